"""Tables of many rows in small files are no broadcasts, so that the driver never holds them."""

import re

import pytest

from cargoline.llm import graph, simhash
from cargoline.operators import classifier, linear, match
from cargoline.plans import views
from cargoline.session import BROADCAST_ROWS, apart, materialize


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rows,strategy", [(1000, "BroadcastHashJoin"), (BROADCAST_ROWS + 1, "SortMergeJoin")])
def test_apart_goes_by_rows(spark, rows, strategy):
    table = materialize(spark.range(rows).selectExpr("id", "'the same in every row' AS label"), "packed")
    asked = spark.range(BROADCAST_ROWS * 10).selectExpr("id", "id AS other", "string(id) AS text")
    found = asked.join(apart(table), "id")
    assert strategy in plan(found) and found.count() == rows


def test_predict_does_not_broadcast_the_weights(spark):
    n = BROADCAST_ROWS + 1
    grams = materialize(spark.range(n).selectExpr("'84' AS hs_code", "concat('w', id) AS gram", "if(id % 2 = 0, 'even', 'odd') AS label", "1L AS c"), "grams")
    classes = spark.createDataFrame([("84", x, n // 2, n, n // 2, n) for x in ("even", "odd")], "hs_code string, label string, n_label bigint, n_group bigint, n_tokens bigint, vocab bigint")
    rows = spark.createDataFrame([(1, "84", "w2 w4 w5"), (2, "84", "w1 w3")], "row_id bigint, hs_code string, clean_text string")
    found = classifier.predict(classifier.BayesModel(("hs_code",), grams, materialize(classes, "classes")), rows)
    assert re.search(r"SortMergeJoin \[hs_code\S*, gram", plan(found))
    assert {(r.row_id, r.label) for r in found.collect()} == {(1, "even"), (2, "odd")}


def test_goods_do_not_broadcast_parts_or_orders(spark, tmp_path):
    rows = {"part": spark.range(BROADCAST_ROWS + 1).selectExpr("id AS p_partkey", "'large ring' AS p_name", "'Brand#7' AS p_brand", "'LARGE' AS p_type", "1 AS p_size", "9D AS p_retailprice"),
            "orders": spark.sql("SELECT 7L AS o_orderkey, 1L AS o_custkey, 'O' AS o_orderstatus, 1D AS o_totalprice, timestamp_ntz'1995-02-01' AS o_orderdate, '1' AS o_orderpriority"),
            "lineitem": spark.sql("SELECT 7L AS l_orderkey, 5L AS l_partkey, 1L AS l_suppkey, 1 AS l_linenumber, 2D AS l_quantity, 3D AS l_extendedprice, 0D AS l_discount, 0D AS l_tax,"
                                  " 'A' AS l_returnflag, 'F' AS l_linestatus, timestamp_ntz'1995-02-02' AS l_shipdate")}
    for name, df in rows.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    spark.range(BROADCAST_ROWS).selectExpr("id + 100 AS o_orderkey", "1L AS o_custkey", "'O' AS o_orderstatus", "1D AS o_totalprice", "timestamp_ntz'1995-02-01' AS o_orderdate",
                                           "'1' AS o_orderpriority").write.mode("append").parquet(f"{tmp_path}/orders.parquet")
    found = views.goods(spark, str(tmp_path))
    assert re.search(r"SortMergeJoin \[o_orderkey", plan(found))
    assert re.search(r"SortMergeJoin \[l_partkey", plan(found))
    assert [(r.row_id, r.class1) for r in found.collect()] == [(7, "ring")]


@pytest.mark.parametrize("hits,joined", [("phrase_hits", "hs_code"), ("overlap_hits", "hs_code"), ("weighted_hits", "keyword"), ("masked_hits", "keyword")])
def test_words_of_texts_are_not_broadcast(spark, hits, joined):
    """Texts in a smaller file than the dictionary: their words and n-grams must not be the side that is sent to the driver."""
    texts = materialize(spark.range(20).selectExpr("id AS row_id", "'84' AS hs_code", "repeat('copper ring ', 20) || 'fan' AS clean_text"), "texts")
    entries = materialize(spark.range(5000).selectExpr("id AS entry_id", "'84' AS hs_code", "array(if(id = 7, 'copper ring', md5(string(id))), sha(string(id))) AS keywords",
                                                       "md5(string(id + 1)) AS product_line", "'NC' AS kind", "'x' AS class1", "md5(string(id + 2)) AS class2"), "dictionary")
    found = getattr(match, hits)(texts, entries)
    joins = [line for line in plan(found).splitlines() if re.search(rf"Join \[{joined}#", line)]
    assert joins and not [line for line in joins if "BuildLeft" in line]
    assert found.count() == 20


@pytest.mark.parametrize("rows,strategy", [(1000, "BroadcastHashJoin"), (BROADCAST_ROWS + 1, "SortMergeJoin")])
def test_margins_do_not_broadcast_many_weights(spark, rows, strategy):
    """The salts of frequent grams are joined first; without any, the plan is changed at run time, and then the weights' file is small enough for a broadcast."""
    weights = materialize(spark.range(rows).selectExpr("'84' AS hs_code", "concat('w', id) AS gram", "'ring' AS label", "0.5D AS u", "2D AS w"), "weights")
    x = materialize(spark.range(BROADCAST_ROWS * 2).selectExpr("'84' AS hs_code", "id AS row_id", "concat('w', id) AS gram", "3D AS v"), "features")
    hot = materialize(spark.sql("SELECT 1L AS _hash, 1L AS _n"), "hot")
    found = linear.margins(x, weights, hot)
    got = found.collect()
    assert len(got) == rows and {r.margin for r in got} == {6.0}
    final = plan(found).split("== Initial Plan ==")[0]
    assert re.search(rf"{strategy} \[hs_code\S*, gram", final)


def test_cells_of_fingerprints_are_no_broadcast(spark):
    """The fingerprints' file is small enough for a broadcast, the cells that are made of each are not."""
    points = materialize(spark.range(20_000).selectExpr("xxhash64(id) AS fingerprint", "id AS group"), "points")
    assert "Broadcast" not in plan(simhash._range_join(points, 4))


def test_many_edges_are_no_broadcast(spark):
    edges = materialize(spark.range(BROADCAST_ROWS + 1).selectExpr("id + 1 AS u", "0L AS v"), "edges")
    assert "Broadcast" not in plan(graph._large_star(edges)) and "Broadcast" not in plan(graph._small_star(edges))
    assert graph._small_star(graph._large_star(edges)).count() == BROADCAST_ROWS + 1


def test_known_grams_are_shuffled_once(spark):
    """A gram's labels go in one row to the join on the gram: no second row or shuffle for the number of known grams."""
    n = BROADCAST_ROWS + 1
    grams = materialize(spark.range(n).selectExpr("'84' AS hs_code", "concat('w', id div 2) AS gram", "if(id % 2 = 0, 'even', 'odd') AS label", "1L + id % 2 AS c"), "grams")
    classes = spark.createDataFrame([("84", x, n // 2, n, n // 2, n) for x in ("even", "odd")], "hs_code string, label string, n_label bigint, n_group bigint, n_tokens bigint, vocab bigint")
    rows = spark.createDataFrame([(1, "84", "w2 w4 w5"), (2, "84", ""), (3, "84", "new")], "row_id bigint, hs_code string, clean_text string")
    found = classifier.predict(classifier.BayesModel(("hs_code",), grams, materialize(classes, "classes")), rows)
    before = plan(found).split("== Initial Plan ==")[-1]
    assert len(re.findall(r"Exchange hashpartitioning\(hs_code\S*, gram", before)) == 2 and "Union" not in before
    got = {r.row_id: (r.label, round(r.confidence, 6)) for r in found.collect()}
    assert got == {1: ("odd", round(27 / 35, 6)), 2: ("even", 0.5), 3: ("even", 0.5)}
