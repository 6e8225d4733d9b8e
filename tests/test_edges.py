"""Inputs that the fixtures don't hold: null keys, repeated row ids, quoted line breaks, mixed files, empty lists."""

from pyspark.sql import functions as F

from cargoline import constants as K
from cargoline.functions import text
from cargoline.operators import dictionary as D
from cargoline.operators import match, standardize
from cargoline.plans import cascade
from cargoline.sources import files, tables

LABEL = "product_line string, kind string, class1 string, class2 string"
KNOWN = [("8501", "big bolt", "L", "NC", "bolt", "big"), ("8501", "small ring", "L", "NC", "ring", "small")]


def known(spark):
    return spark.createDataFrame(KNOWN, f"hs_code string, clean_text string, {LABEL}")


def entries(spark):
    return spark.createDataFrame([(1, "8501", ["gear"], "L", "NC", "gear", "any")], f"entry_id int, hs_code string, keywords array<string>, {LABEL}")


def test_repeated_row_ids_keep_their_own_label(spark):
    rows = spark.createDataFrame([(1, "8501", "big bolt"), (1, "8501", "small ring"), (1, "8501", "gear")], "row_id int, hs_code string, clean_text string")
    got = cascade.classify(rows, known(spark), entries(spark)).select("clean_text", "class1", "status").collect()
    assert sorted(map(tuple, got)) == [("big bolt", "bolt", K.STATUS_HISTORY), ("gear", "gear", K.STATUS_DICTIONARY), ("small ring", "ring", K.STATUS_HISTORY)]
    found = match.match_phrase(rows, entries(spark)).select("keyword").collect()
    assert [r.keyword for r in found] == ["gear"]


def test_null_keys_go_to_review(spark):
    rows = spark.createDataFrame([(1, None, "big bolt"), (2, "8501", None), (None, None, None), (4, "", "")], "row_id int, hs_code string, clean_text string")
    got = cascade.classify(rows, known(spark), entries(spark)).collect()
    assert len(got) == 4 and all(r.status == K.STATUS_REVIEW and r.confidence == 0 and r.class1 == "" for r in got)
    assert sorted(str(r.hs_code) for r in got) == ["", "8501", "None", "None"]


def test_empty_word_lists(spark):
    df = spark.createDataFrame([("led lamp",)], "t string")
    row = df.select(text.any_term(F.col("t"), []).alias("a"), text.without("split(t, ' ')", []).alias("w")).first()
    assert row.a is False and row.w == ["led", "lamp"]


def test_rows_without_tokens_have_no_draft_group(spark):
    rows = spark.createDataFrame([(1, "8501", "motor", "A"), (2, "8501", "12", "A")], "row_id int, hs_code string, product_name string, product_line string")
    rows = rows.withColumns({c: F.lit("x") for c in ("kind", "class1", "class2")})
    assert [r.row_id for r in D.tag_rows(rows, D.draft_groups(rows)).collect()] == [1]


def test_mixed_import_and_export_rows(spark):
    rows = spark.createDataFrame([("1", "a", "Seller", None, "Abroad", None), ("2", "b", None, "Buyer", None, "Maker")],
                                 "HS_Code string, Detailed_Product string, VN_Exporter string, VN_Importer string, Foreign_Importer string, Foreign_Exporter string")
    got = {r.hs_code: (r.trade_direction, r.importer, r.exporter) for r in standardize.standardize(rows).collect()}
    assert got == {"1": ("export", "Abroad", "Seller"), "2": ("import", "Buyer", "Maker")}


def test_reader_keeps_quoted_breaks_repeated_headers_and_counts_fields(spark, tmp_path):
    head = "HS_Code,Detailed_Product"
    (tmp_path / "broken.csv").write_text(f'{head}\n1,"two\nlines"\n2,plain\n', encoding="utf-8")
    got = files.scan(spark, [str(tmp_path / "broken.csv")])
    assert sorted((r.HS_Code, r.Detailed_Product) for r in got.collect()) == [("1", "two\nlines"), ("2", "plain")]
    (tmp_path / "again.csv").write_text(f'{head}\n1,x\n{head}\n2,y,\n3,"a, ""b"""\n', encoding="utf-8")
    rows = files.scan_lines(spark, [str(tmp_path / "again.csv")]).collect()
    assert sorted((r.HS_Code, r.Detailed_Product) for r in rows if not r.malformed) == [("1", "x"), ("3", 'a, "b"'), ("HS_Code", "Detailed_Product")]
    assert sum(r.malformed for r in rows) == 1
    (tmp_path / "long.csv").write_text("\n".join(["t" * 9000] * K.PREAMBLE_LINES + [head, "7,café"]), encoding="latin1")
    got = files.scan(spark, [str(tmp_path / "long.csv")]).collect()
    assert [(r.HS_Code, r.Detailed_Product) for r in got] == [("7", "café")]


def test_dictionary_files_keep_path_order_and_counts(spark, tmp_path):
    both = entries(spark).withColumn("n_products", F.lit(7).cast("bigint"))
    tables.write_dictionary(both, str(tmp_path / "z"))
    tables.write_dictionary(both.withColumn("keywords", F.array(F.lit("bolt"))).drop("n_products"), str(tmp_path / "a"))
    paths = [files.list_files(spark, str(tmp_path / n), ".csv")[0] for n in ("z", "a")]
    got = tables.load_dictionary(spark, paths).orderBy("entry_id").collect()
    assert [(r.keywords, r.n_products) for r in got] == [(["gear"], 7), (["bolt"], None)]


def test_saved_knowledge_is_replaced_at_once(spark, tmp_path):
    from cargoline.operators import classifier
    from cargoline.plans.refresh import Knowledge, load, save

    truth = known(spark)
    model = classifier.train(truth.withColumn("label", F.col("class1")))
    first = save(Knowledge(truth, entries(spark), model), str(tmp_path))
    second = save(Knowledge(truth.limit(1), entries(spark), model), str(tmp_path))
    got = load(spark, str(tmp_path))
    assert first != second and got.ground_truth.count() == 1 and got.model.group == model.group
    assert sorted(map(tuple, got.model.classes.collect())) == sorted(map(tuple, model.classes.collect()))
