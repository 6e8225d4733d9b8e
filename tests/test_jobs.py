"""Dictionary, classifier, cascade and maintenance jobs on small tables, against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cargoline import constants as K
from cargoline.functions import text
from cargoline.operators import classifier, dictionary, dictionary as D, joins, knowledge, report, taxonomy
from cargoline.plans import cascade, refresh
from cargoline.session import shared_dir

L4 = "product_line string, kind string, class1 string, class2 string"


def test_number_sorted_is_dense_and_ordered(spark):
    df = spark.createDataFrame([(f"k{i * 7919 % 1000:04d}",) for i in range(1000)], "k string").repartition(5)
    got = joins.number_sorted(df, "k", "n").orderBy("k").collect()
    assert [r.n for r in got] == list(range(1000))


def test_join_hot_equals_plain_join(spark):
    left = spark.range(3000).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50))
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    counts = left.groupBy("k").agg(F.count("*").alias("n"))
    hot = joins.hottest(counts, ["k"], "n", 5)
    for how in ("left", "inner"):
        a = joins.join_hot(left, right, ["k"], hot, F.col("id"), how, rows_per_salt=100).select("id", "k", "v")
        b = left.join(right, "k", how).select("id", "k", "v")
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("window", [1000, 4])
def test_top_keywords_equals_greedy_choice(spark, window):
    rnd = random.Random(3)
    rows, expected = [], {}
    for c in range(6):
        grams = {" ".join(rnd.choice(["led", "pha", "oled", "ring", "rin"]) for _ in range(rnd.randint(1, 3))) for _ in range(40)}
        ranked = sorted(((float(rnd.randint(1, 9)), rnd.randint(1, 5), g) for g in grams), key=lambda x: (-x[0], -x[1], x[2]))
        chosen = []
        for _, _, g in ranked:
            if len(chosen) < 5 and not any(g in x for x in chosen):
                chosen.append(g)
        expected[str(c)] = chosen
        rows += [(str(c), g, lf, s) for s, lf, g in ranked]
    df = spark.createDataFrame(rows, "c string, gram string, lf int, score double")
    got = {r.c: r.keywords for r in dictionary.top_keywords(df, ["c"], limit=5, window=window).collect()}
    assert got == expected


def test_tfidf_against_hand_computation(spark):
    docs = {"a": ["x y", "x z"], "b": ["x w w"]}
    rows = [("h", label, t) for label, texts in docs.items() for t in texts]
    df = spark.createDataFrame(rows, "hs_code string, label string, clean_text string")
    tf = {l: Counter(g for t in ts for n in (1, 2, 3) for w in [t.split()] for g in
                     [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)]) for l, ts in docs.items()}
    df_count = Counter(g for c in tf.values() for g in c)
    expected = {}
    for label, counts in tf.items():
        raw = {g: n * (math.log(3 / (1 + df_count[g])) + 1) for g, n in counts.items() if df_count[g] <= 1.8}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        expected.update({(label, g): round(v / norm, 6) for g, v in raw.items()})
    got = {(r.label, r.gram): round(r.weight, 6) for r in dictionary.tfidf_weights(df).collect()}
    assert got == expected and not any(g == "x" for _, g in got)


def test_bayes_probabilities(spark):
    train = [("h", "a", "x y"), ("h", "a", "x"), ("h", "b", "z z"), ("s", "only", "q")]
    model = classifier.train(spark.createDataFrame(train, "hs_code string, label string, clean_text string"))
    ask = spark.createDataFrame([(1, "h", "x"), (2, "h", "unseen"), (3, "s", "q"), (4, "none", "x"), (5, "h", "z z")],
                                "row_id bigint, hs_code string, clean_text string")
    got = {r.row_id: r for r in classifier.predict(model, ask).collect()}
    vocab = 5  # x, y, "x y", z, "z z"
    a, b = 2 / 3 * 3 / (4 + vocab), 1 / 3 * 1 / (3 + vocab)
    assert got[1].label == "a" and abs(got[1].confidence - a / (a + b)) < 1e-9
    assert got[2].label == "a" and abs(got[2].confidence - 2 / 3) < 1e-9
    assert got[3].n_labels == 1 and got[3].confidence == 1.0 and 4 not in got and got[5].label == "b"
    gated = {r.row_id: r.status for r in classifier.gate(classifier.predict(model, ask)).collect()}
    assert gated[3] == K.STATUS_SINGLE and gated[2] == K.STATUS_REVIEW


def test_cascade_covers_each_row_once_with_every_status(spark):
    labels_ = {"a": ("SP A", "NC", "c1", "alpha"), "b": ("SP A", "LK", "c2", "beta")}
    history, n = [], 0
    for i in range(30):
        for name in labels_:
            words = {"a": "bulb warm", "b": "cable long"}[name]
            history.append((n, "9405", f"{words} {name}{i}", f"{words} {name}{i}", *labels_[name]))
            n += 1
    history.append((n, "7020", "glass tube", "glass tube", "SP G", "LK", "glass", "tube"))
    schema = f"row_id bigint, hs_code string, product_name string, clean_text string, {L4}"
    known = refresh.refresh(spark.createDataFrame(history, schema))
    # entries that only know their first words leave work for the later stages
    short = known.dictionary.withColumn("keywords", F.expr("filter(keywords, k -> k in ('bulb warm', 'cable'))"))
    rows = [(1, "9405", "bulb warm a1"), (2, "9405", "new bulb warm"), (3, "9405", "cable x"), (4, "9405", "warm thing"),
            (5, "7020", "unknown"), (6, "9999", "bulb warm"), (7, "", "bulb"), (8, "9405", ""), (9, "9405", "long b3 b4")]
    rows += [(100 + i, "9405", "bulb warm a1") for i in range(200)]
    df = spark.createDataFrame(rows, "row_id bigint, hs_code string, clean_text string")
    out = cascade.classify(df, known.ground_truth, short, known.model).collect()
    assert sorted(r.row_id for r in out) == sorted(r[0] for r in rows)
    status = {r.row_id: r.status for r in out}
    assert status[1] == status[150] == K.STATUS_HISTORY and status[2] == status[3] == status[4] == K.STATUS_DICTIONARY
    assert status[5] == K.STATUS_SINGLE and status[6] == status[7] == status[8] == K.STATUS_REVIEW
    assert status[9] == K.STATUS_MODEL
    assert {r.row_id: r.class2 for r in out}[9] == "beta" and {r.row_id: r.class2 for r in out}[8] == ""
    result = spark.createDataFrame(out)
    assert report.inconsistent_inputs(result, ["hs_code", "clean_text"], "class2").count() == 0
    # one label per input, and the checkpoint folder is the session's
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_ground_truth_drops_conflicts(spark):
    rows = [(1, "h", "P", "p", "l", "NC", "c", "x"), (2, "h", "P", "p", "l", "NC", "c", "y"), (3, "h", "Q", "q", "l", "NC", "c", "x"),
            (4, "h", "Q2", "q", "l2", "NC", "c", "x"), (5, "h", "R", "", "l", "NC", "c", "x"), (6, "h", "S", "s", "l", "NC", "c", None)]
    df = spark.createDataFrame(rows, f"row_id bigint, hs_code string, product_name string, clean_text string, {L4}")
    assert [(r.product_name, r.product_line) for r in knowledge.build_ground_truth(df).collect()] == [("Q", "l")]
    assert sorted(r.row_id for r in knowledge.conflicts(df).collect()) == [1, 2]


def test_near_duplicates_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(6, 16))
    v = np.concatenate([centers[rng.integers(0, 6, 150)] + rng.normal(scale=0.35, size=(150, 16)), centers[:3], centers[:3]])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v = v.astype("float32")
    rows = [(i, float(round(rng.random(), 2)), [float(x) for x in v[i]], int(i % 2)) for i in range(len(v))]
    cos = v.astype(float) @ v.astype(float).T
    kept = [i for i, c, _, b in rows if not any(b == y[3] and cos[i, y[0]] > 0.85 and (y[1], -y[0]) > (c, -i) for y in rows)]
    df = spark.createDataFrame(rows, "vec_id bigint, confidence double, embedding array<float>, block int")
    got = sorted(r.vec_id for r in classifier.above_all(df, "block").collect())
    assert got == kept and 0 < len(kept) < len(rows)


def test_taxonomy_prefix_and_upsert(spark):
    fields = "hs_code_prefix string, product_line string, industry_name string, default_type string, source string"
    tax = spark.createDataFrame([("9405", "L", "four", "NC", "s"), ("940510", "L", "six", "NC", "s")], fields)
    asked = spark.createDataFrame([("94051099",), ("9405",), ("94052000",), ("1234",)], "code string")
    got = {r.code: r.industry_name for r in taxonomy.longest_prefix(asked, tax).collect()}
    assert got == {"94051099": "six", "9405": "four", "94052000": "four", "1234": None}
    updates = spark.createDataFrame([("94.05", "M", "new", "lk", 1), ("94.05", "N", "newer", "LK", 2), ("77", "Z", "bad", "QQ", 3)],
                                    "hs_code_prefix string, product_line string, industry_name string, default_type string, seq int")
    got = {r.hs_code_prefix: (r.product_line, r.source) for r in taxonomy.upsert(tax, updates).collect()}
    assert got == {"9405": ("N", "user_input"), "940510": ("L", "s")}


def test_route_picks_the_dictionary_with_most_headings(spark):
    uploads = spark.createDataFrame([("a", "9405.10"), ("a", "85390000"), ("a", "8539"), ("b", "1111"), ("b", None), ("c", "7020"), ("c", "xx")], "upload string, hs_code string")
    lists = spark.createDataFrame([("d1", 5, "8539, 9405,9405"), ("d2", 9, "9405,7020"), ("d0", 9, "7020"), ("d3", 1, "")], "dictionary_id string, size long, headings string")
    got = {r.upload: (r.dictionary_id, r.overlap) for r in D.route(uploads, lists, "active").collect()}
    assert got == {"a": ("d1", 2), "b": ("active", 0), "c": ("d0", 1)}
    assert D.route(uploads, lists.limit(0)).where("dictionary_id IS NULL").count() == 3


def test_kind_by_three_rules(spark):
    rows = [("Vòng đệm, nắp", "NC", "LK"), ("trục quay", "NC", "NC"), ("trục quay", None, "LK"), ("trục quay", "??", "LK"), ("đèn", "LK", "LK"), ("lamp", None, "NC"), (None, None, "NC")]
    df = spark.createDataFrame(rows, "d string, mapped string, expected string")
    assert df.where(text.kind_by_rules(F.col("d"), F.col("mapped")) != F.col("expected")).count() == 0


def test_longer_keywords_replace_shorter_ones(spark):
    rows = [("x", "đèn led", 9.0, 5), ("x", "đèn led âm", 1.0, 1), ("x", "led", 20.0, 9), ("x", "bóng", 3.0, 2), ("x", "oled", 2.0, 2), ("x", "âm trần", 2.0, 3),
            ("y", "led", 4.0, 4), ("y", "led", 4.0, 4), (None, "led", 4.0, 4), (None, "led pha", 3.0, 1)]
    df = spark.createDataFrame(rows[:7] + rows[8:], "c string, gram string, score double, lf bigint")
    got = {r.c: r.keywords for r in dictionary.maximal_keywords(df, ["c"], limit=3).collect()}
    assert got == {"x": ["bóng", "âm trần", "oled"], "y": ["led"], None: ["led pha"]}
    assert dictionary.maximal_keywords(df, ["c"], limit=9).where("c = 'x'").first().keywords == ["bóng", "âm trần", "oled", "đèn led âm"]
    assert dictionary.maximal_keywords(df.where("false"), ["c"]).count() == 0


def test_deep_page_equals_a_sorted_list(spark):
    values = [(None if k % 11 == 0 else f"t{k * 7919 % 50:02d}", k) for k in range(400)] + [("t10", 1000 + k) for k in range(300)]  # one key holds a large part
    df = spark.createDataFrame(values, "t string, k bigint")
    order = ["t", "k"]
    ranged = report.in_ranges(df.repartition(6), order)
    want = sorted(values, key=lambda v: (v[0] is not None, v[0] or "", v[1]))
    for skip, limit in ((0, 5), (133, 40), (350, 1), (650, 100), (699, 1), (700, 5), (10, 0), (0, 700)):
        assert [(r.t, r.k) for r in report.deep_page(ranged, order, skip, limit).collect()] == want[skip:skip + limit]
    assert report.deep_page(report.in_ranges(df.where("false"), order), order, 0, 5).count() == 0
