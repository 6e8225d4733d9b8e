import os

import pytest
from pyspark.sql import functions as F

from cargoline.operators import taxonomy
from cargoline.sources import snapshots

FIELDS = "hs_code_prefix string, product_line string, industry_name string, default_type string, source string"


def inodes(base):
    return {os.path.relpath(os.path.join(folder, n), base) for folder, _, names in os.walk(f"{base}/data") for n in names if n.endswith(".parquet")}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    base = str(tmp_path / "t")
    rows = spark.createDataFrame([(f"{k:04d}", "L", f"name {k}", "NC", "s") for k in range(200)], FIELDS)
    first = snapshots.create(rows, base, "hs_code_prefix", buckets=16)
    before = inodes(base)
    updates = spark.createDataFrame([("00.07", "M", "new", "lk", 1), ("9999", "M", "added", "NC", 2), ("0008", "M", "bad", "??", 3)],
                                    "hs_code_prefix string, product_line string, industry_name string, default_type string, seq int")
    second = taxonomy.merge_into(spark, base, updates, spark.createDataFrame([("0009",)], "hs_code_prefix string"))
    touched = {r[0] for r in spark.createDataFrame([(c,) for c in ("0007", "9999", "0008", "0009")], "c string").select(snapshots.bucket(F.col("c"), 16)).collect()}
    assert {b for b in first.files if first.files[b] != second.files.get(b)} <= touched and len(touched) <= 4
    assert before <= inodes(base) and len(inodes(base)) <= len(before) + len(touched)
    old, new = ({r.hs_code_prefix: (r.industry_name, r.source) for r in snapshots.read(spark, base, v).collect()} for v in (0, 1))
    assert old == {f"{k:04d}": (f"name {k}", "s") for k in range(200)}
    want = old | {"0007": ("new", "user_input"), "9999": ("added", "user_input")}
    del want["0009"]
    assert new == want and snapshots.versions(spark, base) == [0, 1] and snapshots.read(spark, base).count() == 200


def test_conflicts_empty_tables_and_null_keys(spark, tmp_path):
    base = str(tmp_path / "t")
    rows = spark.createDataFrame([(None, 1), ("a", 2), ("a", 2)], "k string, v int")
    snapshots.create(rows, base, "k", buckets=4)
    with pytest.raises(snapshots.Conflict):
        snapshots.create(rows, base, "k", buckets=4)
    assert snapshots.versions(spark, base) == [0] and snapshots.read(spark, base).count() == 3
    with pytest.raises(ValueError):  # the change makes a row of a bucket that it was not given
        snapshots.merge(spark, base, spark.createDataFrame([("a",)], "k string"), lambda old: old.unionByName(spark.createDataFrame([(f"x{k}", 0) for k in range(40)], "k string, v int")))
    snapshots.merge(spark, base, rows.select("k"), lambda old: old.where("false"))
    assert snapshots.read(spark, base).count() == 0 and snapshots.read(spark, base, 0).count() == 3
    snapshots.merge(spark, base, spark.createDataFrame([("b",)], "k string"), lambda old: old.unionByName(spark.createDataFrame([("b", 5)], "k string, v int")))
    assert [tuple(r) for r in snapshots.read(spark, base).collect()] == [("b", 5)]
    snapshots.merge(spark, base, rows.where("false").select("k"), lambda old: old)
    assert snapshots.versions(spark, base) == [0, 1, 2, 3]
