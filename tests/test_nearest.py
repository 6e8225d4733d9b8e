"""Pivot look-ups against comparing all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cargoline.operators import classifier, nearest

SCHEMA = "vec_id bigint, embedding array<float>, block int"


def points(seed, n=160, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, dims))
    v = np.concatenate([centres[rng.integers(0, 7, n)] + rng.normal(scale=0.25, size=(n, dims)), centres[:2], centres[:2], centres[:2], rng.normal(size=(20, dims))])
    return [(i, [float(np.float32(x)) for x in row], int(i % 3 == 0)) for i, row in enumerate(v)]


def cosines(rows):
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v @ v.T


def clusters(rows, least, samples):
    near = cosines(rows) >= least - 1e-12
    near &= np.array([[a[2] == b[2] for b in rows] for a in rows])
    n = near.sum(axis=1)
    core = n >= samples
    name = {}
    for i in range(len(rows)):
        if core[i] and i not in name:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in name:
                    name[k] = i
                    todo += [j for j in np.flatnonzero(near[k]) if core[j]]
    for i in range(len(rows)):
        if not core[i] and (with_core := [j for j in np.flatnonzero(near[i]) if core[j]]):
            name[i] = name[min(with_core)]
    return [(i, int(n[i]), bool(core[i]), name.get(i)) for i in range(len(rows))]


@pytest.mark.parametrize("seed,least,samples", [(1, 0.9, 5), (2, 0.97, 3), (3, 0.5, 20)])
def test_density_clusters(spark, seed, least, samples):
    rows = points(seed)
    odd = [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] * 8, 1), (903, [None] * 8, 0)]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    got = sorted(tuple(r) for r in nearest.density_clusters(df, least, samples, block=["block"]).select("vec_id", "n_near", "core", "cluster").collect())
    expected = clusters(rows, least, samples)
    assert got[:-4] == expected and got[-4:] == [(i, 0, False, None) for i in range(900, 904)]
    assert len({e[3] for e in expected}) > 1


def test_nearest(spark):
    rows, entries = points(4), points(5, n=60)
    cos = cosines([*rows, *entries])[: len(rows), len(rows) :]
    q = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("vec_id", "row_id")
    e = spark.createDataFrame(entries, SCHEMA).withColumnRenamed("vec_id", "entry_id")
    got = {r.row_id: (r.entry_id, round(r.cosine, 9)) for r in nearest.nearest(q, e, 0.55).collect()}
    best = {i: min((-round(cos[i, j], 12), j) for j in range(len(entries))) for i in range(len(rows))}
    assert got == {i: (j, round(-c, 9)) for i, (c, j) in best.items() if -c >= 0.55} and 0 < len(got)
    assert nearest.nearest(q, e.limit(0), 0.55).count() == 0 and nearest.nearest(q.limit(0), e, 0.55).count() == 0


def test_few_pairs_meet(spark):
    """Families that are apart don't meet: far fewer rows than the square are joined."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 24))
    v = centres[rng.integers(0, 40, 1200)] + rng.normal(scale=0.05, size=(1200, 24))
    df = spark.createDataFrame([(i, [float(x) for x in row], 0) for i, row in enumerate(v)], SCHEMA.replace("float", "double"))
    unit = df.select("vec_id", nearest.unit(df["embedding"]).alias("v"))
    known = nearest.placed(unit, "v", nearest.choose_pivots(unit, "v"), ["vec_id"])
    met = nearest.meeting(known, known, [], (2 - 2 * 0.95) ** 0.5).count()
    assert met < 1200 * 1200 / 8


def test_meeting_is_dealt_out(spark, monkeypatch):
    """Neither side goes to the driver, and rings of many asking rows are cut without losing or repeating a pair."""
    monkeypatch.setattr(nearest, "ASKING_PER_TASK", 7)
    rows = points(5)
    vectors = spark.createDataFrame(rows, SCHEMA).selectExpr("vec_id AS point", "block", "embedding").withColumn("v", nearest.unit(F.col("embedding")))
    known = nearest.placed(vectors, "v", nearest.choose_pivots(vectors, "v"), ["block", "point"])
    met = nearest.meeting(known, known, ["block"], (2 - 2 * 0.9) ** 0.5)
    found = [(r.q_point, r.e_point) for r in met.collect()]
    near = {(a[0], b[0]) for a in rows for b in rows if a[2] == b[2] and cosines([a, b])[0, 1] >= 0.9}
    assert near <= set(found) and len(found) == len(set(found))
    joins = [line for line in met._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines() if "cell" in line and "Join [" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


@pytest.mark.parametrize("least", [0.5, 0.9])
def test_files_meet_once(spark, monkeypatch, least):
    """Small files and strips: all near pairs of a block, both ways and once, without a join of vectors; files that are too far apart don't meet."""
    monkeypatch.setattr(nearest, "PACK", 16)
    monkeypatch.setattr(nearest, "STRIP", 5)
    rows = points(8)
    meetings = []
    monkeypatch.setattr(nearest, "meeting", lambda *a: meetings.append(a))
    _, pairs = nearest.near_pairs(spark.createDataFrame(rows + [(700, rows[0][1], None), (701, None, 1)], SCHEMA), least, block=["block"])
    got = [tuple(r) for r in pairs.select("a", "b").collect()]
    cos = cosines(rows)
    point = {}
    for i, r in enumerate(rows):
        point[i] = next((j for j in range(i) if rows[j][2] == r[2] and rows[j][1] == r[1]), i)
    want = {(i, j) for i in range(len(rows)) for j in range(len(rows)) if rows[i][2] == rows[j][2] and point[i] == i and point[j] == j and i != j and cos[i, j] >= least}
    assert len(got) == len(set(got)) and set(got) == want and not meetings


def test_above_all_in_files(spark, monkeypatch):
    """The stronger neighbour wins in whatever file it is; rows of equal strength keep each other; null labels and vectors stay."""
    monkeypatch.setattr(nearest, "PACK", 16)
    rows = [(i, v, block, round((i * 37 % 11) / 10, 1)) for i, v, block in points(9)]
    odd = [(800, None, 1, 0.5), (801, [0.0] * 8, 0, 0.5), (802, rows[0][1], None, 0.1)]
    got = sorted(r.vec_id for r in classifier.above_all(spark.createDataFrame(rows + odd, SCHEMA + ", confidence double"), "block", 0.8).collect())
    cos = cosines(rows)
    stronger = lambda a, b: (b[3], -b[0]) > (a[3], -a[0])
    kept = [a[0] for a in rows if not any(a[2] == b[2] and cos[a[0], b[0]] > 0.8 and stronger(a, b) for b in rows)]
    assert got == kept + [800, 801, 802] and len(kept) < len(rows) / 2
