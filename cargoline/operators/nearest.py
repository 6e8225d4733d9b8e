"""Exact look-ups among unit vectors by pivots: near pairs, the nearest entry, density clusters.

Two unit vectors with cosine c lie sqrt(2 - 2c) apart, so a cosine threshold is a radius. Every vector knows its distances to a few pivots
(far-apart vectors of a bounded sample, so their number and size are fixed). By the triangle inequality two vectors within the radius differ by no
more than it in their distance to any pivot. Each vector goes to the cell of its nearest pivot; it is looked up in the cells of all pivots that are
not more than two radii farther, since a vector within the radius of it can only be in one of those. Within a cell vectors are cut into
rings of the radius by their distance to the pivot, so that only neighbouring rings meet in an equi-join; distances to the other pivots
sort out most pairs that meet before a cosine is computed. All results are exact, whatever the pivots; only the work depends on them.

Where all vectors are compared with each other (near pairs, stronger neighbours) they are packed, in the order of cell and ring, into files of some thousand, and
files are compared as matrices; two files are left out when their distances to some pivot are farther apart than the radius. The files are read where they are needed, so
nothing is repeated in a shuffle, and a task holds two of them.

Vectors that are null, zero or hold null or non-finite components are near nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cargoline.operators.joins import hottest, join_hot
from cargoline.session import materialize, scratch_path

#: Pivots, and the vectors they are chosen from.
PIVOTS, SAMPLE = 24, 2048
#: Asking rows of one ring that may share a task.
ASKING_PER_TASK = 10_000
#: Added to every bound against rounding; the cosine itself decides.
SLACK = 1e-9
#: Vectors of one file, and rows of it that are compared with another file at one time.
PACK, STRIP = 4096, 512


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def unit(vector: Column) -> Column:
    """The vector in double precision at length one; null where it has no direction."""
    v = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when((norm > 0) & (norm < float("inf")) & ~F.isnan(norm), F.transform(v, lambda x: x / norm))


def choose_pivots(vectors: DataFrame, column: str, pivots: int = PIVOTS, sample: int = SAMPLE) -> list[list[float]]:
    """Far-apart vectors of the ``sample`` with the smallest hashes: each next one is the farthest from those before."""
    rows = vectors.select(column).orderBy(F.xxhash64(column), column).limit(sample).collect()
    if not rows:
        return []
    points = np.array([r[0] for r in rows])
    chosen = [0]
    away = np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < pivots and away.max() > 1e-6:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return points[chosen].tolist()


def placed(vectors: DataFrame, column: str, pivots: list[list[float]], keep: Sequence[str]) -> DataFrame:
    """Adds ``far``, the distances to the pivots, and ``home``, the number of the nearest."""
    if not pivots:
        return vectors.select(*keep, column, F.array().cast("array<double>").alias("far"), F.lit(0).alias("home"))
    listed = F.array(*[F.array(*[F.lit(float(x)) for x in p]) for p in pivots])
    far = F.transform(listed, lambda p: F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot(F.col(column), p))))
    known = vectors.select(*keep, column, far.alias("far"))
    return known.withColumn("home", (F.array_position("far", F.array_min("far")) - 1).cast("int"))


def meeting(asking: DataFrame, given: DataFrame, block: Sequence[str], radius: float) -> DataFrame:
    """Pairs of rows that the bounds leave; the asking side's columns start with ``q_``, the given side's with ``e_``.

    The asking side has a row for each cell and ring it looks into, so it is many times its file: it is dealt out by cell and ring, rings of many asking rows
    over several tasks, and no side is a broadcast.
    """
    width = radius + SLACK
    ring = lambda far: F.floor(far / width).cast("int")
    e = given.select(*block, *[F.col(c).alias(f"e_{c}") for c in given.columns if c not in block], F.col("home").alias("cell"), ring(F.element_at("far", F.col("home") + 1)).alias("ring"))
    near = F.filter(F.transform("far", lambda x, i: F.struct(x.alias("d"), i.alias("i"))), lambda s: s["d"] <= F.array_min("far") + 2 * width)
    q = asking.select(*block, *[F.col(c).alias(f"q_{c}") for c in asking.columns if c not in block], F.explode(near).alias("n"))
    # unit vectors lie two apart at most
    around = F.explode(F.sequence(F.greatest(ring(F.col("n.d")) - 1, F.lit(0)), F.least(ring(F.col("n.d")) + 1, F.greatest(ring(F.lit(2.0 + SLACK)), ring(F.col("n.d"))))))
    q = q.withColumn("cell", F.col("n.i")).withColumn("ring", around).drop("n")
    apart = F.exists(F.zip_with("q_far", "e_far", lambda a, b: F.abs(a - b) > width), lambda x: x)
    keys = [*block, "cell", "ring"]
    hot = materialize(hottest(q.groupBy(*keys).agg(F.count("*").alias("n")), keys, "n"), "hot-rings")
    return join_hot(q, e, keys, hot, F.col("q_far"), "inner", rows_per_salt=ASKING_PER_TASK, merge=True).where(~apart)


def _packs(known: DataFrame, number: str, block: Sequence[str], folder: str) -> DataFrame:
    """(block, ``pack``, ``low``, ``high``): files of at most ``PACK`` vectors of one block in the ``folder``, the bounds of their distances to the pivots."""
    ordered = known.select(*block, F.col(number).cast("bigint").alias("number"), "v", "far", "home", F.element_at("far", F.col("home") + 1).alias("away"))
    by = [*block, "home", "away"]
    ordered = ordered.repartitionByRange(*by).sortWithinPartitions(*by)
    size, labels = PACK, list(block)

    def run(batches):
        from pyarrow import fs

        place, inner = fs.FileSystem.from_uri(folder)
        place.create_dir(inner)
        held, rows = [], 0

        def written(parts):
            table = pa.Table.from_batches(parts).combine_chunks()
            matrix = lambda name: table.column(name).combine_chunks().flatten().to_numpy().reshape(len(table), -1)
            name, far = uuid.uuid4().hex, matrix("far")
            with place.open_output_stream(f"{inner}/{name}") as out:
                for array in (table.column("number").to_numpy(), np.ascontiguousarray(matrix("v"))):
                    np.lib.format.write_array(out, array, allow_pickle=False)
            return pa.RecordBatch.from_arrays([*[table.column(c).combine_chunks()[:1] for c in labels], pa.array([name]), pa.array([far.min(axis=0).tolist()]), pa.array([far.max(axis=0).tolist()])],
                                              names=[*labels, "pack", "low", "high"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                same = lambda k: [batch.column(c)[k].as_py() for c in labels]
                if held and labels and [held[0].column(c)[0].as_py() for c in labels] != same(at):
                    yield written(held)
                    held, rows = [], 0
                end = min(batch.num_rows, at + size - rows)
                if labels and same(end - 1) != same(at):  # sorted by block: the end of its rows
                    low, high = at, end - 1
                    while high - low > 1:
                        middle = (low + high) // 2
                        low, high = (middle, high) if same(middle) == same(at) else (low, middle)
                    end = high
                held.append(batch.slice(at, end - at))
                rows, at = rows + end - at, end
                if rows == size:
                    yield written(held)
                    held, rows = [], 0
        if held:
            yield written(held)

    kinds = ", ".join([*[f"`{c}` {known.schema[c].dataType.simpleString()}" for c in block], "pack string, low array<double>, high array<double>"])
    return materialize(ordered.mapInArrow(run, kinds), "packs")


def compare_all(known: DataFrame, number: str, block: Sequence[str], min_cosine: float, found: Callable, schema: str, strict: bool = False) -> DataFrame:
    """Compares all vectors of a block: ``known`` is ``placed`` and written, ``number`` an integer of each row. For every strip of vectors against a file
    ``found(numbers, other numbers, near, same)`` gives columns of the ``schema``; ``near`` is the matrix of who is within ``min_cosine`` (above it if
    ``strict``), ``same`` the place of the strip in the file if it is the same file. Each two files meet once.
    """
    spark = known.sparkSession
    folder = scratch_path(spark, "packed")
    packs = _packs(known, number, block, folder)
    width = (2 - 2 * min_cosine) ** 0.5 + SLACK
    a, b = packs.alias("a"), packs.alias("b")
    beyond = lambda x, y: F.exists(F.zip_with(f"{x}.low", f"{y}.high", lambda low, high: low - high > width), lambda far: far)
    meet = (F.col("a.pack") <= F.col("b.pack")) & ~beyond("a", "b") & ~beyond("b", "a")
    for c in block:
        meet = meet & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    pairs = a.join(b, meet).select(*[F.col(f"a.{c}").alias(c) for c in block], F.col("a.pack").alias("a"), F.col("b.pack").alias("b"))
    tasks = spark.sparkContext.defaultParallelism * 4
    labels, strip = list(block), STRIP

    def run(batches):
        from pyarrow import fs

        place, inner = fs.FileSystem.from_uri(folder)

        def read(name):
            with place.open_input_file(f"{inner}/{name}") as file:
                return np.lib.format.read_array(file, allow_pickle=False), np.lib.format.read_array(file, allow_pickle=False)

        def near(x, y):
            cosine = x @ y.T
            inside = cosine > min_cosine if strict else cosine >= min_cosine
            # next to the bound the sum goes in the order of ``dot``
            i, j = np.nonzero(np.abs(cosine - min_cosine) < 1e-9)
            if len(i):
                exact = np.zeros(len(i))
                for k in range(x.shape[1]):
                    exact += x[i, k] * y[j, k]
                inside[i, j] = exact > min_cosine if strict else exact >= min_cosine
            return inside

        for batch in batches:
            for row in range(batch.num_rows):
                first, second = batch.column("a")[row].as_py(), batch.column("b")[row].as_py()
                numbers, x = read(first)
                others, y = (numbers, x) if first == second else read(second)
                for at in range(0, len(x), strip):
                    columns = found(numbers[at:at + strip], others, near(x[at:at + strip], y), at if first == second else None)
                    for n in range(0, len(columns[0]), 100_000):
                        part = [pa.array(c[n:n + 100_000]) for c in columns]
                        own = [pa.repeat(batch.column(c)[row], len(part[0])) for c in labels]
                        yield pa.RecordBatch.from_arrays([*own, *part], names=[*labels, *[f"c{k}" for k in range(len(part))]])

    kinds = ", ".join([*[f"`{c}` {known.schema[c].dataType.simpleString()}" for c in block], schema])
    return pairs.repartition(tasks, "a", "b").mapInArrow(run, kinds)


def _both_ways(numbers, others, near, same):
    i, j = np.nonzero(near)
    if same is not None:
        kept = i + same != j
        return numbers[i[kept]], others[j[kept]]
    return np.concatenate([numbers[i], others[j]]), np.concatenate([others[j], numbers[i]])


def weaker(numbers, others, near, same):
    """The numbers that have a larger one near them."""
    larger = others[None, :] > numbers[:, None]
    lost = numbers[(near & larger).any(axis=1)]
    if same is not None:
        return (lost,)
    return (np.concatenate([lost, others[(near & (others[None, :] < numbers[:, None])).any(axis=0)]]),)


def nearest(asking: DataFrame, entries: DataFrame, min_cosine: float, id_col: str = "row_id", entry_col: str = "entry_id", vector: str = "embedding",
            block: Sequence[str] = ()) -> DataFrame:
    """For each asking row the entry of largest cosine, ``min_cosine`` at least (ties: smallest entry id): id, entry, ``cosine``; rows without one are left out.

    Entries are dealt out by cell and ring and never broadcast; equal vectors are asked once.
    """
    q = asking.select(id_col, *block, unit(F.col(vector)).alias("v")).where("v IS NOT NULL")
    e = entries.select(F.col(entry_col).alias("entry"), *block, unit(F.col(vector)).alias("v")).where("v IS NOT NULL")
    e = materialize(e.groupBy(*block, "v").agg(F.min("entry").alias("entry")), "entries")
    pivots = choose_pivots(e, "v")
    if not pivots:
        return q.select(id_col, F.lit(None).cast(entries.schema[entry_col].dataType).alias(entry_col), F.lit(0.0).alias("cosine")).limit(0)
    radius = (2 - 2 * min_cosine) ** 0.5
    once = placed(q.select(*block, "v").distinct().withColumn("at", F.xxhash64("v")), "v", pivots, [*block, "at"])
    pairs = meeting(once, placed(e, "v", pivots, [*block, "entry"]), block, radius)
    scored = pairs.select(*block, F.col("q_v").alias("v"), F.col("e_entry").alias("entry"), dot(F.col("q_v"), F.col("e_v")).alias("cosine")).where(F.col("cosine") >= min_cosine)
    best = scored.groupBy(*block, "v").agg(F.max(F.struct("cosine", (-F.col("entry")).alias("_"))).alias("s"))
    return q.join(best, [*block, "v"]).select(id_col, (-F.col("s._")).alias(entry_col), F.col("s.cosine").alias("cosine"))


def near_pairs(vectors: DataFrame, min_cosine: float, id_col: str = "vec_id", vector: str = "embedding", block: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(classes, pairs): each distinct vector of a block with ``point`` (its smallest id) and ``n`` rows, and all pairs of different points (``a``, ``b``, both ways) within the cosine."""
    rows = vectors.select(F.col(id_col).alias("id"), *block, unit(F.col(vector)).alias("v")).where("v IS NOT NULL")
    classes = materialize(rows.groupBy(*block, "v").agg(F.min("id").alias("point"), F.count("*").alias("n")), "classes")
    pivots = choose_pivots(classes, "v")
    if not pivots:
        return classes, classes.select(*block, F.col("point").alias("a"), F.col("point").alias("b")).limit(0)
    known = materialize(placed(classes, "v", pivots, [*block, "point"]), "placed")
    if known.schema["point"].dataType.typeName() in ("byte", "short", "integer", "long"):
        kind = known.schema["point"].dataType.simpleString()
        return classes, compare_all(known, "point", block, min_cosine, _both_ways, "c0 bigint, c1 bigint").select(*block, F.col("c0").cast(kind).alias("a"), F.col("c1").cast(kind).alias("b"))
    pairs = meeting(known, known, block, (2 - 2 * min_cosine) ** 0.5).where(F.col("q_point") != F.col("e_point"))
    return classes, pairs.where(dot(F.col("q_v"), F.col("e_v")) >= min_cosine).select(*block, F.col("q_point").alias("a"), F.col("e_point").alias("b"))


def density_clusters(vectors: DataFrame, min_cosine: float, min_samples: int, id_col: str = "vec_id", vector: str = "embedding", block: Sequence[str] = ()) -> DataFrame:
    """One row per vector: id, block, ``n_near`` (rows within the cosine, itself included), ``core`` (that many are ``min_samples``), ``cluster``.

    Core vectors within the cosine of each other are one cluster, named by its smallest id; another vector belongs to the cluster of the smallest
    core vector near it (compared by id); the rest are noise: a null cluster. A vector without direction is noise with no near rows. Equal vectors are one
    point that counts as often as it occurs, so copies make no pairs.
    """
    classes, pairs = near_pairs(vectors, min_cosine, id_col, vector, block)
    pairs = materialize(pairs, "near-pairs")
    sizes = classes.select(*block, F.col("point").alias("b"), "n")
    others = pairs.join(sizes, [*block, "b"]).groupBy(*block, "a").agg(F.sum("n").alias("others"))
    points = classes.join(others.withColumnRenamed("a", "point"), [*block, "point"], "left").select(*block, "point", "v", (F.col("n") + F.coalesce("others", F.lit(0))).alias("n_near"))
    points = materialize(points.withColumn("core", F.col("n_near") >= min_samples), "density")
    cores = points.where("core").select(*block, F.col("point"))
    links = pairs.join(cores.withColumnRenamed("point", "a"), [*block, "a"], "left_semi")
    links = materialize(links.select(*block, F.col("a").alias("core_point"), F.col("b").alias("point")), "core-links")
    tied = links.join(cores, [*block, "point"], "left_semi")
    named = cores.join(_smallest_reachable(tied, cores, block), [*block, "point"], "left").select(*block, "point", F.coalesce("cluster", "point").alias("cluster"))
    named = materialize(named, "core-clusters")
    border = links.groupBy(*block, "point").agg(F.min("core_point").alias("core_point"))
    border = border.join(named.withColumnRenamed("point", "core_point"), [*block, "core_point"]).select(*block, "point", F.col("cluster").alias("edge"))
    found = points.join(named, [*block, "point"], "left").join(border, [*block, "point"], "left").select(*block, "v", "n_near", "core", F.coalesce("cluster", "edge").alias("cluster"))
    rows = vectors.select(F.col(id_col), *block, unit(F.col(vector)).alias("v"))
    return rows.join(found, [*block, "v"], "left").select(id_col, *block, F.coalesce("n_near", F.lit(0)).alias("n_near"), F.coalesce("core", F.lit(False)).alias("core"), "cluster")


def _smallest_reachable(links: DataFrame, cores: DataFrame, block: Sequence[str]) -> DataFrame:
    """(block, point, cluster): the smallest core point that links connect to each. Labels sink to neighbours, then jump to their label's label, so the
    rounds grow with the logarithm of a cluster's width; each is written."""
    now = materialize(cores.withColumn("cluster", F.col("point")), "labels")
    while True:
        told = links.join(now.select(*block, F.col("point").alias("core_point"), F.col("cluster").alias("near")), [*block, "core_point"])
        least = told.groupBy(*block, "point").agg(F.min("near").alias("near"))
        sunk = now.join(least, [*block, "point"], "left").select(*block, "point", F.col("cluster").alias("old"), F.least("cluster", "near").alias("cluster"))
        # whoever a label named follows it too
        follow = sunk.groupBy(*block, F.col("old").alias("point")).agg(F.min("cluster").alias("by_name"))
        jump = sunk.join(follow, [*block, "point"], "left").select(*block, "point", "old", F.least("cluster", "by_name").alias("cluster"))
        jump = materialize(jump, "labels")
        up = jump.select(*block, F.col("point").alias("cluster"), F.col("cluster").alias("upper"))
        after = jump.join(up, [*block, "cluster"], "left").select(*block, "point", "old", F.coalesce("upper", "cluster").alias("cluster"))
        after = materialize(after, "labels")
        now = after.drop("old")
        if after.where("cluster <> old").isEmpty():
            return now
