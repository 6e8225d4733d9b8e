"""Shards of bounded size by extendible hashing.

A bucket is a prefix of the key's hash bits. The directory starts with one bucket; only a bucket over the byte limit splits on one more
bit, so every row's shard is the shortest prefix whose bucket fits. Sizes are summed at the longest prefix of a stretch of ``STEP`` bits
first, and the shorter prefixes are summed from those; rows whose bucket is still too large go on with the next stretch. ``shard`` writes every shard to a folder of its own and reads them back.

A key may repeat: when all its bits are used up, bits of a number drawn per row go on splitting, so a key with a third of all rows fills as
many shards as it needs. A bucket of one row is never split: a row over the limit gets a shard of its own. Null texts have no bytes, a
null key hashes as the word null; an empty table has no shards. Every row is kept, repeated ones too. Columns of the table that have a name of the
result's (n_bytes, shard, depth, shard_bytes, shard_rows) give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from cargoline.session import materialize, scratch_path

HASH_BITS = 60
STEP = 12
#: Both hashes together; a bucket of several rows that agree in all bits stays as it is.
MOST_BITS = 2 * HASH_BITS


def key_hash(key: Column) -> Column:
    """The first 60 bits of the MD5 digest of the key as text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def _cut(column: str, depth: Column) -> Column:
    """The prefix of ``depth`` bits of a hash, zero for none."""
    return F.call_function("shiftright", F.col(column), (F.lit(HASH_BITS) - F.least(F.greatest(depth, F.lit(0)), F.lit(HASH_BITS))).cast("int"))


def _prefix(depth: Column) -> list[Column]:
    return [_cut("h1", depth).alias("p1"), _cut("h2", depth - HASH_BITS).alias("p2")]


def _kept(rows: DataFrame) -> DataFrame:
    """Whole rows, written once and read back; with zstd, as they lie on disk beside their shuffle and the shards."""
    path = scratch_path(rows.sparkSession, "shard-rows")
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def assign(rows: DataFrame, key: str, size: Column, limit: int) -> DataFrame:
    """``rows`` with ``n_bytes``, ``shard`` (the bits of its prefix), ``depth``, ``shard_bytes`` and ``shard_rows``."""
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in ("n_bytes", "shard", "depth", "shard_bytes", "shard_rows")]
    placed = rows.select(F.struct(*kept).alias("row"), F.coalesce(size, F.lit(0)).cast("bigint").alias("n_bytes"), key_hash(F.col(f"`{key}`")).alias("h1"),
                         F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 4).alias("h2"))
    open_rows, base, done = _kept(placed), 0, []
    while base < MOST_BITS:
        last = min(base + STEP, MOST_BITS)
        leaves = materialize(open_rows.groupBy(*_prefix(F.lit(last))).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n")).select(
            F.col("p1").alias("l1"), F.col("p2").alias("l2"), _back("p1", last, 0).alias("h1"), _back("p2", last, HASH_BITS).alias("h2"), "bytes", "n"), "shard-leaves")
        depths = leaves.withColumn("depth", F.explode(F.sequence(F.lit(base), F.lit(last)))).select("l1", "l2", "bytes", "n", "depth", *_prefix(F.col("depth")))
        sums = depths.groupBy("depth", "p1", "p2").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | (F.col("depth") == MOST_BITS))
        best = depths.join(fits, ["depth", "p1", "p2"]).groupBy("l1", "l2").agg(
            F.min(F.struct("depth", "p1", "p2", "shard_bytes", "shard_rows")).alias("best"))
        best = materialize(best, "shard-directory")
        marked = open_rows.withColumns({"l1": _cut("h1", F.lit(last)), "l2": _cut("h2", F.lit(last - HASH_BITS))}).join(best, ["l1", "l2"], "left")
        done.append(marked.where("best IS NOT NULL").select("row", "n_bytes", "best"))
        if leaves.join(best, ["l1", "l2"], "left_anti").isEmpty():
            break
        open_rows = _kept(marked.where("best IS NULL").select("row", "n_bytes", "h1", "h2"))
        base = last
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    first = F.lpad(F.bin("best.p1"), F.least(F.col("best.depth"), F.lit(HASH_BITS)), "0")
    second = F.when(F.col("best.depth") > HASH_BITS, F.lpad(F.bin("best.p2"), F.col("best.depth") - HASH_BITS, "0")).otherwise("")
    return every.select("row.*", "n_bytes", F.concat(F.when(F.col("best.depth") > 0, first).otherwise(""), second).alias("shard"),
                        F.col("best.depth").alias("depth"), F.col("best.shard_bytes").alias("shard_bytes"), F.col("best.shard_rows").alias("shard_rows"))


def _back(prefix: str, depth: int, start: int) -> Column:
    """The smallest hash that has the prefix."""
    return F.shiftleft(prefix, HASH_BITS - min(max(depth - start, 0), HASH_BITS))


def write(sharded: DataFrame, path: str) -> None:
    """Write the rows of ``assign`` with each shard in a folder of its own, one file each; a shard is small enough for one task."""
    sharded.repartition("shard").write.option("compression", "zstd").partitionBy("shard").parquet(path)


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The shards that ``write`` wrote from rows of ``schema``; a shard's name stays text, and the undivided one has the empty name."""
    return spark.read.schema(schema).parquet(path).withColumn("shard", F.coalesce("shard", F.lit("")))


def shard(rows: DataFrame, key: str, size: Column, limit: int, path: str) -> DataFrame:
    """Assign ``rows`` to shards, write these below ``path`` and return what the written files hold, with ``n_bytes`` and ``shard``."""
    placed = assign(rows, key, size, limit).drop("depth", "shard_bytes", "shard_rows")
    write(placed, path)
    return read(rows.sparkSession, path, placed.schema)
