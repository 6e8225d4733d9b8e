"""Joins and ids that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargoline.session import apart, materialize

#: Any key that holds more than 1/1024 of the rows is among the 1024 most frequent ones, so this many keys are enough,
#: and a broadcast of them has a fixed bound.
HOT_KEYS = 1024
#: Rows of one key that may share a task; a key gets as many salts as it has rows of this many.
ROWS_PER_SALT = 200_000


def hottest(counts: DataFrame, keys: Sequence[str], count_col: str, limit: int = HOT_KEYS) -> DataFrame:
    """Hashes of the ``limit`` most frequent keys of an aggregated count table with their counts: a top-k over 16-byte rows.

    Hashes keep the result to a few kilobytes however long the keys are. Two keys with one hash are both taken as hot,
    which costs a little work and changes nothing.
    """
    hashed = counts.select(F.xxhash64(*keys).alias("_hash"), F.col(count_col).alias("_n"))
    return hashed.orderBy(F.desc("_n"), "_hash").limit(limit).groupBy("_hash").agg(F.sum("_n").alias("_n"))


def join_hot(left: DataFrame, right: DataFrame, keys: Sequence[str], hot: DataFrame, spread_by: Column,
             how: str = "left", measured: DataFrame | None = None, rows_per_salt: int = ROWS_PER_SALT, merge: bool = False) -> DataFrame:
    """Equi-join of a large ``left`` with ``right``, with the rows of ``hot`` keys split over as many partitions as they need.

    ``hot`` comes from ``hottest``: at most ``HOT_KEYS`` hashes with counts. Left rows of a hot key get one of
    ceil(count / ``rows_per_salt``) salts from ``spread_by``; the right rows of that key are repeated once per salt. Every other row
    has salt 0, so nothing else is repeated. ``measured`` names the written table that ``right`` is derived from: with many rows in it ``right`` is no
    broadcast (see ``session.apart``; a hint on ``right`` itself would end at the join with the salts). ``merge`` keeps both sides out of broadcasts whatever their size.
    """
    keys = list(keys)
    for key in keys:
        if left.schema[key].dataType != right.schema[key].dataType:
            raise TypeError(f"join key {key} has different types: hashes would differ")
    marks = F.broadcast(hot.select("_hash", F.ceil(F.col("_n") / rows_per_salt).cast("int").alias("_salts")).where("_salts > 1"))
    marked = lambda df: df.withColumn("_hash", F.xxhash64(*keys)).join(marks, "_hash", "left").drop("_hash")
    many = F.coalesce("_salts", F.lit(1))
    salted_left = marked(left).withColumn("_salt", F.pmod(F.xxhash64(spread_by), many).cast("int")).drop("_salts")
    salted_right = marked(right).withColumn("_salt", F.explode(F.sequence(F.lit(0), many - 1))).drop("_salts")
    if merge:
        salted_right = salted_right.hint("merge")
    elif measured is not None:
        salted_right = apart(salted_right, measured)
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")


def number_sorted(df: DataFrame, order_by: str, name: str) -> DataFrame:
    """Dense 0-based number of each row in the order of ``order_by``, without sorting the table in one task.

    The rows are range-partitioned and written once, so that partition numbers are facts and not recomputed; rows are
    numbered inside their range and shifted by the size of the ranges before. Only one count per range meets in one task.
    """
    ranged = materialize(df.repartitionByRange(order_by).withColumn("_range", F.spark_partition_id()), "ranges")
    running = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(order_by)) - 1
    return (ranged.withColumn("_inside", inside).join(offsets, "_range")
            .withColumn(name, F.col("_offset") + F.col("_inside")).drop("_range", "_inside", "_offset"))
