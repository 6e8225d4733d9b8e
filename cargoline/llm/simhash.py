"""Near-duplicates by SimHash, found by a grid over bit counts of segments.

A fingerprint is embedded as the vector of its per-segment bit counts. Two fingerprints that differ in ``d`` bits have vectors at
Manhattan distance ``d`` at most, so a range join over the grid of vectors finds all pairs and more; an exact bit count then decides.
The count of a segment is kept in unary (the segment's bits sorted), which makes a vector one 64-bit number and the Manhattan distance
the bit count of an exclusive or.

The range join: of two fingerprints four bits apart one half has a distance of two at most, and then there is a grid cell one step away
from both (or nearer). Each fingerprint goes to the cells within one step of each half, and a pair is taken in one of the cells they
share, fixed by the pair, so no pair shows twice. Before that, the same grid with segments of one bit and distance two joins whole cells: there
the count vector is the fingerprint, the members of a cell are two bits apart at most, and a star to the smallest is enough.
A family of near copies has come together by then, and the range join only looks for links between different groups: no pairs
within a group are made.

Null and empty texts and texts of white space have fingerprint zero, linked like any other. Equal texts share a fingerprint, and every
row is kept: repeated rows get the same component. A null id never names a component; a component of null ids alone is null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cargoline.llm.batches import add_columns
from cargoline.llm.graph import components
from cargoline.session import apart, materialize

WORDS = 4
DISTANCE = 4

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Hashes whose bits are unpacked at one time.
_BLOCK = 1 << 17


def shingle_hashes(text: str, words: int = WORDS) -> list[int]:
    """Unsigned XXH64 (seed 42) of every shingle, repeats included; the whole sequence where there are fewer words."""
    parts = text.encode().translate(_LOWER).split()
    if not parts:
        return []
    joined = b" ".join(parts)
    if len(parts) <= words:
        return [xxhash.xxh64_intdigest(joined, 42)]
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], 42) for a, b in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist())]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive runs of hashes: a bit is set where more than half of a run have it."""
    ends = np.cumsum(counts)
    totals = np.zeros((len(counts), 64), dtype=np.int64)
    filled = counts > 0
    for first in range(0, len(hashes), _BLOCK):
        part = hashes[first : first + _BLOCK]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        runs = np.flatnonzero(filled & (ends > first) & (ends - counts < first + len(part)))
        totals[runs] += np.add.reduceat(bits, np.maximum(ends[runs] - counts[runs] - first, 0), axis=0, dtype=np.int64)
    packed = np.packbits(totals * 2 > counts[:, None], axis=1)
    return packed.view(">u8").ravel().astype(np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """``docs`` with ``fingerprint``, the 64 bits as a signed number."""

    def run(column: pa.Array) -> dict[str, pa.Array]:
        lists = [np.array(shingle_hashes(t, words) if t else [], dtype=np.uint64) for t in column.to_pylist()]
        counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        return {"fingerprint": pa.array(majority(np.concatenate(lists), counts))}

    return add_columns(docs, text, run, {"fingerprint": "bigint"})


def unary_counts(fingerprint: Column) -> Column:
    """Bit counts of the two-bit segments, each in unary: 00, 01 or 11."""
    even = F.lit(0x5555555555555555)
    one = fingerprint.bitwiseOR(F.shiftrightunsigned(fingerprint, 1)).bitwiseAND(even)
    both = fingerprint.bitwiseAND(F.shiftrightunsigned(fingerprint, 1)).bitwiseAND(even)
    return one.bitwiseOR(F.shiftleft(both, 1))


def _flips(value: Column, bits: int, allowed) -> Column:
    """``value`` itself and with each of its lower ``bits`` bits flipped, where ``allowed(bit number)``."""
    at = F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), allowed) if allowed else F.sequence(F.lit(0), F.lit(bits - 1))
    return F.concat(F.array(value), F.transform(at, lambda i: value.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))))


def _step(vector: Column):
    """Unary codes stay codes: the lower bit of a segment flips where the upper is clear, the upper where the lower is set."""

    def allowed(i: Column) -> Column:
        other = F.call_function("shiftrightunsigned", vector, F.when(i % 2 == 0, i + 1).otherwise(i - 1)) % 2
        return F.abs(other) == i % 2

    return allowed


def _joined_cells(points: DataFrame) -> DataFrame:
    """Edges between fingerprints two bits apart at most: stars in the cells of the one-bit grid, which hold 65 fingerprints at most."""
    cells = points.select("node", F.explode(_flips(F.col("fingerprint"), 64, None)).alias("cell"))
    least = F.min("node").over(W.partitionBy("cell"))
    return cells.select(least.alias("a"), F.col("node").alias("b")).where("a <> b").distinct()


def _own(fingerprint: Column, half: Column) -> Column:
    """The half of a fingerprint's vector, as a cell of the grid."""
    vector = unary_counts(fingerprint)
    return F.when(half == 0, vector.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned(vector, 32))


def _range_join(points: DataFrame, distance: int) -> DataFrame:
    """Edges between groups of points at most ``distance`` (4 at most) bits apart, through cells one step from both."""
    if distance > 4:
        raise ValueError("halves and single steps reach distance four")
    halves = points.select("fingerprint", "group", F.explode(F.array(F.lit(0), F.lit(1))).alias("half")).withColumn("own", _own(F.col("fingerprint"), F.col("half")))
    stepped = halves.select("fingerprint", "group", "half", F.explode(_flips(F.col("own"), 32, _step(F.col("own")))).alias("cell"))
    # a cell and its half in one number; what else a pair needs comes from the fingerprints, so that little is shuffled
    cells = stepped.select("fingerprint", "group", (F.col("cell") + F.col("half") * F.lit(1 << 32)).alias("cell"))
    # the file of the fingerprints says nothing of the cells, 66 at most for each: no side is a broadcast
    a, b = cells.alias("a"), cells.alias("b").hint("merge")
    fa, fb = F.col("a.fingerprint"), F.col("b.fingerprint")
    half = F.shiftrightunsigned("a.cell", 32)
    own = _own(fa, half)
    differing = own.bitwiseXOR(_own(fb, half))
    lowest = differing.bitwiseAND(-differing)
    within = (F.bit_count(differing) == 2) & (differing == lowest * 3) & (lowest.bitwiseAND(F.lit(0x55555555)) != 0) & (own.bitwiseAND(lowest) != 0)
    between = own.bitwiseXOR(F.when(within, lowest * 2).otherwise(lowest))  # one step from a, and one less to b
    manhattan = unary_counts(fa).bitwiseXOR(unary_counts(fb))
    return a.join(b, (F.col("a.cell") == F.col("b.cell")) & (fa < fb) & (F.col("a.group") != F.col("b.group"))
                  & (F.bit_count(manhattan) <= distance) & (F.bit_count(fa.bitwiseXOR(fb)) <= distance)
                  & (F.col("a.cell").bitwiseAND(F.lit(0xFFFFFFFF)) == between)
                  & ((half == 0) | (F.bit_count(manhattan.bitwiseAND(F.lit(0xFFFFFFFF))) > 2))).select(
        F.col("a.group").alias("a"), F.col("b.group").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """One row per row of ``docs``: id, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable by links."""
    rows = materialize(fingerprints(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`").alias("text")), "text", words).drop("text"), "fingerprints")
    points = materialize(rows.groupBy("fingerprint").agg(F.min(F.col(f"`{id_col}`")).alias("node")), "points")
    known = points.where("node IS NOT NULL")
    if distance >= 2:
        near = components(_joined_cells(known))
        grouped = known.join(apart(near), "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")
    else:
        grouped = known.withColumn("group", F.col("node"))
    grouped = materialize(grouped, "groups")
    linked = components(_range_join(grouped, distance))
    named = grouped.join(apart(linked), grouped.group == linked.node, "left").select("fingerprint", F.coalesce("component", "group").alias("component_id"))
    return rows.join(apart(named, points), "fingerprint", "left").select(
        F.col(f"`{id_col}`"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
