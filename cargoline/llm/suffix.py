"""Exact repeated passages: every byte covered by a string of ``length`` bytes that starts at another place too.

The strings are the suffixes of all texts cut at ``length``; they are ordered by most-significant-digit passes that go no deeper, and what is
alone after a pass is dropped. Whole groups of neighbouring suffixes take the first passes together:

1. Each suffix's first digit is taken at an anchor: the substring of ``GRAM`` bytes in it with the smallest hash, the leftmost of equals. It depends on
   the suffix's bytes alone, so equal suffixes have the same anchor at the same offset. Neighbouring suffixes share anchors, and only
   one row per anchor and run of suffixes goes through the shuffle. A row whose digit no other row has is dropped.
2. The second digit of a row is all that its suffixes cover. Rows that agree in it are repeated throughout.
3. Of rows that differ there but share the first digit, one of each kind sends its bytes to the digit's task, where single suffixes are ordered
   by digits of ``DIGIT`` bytes up to ``length``; equal groups at the end are the repeated ones. A digit with more than ``CROWD`` kinds of rows
   is dealt out by the hashes of its single suffixes instead, so no task ever holds a crowd.

Positions are in UTF-8 bytes. Nulls count as empty; texts shorter than ``length`` keep all their bytes. A repeated row is another document, so the text
of both goes where it is long enough. Matches never cross documents. A long text is worked on in slices; a run cut there only
becomes two rows. Digits are 64-bit hashes, and a whole suffix is compared by several of them.
"""

from __future__ import annotations

import contextlib
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cargoline.llm.batches import chunks, ship
from cargoline.llm.rolling import Rolling, mixed, sliding_argmin
from cargoline.session import materialize

LENGTH = 400
GRAM = 128
DIGIT = 96
CROWD = 2048
#: Bytes of a text whose suffixes are looked at together.
SLICE = 1 << 21


def anchor_rows(data: np.ndarray, length: int, gram: int) -> list[np.ndarray]:
    """(key, context, start, count) of runs of suffixes that share an anchor, of the suffixes of one text that are long enough."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    for first in range(0, len(data) - length + 1, SLICE):
        part = data[first : first + SLICE + length - 1]
        rolling = Rolling(part)
        grams = rolling.grams(gram)
        own = sliding_argmin(grams, length - gram + 1)
        cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
        start = np.concatenate([[0], cuts])
        count = np.diff(np.concatenate([start, [len(own)]]))
        anchor = own[start]
        context = rolling.between(start, start + count - 1 + length)
        context = mixed(context ^ (count.astype(np.uint64) << np.uint64(32)) ^ (anchor - start).astype(np.uint64))
        for kept, values in zip(out, (grams[anchor], context, start + first, count)):
            kept.append(values)
    return [np.concatenate(x) if x else np.array([], dtype=np.uint64) for x in out]


def repeated(rolling: Rolling, start: np.ndarray, length: int, digit: int = DIGIT) -> np.ndarray:
    """Indices into ``start`` of the suffixes whose first ``length`` bytes occur more than once among them."""
    alive = np.arange(len(start))
    group = np.zeros(len(start), dtype=np.uint64)
    for depth in range(0, length, digit):
        at = start[alive]
        value = mixed(rolling.between(at + depth, at + min(depth + digit, length)) ^ (group * np.uint64(0x9E3779B97F4A7C15)))
        order = np.argsort(value, kind="stable")
        ranked = value[order]
        same = np.zeros(len(ranked) + 1, dtype=bool)
        same[1:-1] = ranked[1:] == ranked[:-1]
        keep = same[:-1] | same[1:]
        number = np.cumsum(~same[:-1]).astype(np.uint64)
        alive, group = alive[order[keep]], number[keep]
    return alive


def _stretches(place: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, first and end of the byte stretches that runs of neighbouring suffixes cover; sorted by owner, then place."""
    if not len(place):
        return owner, place, place
    head = np.ones(len(place), dtype=bool)
    head[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)
    firsts = np.flatnonzero(head)
    lasts = np.concatenate([firsts[1:], [len(place)]]) - 1
    return owner[firsts], place[firsts], place[lasts] + length


@contextlib.contextmanager
def _filtered_scans(spark):
    """Let Spark filter any scan by a Bloom filter of the other side of a join; the filter has a fixed largest size."""
    names = {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0", "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _source(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, a 64-bit hash of id and text (equal texts of different ids have different ones), and the text."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{id_col}`"), t).alias("mark"), t.alias("text"))


def _beside(source: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of ``table`` with the text of their document, once each.

    The marks go first, as the side that a Bloom filter for the scan of the texts is made of: only texts that have rows are shuffled.
    """
    marks = materialize(table.groupBy(F.col("mark").alias("m")).agg(F.count("*").alias("n")), "marks").where("n > 0").select("m")
    some = source.join(marks, source["mark"] == marks["m"], "left_semi")
    t = table.withColumnsRenamed({"id": "i", "mark": "own"})
    texts = some.dropDuplicates(["id", "mark"])
    same = F.coalesce(texts["id"] == t["i"], texts["id"].isNull() & t["i"].isNull())  # no key of the join: the texts stay where their marks are
    return texts.join(t, (texts["mark"] == t["own"]) & same).drop("i", "own")


def repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """(id, mark, spans): of each document with repeated bytes, their stretches from start to stop, sorted, not yet merged."""
    spark = docs.sparkSession
    ship(spark)
    source = _source(docs, id_col, text)
    kind = source.schema["id"].dataType.simpleString()
    long_enough = source.where(F.octet_length("text") >= length)

    def anchors(batches):
        for batch in chunks(batches, "text"):
            rows = [anchor_rows(np.frombuffer(t.encode(), dtype=np.uint8), length, gram) for t in batch.column("text").to_pylist()]
            of = pa.array(np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows]))
            key, context, start, count = (np.concatenate([r[k] for r in rows]) for k in range(4))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(of), batch.column("mark").take(of), pa.array(key.view(np.int64)), pa.array(context.view(np.int64)),
                                              pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))], names=["id", "mark", "key", "context", "start", "count"])

    runs = materialize(long_enough.mapInArrow(anchors, f"id {kind}, mark bigint, key bigint, context bigint, start int, count int"), "anchor-runs")
    shared = runs.groupBy("key").agg(F.count("*").alias("n"), F.min("context").alias("least"), F.max("context").alias("most")).where("n > 1")
    # written, so that both sides of the join are plain shuffles, whose hot keys Spark splits
    shared = materialize(shared.select("key", (F.col("least") != F.col("most")).alias("several")), "shared-keys")
    rows = materialize(runs.join(shared, "key"), "shared-runs")
    kinds = materialize(rows.groupBy("key", "context").agg(
        F.count("*").alias("n"), F.first("several").alias("several"), F.min(F.struct("id", "mark", "start", "count")).alias("one")), "run-kinds")
    whole = rows.join(kinds.where("n > 1").select("key", "context"), ["key", "context"]).select(
        "id", "mark", "start", (F.col("start") + F.col("count") - 1 + length).alias("stop"))

    open_kinds = kinds.where("several").select("key", "one.*")
    crowds = materialize(open_kinds.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("key"), "crowds")
    parts = [whole]
    in_crowd = materialize(open_kinds.join(crowds, "key", "left_semi"), "crowd-kinds")
    with _filtered_scans(spark):
        parts.append(materialize(_by_digits(source, open_kinds.join(crowds, "key", "left_anti"), kind, length), "by-digits"))
        if not in_crowd.isEmpty():
            parts.append(materialize(_by_hash(source, in_crowd, kind, length), "by-hash"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return materialize(every.groupBy("id", "mark").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans")), "repeats")


def _by_digits(source: DataFrame, open_kinds: DataFrame, kind: str, length: int) -> DataFrame:
    """Repeated stretches among the single suffixes of runs that share a key, ordered in the key's task."""
    listed = open_kinds.groupBy("id", "mark").agg(F.collect_list(F.struct("key", "start", "count")).alias("runs"))

    def cut(batches):
        for batch in chunks(batches, "text"):
            out: dict[str, list] = {n: [] for n in ("id", "mark", "key", "start", "count", "bytes")}
            for row in batch.to_pylist():
                data = row["text"].encode()
                for r in row["runs"]:
                    for name, value in (("id", row["id"]), ("mark", row["mark"]), ("key", r["key"]), ("start", r["start"]), ("count", r["count"]),
                                        ("bytes", data[r["start"] : r["start"] + r["count"] - 1 + length])):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("id", batch.schema.field("id").type), ("mark", pa.int64()), ("key", pa.int64()), ("start", pa.int32()),
                                                                    ("count", pa.int32()), ("bytes", pa.binary())]))

    def order(batches):
        """Whole keys at a time: rows come sorted by key, and a key's rows are kept together."""
        def settle(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(rows)
            count, begin = table.column("count").to_numpy().astype(np.int64), table.column("start").to_numpy().astype(np.int64)
            data = np.frombuffer(b"".join(table.column("bytes").to_pylist()), dtype=np.uint8)
            size = count - 1 + length
            base = np.cumsum(size) - size
            owner = np.repeat(np.arange(len(count)), count)
            inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            found = np.sort(repeated(Rolling(data), base[owner] + inner, length))
            row, first, end = _stretches(inner[found], owner[found], length)
            take = pa.array(row)
            return pa.RecordBatch.from_arrays([table.column("id").combine_chunks().take(take), table.column("mark").combine_chunks().take(take),
                                               pa.array((begin[row] + first).astype(np.int32)), pa.array((begin[row] + end).astype(np.int32))], names=["id", "mark", "start", "stop"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                keys = batch.column("key").to_numpy()
                if held and sum(b.nbytes for b in held) > SLICE:
                    same = int(np.searchsorted(keys, held[-1].column("key")[-1].as_py(), side="right"))
                    if same:
                        held.append(batch.slice(0, same))
                    if same < batch.num_rows:
                        yield settle(held)
                        held = []
                    batch = batch.slice(same)
                    continue
                size = max(1, int(batch.num_rows * SLICE / max(batch.nbytes, 1)))
                held.append(batch.slice(0, size))
                batch = batch.slice(size)
        if held:
            yield settle(held)

    pieces = _beside(source, listed).select("id", "mark", "text", "runs").mapInArrow(cut, f"id {kind}, mark bigint, key bigint, start int, count int, bytes binary")
    return pieces.repartition("key").sortWithinPartitions("key").mapInArrow(order, f"id {kind}, mark bigint, start int, stop int")


def _by_hash(source: DataFrame, open_kinds: DataFrame, kind: str, length: int) -> DataFrame:
    """The same for keys with a crowd of kinds: single suffixes meet by the hash of all their digits, counted before they are shuffled."""
    listed = open_kinds.groupBy("id", "mark").agg(F.collect_list(F.struct("start", "count")).alias("runs"))

    def suffixes(batches):
        for batch in chunks(batches, "text"):
            for row in batch.to_pylist():
                data = np.frombuffer(row["text"].encode(), dtype=np.uint8)
                for r in row["runs"]:
                    grams = Rolling(data[r["start"] : r["start"] + r["count"] - 1 + length]).grams(length)
                    n = len(grams)
                    yield pa.RecordBatch.from_arrays([pa.array([row["id"]] * n, batch.schema.field("id").type), pa.array([row["mark"]] * n, pa.int64()),
                                                      pa.array(np.arange(r["start"], r["start"] + n, dtype=np.int32)), pa.array(grams.view(np.int64))],
                                                     names=["id", "mark", "start", "suffix"])

    single = materialize(_beside(source, listed).select("id", "mark", "text", "runs").mapInArrow(
        suffixes, f"id {kind}, mark bigint, start int, suffix bigint"), "crowd-suffixes")
    twice = materialize(single.groupBy("suffix").agg(F.count("*").alias("n")).where("n > 1").select("suffix"), "crowd-repeats")
    return single.join(twice, "suffix").select("id", "mark", "start", (F.col("start") + length).alias("stop"))


def remove(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept_sha256`` of the bytes that stay."""
    spark = docs.sparkSession
    source = _source(docs, id_col, text)
    kind = source.schema["id"].dataType.simpleString()
    found = repeats(docs, id_col, text, length)

    def cut(batches):
        for batch in chunks(batches, "text"):
            out: dict[str, list] = {n: [] for n in ("n_removed", "n_spans", "kept")}
            for row in batch.select(["text", "spans"]).to_pylist():
                data, runs = row["text"].encode(), []
                for s in row["spans"]:
                    if runs and s["start"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s["stop"])
                    else:
                        runs.append([s["start"], s["stop"]])
                digest, last = hashlib.sha256(), 0
                for a, b in runs:
                    digest.update(data[last:a])
                    last = b
                digest.update(data[last:])
                for name, value in (("n_removed", sum(b - a for a, b in runs)), ("n_spans", len(runs)), ("kept", digest.hexdigest())):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()),
                                              pa.array(out["kept"], pa.string())], names=["i", "m", "n_removed", "n_spans", "kept"])

    with _filtered_scans(spark):
        changed = materialize(_beside(source, found).select("id", "mark", "text", "spans").mapInArrow(
            cut, f"i {kind}, m bigint, n_removed bigint, n_spans bigint, kept string"), "changed")
    rows = source.select("id", "mark", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole"))
    joined = rows.join(changed, rows["id"].eqNullSafe(changed["i"]) & (rows["mark"] == changed["m"]), "left")
    return joined.select(F.col("id").alias(id_col), "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
                         F.coalesce("n_spans", F.lit(0)).cast("bigint").alias("n_spans"), F.coalesce("kept", "whole").alias("kept_sha256"))
