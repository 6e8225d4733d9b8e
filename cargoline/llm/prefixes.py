"""Prefix trie of conversations by whole sequences: identical conversations collapse into weighted sequences, whose prefixes are then aggregated.

A turn is two 64-bit hashes of its place, role and text; the first d turns are the XOR of theirs, so a prefix is 128 bits whatever its length
and extends by one operation. No conversation is gathered in one place: turns are dealt out by ranges of (conversation, turn), and what a
range adds to a conversation is a row of its own, so that one conversation may hold any share of all turns.

* Rebuilding: every conversation c starts with the first crc32(c) % ``HEADS`` turns of conversation c - c % ``FAMILY``, then has its own after as many.
* Collapse: conversations of equal whole prefix are one sequence, with its number, its smallest id and the digest of its sorted ids.
* Leaves: sequences that are no proper prefix of another one, by an anti-join.
* Prefixes of the sequences, each with its sequence's weight, are summed up to the nodes. A node's saved tokens are all its members' tokens from its depth
  on less each subtree node's tokens once; the latter are counted with the sequence of the smallest member, whose own nodes are one tail of its path.

Everything is linear in the number of turns of distinct sequences. The digest of a sequence's ids is a stream over its sorted ids in one task, since
SHA-256 can't be put together from parts; eight bytes a conversation pass through and none are held.

Defined cases: turns are ordered by turn (null first), then role, then text; a null role or text is empty; repeated rows are turns of their own;
rows without a conversation id belong to no conversation; an empty table gives no node; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cargoline.operators.joins import hottest, join_hot
from cargoline.session import materialize

#: A rebuilt conversation starts with fewer than ``HEADS`` turns of the first conversation of its ``FAMILY``.
HEADS, FAMILY = 4, 20
BLANK = r"[\x20\x09-\x0D]+"
EMPTY_ENDS = hashlib.sha256(b"").hexdigest()


def _heads(conv: Column) -> Column:
    return (F.crc32(conv.cast("string")) % HEADS).cast("bigint")


def _marks(place: Column) -> list[Column]:
    """The two hashes of a turn at a place."""
    return [F.xxhash64(place, "r1").alias("x1"), F.xxhash64(place, "r2").alias("x2")]


def _turns(conversations: DataFrame) -> DataFrame:
    """conv, piece (a range's share of a conversation), place in the conversation from 1, hashes of role and text, words."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv"), F.col("turn"), role.alias("role"), text.alias("text")).where("conv IS NOT NULL")
    order = ["conv", F.asc_nulls_first("turn"), "role", "text"]
    words = F.size(F.array_remove(F.split("text", BLANK), "")).cast("bigint")
    # the number has the partition in its upper bits and the row's place in the lower ones; written, so that it is a fact
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv", F.monotonically_increasing_id().alias("at"), F.xxhash64("role", "text").alias("r1"), F.xxhash64(F.lit(1), "text", "role").alias("r2"), words.alias("w"))
    ranged = materialize(ranged, "turns").withColumn("piece", F.shiftright("at", 33))
    shares = ranged.groupBy("conv", "piece").agg(F.min("at").alias("start"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.join(shares.select("conv", "piece", "start", before.alias("before")), ["conv", "piece"])
    return placed.select("conv", "piece", (F.col("at") - F.col("start") + F.col("before") + 1).alias("place"), "r1", "r2", "w")


def _running(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Adds the XOR of the marks and the sum of the words up to each row of its key."""
    upto = W.partitionBy(*key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumns({"p1": F.bit_xor("x1").over(upto), "p2": F.bit_xor("x2").over(upto), "upto": F.sum("w").over(upto)})


def _rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Starts (conv, depth, …), own turns after them (conv, piece, depth, …), and the conversations (conv, length, prefix, tokens)."""
    lengths = materialize(turns.groupBy("conv").agg(F.count("*").alias("n")), "lengths")
    first = F.col("conv") - F.pmod("conv", F.lit(FAMILY))
    sources = lengths.where(F.pmod("conv", F.lit(FAMILY)) == 0).select(F.col("conv").alias("source"), F.col("n").alias("has"))
    given = F.least(_heads(F.col("conv")), F.coalesce("has", F.lit(0)))
    convs = lengths.withColumn("source", first).join(sources, "source", "left").select("conv", "source", "n", _heads(F.col("conv")).alias("h"), given.alias("given"))
    convs = materialize(convs, "conversations")

    lent = turns.where((F.pmod("conv", F.lit(FAMILY)) == 0) & (F.col("place") < HEADS)).select(F.col("conv").alias("source"), F.col("place").alias("depth"), *_marks(F.col("place")), "w")
    lent = _running(lent, ["source"], "depth")
    starts = convs.join(lent, "source").where("depth <= given").select("conv", "depth", "x1", "x2", "p1", "p2", "w", "upto")

    pieces = turns.groupBy("conv", "piece").agg(F.count("*").alias("_")).join(convs, "conv").select("conv", "piece", "h", "given")
    depth = F.col("place") - F.col("h") + F.col("given")
    own = turns.join(pieces, ["conv", "piece"]).where("place > h").withColumn("depth", depth)
    own = materialize(own.select("conv", "piece", "depth", *_marks(F.col("depth")), "w"), "own-turns")
    return materialize(starts, "starts"), own, convs


def _digests(members: DataFrame) -> DataFrame:
    """SHA-256 of each sequence's sorted ids, comma-joined: (seq, ends_sha256)."""

    def run(batches):
        seq, digest = None, None
        for batch in batches:
            done: list[tuple[int, str]] = []
            for s, conv in zip(batch.column("seq").to_pylist(), batch.column("conv").to_pylist()):
                if digest is None or s != seq:
                    if digest is not None:
                        done.append((seq, digest.hexdigest()))
                    seq, digest = s, hashlib.sha256(str(conv).encode())
                else:
                    digest.update(f",{conv}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], type=pa.int64()), pa.array([d[1] for d in done])], names=["seq", "ends_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([seq], type=pa.int64()), pa.array([digest.hexdigest()])], names=["seq", "ends_sha256"])

    return members.select("seq", "conv").repartition("seq").sortWithinPartitions("seq", "conv").mapInArrow(run, "seq bigint, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``."""
    starts, own, convs = _rebuilt(_turns(conversations))
    node = ["depth", "p1", "p2"]

    # whole prefixes: the start's, then what each piece adds
    opening = starts.groupBy("conv").agg(F.max(F.struct(*node, "upto")).alias("s")).select("conv", F.col("s.p1").alias("s1"), F.col("s.p2").alias("s2"), F.col("s.upto").alias("su"))
    pieces = materialize(own.groupBy("conv", "piece").agg(F.count("*").alias("k"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.sum("w").alias("w")), "pieces")
    whole = pieces.groupBy("conv").agg(F.sum("k").alias("k"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.sum("w").alias("w"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    whole = convs.select("conv", "given").join(opening, "conv", "left").join(whole, "conv", "left").select(
        "conv", (F.col("given") + zero("k")).alias("depth"), zero("s1").bitwiseXOR(zero("x1")).alias("p1"), zero("s2").bitwiseXOR(zero("x2")).alias("p2"),
        (zero("su") + zero("w")).alias("tokens"))
    whole = materialize(whole, "whole")

    # collapse: one weighted sequence for identical conversations, named by its smallest member
    sequences = materialize(whole.groupBy(*node).agg(F.min("conv").alias("seq"), F.count("*").alias("weight"), F.max("tokens").alias("tokens")), "sequences")
    counts = sequences.select(*node, F.col("weight").alias("_w"))
    members = join_hot(whole.select("conv", *node), sequences.select(*node, "seq"), node, hottest(counts, node, "_w"), F.col("conv"), how="inner")
    ends = sequences.select(*node, "seq").join(_digests(members), "seq").select(*node, "ends_sha256")

    # prefixes of the sequences: starts and own turns of their smallest members
    chosen = sequences.select(F.col("seq").alias("conv"), F.col("depth").alias("length"))
    share = W.partitionBy("conv").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    carried = pieces.join(chosen, "conv").join(opening, "conv", "left").select(
        "conv", "piece", zero("s1").bitwiseXOR(zero(F.bit_xor("x1").over(share))).alias("b1"), zero("s2").bitwiseXOR(zero(F.bit_xor("x2").over(share))).alias("b2"),
        (zero("su") + zero(F.sum("w").over(share))).alias("bu"))
    tails = _running(own.join(carried, ["conv", "piece"]), ["conv", "piece"], "depth").withColumns(
        {"p1": F.col("p1").bitwiseXOR(F.col("b1")), "p2": F.col("p2").bitwiseXOR(F.col("b2")), "upto": F.col("upto") + F.col("bu")})
    columns = ["conv", "piece", *node, "x1", "x2", "w", "upto"]
    top = [F.lit(0).cast(t).alias(c) for c, t in (("depth", "bigint"), ("p1", "bigint"), ("p2", "bigint"), ("x1", "bigint"), ("x2", "bigint"), ("w", "bigint"), ("upto", "bigint"))]
    roots = chosen.select("conv", F.lit(-2).cast("bigint").alias("piece"), *top)
    heads = starts.join(chosen.select("conv"), "conv").withColumn("piece", F.lit(-1).cast("bigint"))
    prefixes = materialize(tails.select(*columns).unionByName(heads.select(*columns)).unionByName(roots.select(*columns)), "prefixes")

    # leaves: sequences that are no proper prefix; own tokens: those of the nodes whose smallest member the sequence's is
    nodes = prefixes.groupBy(*node).agg(F.min("conv").alias("conv"), F.max("w").alias("w"))
    nodes = materialize(nodes, "nodes")
    last = sequences.select("seq", F.col("depth").alias("length"))
    proper = prefixes.select("conv", "piece", *node).join(_by_piece(prefixes, last), ["conv", "piece"]).where("depth < length").select(*node).distinct()
    leaves = sequences.join(proper, node, "left_anti").select("seq", F.lit(1).alias("leaf"))
    own_tokens = nodes.groupBy(F.col("conv").alias("seq")).agg(F.sum("w").alias("own"))
    facts = sequences.select("seq", "weight", "tokens").join(leaves, "seq", "left").join(own_tokens, "seq", "left").select(
        "seq", "weight", "tokens", zero("leaf").alias("leaf"), zero("own").alias("own"))
    facts = materialize(facts, "sequence-facts")

    # weighted prefixes: what a member has from the node's depth on
    rest = F.col("tokens") - F.col("upto") + F.col("w")
    rows = prefixes.join(_by_piece(prefixes, facts), ["conv", "piece"])
    summed = rows.groupBy(*node).agg(
        F.min(F.struct("conv", rest.alias("rest"), "own")).alias("first"), F.sum("weight").alias("n_convs"), F.sum("leaf").cast("bigint").alias("n_leaves"),
        F.sum(F.col("weight") * rest).alias("all_tokens"), F.sum("own").alias("own_tokens"), F.max("x1").alias("x1"), F.max("x2").alias("x2"))
    once = F.col("own_tokens") - F.col("first.own") + F.col("first.rest")
    above = [(F.col("depth") - 1).alias("up_depth"), F.col("p1").bitwiseXOR(F.col("x1")).alias("up1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("up2")]
    result = materialize(summed.select(*node, *above, F.col("first.conv").alias("conv_id"), "n_convs", "n_leaves", (F.col("all_tokens") - once).alias("saved_tokens")), "summed")

    up = ["up_depth", "up1", "up2"]
    children = materialize(result.where("depth > 0").groupBy(*up).agg(F.count("*").alias("n_children")), "children")
    parents = result.join(children.toDF(*node, "n_children"), node).select(
        F.col("depth").alias("up_depth"), F.col("p1").alias("up1"), F.col("p2").alias("up2"), F.col("conv_id").alias("parent_conv_id"))
    below = join_hot(result.where("depth > 0"), parents, up, hottest(children, up, "n_children"), F.col("conv_id"), how="inner")
    every = below.unionByName(result.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("bigint")))
    every = every.join(children.toDF(*node, "n_children"), node, "left").join(ends, node, "left")
    return every.select("conv_id", "depth", "parent_conv_id", "n_convs", zero("n_children").alias("n_children"), "n_leaves", "saved_tokens",
                        F.coalesce("ends_sha256", F.lit(EMPTY_ENDS)).alias("ends_sha256"))


def _by_piece(prefixes: DataFrame, facts: DataFrame) -> DataFrame:
    """A sequence's facts once per piece, so that rows of a long conversation are joined piece by piece."""
    return prefixes.groupBy("conv", "piece").agg(F.count("*").alias("_")).drop("_").join(facts.withColumnRenamed("seq", "conv"), "conv")
