"""Benchmark decontamination by a positional index of test terms in the training text, in DataFrame operations alone.

A window is ``window`` consecutive words of a test item, or all words of a shorter item. The occurrences of every test term in the training
text are counted; each window is entered in the index by its rarest term, so the postings that are read are those of few, rare terms.
A posting and a place of its term in an item fix an offset between text and item. At that offset the neighbouring terms' postings must
be there too; the run of words that agree around the posting is then measured, and a run as long as the window is a phrase match. The
runs of all postings together cover exactly the words inside occurring windows. ``near`` finds terms within a distance of each other by
the same postings.

The test terms and the index entries are each broadcast while their words are at most ``BROADCAST_WORDS``; a larger benchmark goes through a
shuffle of the postings, with the same result. An entry and a posting carry their surroundings, never a whole item or a list of other postings, so a frequent term or passage is no group.

Null, empty and wordless texts have no words and no hits; items without words have no windows. Rows of equal id and text count as one when
hits are gathered, and every row of the input is in the result. Ties between equally rare terms go to the first in the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cargoline.llm.words import keyed, words
from cargoline.session import materialize

WINDOW = 10
#: Words of all test items, and of all index entries, up to which these are sent to every task: about 200 MB.
BROADCAST_WORDS = 8_000_000


def _items(tests: DataFrame, id_col: str, text: str, window: int) -> DataFrame:
    t = tests.select(F.col(f"`{id_col}`").alias("item_id"), words(F.col(f"`{text}`")).alias("item")).where(F.size("item") > 0).distinct()
    return t.select("item_id", F.monotonically_increasing_id().alias("number"), "item", F.least(F.lit(window), F.size("item")).alias("length"))


def term_counts(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): occurrences of each of ``terms`` among the ``term`` of ``postings``, zero included."""
    counted = postings.join(terms, "term").groupBy("term").agg(F.count("*").alias("n"))
    return terms.join(counted, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def _entries(items: DataFrame, counts: DataFrame) -> DataFrame:
    """Index entries: the rarest place of each window; one place serves all windows it is rarest in.

    An entry holds the words that its windows can hold, at most ``2 * length - 1`` of them, and the place of its term among these: the entries of
    an item grow in proportion to its words.
    """
    places = items.select("item_id", "number", "length", F.size("item").alias("n_words"), F.posexplode("item").alias("at", "term")).join(counts, "term")
    by_place = W.partitionBy("number").orderBy("at")
    # the frame depends on an item's window length, so each length gets its own
    lengths = [r[0] for r in items.select("length").distinct().collect()]  # at most ``window`` of them
    parts = []
    for n in sorted(lengths):
        around = F.collect_list("term").over(by_place.rowsBetween(1 - n, n - 1))
        best = F.min(F.struct("n", "at", "term", "item")).over(by_place.rowsBetween(0, n - 1))
        parts.append(places.where(F.col("length") == n).withColumn("item", around).withColumn("best", best).where(F.col("at") <= F.col("n_words") - n))
    if not parts:
        return places.where("false").select("item_id", F.array("term").alias("item"), "length", F.col("at").alias("item_at"), "term")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    inside = F.least(F.col("best.at"), F.col("length") - 1)
    return every.select("item_id", F.col("best.item").alias("item"), "length", inside.alias("item_at"), F.col("best.term").alias("term")).distinct()


def _run(a: Column, b: Column) -> Column:
    """Number of leading equal words of two lists of the same length."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: x == y), F.lit(False))
    return F.when(first > 0, first.cast("int") - 1).otherwise(F.size(a))


def _around(hits: DataFrame) -> DataFrame:
    """Of each posting the words that a window over it can hold, if a neighbouring word agrees too; ``first`` is the place of the first of them."""
    n, at, place = F.col("length"), F.col("at"), F.col("item_at")
    word, item = F.col("words"), F.col("item")
    first = F.greatest(at - n + 1, F.lit(0))
    beside = (n == 1) | (F.get(word, at - 1) == F.get(item, place - 1)) | (F.get(word, at + 1) == F.get(item, place + 1))
    return hits.where(F.coalesce(beside, F.lit(False))).select(
        "id", "text_hash", "item_id", "item", "item_at", "length", first.alias("first"), (at - first).alias("at"), F.slice(word, first + 1, at - first + n).alias("words"))


def _measure(near_postings: DataFrame) -> DataFrame:
    """Matched stretches of words around each posting."""
    n, at, place = F.col("length"), F.col("at"), F.col("item_at")
    word, item = F.col("words"), F.col("item")
    before = F.least(at, place)
    after = F.least(F.size(word) - at - 1, F.size(item) - place - 1, n - 1)
    left = _run(F.reverse(F.slice(word, at - before + 1, before)), F.reverse(F.slice(item, place - before + 1, before)))
    right = _run(F.slice(word, at + 2, after), F.slice(item, place + 2, after))
    measured = near_postings.select("id", "text_hash", "item_id", "length", (F.col("first") + at).alias("at"), left.alias("left"), right.alias("right"))
    return measured.where("left + right + 1 >= length").select(
        "id", "text_hash", "item_id", (F.col("at") - F.col("left")).alias("start"), (F.col("at") + F.col("right") + 1).alias("stop"))


def phrase_matches(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text",
                   window: int = WINDOW, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(id, text_hash, item_id, start, stop): stretches of a document's words, from 0, inside occurring windows of an item."""
    items = materialize(_items(tests, item_col, item_text, window), "items")
    small = (items.agg(F.sum(F.size("item"))).first()[0] or 0) <= broadcast_words
    hint = F.broadcast if small else (lambda df: df)
    source = keyed(docs, id_col, text)
    terms = items.select(F.explode("item").alias("term")).distinct()
    # the outer form of explode: else Spark cuts every text into words once more to filter the empty ones
    counts = materialize(term_counts(source.select(F.explode_outer("words").alias("term")), hint(terms)), "term-counts")
    entries = materialize(_entries(items, counts), "index-entries")
    if (entries.agg(F.sum(F.size("item"))).first()[0] or 0) <= broadcast_words:
        postings = source.select("id", "text_hash", "words", F.posexplode_outer("words").alias("at", "term"))
        found = _around(postings.join(F.broadcast(entries), "term"))
    else:
        postings = source.select("id", "text_hash", F.posexplode_outer("words").alias("at", "term")).join(entries, "term").withColumnsRenamed({"id": "i", "text_hash": "h"})
        found = _around(postings.join(source, source["id"].eqNullSafe(postings["i"]) & (source["text_hash"] == postings["h"])))
    # written: the steps up to here compile into one loop over a text's words, which the list functions that follow would break up
    return _measure(materialize(found, "near-postings")).distinct()


def near(docs: DataFrame, terms: list[str], distance: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_hash, at): postings of the rarest of ``terms`` that share a window of ``distance`` words with all the others, in any order."""
    wanted = docs.sparkSession.createDataFrame([(t,) for t in dict.fromkeys(terms)], "term string")
    source = keyed(docs, id_col, text)
    counts = {r["term"]: r["n"] for r in term_counts(source.select(F.explode_outer("words").alias("term")), F.broadcast(wanted)).collect()}  # one row per term
    rarest, *others = sorted(counts, key=lambda t: (counts[t], t))
    first = F.greatest(F.col("at") - distance + 1, F.lit(0))
    rows = source.select("id", "text_hash", "words", F.posexplode_outer("words").alias("at", "term")).where(F.col("term") == rarest).select(
        "id", "text_hash", "at", first.alias("first"), F.slice("words", first + 1, F.lit(2 * distance)).alias("around"))
    together = F.exists(F.sequence(F.col("first"), F.col("at")), lambda s: F.size(F.array_except(
        F.array(*[F.lit(t) for t in others]).cast("array<string>"), F.slice("around", s - F.col("first") + 1, F.lit(distance)))) == 0)
    return rows.where(together).select("id", "text_hash", "at").distinct()


def decontaminate(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """One row per row of ``docs``: id, ``text_hash``, ``n_words``, ``n_hit``, ``n_items``, ``items`` (sorted as strings), ``contaminated``."""
    found = materialize(phrase_matches(docs, tests, id_col, text, item_col, item_text, window, broadcast_words), "phrase-matches")
    stretch = F.struct("start", "stop")
    covered = F.aggregate(
        F.sort_array(F.collect_set(stretch)), F.struct(F.lit(0).alias("stop"), F.lit(0).cast("bigint").alias("n")),
        lambda s, x: F.struct(F.greatest(s["stop"], x["stop"]).alias("stop"),
                              (s["n"] + F.greatest(x["stop"] - F.greatest(s["stop"], x["start"]), F.lit(0))).alias("n")), lambda s: s["n"])
    hits = found.groupBy("id", "text_hash").agg(covered.alias("n_hit"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    rows = keyed(docs, id_col, text).select("id", "text_hash", F.size("words").cast("bigint").alias("n_words"))
    joined = rows.join(hits, rows.id.eqNullSafe(hits.id) & (rows.text_hash == hits.text_hash), "left")
    n_hit = F.coalesce(hits.n_hit, F.lit(0).cast("bigint"))
    items = F.coalesce(hits["items"], F.array().cast("array<string>"))
    return joined.select(rows.id.alias(id_col), rows.text_hash, "n_words", n_hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
                         items.alias("items"), (n_hit > 0).alias("contaminated"))
