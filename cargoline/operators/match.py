"""Dictionary matching as equi-joins.

A keyword occurs in single-spaced text exactly when some word n-gram of the text equals it, so every matcher explodes
n-grams and joins on equality: no pattern scan per keyword, no cross join. N-grams are made distinct inside the row
where positions do not matter, and only hits, not n-grams, reach the shuffle that picks a row's best match (when the
keyword table has few enough rows to be broadcast; otherwise AQE splits the hot n-grams). The n-grams themselves are never broadcast.

All matchers take rows with ``row_id, hs_code, clean_text`` and a dictionary with ``entry_id, hs_code, keywords`` and
the four label parts. ``entry_id`` may be of any ordered type; its order is the order of the entries.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargoline import constants as K
from cargoline.functions import labels, text
from cargoline.operators.joins import hottest, join_hot
from cargoline.session import apart, looked_up, materialize, spread


def _label_struct() -> Column:
    return F.struct(*[F.col(c) for c in K.LABEL_COLUMNS]).alias("label")


def longest_keyword(keywords: DataFrame, column: str = "keyword") -> Column:
    """Words of the longest keyword, as a scalar subquery."""
    return keywords.agg(F.max(F.size(F.split(column, " "))).alias("n")).scalar()


def match_history(rows: DataFrame, ground_truth: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Left join of rows with the labelled history on (code, text); ``history_label`` is null without a match.

    The history has one row per key, so only the rows can be skewed. With ``hot`` (the most frequent keys, where the
    caller has counts at hand) their rows are salted; without it AQE splits the oversized partitions of the left side.
    """
    keys = ["hs_code", "clean_text"]
    known = ground_truth.where("clean_text <> ''").select(*keys, F.struct(*K.LABEL_COLUMNS).alias("history_label"))
    if hot is None:
        return rows.join(known, keys, "left")
    return join_hot(rows, known, keys, hot, F.col("row_id"))


def phrase_table(dictionary: DataFrame) -> DataFrame:
    """One row per (code, keyword): the first entry that has it. Keywords under three characters never match."""
    exploded = dictionary.select("entry_id", "hs_code", _label_struct(),
                                 F.posexplode("keywords").alias("kw_pos", "keyword"))
    exploded = exploded.withColumn("keyword", text.strip(F.col("keyword"))).where(F.length("keyword") >= 3)
    return exploded.groupBy("hs_code", "keyword").agg(F.min(F.struct("entry_id", "kw_pos", "label")).alias("first"))


def numbered_texts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct ``keys`` with their count ``n`` and a number of their own as ``row_id``, written once so that numbers are facts.

    The caller's row ids are no ids of texts: two files may both count from 1.
    """
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return materialize(counted.withColumn("row_id", F.monotonically_increasing_id()), "texts")


def once_per_text(rows: DataFrame, matcher: Callable[[DataFrame], DataFrame], keys: Sequence[str]) -> DataFrame:
    """Run ``matcher`` once per distinct ``keys`` instead of once per row and hand the result to every row.

    Declarations repeat their texts a lot, so this removes most of the n-gram work, and a text that fills a third of the
    table is one text here. The rows of the most frequent texts are salted on the way back.
    """
    keys = list(keys)
    keyed = rows.select("row_id", *[F.coalesce(k, F.lit("")).alias(k) for k in keys])
    texts = numbered_texts(keyed, keys)
    found = matcher(spread(texts.drop("n"))).join(apart(texts.drop("n")), "row_id").drop("row_id")
    return join_hot(keyed, found, keys, hottest(texts, keys, "n"), F.col("row_id"), "inner").drop(*keys)


def match_phrase(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The longest keyword of the same code that occurs in the text; the first entry on ties."""
    return once_per_text(rows, lambda texts: phrase_hits(texts, dictionary), ["hs_code", "clean_text"])


def phrase_hits(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``match_phrase`` for rows whose texts are distinct already."""
    table = materialize(phrase_table(dictionary), "phrases")
    n_max = longest_keyword(table)
    grams = rows.withColumn("_n_max", n_max).select("row_id", "hs_code", F.explode(F.array_distinct(F.transform(
        text.positioned_ngrams(text.words(F.col("clean_text")), F.col("_n_max")), lambda g: g.gram))).alias("keyword"))
    hits = grams.join(looked_up(table), ["hs_code", "keyword"])
    best = hits.groupBy("row_id").agg(F.min(F.struct(
        (-F.length("keyword")).alias("neg_length"), F.col("first.entry_id").alias("entry_id"),
        F.col("first.kw_pos").alias("kw_pos"), F.col("keyword"), F.col("first.label").alias("label"))).alias("best"))
    return best.select("row_id", "best.entry_id", "best.keyword", "best.label")


def match_overlap(rows: DataFrame, dictionary: DataFrame, threshold: float = K.OVERLAP_THRESHOLD,
                  stopwords: Sequence[str] = K.OVERLAP_STOPWORDS) -> DataFrame:
    """Best entry of the same code by shared words: share of the smaller word set times the length of the shared words."""
    return once_per_text(rows, lambda texts: overlap_hits(texts, dictionary, threshold, stopwords),
                         ["hs_code", "clean_text"])


def overlap_hits(rows: DataFrame, dictionary: DataFrame, threshold: float = K.OVERLAP_THRESHOLD,
                 stopwords: Sequence[str] = K.OVERLAP_STOPWORDS) -> DataFrame:
    """``match_overlap`` for rows whose texts are distinct already."""
    entry_words = dictionary.select("entry_id", "hs_code", F.expr(
        "flatten(transform(keywords, k -> split(trim(k), ' +')))").alias("all_words"))
    entries = entry_words.select("entry_id", "hs_code", F.array_sort(F.array_distinct(
        text.without("all_words", stopwords))).alias("words"))
    # entries of one code with the same words score alike and the first one wins, so one of them is enough
    entries = (entries.groupBy("hs_code", "words").agg(F.min("entry_id").alias("entry_id"))
               .selectExpr("hs_code", "entry_id", "size(words) AS n_entry", "explode(words) AS word"))
    entries = materialize(entries, "entry-words")
    words_ = rows.select("row_id", "hs_code", F.array_distinct(
        text.without("split(clean_text, ' ')", stopwords)).alias("words"))
    words_ = words_.selectExpr("row_id", "hs_code", "size(words) AS n_text", "explode(words) AS word")
    shared = (words_.join(looked_up(entries), ["hs_code", "word"]).groupBy("row_id", "entry_id", "n_text", "n_entry")
              .agg(F.count("*").alias("n_shared"), F.sum(F.length("word")).alias("shared_length")))
    score = F.col("n_shared") / F.least("n_text", "n_entry") * F.col("shared_length")
    best = shared.withColumn("score", score).groupBy("row_id").agg(
        F.min(F.struct((-F.col("score")).alias("neg_score"), "entry_id")).alias("best"))
    picked = best.select("row_id", "best.entry_id", (-F.col("best.neg_score")).alias("score"))
    return picked.where(F.col("score") >= threshold).join(
        dictionary.select("entry_id", _label_struct()), "entry_id").select("row_id", "entry_id", "score", "label")


# --- weighted matching ----------------------------------------------------------------------------------------------

def keyword_weight(keyword: Column, high_value: Sequence[str], high_weight: int, junk: Sequence[str],
                   word_weight) -> Column:
    n_words = F.size(F.split(keyword, " "))
    return (F.when(text.any_term(keyword, high_value), F.lit(high_weight)).when(keyword.isin(list(junk)), F.lit(0))
            .otherwise(word_weight(n_words)).cast("double"))


def _clean_keywords(dictionary: DataFrame, *columns: str) -> DataFrame:
    """Cleaned, non-empty keywords, one row each, with their place in the entry."""
    out = dictionary.select(*columns, F.posexplode("keywords").alias("kw_pos", "keyword"))
    return out.withColumn("keyword", text.squeeze(F.col("keyword"))).where("keyword <> ''")


def _hits(rows: DataFrame, table: DataFrame, row_columns: Sequence[str]) -> DataFrame:
    table = materialize(table, "keywords")
    grams = rows.withColumn("_n_max", longest_keyword(table)).select(*row_columns, F.inline(text.positioned_ngrams(
        text.words(F.col("clean_text")), F.col("_n_max"))).alias("start", "stop", "keyword"))
    return grams.join(looked_up(table), "keyword")


def consume(hits: Column) -> Column:
    """Keep hits in array order, skipping any whose word span overlaps one kept before."""
    def keep(kept: Column, hit: Column) -> Column:
        clash = F.exists(kept, lambda k: (k.start <= hit.stop) & (hit.start <= k.stop))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(hit)))

    return F.aggregate(hits, F.slice(hits, 1, 0), keep)


def _pick(scored: DataFrame, order: str) -> DataFrame:
    """Highest positive score per row, first by ``order``; when that one is a component, the first complete product
    with the same score wins. Expects row_id, entry_id, score, kind and ``order``."""
    payload = F.struct(F.col(order).alias("place"), "entry_id", "kind")
    per_score = scored.where("score > 0").groupBy("row_id", "score").agg(
        F.min(payload).alias("first"),
        F.min(F.when(F.upper(F.trim("kind")) == "NC", payload)).alias("first_nc"))
    top = per_score.groupBy("row_id").agg(F.max(F.struct("score", "first", "first_nc")).alias("t"))
    is_component = F.upper(F.trim(F.col("t.first.kind"))) == "LK"
    chosen = F.when(is_component & F.col("t.first_nc").isNotNull(), F.col("t.first_nc")).otherwise(F.col("t.first"))
    return top.select("row_id", F.col("t.score").alias("score"), chosen.alias("c")).select(
        "row_id", "c.entry_id", "score")


def _decide(picked: DataFrame, rows: DataFrame, entries: DataFrame, threshold: float) -> DataFrame:
    """One row per input row: label text and full confidence from the threshold on, review below it."""
    accepted = F.coalesce(F.col("score") >= threshold, F.lit(False))
    named = picked.join(entries.select("entry_id", "label_text"), "entry_id")
    out = rows.select("row_id").join(named, "row_id", "left")
    return out.select("row_id", F.when(accepted, F.col("label_text")).alias("label_text"),
                      F.coalesce("score", F.lit(0.0)).alias("score"),
                      F.when(accepted, F.lit(100.0)).otherwise(F.lit(0.0)).alias("confidence"),
                      F.when(accepted, F.lit(K.STATUS_DICTIONARY)).otherwise(F.lit(K.STATUS_REVIEW)).alias("status"))


def match_weighted(rows: DataFrame, dictionary: DataFrame, threshold: float = K.WEIGHTED_THRESHOLD,
                   use_hs: bool = True, high_value: Sequence[str] = K.HIGH_VALUE_TERMS,
                   junk: Sequence[str] = K.JUNK_TERMS) -> DataFrame:
    """Weighted phrase matching over all entries: longest hits first, no overlaps, weights summed per entry.

    A keyword weighs its words squared, 25 with a high-value term, nothing as a junk term; a tenth of that when the
    first four digits of the codes of row and entry differ. One output row per input row.
    """
    keys = ["hs_code", "clean_text"] if use_hs else ["clean_text"]
    return once_per_text(rows, lambda texts: weighted_hits(texts, dictionary, threshold, use_hs, high_value, junk), keys)


def weighted_hits(rows: DataFrame, dictionary: DataFrame, threshold: float = K.WEIGHTED_THRESHOLD,
                  use_hs: bool = True, high_value: Sequence[str] = K.HIGH_VALUE_TERMS,
                  junk: Sequence[str] = K.JUNK_TERMS) -> DataFrame:
    """``match_weighted`` for rows whose texts are distinct already."""
    parts = [labels.or_no_label(F.col(c)) for c in [*K.LABEL_COLUMNS, "hs_code"]]
    entries = dictionary.select("entry_id", "keywords", labels.or_no_label(F.col("kind")).alias("kind"),
                                labels.or_no_label(F.col("hs_code")).alias("entry_hs"),
                                labels.combine(*parts).alias("label_text"))
    keywords = _clean_keywords(entries, "entry_id", "kind", "entry_hs")
    # the same keyword in several entries belongs to the last of them
    owner = keywords.groupBy("keyword").agg(
        F.max(F.struct("entry_id", "kind", "entry_hs")).alias("o")).select(
        "keyword", "o.*", keyword_weight(F.col("keyword"), high_value, 25, junk, lambda n: n * n).alias("weight"))
    hits = _hits(rows, owner, ["row_id", "hs_code"] if use_hs else ["row_id"])
    if use_hs:
        code = F.trim(F.coalesce("hs_code", F.lit("")))
        plain = F.split(F.when(~code.isin([*K.NULL_WORDS, K.NO_LABEL]), code), r"\.")[0]
        row_heading = F.when(F.length(plain) >= 4, F.substring(plain, 1, 4))
        entry_heading = F.when((F.col("entry_hs") != K.NO_LABEL) & (F.length("entry_hs") >= 4),
                               F.substring("entry_hs", 1, 4))
        hits = hits.withColumn("weight", F.when(row_heading != entry_heading, F.col("weight") / 10.0)
                               .otherwise(F.col("weight")))
    # hits of different islands of overlapping spans can't clash, so each island is settled by itself: long texts take near-linear time
    along = Window.partitionBy("row_id").orderBy("start", "stop")
    reach = F.max("stop").over(along.rowsBetween(Window.unboundedPreceding, -1))
    islands = hits.withColumn("_first", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int")).withColumn("island", F.sum("_first").over(along))
    spans = islands.groupBy("row_id", "island").agg(F.array_sort(F.collect_list(F.struct(
        (-F.length("keyword")).alias("neg_length"), "start", "stop", "entry_id", "kind", "weight"))).alias("hits"))
    kept = spans.select("row_id", F.explode(consume(F.col("hits"))).alias("hit"))
    scored = kept.groupBy("row_id", F.col("hit.entry_id").alias("entry_id")).agg(
        F.round(F.sum("hit.weight"), 6).alias("score"), F.min(F.struct("hit.neg_length", "hit.start", "hit.stop")).alias("position"),
        F.first("hit.kind").alias("kind"))
    return _decide(_pick(scored, "position"), rows, entries, threshold)


def match_masked(rows: DataFrame, dictionary: DataFrame, threshold: float = K.MASKED_THRESHOLD,
                 high_value: Sequence[str] = K.MASKED_HIGH_VALUE_TERMS,
                 junk: Sequence[str] = K.MASKED_JUNK_TERMS) -> DataFrame:
    """Per-entry matching with masking: inside an entry the longest keywords go first and blank what they match.

    A keyword scores once: 20 with a high-value term, nothing as a junk term, else its number of words. Rows that stay
    below the threshold have score 0.
    """
    return once_per_text(rows, lambda texts: masked_hits(texts, dictionary, threshold, high_value, junk), ["clean_text"])


def masked_hits(rows: DataFrame, dictionary: DataFrame, threshold: float = K.MASKED_THRESHOLD,
                high_value: Sequence[str] = K.MASKED_HIGH_VALUE_TERMS,
                junk: Sequence[str] = K.MASKED_JUNK_TERMS) -> DataFrame:
    """``match_masked`` for rows whose texts are distinct already."""
    parts = [labels.or_no_label(F.col(c)) for c in K.LABEL_COLUMNS]
    entries = dictionary.select("entry_id", "keywords", labels.or_no_label(F.col("kind")).alias("kind"),
                                labels.combine(*parts).alias("label_text"))
    table = _clean_keywords(entries, "entry_id", "kind")
    table = table.groupBy("entry_id", "kind", "keyword").agg(F.min("kw_pos").alias("kw_pos"))
    table = table.withColumn("weight", keyword_weight(F.col("keyword"), high_value, 20, junk, lambda n: n))
    # spans that count do not overlap, so without a high-value term no score exceeds the number of words of the text:
    # most short descriptions are settled here, before any n-gram
    open_rows = rows.where((F.size(text.words(F.col("clean_text"))) >= threshold)
                           | text.any_term(F.col("clean_text"), high_value))
    hits = _hits(open_rows, table, ["row_id"])
    # the sum over all hits bounds the score from above: only entries that can reach the threshold have their hits put in
    # order; sum and hits come from one pass, and a text's hits of one entry are bounded by the text
    together = hits.groupBy("row_id", "entry_id", "kind").agg(F.sum("weight").alias("bound"), F.collect_list(F.struct(
        (-F.length("keyword")).alias("neg_length"), "kw_pos", "start", "stop", "weight")).alias("hits"))
    spans = together.where(F.col("bound") >= threshold).select("row_id", "entry_id", "kind", F.array_sort("hits").alias("hits"))
    scoring = F.array_distinct(F.transform(consume(F.col("hits")), lambda h: F.struct(h.kw_pos, h.weight)))
    total = F.aggregate(scoring, F.lit(0.0), lambda acc, s: acc + s.weight)
    scored = spans.select("row_id", "entry_id", "kind", total.alias("score")).where(F.col("score") >= threshold)
    return _decide(_pick(scored, "entry_id"), rows, entries, threshold)
