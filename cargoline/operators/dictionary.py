"""Keyword statistics and dictionary builders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargoline import constants as K
from cargoline.functions import codes, labels, text
from cargoline.session import materialize


def gram_frequencies(rows: DataFrame, by: Sequence[str], tokens_col: str | None = None, n_max: int = 3) -> DataFrame:
    """Rows per word n-gram and group; an n-gram counts once per row.

    Grams are made distinct inside the row, so the explode feeds partial aggregation and only counts are shuffled.
    """
    tokens = F.col(tokens_col) if tokens_col else text.words(F.col("clean_text"))
    grams = rows.select(*by, F.explode(F.array_distinct(text.ngrams(tokens, 1, n_max))).alias("gram"))
    return grams.groupBy(*by, "gram").agg(F.count("*").alias("n_rows"))


def _top_keywords(weighted: DataFrame, by: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """The first ``limit`` grams per group as an ordered array. ``row_number <= limit`` is cut per task before the
    shuffle, so a hot group sends no more than ``limit`` rows from each task."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    ranked = weighted.withColumn("rank", rank).where(F.col("rank") <= limit)
    return ranked.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "gram"))),
                                               lambda g: g.gram).alias("keywords"))


def _gram_counts(rows: DataFrame, by: Sequence[str], n_max: int) -> DataFrame:
    """Occurrences of each n-gram per group. Grams are folded to counts inside each map task before any shuffle."""
    grams = rows.select(*by, F.explode(text.ngrams(text.words(F.col("clean_text")), 1, n_max)).alias("gram"))
    return grams.groupBy(*by, "gram").agg(F.count("*").alias("tf"))


def _raw_tfidf(rows: DataFrame, group: str, label: str, max_df: float, n_max: int) -> DataFrame:
    counts = _gram_counts(rows, [group, label], n_max)
    documents = rows.groupBy(group, label).agg(F.count("*").alias("n_texts")).groupBy(group).agg(
        F.count("*").alias("n_docs")).where("n_docs > 1")
    # grams are already counted per label here, so a window partition holds at most one row per label of the group
    df = F.count("*").over(Window.partitionBy(group, "gram"))
    idf = F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1
    return (counts.withColumn("df", df).join(documents, group).where(F.col("df") <= max_df * F.col("n_docs"))
            .select(group, label, "gram", "tf", "df", F.round(F.col("tf") * idf, 9).alias("raw")))


def _norms(raw: DataFrame, group: str, label: str) -> DataFrame:
    return raw.groupBy(group, label).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))


def tfidf_weights(rows: DataFrame, group: str = "hs_code", label: str = "label", max_df: float = 0.9,
                  n_max: int = 3) -> DataFrame:
    """TF-IDF of word n-grams where a document is all text of one label inside one group.

    Smooth idf, grams in more than ``max_df`` of a group's documents dropped, weights scaled to unit length per
    document over the grams that stay. Groups with one label have no weights.
    """
    raw = materialize(_raw_tfidf(rows, group, label, max_df, n_max), "tfidf")
    return raw.join(_norms(raw, group, label), [group, label]).withColumn("weight", F.col("raw") / F.col("norm"))


def tfidf_keywords(rows: DataFrame, group: str = "hs_code", label: str = "label", limit: int = 20,
                   min_weight: float = 0.03, max_df: float = 0.9) -> DataFrame:
    """Top keywords of every label of every multi-label group.

    A label that keeps no gram has an empty list; a group that keeps none has no rows. Inside a label the order of the
    raw weights is the order of the scaled ones, so the top is taken first and only it meets the norms.
    """
    raw = materialize(_raw_tfidf(rows, group, label, max_df, 3), "tfidf")
    rank = F.row_number().over(Window.partitionBy(group, label).orderBy(F.desc("raw"), F.col("gram")))
    best = raw.withColumn("rank", rank).where(F.col("rank") <= limit).join(_norms(raw, group, label), [group, label])
    strong = best.where(F.round(F.col("raw") / F.col("norm"), 9) > min_weight)
    top = strong.groupBy(group, label).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "gram"))),
                                                       lambda g: g.gram).alias("keywords"))
    pairs = rows.groupBy(group, label).agg(F.count("*").alias("n_products"))
    return (pairs.join(raw.select(group).distinct(), group, "left_semi").join(top, [group, label], "left")
            .withColumn("keywords", F.coalesce("keywords", text.no_strings())))


def single_label_keywords(rows: DataFrame, group: str = "hs_code", label: str = "label", limit: int = 15) -> DataFrame:
    """Most frequent words and word pairs of the groups that have one label only. Pairs stay inside a row."""
    pairs = rows.groupBy(group, label).agg(F.count("*").alias("n_products"))
    single = pairs.groupBy(group).agg(F.count("*").alias("n"), F.first(label).alias(label),
                                      F.first("n_products").alias("n_products")).where("n = 1").drop("n")
    counts = _gram_counts(rows.join(single.select(group), group, "left_semi"), [group], 2)
    top = _top_keywords(counts, [group], [F.desc("tf"), F.col("gram")], limit)
    return single.join(top, group, "left").select(group, label, "n_products",
                                                  F.coalesce("keywords", text.no_strings()).alias("keywords"))


def build_dictionary(ground_truth: DataFrame) -> DataFrame:
    """The supervised dictionary: TF-IDF keywords where a code has several labels, frequent words where it has one.

    ``entry_id`` is code and label in one text; its order is the order of the entries.
    """
    rows = ground_truth.withColumn("label", labels.combine(*K.LABEL_COLUMNS))
    both = tfidf_keywords(rows).unionByName(single_label_keywords(rows))
    parts = [F.trim(labels.split_part(F.col("label"), i)).alias(c) for i, c in enumerate(K.LABEL_COLUMNS)]
    entry_id = F.concat_ws(K.LABEL_SEPARATOR, "hs_code", "label")
    return both.select(entry_id.alias("entry_id"), "keywords", *parts, "hs_code", "n_products")


# --- purity-scored keywords -----------------------------------------------------------------------------------------

def keyword_candidates(rows: DataFrame, by: Sequence[str], tokens_col: str = "tokens", min_purity: float = 0.05,
                       scoring: str = "linear") -> DataFrame:
    """Scored n-grams per class: purity is the class's share of the rows that have the gram, over all classes.

    ``scoring='linear'`` gives 50 x purity + 2 x rows x base, ``'quadratic'`` rows x purity^2 x base, where base is the
    number of words, plus five with a bonus term.
    """
    local = gram_frequencies(rows, by, tokens_col).withColumnRenamed("n_rows", "lf")
    # counts per class are final here: a window partition holds one row per class that has the gram
    scored = local.withColumn("gf", F.sum("lf").over(Window.partitionBy("gram")))
    bonus = F.when(text.any_term(F.col("gram"), K.KEYWORD_BONUS_TERMS), F.lit(5)).otherwise(F.lit(0))
    base = F.size(F.split("gram", " ")) + bonus
    purity = F.col("lf") / F.col("gf")
    score = purity * 50 + (F.col("lf") * 2) * base if scoring == "linear" else F.col("lf") * purity * purity * base
    return scored.where(text.is_keyword("gram") & (purity >= min_purity)).withColumn("score", F.round(score, 6))


def top_keywords(candidates: DataFrame, by: Sequence[str], limit: int = 15, window: int = 1000) -> DataFrame:
    """The best ``limit`` candidates per class, passing over any that is part of one chosen before it.

    A class's first ``window`` candidates settle nearly every class in one bounded array. A class that is still short
    and has more candidates is settled by an equi-join of its candidates with the substrings of the better ones.
    """
    order = [F.desc("score"), F.desc("lf"), F.col("gram")]
    by = list(by)
    candidates = materialize(candidates, "candidates")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    head = candidates.withColumn("rank", rank).where(F.col("rank") <= window)
    sizes = candidates.groupBy(*by).agg(F.count("*").alias("n_candidates"))

    def choose(chosen: Column, gram: Column) -> Column:
        skip = (F.size(chosen) >= limit) | F.exists(chosen, lambda c: F.contains(c, gram))
        return F.when(skip, chosen).otherwise(F.concat(chosen, F.array(gram)))

    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "gram"))), lambda g: g.gram)
    greedy = head.groupBy(*by).agg(ordered.alias("grams")).join(sizes, by).select(
        *by, "n_candidates", F.aggregate("grams", text.no_strings(), choose).alias("keywords"))
    greedy = materialize(greedy, "chosen")
    short = (F.size("keywords") < limit) & (F.col("n_candidates") > window)
    settled = greedy.where(~short).select(*by, "keywords")

    open_ = candidates.join(greedy.where(short).select(*by), by, "left_semi")
    starts = F.sequence(F.lit(1), F.length("gram"))
    pieces = open_.select(*by, F.struct((-F.col("score")).alias("a"), (-F.col("lf")).alias("b"),
                                        F.col("gram").alias("c")).alias("place"),
                          F.explode(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(
                              F.sequence(F.lit(1), F.length("gram") - i + 1),
                              lambda n: F.col("gram").substr(i, n)))))).alias("gram"))
    best_holder = pieces.groupBy(*by, "gram").agg(F.min("place").alias("holder"))
    own = F.struct((-F.col("score")).alias("a"), (-F.col("lf")).alias("b"), F.col("gram").alias("c"))
    free = open_.join(best_holder, [*by, "gram"]).where(F.col("holder") >= own)
    return settled.unionByName(_top_keywords(free, by, order, limit))


def maximal_keywords(candidates: DataFrame, by: Sequence[str], limit: int = 15, n_max: int = 3) -> DataFrame:
    """The best ``limit`` candidates per class after longer ones have replaced the shorter ones that they contain as a run of words.

    Whatever their scores, of two candidates of a class only the longer stays if it contains the other: what stays are the maximal
    candidates. Each candidate, of ``n_max`` words at most, names its proper runs of words and an anti-join drops what is named. Ties go to the
    more frequent candidate, then by text.
    """
    by = list(by)
    # read twice; the counts behind it are not made again
    candidates = materialize(candidates.select(*by, "gram", "score", "lf"), "candidates")
    words = F.split("gram", " ")
    inside = F.array_except(text.ngrams(words, 1, n_max), F.array("gram"))
    contained = candidates.where(F.size(words) > 1).select(*by, F.explode(inside).alias("gram"))
    # a class key may be null, which an anti-join by name would not meet
    keys = [*by, "gram"]
    named = contained.groupBy(*keys).agg(F.lit(1).alias("one")).select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    order = [F.desc("score"), F.desc("lf"), F.col("gram")]
    return _top_keywords(candidates.join(named, same, "left_anti"), by, order, limit)


def _heading_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def fill_labels(df: DataFrame, taxonomy: DataFrame | None = None) -> DataFrame:
    """Fill label parts given as '0': line by code override, then heading, then ``SP`` heading; kind from the taxonomy or
    NC; class 1 from the taxonomy or unclassified; class 2 empty.

    ``taxonomy`` (hs_code_prefix, product_line, industry_name, default_type) replaces the built-in heading names.
    """
    heading = F.substring("hs_code", 1, 4)
    line = F.coalesce(F.try_element_at(_heading_map(K.LINE_OVERRIDES), F.col("hs_code")))
    if taxonomy is not None:
        lines = taxonomy.groupBy(F.substring("hs_code_prefix", 1, 4).alias("_heading")).agg(
            F.min_by("product_line", "hs_code_prefix").alias("_line"))
        names = taxonomy.select(F.col("hs_code_prefix").alias("hs_code"), F.col("industry_name").alias("_industry"),
                                F.col("default_type").alias("_type"))
        df = df.withColumn("_heading", heading).join(lines, "_heading", "left").join(names, "hs_code", "left")
        heading_line = F.col("_line")
    else:
        df = df.withColumn("_industry", F.lit(None).cast("string")).withColumn("_type", F.lit(None).cast("string"))
        heading_line = F.try_element_at(_heading_map(K.LINE_BY_HEADING), heading)
    fill = lambda c, value: F.when(F.col(c) != "0", F.col(c)).otherwise(value)
    out = (df.withColumn("product_line", fill("product_line", F.coalesce(line, heading_line,
                                                                        F.concat(F.lit("SP "), heading))))
           .withColumn("kind", fill("kind", F.coalesce("_type", F.lit("NC"))))
           .withColumn("class1", fill("class1", F.coalesce("_industry", F.lit(K.UNCLASSIFIED))))
           .withColumn("class2", fill("class2", F.lit(""))))
    return out.drop("_heading", "_line", "_industry", "_type")


def _zero_labels(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.expr(f"trim(coalesce({c}, '0'))") for c in K.LABEL_COLUMNS})


def mining_rows(rows: DataFrame) -> DataFrame:
    """Rows for keyword mining: digits-only code, deep-cleaned tokens, null label parts as '0'."""
    keyed = _zero_labels(rows).withColumns({"hs_code": codes.hs_digits(F.col("hs_code")),
                                            "_deep": text.clean_deep(F.col("product_name"))})
    return keyed.withColumn("tokens", text.tokens("_deep", K.LABEL_STOPWORDS)).drop("_deep")


def label_words(columns: Sequence[str] = K.LABEL_COLUMNS) -> Column:
    """Cleaned label parts that may serve as keywords, later parts first, without the ones that say nothing."""
    cleaned = [F.when(~F.lower(F.trim(c)).isin("0", K.UNCLASSIFIED.lower(), "nc", ""), text.clean_deep(F.col(c)))
               for c in reversed(columns)]
    return F.array_distinct(F.filter(F.array_compact(F.array(*cleaned)), lambda w: w != ""))


def build_labelled_dictionary(rows: DataFrame, taxonomy: DataFrame | None = None, limit: int = 15) -> DataFrame:
    """Dictionary straight from labelled rows: purity keywords per (code, label), label words in front, gaps filled."""
    by = ["hs_code", *K.LABEL_COLUMNS]
    mined = mining_rows(rows)
    groups = mined.groupBy(*by).agg(F.count("*").alias("n_products"))
    keywords = top_keywords(keyword_candidates(mined, by), by, limit)
    joined = groups.join(keywords, by, "left")
    filled = fill_labels(joined.withColumn("_group", F.concat_ws(K.LABEL_SEPARATOR, *by)), taxonomy)
    mined_words = F.coalesce("keywords", text.no_strings())
    front = F.filter(label_words(), lambda w: ~F.array_contains(mined_words, w))
    return filled.select(F.col("_group").alias("entry_id"), F.concat(front, mined_words).alias("keywords"),
                         *K.LABEL_COLUMNS, "hs_code", "n_products")


# --- draft groups ---------------------------------------------------------------------------------------------------

def _draft_rows(rows: DataFrame) -> DataFrame:
    """Rows that have a token, with digits-only code and null label parts as '0'."""
    deep = _zero_labels(rows).withColumns({"hs_code": codes.hs_digits(F.col("hs_code")), "_deep": text.clean_deep(F.col("product_name"))})
    return deep.where(F.size(text.tokens("_deep", K.TEXT_STOPWORDS)) > 0).drop("_deep")


def draft_groups(rows: DataFrame) -> DataFrame:
    """Groups of equal (code, label) in first-seen order with a dense number, their size and the first description."""
    from cargoline.operators.joins import number_sorted

    by = ["hs_code", *K.LABEL_COLUMNS]
    groups = _draft_rows(rows).groupBy(*by).agg(F.count("*").alias("n_products"),
                                   F.min(F.struct("row_id", "product_name")).alias("first"))
    flat = groups.select(*by, "n_products", F.col("first.row_id").alias("first_row"),
                         F.substring("first.product_name", 1, 120).alias("sample_text"))
    return number_sorted(flat, "first_row", "cluster_id")


def tag_rows(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows that have a token with the number of their draft group, as the groups were made; large groups are spread by salt."""
    from cargoline.operators.joins import hottest, join_hot

    by = ["hs_code", *K.LABEL_COLUMNS]
    return join_hot(_draft_rows(rows), groups.select(*by, "cluster_id"), by, hottest(groups, by, "n_products"), F.col("row_id"),
                    "inner")


def merge_groups(groups: DataFrame, taxonomy: DataFrame | None = None) -> DataFrame:
    """Groups that became equal once labels are filled, as one: sizes added, number and sample of the largest kept."""
    by = ["hs_code", *K.LABEL_COLUMNS]
    best = F.min(F.struct((-F.col("n_products")).alias("size"), "cluster_id", "sample_text"))
    merged = fill_labels(groups, taxonomy).groupBy(*by).agg(F.sum("n_products").alias("n_products"), best.alias("b"))
    return merged.select(*by, "n_products", "b.cluster_id", "b.sample_text")


def heading_list(dictionary: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct 4-digit headings of a dictionary's codes, sorted and comma-joined. At most 10,000 exist."""
    headings = dictionary.select(*by, codes.hs_heading(F.col("hs_code")).alias("heading")).where(
        "heading is not null").distinct()
    return headings.groupBy(*by).agg(F.concat_ws(",", F.array_sort(F.collect_list("heading"))).alias("headings"))


def route(uploads: DataFrame, dictionaries: DataFrame, active: str | None = None) -> DataFrame:
    """The dictionary for each upload: the one that shares most 4-digit headings with it (ties: more entries, then the smaller id), or ``active``
    where none shares any. ``uploads`` has ``upload`` and ``hs_code``, ``dictionaries`` ``dictionary_id``, ``size`` and its comma-joined ``headings``
    (see ``heading_list``).

    Headings fold to one row per upload before they meet, so an upload of any size asks with its few distinct headings.
    """
    asked = uploads.select("upload", codes.hs_heading(F.col("hs_code")).alias("heading")).distinct()
    listed = dictionaries.select("dictionary_id", "size", F.explode(F.split("headings", ",")).alias("heading")).select(
        "dictionary_id", "size", F.trim("heading").alias("heading")).where("heading <> ''").distinct()
    shared = asked.join(listed, "heading").groupBy("upload", "dictionary_id", "size").agg(F.count("*").alias("overlap"))
    best = shared.groupBy("upload").agg(F.min(F.struct((-F.col("overlap")).alias("o"), (-F.col("size")).alias("s"), "dictionary_id")).alias("b"))
    return asked.select("upload").distinct().join(best, "upload", "left").select(
        "upload", F.coalesce("b.dictionary_id", F.lit(active)).alias("dictionary_id"), F.coalesce(-F.col("b.o"), F.lit(0)).alias("overlap"))


def union_by_priority(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Union of labelled texts where an earlier frame wins over a later one with the same ``key``, then lower row order.

    The choice is a min of structs, so equal keys fold together before the shuffle.
    """
    union = None
    for priority, frame in enumerate(frames):
        tagged = frame.withColumn("priority", F.lit(priority))
        union = tagged if union is None else union.unionByName(tagged)
    rest = [c for c in union.columns if c not in (key, "priority")]
    best = union.groupBy(key).agg(F.min(F.struct("priority", *rest)).alias("b"))
    return best.select(key, "b.priority", *[F.col(f"b.{c}").alias(c) for c in rest])
