"""Per-code text classifiers: multinomial Naive Bayes for all codes in one job, and the jobs around it.

One model per group (a code, or a code and a label level) would be a driver loop of small fits; here every group is
trained by the same aggregates and scored by the same join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoline import constants as K
from cargoline.functions import labels, text
from cargoline.operators import nearest
from cargoline.operators.joins import number_sorted
from cargoline.session import apart, looked_up, materialize


@dataclass(frozen=True)
class BayesModel:
    """Trained tables. ``grams``: group, gram, label, c. ``classes``: group, label, n_label, n_group, n_tokens, vocab."""

    group: tuple[str, ...]
    grams: DataFrame
    classes: DataFrame


def train(rows: DataFrame, group: Sequence[str] = ("hs_code",), label: str = "label", n_max: int = 3) -> BayesModel:
    """Count word n-grams per group and label. Counts fold inside map tasks, so a hot code costs no large shuffle."""
    group = list(group)
    exploded = rows.select(*group, F.col(label).alias("label"),
                           F.explode(text.ngrams(text.words(F.col("clean_text")), 1, n_max)).alias("gram"))
    grams = materialize(exploded.groupBy(*group, "gram", "label").agg(F.count("*").alias("c")), "bayes-grams")
    vocab = grams.groupBy(*group, "gram").agg(F.lit(1).alias("one")).groupBy(*group).agg(F.count("*").alias("vocab"))
    tokens = grams.groupBy(*group, "label").agg(F.sum("c").alias("n_tokens"))
    per_label = rows.groupBy(*group, F.col(label).alias("label")).agg(F.count("*").alias("n_label"))
    per_group = per_label.groupBy(*group).agg(F.sum("n_label").alias("n_group"))
    classes = (per_label.join(per_group, group).join(tokens, [*group, "label"], "left").join(vocab, group, "left")
               .select(*group, "label", "n_label", "n_group", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
                       F.coalesce("vocab", F.lit(0)).alias("vocab")))
    return BayesModel(tuple(group), grams, materialize(classes, "bayes-classes"))


def predict(model: BayesModel, rows: DataFrame, n_max: int = 3, temperature: float = 1.0) -> DataFrame:
    """Best label per row with its softmax probability; rows of unknown groups are left out.

    With Laplace smoothing a label's score is log prior + sum of tf x log(count + 1) - known grams x log(tokens + vocab),
    so only counts of grams a label has seen travel, one row with all labels for each gram. The number of known grams rides along as a label without a name.
    ``rows`` should hold distinct texts: see ``match.once_per_text``.
    """
    group = list(model.group)
    # grouped by what it is joined on, so a known gram is shuffled once
    weights = model.grams.groupBy(*group, "gram").agg(F.collect_list(F.struct("label", F.log(F.col("c") + 1).alias("w"))).alias("weights"))
    weights = looked_up(weights, model.grams)
    grams = rows.select("row_id", *group,
                        F.explode(text.ngrams(text.words(F.col("clean_text")), 1, n_max)).alias("gram"))
    known = F.array(F.struct(F.lit(None).cast("string").alias("label"), F.lit(1.0).alias("w")))
    hits = grams.join(weights, [*group, "gram"]).select("row_id", F.inline(F.concat("weights", known)))
    sums = hits.groupBy("row_id", "label").agg(F.sum("w").alias("w"))
    # labels of one code are a vocabulary, not data: their list per row and per group stays small
    per_row = sums.groupBy("row_id").agg(
        F.max(F.when(F.col("label").isNull(), F.col("w"))).alias("known"),
        F.map_from_entries(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "w")))).alias("seen"))
    class_list = apart(model.classes).groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(
        "label", F.log(F.col("n_label") / F.col("n_group")).alias("prior"),
        F.log(F.greatest(F.col("n_tokens") + F.col("vocab"), F.lit(1))).alias("norm")))).alias("classes"))
    scored = rows.select("row_id", *group).join(per_row, "row_id", "left").join(class_list, group).select(
        "row_id", *group, F.transform("classes", lambda k: F.struct(
            (F.round((k.prior + F.coalesce(F.try_element_at("seen", k.label), F.lit(0.0))
                      - F.coalesce("known", F.lit(0.0)) * k.norm) / temperature, 9)).alias("score"),
            k.label.alias("label"))).alias("scores"))
    # highest score, first label in sort order on ties
    best = F.aggregate("scores", F.get("scores", F.lit(0)),
                       lambda b, s: F.when(s.score > b.score, s).otherwise(b))
    out = scored.select("row_id", *group, F.size("scores").alias("n_labels"), best.alias("best"), "scores")
    total = F.aggregate("scores", F.lit(0.0), lambda acc, s: acc + F.exp(s.score - F.col("best.score")))
    return out.select("row_id", *group, F.col("best.label").alias("label"), (1 / total).alias("confidence"), "n_labels")


def gate(predictions: DataFrame, threshold: float = K.MODEL_THRESHOLD) -> DataFrame:
    """Status of a prediction: own status for codes with one label, accepted from the threshold on, else review."""
    accepted = F.col("confidence") >= threshold
    status = (F.when(F.col("n_labels") == 1, F.lit(K.STATUS_SINGLE)).when(accepted, F.lit(K.STATUS_MODEL))
              .otherwise(F.lit(K.STATUS_REVIEW)))
    percent = F.format_string("AI %.1f%%", F.col("confidence") * 100)
    return predictions.withColumn("status", F.coalesce(status, F.lit(K.STATUS_REVIEW))).withColumn(
        "status_text", F.when(F.col("status") == K.STATUS_MODEL, percent).otherwise(F.col("status")))


def single_labels(rows: DataFrame, group: str = "hs_code", label: str = "label") -> DataFrame:
    """The one label of every group that has exactly one."""
    return rows.groupBy(group).agg(F.min(label).alias("label"), F.max(label).alias("_high"),
                                   F.count("*").alias("n_rows")).where("label = _high").drop("_high")


def by_level(rows: DataFrame, levels: Sequence[str] = K.LABEL_COLUMNS) -> DataFrame:
    """Each row once per label level, as ``level`` and ``label``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(lv).alias("level"), F.col(lv).alias("label")) for lv in levels]))
    return rows.select("hs_code", "clean_text", pairs.alias("p")).select("hs_code", "clean_text", "p.level", "p.label")


def predict_levels(model: BayesModel, rows: DataFrame, levels: Sequence[str] = K.LABEL_COLUMNS) -> DataFrame:
    """Every label level by its own classifier, and the product of their probabilities. ``model`` has level in its group."""
    row_level = F.concat_ws("/", F.col("row_id").cast("string"), "level")
    tasks = rows.select("row_id", "hs_code", "clean_text", F.explode(F.array(*[F.lit(lv) for lv in levels])).alias("level"))
    tasks = tasks.withColumn("task_id", row_level)
    found = predict(model, tasks.select(F.col("task_id").alias("row_id"), "hs_code", "level", "clean_text"))
    found = found.select(F.split("row_id", "/")[0].cast(rows.schema["row_id"].dataType).alias("row_id"), "level",
                         "label", "confidence")
    return found.groupBy("row_id").agg(
        *[F.max(F.when(F.col("level") == lv, F.col("label"))).alias(lv) for lv in levels],
        F.exp(F.sum(F.log("confidence"))).alias("joint_confidence"))


def encode_labels(rows: DataFrame, label: str = "label") -> DataFrame:
    """Number of each distinct label in sorted order, from 0."""
    return number_sorted(rows.select(F.col(label).alias("label")).distinct(), "label", "code")


def stable_percent(key: Column, seed: int) -> Column:
    """0..99 from a hash of the key: the same under any partitioning and in any engine with md5."""
    digest = F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(100))


def split_rows(rows: DataFrame, key: str, train_percent: int = 80, validation_percent: int = 10, seed: int = 42) -> DataFrame:
    """Train, validation and test part by hash of the key."""
    p = stable_percent(F.col(key), seed)
    part = (F.when(p < train_percent, F.lit("train")).when(p < train_percent + validation_percent, F.lit("validation"))
            .otherwise(F.lit("test")))
    return rows.withColumn("part", part)


def supported_labels(rows: DataFrame, label: str = "label", min_rows: int = K.RARE_LABEL_ROWS) -> DataFrame:
    """Rows whose label has at least ``min_rows`` rows. The rare labels are the small side, so they are the ones joined."""
    rare = rows.groupBy(label).agg(F.count("*").alias("_n")).where(F.col("_n") < min_rows).select(label)
    return rows.join(rare, label, "left_anti")


def synthetic_rows(dictionary: DataFrame, mapping: DataFrame | None = None, min_words: int = 2) -> DataFrame:
    """Training rows from dictionary keywords of at least two words, weighted by log(1 + products of the entry).

    ``mapping`` is the HS-to-label mapping; where its top product line is confident enough it replaces the entry's.
    """
    from cargoline.operators.knowledge import confident_line

    entries = dictionary
    if mapping is not None:
        lines = mapping.where((F.col("grain") == "code") & (F.col("level") == "product_line")).select(
            F.col("key").alias("hs_code"), F.col("top").alias("_top"), F.col("confidence").alias("_share"))
        entries = entries.join(lines, "hs_code", "left").withColumn(
            "product_line", confident_line(F.col("hs_code"), F.col("product_line"), F.col("_top"), F.col("_share")))
    parts = [labels.normalize_part(F.col(c), c).alias(c) for c in K.LABEL_COLUMNS]
    weight = F.log1p(F.coalesce(F.col("n_products").cast("double"), F.lit(1.0)))
    rows = entries.select("entry_id", *parts, weight.alias("weight"), F.explode("keywords").alias("keyword")).where(
        F.size(F.split(F.trim("keyword"), r"\s+")) >= min_words)
    sample = text.squeeze(F.concat(F.lit("Hãng: không_có - Sản phẩm: "), F.col("keyword")))
    return rows.select(sample.alias("text"), *K.LABEL_COLUMNS, labels.combine(*K.LABEL_COLUMNS).alias("label"), "weight",
                       "entry_id")


def above_all(vectors: DataFrame, block: str, min_cosine: float = 0.85) -> DataFrame:
    """Drop near duplicates: a row goes when a row of the same block has a cosine above ``min_cosine`` with it and is more confident
    (lower id on ties). Expects ``vec_id, confidence, embedding`` and ``block``.

    Equal vectors fold into the strongest row first; the rest meet by files of near vectors (see ``nearest.compare_all``). A vector without direction is
    near nothing and stays.
    """
    strength = F.struct(F.col("confidence").alias("confidence"), (-F.col("vec_id")).alias("neg_id"))
    rows = vectors.select(block, nearest.unit(F.col("embedding")).alias("v"), strength.alias("strength"))
    unique = materialize(rows.where("v IS NOT NULL").groupBy(block, "v").agg(F.max("strength").alias("strength")), "strongest")
    pivots = nearest.choose_pivots(unique, "v")
    if not pivots:
        kept = rows.where("v IS NULL").select(block, "strength")
    else:
        # equal strengths have one number: neither is weaker
        numbers = materialize(number_sorted(unique.select("strength").distinct(), "strength", "number"), "numbers")
        placed = nearest.placed(unique.join(apart(numbers), "strength"), "v", pivots, [block, "number"])
        lost = nearest.compare_all(materialize(placed, "placed"), "number", [block], min_cosine, nearest.weaker, "c0 bigint", strict=True).distinct()
        lost = lost.join(apart(numbers), F.col("c0") == F.col("number")).select(block, "strength")
        kept = unique.select(block, "strength").join(lost, [block, "strength"], "left_anti").unionByName(rows.where("v IS NULL").select(block, "strength"))
    return kept.select(block, (-F.col("strength.neg_id")).alias("vec_id"), F.col("strength.confidence").alias("confidence"))
