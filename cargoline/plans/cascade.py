"""The classification cascade: history, dictionary phrase, word overlap, classifier, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoline import constants as K
from cargoline.functions import labels
from cargoline.operators import classifier, match
from cargoline.operators.joins import hottest, join_hot
from cargoline.session import materialize, spread

KEYS = ["hs_code", "clean_text"]


def _outcome(df: DataFrame, label: Column, status: Column, confidence: Column) -> DataFrame:
    return df.select(*KEYS, label.alias("label"), status.alias("status"), confidence.cast("double").alias("confidence"))


def label_struct(combined: Column) -> Column:
    return F.struct(*[F.trim(labels.split_part(combined, i)).alias(c) for i, c in enumerate(K.LABEL_COLUMNS)])


def classify_texts(texts: DataFrame, ground_truth: DataFrame, dictionary: DataFrame,
                   model: classifier.BayesModel | None = None, threshold: float = K.MODEL_THRESHOLD) -> DataFrame:
    """Label, status and confidence of distinct (code, text) pairs, each decided by the first stage that can.

    Every stage is written once and the next one reads only what it left open: later stages cost more and see less.
    """
    known = ground_truth.where("clean_text <> ''").select(*KEYS, F.struct(*K.LABEL_COLUMNS).alias("label"))
    looked_up = materialize(texts.select("row_id", *KEYS).join(known, KEYS, "left"), "after-history")
    outcomes = [_outcome(looked_up.where("label is not null"), F.col("label"), F.lit(K.STATUS_HISTORY), F.lit(1.0))]

    remaining = spread(looked_up.where("label is null").drop("label"))
    for name, hits in (("phrase", match.phrase_hits), ("overlap", match.overlap_hits)):
        found = hits(remaining, dictionary).select("row_id", "label")
        tried = materialize(remaining.join(found, "row_id", "left"), f"after-{name}")
        outcomes.append(_outcome(tried.where("label is not null"), F.col("label"), F.lit(K.STATUS_DICTIONARY), F.lit(1.0)))
        remaining = spread(tried.where("label is null").drop("label"))

    if model is None:
        outcomes.append(_outcome(remaining, F.lit(None), F.lit(K.STATUS_REVIEW), F.lit(0.0)))
    else:
        guesses = classifier.gate(classifier.predict(model, remaining), threshold).select(
            "row_id", F.col("label").alias("guess"), "status", "confidence")
        judged = remaining.join(guesses, "row_id", "left")
        accepted = F.coalesce(F.col("status") != K.STATUS_REVIEW, F.lit(False))
        outcomes.append(_outcome(judged, F.when(accepted, label_struct(F.col("guess"))),
                                 F.coalesce("status", F.lit(K.STATUS_REVIEW)), F.coalesce("confidence", F.lit(0.0))))
    result = outcomes[0]
    for more in outcomes[1:]:
        result = result.union(more)
    return result


def classify(rows: DataFrame, ground_truth: DataFrame, dictionary: DataFrame,
             model: classifier.BayesModel | None = None, threshold: float = K.MODEL_THRESHOLD) -> DataFrame:
    """Classify every row of ``row_id, hs_code, clean_text``: label parts, status, confidence.

    Each distinct (code, text) is classified once. Rows take the result by an equi-join in which the rows of the most
    frequent texts are salted, so a text that fills a third of the table does not end in one task. A null code or text counts as
    an empty one, and row ids may repeat: texts have numbers of their own.
    """
    own = dict(zip(KEYS, ("_code", "_text")))
    keyed = rows.withColumns({k: F.coalesce(c, F.lit("")) for c, k in own.items()})
    texts = match.numbered_texts(keyed.select(*[F.col(k).alias(c) for c, k in own.items()]), KEYS)
    outcome = classify_texts(texts, ground_truth, dictionary, model, threshold).withColumnsRenamed(own)
    joined = join_hot(keyed, outcome, list(own.values()), hottest(texts, KEYS, "n"), F.col("row_id"))
    carried = [c for c in rows.columns if c not in K.LABEL_COLUMNS]
    return joined.select(*carried, *[F.coalesce(F.col(f"label.{c}"), F.lit("")).alias(c) for c in K.LABEL_COLUMNS],
                         "status", "confidence")


def classify_weighted(rows: DataFrame, dictionary: DataFrame, **options) -> DataFrame:
    """The worker form: extract brand and power, build the feature text, match it by weighted phrases."""
    from cargoline.functions import text

    product = F.col("product_name")
    features = rows.select("row_id", "hs_code", text.brand(product).alias("brand"), text.power_rating(product).alias("power"),
                           text.feature_text(text.brand(product), text.power_rating(product),
                                             text.longest_segment(product)).alias("clean_text"))
    matched = match.match_weighted(features.select("row_id", "hs_code", "clean_text"), dictionary, **options)
    return features.select("row_id", "brand", "power", F.col("clean_text").alias("feature")).join(matched, "row_id")
