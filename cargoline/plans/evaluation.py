"""The evaluation table: true labels next to the predictions of two dictionaries and the classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargoline import constants as K
from cargoline.functions import labels
from cargoline.operators import classifier, match


def predictions(texts: DataFrame, dictionary: DataFrame, dictionary_b: DataFrame,
                model: classifier.BayesModel) -> DataFrame:
    """Every predictor on distinct texts, one row per text."""
    as_text = labels.combine(*[F.col(f"label.{c}") for c in K.LABEL_COLUMNS])
    phrase = match.phrase_hits(texts, dictionary).select("row_id", as_text.alias("phrase_label"))
    overlap = match.overlap_hits(texts, dictionary).select("row_id", as_text.alias("overlap_label"))
    weighted = match.weighted_hits(texts, dictionary_b).select("row_id", F.col("label_text").alias("dict_b_label"))
    bayes = classifier.predict(model, texts).select(
        "row_id", F.col("label").alias("ai_label"), F.round(F.col("confidence") * 100, 4).alias("ai_confidence"))
    out = texts.select("row_id")
    for part in (phrase, overlap, weighted, bayes):
        out = out.join(part, "row_id", "left")
    return out.select("row_id", F.coalesce("phrase_label", "overlap_label").alias("dict_label"), "dict_b_label", "ai_label",
                      "ai_confidence")


def evaluation(rows: DataFrame, dictionary: DataFrame, dictionary_b: DataFrame,
               model: classifier.BayesModel) -> DataFrame:
    """Labelled rows with ``dict_label``, ``dict_b_label``, ``ai_label``, ``ai_confidence`` and ``predicted_label``."""
    found = match.once_per_text(rows, lambda texts: predictions(texts, dictionary, dictionary_b, model),
                                ["hs_code", "clean_text"])
    known = rows.select("row_id", "hs_code", "product_name", *K.LABEL_COLUMNS, "source_file")
    return known.join(found, "row_id").withColumn("predicted_label", F.coalesce("dict_label", "ai_label"))
