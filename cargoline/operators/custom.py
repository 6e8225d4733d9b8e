"""A user's own model in place of the built-in classifiers, behind the same gate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargoline import constants as K
from cargoline.operators import classifier


def classify_with_model(rows: DataFrame, load: Callable[[str], Callable], path: str, key: str = "row_id", threshold: float = K.MODEL_THRESHOLD) -> DataFrame:
    """``label``, ``confidence``, ``n_labels`` and the gate's ``status`` and ``status_text`` for each of ``rows``, with its ``key``, by a model of the user's.

    ``load(path)`` makes the model from a file or folder that all executors can reach. It runs once in each task, and the model must fit into a
    Python worker. The model takes a pandas batch with all columns of ``rows`` and gives three sequences: labels (null: no answer), probabilities
    of the labels, and how many labels it chose from. Rows without an answer, or with a probability that is no number, go to review. ``rows``
    should hold only the columns that the model needs, and distinct texts (see ``match.once_per_text``). Nothing is shuffled.
    """
    kept = rows.schema[key].dataType.simpleString()

    def run(batches):
        import pandas as pd

        model = None
        for batch in batches:
            model = model or load(path)
            labels, confidence, n_labels = model(batch)
            yield pd.DataFrame({key: batch[key], "label": pd.Series(list(labels), dtype=object, index=batch.index),
                                "confidence": pd.Series(list(confidence), dtype=float, index=batch.index), "n_labels": pd.Series(list(n_labels), dtype="int32", index=batch.index)})

    answers = rows.mapInPandas(run, f"`{key}` {kept}, label string, confidence double, n_labels int")
    known = F.col("label").isNotNull() & ~F.isnan("confidence")
    answers = answers.withColumns({"confidence": F.when(known, F.col("confidence")), "n_labels": F.when(known, F.col("n_labels")).otherwise(0)})
    return classifier.gate(answers, threshold)
