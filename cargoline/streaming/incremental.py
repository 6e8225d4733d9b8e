"""Uploads as a stream: every new file of declarations is cleaned and classified once, then appended to the result.

The classification needs no state between files, so each micro-batch runs the batch cascade; the knowledge tables are
plain inputs of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cargoline import constants as K
from cargoline.functions import text
from cargoline.operators import standardize
from cargoline.plans import cascade
from cargoline.plans.refresh import Knowledge


def clean_batch(raw: DataFrame, known: Knowledge, row_id: str = "row_id") -> DataFrame:
    """Raw rows in, cleaned and classified rows out: the fixed columns, trade direction, month and the row id."""
    ready = standardize.standardize(raw, extra=[row_id])
    keyed = ready.withColumns({"row_id": F.col(row_id), "clean_text": text.clean_basic(F.col("product_name"))})
    out = cascade.classify(keyed.drop(*K.LABEL_COLUMNS, "status"), known.ground_truth, known.dictionary, known.model)
    return out.select("row_id", *K.CLEAN_COLUMNS, "month", "trade_direction", "confidence")


def watch(spark: SparkSession, folder: str, schema: str, known: Knowledge, result_path: str,
          checkpoint: str) -> StreamingQuery:
    """Classify the parquet files arriving in ``folder``. The checkpoint makes a restart go on after the last batch; a
    batch that was cut off is written again under its own number, so no row doubles."""

    def append(batch: DataFrame, number: int) -> None:
        clean_batch(batch, known).write.mode("overwrite").parquet(f"{result_path}/batch={number}")

    return (spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(append)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
