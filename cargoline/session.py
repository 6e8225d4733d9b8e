"""Session, shared folder and table materialisation."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: SQL settings the jobs are tuned for. All are runtime settings; a cluster's own values win when already set.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app_name: str = "cargoline", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` as the cluster names it, or the context's checkpoint folder.

    Only on one machine (master ``local``) a local folder is made and set where neither is named; a cluster has to name one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors can reach")
        configured = tempfile.mkdtemp(prefix="cargoline-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed by Hadoop when the application ends."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage of multi-use intermediates so that a lost executor re-reads files and does not re-run the stages
    before. Catalyst then knows the size of the files, which is far under that of the rows: see ``apart`` for joins with such a table.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a table that may still be sent whole to the driver and every executor: some tens of MB unpacked.
BROADCAST_ROWS = 100_000


def apart(table: DataFrame, measured: DataFrame | None = None) -> DataFrame:
    """``table`` kept out of broadcasts by its file size once it, or the files it is derived from (``measured``), has many rows.

    Catalyst takes the size of files for the size of rows. Packed columns of repeated values take a fiftieth of their memory and less, so a few
    MB of files can be more than the driver holds. The rows are counted from the footers of the files. The hint reaches the next join only.
    """
    return table if (table if measured is None else measured).count() <= BROADCAST_ROWS else table.hint("merge")


def looked_up(table: DataFrame, measured: DataFrame | None = None) -> DataFrame:
    """``table`` of short rows as the side of the next inner join that is looked up: sent to all executors while it, or the files it is derived from
    (``measured``), has few rows, else sorted like the other side.

    Without it Catalyst may send the asking side: it takes the size of the texts' files for the size of the words and n-grams exploded from them.
    """
    return F.broadcast(table) if (table if measured is None else measured).count() <= BROADCAST_ROWS else table.hint("merge")


def spread(scan: DataFrame) -> DataFrame:
    """Redistribute a plain file scan that yields fewer splits than there are cores; leave any larger scan alone.

    Only for scans: asking for the number of splits must not run anything.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
