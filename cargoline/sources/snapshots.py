"""Tables in versions: a manifest names the files of each bucket, and a change rewrites only the buckets that it touches.

Rows belong to a bucket by the hash of their key. Version ``n`` is the manifest ``versions/n``; the files that it names are never changed, so any
version can be read as long as it is kept, and a reader sees one version or the next. A manifest is put in place by one rename that fails if
the version is there already: of two writers that start from the same version one wins and the other gets an error, having changed nothing.
A run that is cut off leaves files that no manifest names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


@dataclass(frozen=True)
class Manifest:
    """``files``: bucket number to folder, below the table's own."""

    version: int
    key: str
    buckets: int
    schema: StructType
    files: dict[int, str]


class Conflict(RuntimeError):
    """Another writer has put the same version in place."""


def bucket(key: Column, buckets: int) -> Column:
    """A null key has a bucket like any other."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(buckets)).cast("int")


def _system(spark: SparkSession, base: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
    return jvm, conf, path, path("versions").getFileSystem(conf)


def versions(spark: SparkSession, base: str) -> list[int]:
    """All versions in order."""
    _, _, path, system = _system(spark, base)
    if not system.exists(path("versions")):
        return []
    return sorted(int(f.getPath().getName()) for f in system.listStatus(path("versions")) if f.getPath().getName().isdigit())


def manifest(spark: SparkSession, base: str, version: int | None = None) -> Manifest:
    """A version's manifest; the last one's without a number."""
    if version is None:
        version = max(versions(spark, base))
    content = json.loads("".join(r.value for r in spark.read.text(f"{base}/versions/{version}").collect()))  # one line of bounded length
    return Manifest(version, content["key"], content["buckets"], StructType.fromJson(content["schema"]), {int(b): f for b, f in content["files"].items()})


def _commit(spark: SparkSession, base: str, new: Manifest) -> Manifest:
    jvm, conf, path, system = _system(spark, base)
    system.mkdirs(path("versions"))
    draft, place = path(f"draft-{uuid.uuid4().hex}"), path(f"versions/{new.version}")
    out = system.create(draft, False)
    out.write(bytearray(json.dumps({"key": new.key, "buckets": new.buckets, "schema": new.schema.jsonValue(), "files": new.files}).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), conf)
    try:
        context.rename(context.makeQualified(draft), context.makeQualified(place), spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as error:
        system.delete(draft, False)
        if system.exists(place):
            raise Conflict(f"version {new.version} of {base} is there already") from error
        raise
    return new


def _write(rows: DataFrame, base: str, key: str, buckets: int) -> dict[int, str]:
    """Write ``rows`` by bucket to a new folder; the folders of the buckets that have rows."""
    folder = f"data/{uuid.uuid4().hex}"
    rows.withColumn("_bucket", bucket(F.col(key), buckets)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{base}/{folder}")
    _, _, path, system = _system(rows.sparkSession, base)
    names = [f.getPath().getName() for f in system.listStatus(path(folder))]  # as many as buckets at most
    return {int(n.partition("=")[2]): f"{folder}/{n}" for n in names if n.startswith("_bucket=")}


def create(rows: DataFrame, base: str, key: str, buckets: int = BUCKETS) -> Manifest:
    """Version 0 of a table."""
    return _commit(rows.sparkSession, base, Manifest(0, key, buckets, rows.schema, _write(rows, base, key, buckets)))


def _read(spark: SparkSession, base: str, of: Manifest, only: set[int] | None = None) -> DataFrame:
    paths = [f"{base}/{f}" for b, f in sorted(of.files.items()) if only is None or b in only]
    return spark.read.schema(of.schema).parquet(*paths) if paths else spark.createDataFrame([], of.schema)


def read(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    return _read(spark, base, manifest(spark, base, version))


def merge(spark: SparkSession, base: str, touched: DataFrame, change: Callable[[DataFrame], DataFrame]) -> Manifest:
    """The next version: ``change`` of the rows in the buckets of the keys in ``touched``, all other buckets' files as they are.

    ``change`` may alter, add and drop rows of those keys only; a row of another bucket would be lost or doubled and is an error.
    """
    old = manifest(spark, base)
    hit = {r[0] for r in touched.select(bucket(F.col(old.key), old.buckets)).distinct().collect()}  # as many as buckets at most
    kept = {b: f for b, f in old.files.items() if b not in hit}
    new = _write(change(_read(spark, base, old, hit)).select(*[F.col(f"`{c}`") for c in old.schema.names]), base, old.key, old.buckets)
    if stray := set(new) - hit:
        raise ValueError(f"rows of buckets that no touched key is in: {sorted(stray)}")
    return _commit(spark, base, Manifest(old.version + 1, old.key, old.buckets, old.schema, kept | new))
