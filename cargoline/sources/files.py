"""Delimited files with unknown preamble, header and encoding."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cargoline import constants as K
from cargoline.session import materialize

_EXTRA = "_extra"


def list_files(spark: SparkSession, folder: str, suffix: str = "") -> list[str]:
    """Paths of the data files below ``folder``, sorted."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    found, walk = [], root.getFileSystem(conf).listFiles(root, True)
    while walk.hasNext():
        path = walk.next().getPath()
        if not path.getName().startswith(("_", ".")) and path.getName().endswith(suffix):
            found.append(path.toString())
    return sorted(found)


def heads(spark: SparkSession, paths: Sequence[str], markers: Sequence[str] = K.HEADER_MARKERS, preamble: int = K.PREAMBLE_LINES) -> DataFrame:
    """One row per file: its ``number`` in ``paths``, ``path``, ``columns`` and the ``skipped`` lines, preamble and header.

    The header is the line after the preamble if it names a known column, else the first line. Tasks read the first lines of their files, however
    long the lines and the files are. The files' scheme must be one that Arrow opens (local, ``hdfs``, ``s3``, ``gs``).
    """
    known = list(markers)

    def run(batches):
        import csv
        import io

        import pyarrow as pa
        from pyarrow import fs

        def decoded(line: bytes) -> str:
            try:
                return line.decode("utf-8")
            except UnicodeDecodeError:
                return line.decode("latin1")

        def first_lines(path: str) -> list[str]:
            place, inner = fs.FileSystem.from_uri(path)
            with place.open_input_file(inner) as opened, io.BufferedReader(opened) as reader:
                lines = [reader.readline() for _ in range(preamble + 1)]
            return [decoded(line.rstrip(b"\r\n")).removeprefix("\ufeff") for line in lines if line]

        def fields(line: str) -> list[str]:
            return [c.strip() for c in next(csv.reader([line]), [])]

        for batch in batches:
            columns, skipped = [], []
            for path in batch.column("path").to_pylist():
                lines = first_lines(path)
                at = preamble if len(lines) > preamble and set(fields(lines[preamble])) & set(known) else 0
                columns.append(fields(lines[at]) if lines else [])
                skipped.append(lines[: at + 1])
            yield pa.RecordBatch.from_arrays([batch.column("number"), batch.column("path"), pa.array(columns, pa.list_(pa.string())),
                                              pa.array(skipped, pa.list_(pa.string()))], names=["number", "path", "columns", "skipped"])

    numbered = spark.createDataFrame([(k, _plain_path(p)) for k, p in enumerate(paths)], "number bigint, path string")
    tasks = max(1, min(len(paths), spark.sparkContext.defaultParallelism))
    return numbered.repartition(tasks).mapInArrow(run, "number bigint, path string, columns array<string>, skipped array<string>")


def _decoded(value: Column) -> Column:
    """Text of a line: UTF-8 where it is valid, Latin-1 otherwise; byte-order mark and carriage return dropped."""
    text = F.when(F.is_valid_utf8(value), value).otherwise(F.decode(value.cast("binary"), "ISO-8859-1"))
    return F.regexp_replace(text, "^﻿|\r$", "")


def _file_path() -> Column:
    return F.regexp_replace("_metadata.file_path", "^file:/+", "/")


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return spark.read.text(list(paths)).select(
        _decoded(F.col("value")).alias("line"), F.is_valid_utf8("value").alias("_utf8"), F.col("_metadata.file_name").alias("source_file"),
        _file_path().alias("_path"), F.col("_metadata.file_block_start").alias("_start"))


def _broken_files(spark: SparkSession, paths: Sequence[str]) -> dict[str, bool]:
    """Paths of files in which a quote stays open at the end of a line, and whether they are all UTF-8: one scan for all files."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    per_file = _lines(spark, paths).groupBy("_path").agg(F.max(quotes % 2).alias("open"), F.min("_utf8").alias("utf8"))
    return {r["_path"]: r["utf8"] for r in per_file.where("open = 1").collect()}  # at most one row per file


def _plain_path(path: str) -> str:
    return re.sub("^file:/+", "/", path)


def _parse_lines(spark: SparkSession, columns: Sequence[str], paths: Sequence[str], found: DataFrame) -> DataFrame:
    """Files with one and the same header, line by line."""
    ddl = ", ".join(f"`{c}` STRING" for c in [*columns, _EXTRA])
    lines = _lines(spark, paths)
    # ten lines per file: Catalyst broadcasts them while they fit. Of the lines of a file's first block that equal a line of its head, as many as the
    # head has are dropped, the first ones; later lines of the same text stay
    skipped = found.select("path", F.explode("skipped").alias("head")).groupBy("path", "head").agg(F.count("*").alias("times"))
    same = (F.col("_path") == F.col("path")) & (F.col("line") == F.col("head")) & (F.col("_start") == 0)
    order = Window.partitionBy("_path", "line").orderBy("_place")
    placed = lines.withColumn("_place", F.monotonically_increasing_id())
    again = placed.join(skipped, same).withColumn("_number", F.row_number().over(order)).where("_number > times").select(lines.columns)
    body = lines.join(skipped, same, "left_anti").unionByName(again)
    unquoted = F.regexp_replace("line", '"[^"]*"', "")  # a doubled quote is two quoted stretches
    n_fields = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(","), F.lit(""))) + 1
    parsed = body.where("line <> ''").select("source_file", (n_fields > len(columns)).alias("malformed"), F.from_csv(
        "line", ddl, {"mode": "PERMISSIVE", "quote": '"', "escape": '"'}).alias("r"))
    return parsed.select("source_file", "malformed", "r.*").drop(_EXTRA)


def _parse_whole(spark: SparkSession, columns: Sequence[str], paths: Sequence[str], utf8: bool, found: DataFrame) -> DataFrame:
    """Files with line breaks inside quotes, of one header and encoding: their records after those of the head, of which blank lines are none.

    One read for all of them; a task takes whole files, one after the other, so a record's number in its file is its place less the file's first
    place. The records are written once, so that both come from the same read.
    """
    ddl = ", ".join(f"`{c}` STRING" for c in [*columns, _EXTRA])
    records = spark.read.schema(ddl).csv(list(paths), multiLine=True, quote='"', escape='"', encoding="UTF-8" if utf8 else "ISO-8859-1", nullValue="", emptyValue="")
    placed = materialize(records.select("*", F.col("_metadata.file_name").alias("source_file"), _file_path().alias("_path"),
                                        F.monotonically_increasing_id().alias("_place")), "quoted-records")
    first = placed.groupBy("_path").agg(F.min("_place").alias("_first"))
    n_head = F.size(F.filter("skipped", lambda line: F.trim(line) != ""))
    bounds = first.join(found.select(F.col("path").alias("_path"), n_head.alias("_head")), "_path")
    body = placed.join(bounds, "_path").where(F.col("_place") - F.col("_first") >= F.col("_head"))
    return body.select("source_file", F.col(_EXTRA).isNotNull().alias("malformed"), *[f"`{c}`" for c in columns])


def _scan_heads(spark: SparkSession, found: DataFrame) -> DataFrame:
    """``found`` is the written table of heads. To the driver come the distinct headers with their paths, once."""
    groups = found.where(F.size("columns") > 0).groupBy("columns").agg(F.array_sort(F.collect_list(F.struct("number", "path"))).alias("files")).collect()
    if not groups:
        raise ValueError("no file has a header")
    groups = [(tuple(g["columns"]), [f["path"] for f in g["files"]]) for g in sorted(groups, key=lambda g: g["files"][0]["number"])]
    broken = _broken_files(spark, [p for _, paths in groups for p in paths])
    frames = []
    for columns, paths in groups:
        if plain := [p for p in paths if p not in broken]:
            frames.append(_parse_lines(spark, columns, plain, found))
        for utf8 in (True, False):
            if quoted := [p for p in paths if broken.get(p) is utf8]:
                frames.append(_parse_whole(spark, columns, quoted, utf8, found))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def scan_lines(spark: SparkSession, paths: Sequence[str], markers: Sequence[str] = K.HEADER_MARKERS,
               preamble: int = K.PREAMBLE_LINES) -> DataFrame:
    """All records of ``paths`` as text columns, with ``source_file`` and ``malformed`` (too many fields); files of equal header share a scan.

    Jobs and driver calls go by the number of different headers, not of files. Files are read line by line; those with line breaks inside
    quotes by whole files. An empty file has no records.
    """
    return _scan_heads(spark, materialize(heads(spark, paths, markers, preamble), "file-heads"))


def scan(spark: SparkSession, paths: Sequence[str], **options) -> DataFrame:
    """Well-formed lines of ``paths``: every column a string, malformed lines skipped, ``source_file`` kept."""
    return scan_lines(spark, paths, **options).where(~F.col("malformed")).drop("malformed")


def scan_labelled(spark: SparkSession, folder: str, required: Sequence[str], markers: Sequence[str] = K.HEADER_MARKERS,
                  preamble: int = K.PREAMBLE_LINES) -> DataFrame:
    """Union of the files below ``folder`` that have all ``required`` columns; other files are skipped after their heads."""
    found = materialize(heads(spark, list_files(spark, folder), markers, preamble), "file-heads")
    needed = F.array(*[F.lit(c) for c in required])
    fitting = found.where(F.size(F.array_except(needed, "columns")) == 0)
    if fitting.isEmpty():
        raise ValueError(f"no file below {folder} has the columns {list(required)}")
    return _scan_heads(spark, fitting).where(~F.col("malformed")).select(*[f"`{c}`" for c in required], "source_file")


def merge(frames: Mapping[str, DataFrame], overrides: Mapping[str, str] | None = None) -> DataFrame:
    """Union of named tables by column name, each row with its source and the trade direction given for that source."""
    overrides = overrides or {}
    tagged = [df.withColumn("source_file", F.lit(name)).withColumn("direction_override",
                                                                  F.lit(overrides.get(name)).cast("string"))
              for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header; embedded quotes are doubled, empty text is quoted and so stays apart from null."""
    df.write.option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``write_csv`` wrote, with empty text and null as they were. No value can equal the null marker used here."""
    return spark.read.schema(schema).options(header=True, escape='"', nullValue="\u0001").csv(path)


def write_slices(df: DataFrame, path: str) -> None:
    """One folder per output slice (accepted, review, other)."""
    from cargoline.operators.standardize import slice_of

    df.withColumn("slice", slice_of(F.col("status"))).write.partitionBy("slice").parquet(path)
