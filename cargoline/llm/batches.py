"""Helpers shared by the operators that work on Arrow batches inside tasks."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

import cargoline

#: Text that a task holds decoded at one time, in bytes; a longer single text is held alone.
CHUNK_CHARS = 4_000_000


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that tasks can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_cargoline_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(cargoline.__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="cargoline-"), "cargoline.zip")  # read by the driver's file server only
    with zipfile.ZipFile(archive, "w") as packed:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    packed.write(path, os.path.relpath(path, os.path.dirname(top)))
    context.addPyFile(archive)
    context._cargoline_shipped = True


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has at most ``limit`` bytes of ``text``, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
        first = held = 0
        for row, size in enumerate(sizes):
            if row > first and held + size > limit:
                yield batch.slice(first, row - first)
                first, held = row, 0
            held += size
        yield batch.slice(first)


def add_columns(df: DataFrame, text: str, fn: Callable[[pa.Array], dict[str, pa.Array]], schema: dict[str, str]) -> DataFrame:
    """``df`` with the columns that ``fn`` makes of the text column, one value per row; ``fn`` runs on chunks inside tasks.

    Every row and every other column stays as it is, so repeated rows, null keys and further columns need no join back. A
    new column replaces one of the same name.
    """
    kept = [c for c in df.columns if c not in schema]
    ship(df.sparkSession)
    source = df.select(*[F.col(f"`{c}`") for c in kept])
    if text not in kept:
        raise ValueError(f"the text column {text!r} would be replaced")
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema] + [f"`{n}` {t}" for n, t in schema.items()])

    def run(batches):
        for batch in chunks(batches, text):
            new = fn(batch.column(text))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[new[n] for n in schema]], names=[*batch.schema.names, *schema])

    return source.mapInArrow(run, out)
