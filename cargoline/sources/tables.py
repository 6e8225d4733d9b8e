"""Dictionaries, label configuration and the ground-truth table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargoline import constants as K
from cargoline.functions import labels, text
from cargoline.operators.joins import number_sorted
from cargoline.sources import files

#: columns of a dictionary file, by our name
DICTIONARY_COLUMNS = {"keyword": "Keyword", "product_line": "Dòng SP", "kind": "Loại", "class1": "Lớp 1",
                      "class2": "Lớp 2", "hs_code": "Mã HS", "n_products": "Số lượng SP"}


def load_dictionary(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Dictionary entries of all files, in the order of ``paths`` and of their lines. Missing columns and null words become the sentinel;
    ``n_products`` is null where a file does not tell it."""
    frames = [files.scan(spark, [p], markers=["Keyword"], preamble=0).withColumn("_file", F.lit(k)) for k, p in enumerate(paths)]
    raw = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    placed = raw.withColumn("_place", F.struct("_file", F.monotonically_increasing_id().alias("line")))
    have = set(raw.columns)
    value = lambda c: F.col(f"`{DICTIONARY_COLUMNS[c]}`") if DICTIONARY_COLUMNS[c] in have else F.lit(None).cast("string")
    entries = placed.select(
        "_place", text.split_keywords(F.lower(value("keyword"))).alias("keywords"),
        *[labels.or_no_label(value(c)).alias(c) for c in [*K.LABEL_COLUMNS, "hs_code"]], F.try_to_number(F.trim(value("n_products")), F.lit("999999999999")).cast("bigint").alias("n_products"))
    return number_sorted(entries, "_place", "entry_id").drop("_place")


def write_dictionary(dictionary: DataFrame, path: str) -> None:
    """Dictionary in the exchange format: comma-separated keywords and the file's column names, by code, larger entries first."""
    have = [c for c in DICTIONARY_COLUMNS if c in dictionary.columns]
    out = dictionary.select(F.array_join("keywords", ", ").alias("Keyword"), *[F.col(c).alias(DICTIONARY_COLUMNS[c]) for c in have])
    order = [F.col(f"`{DICTIONARY_COLUMNS['hs_code']}`")] + [F.desc(f"`{DICTIONARY_COLUMNS[c]}`") for c in have if c == "n_products"]
    files.write_csv(out.orderBy(*order), path)


def label_aliases(spark: SparkSession, path: str) -> DataFrame:
    """Alias table ``level, alias, canonical`` from a label configuration in JSON (level -> aliases -> canonical)."""
    schema = ", ".join(f"{lv} struct<aliases: map<string, string>>" for lv in K.LABEL_COLUMNS)
    config = spark.read.schema(schema).json(path, multiLine=True)
    rows = [config.select(F.lit(lv).alias("level"), F.explode(f"{lv}.aliases").alias("alias", "canonical"))
            for lv in K.LABEL_COLUMNS]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def write_aliases(spark: SparkSession, path: str, aliases=K.LABEL_ALIASES) -> None:
    """The alias configuration as one JSON document."""
    table = F.struct(*[F.struct(labels.alias_map(aliases[lv]).alias("aliases")).alias(lv) for lv in K.LABEL_COLUMNS])
    spark.range(1).select(F.to_json(table)).coalesce(1).write.text(path)


#: What the history is looked up by. A code alone would put a hot code into one bucket; a code and a text is one row.
HISTORY_KEYS = ["hs_code", "clean_text"]


def save_ground_truth(ground_truth: DataFrame, table: str, buckets: int = 64, path: str | None = None) -> None:
    """Replace the ground-truth table, bucketed and sorted by code and text, so that look-ups in it shuffle only what is looked up.

    The rows are dealt out by the buckets' own keys first: every task writes one file of one bucket. ``path`` places the files outside the
    warehouse.
    """
    writer = (ground_truth.repartition(buckets, *HISTORY_KEYS).write.mode("overwrite").bucketBy(buckets, *HISTORY_KEYS)
              .sortBy(*HISTORY_KEYS).format("parquet"))
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def load_ground_truth(spark: SparkSession, table: str) -> DataFrame:
    """The saved table with its buckets. ``match_history`` and the cascade join it as it lies."""
    return spark.table(table)


def mapping_json(mapping: DataFrame) -> DataFrame:
    """The HS-to-label mapping as one JSON text per key."""
    level = F.struct("top", "confidence", "alt", "alt_confidence")
    return mapping.groupBy("grain", "key").agg(F.max("total").alias("total"), F.map_from_entries(F.array_sort(
        F.collect_list(F.struct(F.col("level").alias("k"), level.alias("v"))))).alias("levels")).select(
        "grain", "key", F.to_json(F.struct("total", "levels")).alias("json"))
