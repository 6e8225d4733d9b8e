"""The labelled history: ground truth, its conflicts, and the HS-to-label mapping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargoline import constants as K
from cargoline.functions import labels
from cargoline.operators.joins import hottest, join_hot

_KEYS = ["hs_code", "clean_text"]


def labelled_rows(rows: DataFrame) -> DataFrame:
    """Rows that can enter the ground truth: a product name, a class 2 and some cleaned text; blank label parts kept."""
    kept = rows.where(F.col("product_name").isNotNull() & F.col("class2").isNotNull() & (F.trim("clean_text") != ""))
    return kept.select("row_id", "hs_code", "product_name", "clean_text",
                       *[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in K.LABEL_COLUMNS])


def build_ground_truth(rows: DataFrame) -> DataFrame:
    """One row per (code, text) whose rows agree on class 2; the row with the lowest id stands for the group.

    Conflict test and dedupe are one aggregate, so a text that fills a third of the table shrinks before the shuffle.
    """
    first = F.min(F.struct("row_id", "product_name", *K.LABEL_COLUMNS))
    groups = labelled_rows(rows).groupBy(*_KEYS).agg(
        first.alias("f"), F.min("class2").alias("low"), F.max("class2").alias("high"))
    return groups.where("low = high").select("hs_code", "f.product_name", "clean_text",
                                             *[F.col(f"f.{c}") for c in K.LABEL_COLUMNS])


def conflicts(rows: DataFrame) -> DataFrame:
    """Every labelled row of a (code, text) group that maps to more than one class 2."""
    labelled = labelled_rows(rows)
    groups = labelled.groupBy(*_KEYS).agg(F.count("*").alias("n"), F.min("class2").alias("low"),
                                          F.max("class2").alias("high")).where("low <> high")
    return join_hot(labelled, groups.select(*_KEYS), _KEYS, hottest(groups, _KEYS, "n"), F.col("row_id"), "inner")


def label_mapping(rows: DataFrame, levels: Sequence[str] = K.LABEL_COLUMNS) -> DataFrame:
    """Top and second value of each label level per 4-digit heading and per full code, with their shares.

    One expand and one aggregate serve both grains and all levels. Expects ``hs_code`` as valid digits.
    """
    grain = F.explode(F.array(F.struct(F.lit("prefix").alias("grain"), F.substring("hs_code", 1, 4).alias("key")),
                              F.struct(F.lit("code").alias("grain"), F.col("hs_code").alias("key")))).alias("g")
    level = F.explode(F.array(*[F.struct(F.lit(lv).alias("level"), labels.normalize_value(F.col(lv), lv).alias("value"))
                                for lv in levels])).alias("l")
    long = rows.where(F.col("hs_code").isNotNull()).select(grain, *levels).select("g.*", level).select(
        "grain", "key", "l.level", "l.value")
    counts = long.groupBy("grain", "key", "level", "value").agg(F.count("*").alias("n"))
    totals = counts.groupBy("grain", "key", "level").agg(F.sum("n").alias("total"))
    rank = F.row_number().over(Window.partitionBy("grain", "key", "level").orderBy(F.desc("n"), "value"))
    top = counts.withColumn("rank", rank).where("rank <= 2")
    wide = top.groupBy("grain", "key", "level").agg(
        F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("top"),
        F.max(F.when(F.col("rank") == 1, F.col("n"))).alias("n_top"),
        F.max(F.when(F.col("rank") == 2, F.col("value"))).alias("alt"),
        F.max(F.when(F.col("rank") == 2, F.col("n"))).alias("n_alt"))
    share = lambda c: F.round(F.col(c) / F.col("total"), 4)
    return wide.join(totals, ["grain", "key", "level"]).select(
        "grain", "key", "level", "top", share("n_top").alias("confidence"), "alt",
        share("n_alt").alias("alt_confidence"), "total")


def mapping_tiers(mapping: DataFrame, high: float = 0.8, medium: float = 0.5) -> DataFrame:
    """Codes by the best share among product line, class 1 and class 2, plus the sizes of both grains."""
    best = mapping.where(F.col("level").isin("product_line", "class1", "class2")).groupBy("grain", "key").agg(
        F.max("confidence").alias("best"))
    is_code = F.col("grain") == "code"
    count = lambda cond: F.count(F.when(cond, 1))
    return best.agg(
        count(is_code).alias("total_hs_codes"), count(~is_code).alias("total_prefixes"),
        count(is_code & (F.col("best") >= high)).alias("high_confidence"),
        count(is_code & (F.col("best") >= medium) & (F.col("best") < high)).alias("medium_confidence"),
        count(is_code & (F.col("best") < medium)).alias("low_confidence"))


def confident_line(code: Column, line: Column, mapped_line: Column, confidence: Column,
                   threshold: float = K.OVERRIDE_CONFIDENCE) -> Column:
    """The mapped product line where its share is high enough, else the line at hand."""
    return F.when(F.coalesce(confidence >= threshold, F.lit(False)), mapped_line).otherwise(line)


def merge_dictionaries(by_priority: dict[int, DataFrame]) -> DataFrame:
    """Keywords of several active dictionaries; the same keyword of a code belongs to the highest priority, then to the
    first entry. One row per (code, keyword)."""
    union = None
    for priority, dictionary in by_priority.items():
        part = dictionary.select("hs_code", F.explode("keywords").alias("keyword"), F.lit(priority).alias("priority"),
                                 "entry_id", *K.LABEL_COLUMNS)
        union = part if union is None else union.unionByName(part)
    best = F.min(F.struct((-F.col("priority")).alias("order"), "entry_id", "priority", *K.LABEL_COLUMNS))
    return union.groupBy("hs_code", "keyword").agg(best.alias("b")).select(
        "hs_code", "keyword", "b.priority", "b.entry_id", *[F.col(f"b.{c}") for c in K.LABEL_COLUMNS])


def merge_active(entries: DataFrame, dictionaries: DataFrame, users: DataFrame, admin: str = "admin") -> DataFrame:
    """Keywords of all active dictionaries by their owners: an administrator's entry before a user's, then the first entry.

    ``entries`` have a ``dictionary_id``, ``dictionaries`` tell owner and ``is_active``, ``users`` tell the role.
    """
    active = dictionaries.where("is_active").join(users, dictionaries["owner_id"] == users["user_id"]).select(
        "dictionary_id", (F.col("role") == admin).cast("int").alias("priority"))
    union = entries.join(active, "dictionary_id").select("hs_code", F.explode("keywords").alias("keyword"), "priority", "entry_id", *K.LABEL_COLUMNS)
    best = F.min(F.struct((-F.col("priority")).alias("order"), "entry_id", "priority", *K.LABEL_COLUMNS))
    return union.groupBy("hs_code", "keyword").agg(best.alias("b")).select(
        "hs_code", "keyword", "b.priority", "b.entry_id", *[F.col(f"b.{c}") for c in K.LABEL_COLUMNS])
