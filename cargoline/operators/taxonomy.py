"""HS taxonomy: look-up by longest prefix, offline tariff fallback, upkeep.

A taxonomy has ``hs_code_prefix, product_line, industry_name, default_type, source``; a tariff reference ``hs_code,
level, description``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cargoline import constants as K
from cargoline.functions import codes, text
from cargoline.sources import snapshots

FIELDS = ["product_line", "industry_name", "default_type", "source"]
PREFIX_LENGTHS = (10, 8, 6, 4)


def longest_prefix(code_rows: DataFrame, taxonomy: DataFrame, lengths: Sequence[int] = PREFIX_LENGTHS) -> DataFrame:
    """Taxonomy record of the longest prefix of each distinct ``code``; null fields without one.

    Each code becomes a handful of prefixes, joined on equality. ``code_rows`` should hold distinct codes.
    """
    size = F.length("code")
    prefixes = F.array_distinct(F.array_compact(F.array(
        F.col("code"), *[F.when(size >= n, F.substring("code", 1, n)) for n in lengths])))
    candidates = code_rows.select("code", F.explode(prefixes).alias("hs_code_prefix"))
    best = candidates.join(taxonomy, "hs_code_prefix").groupBy("code").agg(
        F.max(F.struct(F.length("hs_code_prefix").alias("n"), "hs_code_prefix", *FIELDS)).alias("b"))
    return code_rows.join(best, "code", "left").select(
        *code_rows.columns, F.col("b.hs_code_prefix").alias("matched_prefix"), *[F.col(f"b.{c}").alias(c) for c in FIELDS])


def offline_line(code: Column, heading_text: Column) -> Column:
    """Product line from the fixed headings, else from the heading's tariff text, else the heading itself."""
    heading = F.substring(code, 1, 4)
    fixed = F.create_map(*[F.lit(x) for pair in K.LINE_BY_HEADING_OFFLINE.items() for x in pair])
    named = F.when(F.coalesce(heading_text, F.lit("")) != "", text.line_name(heading_text))
    return F.coalesce(F.try_element_at(fixed, heading), named, F.concat(F.lit("SP "), heading))


def resolve(code_rows: DataFrame, taxonomy: DataFrame, reference: DataFrame) -> DataFrame:
    """Longest-prefix match, then the offline tariff with inferred line and kind; ``source`` null means unresolved."""
    matched = longest_prefix(code_rows, taxonomy)
    tariff = reference.select(F.col("hs_code").alias("code"), F.col("description").alias("_description"))
    headings = reference.where(F.length("hs_code") == 4).select(F.col("hs_code").alias("_heading"),
                                                                F.col("description").alias("_heading_text"))
    joined = matched.join(tariff, "code", "left").withColumn("_heading", F.substring("code", 1, 4)).join(
        headings, "_heading", "left")
    hit = F.col("source").isNotNull()
    offline = F.col("_description").isNotNull()
    pick = lambda field, value: F.when(hit, F.col(field)).when(offline, value).alias(field)
    return joined.select(
        *code_rows.columns, pick("product_line", offline_line(F.col("code"), F.col("_heading_text"))),
        pick("industry_name", F.col("_description")), pick("default_type", text.infer_kind(F.col("_description"))),
        pick("source", F.lit("offline")))


def preclassify(code_rows: DataFrame, taxonomy: DataFrame, dictionary: DataFrame, min_products: int = 100) -> DataFrame:
    """Product line and kind of each distinct ``code`` from its taxonomy record, where the dictionary has an entry of more than
    ``min_products`` products under the record's prefix; null else. The lower levels are left to the classification.

    The entries' codes become prefixes, so records and entries meet by equality.
    """
    counts = dictionary.select(codes.hs_digits(F.col("hs_code")).alias("code"), "n_products").groupBy("code").agg(F.max("n_products").alias("n"))
    prefixes = counts.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("code"), F.lit(1))), lambda n: F.substring("code", F.lit(1), n))).alias("matched_prefix"), "n")
    frequent = prefixes.where("matched_prefix <> ''").groupBy("matched_prefix").agg(F.max("n").alias("n")).where(F.col("n") > min_products).select("matched_prefix", F.lit(True).alias("_frequent"))
    matched = longest_prefix(code_rows, taxonomy).join(frequent, "matched_prefix", "left")
    filled = lambda c, name: F.when(F.col("_frequent"), F.col(c)).alias(name)
    return matched.select(*code_rows.columns, filled("product_line", "product_line"), filled("default_type", "kind"))


def unresolved(resolved: DataFrame) -> DataFrame:
    return resolved.where("source is null").select("code")


def upsert(taxonomy: DataFrame, updates: DataFrame, deletes: DataFrame | None = None) -> DataFrame:
    """Snapshot after ``updates`` (with ``seq`` for their order) and ``deletes``. Invalid codes and kinds are ignored;
    the last update of a code wins; updated records have source ``user_input``."""
    kind = F.upper(F.trim("default_type"))
    valid = updates.select(codes.hs_digits(F.col("hs_code_prefix")).alias("hs_code_prefix"), "product_line",
                           "industry_name", kind.alias("default_type"), "seq").where(
        (F.col("hs_code_prefix") != "") & F.col("default_type").isin("NC", "LK"))
    last = valid.groupBy("hs_code_prefix").agg(
        F.max(F.struct("seq", "product_line", "industry_name", "default_type")).alias("u"))
    joined = taxonomy.join(last, "hs_code_prefix", "full_outer")
    changed = F.col("u").isNotNull()
    out = joined.select("hs_code_prefix",
                        *[F.when(changed, F.col(f"u.{c}")).otherwise(F.col(c)).alias(c) for c in FIELDS[:3]],
                        F.when(changed, F.lit("user_input")).otherwise(F.col("source")).alias("source"))
    if deletes is not None:
        out = out.join(deletes.select(codes.hs_digits(F.col("hs_code_prefix")).alias("hs_code_prefix")),
                       "hs_code_prefix", "left_anti")
    return out


def merge_into(spark: SparkSession, base: str, updates: DataFrame, deletes: DataFrame | None = None) -> snapshots.Manifest:
    """``upsert`` on a taxonomy kept in versions (see ``sources.snapshots``): only the buckets of the updated and deleted codes are rewritten."""
    names = updates.select("hs_code_prefix") if deletes is None else updates.select("hs_code_prefix").unionByName(deletes.select("hs_code_prefix"))
    touched = names.select(codes.hs_digits(F.col("hs_code_prefix")).alias("hs_code_prefix"))
    return snapshots.merge(spark, base, touched, lambda old: upsert(old, updates, deletes))


def seed(names: DataFrame, kinds: DataFrame | None = None, source: str = "system") -> DataFrame:
    """Taxonomy records from industry names per code: line by override, heading map, or ``SP`` heading; kind or NC."""
    line_map = lambda m: F.create_map(*[F.lit(x) for pair in m.items() for x in pair])
    code, heading = F.col("hs_code_prefix"), F.substring("hs_code_prefix", 1, 4)
    line = F.coalesce(F.try_element_at(line_map(K.LINE_OVERRIDES), code),
                      F.try_element_at(line_map(K.LINE_BY_HEADING), heading), F.concat(F.lit("SP "), heading))
    kinds_ = names.select("hs_code_prefix").distinct().withColumn("_kind", F.lit(None).cast("string")) if kinds is None \
        else kinds.select("hs_code_prefix", F.col("default_type").alias("_kind"))
    return names.join(kinds_, "hs_code_prefix", "left").select(
        "hs_code_prefix", line.alias("product_line"), "industry_name",
        F.coalesce("_kind", F.lit("NC")).alias("default_type"), F.lit(source).alias("source"))


def import_reference(sheet: DataFrame) -> DataFrame:
    """Tariff reference from a sheet whose code and description columns are found by name, else by position."""
    named = lambda words, fallback: next(
        (c for c in sheet.columns if any(w in c.lower() for w in words)), sheet.columns[fallback])
    code = F.trim(F.regexp_replace(F.col(f"`{named(('hs', 'mã'), 0)}`"), r"\.", ""))
    description = F.trim(F.coalesce(F.col(f"`{named(('tên', 'mô tả', 'hàng hóa'), 1)}`"), F.lit("nan")))
    rows = sheet.select(code.alias("hs_code"), description.alias("description"))
    return rows.where("hs_code is not null and hs_code <> '' and lower(hs_code) <> 'nan'").select(
        "hs_code", F.length("hs_code").alias("level"), "description")


def official(sheet: DataFrame, code_position: int, description_position: int, order_by: str,
             min_digits: int = 6) -> DataFrame:
    """Code and description by column position, leading hyphens dropped, long codes only; the last row of a code wins."""
    code = F.regexp_replace(F.trim(F.col(f"`{sheet.columns[code_position]}`")), r"\.", "")
    raw = F.trim(F.col(f"`{sheet.columns[description_position]}`"))
    rows = sheet.select(code.alias("hs_code"), raw.alias("raw"), F.col(order_by).alias("_order")).where(
        "hs_code is not null and hs_code <> '' and lower(hs_code) <> 'nan' and raw is not null and raw <> '' "
        "and lower(raw) <> 'nan'").where(F.length("hs_code") >= min_digits)
    last = rows.groupBy("hs_code").agg(F.max(F.struct("_order", "raw")).alias("m"))
    return last.select("hs_code", text.strip_hyphens(F.col("m.raw")).alias("description"))
