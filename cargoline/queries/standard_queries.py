"""Column resolution, standardisation and label expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargoline import constants as K
from cargoline.functions import codes, labels
from cargoline.operators import dictionary as D
from cargoline.operators import standardize as S
from cargoline.plans import shared, views
from cargoline.queries.oracle import (cte, q, sql_label_part, sql_longest, sql_normalize_combined, sql_part)
from cargoline.queries.registry import query

L4 = ", ".join(K.LABEL_COLUMNS)
_NUM = r"TRY_CAST(regexp_replace({0}, '[,$\s]|[a-zA-Z]+', '', 'g') AS DOUBLE)"
_DATE = ("coalesce(try_strptime(date, '%Y-%m-%d'), try_strptime(date, '%d/%m/%Y'))::DATE")
_MONTH = f"coalesce(month({_DATE}), TRY_CAST(right(month, 2) AS INT))::INT"
_BRAND = ("coalesce(" + ", ".join(f"CASE WHEN contains(l, {q(b)}) THEN {q(b[:1].upper() + b[1:])} END" for b in K.BRANDS)
          + ", '')")


@query("resolve_columns", ("declarations",), """SELECT row_id,
  coalesce(CASE WHEN trim(detailed_product) <> '' THEN detailed_product END, detailed_product_en) AS product_name,
  trim(regexp_replace(hs_code, '\\.0$', '')) AS hs_code FROM declarations""")
def resolve_columns(spark, sf_dir):
    raw = views.raw_declarations(spark, sf_dir)
    return raw.select("row_id", S.resolve_description(raw).alias("product_name"), S.resolve_hs(raw).alias("hs_code"))


@query("trade_direction", ("declarations",), """SELECT row_id, vn_importer AS importer, foreign_exporter AS exporter,
  origin_country AS country, CASE WHEN source_file = 'file_3' THEN 'export' ELSE 'import' END AS trade_direction
FROM declarations""")
def trade_direction(spark, sf_dir):
    raw = views.raw_declarations(spark, sf_dir)
    given = F.when(F.col("source_file") == "file_3", "export")
    return S.with_trade(raw, given).select("row_id", "importer", "exporter", "country", "trade_direction")


@query("trade_direction_export", ("declarations",), """SELECT row_id, origin_country AS importer,
  coalesce(CASE WHEN row_id % 7 <> 0 THEN vn_importer END, foreign_exporter) AS exporter,
  continent AS country, 'export' AS trade_direction FROM declarations""")
def trade_direction_export(spark, sf_dir):
    d = views.declarations(spark, sf_dir)
    raw = d.select("row_id", F.when(F.col("row_id") % 7 != 0, F.col("vn_importer")).alias("VN_Exporter"),
                   F.col("foreign_exporter").alias("VN_Exporter_EN"), F.col("origin_country").alias("Foreign_Importer"),
                   F.lit(None).cast("string").alias("Destination_Country"), F.col("continent").alias("Destination_Country_CN"))
    return S.with_trade(raw).select("row_id", "importer", "exporter", "country", "trade_direction")


@query("sanitize_numbers", ("declarations",), f"""SELECT row_id, {_NUM.format('quantity')} AS quantity,
  {_NUM.format('total_value_usd')} AS total_value_usd, {_NUM.format('unit_price_usd')} AS unit_price_usd FROM declarations""")
def sanitize_numbers(spark, sf_dir):
    d = views.declarations(spark, sf_dir)
    return d.select("row_id", *[codes.parse_number(F.col(c)).alias(c) for c in ("quantity", "total_value_usd", "unit_price_usd")])


@query("parse_dates", ("declarations",), f"""SELECT row_id, coalesce(strftime({_DATE}, '%Y-%m-%d'), '') AS iso_date,
  {_MONTH} AS month FROM declarations""")
def parse_dates(spark, sf_dir):
    d = views.declarations(spark, sf_dir).select("row_id", codes.parse_date(F.col("date")).alias("d"), "month")
    return d.select("row_id", codes.iso_date(F.col("d")).alias("iso_date"),
                    codes.month_of(F.col("d"), F.col("month")).alias("month"))


_NULLS = ", ".join(f"NULL::VARCHAR AS {c}" for c in ("product_line", "kind", "class1", "class2", "purpose", "power_2", "kind_1",
                                                     "kind_2", "year", "status"))


@query("standardize", ("declarations",), f"""SELECT row_id, source_file, coalesce(strftime({_DATE}, '%Y-%m-%d'), '') AS date,
  trim(regexp_replace(hs_code, '\\.0$', '')) AS hs_code, vn_importer AS importer, product_name, unit_qty AS unit,
  {_NUM.format('quantity')} AS quantity, {_NUM.format('total_value_usd')} AS total_value_usd,
  {_NUM.format('unit_price_usd')} AS unit_price_usd, {_BRAND} AS brand,
  trim(regexp_extract(l, '(\\d+(?:\\.\\d+)?)\\s*(w|watt|hp|kw|kva|v)', 0)) AS power, origin_country AS country, continent,
  foreign_exporter AS exporter, incoterms, method_of_payment, {_NULLS}, {_MONTH} AS month, 'import' AS trade_direction
FROM (SELECT * EXCLUDE ({L4}), lower({sql_longest('product_name')}) AS l FROM (SELECT *, coalesce(CASE WHEN
  trim(detailed_product) <> '' THEN detailed_product END, detailed_product_en) AS product_name FROM declarations) t) u""")
def standardize(spark, sf_dir):
    return S.standardize(views.raw_declarations(spark, sf_dir), extra=["row_id", "source_file"])


# label parts in the spellings people use
_MESSY = {
    "product_line": "CASE row_id % 4 WHEN 0 THEN ' sp led ' WHEN 1 THEN 'Đèn UV' WHEN 2 THEN NULL ELSE product_line END",
    "kind": "CASE row_id % 5 WHEN 0 THEN 'nguyên chiếc' WHEN 1 THEN 'lk' WHEN 2 THEN '0' ELSE kind END",
    "class1": "CASE row_id % 3 WHEN 0 THEN 'Highbay' WHEN 1 THEN upper(class1) ELSE 'Chưa phân loại' END",
    "class2": "CASE row_id % 3 WHEN 0 THEN 'nan' WHEN 1 THEN class2 ELSE 'Smart' END",
}
cte("messy", ("declarations",), "SELECT row_id, " + ", ".join(f"{e} AS {c}" for c, e in _MESSY.items()) + " FROM declarations")


def messy(spark, sf_dir):
    return views.goods(spark, sf_dir).selectExpr("row_id", *[f"{e} AS {c}" for c, e in _MESSY.items()])


@query("label_normalize", ("messy",), "SELECT row_id, " + ", ".join(
    f"{sql_label_part(c, c)} AS {c}" for c in K.LABEL_COLUMNS) + " FROM messy")
def label_normalize(spark, sf_dir):
    return messy(spark, sf_dir).select("row_id", *[labels.normalize_part(F.col(c), c).alias(c) for c in K.LABEL_COLUMNS])


@query("label_split_join", ("messy",), f"""SELECT row_id, label, """ + ", ".join(
    f"{sql_part('label', i)} AS part{i + 1}" for i in range(5)) + f""", {sql_normalize_combined('label')} AS canonical
FROM (SELECT row_id, concat_ws(' | ', {L4}) AS label FROM messy) t""")
def label_split_join(spark, sf_dir):
    d = messy(spark, sf_dir).select("row_id", labels.combine(*K.LABEL_COLUMNS).alias("label"))
    return d.select("row_id", "label", *[labels.split_part(F.col("label"), i).alias(f"part{i + 1}") for i in range(5)],
                    labels.normalize_combined(F.col("label")).alias("canonical"))


@query("label_signature", ("messy",), f"""SELECT row_id, array_to_string(list_filter(string_split(label, ' | '),
  lambda p: lower(p) <> '{K.NO_LABEL}' AND trim(p) <> ''), '|') AS signature
FROM (SELECT row_id, {sql_normalize_combined("concat_ws(' | ', " + L4 + ")")} AS label FROM messy) t""")
def label_signature(spark, sf_dir):
    d = messy(spark, sf_dir).select("row_id", labels.normalize_combined(labels.combine(*K.LABEL_COLUMNS)).alias("label"))
    return d.select("row_id", labels.signature(F.col("label")).alias("signature"))


_ALIAS_ROWS = ", ".join(f"({q(lv)}, {q(a)}, {q(c)})" for lv, t in K.LABEL_ALIASES.items() for a, c in t.items())


@query("label_alias_table", ("messy",), f"""SELECT level, alias, canonical, count(*)::BIGINT AS n_rows FROM (
  SELECT unnest(['product_line', 'kind', 'class1', 'class2']) AS level,
    unnest([product_line, kind, class1, class2]) AS value FROM messy) m
JOIN (VALUES {_ALIAS_ROWS}) a(lv, alias, canonical) ON lv = level AND alias = trim(value) GROUP BY ALL""")
def label_alias_table(spark, sf_dir):
    """The alias table read from its configuration file, with the rows of the table each alias applies to."""
    from cargoline.session import scratch_path
    from cargoline.sources import tables

    path = scratch_path(spark, "labels")
    tables.write_aliases(spark, path)
    aliases = tables.label_aliases(spark, path)
    values = messy(spark, sf_dir).select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("level"), F.trim(c).alias("alias")) for c in K.LABEL_COLUMNS])).alias("v")).select("v.*")
    return values.groupBy("level", "alias").agg(F.count("*").alias("n_rows")).join(aliases, ["level", "alias"])


@query("search_rows", ("declarations",), """SELECT row_id, product_line, class1 FROM declarations
WHERE contains(lower(detailed_product), 'ring') OR contains(lower(product_line), 'ring') OR contains(lower(vn_importer), 'ring')
  OR contains(lower(class1), 'ring')""")
def search_rows(spark, sf_dir):
    d = views.declarations(spark, sf_dir)
    return S.search_rows(d, "RING", ["detailed_product", "product_line", "vn_importer", "class1"]).select(
        "row_id", "product_line", "class1")


@query("split_by_status", ("cascade",), """SELECT slice, status, count(*)::BIGINT AS n FROM (
  SELECT status, CASE WHEN status LIKE 'auto%' THEN 'accepted' WHEN status = 'review' THEN 'review' ELSE 'other' END AS slice
  FROM cascade) t GROUP BY ALL""")
def split_by_status(spark, sf_dir):
    """Slices written as folders and read back."""
    from cargoline.session import scratch_path
    from cargoline.sources import files

    path = scratch_path(spark, "slices")
    files.write_slices(shared.cleaned(spark, sf_dir).select("row_id", "status"), path)
    back = spark.read.schema("row_id bigint, status string, slice string").parquet(path)
    return back.groupBy("slice", "status").agg(F.count("*").alias("n"))


@query("distinct_hs_codes", ("declarations",), """SELECT code, count(*)::BIGINT AS n_rows FROM (
  SELECT regexp_replace(hs_code, '\\D', '', 'g') AS code FROM declarations) t WHERE length(code) >= 4 GROUP BY 1""")
def distinct_hs_codes(spark, sf_dir):
    return S.distinct_codes(views.goods(spark, sf_dir))


@query("dict_prefixes", ("dictionary",), """SELECT kind, string_agg(h, ',' ORDER BY h) AS headings FROM (
  SELECT DISTINCT kind, regexp_replace(hs_code, '\\D', '', 'g')[1:4] AS h FROM dictionary
  WHERE length(regexp_replace(hs_code, '\\D', '', 'g')) >= 4) t GROUP BY kind""")
def dict_prefixes(spark, sf_dir):
    return D.heading_list(shared.dictionary(spark, sf_dir), ["kind"])
