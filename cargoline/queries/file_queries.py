"""Files: written from the declarations, read back through the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargoline import constants as K
from cargoline.operators import taxonomy
from cargoline.plans import shared, views
from cargoline.queries.oracle import _no_label, cte
from cargoline.queries.registry import query
from cargoline.session import scratch_path
from cargoline.sources import files, tables

_ROWS_PER_FILE = 5000
_COLUMNS = ["HS_Code", "Detailed_Product", "VN_Importer", "Quantity", "Total_Value_USD", "Date"]
L4 = ", ".join(K.LABEL_COLUMNS)


def _quoted(c):
    return F.concat(F.lit('"'), F.regexp_replace(F.coalesce(F.col(c), F.lit("")), '"', '""'), F.lit('"'))


def write_raw_files(spark, sf_dir) -> str:
    """Declaration files as offices send them: nine title lines, a header, data, some lines with too many fields.

    A file holds a bounded range of rows, so their number grows with the table and no task writes a large file.
    """
    raw = views.raw_declarations(spark, sf_dir)
    data = F.concat_ws(",", F.col("row_id").cast("string"), *[_quoted(c) for c in _COLUMNS])
    broken = F.when(F.col("row_id") % 50 == 7, F.lit(",stray,fields")).otherwise(F.lit(""))
    keyed = raw.select(F.floor(F.col("row_id") / _ROWS_PER_FILE).alias("part"), "row_id", F.concat(data, broken).alias("line"))
    titles = [f"Customs report line {i}" for i in range(K.PREAMBLE_LINES)] + [",".join(["row_id", *_COLUMNS])]
    heads = keyed.select("part").distinct().select("part", F.posexplode(F.array(*[F.lit(t) for t in titles])).alias("at", "line"))
    lines = heads.select("part", (F.col("at") - 100).cast("bigint").alias("row_id"), "line").unionByName(keyed)
    path = scratch_path(spark, "raw")
    lines.repartition("part").sortWithinPartitions("part", "row_id").select("part", "line").write.partitionBy("part").text(path)
    return path


@query("scan_preamble_csv", ("declarations",), """SELECT row_id::VARCHAR AS row_id, NULLIF(hs_code, '') AS hs_code,
  NULLIF(coalesce(detailed_product, ''), '') AS product, vn_importer AS importer, quantity, total_value_usd, date
FROM declarations WHERE row_id % 50 <> 7""")
def scan_preamble_csv(spark, sf_dir):
    df = files.scan(spark, files.list_files(spark, write_raw_files(spark, sf_dir)))
    text_or_null = lambda c: F.nullif(F.col(c), F.lit(""))
    return df.select("row_id", text_or_null("HS_Code").alias("hs_code"), text_or_null("Detailed_Product").alias("product"),
                     F.col("VN_Importer").alias("importer"), F.col("Quantity").alias("quantity"),
                     F.col("Total_Value_USD").alias("total_value_usd"), F.col("Date").alias("date"))


@query("scan_malformed_count", ("declarations",), """SELECT (count(*) FILTER (WHERE row_id % 50 = 7))::BIGINT AS n_malformed,
  (count(*) FILTER (WHERE row_id % 50 <> 7))::BIGINT AS n_good FROM declarations""")
def scan_malformed_count(spark, sf_dir):
    lines = files.scan_lines(spark, files.list_files(spark, write_raw_files(spark, sf_dir)))
    return lines.agg(F.count(F.when(F.col("malformed"), 1)).alias("n_malformed"),
                     F.count(F.when(~F.col("malformed"), 1)).alias("n_good"))


#: Customers in a file of mixed kind.
_PER_FILE = 50
cte("mixed", (), f"""SELECT c_custkey AS id, c_custkey // {_PER_FILE} AS part, c_name AS name, 'Café ' || c_mktsegment AS segment, c_acctbal FROM customer""")


def write_mixed_files(spark, sf_dir) -> str:
    """Customer files of three kinds: UTF-8, Latin-1, and with line breaks inside quotes. Some name one column more; a few lines have too many fields."""
    rows = views.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.floor(F.col("c_custkey") / _PER_FILE).alias("part"), F.col("c_name").alias("name"), F.concat(F.lit("Café "), "c_mktsegment").alias("segment"))
    rows = rows.withColumn("kind", F.element_at(F.array(F.lit("plain"), F.lit("latin"), F.lit("quoted")), (F.col("part") % 3 + 1).cast("int")))
    rows = rows.withColumn("more", F.col("part") % 2 == 1)
    broken = F.when(F.col("kind") == "quoted", F.concat(F.lit('"'), "name", F.lit('\n""'), "segment", F.lit('"""'))).otherwise(F.concat(F.lit('"'), "name", F.lit(", "), "segment", F.lit('"')))
    line = F.concat(F.col("id").cast("string"), F.lit(","), broken, F.when(F.col("more"), F.concat(F.lit(","), "segment")).otherwise(""),
                    F.when((F.col("id") % 40 == 3), ",stray").otherwise(""))
    header = F.concat(F.lit("HS_Code,Detailed_Product"), F.when(F.col("more"), ",Segment").otherwise(""))
    titles = rows.select("part", "kind", "more").distinct().withColumn("line", F.concat(F.repeat(F.lit("Báo cáo\n"), K.PREAMBLE_LINES - 1), F.lit("n\u00famero\n"), header))
    titles = titles.withColumn("line", F.when(F.col("kind") == "latin", F.replace("line", F.lit("\u1ea3"), F.lit("a"))).otherwise(F.col("line")))
    every = titles.select("part", "kind", F.lit(-1).cast("bigint").alias("id"), "line").unionByName(rows.select("part", "kind", "id", line.alias("line")))
    raw = F.when(F.col("kind") == "latin", F.encode("line", "ISO-8859-1").cast("string")).otherwise(F.col("line"))
    path = scratch_path(spark, "mixed")
    every.repartition("part").sortWithinPartitions("part", "id").select("part", raw.alias("line")).write.partitionBy("part").text(path)
    return path


@query("scan_mixed_files", ("mixed",), """SELECT id::VARCHAR AS id, CASE WHEN part % 3 = 2 THEN name || chr(10) || '"' || segment || '"' ELSE name || ', ' || segment END AS product,
  CASE WHEN part % 2 = 1 THEN segment END AS segment, id % 40 = 3 AS malformed FROM mixed""")
def scan_mixed_files(spark, sf_dir):
    """Files of two headers, two encodings and with quoted line breaks, all records."""
    lines = files.scan_lines(spark, files.list_files(spark, write_mixed_files(spark, sf_dir)))
    return lines.select(F.col("HS_Code").alias("id"), F.col("Detailed_Product").alias("product"), F.col("Segment").alias("segment"), "malformed")


@query("merge_files_provenance", ("declarations",), """SELECT row_id, hs_code, NULL::VARCHAR AS buyer, 'history.csv' AS source_file,
  'import' AS direction_override FROM declarations WHERE order_date < DATE '1998-01-01'
UNION ALL SELECT row_id, hs_code, vn_importer, 'current.csv', NULL FROM declarations WHERE order_date >= DATE '1998-01-01'""")
def merge_files_provenance(spark, sf_dir):
    d = views.declarations(spark, sf_dir)
    cut = F.lit("1998-01-01").cast("date")
    old = d.where(F.col("order_date") < cut).select("row_id", "hs_code")
    new = d.where(F.col("order_date") >= cut).select(F.col("vn_importer").alias("buyer"), "row_id", "hs_code")
    return files.merge({"history.csv": old, "current.csv": new}, {"history.csv": "import"})


@query("scan_labelled_dir", ("declarations",), f"""SELECT hs_code, product_name, {L4} FROM (
  SELECT NULLIF(hs_code, '') AS hs_code, detailed_product_en AS product_name, {L4} FROM declarations) t""")
def scan_labelled_dir(spark, sf_dir):
    """Two folders of labelled files, one of them without a needed column and therefore passed over."""
    names = {"hs_code": "Mã HS", "detailed_product_en": "Tên hàng", "product_line": "Dòng SP", "kind": "Loại",
             "class1": "Lớp 1", "class2": "Lớp 2"}
    d = views.goods(spark, sf_dir)
    path = scratch_path(spark, "labelled")
    files.write_csv(d.select(*[F.col(c).alias(n) for c, n in names.items()]), f"{path}/complete")
    files.write_csv(d.select(*[F.col(c).alias(n) for c, n in names.items() if c != "class2"]), f"{path}/incomplete")
    back = files.scan_labelled(spark, path, list(names.values()), markers=["Mã HS"], preamble=0)
    return back.select(F.nullif(F.col("`Mã HS`"), F.lit("")).alias("hs_code"), F.col("`Tên hàng`").alias("product_name"),
                       *[F.col(f"`{names[c]}`").alias(c) for c in K.LABEL_COLUMNS])


@query("sink_csv_roundtrip", ("declarations",), """SELECT row_id::VARCHAR AS row_id, hs_code, detailed_product, quantity
FROM declarations""")
def sink_csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "csv")
    files.write_csv(views.declarations(spark, sf_dir).select("row_id", "hs_code", "detailed_product", "quantity"), path)
    return files.read_csv(spark, path, "row_id string, hs_code string, detailed_product string, quantity string")


@query("dict_load", ("dictionary",), f"""SELECT array_to_string(keywords, ', ') AS keywords, n_products,
  {', '.join(f"{_no_label(c)} AS {c}" for c in [*K.LABEL_COLUMNS, 'hs_code'])} FROM dictionary""")
def dict_load(spark, sf_dir):
    """The dictionary in its exchange format, written and loaded."""
    path = scratch_path(spark, "dict")
    tables.write_dictionary(shared.dictionary(spark, sf_dir), path)
    back = tables.load_dictionary(spark, files.list_files(spark, path, ".csv"))
    return back.select(F.array_join("keywords", ", ").alias("keywords"), "n_products", *K.LABEL_COLUMNS, "hs_code")


_FAMILY = ("CASE p_type WHEN 'ECONOMY' THEN '9405' WHEN 'SMALL' THEN '8539' WHEN 'MEDIUM' THEN '9617' WHEN 'PROMO' THEN '7020' "
           "WHEN 'STANDARD' THEN '8516' WHEN 'LARGE' THEN '8504' END")
cte("sheet", (), f"""SELECT p_partkey, p_brand, ({_FAMILY}) || '.' || lpad((p_size % 8)::VARCHAR, 2, '0') || '.90' AS code,
  CASE WHEN p_size % 11 = 0 THEN ' ' ELSE '- - ' || p_name || ' (' || p_brand || ')' END AS description FROM part""")


def tariff_sheet(spark, sf_dir):
    """A tariff sheet: one row per part, dotted codes, hyphened texts, some blank."""
    return views.table(spark, sf_dir, "part").selectExpr(
        f"concat({_FAMILY}, '.', lpad(p_size % 8, 2, '0'), '.90') AS `Mã HS`",
        "CASE WHEN p_size % 11 = 0 THEN ' ' ELSE concat('- - ', p_name, ' (', p_brand, ')') END AS `Mô tả hàng hóa`",
        "p_partkey AS row_no")


@query("reference_import", ("sheet",), """SELECT replace(code, '.', '') AS hs_code, length(replace(code, '.', ''))::INT AS level,
  trim(description) AS description FROM sheet""")
def reference_import(spark, sf_dir):
    return taxonomy.import_reference(tariff_sheet(spark, sf_dir))


@query("official_taxonomy", ("sheet",), """SELECT hs_code, trim(regexp_replace(arg_max(d, p_partkey), '^[ -]+', '')) AS description
FROM (SELECT replace(trim(code), '.', '') AS hs_code, trim(description) AS d, p_partkey FROM sheet) t
WHERE d <> '' AND length(hs_code) >= 6 GROUP BY 1""")
def official_taxonomy(spark, sf_dir):
    return taxonomy.official(tariff_sheet(spark, sf_dir), 0, 1, "row_no")
