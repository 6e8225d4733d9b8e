"""Declaration-shaped views over the order tables, used by the registered queries.

One declaration per order that has a line item; some have an unknown code or a description that says nothing. A declaration carries an HS code, a free-text description and the label
parts; orders before ``HISTORY_END`` form the labelled history, later ones are new declarations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargoline.functions import codes, text
from cargoline.session import apart, spread

HISTORY_END = "1995-09-01"


#: schemas of the tables, so that a read does not have to open files to learn them
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "benchmark": "item_id bigint, text string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


_FAMILY = ("CASE p_type WHEN 'ECONOMY' THEN '9405' WHEN 'SMALL' THEN '8539' WHEN 'MEDIUM' THEN '9617' "
           "WHEN 'PROMO' THEN '7020' WHEN 'STANDARD' THEN '8516' WHEN 'LARGE' THEN '8504' END")

#: goods part of a declaration: what classification needs
_GOODS = {
    "row_id": "o_orderkey",
    "hs_code": "CASE WHEN o_orderkey % 101 = 0 THEN '' WHEN o_orderkey % 103 = 0 THEN '99999999' WHEN o_orderkey % 5 = 0 THEN concat(code, '.0') ELSE code END",
    "detailed_product": "CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 3 = 0 "
                        "THEN concat('SKU', l_partkey, '#&', upper(base), '#&VN') ELSE base END",
    "detailed_product_en": "base",
    "product_line": "concat('SP ', p_type)",
    "kind": "CASE WHEN noun IN ('bolt', 'gear', 'ring', 'rod') THEN 'LK' ELSE 'NC' END",
    "class1": "noun",
    "class2": "CASE WHEN o_orderkey % 50 = 0 THEN 'khác' ELSE adjective END",
    "source_file": "concat('file_', o_orderkey % 4)",
    "order_date": "to_date(o_orderdate)",
}

#: trade part: parties, amounts, dates
_TRADE = {
    "vn_importer": "c_name",
    "foreign_exporter": "s_name",
    "origin_country": "n_name",
    "continent": "r_name",
    "quantity": "CASE WHEN o_orderkey % 89 = 0 THEN 'n/a' WHEN hundred >= 1000 THEN concat(hundred div 1000, ',', "
                "lpad(hundred % 1000, 3, '0')) ELSE string(hundred) END",
    "total_value_usd": "CASE WHEN o_orderkey % 89 = 0 THEN 'n/a' ELSE concat('$', l_extendedprice) END",
    "unit_price_usd": "CASE WHEN o_orderkey % 89 = 0 THEN 'n/a' "
                      "ELSE concat(floor(l_extendedprice / l_quantity * 100) / 100D, ' USD') END",
    "date": "CASE WHEN o_orderkey % 83 = 0 THEN 'bad-date' WHEN o_orderkey % 2 = 1 "
            "THEN date_format(o_orderdate, 'dd/MM/yyyy') ELSE date_format(o_orderdate, 'yyyy-MM-dd') END",
    "month": "date_format(o_orderdate, 'yyyyMM')",
    "unit_qty": "l_returnflag",
    "incoterms": "o_orderpriority",
    "method_of_payment": "c_mktsegment",
}


def _goods(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the first line of each order as one aggregate: partial aggregation shrinks the lines before the shuffle,
    # where a window would send every line through it
    first_line = (
        table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
        .agg(F.expr("min(struct(l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag)) AS line"))
        .selectExpr("l_orderkey AS o_orderkey", "line.*")
    )
    return (
        first_line.join(apart(table(spark, sf_dir, "orders")), "o_orderkey")
        .join(apart(table(spark, sf_dir, "part")).withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
        .selectExpr("*", "split(p_name, ' ')[1] AS noun", "split(p_name, ' ')[0] AS adjective",
                    "CASE WHEN o_orderkey % 107 = 0 THEN 'Sản phẩm không xác định' "
                    "ELSE concat(p_name, ' ', p_size, 'W ', replace(p_brand, '#', ''), ' mới 100%') END AS base",
                    f"concat({_FAMILY}, lpad(p_size % 8, 2, '0'), '90') AS code",
                    "bigint(l_quantity * 100) AS hundred")
    )


def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = (
        _goods(spark, sf_dir)
        .join(apart(table(spark, sf_dir, "customer")).withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
        .join(apart(table(spark, sf_dir, "supplier")).withColumnRenamed("s_suppkey", "l_suppkey"), "l_suppkey")
        .join(table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey")
        .join(table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    )
    return joined.selectExpr(*[f"{e} AS {c}" for c, e in {**_GOODS, **_TRADE}.items()])


def goods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations without their trade part: spares the party joins where only goods matter."""
    return _goods(spark, sf_dir).selectExpr(*[f"{e} AS {c}" for c, e in _GOODS.items()])


#: raw column names of a declaration file, by view column
RAW_NAMES = {
    "hs_code": "HS_Code", "detailed_product": "Detailed_Product", "detailed_product_en": "Description",
    "vn_importer": "VN_Importer", "foreign_exporter": "Foreign_Exporter", "origin_country": "Origin_Country",
    "continent": "Continent", "quantity": "Quantity", "total_value_usd": "Total_Value_USD",
    "unit_price_usd": "Unit_Price_USD", "date": "Date", "month": "Month", "unit_qty": "Unit_Qty",
    "incoterms": "Incoterms", "method_of_payment": "Method_of_Payment",
}


def raw_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations under the column names of an uploaded import file."""
    df = declarations(spark, sf_dir)
    return df.select("row_id", *[F.col(c).alias(raw) for c, raw in RAW_NAMES.items()], "source_file")


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goods of the declarations ready for matching: plain code, resolved description and cleaned text."""
    df = goods(spark, sf_dir).withColumn("product_name", F.expr(
        "coalesce(CASE WHEN trim(detailed_product) <> '' THEN detailed_product END, detailed_product_en)"))
    return df.withColumns({"hs_code": codes.hs_plain(F.col("hs_code")),
                           "clean_text": text.clean_basic(F.col("product_name"))})


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).where(F.col("order_date") < F.lit(HISTORY_END).cast("date"))


def new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).where(F.col("order_date") >= F.lit(HISTORY_END).cast("date"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long texts; a small file of them is spread over all cores."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text", "lang"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as labelled texts: the source plays the HS code, the language the label."""
    docs = documents(spark, sf_dir)
    return docs.select(F.col("doc_id").alias("row_id"), F.col("source").alias("hs_code"),
                       text.clean_basic(F.col("text")).alias("clean_text"), F.col("lang").alias("label"))
