"""Reports over the cleaned table and the job log. Every report is an aggregate, so it folds inside map tasks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargoline import constants as K
from cargoline.session import materialize



def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows and share per value of each column, in one pass over the table; nulls are not counted as values."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    counts = df.select(pairs.alias("p")).select("p.*").groupBy("column", "value").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("column"))  # of the counts, nulls included: the table is read once
    return counts.withColumn("share", F.round(F.col("n") / total, 6)).where("value is not null")


def top_values(df: DataFrame, column: str, limit: int = 5) -> DataFrame:
    """Most frequent values of a column, the value itself breaking ties: a top-k, no full sort."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(limit)


def top_companies(df: DataFrame, limit: int = 5) -> DataFrame:
    """Companies by total value: the importer of imports, else the exporter; rows without value or name do not count."""
    company = F.when(F.col("trade_direction") == "import", F.col("importer")).otherwise(F.col("exporter"))
    valued = df.select(company.alias("company"), F.col("total_value_usd").alias("v")).where(
        "company is not null and company <> '' and v is not null")
    return (valued.groupBy("company").agg(F.round(F.sum("v"), 2).alias("total_value"))
            .orderBy(F.desc("total_value"), "company").limit(limit))


def exception_groups(df: DataFrame, by: Sequence[str] = ("hs_code", "brand")) -> DataFrame:
    """Review rows per group; rows with a null key are left out."""
    rows = df.where(F.col("status") == K.STATUS_REVIEW).dropna(subset=list(by))
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def pattern_report(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(F.col(column).alias("pattern")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # of one row per pattern
    return counts.withColumn("percent", F.round(F.col("n") * 100.0 / total, 2))


def cross_tab(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Counts of two columns in long form; pivot for display."""
    return df.groupBy(rows, columns).agg(F.count("*").alias("n"))


def overview(df: DataFrame) -> DataFrame:
    """Rows, total value, total quantity, rows with a code and distinct codes."""
    has_code = F.col("hs_code").isNotNull() & (F.col("hs_code") != "")
    return df.agg(F.count("*").alias("n_rows"), F.round(F.sum("total_value_usd"), 2).alias("total_value"),
                  F.round(F.sum("quantity"), 2).alias("total_quantity"), F.count(F.when(has_code, 1)).alias("n_with_code"),
                  F.countDistinct(F.when(has_code, F.col("hs_code"))).alias("n_codes"))


def usage_counts(log: DataFrame, key: str) -> DataFrame:
    return log.groupBy(key).agg(F.count("*").alias("usage_count"))


def batch_progress(jobs: DataFrame, batch: str = "batch_id", status: str = "status") -> DataFrame:
    """Finished share per batch in percent: 30 while nothing is finished but something runs, 99 while anything runs."""
    n = lambda cond: F.count(F.when(cond, 1))
    s = F.col(status)
    sums = jobs.groupBy(batch).agg(F.count("*").alias("n_jobs"), n(s == "done").alias("n_done"),
                                   n(s == "error").alias("n_error"), n(s.isin("pending", "processing")).alias("n_running"))
    share = F.floor((F.col("n_done") + F.col("n_error")) * 100 / F.col("n_jobs")).cast("int")
    running = F.col("n_running") > 0
    progress = F.when((share == 0) & running, 30).when((share == 100) & running, 99).otherwise(share)
    return sums.withColumn("progress", progress.cast("int"))


def coverage(df: DataFrame, by: str = "source_file") -> DataFrame:
    """Per source file: rows, labelled rows, review rows, auto share, and the distribution check on product lines."""
    labelled = F.col("product_line").isNotNull() & ~F.trim("product_line").isin("", "UNKNOWN")
    lines = df.groupBy(by, "product_line").agg(
        F.count("*").alias("n"), F.count(F.when(labelled, 1)).alias("n_labelled"),
        F.count(F.when(F.col("status") == K.STATUS_REVIEW, 1)).alias("n_review"),
        F.count(F.when(F.startswith("status", F.lit("auto")), 1)).alias("n_auto"))
    return lines.groupBy(by).agg(
        F.sum("n").alias("n_rows"), F.sum("n_labelled").alias("n_labelled"), F.sum("n_review").alias("n_review"),
        F.round(F.sum("n_auto") * 100.0 / F.sum("n"), 2).alias("auto_pct"),
        F.round(F.max("n") * 100.0 / F.sum("n"), 2).alias("top_line_pct"), F.count("*").alias("n_lines"))


def inconsistent_inputs(df: DataFrame, keys: Sequence[str], output: str) -> DataFrame:
    """Inputs that got more than one output. Compares the least with the greatest output: no distinct set per key."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(output).alias("low"), F.max(output).alias("high"))
    return groups.where("low <> high")


def keep_newest(jobs: DataFrame, per: str, newest_by: str, tie: str, keep: int = 10) -> DataFrame:
    """The newest ``keep`` rows per owner. Each task cuts to ``keep`` rows per owner before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(per).orderBy(F.desc(newest_by), F.desc(tie)))
    return jobs.withColumn("_rank", rank).where(F.col("_rank") <= keep).drop("_rank")


def with_parents(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Child rows whose parent survived."""
    return children.join(parents.select(key), key, "left_semi")


def page(df: DataFrame, order_by: str, skip: int, limit: int) -> DataFrame:
    return df.orderBy(order_by).offset(skip).limit(limit)


def in_ranges(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """``df`` written in ranges of ``order_by``, their number as ``_range``: made once, read by ``deep_page`` for any number of pages."""
    return materialize(df.repartitionByRange(*order_by).withColumn("_range", F.spark_partition_id()), "ranges")


def deep_page(ranged: DataFrame, order_by: Sequence[str], skip: int, limit: int) -> DataFrame:
    """Rows ``skip`` to ``skip + limit`` in the order of ``order_by``, nulls first, without sorting or gathering what lies before them.

    The rows of each range are counted, which reads no other column, and only the ranges that hold a part of the page are read and sorted.
    ``order_by`` should tell rows apart: equal rows share a range, and a page that cuts through them takes any.
    """
    counts = sorted(ranged.groupBy("_range").agg(F.count("*").alias("n")).collect())  # one row per range
    before, first, offset, held = 0, None, 0, []
    for number, n in counts:
        if before < skip + limit and before + n > skip:
            if first is None:
                first, offset = number, skip - before
            held.append(number)
        before += n
    if first is None or limit < 1:
        return ranged.drop("_range").limit(0)
    rows = ranged.where(F.col("_range").between(first, held[-1])).drop("_range")
    return rows.orderBy(*order_by).offset(offset).limit(limit)


def spot_check(df: DataFrame, by: str, key: str, per_group: int = 10, seed: int = 42) -> DataFrame:
    """Up to ``per_group`` rows per group in hash order: a repeatable sample, cut per task before the shuffle."""
    order = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order, key))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= per_group).drop("_rank")


def spot_check_strata(df: DataFrame, by: str, key: str, sizes: Mapping[str, int], per_group: int = 10, seed: int = 42) -> DataFrame:
    """``spot_check`` with a size of its own for the groups named in ``sizes``, such as the review rows."""
    wanted = F.coalesce(*[F.when(F.col(by) == g, n) for g, n in sizes.items()], F.lit(per_group))
    drawn = spot_check(df, by, key, max([per_group, *sizes.values()]), seed)
    order = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order, key))
    return drawn.withColumn("_rank", rank).where(F.col("_rank") <= wanted).drop("_rank")


def merge_sources(rows: DataFrame, dict_result: DataFrame, model_result: DataFrame) -> DataFrame:
    """Dictionary result where there is one, else the model's, else none; joined by row id, never by position."""
    d = dict_result.select("row_id", "dict_label", "dict_confidence")
    m = model_result.select("row_id", "ai_label", "ai_confidence")
    joined = rows.join(d, "row_id", "left").join(m, "row_id", "left")
    from_dict, from_model = F.col("dict_label").isNotNull(), F.col("ai_label").isNotNull()
    from cargoline.functions import labels

    final = F.coalesce("dict_label", "ai_label")
    parts = [labels.split_part(final, i).alias(c) for i, c in enumerate([*K.LABEL_COLUMNS, "predicted_hs"])]
    return joined.select(
        "row_id", F.when(from_dict, "dict").when(from_model, "ai").otherwise("none").alias("source"), *parts,
        F.when(from_dict, F.col("dict_confidence")).when(from_model, F.col("ai_confidence")).otherwise(0.0).alias("confidence"),
        "dict_label", "ai_label")
