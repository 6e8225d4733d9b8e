"""Evaluation measures and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cargoline import constants as K
from cargoline.operators import evaluate as E
from cargoline.operators import report as R
from cargoline.plans import shared, views
from cargoline.queries.oracle import LABEL4, TRUTH, cte, q, sql_label_part, sql_normalize_combined, sql_part
from cargoline.queries.registry import query

L4 = ", ".join(K.LABEL_COLUMNS)

# --- evaluation -----------------------------------------------------------------------------------------------------
_PRED = [sql_label_part(sql_part("CASE WHEN trim(coalesce(predicted_label, '')) <> '' THEN predicted_label END", i), c)
         for i, c in enumerate(K.LABEL_COLUMNS)]
_OK = [f"({sql_label_part(c, c)} = {p})" for c, p in zip(K.LABEL_COLUMNS, _PRED)]
_OK.append("(" + " AND ".join(_OK) + ")")


@query("accuracy_breakdown", ("evaluation",), f"""SELECT level, correct, total, round(correct / total, 4) AS accuracy FROM (
  SELECT unnest({'[' + ', '.join(q(c) for c in [*K.LABEL_COLUMNS, 'combined']) + ']'}) AS level,
    unnest([{', '.join(f'(count(*) FILTER (WHERE {o}))::BIGINT' for o in _OK)}]) AS correct, count(*)::BIGINT AS total FROM evaluation) t""")
def accuracy_breakdown(spark, sf_dir):
    return E.accuracy(shared.evaluation(spark, sf_dir))


@query("accuracy_weighted", ("evaluation",), f"""SELECT level, round(correct, 6) AS correct, round(total, 6) AS total,
  round(correct / total, 4) AS accuracy FROM (
  SELECT unnest({'[' + ', '.join(q(c) for c in [*K.LABEL_COLUMNS, 'combined']) + ']'}) AS level,
    unnest([{', '.join(f'coalesce(sum(w) FILTER (WHERE {o}), 0)' for o in _OK)}]) AS correct, sum(w) AS total
  FROM (SELECT *, CASE WHEN kind = 'LK' THEN 0.5 ELSE 1.0 END::DOUBLE AS w FROM evaluation) e) t""")
def accuracy_weighted(spark, sf_dir):
    out = E.accuracy(shared.evaluation(spark, sf_dir), weight=F.when(F.col("kind") == "LK", 0.5).otherwise(1.0))
    return out.withColumns({"correct": F.round("correct", 6), "total": F.round("total", 6)})


@query("confused_pairs", ("confusion",), """SELECT truth, predicted, n FROM confusion WHERE truth <> predicted
ORDER BY n DESC, truth, predicted LIMIT 10""")
def confused_pairs(spark, sf_dir):
    return E.confused_pairs(E.confusion(shared.evaluation(spark, sf_dir)))


cte("top_confused", ("confusion",), """SELECT label, sum(n)::BIGINT AS n_errors FROM (
  SELECT truth AS label, n FROM confusion WHERE truth <> predicted UNION ALL SELECT predicted, n FROM confusion WHERE truth <> predicted) t
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")


@query("confusion_top_classes", ("top_confused",), "SELECT * FROM top_confused")
def confusion_top_classes(spark, sf_dir):
    return E.confused_classes(E.confusion(shared.evaluation(spark, sf_dir)))


cte("top_both", ("top_confused", "confusion"), """SELECT label FROM top_confused
WHERE label IN (SELECT truth FROM confusion) AND label IN (SELECT predicted FROM confusion)""")


@query("confusion_submatrix", ("top_both", "confusion"), """SELECT truth, predicted, n FROM confusion
WHERE truth IN (SELECT label FROM top_both) AND predicted IN (SELECT label FROM top_both)""")
def confusion_submatrix(spark, sf_dir):
    return E.confusion_submatrix(E.confusion(shared.evaluation(spark, sf_dir)))


@query("label_intersect", ("confusion",), "SELECT truth AS label FROM confusion INTERSECT SELECT predicted FROM confusion")
def label_intersect(spark, sf_dir):
    return E.labels_on_both_sides(E.confusion(shared.evaluation(spark, sf_dir)))


@query("dict_vs_model", ("judged",), """SELECT *, round(dict_handled_rows * 100.0 / total_rows, 2)::DOUBLE AS dict_coverage_pct,
  round(dict_correct * 100.0 / dict_handled_rows, 2)::DOUBLE AS dict_accuracy, round(ai_correct * 100.0 / total_rows, 2)::DOUBLE AS ai_accuracy
FROM (SELECT count(*)::BIGINT AS total_rows, count(dict_label)::BIGINT AS dict_handled_rows,
  (count(*) FILTER (WHERE first_right))::BIGINT AS dict_correct, (count(*) FILTER (WHERE model_right))::BIGINT AS ai_correct,
  (count(*) FILTER (WHERE first_right AND model_right))::BIGINT AS both_correct,
  (count(*) FILTER (WHERE NOT first_right AND NOT model_right))::BIGINT AS both_wrong,
  (count(*) FILTER (WHERE first_right AND NOT model_right))::BIGINT AS dict_only_correct,
  (count(*) FILTER (WHERE NOT first_right AND model_right))::BIGINT AS ai_only_correct FROM judged) t""")
def dict_vs_model(spark, sf_dir):
    return E.dictionary_versus_model(shared.evaluation(spark, sf_dir))


_EDGES = K.CALIBRATION_EDGES
_BINS = ", ".join(f"({i}, {_EDGES[i]}, {_EDGES[i + 1]})" for i in range(len(_EDGES) - 1))
cte("calibration", ("judged",), f"""
SELECT bin, low::DOUBLE AS low, high::DOUBLE AS high, count(c)::BIGINT AS n, coalesce(round(count(c) FILTER (WHERE model_right) / nullif(count(c), 0), 4), 0.0) AS accuracy,
  coalesce(round(avg(c) / 100, 4), 0.0) AS mean_confidence
FROM (VALUES {_BINS}) b(bin, low, high) LEFT JOIN (SELECT ai_confidence AS c, model_right FROM judged) j
  ON c / 100 >= low AND (c / 100 < high OR bin = {len(_EDGES) - 2}) GROUP BY ALL""")


@query("calibration_bins", ("calibration",), "SELECT * FROM calibration")
def calibration_bins(spark, sf_dir):
    return E.calibration(shared.evaluation(spark, sf_dir))


@query("calibration_threshold", ("calibration",), """SELECT max(bin) FILTER (WHERE lead_ok = 1) AS optimal_bin,
  arg_max(bin, (accuracy, -bin)) AS best_bin, max(accuracy) AS best_accuracy
FROM (SELECT *, min(CASE WHEN accuracy > 0 AND accuracy >= mean_confidence * 0.9 THEN 1 ELSE 0 END) OVER (ORDER BY bin) AS lead_ok
      FROM calibration) t""")
def calibration_threshold(spark, sf_dir):
    return E.calibration_thresholds(E.calibration(shared.evaluation(spark, sf_dir)))


def _three(what: int, rest: str) -> str:
    arms = " ".join("WHEN " + " AND ".join(f"{c} = {str(v).lower()}" for c, v in zip(("first_right", "second_right", "model_right"), key))
                    + f" THEN {q((name, todo)[what])}" for key, name, todo in E.THREE_WAY)
    return f"CASE {arms} ELSE '{rest}' END"


cte("threeway", ("judged",), f"SELECT *, {_three(0, 'other')} AS pattern, {_three(1, 'none')} AS action FROM judged")


@query("threeway_patterns", ("threeway",), """SELECT pattern, action, count(*)::BIGINT AS n,
  round(count(*) * 100.0 / (SELECT count(*) FROM threeway), 2)::DOUBLE AS percent FROM threeway GROUP BY ALL""")
def threeway_patterns(spark, sf_dir):
    t = E.three_way(shared.evaluation(spark, sf_dir))
    return t.groupBy("pattern", "action").agg(F.count("*").alias("n")).withColumn(
        "percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 2))


@query("threeway_fixes", ("threeway",), """SELECT row_id, hs_code, product_name, coalesce(dict_label, 'Unknown') AS matched_label,
  truth AS correct_label FROM threeway WHERE pattern = 'model_right_only'""")
def threeway_fixes(spark, sf_dir):
    return E.dictionary_fixes(E.three_way(shared.evaluation(spark, sf_dir)))


@query("threeway_report", ("threeway",), """SELECT row_id, pattern, pattern = 'all_wrong' AS hard FROM threeway
WHERE NOT (first_right AND second_right AND model_right) OR coalesce(dict_label, '') <> coalesce(dict_b_label, '')
  OR coalesce(dict_label, '') <> coalesce(ai_label, '')""")
def threeway_report(spark, sf_dir):
    t = E.disagreeing(E.three_way(shared.evaluation(spark, sf_dir)))
    return t.select("row_id", "pattern", (F.col("pattern") == "all_wrong").alias("hard"))


# the true label is known for three of the four source files
_TRUE = f"CASE WHEN source_file <> 'file_0' THEN {LABEL4} END"
cte("disagreement", ("evaluation",), f"""
SELECT *, CASE WHEN t IS NULL AND d <> m THEN 'conflict' WHEN d_ok AND m_ok THEN 'verified' WHEN NOT d_ok AND m_ok AND t IS NOT NULL THEN 'dict_fail_ai_pass'
  WHEN d_ok AND NOT m_ok AND t IS NOT NULL THEN 'dict_pass_ai_fail' WHEN NOT d_ok AND NOT m_ok AND t IS NOT NULL THEN 'both_fail'
  ELSE 'verified' END AS pattern
FROM (SELECT *, d IS NOT NULL AND (t IS NULL OR d = t) AS d_ok, m IS NOT NULL AND (t IS NULL OR m = t) AS m_ok
  FROM (SELECT row_id, product_name, product_name[1:200] AS product, hs_code, ai_confidence / 100 AS ai_confidence,
      CASE WHEN dict_label IS NOT NULL THEN {sql_normalize_combined('dict_label')} END AS d,
      CASE WHEN ai_label IS NOT NULL THEN {sql_normalize_combined('ai_label')} END AS m,
      CASE WHEN source_file <> 'file_0' THEN {TRUTH} END AS t FROM evaluation) a) b""")


def disagreement_table(spark, sf_dir):
    e = shared.evaluation(spark, sf_dir).withColumns({"true_label": F.expr(
        f"CASE WHEN source_file <> 'file_0' THEN concat_ws(' | ', {L4}) END"), "ai_confidence": F.col("ai_confidence") / 100})
    return E.disagreements(e)


@query("disagreement", ("disagreement",), "SELECT row_id, d AS dict_norm, m AS ai_norm, t AS truth, pattern FROM disagreement")
def disagreement(spark, sf_dir):
    return disagreement_table(spark, sf_dir).select("row_id", "dict_norm", "ai_norm", "truth", "pattern")


@query("dict_proposals", ("disagreement",), f"""SELECT row_id, product, hs_code, regexp_replace(hs_code, '\\D', '', 'g')[1:4] AS hs_prefix,
  {', '.join(f"{sql_part('m', i)} AS suggested_{c}" for i, c in enumerate(K.LABEL_COLUMNS))}, round(ai_confidence, 6) AS ai_confidence
FROM disagreement WHERE pattern = 'dict_fail_ai_pass' AND ai_confidence >= 0.8""")
def dict_proposals(spark, sf_dir):
    return E.proposals(disagreement_table(spark, sf_dir)).withColumn("ai_confidence", F.round("ai_confidence", 6))


cte("retrain_base", ("disagreement",), """SELECT row_id, hs_code, product_name AS product, CASE WHEN pattern = 'dict_fail_ai_pass' THEN m ELSE d END AS label,
  CASE WHEN pattern = 'dict_fail_ai_pass' THEN ai_confidence ELSE 1.0 END AS confidence,
  CASE WHEN pattern = 'dict_fail_ai_pass' THEN 'model_right' ELSE 'dict_right' END AS source
FROM disagreement WHERE (pattern = 'dict_fail_ai_pass' AND ai_confidence >= 0.75) OR pattern = 'dict_pass_ai_fail'""")


@query("retrain_rows", ("retrain_base",), f"""
SELECT row_id, source, label, variant, 'san pham: ' || text AS text, round(confidence * CASE WHEN variant = 0 THEN 1.0 ELSE 0.5 END, 2) AS weight
FROM (SELECT row_id, label, confidence, CASE WHEN pos = 1 THEN source ELSE source || '_variant' END AS source, (pos - 1)::INT AS variant, text
  FROM (SELECT *, unnest(v) AS text, generate_subscripts(v, 1) AS pos FROM (
    SELECT *, [product] || list_slice(list_transform(list_filter(list_zip(c, range(1, len(c) + 1)), lambda z: list_position(c, z[1]) = z[2]),
        lambda z: z[1]), 1, 3) AS v
    FROM (SELECT *, list_filter((CASE WHEN len(p) >= 4 THEN [array_to_string(p[1:3], ' '), array_to_string(p[1:2], ' ') || ' ' || p[len(p)]] ELSE [] END)
        || (CASE WHEN len(p) >= 3 THEN [array_to_string(p[2:], ' ')] ELSE [] END)
        || list_transform(regexp_split_to_array(b, '[,;/]'), lambda s: trim(s)), lambda s: len(string_split(s, ' ')) >= 2 AND s <> b) AS c
      FROM (SELECT *, string_split(b, ' ') AS p FROM (SELECT *, lower(product) AS b FROM retrain_base) x) y) z) w) u) r""")
def retrain_rows(spark, sf_dir):
    return E.retraining_rows(disagreement_table(spark, sf_dir)).select("row_id", "source", "label", "variant", "text", "weight")


@query("class_accuracy", ("judged",), """SELECT truth, count(*)::BIGINT AS n, (count(*) FILTER (WHERE predicted_right))::BIGINT AS n_right,
  (count(*) FILTER (WHERE NOT predicted_right))::BIGINT AS n_wrong FROM judged GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def class_accuracy(spark, sf_dir):
    return E.class_accuracy(shared.evaluation(spark, sf_dir))


@query("pattern_report", ("disagreement",), """SELECT pattern, count(*)::BIGINT AS n,
  round(count(*) * 100.0 / (SELECT count(*) FROM disagreement), 2)::DOUBLE AS percent FROM disagreement GROUP BY 1""")
def pattern_report(spark, sf_dir):
    return R.pattern_report(disagreement_table(spark, sf_dir), "pattern")


@query("merge_sources", ("evaluation",), f"""SELECT row_id, CASE WHEN dict_b_label IS NOT NULL THEN 'dict' WHEN ai_label IS NOT NULL THEN 'ai' ELSE 'none' END
    AS source, {', '.join(f"{sql_part('coalesce(dict_b_label, ai_label)', i)} AS {c}" for i, c in enumerate([*K.LABEL_COLUMNS, 'predicted_hs']))},
  CASE WHEN dict_b_label IS NOT NULL THEN 100.0 WHEN ai_label IS NOT NULL THEN ai_confidence ELSE 0.0 END::DOUBLE AS confidence,
  dict_b_label AS dict_label, ai_label FROM evaluation""")
def merge_sources(spark, sf_dir):
    e = shared.evaluation(spark, sf_dir)
    d = e.select("row_id", F.col("dict_b_label").alias("dict_label"), F.lit(100.0).alias("dict_confidence"))
    return R.merge_sources(e.select("row_id"), d, e.select("row_id", "ai_label", "ai_confidence"))


# --- reports --------------------------------------------------------------------------------------------------------
_NUM = r"TRY_CAST(regexp_replace({0}, '[,$\s]|[a-zA-Z]+', '', 'g') AS DOUBLE)"
cte("trade", ("declarations",), f"""SELECT row_id, trim(regexp_replace(hs_code, '\\.0$', '')) AS hs_code, product_line, kind, class1, source_file,
  vn_importer AS importer, foreign_exporter AS exporter, CASE WHEN source_file = 'file_3' THEN 'export' ELSE 'import' END AS trade_direction,
  {_NUM.format('quantity')} AS quantity, {_NUM.format('total_value_usd')} AS total_value_usd FROM declarations""")


@query("value_counts", ("declarations",), """SELECT c AS "column", v AS value, count(*)::BIGINT AS n,
  round(count(*) / (SELECT count(*) FROM declarations), 6) AS share
FROM (SELECT unnest(['product_line', 'kind', 'class1']) AS c, unnest([product_line, kind, class1]) AS v FROM declarations) t GROUP BY ALL""")
def value_counts(spark, sf_dir):
    return R.value_counts(views.goods(spark, sf_dir), ["product_line", "kind", "class1"])


@query("value_counts_top", ("declarations",), """SELECT class1 AS value, count(*)::BIGINT AS n FROM declarations GROUP BY 1
ORDER BY 2 DESC, 1 LIMIT 5""")
def value_counts_top(spark, sf_dir):
    return R.top_values(views.goods(spark, sf_dir), "class1")


@query("top_companies", ("trade",), """SELECT CASE WHEN trade_direction = 'import' THEN importer ELSE exporter END AS company,
  round(sum(total_value_usd), 2) AS total_value FROM trade WHERE total_value_usd IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def top_companies(spark, sf_dir):
    return R.top_companies(shared.trade(spark, sf_dir))


_BRAND = ("coalesce(" + ", ".join(f"CASE WHEN contains(lower(product_name), {q(b)}) THEN {q(b[:1].upper() + b[1:])} END" for b in K.BRANDS)
          + ", '')")


@query("exception_groups", ("cascade",), f"""SELECT hs_code, {_BRAND} AS brand, count(*)::BIGINT AS n FROM cascade
WHERE status = 'review' GROUP BY ALL""")
def exception_groups(spark, sf_dir):
    return R.exception_groups(shared.cleaned(spark, sf_dir))


@query("overview", ("trade",), """SELECT count(*)::BIGINT AS n_rows, round(sum(total_value_usd), 2) AS total_value,
  round(sum(quantity), 2) AS total_quantity, (count(*) FILTER (WHERE hs_code <> ''))::BIGINT AS n_with_code,
  (count(DISTINCT hs_code) FILTER (WHERE hs_code <> ''))::BIGINT AS n_codes FROM trade""")
def overview(spark, sf_dir):
    return R.overview(shared.trade(spark, sf_dir))


@query("source_status_xtab", ("cascade",), "SELECT source_file, status, count(*)::BIGINT AS n FROM cascade GROUP BY ALL")
def source_status_xtab(spark, sf_dir):
    return R.cross_tab(shared.cleaned(spark, sf_dir), "source_file", "status")


@query("coverage_by_file", ("cascade",), """SELECT source_file, sum(n)::BIGINT AS n_rows, sum(l)::BIGINT AS n_labelled, sum(r)::BIGINT AS n_review,
  round(sum(a) * 100.0 / sum(n), 2)::DOUBLE AS auto_pct, round(max(n) * 100.0 / sum(n), 2)::DOUBLE AS top_line_pct, count(*)::BIGINT AS n_lines
FROM (SELECT source_file, product_line, count(*) AS n, count(*) FILTER (WHERE trim(product_line) NOT IN ('', 'UNKNOWN')) AS l,
    count(*) FILTER (WHERE status = 'review') AS r, count(*) FILTER (WHERE status LIKE 'auto%') AS a FROM cascade GROUP BY ALL) t GROUP BY 1""")
def coverage_by_file(spark, sf_dir):
    return R.coverage(shared.cleaned(spark, sf_dir))


@query("consistency_check", ("rows_",), """SELECT hs_code, clean_text, count(*)::BIGINT AS n, min(class2) AS low, max(class2) AS high
FROM rows_ GROUP BY hs_code, clean_text HAVING count(DISTINCT class2) > 1""")
def consistency_check(spark, sf_dir):
    """The input labels are inconsistent on purpose; the cascade's own output has to have no row here (see tests)."""
    return R.inconsistent_inputs(views.rows(spark, sf_dir), ["hs_code", "clean_text"], "class2")


cte("jobs", (), """SELECT event_id AS job_id, user_id, ts AS created_at, value AS total_rows, event_id // 7 AS batch_id,
  CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'processing' ELSE 'done' END AS status FROM events""")


def jobs(spark, sf_dir):
    return views.table(spark, sf_dir, "events").selectExpr(
        "event_id AS job_id", "user_id", "ts AS created_at", "value AS total_rows", "event_id div 7 AS batch_id",
        "CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'processing' ELSE 'done' END AS status")


@query("usage_counts", ("jobs",), "SELECT user_id, count(*)::BIGINT AS usage_count FROM jobs GROUP BY 1")
def usage_counts(spark, sf_dir):
    return R.usage_counts(jobs(spark, sf_dir), "user_id")


@query("batch_progress", ("jobs",), """SELECT batch_id, n_jobs, n_done, n_error, n_running,
  (CASE WHEN share = 0 AND n_running > 0 THEN 30 WHEN share = 100 AND n_running > 0 THEN 99 ELSE share END)::INT AS progress
FROM (SELECT *, floor((n_done + n_error) * 100 / n_jobs) AS share FROM (
  SELECT batch_id, count(*)::BIGINT AS n_jobs, (count(*) FILTER (WHERE status = 'done'))::BIGINT AS n_done,
    (count(*) FILTER (WHERE status = 'error'))::BIGINT AS n_error, (count(*) FILTER (WHERE status = 'processing'))::BIGINT AS n_running
  FROM jobs GROUP BY 1) t) u""")
def batch_progress(spark, sf_dir):
    return R.batch_progress(jobs(spark, sf_dir))


@query("retention_top10", ("jobs",), """SELECT job_id, user_id FROM jobs
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, job_id DESC) <= 10""")
def retention_top10(spark, sf_dir):
    return R.keep_newest(jobs(spark, sf_dir), "user_id", "created_at", "job_id").select("job_id", "user_id")


@query("retention_children", ("jobs",), """SELECT job_id, usage FROM (SELECT job_id, unnest([1, 2]) AS usage FROM jobs) c
WHERE job_id IN (SELECT job_id FROM jobs QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, job_id DESC) <= 10)""")
def retention_children(spark, sf_dir):
    log = jobs(spark, sf_dir)
    usage = log.selectExpr("job_id", "explode(array(1, 2)) AS usage")
    return R.with_parents(usage, R.keep_newest(log, "user_id", "created_at", "job_id"), "job_id")


@query("page_rows", ("declarations",), "SELECT row_id, detailed_product_en FROM declarations ORDER BY row_id LIMIT 50 OFFSET 100")
def page_rows(spark, sf_dir):
    return R.page(views.goods(spark, sf_dir).select("row_id", "detailed_product_en"), "row_id", 100, 50)


@query("page_rows_deep", ("declarations",), """SELECT row_id, detailed_product_en FROM declarations
ORDER BY detailed_product_en NULLS FIRST, row_id LIMIT 50 OFFSET 1000""")
def page_rows_deep(spark, sf_dir):
    """A page far back, by text: only the range that holds it is sorted."""
    order = ["detailed_product_en", "row_id"]
    return R.deep_page(R.in_ranges(views.goods(spark, sf_dir).select("row_id", "detailed_product_en"), order), order, 1000, 50)


@query("spotcheck_sample", ("declarations",), """SELECT row_id, source_file FROM declarations
QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY md5(row_id || ':42'), row_id) <= 10""")
def spotcheck_sample(spark, sf_dir):
    return R.spot_check(views.goods(spark, sf_dir).select("row_id", "source_file"), "source_file", "row_id")


@query("spotcheck_by_status", ("cascade",), """SELECT row_id, status FROM cascade
QUALIFY row_number() OVER (PARTITION BY status ORDER BY md5(row_id || ':42'), row_id) <= CASE WHEN status = 'review' THEN 20 ELSE 10 END""")
def spotcheck_by_status(spark, sf_dir):
    """Rows by the source of their label, and more of those left for review."""
    return R.spot_check_strata(shared.cleaned(spark, sf_dir).select("row_id", "status"), "status", "row_id", {K.STATUS_REVIEW: 20})


@query("consistency_of_output", ("cascade",), """SELECT hs_code, clean_text, count(*)::BIGINT AS n, min(class2) AS low, max(class2) AS high
FROM cascade GROUP BY hs_code, clean_text HAVING count(DISTINCT class2) > 1""")
def consistency_of_output(spark, sf_dir):
    """The cascade gives one label per input: no row may show."""
    return R.inconsistent_inputs(shared.cleaned(spark, sf_dir), ["hs_code", "clean_text"], "class2")
