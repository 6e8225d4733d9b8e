"""Measures of the classification: accuracy, confusion, calibration, agreement and what follows from them.

The evaluation table has ``row_id, hs_code, product_name``, the four true label parts, and predictions as combined
labels: ``dict_label``, ``dict_b_label``, ``ai_label`` with ``ai_confidence`` (0-100) and ``predicted_label``.
All measures are aggregates with partial aggregation on low-cardinality keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargoline import constants as K
from cargoline.functions import labels, text


def _share(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.coalesce(F.round(F.try_divide(part, whole), digits), F.lit(0.0))


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def truth() -> Column:
    return labels.normalize_columns()


def is_right(prediction: str) -> Column:
    """The prediction exists and all its canonical parts equal the true ones."""
    return F.coalesce(F.col(prediction).isNotNull() & (labels.normalize_combined(F.col(prediction)) == F.col("truth")),
                      F.lit(False))


def accuracy(evaluation: DataFrame, prediction: str = "predicted_label", weight: Column | None = None) -> DataFrame:
    """Right rows, rows and accuracy per label level and for all levels together; with ``weight``, sums of weights."""
    one = F.lit(1) if weight is None else weight
    part = lambda i, level: labels.normalize_part(
        labels.split_part(F.when(F.trim(F.coalesce(prediction, F.lit(""))) != "", F.col(prediction)), i), level)
    flags = evaluation.select(one.alias("w"), *[
        (labels.normalize_part(F.col(level), level) == part(i, level)).alias(level)
        for i, level in enumerate(K.LABEL_COLUMNS)])
    every = F.col(K.LABEL_COLUMNS[0])
    for level in K.LABEL_COLUMNS[1:]:
        every = every & F.col(level)
    flags = flags.withColumn("combined", every)
    levels = [*K.LABEL_COLUMNS, "combined"]
    sums = flags.agg(F.sum("w").alias("total"), *[F.sum(F.when(F.col(c), F.col("w")).otherwise(0)).alias(c) for c in levels])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).alias("correct")) for c in levels]))
    return sums.select(rows.alias("r"), "total").select("r.level", "r.correct", "total",
                                                        _share(F.col("r.correct"), F.col("total")).alias("accuracy"))


def confusion(evaluation: DataFrame, prediction: str = "predicted_label") -> DataFrame:
    """Rows per pair of true and predicted canonical label."""
    return evaluation.select(truth().alias("truth"), labels.normalize_combined(F.col(prediction)).alias("predicted")).groupBy(
        "truth", "predicted").agg(F.count("*").alias("n"))


def confused_pairs(pairs: DataFrame, limit: int = 10) -> DataFrame:
    return pairs.where("truth <> predicted").orderBy(F.desc("n"), "truth", "predicted").limit(limit)


def confused_classes(pairs: DataFrame, limit: int = 20) -> DataFrame:
    """Labels by their errors as truth plus their errors as prediction."""
    sides = F.explode(F.array(F.col("truth"), F.col("predicted"))).alias("label")
    errors = pairs.where("truth <> predicted").select(sides, "n").groupBy("label").agg(F.sum("n").alias("n_errors"))
    return errors.orderBy(F.desc("n_errors"), "label").limit(limit)


def labels_on_both_sides(pairs: DataFrame) -> DataFrame:
    """Labels that occur as truth and as prediction."""
    return pairs.select(F.col("truth").alias("label")).intersect(pairs.select(F.col("predicted").alias("label")))


def confusion_submatrix(pairs: DataFrame, limit: int = 20) -> DataFrame:
    """Confusion counts among the most confused labels that occur on both sides."""
    top = confused_classes(pairs, limit).select("label").join(labels_on_both_sides(pairs), "label", "left_semi")
    return (pairs.join(top.withColumnRenamed("label", "truth"), "truth", "left_semi")
            .join(top.withColumnRenamed("label", "predicted"), "predicted", "left_semi"))


def dictionary_versus_model(evaluation: DataFrame, dict_label: str = "dict_label",
                            model_label: str = "ai_label") -> DataFrame:
    """Coverage and accuracy of the dictionary, accuracy of the model, and which of the two is right, in one pass."""
    flags = evaluation.withColumn("truth", truth()).select(
        F.col(dict_label).isNotNull().alias("handled"), is_right(dict_label).alias("d"), is_right(model_label).alias("m"))
    sums = flags.agg(F.count("*").alias("total_rows"), _count(F.col("handled")).alias("dict_handled_rows"),
                     _count(F.col("d")).alias("dict_correct"), _count(F.col("m")).alias("ai_correct"),
                     _count(F.col("d") & F.col("m")).alias("both_correct"),
                     _count(~F.col("d") & ~F.col("m")).alias("both_wrong"),
                     _count(F.col("d") & ~F.col("m")).alias("dict_only_correct"),
                     _count(~F.col("d") & F.col("m")).alias("ai_only_correct"))
    percent = lambda a, b: _share(F.col(a) * 100.0, F.col(b), 2)
    return sums.select("*", percent("dict_handled_rows", "total_rows").alias("dict_coverage_pct"),
                       percent("dict_correct", "dict_handled_rows").alias("dict_accuracy"),
                       percent("ai_correct", "total_rows").alias("ai_accuracy"))


def calibration(evaluation: DataFrame, prediction: str = "ai_label", confidence: str = "ai_confidence",
                edges: Sequence[float] = K.CALIBRATION_EDGES) -> DataFrame:
    """Rows, accuracy and mean confidence per confidence bin; bins are half-open, the last one takes all above its edge.

    Empty bins are rows too.
    """
    spark = evaluation.sparkSession
    last = len(edges) - 2
    share = F.col(confidence) / 100
    bin_no = F.lit(None).cast("int")
    for i in range(last + 1):
        inside = share >= edges[i] if i == last else (share >= edges[i]) & (share < edges[i + 1])
        bin_no = F.coalesce(bin_no, F.when(inside, F.lit(i)))
    counts = evaluation.withColumn("truth", truth()).select(bin_no.alias("bin"), is_right(prediction).alias("right"),
                                                             F.col(confidence).alias("c")).groupBy("bin").agg(
        F.count("*").alias("n"), _count(F.col("right")).alias("n_right"), F.avg("c").alias("mean"))
    bins = spark.createDataFrame([(i, float(edges[i]), float(edges[i + 1])) for i in range(last + 1)],
                                 "bin int, low double, high double")
    return bins.join(counts, "bin", "left").select(
        "bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"), _share(F.col("n_right"), F.col("n")).alias("accuracy"),
        F.coalesce(F.round(F.col("mean") / 100, 4), F.lit(0.0)).alias("mean_confidence"))


def calibration_thresholds(bins: DataFrame, tolerance: float = 0.9) -> DataFrame:
    """Last of the leading bins whose accuracy keeps up with the confidence, and the bin of best accuracy.

    Works on the calibration table, which has one row per bin.
    """
    ok = (F.col("accuracy") > 0) & (F.col("accuracy") >= F.col("mean_confidence") * tolerance)
    leading = F.min(F.when(ok, 1).otherwise(0)).over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    marked = bins.withColumn("leading", leading)
    return marked.agg(F.max(F.when(F.col("leading") == 1, F.col("bin"))).alias("optimal_bin"),
                      F.max_by("bin", F.struct("accuracy", -F.col("bin"))).alias("best_bin"),
                      F.max("accuracy").alias("best_accuracy"))


# fixed values: name and action of each three-way pattern, tested in this order
THREE_WAY = [
    ((True, True, False), "dicts_right_model_wrong", "add_to_training"),
    ((True, False, False), "first_dict_right_only", "promote_first_dict"),
    ((False, False, True), "model_right_only", "fix_first_dict"),
    ((False, False, False), "all_wrong", "manual_review"),
    ((True, False, True), "second_dict_wrong_only", "replace_second_dict"),
]


def three_way(evaluation: DataFrame, first: str = "dict_label", second: str = "dict_b_label",
              model: str = "ai_label") -> DataFrame:
    """Agreement pattern and proposed action per row, from which of two dictionaries and the model are right."""
    rows = evaluation.withColumn("truth", truth()).withColumns(
        {"first_right": is_right(first), "second_right": is_right(second), "model_right": is_right(model)})
    pattern, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for (a, b, c), name, todo in THREE_WAY:
        hit = ((F.col("first_right") == a) & (F.col("second_right") == b) & (F.col("model_right") == c))
        pattern, action = F.coalesce(pattern, F.when(hit, name)), F.coalesce(action, F.when(hit, todo))
    return rows.withColumns({"pattern": F.coalesce(pattern, F.lit("other")), "action": F.coalesce(action, F.lit("none"))})


def disagreeing(patterns: DataFrame) -> DataFrame:
    """Rows of the three-way table on which anything differs or is wrong."""
    first, second, model = [F.coalesce(c, F.lit("")) for c in ("dict_label", "dict_b_label", "ai_label")]
    wrong = ~(F.col("first_right") & F.col("second_right") & F.col("model_right"))
    return patterns.where(wrong | (first != second) | (first != model))


def dictionary_fixes(patterns: DataFrame) -> DataFrame:
    """Rows where only the model is right: the first dictionary's keyword needs work."""
    return patterns.where("pattern = 'model_right_only'").select(
        "row_id", "hs_code", "product_name", F.coalesce("dict_label", F.lit("Unknown")).alias("matched_label"),
        F.col("truth").alias("correct_label"))


def hard_cases(patterns: DataFrame) -> DataFrame:
    return patterns.where("pattern = 'all_wrong'")


def disagreements(evaluation: DataFrame, dict_label: str = "dict_label", ai_label: str = "ai_label",
                  confidence: str = "ai_confidence", truth_label: str = "true_label",
                  conflict_first: bool = True) -> DataFrame:
    """Dictionary against model: verified, dict_fail_ai_pass, dict_pass_ai_fail, both_fail or conflict.

    Without a true label a prediction counts as right. ``conflict_first`` reports differing labels without truth as a
    conflict; otherwise they count as verified. ``confidence`` is a share of 1.
    """
    canonical = lambda c: F.when(F.col(c).isNotNull(), labels.normalize_combined(F.col(c)))
    known_truth = F.when(F.coalesce(F.col(truth_label), F.lit("")) != "", labels.normalize_combined(F.col(truth_label)))
    rows = evaluation.select("row_id", F.substring("product_name", 1, 200).alias("product"), F.col("product_name").alias("whole_text"), "hs_code",
                             canonical(dict_label).alias("dict_norm"), canonical(ai_label).alias("ai_norm"),
                             known_truth.alias("truth"), F.col(confidence).alias("ai_confidence"))
    d, m, t = F.col("dict_norm"), F.col("ai_norm"), F.col("truth")
    d_ok = d.isNotNull() & (t.isNull() | (d == t))
    m_ok = m.isNotNull() & (t.isNull() | (m == t))
    conflict = F.coalesce(t.isNull() & (d != m), F.lit(False))
    ladder = F.when(F.lit(conflict_first) & conflict, "conflict").when(d_ok & m_ok, "verified").when(
        ~d_ok & m_ok & t.isNotNull(), "dict_fail_ai_pass").when(d_ok & ~m_ok & t.isNotNull(), "dict_pass_ai_fail").when(
        ~d_ok & ~m_ok & t.isNotNull(), "both_fail").when(conflict, "conflict").otherwise("verified")
    return rows.withColumn("pattern", ladder)


def proposals(disagreement: DataFrame, min_confidence: float = 0.8) -> DataFrame:
    """Dictionary additions: rows the dictionary missed and a confident model got right, with the label in columns."""
    from cargoline.functions import codes

    parts = [labels.split_part(F.col("ai_norm"), i).alias(f"suggested_{c}") for i, c in enumerate(K.LABEL_COLUMNS)]
    return disagreement.where((F.col("pattern") == "dict_fail_ai_pass") & (F.col("ai_confidence") >= min_confidence)).select(
        "row_id", "product", "hs_code", F.substring(codes.hs_digits(F.col("hs_code")), 1, 4).alias("hs_prefix"),
        *parts, "ai_confidence")


def retraining_rows(disagreement: DataFrame, min_confidence: float = 0.75) -> DataFrame:
    """Training rows from disagreements: the side that was right, the text and its variants, variants at half weight."""
    model_right = (F.col("pattern") == "dict_fail_ai_pass") & (F.col("ai_confidence") >= min_confidence)
    dict_right = F.col("pattern") == "dict_pass_ai_fail"
    picked = disagreement.where(model_right | dict_right).select(
        "row_id", "hs_code", "whole_text",
        F.when(model_right, F.col("ai_norm")).otherwise(F.col("dict_norm")).alias("label"),
        F.when(model_right, F.col("ai_confidence")).otherwise(F.lit(1.0)).alias("confidence"),
        F.when(model_right, F.lit("model_right")).otherwise(F.lit("dict_right")).alias("source"))
    complete = picked.where((labels.split_part(F.col("label"), 0) != K.NO_LABEL)
                            & (labels.split_part(F.col("label"), 1) != K.NO_LABEL))
    texts = F.posexplode(F.concat(F.array("whole_text"), text.text_variants(F.col("whole_text")))).alias("variant", "text")
    parts = [labels.split_part(F.col("label"), i).alias(c) for i, c in enumerate(K.LABEL_COLUMNS)]
    return complete.select("row_id", "hs_code", "label", "confidence", "source", texts).select(
        "row_id", "variant", F.concat(F.lit("san pham: "), F.col("text")).alias("text"), *parts, "label", "hs_code",
        F.round(F.col("confidence") * F.when(F.col("variant") == 0, 1.0).otherwise(0.5), 2).alias("weight"),
        F.when(F.col("variant") == 0, F.col("source")).otherwise(F.concat("source", F.lit("_variant"))).alias("source"))


def class_accuracy(evaluation: DataFrame, prediction: str = "predicted_label", limit: int = 10) -> DataFrame:
    """Right and wrong rows of the most frequent true labels."""
    rows = evaluation.withColumn("truth", truth()).select("truth", is_right(prediction).alias("right"))
    return rows.groupBy("truth").agg(F.count("*").alias("n"), _count(F.col("right")).alias("n_right"),
                                     _count(~F.col("right")).alias("n_wrong")).orderBy(F.desc("n"), "truth").limit(limit)


def ground_truth_check(predicted: DataFrame, truth_rows: DataFrame) -> DataFrame:
    """Accuracy of predicted rows against labelled rows on (code, text); of several labelled rows the last one counts."""
    keys = ["hs_code", "clean_text"]
    last = truth_rows.groupBy(*keys).agg(F.max(F.struct("row_id", *K.LABEL_COLUMNS)).alias("t"))
    # predictions per key and label, folded before the join, so a frequent text is one row here
    grouped = predicted.groupBy(*keys, *K.LABEL_COLUMNS).agg(F.count("*").alias("n"))
    same = [(F.trim(c) == F.trim(F.col(f"t.{c}"))).alias(f"{c}_ok") for c in K.LABEL_COLUMNS[:3]]
    flags = grouped.join(last, keys).select("n", *same)
    oks = [F.col(f"{c}_ok") for c in K.LABEL_COLUMNS[:3]]
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return flags.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("matched"), total(oks[0]).alias("line_correct"),
                     total(oks[1]).alias("kind_correct"), total(oks[2]).alias("class1_correct"),
                     total(oks[0] & oks[1] & oks[2]).alias("all_correct"))
