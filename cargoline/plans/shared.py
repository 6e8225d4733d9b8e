"""Knowledge tables that several queries read: written once per application and input, then shared.

Only inputs of queries are shared (ground truth, dictionaries, the classifier, the evaluation table), as a deployment
would keep them as tables; no query's own result is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargoline import constants as K
from cargoline.functions import codes, labels, text
from cargoline.operators import classifier
from cargoline.operators import dictionary as D
from cargoline.operators import knowledge
from cargoline.plans import views
from cargoline.session import materialize

_built: dict[tuple[str, str, str], object] = {}


def once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], object]):
    session = f"{spark.sparkContext.applicationId}/{spark._jsparkSession.hashCode()}"
    key = (session, sf_dir, name)
    if key not in _built:
        _built[key] = build()
    return _built[key]


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "ground_truth", lambda: materialize(
        knowledge.build_ground_truth(views.history(spark, sf_dir)), "ground_truth"))


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF dictionary of the labelled history."""
    return once(spark, sf_dir, "dictionary", lambda: materialize(
        D.build_dictionary(ground_truth(spark, sf_dir)), "dictionary"))


def dictionary_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purity dictionary of the labelled history."""
    return once(spark, sf_dir, "dictionary_b", lambda: materialize(
        D.build_labelled_dictionary(views.history(spark, sf_dir)), "dictionary_b"))


def model(spark: SparkSession, sf_dir: str) -> classifier.BayesModel:
    return once(spark, sf_dir, "model", lambda: classifier.train(
        ground_truth(spark, sf_dir).withColumn("label", labels.combine(*K.LABEL_COLUMNS))))


def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cargoline.plans import evaluation as plan

    return once(spark, sf_dir, "evaluation", lambda: materialize(plan.evaluation(
        views.new_rows(spark, sf_dir), dictionary(spark, sf_dir), dictionary_b(spark, sf_dir), model(spark, sf_dir)),
        "evaluation"))


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified declarations with brand, the input of the reports on status."""
    from cargoline.plans import cascade

    def build() -> DataFrame:
        out = cascade.classify(views.rows(spark, sf_dir).select("row_id", "hs_code", "clean_text", "product_name", "source_file"),
                               ground_truth(spark, sf_dir), dictionary(spark, sf_dir), model(spark, sf_dir))
        return materialize(out.withColumn("brand", text.brand(F.col("product_name"))), "cleaned")

    return once(spark, sf_dir, "cleaned", build)


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations with parsed amounts, parties and direction; one source file holds exports."""
    d = views.declarations(spark, sf_dir)
    return d.select("row_id", codes.hs_plain(F.col("hs_code")).alias("hs_code"), "product_line", "kind", "class1", "source_file",
                    F.col("vn_importer").alias("importer"), F.col("foreign_exporter").alias("exporter"),
                    F.when(F.col("source_file") == "file_3", "export").otherwise("import").alias("trade_direction"),
                    codes.parse_number(F.col("quantity")).alias("quantity"),
                    codes.parse_number(F.col("total_value_usd")).alias("total_value_usd"))
