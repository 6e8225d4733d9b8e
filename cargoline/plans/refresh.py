"""Knowledge refresh: ground truth, dictionary and classifier from labelled rows, in one application."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargoline import constants as K
from cargoline.functions import labels
from cargoline.operators import classifier, dictionary, knowledge
from cargoline.session import materialize


@dataclass(frozen=True)
class Knowledge:
    ground_truth: DataFrame
    dictionary: DataFrame
    model: classifier.BayesModel


def refresh(rows: DataFrame) -> Knowledge:
    """Each step reads the written table of the one before; a failing step raises and later ones do not run."""
    truth = materialize(knowledge.build_ground_truth(rows), "ground_truth")
    entries = materialize(dictionary.build_dictionary(truth), "dictionary")
    labelled = truth.withColumn("label", labels.combine(*[F.col(c) for c in K.LABEL_COLUMNS]))
    return Knowledge(truth, entries, classifier.train(labelled))


def save(known: Knowledge, base: str) -> str:
    """Write the knowledge as a new version below ``base`` and make it the current one; the version's name.

    The tables are written first, then a pointer to them is put in place by one rename: a reader sees the old version or the new one,
    and a run that is cut off leaves the old one in place.
    """
    spark = known.ground_truth.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    tables = {"ground_truth": known.ground_truth, "dictionary": known.dictionary, "bayes_grams": known.model.grams, "bayes_classes": known.model.classes}
    for name, table in tables.items():
        table.write.parquet(f"{base}/{version}/{name}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    draft, place = (jvm.org.apache.hadoop.fs.Path(f"{base}/{n}") for n in (f"{version}/pointer", "current"))
    files = draft.getFileSystem(conf)
    out = files.create(draft, True)
    out.write(bytearray(json.dumps({"version": version, "group": known.model.group}).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(context.makeQualified(draft), context.makeQualified(place), options)
    return version


def load(spark: SparkSession, base: str) -> Knowledge:
    """The current version of the knowledge below ``base``."""
    pointer = json.loads("".join(r.value for r in spark.read.text(f"{base}/current").collect()))  # one short line
    table = lambda name: spark.read.parquet(f"{base}/{pointer['version']}/{name}")
    return Knowledge(table("ground_truth"), table("dictionary"),
                     classifier.BayesModel(tuple(pointer["group"]), table("bayes_grams"), table("bayes_classes")))
