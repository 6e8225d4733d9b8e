"""Classifier, cascade and what surrounds them."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargoline import constants as K
from cargoline.functions import labels
from cargoline.operators import classifier, knowledge, match, nearest
from cargoline.operators import dictionary as D
from cargoline.operators import evaluate as E
from cargoline.plans import cascade, views
from cargoline.plans.shared import dictionary, dictionary_b, ground_truth, model
from cargoline.queries.oracle import LABEL4, bayes_ctes, cte, q, sql_label_part, sql_squeeze, weighted_ctes
from cargoline.queries.registry import query
from cargoline.session import scratch_path

L4 = ", ".join(K.LABEL_COLUMNS)


def labelled(gt):
    return gt.withColumn("label", labels.combine(*K.LABEL_COLUMNS))


def classified(spark, sf_dir):
    """All declarations through the cascade."""
    return cascade.classify(views.rows(spark, sf_dir), ground_truth(spark, sf_dir), dictionary(spark, sf_dir),
                            model(spark, sf_dir))


bayes_ctes("nb_docs", "corpus", "corpus")


@query("nb_train", ("corpus_nb_classes",), """SELECT hs_code, label, n_label, n_group, n_tokens, vocab
FROM corpus_nb_classes""")
def nb_train(spark, sf_dir):
    return classifier.train(views.corpus(spark, sf_dir)).classes


@query("nb_predict", ("nb_new",), "SELECT row_id, label, round(confidence, 6) AS confidence, n_labels FROM nb_new")
def nb_predict(spark, sf_dir):
    trained = model(spark, sf_dir)
    found = match.once_per_text(views.new_rows(spark, sf_dir),
                                lambda texts: classifier.predict(trained, texts).drop("hs_code"), ["hs_code", "clean_text"])
    return found.withColumn("confidence", F.round("confidence", 6))


cte("quality_train", (), f"""SELECT source AS hs_code, quality::VARCHAR AS label, {sql_squeeze('text')} AS clean_text,
  doc_id AS row_id FROM documents JOIN labels USING (doc_id)""")
cte("quality_rows", (), f"SELECT source AS hs_code, {sql_squeeze('text')} AS clean_text, doc_id AS row_id FROM documents")
bayes_ctes("nb_quality", "quality_train", "quality_rows")


@query("nb_predict_documents", ("nb_quality",),
       "SELECT row_id, label, round(confidence, 6) AS confidence, n_labels FROM nb_quality")
def nb_predict_documents(spark, sf_dir):
    """Learned from the documents with a label, applied to all documents."""
    from cargoline.functions import text
    docs = views.documents(spark, sf_dir).select("doc_id", F.col("source").alias("hs_code"), text.squeeze(F.col("text")).alias("clean_text"))
    known = docs.join(views.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("label")), "doc_id")
    found = classifier.predict(classifier.train(known.withColumnRenamed("doc_id", "row_id")), docs.withColumnRenamed("doc_id", "row_id"))
    return found.select("row_id", "label", F.round("confidence", 6).alias("confidence"), "n_labels")


@query("single_label_predict", ("rows_", "gt_train"), """SELECT r.row_id, s.label, 'auto_single' AS status FROM rows_ r JOIN (
  SELECT hs_code || source AS k, min(label) AS label FROM (SELECT hs_code, product_line AS label, source_file AS source FROM rows_) t
  GROUP BY 1 HAVING count(DISTINCT label) = 1) s ON s.k = r.hs_code || r.source_file""")
def single_label_predict(spark, sf_dir):
    rows = views.rows(spark, sf_dir).select("row_id", F.concat("hs_code", "source_file").alias("k"),
                                            F.col("product_line").alias("label"))
    single = classifier.single_labels(rows, "k").select("k", "label")
    return rows.drop("label").join(single, "k").select("row_id", "label", F.lit(K.STATUS_SINGLE).alias("status"))


@query("confidence_gate", ("nb_new",), """SELECT row_id, status,
  CASE WHEN status = 'auto_model' THEN printf('AI %.1f%%', round(confidence * 100, 6)) ELSE status END AS status_text
FROM (SELECT *, CASE WHEN n_labels = 1 THEN 'auto_single' WHEN confidence >= 0.85 THEN 'auto_model' ELSE 'review' END AS status
      FROM nb_new) t""")
def confidence_gate(spark, sf_dir):
    trained = model(spark, sf_dir)
    found = match.once_per_text(views.new_rows(spark, sf_dir),
                                lambda texts: classifier.predict(trained, texts).drop("hs_code"), ["hs_code", "clean_text"])
    return classifier.gate(found.withColumn("confidence", F.round("confidence", 8))).select("row_id", "status", "status_text")


@query("label_encode", ("rows_",), f"""SELECT label, row_number() OVER (ORDER BY label) - 1 AS code
FROM (SELECT DISTINCT {LABEL4} AS label FROM rows_) t""")
def label_encode(spark, sf_dir):
    return classifier.encode_labels(labelled(views.rows(spark, sf_dir)))


cte("level_train", ("ground_truth",), " UNION ALL ".join(
    f"SELECT hs_code, {q(c)} AS level, {c} AS label, clean_text FROM ground_truth" for c in K.LABEL_COLUMNS))
cte("level_rows", ("new_rows",), " UNION ALL ".join(
    f"SELECT row_id || '/' || {q(c)} AS row_id, hs_code, {q(c)} AS level, clean_text FROM new_rows" for c in K.LABEL_COLUMNS))
bayes_ctes("nb_levels", "level_train", "level_rows", ("hs_code", "level"))


@query("multilevel_predict", ("nb_levels",), """SELECT string_split(row_id, '/')[1]::BIGINT AS row_id, """ + ", ".join(
    f"max(label) FILTER (WHERE string_split(row_id, '/')[2] = '{c}') AS {c}" for c in K.LABEL_COLUMNS) + """,
  round(exp(sum(ln(confidence))), 6) AS joint_confidence FROM nb_levels GROUP BY 1""")
def multilevel_predict(spark, sf_dir):
    trained = classifier.train(classifier.by_level(ground_truth(spark, sf_dir)), ["hs_code", "level"])
    found = match.once_per_text(views.new_rows(spark, sf_dir), lambda texts: classifier.predict_levels(trained, texts),
                                ["hs_code", "clean_text"])
    return found.withColumn("joint_confidence", F.round("joint_confidence", 6))


@query("hash_split", (), """SELECT doc_id, CASE WHEN p < 80 THEN 'train' WHEN p < 90 THEN 'validation' ELSE 'test' END AS part
FROM (SELECT doc_id, ('0x' || md5(doc_id || ':42')[1:8])::BIGINT % 100 AS p FROM documents) t""")
def hash_split(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select("doc_id")
    return classifier.split_rows(docs, "doc_id")


#: Unit vectors in double precision.
_UNIT = """SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e FROM embeddings"""


@query("semantic_dedup", (), f"""WITH v AS (SELECT *, round((vec_id * 37 % 101) / 100.0, 2)::DOUBLE AS confidence FROM ({_UNIT}))
SELECT vec_id, label, confidence FROM v a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE b.label = a.label AND
  (b.confidence > a.confidence OR (b.confidence = a.confidence AND b.vec_id < a.vec_id))
  AND list_dot_product(a.e, b.e) > 0.85)""")
def semantic_dedup(spark, sf_dir):
    v = views.table(spark, sf_dir, "embeddings").withColumn(
        "confidence", F.round((F.col("vec_id") * 37 % 101) / 100.0, 2))
    return classifier.above_all(v, "label")


@query("match_semantic", (), f"""WITH v AS ({_UNIT}), entries AS (SELECT min(vec_id) AS entry_id, e FROM v WHERE vec_id IN (SELECT min(vec_id) FROM v GROUP BY label) GROUP BY e),
found AS (SELECT a.vec_id AS row_id, min((-list_dot_product(a.e, b.e), b.entry_id)) AS s FROM v a JOIN entries b ON list_dot_product(a.e, b.e) >= 0.55 GROUP BY 1)
SELECT v.vec_id AS row_id, s[2] AS entry_id, round(-s[1], 6) AS cosine FROM v LEFT JOIN found ON row_id = vec_id""")
def match_semantic(spark, sf_dir):
    """Every vector against one entry per class; a row without an entry at 0.55 stays open."""
    rows = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding", "label")
    entries = rows.groupBy("label").agg(F.min_by(F.struct("row_id", "embedding"), "row_id").alias("s")).select(F.col("s.row_id").alias("entry_id"), "s.embedding")
    found = nearest.nearest(rows, entries, 0.55)
    return rows.select("row_id").join(found, "row_id", "left").select("row_id", "entry_id", F.round("cosine", 6).alias("cosine"))


def _clusters_sql(min_cosine, min_samples):
    return f"""WITH RECURSIVE v AS ({_UNIT}),
near AS (SELECT a.vec_id AS i, b.vec_id AS j FROM v a JOIN v b ON list_dot_product(a.e, b.e) >= {min_cosine} OR a.e = b.e),
density AS (SELECT i, count(*) AS n_near, count(*) >= {min_samples} AS core FROM near GROUP BY i),
links AS (SELECT i, j FROM near WHERE i IN (SELECT i FROM density WHERE core) AND j IN (SELECT i FROM density WHERE core)),
reach AS (SELECT i, i AS r FROM density WHERE core UNION SELECT reach.i, links.j FROM reach JOIN links ON reach.r = links.i),
named AS (SELECT i, min(r) AS cluster FROM reach GROUP BY i),
edge AS (SELECT n.i, min(n.j) AS c FROM near n JOIN named ON named.i = n.j GROUP BY n.i)
SELECT d.i AS vec_id, n_near, core, coalesce(named.cluster, e.cluster) AS cluster FROM density d LEFT JOIN named USING (i)
LEFT JOIN (SELECT edge.i, named.cluster FROM edge JOIN named ON named.i = edge.c) e USING (i)"""


@query("cluster_descriptions", (), _clusters_sql(0.35, 5))
def cluster_descriptions(spark, sf_dir):
    """Density clusters of all vectors: cosine distance 0.65, five neighbours."""
    return nearest.density_clusters(views.table(spark, sf_dir, "embeddings"), min_cosine=0.35, min_samples=5)


def _synthetic(spark, sf_dir):
    gt = ground_truth(spark, sf_dir)
    return classifier.synthetic_rows(dictionary(spark, sf_dir), knowledge.label_mapping(gt)), gt


_NORM = {c: sql_label_part(c, c) for c in K.LABEL_COLUMNS}
cte("synthetic", ("dictionary", "ground_truth"), f"""
SELECT text, {L4}, {LABEL4} AS label, weight, entry_id FROM (
  SELECT entry_id, {sql_squeeze("'Hãng: không_có - Sản phẩm: ' || keyword")} AS text, {sql_label_part('pl', 'product_line')} AS product_line,
    {_NORM['kind']} AS kind, {_NORM['class1']} AS class1, {_NORM['class2']} AS class2, ln(1 + n_products) AS weight
  FROM (SELECT d.*, unnest(keywords) AS keyword, CASE WHEN m.share >= 0.8 THEN m.top ELSE product_line END AS pl
    FROM dictionary d LEFT JOIN (
      SELECT hs_code, arg_max(product_line, (n, product_line)) AS top, round(max(n) / sum(n), 4) AS share
      FROM (SELECT hs_code, product_line, count(*) AS n FROM ground_truth GROUP BY ALL) x GROUP BY hs_code) m USING (hs_code)) t
  WHERE len(string_split(trim(keyword), ' ')) >= 2) u""")


@query("synthetic_train", ("synthetic",), "SELECT text, label, round(weight, 6) AS weight, entry_id FROM synthetic")
def synthetic_train(spark, sf_dir):
    rows, _ = _synthetic(spark, sf_dir)
    return rows.select("text", "label", F.round("weight", 6).alias("weight"), "entry_id")


@query("priority_union", ("synthetic", "ground_truth"), f"""
SELECT text, priority, label, round(weight, 6) AS weight FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY priority, label, weight) AS rn FROM (
    SELECT {sql_squeeze("'Sản phẩm: ' || clean_text")} AS text, 0 AS priority, {LABEL4} AS label, 1.0 AS weight FROM ground_truth
    UNION ALL SELECT text, 1, label, weight FROM synthetic) t) u WHERE rn = 1""")
def priority_union(spark, sf_dir):
    from cargoline.functions import text
    synthetic, gt = _synthetic(spark, sf_dir)
    original = gt.select(text.squeeze(F.concat(F.lit("Sản phẩm: "), "clean_text")).alias("text"),
                         labels.combine(*K.LABEL_COLUMNS).alias("label"), F.lit(1.0).alias("weight"))
    union = D.union_by_priority([original, synthetic.select("text", "label", "weight")], "text")
    return union.withColumn("weight", F.round("weight", 6))


@query("classify_cascade", ("cascade",), f"SELECT row_id, {L4}, status, round(confidence, 6) AS confidence FROM cascade")
def classify_cascade(spark, sf_dir):
    out = classified(spark, sf_dir)
    return out.select("row_id", *K.LABEL_COLUMNS, "status", F.round("confidence", 6).alias("confidence"))


@query("classify_cascade_edges", ("cascade",), f"""SELECT 1 AS row_id, {L4}, status, round(confidence, 6) AS confidence FROM cascade
UNION ALL SELECT row_id, '', '', '', '', 'review', NULL FROM cascade""")
def classify_cascade_edges(spark, sf_dir):
    """All declarations under one and the same row id, and all of them once more without code and text."""
    rows = views.rows(spark, sf_dir).select("row_id", "hs_code", "clean_text")
    nothing = rows.select("row_id", F.lit(None).cast("string").alias("hs_code"), F.lit(None).cast("string").alias("clean_text"))
    both = rows.withColumn("row_id", F.lit(1).cast(rows.schema["row_id"].dataType)).unionByName(nothing)
    out = cascade.classify(both, ground_truth(spark, sf_dir), dictionary(spark, sf_dir), model(spark, sf_dir))
    return out.select("row_id", *K.LABEL_COLUMNS, "status", F.round(F.when(F.col("clean_text").isNotNull(), F.col("confidence")), 6).alias("confidence"))


cte("feature_rows", ("rows_",), "SELECT row_id, hs_code, feature AS clean_text, brand, power FROM (" + f"""
SELECT row_id, hs_code, b AS brand, p AS power,
  {sql_squeeze("'Hãng: ' || b || ' - Công suất: ' || p || ' - Sản phẩm: ' || l")} AS feature
FROM (SELECT *, coalesce({', '.join(f"CASE WHEN contains(lower(l), {q(x)}) THEN {q(x[:1].upper() + x[1:])} END" for x in K.BRANDS)}, '') AS b,
        trim(regexp_extract(lower(l), '(\\d+(?:\\.\\d+)?)\\s*(w|watt|hp|kw|kva|v)', 0)) AS p
      FROM (SELECT row_id, hs_code, CASE WHEN contains(product_name, '#&') THEN list_reduce(list_filter(list_transform(
          string_split(product_name, '#&'), lambda x: trim(x)), lambda x: x <> ''),
          lambda x, y: CASE WHEN length(y) > length(x) THEN y ELSE x END) ELSE product_name END AS l FROM rows_) t) u) v""")
weighted_ctes("worker", "feature_rows", "dictionary_b", use_hs=True)


@query("classify_weighted", ("worker", "feature_rows"), """SELECT f.row_id, brand, power, f.clean_text AS feature, label_text, score,
  confidence, status FROM feature_rows f JOIN worker USING (row_id)""")
def classify_weighted(spark, sf_dir):
    return cascade.classify_weighted(views.rows(spark, sf_dir), dictionary_b(spark, sf_dir))


@query("eval_ground_truth", ("cascade", "history"), """
SELECT count(*)::BIGINT AS matched, count(*) FILTER (WHERE l)::BIGINT AS line_correct, count(*) FILTER (WHERE k)::BIGINT AS kind_correct,
  count(*) FILTER (WHERE c)::BIGINT AS class1_correct, count(*) FILTER (WHERE l AND k AND c)::BIGINT AS all_correct
FROM (SELECT p.product_line = t.product_line AS l, p.kind = t.kind AS k, p.class1 = t.class1 AS c
  FROM cascade p JOIN (SELECT * FROM history QUALIFY row_number() OVER (PARTITION BY hs_code, clean_text ORDER BY row_id DESC) = 1) t
  USING (hs_code, clean_text)) x""")
def eval_ground_truth(spark, sf_dir):
    return E.ground_truth_check(classified(spark, sf_dir), views.history(spark, sf_dir))


@query("knowledge_refresh", ("ground_truth", "dictionary", "gt_train_nb_classes"), """
SELECT hs_code, n_truth, n_entries, n_classes FROM
  (SELECT hs_code, count(*)::BIGINT AS n_truth FROM ground_truth GROUP BY 1) a
  JOIN (SELECT hs_code, count(*)::BIGINT AS n_entries FROM dictionary GROUP BY 1) b USING (hs_code)
  JOIN (SELECT hs_code, count(*)::BIGINT AS n_classes FROM gt_train_nb_classes GROUP BY 1) c USING (hs_code)""")
def knowledge_refresh(spark, sf_dir):
    from cargoline.plans.refresh import refresh
    known = refresh(views.history(spark, sf_dir))
    n = lambda df, name: df.groupBy("hs_code").agg(F.count("*").alias(name))
    return n(known.ground_truth, "n_truth").join(n(known.dictionary, "n_entries"), "hs_code").join(
        n(known.model.classes, "n_classes"), "hs_code")


@query("classify_from_saved_knowledge", ("cascade",), f"SELECT row_id, {L4}, status, round(confidence, 6) AS confidence FROM cascade")
def classify_from_saved_knowledge(spark, sf_dir):
    """Knowledge refreshed, saved in the shared folder and loaded again classifies like the knowledge in memory."""
    from cargoline.plans.refresh import load, refresh, save
    from cargoline.session import scratch_path
    base = scratch_path(spark, "knowledge")
    save(refresh(views.history(spark, sf_dir)), base)
    known = load(spark, base)
    out = cascade.classify(views.rows(spark, sf_dir), known.ground_truth, known.dictionary, known.model)
    return out.select("row_id", *K.LABEL_COLUMNS, "status", F.round("confidence", 6).alias("confidence"))


@query("label_support", ("rows_",), f"""SELECT label, count(*)::BIGINT AS n FROM (
  SELECT {LABEL4} AS label FROM rows_) t GROUP BY 1 HAVING count(*) >= 5""")
def label_support(spark, sf_dir):
    kept = classifier.supported_labels(labelled(views.rows(spark, sf_dir)))
    return kept.groupBy("label").agg(F.count("*").alias("n"))


#: How sharply the probabilities of the nearest-centroid model follow its cosines.
_SHARPNESS = 20.0


@query("classify_with_model", (), f"""WITH c AS (SELECT label, list(m ORDER BY pos) AS m FROM (SELECT label, pos, avg(x) AS m FROM (
    SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings WHERE label IS NOT NULL) GROUP BY ALL) GROUP BY label),
s AS (SELECT vec_id, c.label, {_SHARPNESS} * list_cosine_similarity(embedding::DOUBLE[], m) AS s FROM embeddings, c),
b AS (SELECT vec_id, min((-s, label)) AS best, max(s) AS top, count(*)::INT AS n_labels FROM s GROUP BY vec_id),
p AS (SELECT vec_id, any_value(best[2])::VARCHAR AS label, 1 / sum(exp(s - top)) AS confidence, any_value(n_labels) AS n_labels FROM s JOIN b USING (vec_id) GROUP BY vec_id)
SELECT vec_id, label, round(confidence, 6) AS confidence, n_labels, CASE WHEN n_labels = 1 THEN 'auto_single' WHEN confidence >= 0.85 THEN 'auto_model' ELSE 'review' END AS status FROM p""")
def classify_with_model(spark, sf_dir):
    """A nearest-centroid model, one vector per label, fitted here, saved, and applied to all vectors as a user's model."""
    from cargoline.operators.custom import classify_with_model as apply

    vectors = views.table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    parts = vectors.where("label IS NOT NULL").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    path = scratch_path(spark, "centroids")
    means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda e: e.m).alias("m")).write.parquet(path)
    sharpness = _SHARPNESS

    def load(folder):
        import numpy as np
        import pyarrow.parquet as pq
        from pyarrow import fs

        place, inner = fs.FileSystem.from_uri(folder)
        saved = pq.read_table(inner, filesystem=place).sort_by("label").to_pydict()
        centres = np.array(saved["m"], dtype=float)
        centres /= np.linalg.norm(centres, axis=1, keepdims=True)

        def answer(batch):
            v = np.array(batch["embedding"].tolist(), dtype=float)
            scores = sharpness * (v @ centres.T) / np.linalg.norm(v, axis=1, keepdims=True)
            shares = np.exp(scores - scores.max(axis=1, keepdims=True))
            return [str(saved["label"][k]) for k in scores.argmax(axis=1)], 1 / shares.sum(axis=1), [len(centres)] * len(v)

        return answer

    found = apply(vectors.select("vec_id", "embedding"), load, path, key="vec_id")
    return found.select("vec_id", "label", F.round("confidence", 6).alias("confidence"), "n_labels", "status")
