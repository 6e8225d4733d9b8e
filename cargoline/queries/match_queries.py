"""Knowledge and dictionary matching over declarations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cargoline import constants as K
from cargoline.functions import text
from cargoline.operators import dictionary as D
from cargoline.operators import knowledge, match
from cargoline.plans import views
from cargoline.plans.shared import dictionary, dictionary_b, ground_truth
from cargoline.queries.oracle import (CTES, cte, masked_ctes, overlap_sql, phrase_sql, sql_clean_basic, sql_ngrams, sql_words,
                                      weighted_ctes)
from cargoline.queries.registry import query
from cargoline.session import scratch_path
from cargoline.sources import tables

L4 = "product_line, kind, class1, class2"


@query("ground_truth_build", ("ground_truth",), "SELECT * FROM ground_truth")
def ground_truth_build(spark, sf_dir):
    return knowledge.build_ground_truth(views.history(spark, sf_dir))


@query("gt_conflicts", ("history",), f"""SELECT row_id, hs_code, product_name, clean_text, {L4} FROM history
WHERE (hs_code, clean_text) IN (SELECT (hs_code, clean_text) FROM history GROUP BY hs_code, clean_text
  HAVING count(DISTINCT class2) > 1)""")
def gt_conflicts(spark, sf_dir):
    return knowledge.conflicts(views.history(spark, sf_dir))


@query("dict_tfidf", ("doc_kw",), "SELECT hs_code, label, n_products, array_to_string(keywords, ', ') AS keywords FROM doc_kw")
def dict_tfidf(spark, sf_dir):
    kw = D.tfidf_keywords(views.corpus(spark, sf_dir))
    return kw.select("hs_code", "label", "n_products", F.array_join("keywords", ", ").alias("keywords"))


@query("dict_supervised", ("dictionary",),
       f"SELECT entry_id, array_to_string(keywords, ', ') AS keywords, {L4}, hs_code, n_products FROM dictionary")
def dict_supervised(spark, sf_dir):
    d = D.build_dictionary(ground_truth(spark, sf_dir))
    return d.withColumn("keywords", F.array_join("keywords", ", "))


# one label per source file of one code: every text of a line, seen from the line's own name
cte("line_corpus", ("rows_",), "SELECT product_line || source_file AS hs_code, clean_text, product_line AS label FROM rows_")
CTES["line_src"] = (("line_corpus",), f"SELECT hs_code, label, {sql_words('clean_text')} AS w FROM line_corpus")
CTES["line_pairs"] = (("line_src",), CTES["gt_pairs"][1].replace("gt_", "line_"))
CTES["line_single"] = (("line_src", "line_pairs"), CTES["gt_single"][1].replace("gt_", "line_"))


@query("dict_single_label", ("line_single",),
       "SELECT hs_code, label, n_products, array_to_string(keywords, ', ') AS keywords FROM line_single")
def dict_single_label(spark, sf_dir):
    rows = views.rows(spark, sf_dir).select(F.concat("product_line", "source_file").alias("hs_code"), "clean_text",
                                            F.col("product_line").alias("label"))
    return D.single_label_keywords(rows).withColumn("keywords", F.array_join("keywords", ", "))


@query("keyword_candidates", ("candidates",), f"SELECT hs_code, {L4}, gram, lf, gf, score FROM candidates")
def keyword_candidates(spark, sf_dir):
    by = ["hs_code", *K.LABEL_COLUMNS]
    return D.keyword_candidates(D.mining_rows(views.history(spark, sf_dir)), by)


cte("doc_mined", ("corpus",), f"""SELECT hs_code, label AS product_line, '' AS kind, '' AS class1, '' AS class2,
  list_filter({sql_words('clean_text')}, lambda w: length(w) > 1) AS tokens FROM corpus""")


@query("keyword_purity", ("candidates",), f"""SELECT hs_code, product_line, count(*)::BIGINT AS n_candidates,
  max(score) AS best_score, round(avg(lf / gf), 6) AS mean_purity FROM candidates GROUP BY ALL""")
def keyword_purity(spark, sf_dir):
    by = ["hs_code", *K.LABEL_COLUMNS]
    c = D.keyword_candidates(D.mining_rows(views.history(spark, sf_dir)), by)
    return c.groupBy("hs_code", "product_line").agg(
        F.count("*").alias("n_candidates"), F.max("score").alias("best_score"),
        F.round(F.avg(F.col("lf") / F.col("gf")), 6).alias("mean_purity"))


@query("keyword_topn", ("kw_top",), f"SELECT hs_code, {L4}, array_to_string(keywords, ', ') AS keywords FROM kw_top")
def keyword_topn(spark, sf_dir):
    by = ["hs_code", *K.LABEL_COLUMNS]
    c = D.keyword_candidates(D.mining_rows(views.history(spark, sf_dir)), by)
    return D.top_keywords(c, by).withColumn("keywords", F.array_join("keywords", ", "))


@query("keyword_maximal", ("candidates",), f"""SELECT hs_code, {L4}, string_agg(gram, ', ' ORDER BY score DESC, lf DESC, gram) AS keywords
FROM (SELECT *, row_number() OVER (PARTITION BY hs_code, {L4} ORDER BY score DESC, lf DESC, gram) AS place FROM (SELECT c.* FROM candidates c
  LEFT JOIN (SELECT DISTINCT hs_code, {L4}, part, 1 AS named FROM (SELECT hs_code, {L4}, gram, unnest({sql_ngrams('w')}) AS part
    FROM (SELECT *, string_split(gram, ' ') AS w FROM candidates) a) b WHERE part <> gram) p
  ON p.part = c.gram AND {' AND '.join(f'p.{k} IS NOT DISTINCT FROM c.{k}' for k in ('hs_code', *K.LABEL_COLUMNS))}
  WHERE named IS NULL) f) t WHERE place <= 15 GROUP BY ALL""")
def keyword_maximal(spark, sf_dir):
    """Keywords per class when longer ones replace shorter ones."""
    by = ["hs_code", *K.LABEL_COLUMNS]
    c = D.keyword_candidates(D.mining_rows(views.history(spark, sf_dir)), by)
    return D.maximal_keywords(c, by).withColumn("keywords", F.array_join("keywords", ", "))


@query("dict_from_labelled", ("dictionary_b",),
       f"SELECT entry_id, array_to_string(keywords, ', ') AS keywords, {L4}, hs_code, n_products FROM dictionary_b")
def dict_from_labelled(spark, sf_dir):
    return D.build_labelled_dictionary(views.history(spark, sf_dir)).withColumn("keywords", F.array_join("keywords", ", "))


@query("match_history", ("rows_", "ground_truth"), """SELECT row_id, g.product_line AS history_line,
  g.class2 AS history_class2 FROM rows_ r LEFT JOIN ground_truth g ON g.hs_code = r.hs_code AND g.clean_text = r.clean_text""")
def match_history(spark, sf_dir):
    rows = views.rows(spark, sf_dir).select("row_id", "hs_code", "clean_text")
    m = match.match_history(rows, ground_truth(spark, sf_dir))
    return m.select("row_id", F.col("history_label.product_line").alias("history_line"),
                    F.col("history_label.class2").alias("history_class2"))


@query("match_history_table", ("rows_", "ground_truth"), """SELECT row_id, g.product_line AS history_line,
  g.class2 AS history_class2 FROM rows_ r LEFT JOIN ground_truth g ON g.hs_code = r.hs_code AND g.clean_text = r.clean_text""")
def match_history_table(spark, sf_dir):
    """The history as a bucketed table: only the declarations are shuffled."""
    table = f"history_{uuid.uuid4().hex}"
    tables.save_ground_truth(ground_truth(spark, sf_dir), table, path=scratch_path(spark, "history"))
    rows = views.rows(spark, sf_dir).select("row_id", "hs_code", "clean_text")
    m = match.match_history(rows, tables.load_ground_truth(spark, table))
    return m.select("row_id", F.col("history_label.product_line").alias("history_line"), F.col("history_label.class2").alias("history_class2"))


@query("match_phrase", ("new_rows", "dictionary"), phrase_sql("new_rows"))
def match_phrase(spark, sf_dir):
    m = match.match_phrase(views.new_rows(spark, sf_dir), dictionary(spark, sf_dir))
    return m.select("row_id", "entry_id", "keyword", "label.*")


@query("match_overlap", ("new_rows", "dictionary"), overlap_sql("new_rows"))
def match_overlap(spark, sf_dir):
    m = match.match_overlap(views.new_rows(spark, sf_dir), dictionary(spark, sf_dir))
    return m.select("row_id", "entry_id", "score", "label.*")


weighted_ctes("weighted", "new_rows", "dictionary_b", use_hs=False)
weighted_ctes("weighted_hs", "new_rows", "dictionary_b", use_hs=True)
# the fixtures hold hardly any deciding term, so one of their own words is made one
_HIGH = [*K.MASKED_HIGH_VALUE_TERMS, "ring"]
masked_ctes("masked", "new_rows", "dictionary_b", _HIGH)


@query("match_weighted", ("weighted",), "SELECT * FROM weighted")
def match_weighted(spark, sf_dir):
    return match.match_weighted(views.new_rows(spark, sf_dir), dictionary_b(spark, sf_dir), use_hs=False)


@query("match_weighted_hs", ("weighted_hs",), "SELECT * FROM weighted_hs")
def match_weighted_hs(spark, sf_dir):
    return match.match_weighted(views.new_rows(spark, sf_dir), dictionary_b(spark, sf_dir))


@query("match_masked", ("masked",), "SELECT * FROM masked")
def match_masked(spark, sf_dir):
    return match.match_masked(views.new_rows(spark, sf_dir), dictionary_b(spark, sf_dir), high_value=_HIGH)


cte("doc_rows", (), f"""SELECT doc_id AS row_id, 'doc' AS hs_code, {sql_clean_basic('text')} AS clean_text FROM documents""")
cte("phrases", (), f"""SELECT item_id AS entry_id, list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) AS keywords, 'item' AS product_line,
  CASE WHEN item_id % 2 = 0 THEN 'NC' ELSE 'LK' END AS kind, 'phrase' AS class1, item_id::VARCHAR AS class2,
  'doc' AS hs_code FROM (SELECT item_id, {sql_words(sql_clean_basic('text'))} AS w FROM benchmark) t""")
weighted_ctes("weighted_docs", "doc_rows", "phrases", use_hs=True)


@query("match_weighted_documents", ("weighted_docs",), "SELECT * FROM weighted_docs")
def match_weighted_documents(spark, sf_dir):
    docs = views.documents(spark, sf_dir)
    rows = docs.select(F.col("doc_id").alias("row_id"), F.lit("doc").alias("hs_code"),
                       text.clean_basic(F.col("text")).alias("clean_text"))
    item = F.col("item_id")
    phrases = views.table(spark, sf_dir, "benchmark").select(
        item.alias("entry_id"),
        text.ngrams(text.words(text.clean_basic(F.col("text"))), 3, 3).alias("keywords"),
        F.lit("item").alias("product_line"), F.when(item % 2 == 0, "NC").otherwise("LK").alias("kind"),
        F.lit("phrase").alias("class1"), item.cast("string").alias("class2"), F.lit("doc").alias("hs_code"))
    return match.match_weighted(rows, phrases)
