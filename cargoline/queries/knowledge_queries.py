"""Mapping, draft groups, label filling and taxonomy."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargoline import constants as K
from cargoline.functions import codes, text
from cargoline.operators import dictionary as D
from cargoline.operators import knowledge, standardize, taxonomy
from cargoline.plans import shared, views
from cargoline.queries.file_queries import _FAMILY
from cargoline.queries.oracle import cte, in_list, q, sql_clean_deep
from cargoline.queries.registry import query
from cargoline.session import scratch_path
from cargoline.sources import snapshots

L4 = ", ".join(K.LABEL_COLUMNS)


def _value_sql(level: str) -> str:
    t = f"trim(coalesce({level}, 'nan'))"
    cases = " ".join(f"WHEN {q(a)} THEN {q(c)}" for a, c in K.LABEL_ALIASES[level].items())
    named = f"(CASE {t} {cases} ELSE {t} END)"
    named = f"lower({named})" if level in ("class1", "class2") else named
    return f"(CASE WHEN {t} IN {in_list(K.NULL_WORDS)} THEN '{K.NO_LABEL}' ELSE {named} END)"


cte("mapping", ("declarations",), f"""
SELECT grain, key, level, max(value) FILTER (WHERE rn = 1) AS top, round(max(n) FILTER (WHERE rn = 1) / max(total), 4) AS confidence,
  max(value) FILTER (WHERE rn = 2) AS alt, round(max(n) FILTER (WHERE rn = 2) / max(total), 4) AS alt_confidence,
  max(total)::BIGINT AS total
FROM (SELECT *, row_number() OVER (PARTITION BY grain, key, level ORDER BY n DESC, value) AS rn,
        sum(n) OVER (PARTITION BY grain, key, level) AS total
  FROM (SELECT grain, CASE grain WHEN 'prefix' THEN code[1:4] ELSE code END AS key, level, value, count(*)::BIGINT AS n
    FROM (SELECT code, unnest({'[' + ', '.join(q(c) for c in K.LABEL_COLUMNS) + ']'}) AS level,
            unnest([{', '.join(_value_sql(c) for c in K.LABEL_COLUMNS)}]) AS value
          FROM (SELECT *, regexp_replace(hs_code, '\\D', '', 'g') AS code FROM declarations) d WHERE length(code) >= 4) x,
         (VALUES ('prefix'), ('code')) g(grain) GROUP BY ALL) y) z
GROUP BY grain, key, level""")


def mapping(spark, sf_dir):
    rows = views.goods(spark, sf_dir).withColumn("hs_code", codes.hs_valid(F.col("hs_code")))
    return knowledge.label_mapping(rows)


@query("hs_mapping", ("mapping",), "SELECT * FROM mapping")
def hs_mapping(spark, sf_dir):
    return mapping(spark, sf_dir)


@query("hs_mapping_tiers", ("mapping",), """SELECT (count(*) FILTER (WHERE grain = 'code'))::BIGINT AS total_hs_codes,
  (count(*) FILTER (WHERE grain = 'prefix'))::BIGINT AS total_prefixes,
  (count(*) FILTER (WHERE grain = 'code' AND best >= 0.8))::BIGINT AS high_confidence,
  (count(*) FILTER (WHERE grain = 'code' AND best >= 0.5 AND best < 0.8))::BIGINT AS medium_confidence,
  (count(*) FILTER (WHERE grain = 'code' AND best < 0.5))::BIGINT AS low_confidence
FROM (SELECT grain, key, max(confidence) AS best FROM mapping WHERE level <> 'kind' GROUP BY ALL) t""")
def hs_mapping_tiers(spark, sf_dir):
    return knowledge.mapping_tiers(mapping(spark, sf_dir))


# labels with gaps, as files have them before filling
_GAPS = {"product_line": "CASE WHEN row_id % 4 = 0 THEN NULL ELSE product_line END",
         "kind": "CASE WHEN row_id % 6 = 0 THEN '0' ELSE kind END",
         "class1": "CASE WHEN row_id % 9 = 0 THEN NULL ELSE class1 END",
         "class2": "CASE WHEN row_id % 2 = 0 THEN NULL ELSE class2 END"}
_GAP_SELECT = ", ".join(f"{e} AS {c}" for c, e in _GAPS.items())
cte("gaps", ("rows_",), f"""SELECT row_id, regexp_replace(hs_code, '\\D', '', 'g') AS hs_code, product_name,
  {', '.join(f"trim(coalesce({e}, '0')) AS {c}" for c, e in _GAPS.items())} FROM rows_""")
cte("draft_rows", ("gaps",), f"""SELECT * FROM gaps WHERE len(list_filter(string_split({sql_clean_deep('product_name')}, ' '),
  lambda w: length(w) > 1 AND w NOT IN {in_list(K.TEXT_STOPWORDS)})) > 0""")
cte("draft", ("draft_rows",), f"""SELECT *, row_number() OVER (ORDER BY first_row) - 1 AS cluster_id FROM (
  SELECT hs_code, {L4}, count(*)::BIGINT AS n_products, arg_min(product_name, row_id)[1:120] AS sample_text,
    min(row_id) AS first_row FROM draft_rows GROUP BY ALL) t""")
_LINE = ("CASE hs_code " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in K.LINE_OVERRIDES.items()) + " ELSE CASE hs_code[1:4] "
         + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in K.LINE_BY_HEADING.items()) + " ELSE 'SP ' || hs_code[1:4] END END")
_FILL = (f"CASE WHEN product_line <> '0' THEN product_line ELSE {_LINE} END AS product_line, "
         "CASE WHEN kind <> '0' THEN kind ELSE 'NC' END AS kind, "
         f"CASE WHEN class1 <> '0' THEN class1 ELSE {q(K.UNCLASSIFIED)} END AS class1, "
         "CASE WHEN class2 <> '0' THEN class2 ELSE '' END AS class2")


def gaps(spark, sf_dir):
    return views.rows(spark, sf_dir).selectExpr("row_id", "hs_code", "product_name", *[f"{e} AS {c}" for c, e in _GAPS.items()])


@query("draft_taxonomy", ("draft",), f"SELECT hs_code, {L4}, n_products, first_row, sample_text, cluster_id FROM draft")
def draft_taxonomy(spark, sf_dir):
    return D.draft_groups(gaps(spark, sf_dir))


@query("draft_row_groups", ("draft_rows", "draft"), f"SELECT g.row_id, d.cluster_id FROM draft_rows g JOIN draft d USING (hs_code, {L4})")
def draft_row_groups(spark, sf_dir):
    rows = gaps(spark, sf_dir)
    return D.tag_rows(rows, D.draft_groups(rows)).select("row_id", "cluster_id")


@query("draft_merge", ("draft",), f"""SELECT hs_code, {L4}, sum(n_products)::BIGINT AS n_products,
  arg_min(cluster_id, (-n_products, cluster_id)) AS cluster_id, arg_min(sample_text, (-n_products, cluster_id)) AS sample_text
FROM (SELECT hs_code, n_products, cluster_id, sample_text, {_FILL} FROM draft) t GROUP BY hs_code, {L4}""")
def draft_merge(spark, sf_dir):
    return D.merge_groups(D.draft_groups(gaps(spark, sf_dir)))


@query("label_fill_chain", ("gaps",), f"SELECT row_id, hs_code, {_FILL} FROM gaps")
def label_fill_chain(spark, sf_dir):
    rows = D._zero_labels(gaps(spark, sf_dir)).withColumn("hs_code", codes.hs_digits(F.col("hs_code")))
    return D.fill_labels(rows).select("row_id", "hs_code", *K.LABEL_COLUMNS)


@query("dict_priority_merge", ("dictionary", "dictionary_b"), """SELECT keyword, hs_code, priority, class1, class2 FROM (
  SELECT *, row_number() OVER (PARTITION BY hs_code, keyword ORDER BY priority DESC, entry_id) AS rn FROM (
    SELECT unnest(keywords) AS keyword, hs_code, 0 AS priority, class1, class2, entry_id FROM dictionary
    UNION ALL SELECT unnest(keywords), hs_code, 1, class1, class2, entry_id FROM dictionary_b) t) u WHERE rn = 1""")
def dict_priority_merge(spark, sf_dir):
    """Two active dictionaries of a user and an administrator; for one keyword of one code the administrator's counts."""
    from cargoline.operators.knowledge import merge_dictionaries

    return merge_dictionaries({0: shared.dictionary(spark, sf_dir), 1: shared.dictionary_b(spark, sf_dir)}).select(
        "keyword", "hs_code", "priority", "class1", "class2")


# --- taxonomy -------------------------------------------------------------------------------------------------------
_P6 = f"concat({_FAMILY}, lpad(p_size % 8, 2, '0'))"


def taxonomy_table(spark, sf_dir):
    """Headings of the parts, and their 6-digit prefixes where the size group is even."""
    parts = views.table(spark, sf_dir, "part")
    four = parts.selectExpr(f"{_FAMILY} AS hs_code_prefix", "concat('SP ', p_type) AS product_line",
                            "concat('Nhóm ', p_type) AS industry_name", "'NC' AS default_type", "'system' AS source").distinct()
    six = parts.where("p_size % 8 % 2 = 0").selectExpr(
        f"{_P6} AS hs_code_prefix", "concat('SP ', p_type) AS product_line",
        "concat('Nhóm ', p_type, ' ', p_size % 8) AS industry_name", "'LK' AS default_type", "'system' AS source").distinct()
    return four.unionByName(six)


def reference_table(spark, sf_dir):
    """Tariff texts of all 8-digit codes."""
    from cargoline.queries.file_queries import tariff_sheet
    out = taxonomy.official(tariff_sheet(spark, sf_dir), 0, 1, "row_no")
    return out.withColumn("level", F.length("hs_code"))


_P6_SQL = f"(({_FAMILY}) || lpad((p_size % 8)::VARCHAR, 2, '0'))"
cte("taxonomy", (), f"""SELECT DISTINCT {_FAMILY} AS hs_code_prefix, 'SP ' || p_type AS product_line, 'Nhóm ' || p_type AS industry_name,
  'NC' AS default_type, 'system' AS source FROM part
UNION ALL SELECT DISTINCT {_P6_SQL}, 'SP ' || p_type, 'Nhóm ' || p_type || ' ' || (p_size % 8), 'LK', 'system' FROM part
WHERE p_size % 8 % 2 = 0""")
cte("code_rows", ("declarations",), """SELECT CASE WHEN row_id % 13 = 0 THEN '2' || code[2:] WHEN row_id % 11 = 0 THEN code || '10'
  ELSE code END AS code, count(*)::BIGINT AS n_rows FROM (SELECT row_id, regexp_replace(hs_code, '\\D', '', 'g') AS code FROM declarations) t
WHERE length(code) >= 4 GROUP BY 1""")
cte("tariff", ("sheet",), """SELECT replace(trim(code), '.', '') AS code, trim(regexp_replace(arg_max(trim(description), p_partkey),
  '^[ -]+', '')) AS description FROM sheet WHERE trim(description) <> '' GROUP BY 1""")
cte("prefix_match", ("code_rows", "taxonomy"), """SELECT c.code, c.n_rows, t.* FROM code_rows c LEFT JOIN (
  SELECT * FROM (SELECT c.code AS k, t.*, row_number() OVER (PARTITION BY c.code ORDER BY length(hs_code_prefix) DESC) AS rn
    FROM code_rows c JOIN taxonomy t ON starts_with(c.code, t.hs_code_prefix)
      AND length(t.hs_code_prefix) IN (4, 6, 8, 10, length(c.code))) x WHERE rn = 1) t ON t.k = c.code""")


def code_rows(spark, sf_dir):
    """Distinct codes of the declarations, some outside the taxonomy and some longer than it."""
    d = views.goods(spark, sf_dir).select("row_id", codes.hs_digits(F.col("hs_code")).alias("c"))
    return standardize.distinct_codes(d.selectExpr(
        "CASE WHEN length(c) < 4 THEN c WHEN row_id % 13 = 0 THEN concat('2', substring(c, 2)) WHEN row_id % 11 = 0 THEN concat(c, '10') ELSE c END "
        "AS hs_code"))


@query("taxonomy_longest_prefix", ("prefix_match",), """SELECT code, n_rows, hs_code_prefix AS matched_prefix, product_line,
  industry_name, default_type, source FROM prefix_match""")
def taxonomy_longest_prefix(spark, sf_dir):
    return taxonomy.longest_prefix(code_rows(spark, sf_dir), taxonomy_table(spark, sf_dir))


_COMPONENT = " OR ".join(f"contains(lower(description), {q(t)})" for t in K.COMPONENT_TERMS)


@query("taxonomy_resolve", ("prefix_match", "tariff"), f"""
SELECT code, n_rows, CASE WHEN source IS NOT NULL THEN product_line WHEN description IS NOT NULL THEN
    CASE code[1:4] {' '.join(f"WHEN {q(a)} THEN {q(b)}" for a, b in K.LINE_BY_HEADING_OFFLINE.items())} ELSE 'SP ' || code[1:4] END END AS product_line,
  CASE WHEN source IS NOT NULL THEN industry_name ELSE description END AS industry_name,
  CASE WHEN source IS NOT NULL THEN default_type WHEN description IS NOT NULL THEN CASE WHEN {_COMPONENT} THEN 'LK' ELSE 'NC' END END
    AS default_type,
  CASE WHEN source IS NOT NULL THEN source WHEN description IS NOT NULL THEN 'offline' END AS source
FROM (SELECT p.*, f.description FROM (SELECT code, n_rows, product_line, industry_name, default_type, source FROM prefix_match) p LEFT JOIN tariff f ON f.code = p.code) x""")
def taxonomy_resolve(spark, sf_dir):
    return taxonomy.resolve(code_rows(spark, sf_dir), taxonomy_table(spark, sf_dir), reference_table(spark, sf_dir))


@query("taxonomy_unresolved", ("prefix_match", "tariff"), """SELECT code FROM (SELECT code, source FROM prefix_match) WHERE source IS NULL AND code NOT IN (SELECT code FROM tariff)""")
def taxonomy_unresolved(spark, sf_dir):
    """The codes that neither the whole taxonomy nor the tariff knows."""
    return taxonomy.unresolved(taxonomy_resolve(spark, sf_dir))


@query("taxonomy_offline", ("code_rows", "tariff"), f"""SELECT code, n_rows, CASE WHEN description IS NOT NULL THEN
    CASE code[1:4] {' '.join(f"WHEN {q(a)} THEN {q(b)}" for a, b in K.LINE_BY_HEADING_OFFLINE.items())} ELSE 'SP ' || code[1:4] END END AS product_line,
  description AS industry_name, CASE WHEN description IS NOT NULL THEN CASE WHEN {_COMPONENT} THEN 'LK' ELSE 'NC' END END AS default_type,
  CASE WHEN description IS NOT NULL THEN 'offline' END AS source FROM code_rows LEFT JOIN tariff USING (code)""")
def taxonomy_offline(spark, sf_dir):
    """An empty taxonomy: what the tariff alone tells."""
    return taxonomy.resolve(code_rows(spark, sf_dir), taxonomy_table(spark, sf_dir).where("false"), reference_table(spark, sf_dir))


cte("tax_updates", (), f"""SELECT ({_FAMILY}) || '.' || lpad((p_size % 8)::VARCHAR, 2, '0') AS hs_code_prefix, 'SP ' || p_brand AS product_line,
  p_name AS industry_name, CASE p_size % 5 WHEN 0 THEN ' lk ' WHEN 1 THEN 'XX' ELSE 'NC' END AS default_type, p_partkey AS seq FROM part""")


_UPSERT_SQL = """
SELECT hs_code_prefix, coalesce(u.product_line, t.product_line) AS product_line, coalesce(u.industry_name, t.industry_name) AS industry_name,
  coalesce(u.default_type, t.default_type) AS default_type, CASE WHEN u.seq IS NOT NULL THEN 'user_input' ELSE t.source END AS source
FROM taxonomy t FULL OUTER JOIN (SELECT * FROM (SELECT * REPLACE (replace(hs_code_prefix, '.', '') AS hs_code_prefix,
    upper(trim(default_type)) AS default_type) FROM tax_updates) z WHERE default_type IN ('NC', 'LK')
  QUALIFY row_number() OVER (PARTITION BY hs_code_prefix ORDER BY seq DESC) = 1) u USING (hs_code_prefix)
WHERE hs_code_prefix NOT IN ('9405', '850400')"""


def tax_changes(spark, sf_dir):
    """Updates from the parts, some with a kind that is none, and two codes to delete."""
    updates = views.table(spark, sf_dir, "part").selectExpr(
        f"concat({_FAMILY}, '.', lpad(p_size % 8, 2, '0')) AS hs_code_prefix", "concat('SP ', p_brand) AS product_line",
        "p_name AS industry_name", "CASE p_size % 5 WHEN 0 THEN ' lk ' WHEN 1 THEN 'XX' ELSE 'NC' END AS default_type",
        "p_partkey AS seq")
    return updates, spark.createDataFrame([("9405",), ("8504.00",)], "hs_code_prefix string")


@query("taxonomy_upsert", ("taxonomy", "tax_updates"), _UPSERT_SQL)
def taxonomy_upsert(spark, sf_dir):
    return taxonomy.upsert(taxonomy_table(spark, sf_dir), *tax_changes(spark, sf_dir))


@query("taxonomy_merge", ("taxonomy", "tax_updates"), f"""SELECT *, 0 AS version FROM taxonomy UNION ALL BY NAME SELECT *, 1 AS version FROM ({_UPSERT_SQL}) u""")
def taxonomy_merge(spark, sf_dir):
    """The taxonomy in versions, before and after the changes; both are read from the same table."""
    base = scratch_path(spark, "taxonomy")
    snapshots.create(taxonomy_table(spark, sf_dir), base, "hs_code_prefix")
    taxonomy.merge_into(spark, base, *tax_changes(spark, sf_dir))
    versions = [snapshots.read(spark, base, v).withColumn("version", F.lit(v)) for v in snapshots.versions(spark, base)]
    return versions[0].unionByName(versions[1])


@query("taxonomy_seed", ("tariff",), f"""SELECT code AS hs_code_prefix, {_LINE.replace('hs_code', 'code')} AS product_line, description AS industry_name,
  'NC' AS default_type, 'system' AS source FROM tariff""")
def taxonomy_seed(spark, sf_dir):
    names = reference_table(spark, sf_dir).select(F.col("hs_code").alias("hs_code_prefix"), F.col("description").alias("industry_name"))
    return taxonomy.seed(names)


@query("taxonomy_seed_kinds", ("tariff",), f"""SELECT code AS hs_code_prefix, {_LINE.replace('hs_code', 'code')} AS product_line, description AS industry_name,
  CASE WHEN code[5:6] IN ('01', '03', '05', '07') THEN 'LK' ELSE 'NC' END AS default_type, 'tariff' AS source FROM tariff""")
def taxonomy_seed_kinds(spark, sf_dir):
    """Names with the kinds that a user gives for some of the codes."""
    names = reference_table(spark, sf_dir).select(F.col("hs_code").alias("hs_code_prefix"), F.col("description").alias("industry_name"))
    kinds = names.where("substring(hs_code_prefix, 6, 1) IN ('1', '3', '5', '7')").select("hs_code_prefix", F.lit("LK").alias("default_type"))
    return taxonomy.seed(names, kinds, "tariff")


cte("full_taxonomy", ("taxonomy", "tariff"), f"""SELECT * FROM taxonomy UNION ALL SELECT code, {_LINE.replace('hs_code', 'code')}, description,
  CASE WHEN code[5:6] IN ('01', '03', '05', '07') THEN 'LK' ELSE 'NC' END, 'tariff' FROM tariff""")
_OVERRIDE = "CASE hs_code " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in K.LINE_OVERRIDES.items()) + " END"


@query("label_fill_taxonomy", ("gaps", "full_taxonomy"), f"""SELECT row_id, hs_code,
  CASE WHEN product_line <> '0' THEN product_line ELSE coalesce({_OVERRIDE}, heading_line, 'SP ' || hs_code[1:4]) END AS product_line,
  CASE WHEN kind <> '0' THEN kind ELSE coalesce(default_type, 'NC') END AS kind,
  CASE WHEN class1 <> '0' THEN class1 ELSE coalesce(industry_name, {q(K.UNCLASSIFIED)}) END AS class1,
  CASE WHEN class2 <> '0' THEN class2 ELSE '' END AS class2
FROM gaps LEFT JOIN (SELECT hs_code_prefix AS hs_code, default_type, industry_name FROM full_taxonomy) n USING (hs_code)
  LEFT JOIN (SELECT hs_code_prefix[1:4] AS heading, arg_min(product_line, hs_code_prefix) AS heading_line FROM full_taxonomy GROUP BY 1) h ON h.heading = hs_code[1:4]""")
def label_fill_taxonomy(spark, sf_dir):
    """Gaps filled from a taxonomy of headings, six-digit groups and full codes."""
    rows = D._zero_labels(gaps(spark, sf_dir)).withColumn("hs_code", codes.hs_digits(F.col("hs_code")))
    records = taxonomy_table(spark, sf_dir).unionByName(taxonomy_seed_kinds(spark, sf_dir))
    return D.fill_labels(rows, records).select("row_id", "hs_code", *K.LABEL_COLUMNS)


@query("dict_active_owners", ("dictionary", "dictionary_b"), """SELECT keyword, hs_code, priority, class1, class2 FROM (
  SELECT *, row_number() OVER (PARTITION BY hs_code, keyword ORDER BY priority DESC, entry_id) AS rn FROM (
    SELECT unnest(keywords) AS keyword, hs_code, 0 AS priority, class1, class2, entry_id FROM dictionary
    UNION ALL SELECT unnest(keywords), hs_code, 1, class1, class2, entry_id FROM dictionary_b) t) u WHERE rn = 1""")
def dict_active_owners(spark, sf_dir):
    """A user's and an administrator's dictionary, and an inactive one of the administrator that must not count."""
    from functools import reduce

    from cargoline.operators.knowledge import merge_active

    tagged = [d.select("entry_id", "keywords", "hs_code", *K.LABEL_COLUMNS).withColumn("dictionary_id", F.lit(k)) for k, d in (
        (1, shared.dictionary(spark, sf_dir)), (2, shared.dictionary_b(spark, sf_dir)),
        (3, shared.dictionary(spark, sf_dir).withColumns({c: F.lit("inactive") for c in K.LABEL_COLUMNS})))]
    owned = spark.createDataFrame([(1, 7, True), (2, 8, True), (3, 8, False)], "dictionary_id int, owner_id int, is_active boolean")
    users = spark.createDataFrame([(7, "user"), (8, "admin")], "user_id int, role string")
    return merge_active(reduce(lambda a, b: a.unionByName(b), tagged), owned, users).select("keyword", "hs_code", "priority", "class1", "class2")


@query("hs_preclassify", ("prefix_match", "dictionary_b"), """SELECT code, n_rows, CASE WHEN n > 100 THEN product_line END AS product_line, CASE WHEN n > 100 THEN default_type END AS kind
FROM (SELECT p.code, any_value(p.n_rows) AS n_rows, any_value(p.product_line) AS product_line, any_value(p.default_type) AS default_type, max(d.n_products) AS n
      FROM prefix_match p LEFT JOIN dictionary_b d ON starts_with(regexp_replace(d.hs_code, '\\D', '', 'g'), p.hs_code_prefix) GROUP BY p.code) t""")
def hs_preclassify(spark, sf_dir):
    """Line and kind from the taxonomy where the dictionary has an entry of more than a hundred products under the code's prefix."""
    return taxonomy.preclassify(code_rows(spark, sf_dir), taxonomy_table(spark, sf_dir), shared.dictionary_b(spark, sf_dir))


@query("dict_route", ("rows_", "dictionary"), """SELECT * FROM (
WITH asked AS (SELECT DISTINCT source_file AS upload, CASE WHEN length(h) >= 4 THEN h[1:4] END AS heading FROM (SELECT source_file, regexp_replace(hs_code, '\\D', '', 'g') AS h FROM rows_)),
sizes AS (SELECT product_line AS dictionary_id, count(*) AS size FROM dictionary GROUP BY 1),
listed AS (SELECT DISTINCT product_line AS dictionary_id, regexp_replace(hs_code, '\\D', '', 'g')[1:4] AS heading FROM dictionary WHERE length(regexp_replace(hs_code, '\\D', '', 'g')) >= 4),
best AS (SELECT upload, min((-o, -size, dictionary_id)) AS b FROM (SELECT upload, dictionary_id, count(*) AS o FROM asked JOIN listed USING (heading) GROUP BY ALL) JOIN sizes USING (dictionary_id) GROUP BY upload)
SELECT upload, coalesce(b[3], 'active') AS dictionary_id, coalesce(-b[1], 0)::BIGINT AS overlap FROM (SELECT DISTINCT upload FROM asked) LEFT JOIN best USING (upload)) x""")
def dict_route(spark, sf_dir):
    """Each source file to the product line's dictionary that covers most of its headings."""
    entries = shared.dictionary(spark, sf_dir)
    sizes = entries.groupBy("product_line").agg(F.count("*").alias("size"))
    lists = D.heading_list(entries, ["product_line"]).join(sizes, "product_line").withColumnRenamed("product_line", "dictionary_id")
    uploads = views.rows(spark, sf_dir).select(F.col("source_file").alias("upload"), "hs_code")
    return D.route(uploads, lists, "active")


_COUNT_TERMS = " + ".join(f"contains(lower(d), {q(t)})::INT" for t in K.KIND_RULE_TERMS)


@query("kind_rules", ("declarations", "taxonomy"), f"""SELECT row_id, CASE WHEN n >= 2 THEN 'LK' WHEN t.default_type IN ('NC', 'LK') THEN t.default_type WHEN n >= 1 THEN 'LK' ELSE 'NC' END AS kind
FROM (SELECT row_id, code, {_COUNT_TERMS} AS n FROM (SELECT row_id, regexp_replace(hs_code, '\\D', '', 'g') AS code,
  CASE WHEN class1 = 'ring' THEN 'Vòng đệm, nắp ' WHEN class1 = 'rod' THEN 'Trục ' ELSE '' END || detailed_product_en AS d FROM declarations) x) y
LEFT JOIN (SELECT * FROM taxonomy WHERE length(hs_code_prefix) = 6) t ON t.hs_code_prefix = code[1:6]""")
def kind_rules(spark, sf_dir):
    """Kind of every declaration by component words and its code's record."""
    head = F.when(F.col("class1") == "ring", "Vòng đệm, nắp ").when(F.col("class1") == "rod", "Trục ").otherwise("")
    rows = views.declarations(spark, sf_dir).select("row_id", codes.hs_digits(F.col("hs_code")).alias("code"), F.concat(head, "detailed_product_en").alias("d"))
    six = taxonomy_table(spark, sf_dir).where("length(hs_code_prefix) = 6")
    known = taxonomy.longest_prefix(rows.select("code").distinct(), six, (6,)).select("code", "default_type")
    return rows.join(known, "code", "left").select("row_id", text.kind_by_rules(F.col("d"), F.col("default_type")).alias("kind"))
