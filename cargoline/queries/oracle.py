"""Building blocks of the SQL that checks each query: text expressions and shared common table expressions."""

from __future__ import annotations

import re

from cargoline import constants as K
from cargoline.plans.views import HISTORY_END

CTES: dict[str, tuple[tuple[str, ...], str]] = {}
#: expressions whose columns are long and must not be repeated where they are used
COSTLY = {"evaluation", "judged", "disagreement", "retrain_base", "threeway", "messy"}


def cte(name: str, deps: tuple[str, ...], sql: str) -> None:
    CTES[name] = (deps, sql)


def with_ctes(names: tuple[str, ...] | list[str], body: str) -> str:
    """``WITH`` clause holding ``names`` and everything they need, in dependency order, before ``body``."""
    order: list[str] = []

    def visit(name: str) -> None:
        deps, _ = CTES[name]
        for d in deps:
            visit(d)
        if name not in order:
            order.append(name)

    for n in names:
        visit(n)
    if not order:
        return body
    # an expression used more than once is computed once
    texts = [body, *[CTES[n][1] for n in order]]
    uses = {n: sum(len(re.findall(rf"\b{n}\b", t)) for t in texts) for n in order}
    return "WITH " + ",\n".join(f"{n} AS {'MATERIALIZED ' if uses[n] > 1 or n in COSTLY else ''}(\n{CTES[n][1]}\n)" for n in order) + "\n" + body


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def sql_strip(e: str) -> str:
    return rf"regexp_replace({e}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def sql_longest(e: str) -> str:
    parts = f"list_filter(list_transform(string_split({e}, '#&'), lambda p: {sql_strip('p')}), lambda p: p <> '')"
    return (f"(CASE WHEN contains({e}, '#&') AND len({parts}) > 0 THEN list_reduce({parts}, "
            f"lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END) ELSE {e} END)")


def sql_squeeze(e: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({e}, '')), '[^a-z0-9{K.VIETNAMESE_LETTERS}]+', ' ', 'g'))"


def sql_clean_basic(e: str) -> str:
    return sql_squeeze(sql_longest(f"lower(coalesce({e}, ''))"))


def sql_clean_deep(e: str) -> str:
    """Lookahead-free form of the deep cleaning; equal to it on the declaration texts."""
    s = f"regexp_replace(lower(coalesce({e}, '')), '^[^#]*#\\s*&?\\s*', '')"
    s = f"regexp_replace({s}, '#\\s*&?\\s*vn\\s*$', '')"
    code = r"\b[a-z0-9.\-]*([0-9][a-z0-9.\-]*[a-z]|[a-z][a-z0-9.\-]*[0-9])[a-z0-9.\-]*\b"
    s = f"regexp_replace({s}, '{code}', ' ', 'g')"
    s = f"regexp_replace({s}, '\\b\\d+([.,]\\d+)?\\b', ' ', 'g')"
    s = f"regexp_replace({s}, '[^a-z{K.VIETNAMESE_LETTERS}]+', ' ', 'g')"
    return f"trim({s})"


def sql_words(e: str) -> str:
    return f"list_filter(string_split({e}, ' '), lambda w: w <> '')"


def sql_ngrams(e: str, n_min: int = 1, n_max: int = 3) -> str:
    """List of word n-grams of the list ``e`` (a column name), made by zipping the list with itself shifted."""
    parts = []
    for n in range(n_min, n_max + 1):
        shifted = ", ".join(f"{e}[{k + 1}:len({e}) - {n - 1 - k}]" for k in range(n))
        gram = " || ' ' || ".join(f"z[{k + 1}]" for k in range(n))
        parts.append(e if n == 1 else f"(CASE WHEN len({e}) >= {n} THEN list_transform(list_zip({shifted}), "
                                      f"lambda z: {gram}) ELSE [] END)")
    return "(" + " || ".join(parts) + ")"


def sql_positioned_ngrams(e: str, n_max: int = 3) -> str:
    """As ``sql_ngrams``, with the positions of the first and the last word."""
    parts = []
    for n in range(1, n_max + 1):
        shifted = ", ".join(f"{e}[{k + 1}:len({e}) - {n - 1 - k}]" for k in range(n))
        gram = " || ' ' || ".join(f"z[{k + 2}]" for k in range(n))
        parts.append(f"(CASE WHEN len({e}) >= {n} THEN list_transform(list_zip(range(0, len({e}) - {n - 1}), {shifted}), "
                     f"lambda z: {{'start': z[1], 'stop': z[1] + {n - 1}, 'keyword': {gram}}}) ELSE [] END)")
    return "(" + " || ".join(parts) + ")"


def sql_label_part(e: str, level: str) -> str:
    text = f"trim(coalesce({e}, 'nan'))"
    aliases = K.LABEL_ALIASES[level]
    default = f"lower({text})" if level in ("class1", "class2") else text
    cases = " ".join(f"WHEN {q(a)} THEN {q(c)}" for a, c in aliases.items())
    named = f"(CASE {text} {cases} ELSE {default} END)"
    return f"(CASE WHEN {named} IN {in_list(K.NULL_WORDS)} THEN '{K.NO_LABEL}' ELSE {named} END)"


def sql_part(e: str, index: int) -> str:
    return f"coalesce(string_split({e}, ' | ')[{index + 1}], '{K.NO_LABEL}')"


def sql_normalize_combined(e: str) -> str:
    text = f"(CASE WHEN trim(coalesce({e}, '')) <> '' THEN {e} END)"
    return "(" + " || ' | ' || ".join(sql_label_part(sql_part(text, i), lv)
                                      for i, lv in enumerate(K.LABEL_COLUMNS)) + ")"


FAMILY = ("CASE p_type WHEN 'ECONOMY' THEN '9405' WHEN 'SMALL' THEN '8539' WHEN 'MEDIUM' THEN '9617' "
          "WHEN 'PROMO' THEN '7020' WHEN 'STANDARD' THEN '8516' WHEN 'LARGE' THEN '8504' END")

cte("declarations", (), f"""
SELECT o_orderkey AS row_id,
  CASE WHEN o_orderkey % 101 = 0 THEN '' WHEN o_orderkey % 103 = 0 THEN '99999999' WHEN o_orderkey % 5 = 0 THEN code || '.0' ELSE code END AS hs_code,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL
       WHEN o_orderkey % 3 = 0 THEN 'SKU' || l_partkey || '#&' || upper(base) || '#&VN' ELSE base END AS detailed_product,
  base AS detailed_product_en, c_name AS vn_importer, s_name AS foreign_exporter, n_name AS origin_country,
  r_name AS continent,
  CASE WHEN o_orderkey % 89 = 0 THEN 'n/a'
       WHEN hundred >= 1000 THEN (hundred // 1000) || ',' || lpad((hundred % 1000)::VARCHAR, 3, '0')
       ELSE hundred::VARCHAR END AS quantity,
  CASE WHEN o_orderkey % 89 = 0 THEN 'n/a' ELSE '$' || l_extendedprice::VARCHAR END AS total_value_usd,
  CASE WHEN o_orderkey % 89 = 0 THEN 'n/a'
       ELSE (floor(l_extendedprice / l_quantity * 100) / 100)::VARCHAR || ' USD' END AS unit_price_usd,
  CASE WHEN o_orderkey % 83 = 0 THEN 'bad-date' WHEN o_orderkey % 2 = 1 THEN strftime(o_orderdate, '%d/%m/%Y')
       ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date,
  strftime(o_orderdate, '%Y%m') AS month, l_returnflag AS unit_qty, o_orderpriority AS incoterms,
  c_mktsegment AS method_of_payment, 'SP ' || p_type AS product_line,
  CASE WHEN noun IN ('bolt', 'gear', 'ring', 'rod') THEN 'LK' ELSE 'NC' END AS kind, noun AS class1,
  CASE WHEN o_orderkey % 50 = 0 THEN 'khác' ELSE adjective END AS class2,
  'file_' || (o_orderkey % 4) AS source_file, o_orderdate::DATE AS order_date
FROM (
  SELECT *, string_split(p_name, ' ')[2] AS noun, string_split(p_name, ' ')[1] AS adjective,
    CASE WHEN o_orderkey % 107 = 0 THEN 'Sản phẩm không xác định'
      ELSE p_name || ' ' || p_size || 'W ' || replace(p_brand, '#', '') || ' mới 100%' END AS base,
    ({FAMILY}) || lpad((p_size % 8)::VARCHAR, 2, '0') || '90' AS code, (l_quantity * 100)::BIGINT AS hundred
  FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
          l_suppkey, l_quantity, l_extendedprice, l_returnflag) = 1) l
  JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey JOIN customer ON c_custkey = o_custkey
  JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
  JOIN region ON r_regionkey = n_regionkey) t""")

cte("rows_", ("declarations",), f"""
SELECT * REPLACE (trim(regexp_replace(coalesce(hs_code, ''), '\\.0$', '')) AS hs_code),
  {sql_clean_basic('product_name')} AS clean_text
FROM (SELECT *, coalesce(CASE WHEN trim(detailed_product) <> '' THEN detailed_product END, detailed_product_en)
        AS product_name FROM declarations) d""")

cte("history", ("rows_",), f"SELECT * FROM rows_ WHERE order_date < DATE '{HISTORY_END}'")
cte("new_rows", ("rows_",), f"SELECT * FROM rows_ WHERE order_date >= DATE '{HISTORY_END}'")
cte("corpus", (), f"""SELECT doc_id AS row_id, source AS hs_code, {sql_clean_basic('text')} AS clean_text, lang AS label
FROM documents""")

_L4 = "product_line, kind, class1, class2"
LABEL4 = "product_line || ' | ' || kind || ' | ' || class1 || ' | ' || class2"

cte("ground_truth", ("history",), f"""
SELECT hs_code, product_name, clean_text, {_L4} FROM (
  SELECT *, row_number() OVER (PARTITION BY hs_code, clean_text ORDER BY row_id) AS rn,
    min(class2) OVER (PARTITION BY hs_code, clean_text) AS low, max(class2) OVER (PARTITION BY hs_code, clean_text) AS high
  FROM history WHERE clean_text <> '') t WHERE rn = 1 AND low = high""")


def tfidf_ctes(prefix: str, source: str, limit: int = 20) -> None:
    """Shared expressions ``<prefix>_raw``, ``<prefix>_norm``, ``<prefix>_kw`` over ``source(hs_code, label, clean_text)``."""
    cte(f"{prefix}_src", (source,), f"SELECT hs_code, {LABEL4 if source == 'ground_truth' else 'label'} AS label, "
                                    f"{sql_words('clean_text')} AS w FROM {source}")
    cte(f"{prefix}_pairs", (f"{prefix}_src",),
        f"SELECT hs_code, label, count(*)::BIGINT AS n_products FROM {prefix}_src GROUP BY ALL")
    cte(f"{prefix}_raw", (f"{prefix}_src", f"{prefix}_pairs"), f"""
SELECT hs_code, label, gram, tf, df, round(tf * (ln((1 + n_docs) / (1 + df)) + 1), 9) AS raw FROM (
  SELECT *, count(*) OVER (PARTITION BY hs_code, gram) AS df FROM (
    SELECT hs_code, label, gram, count(*)::BIGINT AS tf
    FROM (SELECT hs_code, label, unnest({sql_ngrams('w')}) AS gram FROM {prefix}_src) a GROUP BY ALL) b) c
JOIN (SELECT hs_code, count(*)::BIGINT AS n_docs FROM {prefix}_pairs GROUP BY 1 HAVING count(*) > 1) d USING (hs_code)
WHERE df <= 0.9 * n_docs""")
    cte(f"{prefix}_norm", (f"{prefix}_raw",),
        f"SELECT hs_code, label, sqrt(sum(raw * raw)) AS norm FROM {prefix}_raw GROUP BY ALL")
    cte(f"{prefix}_kw", (f"{prefix}_raw", f"{prefix}_norm", f"{prefix}_pairs"), f"""
SELECT p.hs_code, p.label, p.n_products, coalesce(k.keywords, []) AS keywords FROM {prefix}_pairs p LEFT JOIN (
  SELECT hs_code, label, list(gram ORDER BY rn) AS keywords FROM (
    SELECT hs_code, label, gram, raw / norm AS weight,
      row_number() OVER (PARTITION BY hs_code, label ORDER BY raw DESC, gram) AS rn
    FROM {prefix}_raw JOIN {prefix}_norm USING (hs_code, label)) t
  WHERE rn <= {limit} AND round(weight, 9) > 0.03 GROUP BY ALL) k USING (hs_code, label)
WHERE p.hs_code IN (SELECT hs_code FROM {prefix}_raw)""")
    cte(f"{prefix}_single", (f"{prefix}_src", f"{prefix}_pairs"), f"""
SELECT s.hs_code, s.label, s.n_products, coalesce(k.keywords, []) AS keywords FROM (
  SELECT hs_code, min(label) AS label, min(n_products) AS n_products FROM {prefix}_pairs GROUP BY 1 HAVING count(*) = 1) s
LEFT JOIN (SELECT hs_code, list(gram ORDER BY rn) AS keywords FROM (
    SELECT hs_code, gram, row_number() OVER (PARTITION BY hs_code ORDER BY count(*) DESC, gram) AS rn
    FROM (SELECT hs_code, unnest({sql_ngrams('w', 1, 2)}) AS gram FROM {prefix}_src) a GROUP BY hs_code, gram) t
  WHERE rn <= 15 GROUP BY 1) k USING (hs_code)""")


tfidf_ctes("gt", "ground_truth")
tfidf_ctes("doc", "corpus")
_PARTS = ", ".join(f"string_split(label, ' | ')[{i + 1}] AS {c}" for i, c in enumerate(K.LABEL_COLUMNS))
cte("dictionary", ("gt_kw", "gt_single"), f"""
SELECT hs_code || ' | ' || label AS entry_id, keywords, {_PARTS}, hs_code, n_products
FROM (SELECT * FROM gt_kw UNION ALL SELECT * FROM gt_single) t""")

# --- purity keywords ------------------------------------------------------------------------------------------------
_WORD_OK = (f"(w NOT IN {in_list(K.LABEL_STOPWORDS)} AND length(w) >= 3 AND NOT regexp_matches(w, '^\\d') "
            f"AND NOT regexp_matches(w, '^(\\d+[a-z]+|[a-z]+\\d+)$') "
            f"AND regexp_matches(w, '[a-z{K.VIETNAMESE_LETTERS}]{{2,}}'))")
_ANY_BONUS = " OR ".join(f"contains(gram, {q(t)})" for t in K.KEYWORD_BONUS_TERMS)


def candidate_sql(source: str) -> str:
    """Purity-scored n-grams over ``source(hs_code, label columns..., tokens list)``."""
    return f"""
SELECT *, round(lf / gf * 50 + (lf * 2) * (len(string_split(gram, ' ')) + CASE WHEN {_ANY_BONUS} THEN 5 ELSE 0 END), 6)
  AS score FROM (
  SELECT *, (sum(lf) OVER (PARTITION BY gram))::BIGINT AS gf FROM (
    SELECT hs_code, {_L4}, gram, count(*)::BIGINT AS lf
    FROM (SELECT hs_code, {_L4}, unnest(list_distinct({sql_ngrams('tokens')})) AS gram FROM {source}) a GROUP BY ALL) b) c
WHERE lf / gf >= 0.05 AND len(list_filter(string_split(gram, ' '), lambda w: {_WORD_OK})) > 0
  AND len(list_filter(string_split(gram, ' '), lambda w: w IN {in_list(K.KEYWORD_STOPWORDS)})) = 0"""


cte("mined", ("history",), f"""
SELECT * REPLACE (regexp_replace(hs_code, '\\D', '', 'g') AS hs_code), list_filter(string_split(
  {sql_clean_deep('product_name')}, ' '), lambda w: length(w) > 1 AND w NOT IN {in_list(K.LABEL_STOPWORDS)}) AS tokens
FROM history""")
cte("candidates", ("mined",), candidate_sql("mined"))
cte("kw_top", ("candidates",), f"""
SELECT hs_code, {_L4}, list(gram ORDER BY rn) AS keywords FROM (
  SELECT *, row_number() OVER (PARTITION BY hs_code, {_L4} ORDER BY score DESC, lf DESC, gram) AS rn FROM (
    SELECT c.* FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM candidates b WHERE b.hs_code = c.hs_code
      AND b.product_line = c.product_line AND b.kind = c.kind AND b.class1 = c.class1 AND b.class2 = c.class2
      AND b.gram <> c.gram AND contains(b.gram, c.gram) AND (b.score > c.score OR (b.score = c.score AND (b.lf > c.lf
        OR (b.lf = c.lf AND b.gram < c.gram)))))) f) t
WHERE rn <= 15 GROUP BY ALL""")
_LABEL_WORDS = "[" + ", ".join(
    f"CASE WHEN lower(trim({c})) NOT IN ('0', {q(K.UNCLASSIFIED.lower())}, 'nc', '') THEN {sql_clean_deep(c)} END"
    for c in reversed(K.LABEL_COLUMNS)) + "]"
cte("dictionary_b", ("mined", "kw_top"), f"""
SELECT entry_id, list_filter(lw, lambda w: NOT list_contains(kw, w)) || kw AS keywords, {_L4}, hs_code, n_products
FROM (SELECT *, hs_code || ' | ' || {LABEL4} AS entry_id, coalesce(keywords, []) AS kw,
    list_filter({_LABEL_WORDS}, lambda w: w IS NOT NULL AND w <> '') AS lw
  FROM (SELECT hs_code, {_L4}, count(*)::BIGINT AS n_products FROM mined GROUP BY ALL) g
  LEFT JOIN kw_top USING (hs_code, {_L4})) t""")

# --- matching -------------------------------------------------------------------------------------------------------
_LABEL_STRUCT = "{'product_line': product_line, 'kind': kind, 'class1': class1, 'class2': class2}"


def phrase_sql(rows: str, dictionary: str = "dictionary") -> str:
    return f"""
SELECT row_id, entry_id, keyword, {_L4} FROM (
  SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY length(keyword) DESC, entry_id, kw_pos) AS rn FROM (
    SELECT row_id, d.entry_id, d.keyword, d.kw_pos, d.product_line, d.kind, d.class1, d.class2 FROM {rows} r JOIN (
      SELECT *, unnest(keywords) AS keyword, generate_subscripts(keywords, 1) AS kw_pos FROM {dictionary}) d
    ON d.hs_code = r.hs_code AND length(d.keyword) >= 3
      AND contains(' ' || r.clean_text || ' ', ' ' || d.keyword || ' ')) h) t WHERE rn = 1"""


def _sig(words_list: str) -> str:
    return f"list_distinct(list_filter({words_list}, lambda w: w <> '' AND w NOT IN {in_list(K.OVERLAP_STOPWORDS)}))"


def overlap_sql(rows: str, dictionary: str = "dictionary") -> str:
    flat = "flatten(list_transform(keywords, lambda k: string_split(k, ' ')))"
    return f"""
SELECT row_id, entry_id, score, {_L4} FROM (
  SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, entry_id) AS rn FROM (
    SELECT row_id, entry_id, {_L4}, len(s) / least(len(t), len(e)) * list_sum(list_transform(s, lambda w: length(w)))
      AS score
    FROM (SELECT r.row_id, d.entry_id, d.product_line, d.kind, d.class1, d.class2, t, e, list_intersect(t, e) AS s
      FROM (SELECT row_id, hs_code, {_sig("string_split(clean_text, ' ')")} AS t FROM {rows}) r
      JOIN (SELECT *, {_sig(flat)} AS e FROM {dictionary}) d ON d.hs_code = r.hs_code
      WHERE list_has_any(t, e)) p) x) y WHERE rn = 1 AND score >= 0.5"""


def _weight_sql(high, high_weight: int, junk, word_weight: str) -> str:
    any_high = " OR ".join(f"contains(keyword, {q(t)})" for t in high)
    return (f"(CASE WHEN {any_high} THEN {high_weight} WHEN keyword IN {in_list(junk)} THEN 0 ELSE {word_weight} END)"
            "::DOUBLE")


def _no_label(e: str) -> str:
    return f"(CASE WHEN {e} IS NULL OR {e} IN {in_list(K.NULL_WORDS)} THEN '{K.NO_LABEL}' ELSE {e} END)"


def _keywords_sql(dictionary: str, with_hs: bool) -> str:
    text = " || ' | ' || ".join(_no_label(c) for c in K.LABEL_COLUMNS + (["hs_code"] if with_hs else []))
    return f"""SELECT entry_id, {_no_label('kind')} AS kind, {_no_label('hs_code')} AS entry_hs, {text} AS label_text,
    {sql_squeeze('k')} AS keyword, kw_pos
  FROM (SELECT *, unnest(keywords) AS k, generate_subscripts(keywords, 1) AS kw_pos FROM {dictionary}) x
  WHERE {sql_squeeze('k')} <> ''"""


def _hit_sql(rows: str, table: str) -> str:
    # no keyword of the fixtures has more than three words
    grams = sql_positioned_ngrams("w")
    return f"""SELECT g.row_id, g.hs_code, g.s.start AS start, g.s.stop AS stop, k.* FROM (
    SELECT row_id, hs_code, unnest({grams}) AS s FROM (
      SELECT row_id, hs_code, {sql_words('clean_text')} AS w FROM {rows}) a) g JOIN {table} k ON k.keyword = g.s.keyword"""


_CONSUME = """list_reduce(hits, lambda a, h: CASE WHEN len(list_filter(a, lambda k: k.start <= h[1].stop AND
  h[1].start <= k.stop)) > 0 THEN a ELSE a || h END, [])"""


def _decide_sql(rows: str, scored: str, threshold: float) -> str:
    return f"""
SELECT r.row_id, CASE WHEN score >= {threshold} THEN label_text END AS label_text, coalesce(score, 0.0)::DOUBLE AS score,
  CASE WHEN score >= {threshold} THEN 100.0 ELSE 0.0 END::DOUBLE AS confidence,
  CASE WHEN score >= {threshold} THEN 'auto_dictionary' ELSE 'review' END AS status
FROM {rows} r LEFT JOIN (
  SELECT row_id, score, CASE WHEN upper(trim(k1)) = 'LK' AND tnc IS NOT NULL THEN tnc ELSE t1 END AS label_text FROM (
    SELECT row_id, max(score) AS score, arg_min(label_text, pos) AS t1, arg_min(kind, pos) AS k1,
      arg_min(label_text, pos) FILTER (WHERE upper(trim(kind)) = 'NC') AS tnc
    FROM (SELECT *, max(score) OVER (PARTITION BY row_id) AS best FROM {scored} WHERE score > 0) x
    WHERE score = best GROUP BY row_id) y) z USING (row_id)"""


def weighted_ctes(name: str, rows: str, dictionary: str, use_hs: bool) -> None:
    weight = _weight_sql(K.HIGH_VALUE_TERMS, 25, K.JUNK_TERMS, "len(string_split(keyword, ' ')) ** 2")
    cte(f"{name}_kw", (dictionary,), f"""
SELECT *, {weight} AS weight FROM (
  SELECT * FROM ({_keywords_sql(dictionary, True)}) t
  QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY entry_id DESC) = 1) u""")
    code = (f"string_split(CASE WHEN trim(hs_code) NOT IN {in_list([*K.NULL_WORDS, K.NO_LABEL])} THEN trim(hs_code) END, "
            "'.')[1]")
    scaled = (f"CASE WHEN length({code}) >= 4 AND entry_hs <> '{K.NO_LABEL}' AND length(entry_hs) >= 4 AND "
              f"({code})[1:4] <> entry_hs[1:4] THEN weight / 10.0 ELSE weight END") if use_hs else "weight"
    cte(f"{name}_kept", (rows, f"{name}_kw"), f"""
SELECT row_id, unnest(kept) AS hit, generate_subscripts(kept, 1) AS pos FROM (
  SELECT row_id, {_CONSUME} AS kept FROM (
    SELECT row_id, list([{{'start': start, 'stop': stop, 'entry_id': entry_id, 'kind': kind, 'label_text': label_text,
        'weight': {scaled}}}] ORDER BY length(keyword) DESC, start) AS hits
    FROM ({_hit_sql(rows, name + '_kw')}) h GROUP BY row_id) a) b""")
    cte(f"{name}_scored", (f"{name}_kept",), f"""
SELECT row_id, hit.entry_id AS entry_id, any_value(hit.kind) AS kind, any_value(hit.label_text) AS label_text,
  round(sum(hit.weight), 6) AS score, min(pos) AS pos FROM {name}_kept GROUP BY ALL""")
    cte(name, (rows, f"{name}_scored"), _decide_sql(rows, f"{name}_scored", K.WEIGHTED_THRESHOLD))


def masked_ctes(name: str, rows: str, dictionary: str, high_value) -> None:
    weight = _weight_sql(high_value, 20, K.MASKED_JUNK_TERMS, "len(string_split(keyword, ' '))")
    cte(f"{name}_kw", (dictionary,), f"""
SELECT *, {weight} AS weight FROM (SELECT entry_id, keyword, min(kw_pos) AS kw_pos, any_value(kind) AS kind,
  any_value(label_text) AS label_text FROM ({_keywords_sql(dictionary, False)}) t GROUP BY entry_id, keyword) u""")
    cte(f"{name}_scored", (rows, f"{name}_kw"), f"""
SELECT row_id, entry_id AS pos, kind, label_text,
  list_sum(list_transform(list_distinct(list_transform(kept, lambda k: {{'p': k.kw_pos, 'w': k.weight}})), lambda z: z.w))
    AS score
FROM (SELECT row_id, entry_id, kind, label_text, {_CONSUME} AS kept FROM (
    SELECT row_id, entry_id, any_value(kind) AS kind, any_value(label_text) AS label_text,
      list([{{'start': start, 'stop': stop, 'kw_pos': kw_pos, 'weight': weight}}]
        ORDER BY length(keyword) DESC, kw_pos, start) AS hits
    FROM ({_hit_sql(rows, name + '_kw')}) h GROUP BY row_id, entry_id) a) b""")
    cte(f"{name}_able", (f"{name}_scored",), f"SELECT * FROM {name}_scored WHERE score >= {K.MASKED_THRESHOLD}")
    cte(name, (rows, f"{name}_able"), _decide_sql(rows, f"{name}_able", K.MASKED_THRESHOLD))


def bayes_ctes(name: str, train: str, rows: str, group: tuple[str, ...] = ("hs_code",)) -> None:
    """``<name>`` = row_id, label, confidence, n_labels of a Naive Bayes trained on ``train(group, label, clean_text)``."""
    g = ", ".join(group)
    if f"{train}_nb_grams" not in CTES:
        cte(f"{train}_nb_grams", (train,), f"""SELECT {g}, label, gram, count(*)::BIGINT AS c
FROM (SELECT {g}, label, unnest({sql_ngrams('w')}) AS gram FROM (SELECT {g}, label, {sql_words('clean_text')} AS w
      FROM {train}) a) b GROUP BY ALL""")
        cte(f"{train}_nb_classes", (train, f"{train}_nb_grams"), f"""
SELECT l.*, (sum(n_label) OVER (PARTITION BY {g}))::BIGINT AS n_group, coalesce(n_tokens, 0)::BIGINT AS n_tokens,
  coalesce(vocab, 0)::BIGINT AS vocab
FROM (SELECT {g}, label, count(*)::BIGINT AS n_label FROM {train} GROUP BY ALL) l
LEFT JOIN (SELECT {g}, label, sum(c) AS n_tokens FROM {train}_nb_grams GROUP BY ALL) t USING ({g}, label)
LEFT JOIN (SELECT {g}, count(DISTINCT gram) AS vocab FROM {train}_nb_grams GROUP BY ALL) v USING ({g})""")
    gram_deps = (rows, f"{train}_nb_grams", f"{train}_nb_classes")
    cte(f"{name}_tf", gram_deps, f"""SELECT row_id, {g}, gram, count(*)::BIGINT AS tf
FROM (SELECT row_id, {g}, unnest({sql_ngrams('w')}) AS gram FROM (SELECT row_id, {g}, {sql_words('clean_text')} AS w
      FROM {rows}) a) b GROUP BY ALL""")
    cte(f"{name}_scores", (f"{name}_tf", *gram_deps), f"""
SELECT row_id, label, round(ln(n_label / n_group) + coalesce(s.w, 0)
    - coalesce(k.known, 0) * ln(greatest(n_tokens + vocab, 1)), 9) AS score
FROM (SELECT row_id, {g} FROM {rows}) r JOIN {train}_nb_classes c USING ({g})
LEFT JOIN (SELECT row_id, sum(tf) AS known FROM {name}_tf JOIN (SELECT DISTINCT {g}, gram FROM {train}_nb_grams) v
           USING ({g}, gram) GROUP BY row_id{', ' + g if len(group) > 1 else ''}) k USING (row_id)
LEFT JOIN (SELECT row_id, label, sum(tf * ln(c + 1)) AS w FROM {name}_tf JOIN {train}_nb_grams USING ({g}, gram)
           GROUP BY row_id, label) s USING (row_id, label)""")
    cte(name, (f"{name}_scores",), f"""
SELECT row_id, arg_min(label, (-score, label)) AS label, 1 / sum(exp(score - best)) AS confidence,
  count(*)::INT AS n_labels
FROM (SELECT *, max(score) OVER (PARTITION BY row_id) AS best FROM {name}_scores) t GROUP BY row_id""")


cte("gt_train", ("ground_truth",), f"SELECT hs_code, {LABEL4} AS label, clean_text FROM ground_truth")
bayes_ctes("nb_new", "gt_train", "new_rows")
weighted_ctes("eval_b", "new_rows", "dictionary_b", use_hs=True)
cte("eval_phrase", ("new_rows", "dictionary"), phrase_sql("new_rows"))
cte("eval_overlap", ("new_rows", "dictionary"), overlap_sql("new_rows"))
cte("evaluation", ("new_rows", "eval_phrase", "eval_overlap", "eval_b", "nb_new"), f"""
SELECT *, coalesce(dict_label, ai_label) AS predicted_label FROM (
  SELECT r.row_id, r.hs_code, r.product_name, r.product_line, r.kind, r.class1, r.class2, r.source_file,
    coalesce(p.product_line || ' | ' || p.kind || ' | ' || p.class1 || ' | ' || p.class2,
             o.product_line || ' | ' || o.kind || ' | ' || o.class1 || ' | ' || o.class2) AS dict_label,
    b.label_text AS dict_b_label, n.label AS ai_label, round(n.confidence * 100, 4) AS ai_confidence
  FROM new_rows r LEFT JOIN eval_phrase p USING (row_id) LEFT JOIN eval_overlap o USING (row_id)
  LEFT JOIN eval_b b USING (row_id) LEFT JOIN nb_new n USING (row_id)) t""")
TRUTH = "(" + " || ' | ' || ".join(sql_label_part(c, c) for c in K.LABEL_COLUMNS) + ")"


def right_sql(prediction: str) -> str:
    return f"coalesce({prediction} IS NOT NULL AND {sql_normalize_combined(prediction)} = {TRUTH}, false)"


cte("judged", ("evaluation",), f"""SELECT *, {TRUTH} AS truth, {right_sql('dict_label')} AS first_right,
  {right_sql('dict_b_label')} AS second_right, {right_sql('ai_label')} AS model_right,
  {right_sql('predicted_label')} AS predicted_right, {sql_normalize_combined('predicted_label')} AS predicted
FROM evaluation""")
cte("confusion", ("judged",), "SELECT truth, predicted, count(*)::BIGINT AS n FROM judged GROUP BY ALL")

# --- cascade --------------------------------------------------------------------------------------------------------
cte("open0", ("rows_", "ground_truth"), """SELECT r.* FROM rows_ r LEFT JOIN (SELECT hs_code, clean_text, 1 AS hit
FROM ground_truth) g USING (hs_code, clean_text) WHERE hit IS NULL""")
cte("c_phrase", ("open0", "dictionary"), phrase_sql("open0"))
cte("open1", ("open0", "c_phrase"), "SELECT * FROM open0 WHERE row_id NOT IN (SELECT row_id FROM c_phrase)")
cte("c_overlap", ("open1", "dictionary"), overlap_sql("open1"))
cte("open2", ("open1", "c_overlap"), "SELECT * FROM open1 WHERE row_id NOT IN (SELECT row_id FROM c_overlap)")
bayes_ctes("c_bayes", "gt_train", "open2")
_M = [f"coalesce(string_split(label, ' | ')[{i + 1}], '')" for i in range(4)]
cte("cascade", ("rows_", "ground_truth", "c_phrase", "c_overlap", "open2", "c_bayes"), f"""
SELECT r.row_id, l.product_line, l.kind, l.class1, l.class2, l.status, l.confidence, r.hs_code, r.source_file,
  r.clean_text, r.product_name
FROM rows_ r JOIN (
  SELECT row_id, g.product_line, g.kind, g.class1, g.class2, 'auto_history' AS status, 1.0::DOUBLE AS confidence
  FROM rows_ JOIN ground_truth g USING (hs_code, clean_text)
  UNION ALL SELECT row_id, {_L4}, 'auto_dictionary', 1.0 FROM c_phrase
  UNION ALL SELECT row_id, {_L4}, 'auto_dictionary', 1.0 FROM c_overlap
  UNION ALL SELECT row_id, CASE WHEN ok THEN {_M[0]} ELSE '' END, CASE WHEN ok THEN {_M[1]} ELSE '' END,
    CASE WHEN ok THEN {_M[2]} ELSE '' END, CASE WHEN ok THEN {_M[3]} ELSE '' END,
    CASE WHEN n_labels = 1 THEN 'auto_single' WHEN ok THEN 'auto_model' ELSE 'review' END, coalesce(confidence, 0.0)
  FROM (SELECT *, coalesce(n_labels = 1 OR confidence >= 0.85, false) AS ok FROM open2 LEFT JOIN c_bayes USING (row_id)) b
) l USING (row_id)""")
