"""The registered query of each operator, with the parameters of production, and the SQL it is checked with where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cargoline.llm import licenses

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register the decorated ``(spark, sf_dir) -> DataFrame``."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op3_bpe")
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from cargoline.llm import bpe

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = bpe.Vocabulary.load(public_tokenizers.path("word_bpe_49k.json"))
    return bpe.encode_decode(docs, vocabulary, outputs=("n_tokens", "ids_sha256", "decoded_sha256")).drop("text")


@query("op2_pii")
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cargoline.llm import pii

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    columns = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")
    return pii.find(docs, outputs=columns).drop("text")


@query("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cargoline.llm import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def language_model(docs: DataFrame):
    """Learned from the documents that are not held out."""
    from cargoline.llm import langid

    return langid.learn(docs.where(~langid.held_out(docs["doc_id"]) & docs["doc_id"].isNotNull()))


@query("op5_language")
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cargoline.llm import langid

    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", langid.held_out(docs["doc_id"]).alias("held_out"))
    return langid.predict(rows, language_model(docs)).drop("text")


#: DuckDB: the words of a text.
WORDS_SQL = r"""list_filter(regexp_split_to_array(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"""


@query("op7_decontamination", sql=f"""
WITH d AS (SELECT doc_id, {WORDS_SQL.format('text')} AS w FROM documents),
b AS (SELECT item_id, {WORDS_SQL.format('text')} AS w FROM benchmark),
n AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM n)),
lengths AS (SELECT DISTINCT k FROM n),
places AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS phrase
           FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, lengths WHERE len(w) >= k)),
hits AS (SELECT doc_id, item_id, s, k FROM places JOIN windows USING (k, phrase)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',') AS items FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)""")
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cargoline.llm import decontaminate

    rows = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return rows.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


@query("op10_licenses", sql=licenses.oracle_sql(WORDS_SQL))
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op6_warc")
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cargoline.llm import warc

    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SHARD_BYTES = 1 << 20


@query("op8_sharding", sql=f"""
WITH d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents),
p AS (SELECT doc_id, n_bytes, depth, h >> (60 - depth) AS prefix FROM (SELECT *, unnest(range(0, 41)) AS depth FROM d)),
s AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM p GROUP BY depth, prefix),
best AS (SELECT doc_id, n_bytes, min((depth, prefix, shard_bytes, shard_rows)) AS b FROM p JOIN s USING (depth, prefix)
         WHERE shard_bytes <= {SHARD_BYTES} OR shard_rows = 1 GROUP BY doc_id, n_bytes)
SELECT doc_id, n_bytes, CASE WHEN b[1] = 0 THEN '' ELSE lpad(bin(b[2]), b[1]::INTEGER, '0') END AS shard, b[1]::INTEGER AS depth, b[3] AS shard_bytes, b[4] AS shard_rows
FROM best""")
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents written as shards; sizes are those of the written texts, summed over the written files."""
    from cargoline.llm import sharding
    from cargoline.session import scratch_path

    written = sharding.shard(table(spark, sf_dir, "documents"), "doc_id", F.octet_length("text"), SHARD_BYTES, scratch_path(spark, "shards"))
    rows = written.select("doc_id", "shard", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    sizes = rows.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_rows"))
    return rows.join(sizes, "shard").select("doc_id", "n_bytes", "shard", F.length("shard").alias("depth"), "shard_bytes", "shard_rows")


@query("op9_embeddings")
def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cargoline.llm import embed
    from cargoline.session import materialize

    rows = table(spark, sf_dir, "embeddings")
    result = materialize(embed.near_duplicates(rows), "embedding-links")
    found, _ = embed.recall(rows, result)
    if found < 0.9:
        raise RuntimeError(f"the audit found a recall of {found:.3f}")
    return result


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cargoline.llm import suffix

    return suffix.remove(table(spark, sf_dir, "documents"))


#: DuckDB: CRC-32 from its polynomial; ``crc_table`` has the values of single bytes, ``crc({})`` is that of a text's UTF-8 bytes.
CRC_TABLE_SQL = """bits AS (SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) r(i)
    UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8)"""


def crc_sql(text: str) -> str:
    places = f"list_transform(range(1, strlen({text}) * 2, 2), lambda i: ('0x' || substr(hex({text}), i, 2))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {places}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


@query("op11_spelling", sql=rf"""
WITH RECURSIVE {CRC_TABLE_SQL},
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (SELECT doc_id::VARCHAR || ':' || run AS k, run, count(*) AS m FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, m, {crc_sql('k')} AS h FROM counted, crc_table),
words AS (SELECT word, sum(m)::BIGINT AS n FROM (SELECT m, CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word FROM hashed)
          WHERE length(word) >= 7 GROUP BY word HAVING sum(m) >= 2),
cuts AS (SELECT word, n, length(word) AS l, i, left(word, i) || substr(word, i + 2) AS cut FROM (SELECT *, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.l = b.l AND a.word <> b.word
         UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word
         UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word),
best AS (SELECT word, count(*) AS n_near, min((-m, other)) AS s FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -s[1] >= 10 * n THEN s[2] END AS form, CASE WHEN -s[1] >= 10 * n THEN -s[1] END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, 0 AS step FROM forms UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL),
roots AS (SELECT word, max((step, root))[2] AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM forms JOIN roots USING (word)""")
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cargoline.llm import spelling

    return spelling.variants(table(spark, sf_dir, "documents"))


@query("op12_html")
def op12_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cargoline.llm import html

    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query("op13_prefixes", sql=rf"""
WITH RECURSIVE {CRC_TABLE_SQL},
own AS (SELECT conv_id AS c, list(r ORDER BY turn NULLS FIRST, r) AS turns
        FROM (SELECT conv_id, turn, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS r FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
ids AS (SELECT c, c::VARCHAR AS k, turns FROM own),
hashed AS (SELECT c, turns, {crc_sql('k')} % 4 AS h FROM ids, crc_table),
rebuilt AS (SELECT o.c, list_concat(coalesce(s.turns, [])[1:h], o.turns[h + 1:]) AS seq FROM hashed o LEFT JOIN own s ON s.c = o.c - ((o.c % 20) + 20) % 20),
rows AS (SELECT c, len(seq) AS l, d, seq[1:d] AS prefix FROM (SELECT c, seq, unnest(range(len(seq) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT d, prefix, min(c) AS conv_id, count(*) AS n_convs, list(c ORDER BY c) FILTER (l = d) AS ends FROM rows GROUP BY d, prefix),
costs AS (SELECT *, (n_convs - 1) * CASE WHEN d = 0 THEN 0 ELSE len(list_filter(regexp_split_to_array(prefix[d].text, '[ 	-
]+'), lambda w: w <> '')) END AS cost FROM nodes),
kids AS (SELECT prefix[1:d - 1] AS up, d - 1 AS ud, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2),
full_nodes AS (SELECT c.*, coalesce(n_children, 0) AS n_children FROM costs c LEFT JOIN kids k ON k.ud = c.d AND k.up = c.prefix),
above AS (SELECT unnest(range(d + 1)) AS ud, prefix, cost, n_children FROM full_nodes),
below AS (SELECT ud, prefix[1:ud] AS up, sum(cost) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM above GROUP BY 1, 2)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n.n_children::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves,
       b.saved_tokens::BIGINT AS saved_tokens, sha256(array_to_string(coalesce(n.ends, []), ',')) AS ends_sha256
FROM full_nodes n JOIN below b ON b.ud = n.d AND b.up = n.prefix LEFT JOIN nodes p ON p.d = n.d - 1 AND p.prefix = n.prefix[1:n.d - 1]""")
def op13_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cargoline.llm import prefixes

    return prefixes.trie(table(spark, sf_dir, "conversations"))
