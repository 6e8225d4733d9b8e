"""Decontamination, licences, archives, shards, embeddings: each against a plain version, with the odd inputs."""

import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cargoline.llm import decontaminate, embed, licenses, sharding, warc, words

ALPHABET = "abcdefghij"


def words_of(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c if c in "0123456789abcdefghijklmnopqrstuvwxyz" or ord(c) > 127 else " " for c in t or "").split(" ")


def plain_words(t):
    return [w for w in words_of(t) if w]


def test_words(spark):
    texts = [None, "", "--", "Ab c-É9x_y\x00z", "ÀB ß", " lead", "trail ", "x" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", words.words(F.col("text")).alias("w"))
    assert {r.i: r.w for r in df.collect()} == {k: plain_words(t) for k, t in enumerate(texts)}


# --- decontamination ------------------------------------------------------------------------------------------------

def hits(texts, items, window):
    out = {}
    for i, t in enumerate(texts):
        w, gone, found = plain_words(t), set(), set()
        for item, u in items:
            u = plain_words(u)
            n = min(window, len(u))
            for s in range(len(u) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == u[s : s + n]:
                        gone |= set(range(p, p + n))
                        found.add(str(item))
        out[i] = (len(w), len(gone), len(found), sorted(found), bool(gone))
    return out


@pytest.mark.parametrize("broadcast_words", [10**6, 0])
def test_decontamination_equals_brute_force(spark, broadcast_words):
    rnd = random.Random(4)
    text = lambda n: " ".join(rnd.choice(ALPHABET) + rnd.choice(["", "x"]) for _ in range(n))
    items = [(k, text(n)) for k, n in enumerate((3, 4, 5, 9, 12, 1, 2))] + [(7, None), (8, "..."), (9, "a a a a a a"), (9, "b b b b")]
    texts = [None, "", "!", "a", "a " * 3000] + [text(rnd.randint(1, 60)) for _ in range(30)] + [f"{text(3)}, {items[rnd.randrange(7)][1].upper()}\n{text(2)}" for _ in range(20)]
    docs = spark.createDataFrame([(k, t, "own") for k, t in enumerate(texts)], "doc_id int, text string, words string")
    tests = spark.createDataFrame([(k, t, "own") for k, t in items], "item_id int, text string, term string")
    got = decontaminate.decontaminate(docs, tests, window=4, broadcast_words=broadcast_words).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated) for r in got} == hits(texts, items, 4)


def test_decontamination_odd_rows(spark):
    docs = spark.createDataFrame([(None, "one two three"), (1, "one two three"), (1, "one two three"), (1, "four")], "doc_id int, text string")
    tests = spark.createDataFrame([(1, "Two three")], "item_id int, text string")
    got = decontaminate.decontaminate(docs, tests).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit) for r in got) == [("1", 1, 0), ("1", 3, 2), ("1", 3, 2), ("None", 3, 2)]
    assert decontaminate.decontaminate(docs.where("false"), tests).count() == 0
    assert [r.n_hit for r in decontaminate.decontaminate(docs, tests.where("false")).collect()] == [0, 0, 0, 0]


def test_near(spark):
    docs = spark.createDataFrame([(1, "a x x b y c"), (2, "a x x x x x b c"), (3, "c b a"), (4, None)], "doc_id int, text string")
    got = decontaminate.near(docs, ["a", "b", "c"], 6).collect()
    assert sorted((r.id, r["at"]) for r in got) == [(1, 0), (3, 2)]
    assert decontaminate.near(docs, ["a", "zz"], 6).count() == 0 and decontaminate.near(docs, ["x"], 1).count() == 7


def test_decontamination_of_a_long_item(spark):
    """The index of an item grows in proportion to its words: an entry holds a window's surroundings, not the item."""
    words_ = [f"w{k % 700}x{k // 31}" for k in range(20_000)]
    docs = spark.createDataFrame([(1, " ".join(words_[5_000:5_300]) + " other " + " ".join(words_[9:18])), (2, "w0x0 other")], "doc_id bigint, text string")
    tests = spark.createDataFrame([("long", " ".join(words_))], "item_id string, text string")
    items = decontaminate.materialize(decontaminate._items(tests, "item_id", "text", 10), "items")
    counts = items.select(F.explode("item").alias("term")).distinct().withColumn("n", F.lit(1))
    entries = decontaminate._entries(items, counts)
    assert entries.agg(F.max(F.size("item"))).first()[0] == 19 and 0 < entries.count() <= 20_000
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.decontaminate(docs, tests).collect()}
    assert got == {1: (300, ["long"]), 2: (0, [])}


# --- licences -------------------------------------------------------------------------------------------------------

def test_licences(spark):
    notice = next(t.words for t in licenses.TEMPLATES if t.label == "mit" and not t.exact)
    changed = notice.replace("free of charge", "entirely free of charge").replace("person", "body")
    texts = [None, "", "mit", "Released under the MIT License. MIT license", "CC BY-NC 4.0", "GNU General\nPublic License, Apache License", notice, changed, "permission is hereby", "mit licenses", "x " * 30_000 + "mit license"]
    docs = spark.createDataFrame([(k, t, "own") for k, t in enumerate(texts)], "doc_id int, text string, label string")
    got = {r.doc_id: (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in licenses.scan(docs).collect()}
    nothing = (0, None, None, "", "")
    assert got == {0: nothing, 1: nothing, 2: nothing, 3: (2, 3, 5, "mit", "mit"), 4: (1, 0, 0, "cc-by", "cc-by,cc-by-nc"), 5: (2, 0, 4, "apache,gpl", "apache,gpl"),
                   6: (0, None, None, "", "mit"), 7: (0, None, None, "", "mit"), 8: nothing, 9: nothing, 10: (1, 30_000, 30_000, "mit", "mit")}
    assert licenses.scan(docs.where("false")).count() == 0
    twice = spark.createDataFrame([(1, "mit license"), (1, "mit license"), (1, "x"), (None, "mit license")], "doc_id int, text string")
    assert sorted((str(r.doc_id), r.n_base) for r in licenses.scan(twice).collect()) == [("1", 0), ("1", 1), ("1", 1), ("None", 1)]


# --- archives -------------------------------------------------------------------------------------------------------

def test_archive_round_trip(spark):
    html = ["<p>a</p>", "<p>a</p>", None, "", "é\r\n\r\n☃", "x" * 300_000, "<p>a</p>", "b"]
    ids = [5, 2, 7, 3, 1, 8, 2, None]
    url = ["http://x/\r\ny z", None, "u", "", "v", "w", "http://x", "k"]
    pages = spark.createDataFrame([(i, u, h, "own") for i, u, h in zip(ids, url, html)], "page_id bigint, url string, html string, digest string")
    got = warc.round_trip(pages).collect()
    want = []
    for i, h in zip(ids, html):
        p = (h or "").encode()
        first = min([j for j, g in zip(ids, html) if (g or "").encode() == p and j is not None], default=i)
        want.append((str(i), len(p), warc.digest(p), "response" if first == i else "revisit", None if first == i else first))
    assert sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    assert {r.html for r in got if r.record_type == "response"} == {"<p>a</p>", "", "é\r\n\r\n☃", "x" * 300_000, "b"}
    assert warc.round_trip(pages.where("false")).count() == 0
    assert {r.record_type for r in warc.round_trip(pages, least=100).collect()} == {"response"}


@pytest.mark.parametrize("zip64", [False, True])
def test_packages_are_plain_zip_files(zip64):
    data = warc.package([b"one", b"three"], zip64)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.read(warc.RECORDS) == b"onethree" and z.read(warc.INDEX) == b"0 3\n3 5\n"
    members = warc.central_directory(lambda at, n: data[at : at + n], len(data))
    assert [data[(s := warc.member_start(lambda at, n: data[at : at + n], m)) : s + m.size] for m in members] == [b"onethree", b"0 3\n3 5\n"]


def test_central_directory_of_other_writers():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = b"PK\5\6 in a comment"
        for k in range(70_000):  # more members than the plain count holds
            z.writestr(zipfile.ZipInfo(f"{k}"), b"")
        z.writestr(zipfile.ZipInfo("last"), b"payload")
    data = out.getvalue()
    read = lambda at, n: data[at : at + n]
    members = warc.central_directory(read, len(data))
    assert len(members) == 70_001 and read(warc.member_start(read, members[-1]), members[-1].size) == b"payload"
    with pytest.raises(ValueError, match="no end"):
        warc.central_directory(lambda at, n: b"x" * n, 500)


# --- shards ---------------------------------------------------------------------------------------------------------

def test_shards_fit_and_only_large_buckets_split(spark):
    rnd = random.Random(6)
    rows = [(k, rnd.randint(0, 900), "own") for k in range(400)] + [(None, 5, "own"), (1000, None, "own"), (1001, 9000, "own")] + [(77, 100, "own")] * 300
    table = spark.createDataFrame(rows, "key bigint, size bigint, depth string")
    got = sharding.assign(table, "key", F.col("size"), 4000).collect()
    assert len(got) == len(rows) and sorted(str(r.key) for r in got) == sorted(str(r[0]) for r in rows)
    sums: dict = {}
    for r in got:
        sums.setdefault(r.shard, []).append(r.n_bytes)
        assert len(r.shard) == r.depth
    assert all((sum(v), len(v)) == (r.shard_bytes, r.shard_rows) for r in got for v in [sums[r.shard]])
    assert all(sum(v) <= 4000 or len(v) == 1 for v in sums.values())
    for s in sums:  # no bucket is split without need, and no shard is inside another
        parent = [v for t, v in sums.items() if t.startswith(s[:-1])]
        assert not s or sum(map(sum, parent)) > 4000
        assert not any(t != s and t.startswith(s) for t in sums)
    assert sharding.assign(table.where("false"), "key", F.col("size"), 10).count() == 0
    assert {r.shard for r in sharding.assign(table, "key", F.col("size"), 10**9).collect()} == {""}


def test_written_shards_hold_every_row_once(spark, tmp_path):
    rnd = random.Random(7)
    texts = [None, "", "\u00e9" * 3000] + ["".join(rnd.choices(ALPHABET, k=rnd.randint(0, 400))) for _ in range(300)]
    rows = [(k if k % 9 else None, t, "own") for k, t in enumerate(texts)] + [(5, "same", "own")] * 40
    df = spark.createDataFrame(rows, "key bigint, text string, shard string")
    for limit, name in ((2000, "cut"), (10**9, "whole")):
        path = str(tmp_path / name)
        back = sharding.shard(df, "key", F.octet_length("text"), limit, path).collect()
        assert sorted(map(repr, ((r.key, r.text) for r in back))) == sorted(map(repr, ((k, t) for k, t, _ in rows)))
        sums: dict = {}
        for r in back:
            sums.setdefault(r.shard, []).append(len((r.text or "").encode()))
        assert all(sum(v) <= limit or len(v) == 1 for v in sums.values())
        folders = [f for f in (tmp_path / name).iterdir() if f.is_dir()]
        assert len(folders) == len(sums) and all(len(list(f.glob("*.parquet"))) == 1 for f in folders)
    assert set(sums) == {""}
    assert sharding.shard(df.where("false"), "key", F.octet_length("text"), 10, str(tmp_path / "empty")).count() == 0


# --- embeddings -----------------------------------------------------------------------------------------------------

def linked(rows, threshold=0.98):
    good = [(i, np.array(e, dtype=np.float64), l) for i, e, l in rows if i is not None and l is not None and e is not None and None not in e and np.isfinite(e).all() and any(e)]
    n = len(good)
    cos = lambda a, b: len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold
    pairs = [(x, y) for x in range(n) for y in range(x) if good[x][2] == good[y][2] and cos(good[x][1], good[y][1])]
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    count = [0] * n
    for x, y in pairs:
        count[x] += 1
        count[y] += 1
        parent[root(x)] = root(y)
    least: dict = {}
    for x in range(n):
        least[root(x)] = min(least.get(root(x), good[x][0]), good[x][0])
    return {good[x][0]: (count[x], least[root(x)]) for x in range(n)}


@pytest.mark.parametrize("cell_size", [1024, 24])
def test_embeddings(spark, cell_size):
    rnd = np.random.default_rng(8)
    rows, k = [], 0
    for family in range(30):
        base = rnd.normal(size=16)
        for _ in range(8):
            rows.append((k, (base + rnd.normal(size=16) * 0.05).astype(np.float32).tolist(), family % 3))
            k += 1
    dense = rnd.normal(size=16)
    for _ in range(90):
        rows.append((k, (dense + rnd.normal(size=16) * 0.02).astype(np.float32).tolist(), 1))
        k += 1
    rows += [(k + 1, rows[0][1], 0), (k + 2, rows[0][1], 1), (k + 3, None, 1), (k + 4, [0.0] * 16, 1), (k + 5, [float("nan")] + [1.0] * 15, 1), (k + 6, [None] + [1.0] * 15, 1),
             (k + 7, [1.0], 1), (k + 8, [2.0], 1), (k + 9, rows[0][1], None), (k + 10, [float("inf")] + [1.0] * 15, 0), (k + 11, [], 0)]
    table = spark.createDataFrame([(*r, "own") for r in rows], "vec_id bigint, embedding array<float>, label int, node string")
    result = embed.near_duplicates(table, cell_size=cell_size)
    got = {r.vec_id: r for r in result.collect()}
    want = linked(rows)
    assert len(got) == len(rows)
    total = sum(n for n, _ in want.values())
    assert sum(min(n, got[i].n_links) for i, (n, _) in want.items()) >= 0.9 * total and all(got[i].n_links <= n for i, (n, _) in want.items())
    assert np.mean([got[i].component_id == c for i, (_, c) in want.items()]) > 0.95
    assert all((got[r[0]].n_links, got[r[0]].component_id, got[r[0]].kept) == (0, r[0], True) for r in rows if r[0] not in want)
    share, judged = embed.recall(table, result)
    assert share >= 0.9 and judged > 0


def test_dense_cell_with_overlap(spark, monkeypatch):
    """A dense family that shares nodes with a small cell: every link is counted once at both ends, also within one block."""
    rnd = np.random.default_rng(2)
    base = rnd.normal(size=16)
    rows = [(k, (base + rnd.normal(size=16) * (0.03 if k < 60 else 0.14)).astype(np.float32).tolist(), 1) for k in range(80)]

    def cells(points, cell_size):
        def named(cell, where, first):
            return points.where(where).select(F.lit(cell).alias("cell"), "node", "copies", "embedding", F.lit(first).alias("first"))

        return (named("1:16/1", "node >= 60", True).unionByName(named("1:16/1", "node BETWEEN 50 AND 59", False)),
                named("1:16/0", "node < 60", True).unionByName(named("1:16/0", "node >= 60", False)))

    monkeypatch.setattr(embed, "_cells", cells)
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed.near_duplicates(table, cell_size=24).collect()}
    want = linked(rows)
    assert got == want and len({n for n, _ in want.values()}) > 5


def test_embeddings_are_judged_in_their_own_precision(spark):
    """Components that single precision would round onto the threshold: the cosines are 0.98 less or more 1e-9."""
    def beside(cosine):
        return [cosine, float(np.sqrt(1 - cosine * cosine))]

    rows = [(1, [1.0, 0.0], 1), (2, beside(0.98 - 1e-9), 1), (3, [1.0, 0.0], 2), (4, beside(0.98 + 1e-9), 2)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embed.near_duplicates(table).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 1}


def test_recall_leaves_copies_out(spark):
    rows = [(k, [1.0, 0.0], 1) for k in range(50)] + [(50, [1.0, 0.01], 1), (51, [0.0, 1.0], 1)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    result = embed.near_duplicates(table)
    assert embed.recall(table, result) == (1.0, 2)
    lost = result.withColumn("n_links", F.when(F.col("vec_id") < 50, 49).otherwise(0).cast("bigint"))  # copies alone
    assert embed.recall(table, lost) == (0.0, 2)
    assert embed.recall(table.where("vec_id < 50"), result) == (1.0, 0)


def test_embeddings_without_rows_or_ids(spark):
    table = spark.createDataFrame([(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (4, [1.0, 0.0], 1)], "vec_id bigint, embedding array<float>, label int")
    got = embed.near_duplicates(table).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == [("4", 1, "4", True), ("4", 1, "4", True), ("None", 0, "None", False)]
    assert embed.near_duplicates(table.where("false")).count() == 0
