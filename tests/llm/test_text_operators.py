"""Encoding, personal data, language, fingerprints, repeated passages: each against a plain version, with the odd inputs."""

import hashlib
import random
import time
import re

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from cargoline.llm import bpe, graph, langid, pii, rolling, simhash, suffix

ODD = [None, "", " \n\t ", "a", "A", "Ünïcode ÉÀ ß", "x" * 300_000, "word " * 40_000, "☃ 漢字 🙂", "\x00\x1c\x85 z", "same text here now", "same text here now"]
SCHEMA = "doc_id bigint, text string, lang string, score string, n_tokens string"


def docs(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", "own", "kept") for i, t in zip(ids, texts)], SCHEMA)


# --- encoding -------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(public_tokenizers.path("word_bpe_49k.json"))


def test_encoding_equals_the_library(spark, vocabulary):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rnd = random.Random(5)
    letters = " aAbBeEtThHßéÉΣς'’.,!?-_#\n\t\x1f\x85\xa0²½٣İ🙂漢é"
    texts = ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 80))) for _ in range(400)] + [
        "<|endoftext|>x<|startoftext|> y", "aaaa" * 9 + "====----", "I'll we're 'S don'T"]
    got = bpe.encode_decode(docs(spark, texts), vocabulary, outputs=("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"))
    assert got.columns[-5:] == ["n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"] and "score" in got.columns
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == len(texts)
    for k, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want = " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)
        assert (rows[k].ids, rows[k].decoded, rows[k].n_tokens) == (*want, len(ids)), repr((t or "")[:60])
        assert (rows[k].ids_sha256, rows[k].decoded_sha256) == tuple(hashlib.sha256(x.encode()).hexdigest() for x in want)
        assert vocabulary.decode(ids) == want[1]


def test_store_is_bounded_and_changes_nothing(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    vocabulary.store.clear()
    words = ["the", "thing", "things", "other"]
    vocabulary.learn(set(words[:2]))
    vocabulary.learn(set(words))
    assert all(w in vocabulary.store for w in words)
    vocabulary.store.clear()


# --- personal data --------------------------------------------------------------------------------------------------

def plain_by_patterns(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(int(x) if k % 2 == 0 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append((2, *m.span()))
    return sorted(out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.findall("[0-9]", m[0])) <= 15])


@pytest.mark.parametrize("letters", ["a@.b-1+ ", "0123456789 .-+()", "ab@@..1 ", "1.25 ", "4 41-1"])
def test_plain_spans_equal_the_patterns(letters):
    rnd = random.Random(9)
    for _ in range(4000):
        t = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 45)))
        assert sorted(pii.plain_spans(t)) == plain_by_patterns(t), t


@pytest.mark.parametrize("text, kind, found", [
    ("write john.doe at example dot com now", "email", "john.doe at example dot com"), ("j[at]x[dot]org!", "email", "j[at]x[dot]org"),
    ("bob (at) mail.example.org", "email", "bob (at) mail.example.org"), ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
    ("ｊｏｅ＠x．com ok", "email", "ｊｏｅ＠x．com"),
    ("call plus four nine one seven zero one two three four five six please", "phone", "plus four nine one seven zero one two three four five six"),
    ("ip one nine two dot one six eight dot zero dot one end", "ip", "one nine two dot one six eight dot zero dot one"),
    ("card 4111​1111 1111 1111 x", "card", "4111​1111 1111 1111"), ("first line\nj[at]x[dot]org", "email", "j[at]x[dot]org")])
def test_disguised_spans_map_back(text, kind, found):
    plain, more = pii.spans_of(text)
    assert (plain, [(pii.KINDS[k], text[a:b]) for k, a, b in more]) == ([], [(kind, found)])


def test_clean_texts_and_plain_spans_stay():
    for t in ("see you at example.com", "we met at point zero", "one two three", "", None, "at dot at dot"):
        assert pii.spans_of(t) == ([], [])
    t = "a@b.com and c[at]d.com"
    plain, more = pii.spans_of(t)
    assert pii.listed(sorted(plain + more)) == "email:0:7,email:12:22" and pii.redacted(t, plain + more) == "[EMAIL] and [EMAIL]"


@pytest.mark.parametrize("text, kind, found", [
    ("tel +49\u00a030\u00a01234567 now", "phone", "+49\u00a030\u00a01234567"),
    ("card 4111\u00a01111\u00a01111\u00a01111 x", "card", "4111\u00a01111\u00a01111\u00a01111"),
    ("call plus 49 30 1234567", "phone", "plus 49 30 1234567"), ("call plus49 30 1234567", "phone", "plus49 30 1234567"),
    ("host 192.one.168.two up", "ip", "192.one.168.two"), ("host 192.un.168.2 up", "ip", "192.un.168.2"),
    ('"un.un.un.un"', "ip", "un.un.un.un"), ("host 192.\u017fix.168.2 up", "ip", "192.\u017fix.168.2")])
def test_gate_lets_disguises_through(text, kind, found):
    plain, more = pii.spans_of(text)
    assert (plain, [(pii.KINDS[k], text[a:b]) for k, a, b in more]) == ([], [(kind, found)])


def test_gate_changes_nothing(monkeypatch):
    rnd = random.Random(5)
    words = [*pii._DIGIT_WORDS, *pii._AT_WORDS, *pii._DOT_WORDS, "plus", "Plus", "UN", "un", "f\u0131ve", "\u0130", "\u017fix"]
    odd = [chr(c) for c in rnd.sample(sorted(pii._TABLE), 40)] + list(pii._HIDDEN) + list(pii._MARKS)
    bits = ["192", "168", "49", "30", "1234567", "4111", "1111", "a", "bob", "com", "O1", "l", "i", "@", "+", "[at]", "(dot)", "{.}"]
    ends = [" ", " ", ".", "-", ",", "'", '"', "_", "", "\u00a0", "\n", "(", ")", "\t"]
    identifiers = ["+49 30 1234567", "192.168.1.2", "4111 1111 1111 1111", "bob@mail.example.com", "plus 49 30 1234567"]
    names = {str(d): [w for w, v in pii._DIGIT_WORDS.items() if v == str(d)] for d in range(10)}
    texts = []
    for _ in range(20000):
        texts.append("".join(rnd.choice(rnd.choice([words, bits, bits, odd])) + rnd.choice(ends) for _ in range(rnd.randint(1, 12))))
    for _ in range(20000):
        told = "".join(rnd.choice(names[c]) if c in names and rnd.random() < 0.1 else "\u00a0" if c == " " and rnd.random() < 0.3 else c for c in rnd.choice(identifiers))
        texts.append(rnd.choice(ends) + told.replace("+", rnd.choice(["+", "plus ", "plus"])) + rnd.choice(ends))
    gated = [pii.spans_of(t) for t in texts]
    monkeypatch.setattr(pii, "_suspect", lambda t: True)
    free = [pii.spans_of(t) for t in texts]
    assert [t for t, a, b in zip(texts, gated, free) if a != b] == [] and sum(bool(more) for _, more in free) > 1000


@pytest.mark.parametrize("run", [" ", "\t", "|", "l", "0", "1", ".", "1.", "(", "[ ", "+", "@", "a@", "o|", "one ", " at ", "dot ", "( at"])
def test_long_runs_take_linear_time(run):
    began = time.time()
    pii.spans_of("one " + run * (300_000 // len(run)) + " one a at b dot c")
    assert time.time() - began < 5


def test_long_digit_parts_are_no_addresses():
    zeros = "0" * 5_000
    assert pii.spans_of(f"1.2.3.{zeros}1")[0] == [(1, 0, 5007)]
    assert pii.spans_of(f"1.2.3.{zeros}256 1.2.3.{'9' * 5_000} 9.9.9.0")[0][-1][0] == 1
    assert len(pii.spans_of(f"1.2.3.{zeros}256 1.2.3.{'9' * 5_000} 9.9.9.0")[0]) == 1


def test_brackets_after_consumed_blanks():
    assert pii.spans_of("john (at)  (dot) [dot] one")[1] == pii.spans_of("john (at) (dot) [dot] one")[1]
    assert pii.listed(pii.spans_of("jo [at] ex  (dot) com")[1]) == "email:0:21"


def test_find_on_odd_rows(spark):
    texts = [*ODD, "+1 (743) 555-3824 a@b.co"]
    got = {r.doc_id: r for r in pii.find(docs(spark, texts), outputs=tuple(pii.OUTPUTS)).collect()}
    assert len(got) == len(texts) and got[0].redacted is None and got[0].spans == "" and got[12].redacted == "[PHONE] [EMAIL]"
    assert got[12].base_sha256 == hashlib.sha256(b"email:18:24,phone:0:17").hexdigest() and (got[12].n_email, got[12].n_phone, got[12].n_ip) == (1, 1, 0)
    assert pii.find(docs(spark, []), outputs=("spans",)).count() == 0


# --- language -------------------------------------------------------------------------------------------------------

def test_language(spark):
    rnd = random.Random(1)
    sounds = {"en": ["the", "th", "ing", "and", "er"], "de": ["sch", "ung", "ein", "der", "ß"], "fr": ["é", "eau", "que", "les", "oi"], "es": ["ción", "ñ", "ó", "que", "os"],
              "it": ["zione", "gli", "che", "della", "ù"]}
    rows = [(k, " ".join("".join(rnd.choice(sounds[l]) for _ in range(rnd.randint(1, 3))) for _ in range(40)), l) for k, l in enumerate(list(sounds) * 40)]
    table = spark.createDataFrame(rows + [(900, None, "en"), (901, "123 ...", "en"), (902, "untold", None)], "doc_id bigint, text string, lang string")
    out = langid.held_out(F.col("doc_id"))
    model = langid.learn(table.where(~out))
    got = langid.predict(table.withColumn("score", F.lit("x")), model).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 for r in got)
    told = {r.doc_id: r for r in got}
    assert all(told[i].lang_pred == langid.UNDETERMINED and told[i].score == 0 for i in (900, 901))
    tested = [r for r in table.where(out).collect() if r.doc_id < 900]
    assert tested and np.mean([told[r.doc_id].lang_pred == r.lang for r in tested]) > 0.95
    empty = langid.learn(table.where("false"))
    assert {r.lang_pred for r in langid.predict(table, empty).collect()} == {langid.UNDETERMINED}
    one = langid.learn(table.where("lang = 'fr'"))
    assert {r.lang_pred for r in langid.predict(table.where("doc_id < 900"), one).collect()} == {"fr"}
    assert langid.predict(table.where("false"), model).count() == 0


def test_codewords_tell_all_languages_apart():
    for n in (2, 3, 4, 5, 12, 40):
        code = langid.codewords(n)
        assert len({tuple(row) for row in code}) == n
        assert n < 3 or min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= 2


# --- fingerprints ---------------------------------------------------------------------------------------------------

def fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints, distance=4):
    ids, parent = sorted(prints), {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(3)
    base = [" ".join(f"w{rnd.randint(0, 400)}" for _ in range(120)) for _ in range(6)]
    texts = [t[:5000] if t else t for t in ODD]
    for b in base:
        for _ in range(8):
            w = b.split()
            w[rnd.randrange(len(w))] = "Other"
            texts.append(" ".join(w))
    got = simhash.near_duplicates(docs(spark, texts)).collect()
    prints = {k: fingerprint(t) for k, t in enumerate(texts)}
    assert {r.doc_id: r.fingerprint for r in got} == {k: f"{v:016x}" for k, v in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == classes(prints)


def test_near_duplicates_with_null_and_repeated_ids(spark):
    got = simhash.near_duplicates(docs(spark, ["a b c d e", "a b c d e", "x", "y", "q", "q"], [7, 7, None, 3, None, 9])).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in got if r.fingerprint == f"{fingerprint('a b c d e'):016x}") == [("7", 7), ("7", 7)]
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got if r.fingerprint == f"{fingerprint('q'):016x}") == [("9", "9"), ("None", "9")]
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_grid_finds_every_pair_once(spark):
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 2**63, 40, dtype=np.uint64)
    prints = {}
    for i in range(700):
        x = int(base[rnd.integers(40)])
        for b in rnd.choice(64, rnd.integers(0, 7), replace=False):
            x ^= 1 << int(b)
        prints.setdefault(x, i)
    points = spark.createDataFrame([(i, i, int(np.uint64(x).astype(np.int64))) for x, i in prints.items()], "node bigint, group bigint, fingerprint bigint")
    got = [frozenset((r.a, r.b)) for r in simhash._range_join(points, 4).collect()]
    want = {frozenset((prints[x], prints[y])) for x in prints for y in prints if x < y and (x ^ y).bit_count() <= 4}
    assert len(got) == len(set(got)) and set(got) == want
    assert all((dict((v, k) for k, v in prints.items())[r.a] ^ dict((v, k) for k, v in prints.items())[r.b]).bit_count() <= 2 for r in simhash._joined_cells(points).collect())


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 200), (200, 100), (300, 300), (None, 5), (150, 100)] + [(500, k) for k in range(501, 560)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, 200: 100, 150: 100, **{k: 500 for k in range(501, 560)}}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- repeated passages ----------------------------------------------------------------------------------------------

def removed(texts, length):
    data = [(t or "").encode() for t in texts]
    seen: dict = {}
    for b in data:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in data:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [2048, 2])
def test_repeated_passages_equal_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffix, "SLICE", 700)
    found = suffix.repeats
    monkeypatch.setattr(suffix, "repeats", lambda d, i, t, n: found(d, i, t, n, 16, crowd))
    rnd = random.Random(11)
    word = lambda n: "".join(rnd.choice("abcé ") for _ in range(n))
    passages = [word(n) for n in (60, 59, 61, 90, 250)]
    texts = [None, "", "a" * 59, "a" * 300, "ab" * 200, "line one\n" * 60, word(2000)] + [word(rnd.randint(0, 90)) + rnd.choice(passages) + word(rnd.randint(0, 90)) for _ in range(50)]
    texts += [texts[6], texts[20], texts[20]]
    got = {r.doc_id: tuple(r)[1:] for r in suffix.remove(docs(spark, texts), length=60).collect()}
    assert got == dict(enumerate(removed(texts, 60)))


def test_repeated_passages_odd_rows(spark):
    long = "".join(random.Random(2).choice("abcdefgh ") for _ in range(900))
    rows = suffix.remove(docs(spark, [long, long, long[:300], "x" * 399, None], [1, 1, 1, None, None])).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans) for r in rows) == [
        ("1", 300, 0, 0), ("1", 900, 900, 1), ("1", 900, 900, 1), ("None", 0, 0, 0), ("None", 399, 0, 0)]
    assert suffix.remove(docs(spark, [])).count() == 0


def test_rolling_hashes_and_sliding_minimum():
    data = np.frombuffer(b"abcabcabcXabcabc" * 9, dtype=np.uint8)
    r = rolling.Rolling(data)
    grams = r.grams(5)
    assert all((grams[i] == grams[j]) == (bytes(data[i : i + 5]) == bytes(data[j : j + 5])) for i in range(60) for j in range(60))
    v = np.random.default_rng(0).integers(0, 1 << 40, 200, dtype=np.uint64) << np.uint64(20)
    for width in (1, 2, 3, 7, 64, 200):
        assert rolling.sliding_argmin(v, width).tolist() == [i + int(v[i : i + width].argmin()) for i in range(200 - width + 1)]
