"""Spelling variants against comparing all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from cargoline.llm import spelling

SCHEMA = "doc_id long, text string, word string, n string, key string, run string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", None, "y", "z") for i, t in rows], SCHEMA)


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= 2}
    near = {w: [v for v in n if v != w and one_apart(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def found(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r.word for r in rows}) == len(rows)
    return {tuple(r) for r in rows}


@pytest.mark.parametrize("letters", ["ab", "abÀé×z", "aeinrst"])
def test_equals_all_pairs(spark, letters):
    rng = random.Random(len(letters))
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 11))) for _ in range(60)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(40):
            w = stems[min(int(rng.expovariate(0.1)), 59)]
            if rng.random() < 0.2:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", rng.choice(letters), w[at] + rng.choice(letters)]) + w[at + 1 :]
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", ", ", "1"]).join(words)))
    assert found(spelling.variants(table(spark, rows))) == brute(rows)


def test_chains_ties_nulls_and_repeats(spark):
    chain = [(1, "abcdefgh " * 1200), (1, "abcdefgx " * 110), (1, "abcdefgxy " * 10), (1, "abcdefgxyz")] * 2
    ties = [(3, "qrstuvwx " * 30), (3, "qrstuvwy " * 30), (3, "qrstuvw " * 3)]
    odd = [(None, "Nullword nullword"), (None, None), (5, None), (6, ""), (7, "short words only"), (7, "ÀÉÎÕÜÝÞ àéîõüýþ ÀÉÎÕÜÝÞ")]
    rows = chain + ties + odd
    got = found(spelling.variants(table(spark, rows)))
    assert got == brute(rows)
    assert found(spelling.variants(table(spark, []))) == set()


def test_very_long_words(spark):
    long = "".join(random.Random(5).choice("abcdefghij") for _ in range(200_000))
    rows = [(1, long + " " + long), (2, long[:-1] + "k " + long[:-1] + "k")]
    got = spelling.variants(table(spark, rows)).collect()
    assert sorted(r.n_near for r in got) == [1, 1]


def test_long_and_short_words_alike(spark, monkeypatch):
    rng = random.Random(8)
    stems = ["".join(rng.choice("abé") for _ in range(9)) for _ in range(40)]
    rows = [(i, " ".join(rng.choice(stems) for _ in range(200))) for i in range(5)]
    monkeypatch.setattr(spelling, "SHORT", 0)
    assert found(spelling.variants(table(spark, rows))) == brute(rows)


def test_near_words_always_share_a_signature():
    rng = random.Random(9)
    for _ in range(3000):
        w = "".join(rng.choice("abcé") for _ in range(rng.randint(7, 14)))
        at = rng.randrange(len(w))
        v = w[:at] + rng.choice(["", rng.choice("abcé"), w[at] + rng.choice("abcé")]) + w[at + 1 :]
        if v != w:
            assert {k for _, k in spelling.signatures(w)} & {k for _, k in spelling.signatures(v)}


def test_letters_of_the_language_operator():
    """A superscript, a fraction or a Roman numeral sign is no letter."""
    from cargoline.llm import langid

    assert not any(langid._LETTER.search(t) for t in ("²", "½", "Ⅷ", "12_3", "")) and all(langid._LETTER.search(t) for t in ("a", "é", "ж", "語"))
