"""Matchers against plain Python loops over every entry."""

import random

import pytest

from cargoline import constants as K
from cargoline.operators import match

WORDS = ["pha", "led", "đèn", "uv", "bàn", "small", "ring", "mới", "100", "nhựa", "cold", "rod", "thanh", "x"]
LABELS = [("SP A", "LK", "c1", "d1"), ("SP A", "NC", "c1", "d2"), ("SP B", "NC", "c2", "d3"), ("0", "LK", "c3", "d4")]


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(7)
    phrase = lambda a, b: " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(a, b)))
    rows = [(i, rnd.choice(["9405", "8539", "85391000", ""]), phrase(0, 9)) for i in range(250)]
    rows += [(1000 + i, "9405", "đèn led pha") for i in range(120)]  # one text with a third of all rows
    entries = []
    for e in range(14):
        keywords = [phrase(1, 3) for _ in range(rnd.randint(1, 6))]
        entries.append((e, rnd.choice(["9405", "8539", "85391000"]), keywords, *rnd.choice(LABELS)))
    r = spark.createDataFrame(rows, "row_id bigint, hs_code string, clean_text string").cache()
    d = spark.createDataFrame(entries, "entry_id bigint, hs_code string, keywords array<string>, product_line string, "
                                       "kind string, class1 string, class2 string").cache()
    return rows, entries, r, d


def test_phrase(data):
    rows, entries, r, d = data
    expected = {}
    for i, hs, t in rows:
        best, length = None, 0
        for e in entries:
            for k in e[2] if e[1] == hs else []:
                if len(k) >= 3 and f" {k} " in f" {t} " and len(k) > length:
                    best, length = (e[0], k), len(k)
        if best:
            expected[i] = best
    assert {x.row_id: (x.entry_id, x.keyword) for x in match.match_phrase(r, d).collect()} == expected


def test_overlap(data):
    rows, entries, r, d = data
    stop = set(K.OVERLAP_STOPWORDS)
    expected = {}
    for i, hs, t in rows:
        words, best, top = set(t.split()) - stop, None, 0
        for e in entries:
            sig = {w for k in e[2] for w in k.split()} - stop
            both = words & sig
            if e[1] == hs and both:
                score = len(both) / min(len(words), len(sig)) * sum(map(len, both))
                if score > top:
                    best, top = e[0], score
        if top >= 0.5:
            expected[i] = (best, round(top, 9))
    assert {x.row_id: (x.entry_id, round(x.score, 9)) for x in match.match_overlap(r, d).collect()} == expected


def spans(text, keyword):
    w, k = text.split(), keyword.split()
    return [(i, i + len(k) - 1) for i in range(len(w) - len(k) + 1) if w[i:i + len(k)] == k]


def choose(scores, kinds):
    """Highest score, first seen; a complete product with the same score beats a component seen before."""
    best, top = None, 0
    for e, s in scores.items():
        if s > top:
            best, top = e, s
        elif s == top and s > 0 and best is not None and kinds[e] == "NC" and kinds[best] == "LK":
            best = e
    return best, top


def sentinel(v):
    return K.NO_LABEL if v in K.NULL_WORDS else v


@pytest.mark.parametrize("use_hs", [True, False])
def test_weighted(data, use_hs):
    rows, entries, r, d = data
    owner = {k: e for e in entries for k in e[2]}
    kinds = {e[0]: e[4] for e in entries}
    text_of = {e[0]: " | ".join(sentinel(v) for v in (*e[3:7], e[1])) for e in entries}
    expected = {}
    for i, hs, t in rows:
        hits = []
        for k, e in owner.items():
            w = 25 if any(h in k for h in K.HIGH_VALUE_TERMS) else 0 if k in K.JUNK_TERMS else len(k.split()) ** 2
            if use_hs and len(hs) >= 4 and hs[:4] != e[1][:4]:
                w /= 10
            hits += [(-len(k), a, b, e[0], w) for a, b in spans(t, k)]
        taken, scores = [], {}
        for _, a, b, e, w in sorted(hits):
            if all(b < c or a > f for c, f in taken):
                taken.append((a, b))
                scores[e] = round(scores.get(e, 0) + w, 6)
        e, s = choose(scores, kinds)
        expected[i] = (text_of[e] if e is not None and s >= 5 else None, round(s, 6))
    got = {x.row_id: (x.label_text, round(x.score, 6)) for x in match.match_weighted(r, d, use_hs=use_hs).collect()}
    assert got == expected


def test_masked(data):
    rows, entries, r, d = data
    kinds = {e[0]: e[4] for e in entries}
    expected = {}
    for i, _, t in rows:
        scores = {}
        for e in entries:
            taken, total, done = [], 0, set()
            for k in sorted(e[2], key=len, reverse=True):
                hit = False
                for a, b in spans(t, k):
                    if all(b < c or a > f for c, f in taken):
                        taken.append((a, b))
                        hit = True
                if hit and k not in done:
                    done.add(k)
                    total += (20 if any(h in k for h in K.MASKED_HIGH_VALUE_TERMS) else 0 if k in K.MASKED_JUNK_TERMS
                              else len(k.split()))
            scores[e[0]] = total
        e, s = choose(scores, kinds)
        expected[i] = (None if s < 15 else " | ".join(sentinel(v) for v in next(x for x in entries if x[0] == e)[3:7]), s if s >= 15 else 0)
    got = {x.row_id: (x.label_text, x.score) for x in match.match_masked(r, d).collect()}
    assert got == expected


def test_results_do_not_depend_on_partitioning(spark, data):
    _, _, r, d = data
    outs = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        outs.append(sorted(map(str, match.match_weighted(r.repartition(int(n)), d).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert outs[0] == outs[1]
