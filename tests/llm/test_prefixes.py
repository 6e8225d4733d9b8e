"""The prefix trie against a plain one, over lists of turns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from cargoline.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string, depth string, p1 string, seq string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(turns)] for c, turns in own.items()}
    seqs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        cost = (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += cost
            leaves[p[:d]] += not children[p]
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(seqs[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


@pytest.mark.parametrize("seed,convs,kinds", [(1, 90, 2), (2, 60, 3), (3, 200, 1)])
def test_equals_a_plain_trie(spark, seed, convs, kinds):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(convs * 2), convs):
        for t in range(rng.choice([0, 1, 2, 3, 4, 7])):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]) if kinds > 1 else "user",
                         rng.choice(["", None, " a  b\tc ", "one", "x y z"][: kinds + 2])))
    rows += [rows[0], rows[0], (None, 1, "user", "no conversation")]
    assert found(prefixes.trie(table(spark, rows))) == brute(rows)


def test_one_long_conversation_and_identical_ones(spark):
    rows = [(20, t, "user", f"turn {t % 7}") for t in range(120)]
    rows += [(c, t, "user", f"same {t}") for c in range(40, 400) for t in range(3)]
    assert found(prefixes.trie(table(spark, rows))) == brute(rows)


def test_empty_table_and_turnless_conversations(spark):
    assert found(prefixes.trie(table(spark, []))) == []
    short = [c for c in range(1, 400) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20]
    rows = [(c, 0, None, None) for c in short[:5]]
    got = found(prefixes.trie(table(spark, rows)))
    assert got == brute(rows) and len(got) == 1 and got[0][1] == 0
