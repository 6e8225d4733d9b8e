"""Spelling variants: words one code point apart, found by partition-and-enumerate signatures of their letter multisets.

A word's letters are a binary vector: one dimension for each letter and occurrence number ("banana" has a1 a2 a3 b1 n1 n2). One inserted or
deleted code point changes one dimension, a replaced one two, so near words have a Hamming distance of two at most. The dimensions are dealt
into ``PARTS`` parts; two differing dimensions leave ``PARTS - 2`` parts equal, so enumerating every choice of that many parts gives near
words an equal signature, without exception. A signature is joined with what else one edit leaves alone: the length of the longer word and
either its first half or its last half. All of it is one 64-bit key, candidates come from an equi-join on it, and the edit distance of every
candidate is computed. Equal hashes of unequal signatures only add candidates.

Words and counts come from all documents. Nothing else than aggregates and equi-joins is shuffled, so that a word in every document, or one
with very many near words, is only ever the key of a sum, a minimum or a join that Spark can split.

Defined cases: a null or empty text has no words, a null id counts as an empty one, repeated rows count again, an empty table gives no rows, and
columns other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from cargoline.llm.batches import ship
from cargoline.llm.words import lower_ascii
from cargoline.session import materialize

LETTERS = "A-Za-zÀ-ÿ"
#: Least code points of a word, least occurrences, and how many times commoner a form has to be.
LENGTH, COUNT, TIMES = 7, 2, 10
#: One run in ``SLIP`` loses a code point.
SLIP = 31
PARTS, DISTANCE = 4, 2
#: Spark's edit distance takes the square of the length; longer words are compared by their first difference.
SHORT = 64
_CHOICES = list(combinations(range(PARTS), PARTS - DISTANCE))


def slipped(doc_id: Column, run: Column) -> Column:
    """The run without one code point where the CRC of id and run says so, else the run as it is."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.char_length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(h % SLIP == 0, shorter).otherwise(run)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``word`` and ``n``, its occurrences in all documents, for words of ``LENGTH`` code points and ``COUNT`` occurrences at least."""
    # a shorter run can't give a long enough word; a greedy match of this many letters is a whole run
    runs = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"([{LETTERS}]{{{LENGTH},}})"), F.lit(1))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(runs).alias("run")).select("id", lower_ascii(F.col("run")).alias("run"))
    words = rows.select(slipped(F.col("id"), F.col("run")).alias("word")).where(F.char_length("word") >= LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= COUNT)


def signatures(word: str) -> list[tuple[int, int]]:
    """(length of the longer word, key) for all pairs that the word can be in as one of two words of equal length, as the shorter or the longer."""
    seen: Counter = Counter()
    parts = [0] * PARTS
    for letter in word:
        seen[letter] += 1
        bit = xxhash.xxh64_intdigest(f"{letter}{seen[letter]}")
        parts[bit % PARTS] += bit
    chosen = [":".join(str(parts[p]) for p in choice) for choice in _CHOICES]
    out = []
    for longer in (len(word), len(word) + 1):
        half = longer // 2
        for side, anchor in (("<", word[:half]), (">", word[half - longer :])):
            start = f"{longer}{side}{anchor}{side}"
            out += [(longer, xxhash.xxh64_intdigest(f"{start}{number}:{sums}") - (1 << 63)) for number, sums in enumerate(chosen)]
    return out


def _signed(words: DataFrame) -> DataFrame:
    ship(words.sparkSession)

    def run(batches):
        for batch in batches:
            keys, longer, which = [], [], []
            for row, word in enumerate(batch.column("word").to_pylist()):
                for length, key in signatures(word):
                    keys.append(key)
                    longer.append(length)
                    which.append(row)
            rows = batch.take(pa.array(which, type=pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.int64()), pa.array(longer, type=pa.int64()), *rows.columns], names=["key", "longer", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "key bigint, longer bigint, word string, n bigint")


def _one_apart(a: Column, b: Column) -> Column:
    """Whether exactly one inserted, deleted or replaced code point makes one word the other; linear in long words."""
    differs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~x.eqNullSafe(y))
    at = F.array_position(differs, True).cast("int")
    size_a, size_b = F.char_length(a), F.char_length(b)
    after = lambda word, size, longer: F.substring(word, at + longer.cast("int"), size)
    same = after(a, size_a, size_a >= size_b) == after(b, size_b, size_b >= size_a)
    return F.when(F.greatest(size_a, size_b) <= SHORT, F.levenshtein(a, b, 1) == 1).otherwise((at > 0) & (F.abs(size_a - size_b) <= 1) & same)


def near_words(words: DataFrame) -> DataFrame:
    """Pairs ``a`` < ``b`` of words that differ by exactly one inserted, deleted or replaced code point, each once, with their counts ``n_a`` and ``n_b``."""
    signed = _signed(words)
    a = signed.select("key", "longer", F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = signed.select("key", F.col("word").alias("b"), F.col("n").alias("n_b"))
    fits = F.greatest(F.char_length("a"), F.char_length("b")) == F.col("longer")
    pairs = a.join(b, "key").where((F.col("a") < F.col("b")) & fits)
    return pairs.where(_one_apart(F.col("a"), F.col("b"))).select("a", "b", "n_a", "n_b").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``: forms followed to the last. A form is at least ten times commoner, so chains are short and have no rings; each round doubles the step."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = materialize(now.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = after.drop("moved")
        if not after.where("moved").limit(1).count():
            return now


def variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per word: ``word``, ``form`` (the near word of largest count that is ten times commoner at least, else null), ``root``, ``n``, ``n_near``, ``form_n``."""
    words = materialize(vocabulary(docs, id_col, text), "words")
    pairs = materialize(near_words(words), "near-words")
    ends = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    best = ends.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("_"), "other")).alias("s"))
    best = best.select("word", "n_near", F.col("s.other").alias("other"), (-F.col("s._")).alias("other_n"))
    common = F.col("other_n") >= F.col("n") * TIMES
    found = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(common, F.col("other")).alias("form"), F.when(common, F.col("other_n")).alias("form_n"))
    found = materialize(found, "forms")
    roots = _roots(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
