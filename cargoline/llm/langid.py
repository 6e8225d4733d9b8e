"""Language identification by error-correcting output codes over binary n-gram classifiers.

Every language has a codeword; each bit splits the languages in two, and a naive Bayes classifier over hashed character bigrams and
trigrams gives the log odds of that split per n-gram. Decoding adds, for every language, the logistic losses of its codeword's bits,
each bit weighted by how well its classifier does on the learning documents, and takes the language with the smallest loss. A text
whose two best languages are close is marked as ambiguous.

Learning counts the n-grams of all learning documents inside tasks and sums the counts per language and bucket; what reaches the driver
is one table of languages x buckets, whatever the number of documents. The weights come from a second pass over the same documents.

Null texts and texts without letters are ``und`` with score 0, and so is every text when nothing could be learned. With one language
alone, every text with letters gets it with score 1. Rows are independent of each other; repeated rows get equal results.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from cargoline.llm.batches import add_columns, chunks, ship

BUCKET_BITS = 16
#: Characters whose n-grams are weighed at one time.
_BLOCK = 500_000
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """(n, bits) of -1 and 1: all splits of up to four languages, else the best of a few random sets of splits by smallest distance."""
    if n <= 4:
        splits = [s for k in range(1, n // 2 + 1) for s in combinations(range(n), k) if 2 * k < n or 0 in s]
        return np.array([[1 if i in s else -1 for s in splits] for i in range(n)], dtype=np.float64).reshape(n, len(splits))
    rng, bits, best, best_gap = np.random.default_rng(seed), max(15, 6 * int(np.ceil(np.log2(n)))), None, -1
    for _ in range(64):
        code = np.where(rng.permuted(np.arange(n)[:, None] % 2 == np.zeros(bits), axis=0), 1.0, -1.0)
        agree = code @ code.T
        gap = (bits - (agree - np.eye(n) * 2 * bits).max()) / 2
        if gap > best_gap:
            best, best_gap = code, gap
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits, log odds per n-gram
    reliability: np.ndarray  # per bit


def _features(text: str) -> np.ndarray:
    """Buckets of the bigrams (first half) and trigrams of a lower-cased text with a space around."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    two = (c[:-1] * np.uint32(0x9E3779B1)) ^ (c[1:] * np.uint32(0x85EBCA77))
    three = (two[:-1] * np.uint32(0xC2B2AE3D)) ^ (c[2:] * np.uint32(0x27D4EB2F))
    shift = np.uint32(33 - BUCKET_BITS)
    half = np.uint32(1 << (BUCKET_BITS - 1))
    return np.concatenate([(two * np.uint32(0x9E3779B1)) >> shift, ((three * np.uint32(0x85EBCA77)) >> shift) + half])


def _margins(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """Mean log odds of each bit over a text's n-grams, drawn towards zero where there are few."""
    out = np.zeros((len(texts), weights.shape[1]))
    for k, text in enumerate(texts):
        total, n = np.zeros(weights.shape[1]), 0
        for first in range(0, len(text), _BLOCK):
            f = _features(text[first : first + _BLOCK + 2] if len(text) > _BLOCK else text)
            if len(f) * weights.shape[1] > 1 << 18:
                total += np.bincount(f, minlength=len(weights)) @ weights
            else:
                total += weights[f].sum(axis=0)
            n += len(f)
        out[k] = total / (n + 8)
    return out


def _losses(margins: np.ndarray, model: Model) -> np.ndarray:
    """Loss of each language's codeword, texts x languages."""
    gain = 12.0
    plus, minus = np.logaddexp(0, -gain * margins) * model.reliability, np.logaddexp(0, gain * margins) * model.reliability
    return plus @ (model.code.T > 0) + minus @ (model.code.T < 0)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Fit on all rows of ``docs`` that have a language and letters."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in chunks(batches, "text"):
            for value, label in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                if not _LETTER.search(value):
                    continue
                if label not in sums:
                    sums[label] = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
                for first in range(0, len(value), _BLOCK):
                    f = _features(value[first : first + _BLOCK])
                    if len(f) > 4096:
                        sums[label] += np.bincount(f, minlength=1 << BUCKET_BITS)
                    else:
                        np.add.at(sums[label], f, 1)
        for label, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([label] * len(at)), "bucket": pa.array(at), "n": pa.array(n[at])})

    counted = rows.mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counted.toPandas()  # languages x buckets at most
    languages = sorted(table["lang"].unique())
    code = codewords(len(languages))
    share = np.zeros((len(languages), 1 << BUCKET_BITS))
    for k, name in enumerate(languages):
        own = table[table["lang"] == name]
        share[k, own["bucket"].to_numpy()] = own["n"].to_numpy()
        share[k] = (share[k] + 0.5) / (share[k].sum() + 0.5 * share.shape[1])
    bits = code.shape[1]
    weights = np.zeros((1 << BUCKET_BITS, bits))
    for b in range(bits):
        weights[:, b] = np.log(share[code[:, b] > 0].mean(axis=0)) - np.log(share[code[:, b] < 0].mean(axis=0))
    model = Model(languages, code, weights, np.ones(bits))
    if bits:
        model.reliability = _reliability(rows, model)
    return model


def _reliability(rows: DataFrame, model: Model) -> np.ndarray:
    """Twice the share over one half of learning documents that a bit's classifier gets right."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # languages and buckets, not documents
    bits = model.code.shape[1]

    def judge(batches):
        m = shared.value
        place = {name: k for k, name in enumerate(m.languages)}
        right, n = np.zeros(bits, dtype=np.int64), 0
        for batch in chunks(batches, "text"):
            pairs = [(t, l) for t, l in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()) if _LETTER.search(t)]
            if pairs:
                signs = np.sign(_margins([t for t, _ in pairs], m.weights))
                right += (signs == m.code[[place[l] for _, l in pairs]]).sum(axis=0)
                n += len(pairs)
        yield pa.RecordBatch.from_pydict({"bit": pa.array(range(bits), type=pa.int32()), "ok": pa.array(right), "n": pa.array([n] * bits)})

    sums = rows.mapInArrow(judge, "bit int, ok bigint, n bigint").groupBy("bit").agg(F.sum("ok").alias("ok"), F.sum("n").alias("n")).collect()
    share = {r["bit"]: r["ok"] / max(r["n"], 1) for r in sums}
    return np.array([max(2 * share.get(b, 1) - 1, 0.01) for b in range(bits)])


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1, the share of the best language among all by loss) and ``ambiguous``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages and buckets, not documents

    def run(column: pa.Array) -> dict[str, pa.Array]:
        m = shared.value
        texts = column.to_pylist()
        known = [k for k, t in enumerate(texts) if t and m.languages and _LETTER.search(t)]
        names, scores, close = [UNDETERMINED] * len(texts), [0.0] * len(texts), [True] * len(texts)
        if known:
            loss = _losses(_margins([texts[k] for k in known], m.weights), m)
            share = np.exp(loss.min(axis=1, keepdims=True) - loss)
            share /= share.sum(axis=1, keepdims=True)
            best = loss.argmin(axis=1)
            for row, k in enumerate(known):
                names[k], scores[k] = m.languages[best[row]], float(share[row, best[row]])
                close[k] = scores[k] < 0.5
        return {"lang_pred": pa.array(names), "score": pa.array(scores), "ambiguous": pa.array(close)}

    return add_columns(docs, text, run, {"lang_pred": "string", "score": "double", "ambiguous": "boolean"})


def held_out(id_col: Column) -> Column:
    """Whether a document is kept from learning: a quarter by a checksum of its id; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))
