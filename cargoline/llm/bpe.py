"""Byte-pair encoding and decoding with a public vocabulary, by an index of pair occurrences.

The texts of a chunk are cut into words. Words not met before are laid out one after the other as arrays of symbols; an index maps
each pair of neighbouring symbols that has a merge rank to all its positions. Ranks that occur are taken in ascending order from a
heap: all positions of the rank merge at once, and only the pairs beside them are looked up and put in their lists. A vocabulary in
which every merge makes a symbol of its own never yields a pair of a lower rank than the one that made it, so one ascending pass gives
what word-by-word merging gives; ``Vocabulary`` checks that.

Nulls count as empty texts; an empty text has no token. A text of any length is encoded whole. Rows are independent of each other.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cargoline.llm.batches import add_columns

#: Encoded words a worker keeps; the store is emptied when it is full, so memory stays bounded and results don't change.
KEPT_WORDS = 300_000

OUTPUTS = {"n_tokens": "bigint", "ids": "string", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


@dataclass
class Vocabulary:
    """A byte-level vocabulary with word ends, read from a ``tokenizers`` file."""

    tokens: list[str]
    pair_keys: np.ndarray  # sorted keys left << 32 | right of the pairs that merge
    pair_ranks: np.ndarray
    left: np.ndarray  # by rank
    right: np.ndarray
    product: np.ndarray
    inner: np.ndarray  # symbol of a byte within a word
    last: np.ndarray  # symbol of a byte that ends a word
    special: dict[str, int]
    pattern: str
    lower: bool
    store: dict = field(default_factory=dict, repr=False)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        ids: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = [""] * (max([*ids.values(), *special.values()]) + 1)
        for token, i in [*ids.items(), *special.items()]:
            tokens[i] = token
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([ids[m[k]] for m in merges], dtype=np.int64) for k in (0, 1))
        product = np.array([ids[a + b] for a, b in merges], dtype=np.int32)
        if len(np.unique(product)) != len(product):
            raise ValueError("two merges make the same symbol: one ascending pass over the ranks would not be exact")
        keys = left << 32 | right
        order = np.argsort(keys)
        kinds = {k["type"]: k for k in spec["pre_tokenizer"]["pretokenizers"]}
        normal = [n["type"] for n in spec["normalizer"]["normalizers"]]
        alphabet = byte_alphabet()
        return cls(tokens=tokens, pair_keys=keys[order], pair_ranks=order.astype(np.int32), left=left.astype(np.int32), right=right.astype(np.int32),
                   product=product, inner=np.array([ids[c] for c in alphabet], dtype=np.int32),
                   last=np.array([ids[c + suffix] for c in alphabet], dtype=np.int32), special=special,
                   pattern=kinds["Split"]["pattern"]["Regex"], lower="Lowercase" in normal)

    def __getstate__(self):
        return {**self.__dict__, "store": {}}

    def ranks_of(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def normalise(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # lower-casing goes character by character: no final sigma
        return text.lower() if self.lower else text

    def words(self, text: str) -> list[str]:
        """Words of a text in order; special tokens stand for themselves."""
        find = _pattern(self.pattern).findall if _RARE.search(text) else _plain(self.pattern).findall
        if not any(s in text for s in self.special):
            return find(self.normalise(text))
        out: list[str] = []
        for part in regex.split("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")", text):
            out += [part] if part in self.special else find(self.normalise(part))
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words one after the other and where each word's ids end, from one index of pair occurrences."""
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        n = len(data)
        symbol = self.inner[data]
        symbol[ends - 1] = self.last[data[ends - 1]]
        after = np.arange(1, n + 1, dtype=np.int32)
        after[ends - 1] = -1
        before = np.arange(-1, n - 1, dtype=np.int32)
        before[ends - sizes] = -1
        lists: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def index(at: np.ndarray) -> None:
            rank = self.ranks_of(symbol[at].astype(np.int64) << 32 | symbol[after[at]])
            found = rank >= 0
            at, rank = at[found], rank[found]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            starts = [0, *cuts.tolist(), len(at)]
            for a, b in zip(starts, starts[1:]):
                r = int(rank[a])
                if r not in lists:
                    lists[r] = []
                    heapq.heappush(active, r)
                lists[r].append(at[a:b])

        index(np.flatnonzero(after >= 0).astype(np.int32))
        while active:
            r = heapq.heappop(active)
            parts = lists.pop(r)
            at = parts[0] if len(parts) == 1 else np.concatenate(parts)
            at = at[symbol[at] == self.left[r]]
            nxt = after[at]
            good = nxt >= 0
            at, nxt = at[good], nxt[good]
            good = symbol[nxt] == self.right[r]
            at, nxt = at[good], nxt[good]
            if not len(at):
                continue
            if self.left[r] == self.right[r]:
                at = _alternate(np.unique(at), after)
                nxt = after[at]
            symbol[at] = self.product[r]
            symbol[nxt] = -1
            beyond = after[nxt]
            after[at] = beyond
            has = beyond >= 0
            before[beyond[has]] = at[has]
            prior = before[at]
            prior = prior[prior >= 0]
            index(np.concatenate([prior[symbol[prior] != self.product[r]], at[has]]))  # merged neighbours are in ``at`` already
        live = symbol >= 0
        return symbol[live], np.cumsum(np.add.reduceat(live, ends - sizes, dtype=np.int64))

    def learn(self, words: set[str]) -> None:
        """Put words in the worker's store: ids and tokens as text."""
        new = [w for w in words if w not in self.store]
        if len(self.store) + len(new) > KEPT_WORDS:
            self.store.clear()
            new = list(words)
        for token, i in self.special.items():
            self.store[token] = (str(i), token)
        new = [w for w in new if w not in self.special]
        if new:
            tokens, text = self.tokens, _digits(len(self.tokens))
            ids, ends = self.encode_words(new)
            ids = ids.tolist()
            digits, names = [text[i] for i in ids], [tokens[i] for i in ids]
            first = 0
            for word, end in zip(new, ends.tolist()):
                self.store[word] = (" ".join(digits[first:end]), " ".join(names[first:end]))
                first = end

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids: this vocabulary names no decoder, so the tokens stand as they are, a space between."""
        return " ".join([self.tokens[i] for i in ids])


#: Texts with other characters than these go to the engine that knows all of Unicode.
_RARE = re.compile("[^\\x00-\\x1b\\x20-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u024f]")
#: The classes at the end of the pattern, after its fixed strings.
_CLASSES = "|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_PATTERNS: dict[str, regex.Pattern] = {}
_DIGITS: list[str] = []


def _pattern(source: str) -> regex.Pattern:
    if source not in _PATTERNS:
        _PATTERNS[source] = regex.compile(source)
    return _PATTERNS[source]


def _plain(source: str):
    """The same pattern for texts without rare characters, where letters are a short list; letters go first, as no fixed string starts with one."""
    if ("plain", source) not in _PATTERNS:
        fixed = source.removesuffix(_CLASSES)
        letters = "".join(c for c in map(chr, range(0x250)) if c.isalpha())
        fits = fixed != source and not any(p[:1] in letters for p in fixed.split("|"))
        plain = f"[{letters}]+|[0-9]|{fixed}|[^\\s{letters}0-9]+"
        _PATTERNS["plain", source] = re.compile(plain) if fits else regex.compile(source)
    return _PATTERNS["plain", source]


def _digits(n: int) -> list[str]:
    while len(_DIGITS) < n:
        _DIGITS.append(str(len(_DIGITS)))
    return _DIGITS


def _alternate(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of sorted positions of a pair of equal symbols, every other one within a run, from the left."""
    joined = np.zeros(len(at), dtype=bool)
    joined[1:] = after[at[:-1]] == at[1:]
    starts = np.flatnonzero(~joined)
    run = np.cumsum(~joined) - 1
    return at[(np.arange(len(at)) - starts[run]) % 2 == 0]


def encode_decode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text",
                  outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """``docs`` with the asked ``outputs`` of encoding each text and decoding the ids again.

    ``ids`` are decimal numbers joined by a space, ``decoded`` is the text that the ids decode to; the ``_sha256`` outputs are the
    digests of these two. Only what is asked for leaves the task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # as large as the vocabulary file, whatever the input

    def run(column: pa.Array) -> dict[str, pa.Array]:
        vocab = shared.value
        words = [vocab.words(t) if t else [] for t in column.to_pylist()]
        vocab.learn(set().union(*words))
        store = vocab.store
        made: dict[str, list] = {name: [] for name in outputs}
        for listed in words:
            pairs = [store[w] for w in listed]
            ids = " ".join([p[0] for p in pairs])
            decoded = " ".join([p[1] for p in pairs])
            row = {"n_tokens": ids.count(" ") + 1 if ids else 0, "ids": ids, "decoded": decoded}
            for name in outputs:
                source = name.removesuffix("_sha256")
                made[name].append(row[name] if name == source else hashlib.sha256(row[source].encode()).hexdigest())
        return {n: pa.array(v, type=pa.int64() if n == "n_tokens" else pa.string()) for n, v in made.items()}

    return add_columns(docs, text, run, {n: OUTPUTS[n] for n in outputs})
