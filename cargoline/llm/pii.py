"""Personal data in plain and in disguised form, with offsets into the text as it was given.

Plain identifiers are found in the text itself. Disguised ones are found line by line where a line holds a sign of a disguise: a chain of
transducers rewrites the line (look-alike characters and invisible ones; then spelled digits, "at" and "dot"), each keeping for every
piece of its output the stretch of its input it came from. The same detectors run over the last output, and each span found goes back
through the chain. No identifier holds a line break, so lines can be taken by themselves. A span that the chain adds must hold a
rewritten piece and must not meet a plain one of its kind.

Null and empty texts hold nothing. Spans are in code points, end exclusive. Rows are independent of each other.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from cargoline.llm.batches import add_columns

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A start within a run of digits can match nothing that a start at its head can't.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def plain_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that don't overlap; a match that fails its check is dropped and not tried again shorter."""
    found: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        first = at
        while first > done and text[first - 1] in _LOCAL:
            first -= 1
        if first < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((0, first, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= len(_DIGIT.findall(m[0])) <= 15:
            found.append((3, *m.span()))
    return found


# Look-alike letters of other scripts and for digits, spelled digits, words for "at" and "dot", brackets around them.
_ALIKE = dict(zip("аеорсхуіјѕԁһкмтвнАВЕКМНОРСТХУІЈЅαονρτυικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcxyijsdhkmtbhABEKMHOPCTXYIJSaovptuikABEZHIKMNOPTYX", strict=True))
_MARKS = {"。": ".", "․": ".", "·": ".", "•": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-",
          " ": " ", " ": " ", " ": " ", " ": " "}
_HIDDEN = "­​‌‍⁠﻿"
_DIGIT_WORDS = {w: str(d) for words in (
    "zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve") for d, w in enumerate(words.split())}
_AT_WORDS = ("at", "arroba", "arobase", "klammeraffe")
_DOT_WORDS = ("dot", "punkt", "point", "punto")
_AS_DIGITS = str.maketrans("OoIl|", "00111")
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"


def _characters() -> dict[int, str]:
    """Every character that stands for one ASCII letter, digit or sign of an identifier, by its look or its compatible form."""
    wanted = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789@.+-()_%")
    table = {ord(c): a for c, a in {**_ALIKE, **_MARKS}.items()}
    for code in (*range(0x250, 0xD800), *range(0xF900, 0x20000)):
        form = unicodedata.normalize("NFKC", chr(code))
        digit = unicodedata.decimal(chr(code), None)
        if form != chr(code) and form in wanted:
            table[code] = form
        elif digit is not None:
            table[code] = str(digit)
    return table


_TABLE = _characters()
#: The quick sign of a character to rewrite: any that the table or the hidden ones name.
_ODD = frozenset({*map(chr, _TABLE), *_HIDDEN})
_INVISIBLE = re.compile(f"[{_HIDDEN}]+")
_words = "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True))
_at, _dot = "|".join(_AT_WORDS), "|".join(_DOT_WORDS)
_LABEL = r"[A-Za-z0-9][A-Za-z0-9-]*"
#: A bare "at" counts only where a bare or bracketed "dot" follows its next word; a bare "dot" stands between words or digits.
_DISGUISE = re.compile(
    rf"(?P<digits>(?<![^\W_])(?:{_words})(?:[ -](?:{_words}))*(?![^\W_]))"
    rf"|(?P<at>(?:(?<![ \t])[ \t]++)?+{_OPEN}[ \t]*(?:{_at}|@)[ \t]*{_CLOSE}[ \t]*|(?<![ \t])[ \t]++(?:{_at})[ \t]+(?={_LABEL}(?:\.{_LABEL})*[ \t]*(?:[ \t](?:{_dot})[ \t]|{_OPEN}[ \t]*(?:{_dot}|\.)[ \t]*{_CLOSE})))"
    rf"|(?P<dot>(?:(?<![ \t])[ \t]++)?+{_OPEN}[ \t]*(?:{_dot}|\.)[ \t]*{_CLOSE}[ \t]*|(?<![ \t])[ \t]++(?:{_dot})[ \t]+)"
    # a run of letters like digits is tried from its head only
    r"|(?P<alike>(?<![^\W_])(?:[0-9]+[OoIl|][0-9OoIl|]*|(?<![OoIl|])[OoIl|]+[0-9][0-9OoIl|]*)(?![^\W_]))"
    r"|(?P<plus>(?<![^\W_])plus[ ]?(?=[0-9(]|(?:" + _words + r")(?![^\W_])))", re.IGNORECASE)
_WORD = re.compile(_words, re.IGNORECASE)
_BRACKETED = re.compile(rf"{_OPEN}[ \t]*(?i:{_at}|{_dot}|@|\.)[ \t]*{_CLOSE}")
_MIXED = re.compile("[0-9][OoIl|]|[OoIl|][0-9]")
#: Words that make a line worth rewriting, looked up between the borders that the pattern takes.
_SIGNS = frozenset({*_DIGIT_WORDS, *_DOT_WORDS} - {"un"})
_SIGN = re.compile(r"(?<![^\W_])(?:" + "|".join(sorted(_SIGNS, key=len, reverse=True)) + r")(?![^\W_])")
_ONE = re.compile(r"(?<![^\W_])un(?![^\W_])")
_PLUS = re.compile(r"(?<![^\W_])plus[ ]?(?=[0-9(]|(?:" + _words + r")(?![^\W_]))")
#: Letters that match others where case is ignored and that lower() leaves or takes apart.
_CASES = str.maketrans("ıİſ", "iis")


@dataclass
class Rewritten:
    """A transducer's output and, for each piece that differs from its input, where both lie."""

    text: str
    out_start: list[int]
    out_end: list[int]
    in_start: list[int]
    in_end: list[int]

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """The input stretch of the output stretch, and whether a rewritten piece is in it."""
        first, last = bisect_right(self.out_start, start) - 1, bisect_right(self.out_start, end - 1) - 1
        a, b = self._shift(first, start), self._shift(last, end - 1) + 1
        if first >= 0 and start < self.out_end[first]:
            a = self.in_start[first]
        if last >= 0 and end - 1 < self.out_end[last]:
            b = self.in_end[last]
        inner = last > first or (first >= 0 and start < self.out_end[first])
        return a, b, inner

    def _shift(self, piece: int, at: int) -> int:
        return at if piece < 0 else at - self.out_end[piece] + self.in_end[piece]


def transduce(text: str, pattern: re.Pattern, value) -> Rewritten:
    """Put ``value(match)`` for each match of ``pattern``."""
    parts, out, last, size = [], Rewritten("", [], [], [], []), 0, 0
    for m in pattern.finditer(text):
        new = value(m)
        parts += [text[last:m.start()], new]
        size += m.start() - last
        for listed, at in ((out.out_start, size), (out.out_end, size + len(new)), (out.in_start, m.start()), (out.in_end, m.end())):
            listed.append(at)
        size += len(new)
        last = m.end()
    out.text = "".join([*parts, text[last:]])
    return out


def _lower(text: str) -> str:
    """In lower case, as the patterns see it."""
    return text.lower() if text.isascii() else text.translate(_CASES).lower()


def _plain_form(m: re.Match) -> str:
    if m["digits"]:
        return "".join([_DIGIT_WORDS[_lower(w)] for w in _WORD.findall(m["digits"])])
    if m["alike"]:
        return m["alike"].translate(_AS_DIGITS)
    return {"at": "@", "dot": ".", "plus": "+"}[m.lastgroup]


def disguised_spans(line: str) -> list[Span]:
    """Identifiers of a line that show after rewriting and hold a rewritten piece."""
    shown = line.translate(_TABLE)  # one character for one: offsets stay
    bare = transduce(shown, _INVISIBLE, lambda m: "")
    told = transduce(bare.text, _DISGUISE, _plain_form)
    found = []
    for kind, start, end in plain_spans(told.text):
        a, b, inner = told.source(start, end)
        a, b, hidden = bare.source(a, b)
        if inner or hidden or line[a:b] != shown[a:b]:
            found.append((kind, a, b))
    return found


def _suspect(text: str) -> bool:
    """Whether rewriting the text can show an identifier: never false where ``disguised_spans`` finds one that is not plain.

    The French article "un" counts where there is more that an identifier could be made of: a digit, an "@" or four of them.
    """
    if (not text.isascii() and not _ODD.isdisjoint(text)) or _BRACKETED.search(text) or _MIXED.search(text):
        return True
    lower = _lower(text)
    if _SIGN.search(lower) or ("plus" in lower and _PLUS.search(lower)):
        return True
    ones = len(_ONE.findall(lower)) if "un" in lower else 0
    return ones > 3 or (ones > 0 and ("@" in text or _DIGIT.search(text) is not None))


def spans_of(text: str | None) -> tuple[list[Span], list[Span]]:
    """Plain spans and the further ones that were disguised, each by kind and start."""
    if not text:
        return [], []
    plain = sorted(plain_spans(text))
    more: list[Span] = []
    if _suspect(text):
        start = 0
        for line in text.split("\n"):
            if _suspect(line):
                more += [(k, a + start, b + start) for k, a, b in disguised_spans(line)]
            start += len(line) + 1
        more = sorted({s for s in more if not any(s[0] == k and s[1] < b and a < s[2] for k, a, b in plain)})
    return plain, more


def listed(spans: list[Span]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for k, a, b in spans])


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each stretch of personal data replaced by the name of its kind; stretches that overlap become one."""
    parts, last = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in spans):
        if start >= last:
            parts += [text[last:start], f"[{KINDS[kind].upper()}]"]
        last = max(last, end)
    return "".join([*parts, text[last:]])


OUTPUTS = {"n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string", "n_added": "bigint",
           "redacted": "string"}


def find(docs: DataFrame, text: str = "text", outputs: tuple[str, ...] = ("spans",)) -> DataFrame:
    """``docs`` with the asked ``outputs`` for each text.

    ``spans`` lists every span as ``kind:start:end`` by kind, then start; the ``n_`` columns count the plain spans of a kind, ``n_added``
    those that were disguised; ``base_sha256`` is the digest of the plain spans' list; ``redacted`` is the text with all spans replaced
    (null stays null).
    """

    def run(column: pa.Array) -> dict[str, pa.Array]:
        made: dict[str, list] = {n: [] for n in outputs}
        for value in column.to_pylist():
            plain, more = spans_of(value)
            every = sorted(plain + more)
            for name in outputs:
                if name == "spans":
                    made[name].append(listed(every))
                elif name == "base_sha256":
                    made[name].append(hashlib.sha256(listed(plain).encode()).hexdigest())
                elif name == "redacted":
                    made[name].append(redacted(value, every) if every else value)
                elif name == "n_added":
                    made[name].append(len(more))
                else:
                    made[name].append(sum(KINDS[k] == name[2:] for k, _, _ in plain))
        return {n: pa.array(v, type=pa.string() if OUTPUTS[n] == "string" else pa.int64()) for n, v in made.items()}

    return add_columns(docs, text, run, {n: OUTPUTS[n] for n in outputs})
