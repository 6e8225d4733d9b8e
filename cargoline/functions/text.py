"""Text expressions. Every function takes and returns Columns, so it runs inside the JVM and Catalyst sees it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cargoline import constants as K

_BLANK_ENDS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
_NOT_TEXT = f"[^a-z0-9{K.VIETNAMESE_LETTERS}]+"
_NOT_LETTER = f"[^a-z{K.VIETNAMESE_LETTERS}\\s]+"
_TWO_LETTERS = f"[a-z{K.VIETNAMESE_LETTERS}]{{2,}}"
_EMPTY = "cast(array() as array<string>)"


def no_strings() -> Column:
    return F.expr(_EMPTY)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _BLANK_ENDS, "")


def longest_segment(text: Column) -> Column:
    """The longest non-blank part between segment marks, the first one on ties; text without a mark stays as it is."""
    parts = F.filter(F.transform(F.split(text, K.SEGMENT_MARK), strip), lambda p: p != "")
    longest = F.aggregate(parts, F.lit(""), lambda best, p: F.when(F.length(p) > F.length(best), p).otherwise(best))
    marked = F.contains(text, F.lit(K.SEGMENT_MARK))
    return F.when(marked, F.coalesce(F.nullif(longest, F.lit("")), text)).otherwise(text)


def squeeze(text: Column) -> Column:
    """Lower-case letters and digits, single-spaced; everything else is a separator."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _NOT_TEXT, " "))


def clean_basic(text: Column) -> Column:
    """Cleaning for look-ups: lower case, longest segment, letters and digits only."""
    return squeeze(longest_segment(F.lower(F.coalesce(text, F.lit("")))))


def clean_deep(text: Column) -> Column:
    """Cleaning for keyword mining: also drops the code before the mark, model codes and numbers."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern, replacement in (
        (r"(?U)^[^#]*#\s*&?\s*", ""),
        (r"(?U)#\s*&?\s*vn\s*$", ""),
        (r"(?U)\b(?=[a-z0-9.-]*\d)(?=[a-z0-9.-]*[a-z])[a-z0-9.-]+\b", " "),
        (r"(?U)\b\d+(?:[.,]\d+)?\b", " "),
        ("(?U)" + _NOT_LETTER, " "),
        (r"(?U)\s+", " "),
    ):
        out = F.regexp_replace(out, pattern, replacement)
    return F.trim(out)


def words(text: Column) -> Column:
    """Words of single-spaced text; an empty array for empty text."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def _in(values: Sequence[str]) -> str:
    """The list after IN; a value no word can have stands for an empty one."""
    if not values:
        return "('')"
    return "(" + ", ".join("'" + v.replace("'", "\\'") + "'" for v in values) + ")"


def without(words_: str, stopwords: Sequence[str], min_length: int = 1) -> Column:
    """Array column named ``words_`` without stop words and shorter words.

    Written as SQL text, so that a long word list is one expression and becomes a hash set, not a chain of literals.
    """
    return F.expr(f"filter({words_}, w -> length(w) >= {min_length} AND w NOT IN {_in(stopwords)})")


def tokens(text: str, stopwords: Sequence[str] = K.LABEL_STOPWORDS) -> Column:
    """Words of the text column named ``text`` that have at least two characters and are no stop words."""
    return without(f"split({text}, ' ')", stopwords, 2)


def is_keyword(gram: str, stopwords: Sequence[str] = K.LABEL_STOPWORDS,
               excluded: Sequence[str] = K.KEYWORD_STOPWORDS) -> Column:
    """A phrase (column name) that can be a keyword: one word of it carries meaning, none of it is excluded.

    A word carries meaning when it is no stop word, has three characters, does not start with a digit, is not code-like
    and has two letters in a row.
    """
    words_ = f"split({gram}, ' ')"
    meaning = (f"w NOT IN {_in(stopwords)} AND length(w) >= 3 AND NOT w RLIKE r'(?U)^\\d' "
               f"AND NOT w RLIKE r'(?U)^(\\d+[a-z]+|[a-z]+\\d+)$' AND w RLIKE '{_TWO_LETTERS}'")
    return F.expr(f"exists({words_}, w -> {meaning}) AND NOT exists({words_}, w -> w IN {_in(excluded)})")


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body refers to it.

    Without this, Catalyst inlines an expression into every lambda that mentions it and evaluates it per array element.
    """
    return F.transform(F.array(value), body)[0]


def ngrams(tokens_: Column, n_min: int = 1, n_max: int = 3) -> Column:
    """Word n-grams, shorter ones first."""

    def of_length(words_: Column, n: int) -> Column:
        if n == 1:
            return words_
        grams = F.transform(F.sequence(F.lit(0), F.size(words_) - n),
                            lambda i: F.concat_ws(" ", *[F.get(words_, i + k) for k in range(n)]))
        return F.when(F.size(words_) >= n, grams).otherwise(no_strings())

    return bind(tokens_, lambda w: F.flatten(F.array(*[of_length(w, n) for n in range(n_min, n_max + 1)])))


def positioned_ngrams(tokens_: Column, n_max: Column) -> Column:
    """``struct(start, stop, gram)`` for every word n-gram up to ``n_max`` words (a Column, often a scalar subquery)."""

    def build(w: Column) -> Column:
        size = F.size(w)
        per_length = F.transform(
            F.sequence(F.lit(1), F.least(F.coalesce(n_max, F.lit(1)), size)),
            lambda n: F.transform(
                F.sequence(F.lit(0), size - n),
                lambda i: F.struct(i.alias("start"), (i + n - 1).alias("stop"),
                                   F.array_join(F.slice(w, i + 1, n), " ").alias("gram")),
            ),
        )
        return F.when(size > 0, F.flatten(per_length))

    return bind(tokens_, build)


def any_term(text: Column, terms: Sequence[str]) -> Column:
    """True when ``text`` contains any of ``terms`` as a substring: one alternation instead of one scan per term."""
    if not terms:
        return F.lit(False)
    specials = set("\\.[]{}()*+-?^$|/&#")
    pattern = "|".join("".join("\\" + ch if ch in specials else ch for ch in t) for t in terms)
    return text.rlike(pattern)


def power_rating(text: Column) -> Column:
    return F.trim(F.regexp_extract(F.lower(longest_segment(F.coalesce(text, F.lit("")))), K.POWER_PATTERN, 0))


def brand(text: Column, brands: Sequence[str] = K.BRANDS) -> Column:
    """First brand of the ordered list that occurs in the text, first letter upper-case; empty when none does."""
    lowered = F.lower(longest_segment(F.coalesce(text, F.lit(""))))
    found = [F.when(F.contains(lowered, F.lit(b)), F.lit(b[:1].upper() + b[1:])) for b in brands]
    return F.coalesce(*found, F.lit(""))


def infer_kind(description: Column, component_terms: Sequence[str] = K.COMPONENT_TERMS) -> Column:
    return F.when(any_term(F.lower(description), component_terms), F.lit("LK")).otherwise(F.lit("NC"))


def kind_by_rules(description: Column, mapped: Column, component_terms: Sequence[str] = K.KIND_RULE_TERMS) -> Column:
    """Kind by three rules: two component words or more make a component; else what the code's record says (``mapped``); else one component word
    makes one; else a finished good."""
    low = F.lower(F.coalesce(description, F.lit("")))
    found = sum((F.contains(low, F.lit(t)).cast("int") for t in component_terms), F.lit(0))
    return F.when(found >= 2, "LK").when(mapped.isin("NC", "LK"), mapped).when(found >= 1, "LK").otherwise("NC")


def line_name(description: Column) -> Column:
    """Product-line name from a heading text."""
    bare = F.regexp_replace(description, r"\(.*?\)", "")
    first = F.split(bare, r"(?iU)[;,]|\bhoặc\b|\bkể cả\b|\bdùng cho\b|\bdùng để\b")[0]
    name = F.regexp_replace(strip(first), r"(?U)^\W+|\W+$", "")
    name = F.trim(F.regexp_replace(name, r"(?U)\s+", " "))
    first_word = F.split(strip(description), r"(?U)\s+")[0]
    return F.when(F.coalesce(description, F.lit("")) == "", F.lit("")).when(
        F.length(name) > 3, F.concat(F.lit("SP "), F.upper(name))
    ).otherwise(F.concat(F.lit("SP "), F.upper(first_word)))


def industry_name(description: Column) -> Column:
    """Industry name from a tariff text: foreign-language brackets dropped, trimmed, first letter upper-case."""
    accented = K.VIETNAMESE_LETTERS + K.VIETNAMESE_LETTERS.upper()
    text = F.regexp_replace(description, rf"\([^){accented}]{{4,}}\)", "")
    text = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    text = F.regexp_replace(text, r"(?U)^\W+|\W+$", "")
    return F.coalesce(F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30)), F.lit(""))


def strip_hyphens(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "^[ -]+", ""))


def text_variants(text: Column, limit: int = 3) -> Column:
    """Up to ``limit`` shortened forms of a text, in a fixed order: head, head and tail, rest, then listed pieces."""

    def of(base: Column) -> Column:
        def with_parts(parts: Column) -> Column:
            n = F.size(parts)
            pick = lambda cond, arr: F.when(cond, F.array(F.array_join(arr, " "))).otherwise(no_strings())
            candidates = F.concat(
                pick(n >= 4, F.slice(parts, 1, 3)),
                pick(n >= 4, F.concat(F.slice(parts, 1, 2), F.slice(parts, -1, 1))),
                pick(n >= 3, F.slice(parts, 2, F.greatest(n - 1, F.lit(1)))),
                F.transform(F.split(base, "[,;/]"), strip),
            )
            kept = F.filter(candidates, lambda v: v.rlike(r"(?U)\S\s+\S") & (v != base))
            return F.slice(F.array_distinct(kept), 1, limit)

        return bind(F.filter(F.split(base, r"(?U)\s+"), lambda w: w != ""), with_parts)

    return bind(strip(F.lower(F.coalesce(text, F.lit("")))), of)


def split_keywords(text: Column, min_words: int = 1) -> Column:
    """Comma-separated keywords as an array of trimmed, non-empty strings with at least ``min_words`` words."""
    items = F.filter(F.transform(F.split(text, ","), strip), lambda k: k != "")
    if min_words > 1:
        items = F.filter(items, lambda k: F.size(F.split(k, r"(?U)\s+")) >= min_words)
    return items


def feature_text(brand_: Column, power: Column, product: Column) -> Column:
    """Brand, power and product in one cleaned text."""
    return squeeze(F.concat(F.lit("Hãng: "), brand_, F.lit(" - Công suất: "), power, F.lit(" - Sản phẩm: "), product))
