"""Label expressions: the four label parts, their combined text form and the alias vocabulary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cargoline import constants as K


def or_no_label(value: Column) -> Column:
    """The value, or the sentinel for null and the null words."""
    return F.when(value.isNull() | value.isin(K.NULL_WORDS), F.lit(K.NO_LABEL)).otherwise(value)


def combine(*parts: Column | str) -> Column:
    return F.concat_ws(K.LABEL_SEPARATOR, *parts)


def split_part(label: Column, index: int) -> Column:
    """Part ``index`` of a combined label; the sentinel when it is missing."""
    return F.coalesce(F.get(F.split(label, r" \| "), F.lit(index)), F.lit(K.NO_LABEL))


def alias_map(aliases: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])


def normalize_part(value: Column, level: str, aliases: Mapping[str, Mapping[str, str]] = K.LABEL_ALIASES) -> Column:
    """Canonical form of one label part: trim, alias, lower case for the two classes, sentinel for null words."""
    text = F.trim(F.coalesce(value, F.lit("nan")))
    default = F.lower(text) if level in ("class1", "class2") else text
    table = aliases.get(level) or {}
    named = F.coalesce(F.try_element_at(alias_map(table), text), default) if table else default
    return or_no_label(named)


def normalize_value(value: Column, level: str, aliases: Mapping[str, Mapping[str, str]] = K.LABEL_ALIASES) -> Column:
    """The mapping job's form: null words first, then alias, then lower case for the two classes."""
    text = F.trim(F.coalesce(value, F.lit("nan")))
    table = aliases.get(level) or {}
    named = F.coalesce(F.try_element_at(alias_map(table), text), text) if table else text
    if level in ("class1", "class2"):
        named = F.lower(named)
    return F.when(text.isin(K.NULL_WORDS), F.lit(K.NO_LABEL)).otherwise(named)


def normalize_combined(label: Column, aliases: Mapping[str, Mapping[str, str]] = K.LABEL_ALIASES) -> Column:
    """Canonical combined label; all sentinels for a null or blank label."""
    text = F.when(F.trim(F.coalesce(label, F.lit(""))) != "", label)
    return combine(*[normalize_part(split_part(text, i), level, aliases) for i, level in enumerate(K.LABEL_COLUMNS)])


def normalize_columns(columns: Sequence[str] = K.LABEL_COLUMNS, aliases=K.LABEL_ALIASES) -> Column:
    return combine(*[normalize_part(F.col(c), level, aliases) for c, level in zip(columns, K.LABEL_COLUMNS)])


def signature(label: Column) -> Column:
    """Label parts without the sentinel ones, joined by a bar."""
    kept = F.filter(F.split(label, r" \| "), lambda p: (F.lower(p) != K.NO_LABEL) & (F.trim(p) != ""))
    return F.array_join(kept, "|")
