"""Words of a text as expressions: A-Z lower-cased, then runs of digits, a-z and characters beyond ASCII."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """Only A-Z change; a text of ASCII alone takes the quick way to the same result."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The words in order; none for a null or empty text."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN), "")


def keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, a hash of the text and the words. Rows of one id but different texts stay apart; equal rows count as one."""
    t = F.col(f"`{text}`")
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.coalesce(t, F.lit(""))).alias("text_hash"), words(t).alias("words"))
