"""HS code, number and date expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_FORMATS = ["yyyy-MM-dd", "dd/MM/yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd"]


def hs_plain(code: Column) -> Column:
    """Code as text without the ``.0`` a spreadsheet adds; empty when null."""
    return F.trim(F.regexp_replace(F.coalesce(code, F.lit("")), r"\.0$", ""))


def hs_digits(code: Column) -> Column:
    return F.regexp_replace(F.coalesce(code, F.lit("")), r"\D", "")


def hs_valid(code: Column, min_digits: int = 4) -> Column:
    digits = hs_digits(code)
    return F.when(F.length(digits) >= min_digits, digits)


def hs_heading(code: Column) -> Column:
    """First four digits, null when there are fewer."""
    return F.substring(hs_valid(code), 1, 4)


def parse_number(text: Column) -> Column:
    """Number in a text with separators, currency signs and units; null when it is none. Latin letters are dropped."""
    return F.regexp_replace(text, r"[,$\s]|[a-zA-Z]+", "").try_cast("double")


def parse_date(text: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Date in the first format that fits; null when none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("date")


def month_of(date: Column, month_text: Column) -> Column:
    """Month of the date, else the last two characters of the month column."""
    return F.coalesce(F.month(date), F.right(month_text, F.lit(2)).try_cast("int"))


def iso_date(date: Column) -> Column:
    return F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.lit(""))


def month_name(month: Column) -> Column:
    """Month as text in the older table form; empty when there is none."""
    return F.coalesce(F.concat(F.lit("Tháng "), month.cast("string")), F.lit(""))
