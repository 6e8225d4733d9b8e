"""From an uploaded table, whatever its column names, to the fixed cleaned columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoline import constants as K
from cargoline.functions import codes, text


def column(df: DataFrame, name: str, default: str | None = "") -> Column:
    """The column, or a default literal where the table lacks it."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(default).cast("string")


def first_present(df: DataFrame, candidates: Sequence[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in candidates if c in df.columns]


def resolve_description(df: DataFrame, candidates: Sequence[str] = K.DESCRIPTION_CANDIDATES) -> Column:
    """First candidate of the row that is neither null nor blank; empty text when there is none."""
    present = first_present(df, candidates)
    return F.coalesce(*[F.when(text.strip(c) != "", c) for c in present], F.lit(""))


def resolve_hs(df: DataFrame, candidates: Sequence[str] = K.HS_CANDIDATES) -> Column:
    """First non-null code of the row as plain text; empty when there is none."""
    return codes.hs_plain(F.coalesce(*first_present(df, candidates), F.lit("")))


def required_columns(df: DataFrame) -> None:
    """Raise when no column can hold the code or the description: known from the schema, no job needed."""
    for what, candidates in (("HS code", K.HS_CANDIDATES), ("description", K.DESCRIPTION_CANDIDATES)):
        if not first_present(df, candidates):
            raise ValueError(f"no {what} column among {df.columns}")


def with_trade(df: DataFrame, direction: str | Column | None = None) -> DataFrame:
    """Add importer, exporter, country and trade direction, by which party columns the table has. Export is tried first; where a table
    has the columns of both, each row goes by the parties it names.

    ``direction`` overrides the detected direction; as a Column it does so per row where it is not null.
    """
    filled = lambda *names: F.coalesce(*[F.trim(F.col(f"`{n}`")) != "" for n in names if n in df.columns], F.lit(False))
    any_filled = lambda *names: reduce(lambda x, y: x | y, [filled(n) for n in names])
    exports, imports = "VN_Exporter" in df.columns, "VN_Importer" in df.columns
    out = {
        "exporter": F.coalesce(column(df, "VN_Exporter"), column(df, "VN_Exporter_EN")), "importer": column(df, "Foreign_Importer"),
        "country": F.coalesce(column(df, "Destination_Country"), column(df, "Destination_Country_CN", None))}
    into = {
        "importer": F.coalesce(column(df, "VN_Importer"), column(df, "VN_Importer_EN")), "exporter": column(df, "Foreign_Exporter"),
        "country": F.coalesce(column(df, "Origin_Country"), column(df, "Origin_Country_CN", None))}
    if exports and imports:
        # a union of files of both kinds: the parties that a row names decide, export first
        is_export = any_filled("VN_Exporter", "VN_Exporter_EN", "Foreign_Importer") | ~any_filled("VN_Importer", "VN_Importer_EN", "Foreign_Exporter")
        importer, exporter, country = (F.when(is_export, out[c]).otherwise(into[c]) for c in ("importer", "exporter", "country"))
        detected = F.when(is_export, "export").otherwise("import")
    elif exports or imports:
        importer, exporter, country = ((out if exports else into)[c] for c in ("importer", "exporter", "country"))
        detected = F.lit("export" if exports else "import")
    else:
        importer = exporter = country = detected = F.lit("")
    if direction is None or isinstance(direction, str):
        final = F.lit(direction) if direction else detected
    else:
        final = F.coalesce(direction, detected)
    return df.withColumns({"importer": importer, "exporter": exporter, "country": country, "trade_direction": final})


def standardize(df: DataFrame, direction: str | Column | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """One row per input row in the cleaned columns, plus trade direction and ``extra`` columns of the input.

    Label columns and status are null here; classification fills them.
    """
    required_columns(df)
    # resolve once, in an own projection, so that no later expression repeats the choice
    named = with_trade(df, direction).withColumns({
        "_product": resolve_description(df), "_hs": resolve_hs(df),
        "_date": codes.parse_date(column(df, "Date", None)),
    })
    values = {
        "date": codes.iso_date(F.col("_date")),
        "hs_code": F.col("_hs"),
        "importer": F.col("importer"),
        "product_name": F.col("_product"),
        "unit": column(df, "Unit_Qty"),
        "quantity": codes.parse_number(column(df, "Quantity", None)),
        "total_value_usd": codes.parse_number(column(df, "Total_Value_USD", None)),
        "unit_price_usd": codes.parse_number(column(df, "Unit_Price_USD", None)),
        "brand": text.brand(F.col("_product")),
        "power": text.power_rating(F.col("_product")),
        "country": F.col("country"),
        "continent": column(df, "Continent"),
        "exporter": F.col("exporter"),
        "incoterms": column(df, "Incoterms"),
        "method_of_payment": column(df, "Method_of_Payment"),
    }
    month = codes.month_of(F.col("_date"), column(df, "Month", None))
    fixed = [values.get(c, F.lit(None).cast("string")).alias(c) for c in K.CLEAN_COLUMNS]
    return named.select(*extra, *fixed, month.alias("month"), F.col("trade_direction"))


def search_rows(df: DataFrame, needle: str, columns: Sequence[str], only_status: str | None = None) -> DataFrame:
    """Rows with ``needle`` in any of ``columns``, case ignored, optionally of one status only."""
    found = df if only_status is None else df.where(F.col("status") == only_status)
    if not needle:
        return found
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(needle.lower())), F.lit(False))
    return found.where(hit)


def slice_of(status: Column) -> Column:
    """Output slice of a row: accepted, review, or other."""
    return F.when(F.startswith(status, F.lit("auto")), F.lit("accepted")).when(
        status == K.STATUS_REVIEW, F.lit("review")).otherwise(F.lit("other"))


def distinct_codes(df: DataFrame, hs_column: str = "hs_code") -> DataFrame:
    """Distinct valid codes with their row counts."""
    return df.select(codes.hs_valid(F.col(hs_column)).alias("code")).where("code is not null").groupBy("code").agg(
        F.count("*").alias("n_rows"))
