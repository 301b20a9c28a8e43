"""Raw trial-balance rows to the canonical ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closebook.functions import ledger as L
from closebook.operators.columns import add_missing, resolve_columns, resolve_headers
from closebook.operators.lookup import lookup_join
from closebook.schemas import AMOUNT, TB
from closebook.session import staged
from closebook.sources.files import RawTables


def split_amount(df: DataFrame, column: str = "Amount") -> DataFrame:
    """Signed amount to Debit and Credit, where the table has not both of them already."""
    if column not in df.columns or {"Debit", "Credit"} <= set(df.columns):
        return df
    amt = L.amount_of(df, column)
    return df.withColumns({"Debit": L.debit_part(amt), "Credit": L.credit_part(amt)})


def coerce_ledger(df: DataFrame) -> DataFrame:
    """Typed amounts, period and currency; absent ledger columns are added."""
    present = set(df.columns)
    typed = {c: L.amount_of(df, c) for c in ("Debit", "Credit") if c in present}
    if "Period" in present:
        typed["Period"] = L.period_key(F.col("Period"))
    if "CurrencyCode" in present:
        typed["CurrencyCode"] = L.currency_code(F.col("CurrencyCode"))
    df = df.withColumns(typed) if typed else df
    zero = F.lit(0).cast(AMOUNT)
    defaults = {
        f.name: zero if f.dataType == AMOUNT else F.lit(None).cast(f.dataType) for f in TB.fields
    }
    return add_missing(df, defaults)


def normalize_ledger(df: DataFrame, fuzzy: bool = True, report: bool = False) -> DataFrame:
    """Resolve headers, split a single amount column, then coerce and complete the columns.

    With ``report`` each row counts its amounts that do not fit, and so became zero, in ``too_large``; the
    file report adds them up.
    """
    found = resolve_columns(df, TB.names, fuzzy)
    if report:
        sides = [c for c in ("Debit", "Credit") if c in found.columns]
        read = ["Amount"] if "Amount" in found.columns and len(sides) < 2 else sides
        found = found.withColumn("too_large", sum((L.too_large_of(found, c).cast("int") for c in read), F.lit(0)))
    return coerce_ledger(split_amount(found))


def blank_files(df: DataFrame, file_col: str = "file_name") -> DataFrame:
    """Files whose entity or period is blank in every row. One row per such file."""
    flags = df.groupBy(file_col).agg(
        F.bool_and(L.is_blank(F.col("EntityCode"))).alias("entity_blank"),
        F.bool_and(L.is_blank(F.col("Period"))).alias("period_blank"),
    )
    return flags.filter("entity_blank OR period_blank")


def fill_from_name(
    df: DataFrame,
    file_col: str = "file_name",
    fill: str = "file",
    small: bool | None = None,
) -> DataFrame:
    """Fill blank entity and period from the file name.

    ``fill="file"`` does so only where the whole file is blank, ``fill="row"`` in each
    blank row. ``small`` is passed on to the lookup of blank files.
    """
    entity, period = L.entity_in_name(F.col(file_col)), L.period_in_name(F.col(file_col))
    if fill == "row":
        return df.withColumns(
            {
                "EntityCode": F.when(L.is_blank(F.col("EntityCode")), entity).otherwise(F.col("EntityCode")),
                "Period": F.when(L.is_blank(F.col("Period")), period).otherwise(F.col("Period")),
            }
        )
    columns = df.columns
    blank = staged(blank_files(df, file_col), "blank_files")
    flagged = lookup_join(df, blank, [file_col], small=small)
    return flagged.withColumns(
        {
            "EntityCode": F.when(
                F.col("entity_blank"), F.coalesce(entity, F.col("EntityCode"))
            ).otherwise(F.col("EntityCode")),
            "Period": F.when(
                F.col("period_blank"), F.coalesce(period, F.col("Period"))
            ).otherwise(F.col("Period")),
        }
    ).select(*columns)


def project(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Exactly the required columns, in their order."""
    return df.select(*[F.col(f"`{c}`") for c in required])


def file_headers(headers: DataFrame, required: Sequence[str], fuzzy: bool = True) -> DataFrame:
    """Per file: where each column sits, how many were renamed, which required ones it lacks.

    Ledger columns are never lacking, as absent ones are added.
    """
    extra = [c for c in required if c not in TB.names]
    found = resolve_headers(headers, TB.names, fuzzy)
    found = found.withColumn("_canonical", F.map_keys("resolved"))
    places = [
        F.coalesce(F.array_position("header", F.element_at("resolved", c)), F.lit(0)).alias(c)
        for c in TB.names
    ] + [F.array_position("header", c).alias(c) for c in dict.fromkeys(["Amount", *extra])]
    lacking = F.array_except(
        F.array(*[F.lit(c) for c in extra]).cast("array<string>"), F.col("header")
    )
    return found.select(
        "file_path",
        "file_name",
        F.struct(*places).alias("place"),
        F.size(F.array_except("_canonical", "header")).alias("aliased"),
        lacking.alias("missing"),
    )


def ledger_of_cells(raw: RawTables, required: Sequence[str], small: bool | None = None) -> DataFrame:
    """Canonical ledger rows of files with different headers.

    ``raw.headers`` comes from ``file_headers``. A single amount column is split where the
    file has not both Debit and Credit. ``too_large`` counts a row's amounts that do not fit;
    ``_file``, ``_block`` and ``_row`` (ORDER) give the order of the rows.
    """
    extra = [c for c in required if c not in TB.names]
    places = raw.headers.select("file_path", "place")
    rows = lookup_join(raw.rows, places, ["file_path"], small=small)

    def cell(name: str) -> Column:
        return F.get("cells", (F.col(f"place.`{name}`") - 1).cast("int"))

    split = (F.col("place.Amount") > 0) & (F.least("place.Debit", "place.Credit") == 0)
    amt = L.amount(cell("Amount"))
    large = [L.too_large(cell(c)).cast("int") for c in ("Amount", "Debit", "Credit")]
    return rows.select(
        "file_name",
        F.when(split, large[0]).otherwise(large[1] + large[2]).alias("too_large"),
        F.col("file_path").alias("_file"),
        F.col("block").alias("_block"),
        F.col("row_no").alias("_row"),
        cell("EntityCode").alias("EntityCode"),
        cell("AccountCode").alias("AccountCode"),
        cell("AccountName").alias("AccountName"),
        F.when(split, L.debit_part(amt)).otherwise(L.amount(cell("Debit"))).alias("Debit"),
        F.when(split, L.credit_part(amt)).otherwise(L.amount(cell("Credit"))).alias("Credit"),
        L.period_key(cell("Period")).alias("Period"),
        L.currency_code(cell("CurrencyCode")).alias("CurrencyCode"),
        *[cell(c).alias(c) for c in extra],
    )
