"""Checks on a ledger: balance, per-file report, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closebook.functions import ledger as L
from closebook.schemas import AMOUNT


def total(df: DataFrame, column: str) -> Column:
    """Sum of a column, cells that are no number counting as zero."""
    return F.coalesce(F.sum(L.amount_of(df, column)), F.lit(0).cast(AMOUNT))


def is_balanced(debit: Column, credit: Column) -> Column:
    """Debits equal credits to the cent."""
    return F.round(debit - credit, 2) == 0


def balance_check(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Debit and credit totals per group, and whether they agree."""
    sums = df.groupBy(*by).agg(total(df, "Debit").alias("debit"), total(df, "Credit").alias("credit"))
    return sums.withColumn("balanced", is_balanced(F.col("debit"), F.col("credit")))


def debits_equal_credits(df: DataFrame) -> bool:
    """Whole-table balance; False where a column is absent or an amount does not fit."""
    if not {"Debit", "Credit"} <= set(df.columns):
        return False
    large = F.coalesce(F.bool_or(L.too_large_of(df, "Debit") | L.too_large_of(df, "Credit")), F.lit(False))
    sums = df.agg(total(df, "Debit").alias("debit"), total(df, "Credit").alias("credit"), large.alias("large"))
    return bool(sums.select(is_balanced(F.col("debit"), F.col("credit")) & ~F.col("large")).first()[0])


def file_report(df: DataFrame, file_col: str = "file_name") -> DataFrame:
    """Per file: rows, totals, periods that are no real month, and whether it balances.

    If ``df`` counts amounts that are too large (``too_large``), their number per file as well.
    """
    counted = [F.sum("too_large").alias("too_large")] if "too_large" in df.columns else []
    report = df.groupBy(file_col).agg(
        F.count("*").alias("rows"),
        total(df, "Debit").alias("debit"),
        total(df, "Credit").alias("credit"),
        F.count_if(~L.is_period(F.col("Period"))).alias("odd_periods"),
        *counted,
    )
    return report.withColumn("balanced", is_balanced(F.col("debit"), F.col("credit")))


def collect_metrics(raw: DataFrame, file_col: str = "file_name") -> DataFrame:
    """One row: files, rows, and files whose entity or period comes from their name."""
    hint_entity, hint_period = L.entity_in_name(F.col(file_col)), L.period_in_name(F.col(file_col))
    per_file = raw.groupBy(file_col).agg(
        F.count("*").alias("n"),
        F.bool_and(L.is_blank(F.col("EntityCode"))).alias("entity_blank"),
        F.bool_and(L.is_blank(F.col("Period"))).alias("period_blank"),
    )
    return per_file.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count_if(F.col("entity_blank") & hint_entity.isNotNull()).alias(
            "entity_inferred_from_filename"
        ),
        F.count_if(F.col("period_blank") & hint_period.isNotNull()).alias(
            "period_inferred_from_filename"
        ),
    )
