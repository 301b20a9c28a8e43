"""Rates and currency translation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closebook.functions import ledger as L
from closebook.operators.columns import add_missing, resolve_columns
from closebook.operators.lookup import keep_last, lookup_join
from closebook.schemas import FX_ADJ, FX_RATES


def clean_rates(
    df: DataFrame, order_by: Sequence[str], rate_period: str | None = None, fuzzy: bool = True
) -> DataFrame:
    """One rate per currency: headers resolved, codes upper-cased, last by ``order_by`` wins.

    A rate that is no number is kept as NULL and counts as missing in translation.
    """
    raw = resolve_columns(df, FX_RATES.names, fuzzy)
    raw = add_missing(raw, {"Period": F.lit(None).cast("string")})
    if rate_period is not None:
        raw = raw.filter(L.period_key(F.col("Period")) == rate_period)
    rates = raw.select(
        L.currency_code(F.col("CurrencyCode")).alias("CurrencyCode"),
        L.parse_rate(F.col("FXRate")).alias("FXRate"),
        F.struct(*order_by).alias("_order"),
    ).filter(F.col("CurrencyCode").isNotNull())
    return keep_last(rates, ["CurrencyCode"], ["_order"]).drop("_order")


def rates_from_json(df: DataFrame, payload: str | Column, wrapper: str | None = "rates") -> DataFrame:
    """Rows (CurrencyCode, FXRate) of a JSON payload ``{"rates": {"eur": 1.1}}``.

    ``wrapper=None`` reads a payload that is the code -> rate object itself.
    """
    schema = f"{wrapper} map<string,double>" if wrapper else "map<string,double>"
    parsed = F.from_json(payload, schema)
    rates = parsed.getField(wrapper) if wrapper else parsed
    return df.select(*df.columns, F.explode(rates).alias("_code", "_rate")).select(
        *df.columns,
        F.upper("_code").alias("CurrencyCode"),
        L.parse_rate(F.col("_rate")).alias("FXRate"),
    )


def rates_of_payloads(payloads: DataFrame, wrapper: str = "rates") -> tuple[DataFrame, DataFrame]:
    """Rates (CurrencyCode, FXRate as text, origin) of JSON payloads, and what is wrong with them.

    ``payloads`` has payload, a document ``{"rates": {"eur": 1.1}}``, and origin, its name. The second table
    has (origin, code, value, reason): a row for each payload that is no JSON or holds no object of rates, and
    for each rate that is no number or too large. Nothing vanishes.
    """
    rates_at = f"try_variant_get(document, '$.{wrapper}', 'map<string,variant>')"
    parsed = payloads.select("origin", "payload", F.try_parse_json("payload").alias("document"))
    read = parsed.withColumn("rates", F.expr(rates_at))
    whole = read.filter("rates IS NULL").select(
        "origin", F.lit(None).cast("string").alias("code"), F.substring("payload", 1, 200).alias("value"),
        F.when(F.col("document").isNull(), "is no JSON").otherwise(f"has no object of {wrapper}").alias("reason"),
    )
    each = read.filter("rates IS NOT NULL").select("origin", F.explode("rates").alias("code", "rate"))
    each = each.withColumn("value", F.expr("try_variant_get(rate, '$', 'string')"))
    wrong = each.select("origin", "code", "value", _unusable(F.col("value")).alias("reason")).filter("reason IS NOT NULL")
    named = wrong.withColumn("reason", F.concat(F.lit("rate of "), "code", F.lit(" "), "reason"))
    good = each.select(F.col("code").alias("CurrencyCode"), F.col("value").alias("FXRate"), "origin")
    return good, whole.unionByName(named)


def _unusable(value: Column) -> Column:
    """Why a rate's text can't be used; NULL if it can."""
    return F.when(L.parse_rate(value).isNull(), F.when(value.try_cast("double").isNotNull() & ~F.isnan(value.try_cast("double")), "is too large").otherwise("is no number"))


def too_large_rates(df: DataFrame, order_by: Sequence[str], fuzzy: bool = True) -> DataFrame:
    """(origin, code, value, reason) of the rates that are numbers without a place in a rate."""
    raw = resolve_columns(df, FX_RATES.names, fuzzy)
    value = F.col("FXRate").cast("string")
    found = raw.select(
        F.concat_ws(" ", F.lit("rate"), *[F.col(c).cast("string") for c in order_by]).alias("origin"),
        L.currency_code(F.col("CurrencyCode")).alias("code"), value.alias("value"), _unusable(value).alias("reason"),
    ).filter("reason = 'is too large' AND code IS NOT NULL")
    return found.withColumn("reason", F.concat(F.lit("rate of "), "code", F.lit(" "), "reason"))


def missing_codes(tb: DataFrame, rates: DataFrame) -> DataFrame:
    """Distinct ledger currencies without a usable rate, sorted; no code reads ``<blank>``.

    The ledger is reduced to its distinct codes first, so the join never sees a hot key.
    """
    codes = tb.select("CurrencyCode").distinct()
    usable = rates.filter(F.col("FXRate").isNotNull()).select("CurrencyCode")
    lacking = codes.join(usable, "CurrencyCode", "left_anti")
    return lacking.select(
        F.coalesce("CurrencyCode", F.lit("<blank>")).alias("CurrencyCode")
    ).orderBy("CurrencyCode")


def translate(tb: DataFrame, rates: DataFrame, small: bool | None = None) -> DataFrame:
    """Add FXRate, LocalAmount and ReportingCurrencyAmount to each ledger row.

    ``rates`` holds each currency once (``clean_rates``). Rows without a rate keep NULLs;
    ``missing_codes`` names them.
    """
    tb = add_missing(tb, {c: F.lit(0) for c in ("Debit", "Credit")})
    joined = lookup_join(tb, rates.select("CurrencyCode", "FXRate"), ["CurrencyCode"], small=small)
    local = L.local_amount(F.col("Debit"), F.col("Credit"))
    amounts = {
        "LocalAmount": local,
        "ReportingCurrencyAmount": L.reporting_amount(local, F.col("FXRate")),
    }
    return joined.withColumns(amounts).select(
        *tb.columns, "FXRate", "LocalAmount", "ReportingCurrencyAmount"
    )


def adjustments(adjusted: DataFrame, period: str) -> DataFrame:
    """The adjustment table: its six columns, Period being the run period."""
    return adjusted.withColumn("Period", F.lit(period)).select(*FX_ADJ.names)
