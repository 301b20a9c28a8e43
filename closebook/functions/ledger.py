"""Expressions on ledger cells: amounts, periods, codes and file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from closebook.functions.text import non_empty
from closebook.schemas import AMOUNT, RATE, REPORTED


PERIOD_PATTERN = r"(20\d{2})(0[1-9]|1[0-2])"
ENTITY_PATTERN = r"(?i)TB_([^_\.]+)"


def is_blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def _parse(c: Column, kind: T.DecimalType) -> Column:
    # A failed cast raises and catches an exception for its cell, which is slow; most blanks
    # and words are told apart by their first character.
    return F.when(c.cast("string").rlike(r"^[\x00-\x20]*[+-]?[0-9.]"), c.try_cast(kind))


def parse_amount(c: Column) -> Column:
    """Amount of a text cell, NULL where it is no number."""
    return _parse(c, AMOUNT)


def too_large(c: Column) -> Column:
    """True for a text cell that is a number but has no place in an amount."""
    failed = parse_amount(c).isNull() & c.rlike(r"^[\x00-\x20]*[+-]?[0-9.]")
    return F.coalesce(F.when(failed, c.try_cast("double").isNotNull()), F.lit(False))


def amount(c: Column) -> Column:
    """Amount of a text cell, zero where it is no number; ``too_large`` tells what does not fit."""
    return F.coalesce(parse_amount(c), F.lit(0).cast(AMOUNT))


def amount_of(df: DataFrame, name: str) -> Column:
    """Amount in a column of any type, zero where it is no number; ``too_large_of`` tells what does not fit."""
    c = F.col(name)
    if df.schema[name].dataType == T.StringType():
        return amount(c)
    return F.coalesce(c.try_cast(AMOUNT), F.lit(0).cast(AMOUNT))


def too_large_of(df: DataFrame, name: str) -> Column:
    """True for a number in a column of any type that has no place in an amount."""
    c = F.col(f"`{name}`")
    kind = df.schema[name].dataType
    if kind == T.StringType():
        return too_large(c)
    number = ~F.isnan(c) if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType) else F.lit(True)
    return c.isNotNull() & number & c.try_cast(AMOUNT).isNull()


def parse_rate(c: Column) -> Column:
    """Rate of a text cell, NULL where it is no number."""
    return _parse(c, RATE)


def period_key(c: Column) -> Column:
    """First six digits of a period cell; NULL when it has none."""
    return non_empty(F.substring(F.regexp_replace(c.cast("string"), "[^0-9]", ""), 1, 6))


def is_period(c: Column) -> Column:
    """True for a real ``YYYYMM`` of this century."""
    return F.coalesce(c.rlike("^" + PERIOD_PATTERN + "$"), F.lit(False))


def currency_code(c: Column) -> Column:
    return F.upper(non_empty(F.trim(c)))


def debit_part(amt: Column) -> Column:
    return F.when(amt > 0, amt).otherwise(F.lit(0).cast(AMOUNT))


def credit_part(amt: Column) -> Column:
    return F.when(amt < 0, (-amt).cast(AMOUNT)).otherwise(F.lit(0).cast(AMOUNT))


def file_name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def period_in_name(file_name: Column) -> Column:
    """First ``YYYYMM`` in a file name, else NULL."""
    return non_empty(F.regexp_extract(file_name, PERIOD_PATTERN, 0))


def entity_in_name(file_name: Column) -> Column:
    """Entity part of a ``TB_{entity}_...`` file name, else NULL."""
    return non_empty(F.regexp_extract(file_name, ENTITY_PATTERN, 1))


def local_amount(debit: Column, credit: Column) -> Column:
    zero = F.lit(0).cast(AMOUNT)
    return (F.coalesce(debit, zero) - F.coalesce(credit, zero)).cast(AMOUNT)


def reporting_amount(local: Column, rate: Column) -> Column:
    return F.round(local * rate, 2).cast(REPORTED)
