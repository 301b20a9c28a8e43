"""Fields of free-form records held as VARIANT, one record per row.

The expressions are SQL text over column names. A record is first turned into a map of texts,
so that looking for a field under several keys reads the record once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closebook.functions.text import WS_CHARS
from closebook.schemas import ITEM_CODE_KEYS, NESTED_LIST_KEYS, SERVICE_LIST_KEYS

_SPACES = "".join(f"\\u{ord(c):04x}" for c in WS_CHARS)
_FILLED = "NOT IN ('', '[]')"


def field_texts(record: str = "record") -> Column:
    """All fields of a record as text; lists and objects as JSON."""
    return F.try_variant_get(record, "$", "map<string,string>")


def first_field(keys: Sequence[str], texts: str = "texts", default: str | None = None) -> Column:
    """First value under ``keys`` that is not null, ``""`` or ``[]``; zero counts as a value."""
    found = F.expr(_first([f"{texts}['{k}']" for k in keys]))
    return found if default is None else F.coalesce(found, F.lit(default))


def _first(values: Sequence[str]) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN {v} {_FILLED} THEN {v} END" for v in values) + ")"


def service_value(record: str = "record", texts: str = "texts") -> Column:
    """First service assignment that is not null, ``""`` or ``[]``, as VARIANT."""
    cases = [
        f"WHEN {texts}['{k}'] {_FILLED} THEN try_variant_get({record}, '$.{k}', 'variant')"
        for k in SERVICE_LIST_KEYS
    ]
    return F.expr("CASE " + " ".join(cases) + " END")


_WRAPPED = '"(' + "|".join(NESTED_LIST_KEYS) + ')":'
_ITEM = "struct<code:string,value:variant>"


def _unwrapped(v: str) -> str:
    """The parts of a service value, one wrapper taken off: codes, and values still to be taken apart.

    Text is split, list elements are taken whole (an object by its code key); elements of a wrapped list
    are service values again, so text among them is split. An object without such a list is its own code.
    """

    def code_of(x: str) -> str:
        return _first([f"try_variant_get({x}, '$.{k}', 'string')" for k in ITEM_CODE_KEYS])

    def final(codes: str) -> str:
        return f"transform({codes}, c -> struct(c AS code, cast(NULL AS variant) AS value))"

    lists = ", ".join(f"try_variant_get({v}, '$.{k}', 'array<variant>')" for k in NESTED_LIST_KEYS)
    wrapped = f"get(filter(array({lists}), l -> size(l) > 0), 0)"
    return f"""CASE substr(schema_of_variant({v}), 1, 5)
      WHEN 'STRIN' THEN {final(f"split(try_variant_get({v}, '$', 'string'), '[;,]')")}
      WHEN 'ARRAY' THEN {final(f"""transform(try_variant_get({v}, '$', 'array<variant>'), i ->
        CASE WHEN schema_of_variant(i) LIKE 'OBJECT%' THEN {code_of('i')} ELSE try_variant_get(i, '$', 'string') END)""")}
      WHEN 'OBJEC' THEN coalesce(transform({wrapped}, w -> struct(cast(NULL AS string) AS code, w AS value)), {final(f"filter(array({code_of(v)}), c -> c IS NOT NULL)")})
      ELSE cast(array() AS array<{_ITEM}>) END"""


def codes_of(value: str) -> Column:
    """Codes of a service value: trimmed, upper-cased, each once, in order, below any number of wrappers.

    Each step takes one wrapper off every value of a list, in place. A value is wrapped no more often
    than its text names a wrapping key, so that many steps, and one for the value itself, leave none.
    """
    steps = f"sequence(0, regexp_count(coalesce(try_variant_get({value}, '$', 'string'), ''), '{_WRAPPED}'))"
    step = f"CASE WHEN exists(items, i -> i.value IS NOT NULL) THEN flatten(transform(items, i -> CASE WHEN i.value IS NULL THEN array(i) ELSE {_unwrapped('i.value')} END)) ELSE items END"
    start = f"cast(array(struct(cast(NULL AS string) AS code, {value} AS value)) AS array<{_ITEM}>)"
    clean = f"aggregate({steps}, {start}, (items, n) -> {step}, items -> transform(items, i -> upper(trim(BOTH '{_SPACES}' FROM i.code))))"
    return F.expr(f"array_distinct(filter({clean}, c -> c <> ''))")


def with_texts(df: DataFrame, record: str = "record") -> DataFrame:
    """Add ``texts``, in a projection of its own so that it is computed once per row."""
    return df.withColumn("texts", field_texts(record))


def with_service_codes(df: DataFrame, record: str = "record") -> DataFrame:
    """Add ``codes``; ``texts`` must be there."""
    valued = df.withColumn("_services", service_value(record))
    return valued.withColumn("codes", codes_of("_services")).drop("_services")
