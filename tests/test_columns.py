"""Header resolution."""

from __future__ import annotations

import random

from closebook.operators import columns as C
from closebook.schemas import FX_RATES, TB


def test_alias_and_case(spark):
    df = spark.createDataFrame(
        [("US1", "1000", "100", 50, "2025-01", "usd", "m")],
        ["Entity", "account", "Debit Amount", "CREDIT", "FiscalPeriod", "Currency", "Memo"],
    )
    found = C.resolve_columns(df, TB.names)
    assert found.columns == ["EntityCode", "AccountCode", "Debit", "Credit", "Period", "CurrencyCode", "Memo"]
    assert C.aliased_columns(df, TB.names) == 6


def test_first_alias_and_exact_name_win():
    assert C.match_header(["Company", "Entity"], TB.names) == {"EntityCode": "Entity"}
    assert C.match_header(["Entity", "entitycode"], TB.names) == {"EntityCode": "entitycode"}


def test_fuzzy_scores():
    assert C.token_set_score("Debit", "Debit USD") == 100
    assert C.token_set_score("Credit", "Credit Limit") == 100
    assert round(C.token_set_score("AccountName", "Account Name"), 1) == 95.7
    assert C.token_set_score("EntityCode", "Entity Code") < 90
    assert C.token_set_score("Debit", "") == 0


def longest_common(a, b):
    if not a or not b:
        return 0
    if a[0] == b[0]:
        return 1 + longest_common(a[1:], b[1:])
    return max(longest_common(a[1:], b), longest_common(a, b[1:]))


def test_common_length_against_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 7))) for _ in range(2))
        assert C._common_length(a, b) == longest_common(a, b)


def test_fuzzy_leaves_claimed_columns_alone():
    header = ["AccountCode", "Account Name", "Debit USD", "Credit"]
    assert C.match_header(header, TB.names) == {
        "AccountCode": "AccountCode",
        "AccountName": "Account Name",
        "Debit": "Debit USD",
        "Credit": "Credit",
    }
    assert "AccountName" not in C.match_header(header, TB.names, fuzzy=False)


def test_rates_header():
    assert C.match_header(["ISO Currency", "FX", "Period", "Source"], FX_RATES.names)["FXRate"] == "FX"


def test_headers_on_executors(spark):
    headers = spark.createDataFrame(
        [("a", ["Entity", "Dr"]), ("b", ["Company", "Amount"]), ("c", [])], "f string, header array<string>"
    )
    found = C.resolve_headers(headers, TB.names).orderBy("f").collect()
    assert [r["resolved"] for r in found] == [
        {"EntityCode": "Entity", "Debit": "Dr"},
        {"EntityCode": "Company"},
        {},
    ]


def test_missing(spark):
    df = spark.createDataFrame([(1, 2)], ["A", "B"])
    assert C.missing_columns(df, ["A", "C"]) == ["C"]
    headers = spark.createDataFrame([(["A", "B"],)], "header array<string>")
    assert C.missing_in_headers(headers, ["D", "A", "C"]).first()["missing"] == ["D", "C"]
