"""Normalisation, file fill, checks and translation."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from closebook.operators import fx, normalize, quality
from closebook.schemas import AMOUNT, FX_ADJ, TB

TB_TEXT = "EntityCode string, AccountCode string, Debit string, Credit string, CurrencyCode string"


def test_normalize_aliased_text(spark):
    df = spark.createDataFrame(
        [("US1", "1000", "100", "50", "2025-01", "usd")],
        ["Entity", "Account", "Debit Amount", "Credit Amount", "FiscalPeriod", "Currency"],
    )
    tb = normalize.normalize_ledger(df)
    assert set(tb.columns) == set(TB.names)
    assert tb.select(TB.names).first() == ("US1", "1000", None, Decimal(100), Decimal(50), "202501", "USD")
    assert {f.name: f.dataType for f in tb.schema}["Debit"] == AMOUNT


def test_amount_only_file_is_split_before_defaults(spark):
    df = spark.createDataFrame([("7",), ("-7",), ("n/a",), (None,)], "Amount string")
    tb = normalize.normalize_ledger(df)
    assert [tuple(r) for r in tb.select("Debit", "Credit").collect()] == [(7, 0), (0, 7), (0, 0), (0, 0)]
    assert quality.debits_equal_credits(tb)


def test_amount_is_ignored_where_both_sides_exist(spark):
    df = spark.createDataFrame([("9", "1", "2")], "Amount string, Debit string, Credit string")
    assert normalize.normalize_ledger(df).select("Debit", "Credit").first() == (1, 2)


@pytest.mark.parametrize(
    ("schema", "large", "fits"),
    [("string", "1e16", "7"), ("double", 1e16, float("nan")), ("bigint", 10**17, 7), ("decimal(38,2)", Decimal(10) ** 20, Decimal(7)), ("double", float("inf"), 7.0)],
)
def test_amounts_that_do_not_fit_are_counted_for_any_type(spark, schema, large, fits):
    df = spark.createDataFrame([("f", large, fits), ("f", fits, None), ("g", fits, fits)], f"file_name string, Dr {schema}, Cr {schema}")
    tb = normalize.normalize_ledger(df, report=True)
    assert {r["file_name"]: r["too_large"] for r in quality.file_report(tb).collect()} == {"f": 1, "g": 0}
    signed = normalize.normalize_ledger(df.selectExpr("file_name", "Dr AS Amount"), report=True)
    assert sorted(r["too_large"] for r in signed.collect()) == [0, 0, 1]
    assert not quality.debits_equal_credits(df.selectExpr("Dr AS Debit", "Dr AS Credit"))
    assert quality.debits_equal_credits(df.filter("file_name = 'g'").selectExpr("Dr AS Debit", "Dr AS Credit"))


@pytest.fixture
def files(spark):
    return spark.createDataFrame(
        [
            ("TB_US_202501.xlsx", None, "", 1),
            ("TB_US_202501.xlsx", "", None, 2),
            ("TB_GB_202502.xlsx", None, "202412", 3),
            ("TB_GB_202502.xlsx", "UK", "", 4),
            ("ledger.xlsx", None, None, 5),
        ],
        "file_name string, EntityCode string, Period string, n int",
    )


@pytest.mark.parametrize("small", [True, False, None])
def test_fill_whole_files(files, small):
    got = normalize.fill_from_name(files, small=small).orderBy("n").collect()
    assert [(r["EntityCode"], r["Period"]) for r in got] == [
        ("US", "202501"),
        ("US", "202501"),
        (None, "202412"),
        ("UK", ""),
        (None, None),
    ]


def test_fill_rows(files):
    got = normalize.fill_from_name(files, fill="row").orderBy("n").collect()
    assert [(r["EntityCode"], r["Period"]) for r in got][2:4] == [("GB", "202412"), ("UK", "202502")]


def test_collect_metrics(files):
    assert quality.collect_metrics(files).first().asDict() == {
        "files": 3,
        "rows": 5,
        "entity_inferred_from_filename": 1,
        "period_inferred_from_filename": 1,
    }


@pytest.mark.parametrize("gap, even", [("0.004", True), ("0.005", False), ("0.01", False)])
def test_balance_edge(spark, gap, even):
    df = spark.createDataFrame([("100", "0"), ("0", str(Decimal(100) - Decimal(gap)))], "Debit string, Credit string")
    assert quality.debits_equal_credits(df) is even


def test_balance_of_plain_numbers(spark):
    assert quality.debits_equal_credits(spark.createDataFrame([(100, 75), (50, 75)], ["Debit", "Credit"]))
    assert not quality.debits_equal_credits(spark.createDataFrame([(100, 50)], ["Debit", "Credit"]))
    assert not quality.debits_equal_credits(spark.createDataFrame([(100,)], ["Debit"]))


def test_file_report(spark):
    df = spark.createDataFrame(
        [("a", "1", "1", "202501"), ("b", "1", "2", "012025")],
        "file_name string, Debit string, Credit string, Period string",
    )
    got = {r["file_name"]: (r["rows"], r["odd_periods"], r["balanced"]) for r in quality.file_report(df).collect()}
    assert got == {"a": (1, 0, True), "b": (1, 1, False)}


@pytest.fixture
def tb(spark):
    rows = [("E1", "A1", "100", "0", "USD"), ("E2", "A1", "0", "200", "EUR"), ("E3", "A1", None, "5", "EUR")]
    return spark.createDataFrame(rows, TB_TEXT).withColumns(
        {c: F.col(c).cast(AMOUNT) for c in ("Debit", "Credit")}
    )


def clean(spark, rows):
    raw = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "`ISO Currency` string, FX string, n int")
    return fx.clean_rates(raw, ["n"])


@pytest.mark.parametrize("small", [True, False, None])
def test_translate(spark, tb, small):
    rates = clean(spark, [("usd", "1"), ("eur", "9"), ("EUR ", "1.1")])
    got = fx.translate(tb, rates, small).orderBy("EntityCode").collect()
    assert [(r["LocalAmount"], r["FXRate"], r["ReportingCurrencyAmount"]) for r in got] == [
        (100, 1, 100),
        (-200, Decimal("1.1"), Decimal("-220.00")),
        (-5, Decimal("1.1"), Decimal("-5.50")),
    ]
    adj = fx.adjustments(fx.translate(tb, rates), "202301")
    assert adj.columns == FX_ADJ.names
    assert {r["Period"] for r in adj.collect()} == {"202301"}


def test_missing_codes(spark, tb):
    more = tb.unionByName(spark.createDataFrame([("E4", "A1", None, None, None)], tb.schema))
    rates = clean(spark, [("usd", "1"), ("eur", "n/a")])
    assert [r[0] for r in fx.missing_codes(more, rates).collect()] == ["<blank>", "EUR"]
    assert fx.missing_codes(tb, clean(spark, [("usd", "1"), ("eur", "2")])).isEmpty()


def test_rates_of_one_period(spark):
    raw = spark.createDataFrame([("EUR", "1", "2025-01", 1), ("EUR", "2", "2025-02", 2)], "Curr string, Rate string, YYYYMM string, n int")
    assert fx.clean_rates(raw, ["n"], rate_period="202501").first()["FXRate"] == 1
    assert fx.clean_rates(raw, ["n"]).first()["FXRate"] == 2


def test_rates_from_json(spark):
    df = spark.createDataFrame([('{"rates":{"eur":1.1,"Usd":1}}',)], "payload string")
    got = fx.rates_from_json(df, "payload").select("CurrencyCode", "FXRate").collect()
    assert sorted(tuple(r) for r in got) == [("EUR", Decimal("1.1")), ("USD", 1)]
