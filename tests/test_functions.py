"""Column expressions on boundary values, and random ones against plain Python."""

from __future__ import annotations

import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from closebook.functions import ledger as L
from closebook.functions import text as X


def apply(spark, values, fn, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("v"))).collect()]


def test_amount_coercion(spark):
    cells = ["12", " 12 ", "1e3", "+5", "1,000", "$5", "nan", "inf", "1d", "", None]
    parsed = apply(spark, cells, L.parse_amount)
    assert parsed == [12, 12, 1000, 5] + [None] * 7
    assert apply(spark, cells, L.amount) == [12, 12, 1000, 5] + [0] * 7


def test_period_key(spark):
    cells = ["2025-01", "202501.0", "2025-01-31", "01/2025", "", None, "x"]
    keys = apply(spark, cells, L.period_key)
    assert keys == ["202501", "202501", "202501", "012025", None, None, None]
    assert apply(spark, keys, L.is_period) == [True, True, True, False, False, False, False]


def test_file_names(spark):
    names = ["TB_USA_202501.xlsx", "TB_GBR_Q1_2025.xlsx", "tb_x.csv", "GL_209913.csv", "other"]
    assert apply(spark, names, L.period_in_name) == ["202501", None, None, None, None]
    assert apply(spark, names, L.entity_in_name) == ["USA", "GBR", "x", None, None]


def test_currency_code(spark):
    assert apply(spark, [" usd ", "", "  ", None], L.currency_code) == ["USD", None, None, None]


def test_signed_split(spark):
    cells = ["7", "-7", "n/a", "", None]
    both = apply(spark, cells, lambda c: F.struct(L.debit_part(L.amount(c)), L.credit_part(L.amount(c))))
    assert [tuple(b) for b in both] == [(7, 0), (0, 7), (0, 0), (0, 0), (0, 0)]


@pytest.mark.parametrize("local, shown", [("2.675", "2.68"), ("-2.675", "-2.68"), ("0.125", "0.13")])
def test_reporting_amount_rounds_half_up(spark, local, shown):
    row = spark.range(1).select(
        L.reporting_amount(F.lit(local).cast("decimal(18,4)"), F.lit("1").cast("decimal(18,10)"))
    )
    assert row.first()[0] == Decimal(shown)


def test_small_rates_keep_their_digits(spark):
    row = spark.range(1).select(
        L.reporting_amount(F.lit("1000000").cast("decimal(18,4)"), L.parse_rate(F.lit("0.0000613")))
    )
    assert row.first()[0] == Decimal("61.30")


def test_slugify(spark):
    assert apply(spark, ["Acme & Co.", "___", "Ünï"], X.slugify) == ["Acme_Co", "client", "n"]


def test_rate_display(spark):
    cells = ["0", "$1,250.5", "TBD", " 1e3 ", "-5", "5d", "1f", "nan", "-Infinity", ".5", "5.", "1_000"]
    assert apply(spark, cells, X.rate_display) == [
        "$0.00",
        "$1,250.50",
        "TBD",
        "$1,000.00",
        "$-5.00",
        "5d",
        "1f",
        "$nan",
        "$-inf",
        "$0.50",
        "$5.00",
        "1_000",
    ]


def test_rate_display_rounds_as_python(spark):
    rng = random.Random(5)
    cells = [repr(rng.choice([1, 10, 1e4]) * rng.random()) for _ in range(300)] + ["0.125", "2.675", "1.005"]
    assert apply(spark, cells, X.rate_display) == [f"${float(c):,.2f}" for c in cells]


def letter(spark, base, year="2025"):
    values = {
        "ClientName": F.lit("Acme {{ClientID}}"),
        "ClientID": F.lit("C-1"),
        "FiscalYear": F.lit(year),
        "ServiceSummary": F.lit("- TAX"),
        "GeneratedOn": F.lit("now"),
    }
    return apply(spark, [base], lambda c: X.complete_letter(c, values))[0]


def test_letter_merge_sees_earlier_inserts(spark):
    assert letter(spark, "{{ClientName}} FY{{FiscalYear}}: {{ServiceSummary}}") == "Acme C-1 FY2025: - TAX"


def test_letter_gets_what_it_lacks(spark):
    text = letter(spark, "Dear {{ClientName}}  \n\t\n")
    assert text == "Dear Acme C-1\n\nService Summary:\n- TAX\n\nFiscal Year: FY2025\n"


def test_row_line_keeps_blank_cells(spark):
    row = spark.createDataFrame([(1, None, "x")], "a int, b string, c string")
    assert row.select(X.row_line([F.col(c) for c in row.columns])).first()[0] == "1 |  | x"


def test_fill_path(spark):
    filled = apply(spark, ["{root}/data/{name}.txt"], lambda c: X.fill_path(c, {"root": "base", "name": "file"}))
    assert filled == ["base/data/file.txt"]


def python_tool(tool):
    name = " ".join(tool.split())
    cut = re.search(r"(?is) (mock|sandbox|integration|automation|workflow|templating)", name)
    return name[: cut.start()].strip() if cut else name


def test_tool_names(spark):
    tools = ["Ledger Suite mock API integration", "Client Desk mock API integration", "Client Desk"]
    assert apply(spark, [tools], X.tool_names, "array<string>") == [["Ledger Suite", "Client Desk"]]
    assert apply(spark, [["A  Sandbox", "mock", "  ", None]], X.tool_names, "array<string>") == [["A", "mock"]]
    rng = random.Random(2)
    words = ["Tool", "Mock", "sandbox", "API", "integrations", "WORKFLOW", "x", "automation"]
    names = ["  ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(200)]
    assert apply(spark, names, X.tool_name) == [python_tool(n) for n in names]


def test_tutorial_ref(spark):
    paths = ["notebooks/a.ipynb", "./notebooks//a.ipynb", "a.ipynb", "notebooks", "", "/notebooks/a", "x/./y/"]
    assert apply(spark, paths, X.tutorial_ref) == ["a.ipynb", "a.ipynb", "a.ipynb", "", "", "/notebooks/a", "x/y"]


def test_canonical_uuid(spark):
    dashed = "5e1f5e2f-7207-4220-ae7a-80a528bf79cb"
    bare = dashed.replace("-", "").upper()
    values = [dashed, bare, "{" + dashed + "}", "urn:uuid:" + dashed, "step-1", bare[:-1], None]
    assert apply(spark, values, X.canonical_uuid) == [dashed] * 4 + [None] * 3
