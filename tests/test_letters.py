"""Letter drafting on the cases that decide between letter and exception."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from closebook.operators import letters as O
from closebook.sources.files import prior_letter_keys

CLIENTS = [
    {"ClientID": "C-1", "ClientName": "Birch Lane Foods", "FiscalYear": "2025", "ServiceLines": ["payroll", "TAX"]},
    {"ClientID": "C-2", "ClientName": "Quay", "FY": 2025, "ServiceLineCodes": "AUDIT;tax"},
    {"ClientID": "C-3", "ServiceLines": ["TAX"]},
    {"ClientName": "No Id", "ServiceLines": ["TAX"]},
    {"ClientID": "C-5", "ClientName": "No Codes"},
    {"ClientID": "C-6", "ClientName": "Unknown", "ServiceLines": ["TAX", "NOPE", "BARE"]},
    {"ClientID": "C-7", "ClientName": "Free", "ServiceLines": ["FREE", "ODD", "RICH"]},
    {"ClientID": "C-8", "ClientName": "Odd Year", "FiscalYear": "FY25", "ServiceLines": "TAX"},
    {"ClientID": "C-9", "ClientName": "Empty Prior", "ServiceLines": "TAX"},
]
SERVICES = [
    {"Code": "tax", "Name": "Old", "Rate": 1},
    {"ServiceLineCode": "PAYROLL", "Description": "Payroll runs", "Rate": 95.0},
    {"ServiceLineCode": " tax ", "Description": "Tax returns", "Rate": 140},
    {"ServiceLineCode": "AUDIT", "BillingRate": "$1,250.5"},
    {"ServiceLineCode": "BARE", "Description": "No rate", "Rate": ""},
    {"ServiceLineCode": "FREE", "Rate": 0},
    {"ServiceLineCode": "ODD", "Rate": "TBD"},
    {"ServiceLineCode": "RICH", "HourlyRate": "1e4"},
    {"Description": "no code", "Rate": 5},
]
PRIOR = [
    ("Birch_Lane_Foods_EngagementLetter_FY2024.docx", "Prior {{ClientName}} FY{{FiscalYear}}\n"),
    ("Empty_Prior_EngagementLetter_FY2024.docx", ""),
    ("Quay_EngagementLetter_FY2023.docx", "too old"),
    ("notes.txt", "x"),
]
TEMPLATE = "To {{ClientName}} ({{ClientID}}) FY{{FiscalYear}}\n{{ServiceSummary}}\nPrepared {{GeneratedOn}}"


def records(spark, docs):
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "n int, doc string").select("n", F.parse_json("doc").alias("record"))


@pytest.fixture
def index(spark):
    return O.service_index(records(spark, SERVICES), ["n"])


@pytest.fixture
def assessed(spark, index):
    prior = prior_letter_keys(spark.createDataFrame(PRIOR, "file_name string, text string"))
    return O.assess_clients(records(spark, CLIENTS), index, prior, "202501")


def test_last_service_wins(index):
    got = {r["code"]: (r["description"], r["rate"]) for r in index.collect()}
    assert got["TAX"] == ("Tax returns", "140")
    assert got["AUDIT"] == ("", "$1,250.5")
    assert got["BARE"][1] is None and got["FREE"][1] == "0"
    assert len(got) == 7


def test_outcomes(assessed):
    got = {r["n"]: (r["outcome"], r["missing"], r["invalid"]) for r in assessed.collect()}
    assert got[0] == ("letter", [], [])
    assert got[2] == ("missing_fields", ["client_name"], [])
    assert got[3] == ("missing_fields", ["client_id"], [])
    assert got[4][:2] == ("missing_fields", ["service_lines"])
    assert got[5] == ("bad_services", [], ["NOPE", "BARE"])
    assert [got[i][0] for i in (1, 6, 7, 8)] == ["letter"] * 4


def test_prior_letters(assessed):
    got = {r["n"]: (r["source"], r["prior_note"]) for r in assessed.collect()}
    assert got[0] == ("rolled_forward", None)
    assert got[1] == ("template", "Prior year letter not found for Quay FY2025 → defaulted to template.")
    assert got[7][0] == "template" and "FYFY25" in got[7][1]
    assert got[8] == ("template", None)


def test_letters(assessed):
    drafts = O.render_letters(assessed, TEMPLATE, "/out/", "now")
    got = {r["client_id"]: r for r in drafts.collect()}
    assert set(got) == {"C-1", "C-2", "C-7", "C-8", "C-9"}
    assert got["C-1"]["letter_text"] == (
        "Prior Birch Lane Foods FY2025\n\nService Summary:\n"
        "- PAYROLL (Payroll runs) @ $95.00\n- TAX (Tax returns) @ $140.00\n"
    )
    assert got["C-2"]["letter_text"] == (
        "To Quay (C-2) FY2025\n- AUDIT () @ $1,250.50\n- TAX (Tax returns) @ $140.00\nPrepared now"
    )
    assert "- FREE () @ $0.00\n- ODD () @ TBD\n- RICH () @ $10,000.00" in got["C-7"]["letter_text"]
    assert got["C-1"]["output_path"] == "/out/Birch_Lane_Foods_EngagementLetter_FY2025.docx"
    assert got["C-2"]["service_lines"] == ["AUDIT", "TAX"]


def test_exceptions(assessed):
    got = {r["client_id"]: r["reason"] for r in O.exceptions(assessed).collect()}
    assert got["C-6"] == (
        "Service line validation failed for client Unknown (C-6): invalid or missing rate for ['NOPE', 'BARE']"
    )
    assert got["C-5"] == (
        "Record missing required fields ['service_lines']: {\"ClientID\":\"C-5\",\"ClientName\":\"No Codes\"}"
    )
    assert got[""].startswith("Record missing required fields ['client_id']")


def test_metrics(assessed, index):
    got = {r["metric"]: r["value"] for r in O.letter_metrics(assessed, index, ["a", "b"]).collect()}
    assert got == {
        "clients_processed": 9,
        "letters_generated": 5,
        "exceptions": 4,
        "rolled_forward_letters": 1,
        "notifications_prepared": 10,
        "ok": 0,
        "service_lines_available": 7,
    }


def test_notifications(assessed):
    made = O.manifest(O.render_letters(assessed, TEMPLATE, "/out", "now"))
    lines = O.notifications(made, ["x", " ", "y"], "T").orderBy("position", "client_id").collect()
    assert lines[0]["line"] == "T | Draft engagement letters ready: 5 clients"
    assert lines[1]["line"] == (
        "Notify x, y → Birch Lane Foods letter saved to /out/Birch_Lane_Foods_EngagementLetter_FY2025.docx"
    )
    assert len(lines) == 6
    alone = O.notifications(made, None, "T").collect()
    assert [r["line"] for r in alone] == ["No notification recipients configured."]


def test_recipient_list():
    assert O.recipient_list(["a", "", 5]) == ["a", "5"]
    assert O.recipient_list("a") == ["a"]
    assert O.recipient_list(None) == []


def test_two_clients_with_one_path_are_both_kept(spark, index):
    docs = [{"ClientID": f"C-{i}", "ClientName": "Same", "ServiceLines": "TAX"} for i in (1, 2)]
    drafts = O.render_letters(O.assess_clients(records(spark, docs), index, None, "202501"), TEMPLATE, "/o", "t")
    assert drafts.count() == 2
    assert [r["count"] for r in O.clashing_paths(drafts).collect()] == [2]


@pytest.mark.parametrize("small", [True, False])
def test_large_catalogue_gives_the_same(spark, index, small):
    fields = O.client_fields(records(spark, CLIENTS), "202501")
    got = O.validate_services(fields, index, small_index=small, small_details=small)
    assert {r["n"]: r["invalid"] for r in got.collect()} == {
        0: [], 1: [], 2: [], 3: [], 4: None, 5: ["NOPE", "BARE"], 6: [], 7: [], 8: []
    }


def test_valid_clients(spark):
    fields = spark.createDataFrame([("C-1",), ("C-2",), ("C-2",)], "client_id string")
    ids = spark.createDataFrame([("C-2",), ("C-2",), ("C-3",)], "client_id string")
    assert [r[0] for r in O.valid_clients(fields, ids).collect()] == ["C-2", "C-2"]
    assert [r[0] for r in O.valid_clients(fields, ids, "left_anti").collect()] == ["C-1"]
