"""Digests of written tables, run-log rows of all jobs, payloads of rates, and the catalogue replaced in place."""

from __future__ import annotations

import hashlib
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from closebook.operators import fx
from closebook.plans import close
from closebook.plans.engagement import draft_letters, register_tutorials
from closebook.sources import paths, sinks
from closebook.sources.files import read_catalog, read_rates


def log_of(spark, path):
    return [r.asDict() for r in spark.read.parquet(str(path)).orderBy("logged_at").collect()]


def test_digest_is_of_the_rows_alone(spark, tmp_path):
    rows = [(i % 7, None if i % 3 else f"é{i}", float(i)) for i in range(200)]
    df = spark.createDataFrame([*rows, rows[0]], "a int, b string, c double")
    one = sinks.write_table(df.orderBy("c"), str(tmp_path / "one"))
    two = sinks.write_table(df.repartition(7).orderBy(F.desc("a"), "b"), str(tmp_path / "two.csv"))
    assert one == two and one.rows == 201
    texts = ["{" + f'"a":{a},"b":{json.dumps(b, ensure_ascii=False)},"c":{c}' + "}" for a, b, c in [*rows, rows[0]]]
    total = sum(int(hashlib.md5(t.encode()).hexdigest(), 16) for t in texts) % 2**128
    assert one.digest == f"201:{total:032x}"
    assert sinks.write_table(df.distinct(), str(tmp_path / "three")).digest != one.digest
    assert sinks.write_table(df.limit(0), str(tmp_path / "four")) == sinks.Written(0, f"0:{0:032x}")
    lines = spark.createDataFrame([(2, "b"), (1, "a")], "n int, line string")
    assert sinks.write_lines(lines, str(tmp_path / "text"), ["n"]).rows == 2


def test_close_logs_its_outputs(spark, tmp_path):
    (tmp_path / "TB_E1_202301.csv").write_text("Entity,Account,Dr,Cr,Currency\nE1,A,5,0,usd\nE1,B,0,5,usd\n")
    (tmp_path / "rates.json").write_text('{"rates": {"usd": 1, "Eur": "1.1"}}')
    logs = []
    for out in ("out", "again"):
        done = close.close_period(spark, "202301", str(tmp_path), str(tmp_path / "rates.json"), str(tmp_path / out))
        assert [r.ok for r in done.values()] == [True] * 3
        logs.append({r["step"]: r for r in log_of(spark, tmp_path / out / "run_log")})
    first, again = logs
    assert {s: [k.rsplit("/", 1)[1] for k in sorted(r["output_hashes"])] for s, r in first.items()} == {
        "collect_tb": ["Master_TB_202301"], "translate_fx": ["FX_Adjustments_202301", "Master_TB_202301_Adjusted"], "assemble_support": ["Support_202301"],
    }
    for step, row in first.items():
        assert sorted(row["output_hashes"].values()) == sorted(again[step]["output_hashes"].values())
    assert first["collect_tb"]["input_hashes"][f"{tmp_path}/TB_*_202301"].startswith("2:")


@pytest.mark.parametrize(
    ("payload", "reason"),
    [
        ("{not json", "is no JSON"), ("", "is no JSON"), ('{"data": 1}', "has no object of rates"), ("[1]", "has no object of rates"),
        ('{"rates": {"usd": "x", "eur": 2}}', "rate of usd is no number"), ('{"rates": {"usd": 20000000}}', "rate of usd is too large"), ('{"rates": {"usd": null}}', "rate of usd is no number"),
    ],
)
def test_payloads_that_do_not_parse(spark, tmp_path, payload, reason):
    path = tmp_path / "rates.json"
    path.write_text(payload)
    tb = spark.createDataFrame([("E", "A", Decimal(1), Decimal(0), "USD")], "EntityCode string, AccountCode string, Debit decimal(20,4), Credit decimal(20,4), CurrencyCode string")
    done = close.translate_fx(tb, str(path), "202301", str(tmp_path / "a"), str(tmp_path / "b"))
    if not payload:  # Spark gives a row for an empty file, too
        assert not done.ok
        return
    assert not done.ok and done.messages == [f"file:{path}: {reason}", f"All 1 in {tmp_path}/a_Rejected_Rates"]
    assert [r["reason"] for r in spark.read.parquet(f"{tmp_path}/a_Rejected_Rates").collect()] == [reason]
    assert not (tmp_path / "a").exists()


def test_rates_of_many_payloads(spark, tmp_path):
    (tmp_path / "p1.json").write_text('{"rates": {"usd": 1, "gbp": 1.25e0}}')
    (tmp_path / "p2.json").write_text('{"rates": {"GBP": "1.5"}}')
    rates, rejected = read_rates(spark, f"{tmp_path}/*.json")
    clean = fx.clean_rates(rates, ["_file", "_block", "_row"])
    assert {r["CurrencyCode"]: r["FXRate"] for r in clean.collect()} == {"USD": Decimal(1), "GBP": Decimal("1.5")}
    assert rejected.isEmpty()


def test_too_large_rate_in_a_table_is_named(spark, tmp_path):
    tb = spark.createDataFrame([("E", "A", Decimal(1), Decimal(0), "IDR")], "EntityCode string, AccountCode string, Debit decimal(20,4), Credit decimal(20,4), CurrencyCode string")
    rates = spark.createDataFrame([("idr", "20000000", 1), ("usd", "n/a", 2)], "CurrencyCode string, FXRate string, n int")
    done = close.translate_fx(tb, rates, "202301", str(tmp_path / "a"), str(tmp_path / "b"), ["n"])
    assert not done.ok and done.messages[0] == "rate 1: rate of IDR is too large"


def test_letters_log_their_outputs(spark, tmp_path):
    (tmp_path / "clients.jsonl").write_text('{"ClientID": "1", "ClientName": "A", "FiscalYear": 2025, "services": "tax"}\n{"ClientID": "2"}\n')
    (tmp_path / "services.csv").write_text('Code,Description,Rate\nTAX,"Tax\nreturns",10\n')
    (tmp_path / "t.dotx").write_text("{{ClientName}} {{ServiceSummary}}")
    done = draft_letters(
        spark, "202501", client_metadata=str(tmp_path / "clients.jsonl"), service_lines=str(tmp_path / "services.csv"), template_path=str(tmp_path / "t.dotx"), output_folder=str(tmp_path / "out")
    )
    assert done.metrics["letters_generated"] == 1
    absent = draft_letters(
        spark, "202501", client_metadata=str(tmp_path / "none.jsonl"), service_lines=str(tmp_path / "services.csv"), template_path=str(tmp_path / "t.dotx"), output_folder=str(tmp_path / "out")
    )
    assert not absent.ok
    ok, failed = log_of(spark, tmp_path / "out" / "run_log")
    assert (ok["step"], ok["status"], failed["status"]) == ("draft_letters", "error", "error")  # one client is an exception
    assert ok["output_hashes"][f"{tmp_path}/out/letters_202501"].startswith("1:") and len(ok["output_hashes"]) == 4
    assert ok["input_hashes"][str(tmp_path / "clients.jsonl")].startswith("2:")
    assert failed["messages"][0].startswith("Client metadata file not found") and failed["output_hashes"] == {}


def news(spark, *rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "step_name string, description string, tutorial_path string, tools array<string>, n int")


def tables(spark, path):
    steps, toolsets = read_catalog(spark, str(path))
    return sorted((r["name"], r["description"]) for r in steps.collect()), sorted((r["name"], r["tutorial"], r["tools"]) for r in toolsets.collect())


def test_catalogue_is_replaced_in_place(spark, tmp_path, monkeypatch):
    path = tmp_path / "c.json"
    path.write_text(json.dumps([{"id": "own", "name": "A", "description": "old", "toolsets": []}]))
    register_tutorials(spark, str(path), news(spark, ("A", "a1", "x.ipynb", ["T"]), ("B", "b1", "y.ipynb", ["U"])), ["n"])
    register_tutorials(spark, str(path), news(spark, ("B", "b2", "z.ipynb", ["V"])), ["n"])
    want = ([("A", "a1"), ("B", "b2")], [("A", "x.ipynb", ["T"]), ("B", "y.ipynb", ["U"]), ("B", "z.ipynb", ["V"])])
    assert tables(spark, path) == want
    document = json.loads("".join(p.read_text() for p in sorted(path.glob("part-*"))))
    assert [(e["name"], e["description"], len(e["toolsets"])) for e in document] == [("A", "a1", 1), ("B", "b2", 2)]
    assert document[0]["id"] == "own"
    log = log_of(spark, f"{path}.run_log")
    assert [r["metrics"] for r in log] == [{"steps": "2", "toolsets": "2"}, {"steps": "2", "toolsets": "3"}]
    assert all(len(r["output_hashes"]) == 3 for r in log)

    def killed(*_):
        raise KeyboardInterrupt

    # A write that is killed before the pointer is replaced leaves the old version current.
    with monkeypatch.context() as patched:
        patched.setattr(paths.Files, "replace", killed)
        with pytest.raises(KeyboardInterrupt):
            register_tutorials(spark, str(path), news(spark, ("C", "c", "q.ipynb", ["W"])), ["n"])
    assert tables(spark, path) == want
    # So does one that finds another version current than the one it read.
    steps, toolsets = read_catalog(spark, str(path))
    with pytest.raises(ValueError, match="replaced meanwhile"):
        sinks.write_catalog(steps, toolsets, str(path), "v-other")
    assert tables(spark, path) == want
    register_tutorials(spark, str(path), news(spark, ("C", "c", "q.ipynb", ["W"])), ["n"])
    assert ("C", "c") in tables(spark, path)[0]


def test_other_fields_of_an_entry_survive(spark, tmp_path):
    path = tmp_path / "c.json"
    entry = {
        "id": "own", "name": "A", "owner": {"team": ["x", None], "level": 2.5}, "description": "old", "tags": [], "note": None,
        "toolsets": [{"id": "t1", "tutorial": "x.ipynb", "tools": ["T"], "minutes": 30, "said \"so\"": "a, b"}],
    }
    path.write_text(json.dumps([entry, {"id": "plain", "name": "B", "description": "b", "toolsets": []}]))
    for n in range(2):
        register_tutorials(spark, str(path), news(spark, ("A", f"a{n}", "x.ipynb", ["T", "U"]), ("C", "c", "y.ipynb", ["V"])), ["n"])
    document = {e["name"]: e for e in json.loads("".join(p.read_text() for p in sorted(path.glob("part-*"))))}
    toolset = entry["toolsets"][0] | {"tools": ["T", "U"]}
    assert document["A"] == entry | {"description": "a1", "toolsets": [toolset]}
    assert document["B"] == {"id": "plain", "name": "B", "description": "b", "toolsets": []}
    assert set(document["C"]) == {"id", "name", "description", "toolsets"}
