"""Catalogue upsert and document, support lines."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from closebook.operators import catalog, support
from closebook.plans.engagement import register_tutorials
from closebook.sources import sinks
from closebook.sources.files import read_catalog

UUID = re.compile(r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
UPDATE = "step_name string, description string, tutorial_path string, tools array<string>, n int"


def updates(spark, *rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], UPDATE)


def document(path):
    text = "".join(p.read_text(encoding="utf-8") for p in sorted(path.glob("part-*")))
    return json.loads(text)


def test_register_creates_updates_and_adds(spark, tmp_path):
    first = updates(
        spark, ("MatchInvoices", "Old", "notebooks/invoices.ipynb", ["Ledger export", "Bank feed", "Ledger export mock API"])
    )
    register_tutorials(spark, str(tmp_path / "none.json"), first, ["n"], str(tmp_path / "v1"))
    (entry,) = document(tmp_path / "v1")
    assert entry["name"] == "MatchInvoices" and entry["description"] == "Old"
    (toolset,) = entry["toolsets"]
    assert toolset["tutorial"] == "invoices.ipynb" and toolset["tools"] == ["Ledger export", "Bank feed"]
    assert UUID.match(entry["id"]) and UUID.match(toolset["id"]) and entry["id"] != toolset["id"]

    second = updates(
        spark,
        ("MatchInvoices", "Stale", "invoices.ipynb", ["Mailbox"]),
        ("MatchInvoices", 'Fresh "quoted"', "./notebooks/invoices.ipynb", ["Bank feed", "Ledger export", "Ledger export"]),
        ("MatchInvoices", 'Fresh "quoted"', "notebooks/bank.ipynb", ["Archive"]),
        ("Another", "New", "x.ipynb", []),
    )
    register_tutorials(spark, str(tmp_path / "v1"), second, ["n"], str(tmp_path / "v2"))
    another, again = document(tmp_path / "v2")
    assert another["name"] == "Another" and another["toolsets"][0]["tools"] == []
    assert again["id"] == entry["id"] and again["description"] == 'Fresh "quoted"'
    assert [t["tutorial"] for t in again["toolsets"]] == ["bank.ipynb", "invoices.ipynb"]
    assert again["toolsets"][1] == {**toolset, "tools": ["Bank feed", "Ledger export"]}
    ids = [e["id"] for e in (again, another)] + [t["id"] for e in (again, another) for t in e["toolsets"]]
    assert len(set(ids)) == 5


def test_legacy_ids_and_references_are_cleaned(spark):
    steps = spark.createDataFrame(
        [("0C9A1D7733B14E52A9F6D1844B7E20FF", "A", "a"), ("own-id", "B", "b")], "id string, name string, description string"
    )
    toolsets = spark.createDataFrame(
        [("{b3d20e61-5a94-47c8-8f10-92c6ae4d7753}", "A", "notebooks/invoices.ipynb", ["T"])],
        "id string, name string, tutorial string, tools array<string>",
    )
    news = updates(spark, ("A", "a2", "invoices.ipynb", ["T", "U"]))
    got_steps, got_tools = catalog.upsert_catalog(steps, toolsets, news, ["n"], catalog.keyed_id)
    assert sorted(tuple(r) for r in got_steps.collect()) == [
        ("0c9a1d77-33b1-4e52-a9f6-d1844b7e20ff", "A", "a2"),
        ("own-id", "B", "b"),
    ]
    assert [tuple(r) for r in got_tools.collect()] == [
        ("b3d20e61-5a94-47c8-8f10-92c6ae4d7753", "A", "invoices.ipynb", ["T", "U"])
    ]


@pytest.mark.parametrize("text", ["", "{not json", '{"id": 1}', "[1, null]"])
def test_malformed_catalogue_is_empty(spark, tmp_path, text):
    path = tmp_path / "c.json"
    path.write_text(text)
    steps, toolsets = read_catalog(spark, str(path))
    assert steps.isEmpty() and toolsets.isEmpty()


def test_document_of_many_steps(spark, tmp_path):
    names = spark.range(60).selectExpr("concat('s', lpad(id, 3, '0')) AS name")
    steps = names.selectExpr("concat('i', name) AS id", "name", "name AS description")
    toolsets = names.selectExpr("name", "explode(sequence(1, 1 + hash(name) % 3 + 3)) AS t").selectExpr(
        "concat('t', name, t) AS id", "name", "concat('n', t) AS tutorial", "array('x', 'y') AS tools"
    )
    sinks.write_catalog(steps, toolsets, str(tmp_path / "doc"))
    made = document(tmp_path / "doc")
    assert [e["name"] for e in made] == [f"s{i:03d}" for i in range(60)]
    expected = {}
    for r in toolsets.orderBy("name", "tutorial").collect():
        expected.setdefault(r["name"], []).append(r["id"])
    assert {e["name"]: [t["id"] for t in e["toolsets"]] for e in made} == expected


def test_register_again_on_a_document_of_many_parts(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        news = spark.range(400).selectExpr(
            "CASE WHEN id > 0 THEN concat('s', id) END AS step_name", "'d' AS description",
            "concat('n', id % 3) AS tutorial_path", "array('x') AS tools", "id AS n",
        )
        register_tutorials(spark, str(tmp_path / "none"), news, ["n"], str(tmp_path / "v1"))
        assert len(list((tmp_path / "v1").glob("part-*"))) > 1
        register_tutorials(spark, str(tmp_path / "v1"), news.filter("id > 0"), ["n"], str(tmp_path / "v2"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    first, again = document(tmp_path / "v1"), document(tmp_path / "v2")
    assert len(first) == 400 and first[0]["name"] is None
    assert {e["name"]: e["id"] for e in again} == {e["name"]: e["id"] for e in first}
    for part in (tmp_path / "v1.tables").iterdir():
        part.rename(tmp_path / part.name)
    with pytest.raises(ValueError, match="several files"):
        read_catalog(spark, str(tmp_path / "v1"))


def test_support_lines_hold_all_rows_in_order(spark):
    table = spark.range(5000).selectExpr("(id * 7919) % 5000 AS id").repartition(6)
    lines = support.section_lines(table, ["id"]).orderBy("position").collect()
    assert [(r["position"], r["line"]) for r in lines] == [(i + 1, str(i)) for i in range(5000)]


def test_support_lines_stop_at_a_given_limit_and_keep_blanks(spark):
    table = spark.range(1001, 0, -1).select("id", F.lit(None).cast("string").alias("b"), F.lit("c").alias("c"))
    lines = support.section_lines(table, ["id"], section=3, limit=1000).orderBy("position").collect()
    assert len(lines) == 1000
    assert lines[0] == (3, 1, "1 |  | c") and lines[-1]["line"] == "1000 |  | c"


def test_support_text(spark, tmp_path):
    one = support.Section(spark.createDataFrame([(1, 2)], ["a", "b"]), ["a"])
    two = support.Section(spark.createDataFrame([("z", 4), ("y", 1)], ["a", "b"]).selectExpr("a = 'z' AS k", "b - 1 AS a", "b"), ["k"])
    two.columns = ["a", "b"]
    sinks.write_support([one, two], str(tmp_path / "s"))
    both = support.support_lines([one, two]).orderBy("section", "position").collect()
    assert [tuple(r) for r in both] == [(0, 1, "1 | 2"), (1, 1, "0 | 1"), (1, 2, "3 | 4")]
    text = "".join(p.read_text() for p in sorted((tmp_path / "s").glob("part-*")))
    assert text == "1 | 2\n\n0 | 1\n3 | 4\n\n"
