"""Fields and service codes of free-form records, against a plain Python statement of the rules."""

from __future__ import annotations

import json
import random
import re

from pyspark.sql import functions as F

from closebook.functions.records import first_field, with_service_codes, with_texts
from closebook.schemas import SERVICE_LIST_KEYS
from closebook.sources.files import record_of


def records(spark, docs):
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, doc string")
    return rows.select("i", F.parse_json("doc").alias("record")).orderBy("i")


def codes(spark, docs):
    coded = with_service_codes(with_texts(records(spark, docs)))
    return [r["codes"] for r in coded.orderBy("i").collect()]


def expected(doc):
    value = next((doc[k] for k in SERVICE_LIST_KEYS if doc.get(k) not in (None, "", [])), None)
    found = raw_codes(value)
    return list(dict.fromkeys(c.strip().upper() for c in found if c is not None and c.strip()))


def raw_codes(value):
    if isinstance(value, str):
        return re.split("[;,]", value)
    if isinstance(value, list):
        return [item_code(v) if isinstance(v, dict) else None if v is None else str(v) for v in value]
    if isinstance(value, dict):
        inner = next((value[k] for k in ("codes", "items", "service_lines") if value.get(k)), None)
        if isinstance(inner, list):
            return [c for v in inner for c in raw_codes(v)]
        return [item_code(value)]
    return []


def item_code(item):
    value = next((item[k] for k in ("code", "Code", "ServiceLineCode") if item.get(k) not in (None, "", [])), None)
    return None if value is None else str(value)


def test_deep_wrappers(spark):
    def wrapped(times):
        value = {"code": "A"}
        for _ in range(times):
            value = {"codes": [value]}
        return {"services": value}

    assert codes(spark, [wrapped(n) for n in (0, 1, 3, 7, 20, 60)]) == [["A"]] * 6


def test_wrappers_of_several_depths_keep_their_order(spark):
    def around(value, times):
        for n in range(times):
            value = {("codes", "items", "service_lines")[n % 3]: [value]}
        return value

    value = {"items": ["x;y", around({"codes": ["p", {"Code": "q"}]}, 9), "z", around(["r", "s"], 4), {"note": '"codes":"codes":'}, 7]}
    record = {"services": value}
    assert codes(spark, [record]) == [[c.strip().upper() for c in raw_codes(value) if c]] == [["X", "Y", "P", "Q", "Z", "R", "S"]]


def test_shapes(spark):
    docs = [
        {"ServiceLines": ["a", " B ", "A"]},
        {"services": "x;y, x"},
        {"ServiceLines": [{"code": "t1"}, {"Code": "t2"}]},
        {"ServiceAssignments": {"codes": ["m", "n;o"]}},
        {"ServiceLines": [], "services": "z"},
        {"service_line_codes": "", "ServiceLineCodes": None},
        {},
        {"services": 5},
        {"services": {"items": [{"code": "p"}, ["q", "r;s"], {"codes": ["u,v"]}]}},
        {"services": {"codes": [], "service_lines": [{"Code": 7}]}},
    ]
    assert codes(spark, docs) == [
        ["A", "B"],
        ["X", "Y"],
        ["T1", "T2"],
        ["M", "N", "O"],
        ["Z"],
        [],
        [],
        [],
        ["P", "Q", "R;S", "U", "V"],
        ["7"],
    ]


def random_value(rng, depth):
    shape = rng.choice(["text", "list", "object", "none"] if depth else ["text"])
    if shape == "text":
        return rng.choice(["a;b", " c ,, d", "", "e", "a, A"])
    if shape == "none":
        return rng.choice([None, []])
    if shape == "list":
        return [rng.choice(["a", " b ", "", {"code": "k"}, {"Code": "", "ServiceLineCode": "l"}]) for _ in range(rng.randint(0, 4))]
    key = rng.choice(["codes", "items", "service_lines", "other"])
    return {key: [random_value(rng, 0) for _ in range(rng.randint(0, 3))]}


def test_random_shapes(spark):
    rng = random.Random(11)
    docs = [
        {k: random_value(rng, 1) for k in rng.sample(SERVICE_LIST_KEYS, rng.randint(0, 3))}
        for _ in range(400)
    ]
    assert codes(spark, docs) == [expected(d) for d in docs]


def test_first_field_skips_empties_only(spark):
    docs = [{"a": "", "b": "x"}, {"a": 0, "b": "x"}, {"a": None, "b": []}, {"a": [], "b": " "}, {}]
    found = with_texts(records(spark, docs)).select(first_field(["a", "b"]), first_field(["a", "b"], default="?"))
    assert [tuple(r) for r in found.collect()] == [("x", "x"), ("0", "0"), (None, "?"), (" ", " "), (None, "?")]


def test_table_rows_are_records_too(spark):
    table = spark.createDataFrame([("C-1", "", "a;b")], "ClientID string, ClientName string, services string")
    got = with_service_codes(with_texts(table.select(record_of(table).alias("record")))).select(
        first_field(["ClientID"]), first_field(["ClientName"]), "codes"
    )
    assert tuple(got.first()) == ("C-1", None, ["A", "B"])
