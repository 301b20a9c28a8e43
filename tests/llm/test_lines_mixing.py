"""Line dedup and mixing against plain Python."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pytest

from closebook.llm.lines import drop_boilerplate
from closebook.llm.mixing import mixed, realised_weights, source_weights, token_count
from closebook.operators import lookup


def page(*lines):
    return "<html><script>var x='<p>';</script><style>p{}</style><!-- no -->" + "".join(f"<p class=a>{x}</p>" for x in lines) + "</html>"


@pytest.fixture
def pages():
    rows = [(i, "http://A.example.com/x", page("menu", f"own {i}", "menu", "<b>two</b>  words") if i % 2 else page("menu", "rare" if i == 4 else f"own {i}")) for i in range(10)]
    rows += [(100 + i, "https://few.example.org:80/", page("menu", "same")) for i in range(4)]
    return rows + [(200, None, page("menu")), (201, "no url", None), (202, "http://a.example.com", ""), (0, "http://a.example.com?x", page("menu"))]


def expected(rows, ratio=0.2, least=5):
    found = []
    for number, url, html in rows:
        host = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", url or "")
        text = re.sub(r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", "", html or "")
        text = re.sub(r"<[^>]*>", " ", re.sub(r"</?(p|html)( [^>]*)?>", "\n", text))
        lines = [re.sub(" +", " ", x).strip() for x in text.split("\n")]
        found.append((number, host[1].lower() if host else "", [x for x in lines if x]))
    total, seen = Counter(h for _, h, _ in found), Counter((h, x) for _, h, lines in found for x in set(lines))
    drop = {k for k, n in seen.items() if total[k[0]] >= least and n > ratio * total[k[0]]}
    return [(i, h, [x for x in lines if (h, x) not in drop], len(lines), sum((h, x) in drop for x in lines)) for i, h, lines in found]


@pytest.mark.parametrize("small", [True, False])
def test_lines(spark, pages, small, monkeypatch):
    if not small:
        monkeypatch.setattr("closebook.operators.lookup.measured_small", lambda *a, **b: False)
    table = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS lines")
    got = drop_boilerplate(table).select("page_id", "host", "kept", "n_lines", "n_dropped").collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected(pages), key=str)
    assert any(r["n_dropped"] for r in got)
    assert drop_boilerplate(table.limit(0)).collect() == []
    assert lookup.measured_small is not None


@pytest.fixture
def docs(spark):
    rows = [(i, "big", "w " * (5 + i % 7)) for i in range(300)] + [(1000 + i, "mid", "w " * 6) for i in range(60)] + [(2000 + i, "low", "a b c") for i in range(20)]
    rows += [(3000, None, "one two"), (3001, "big", None), (3002, "blank", ""), (5, "big", "w"), (None, "mid", "w w")]
    return spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 AS place", "7 AS budget")


def blocks(docs):
    return docs.groupBy("source").agg({"text": "count"})


def test_repetitions(spark, docs):
    got = mixed(docs, repetitions=3.0)
    assert got.columns == ["doc_id", "source", "text", "budget", "n_tokens", "pass_no", "place"]
    rows = got.collect()
    tokens, before = Counter(), Counter()
    for r in rows:
        tokens[r["source"]] += r["n_tokens"]
    for r in docs.withColumn("n", token_count()).collect():
        before[r["source"]] += r["n"]
    ids = Counter((r["doc_id"], r["source"], r["text"]) for r in rows)
    assert all(ids[(r["doc_id"], r["source"], r["text"])] >= 1 for r in docs.collect())
    least = min(n for n in before.values() if n)
    exponent = max(0, 1 + math.log(3) / math.log(least / before["big"]))
    assert tokens["big"] == before["big"]
    for source, n in before.items():
        if n:
            budget = n * (n / before["big"]) ** (exponent - 1)
            assert tokens[source] <= budget + 1 and tokens[source] >= n
    passes = defaultdict(set)
    for r in rows:
        passes[(r["source"], r["pass_no"])].add(r["place"])
    assert all(min(p) >= 1 for p in passes.values())


def test_partial_pass_takes_what_fits(spark):
    """A long document early in the last pass is passed over, and what fits after it is taken."""
    rows = [(i, "big", "w " * 40) for i in range(400)] + [(1000 + i, "small", "w " * (3000 if i == 7 else 20)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "'kept' AS _source", "1 AS _block", "2 AS _tokens")
    got = mixed(docs, repetitions=1.4)
    assert got.columns == [*docs.columns, "n_tokens", "pass_no", "place"]
    assert {(r["_source"], r["_block"], r["_tokens"]) for r in got.collect()} == {("kept", 1, 2)}
    small = got.filter("source = 'small'").groupBy("pass_no").sum("n_tokens").collect()
    passes = {r["pass_no"]: r["sum(n_tokens)"] for r in small}
    total = 199 * 20 + 3000
    assert passes[1] == total and 0.35 * total < passes[2] <= 0.4 * total + 1
    weights = {r["source"]: r["weight"] for r in realised_weights(got).collect()}
    aim = {"big": 16_000, "small": 1.4 * total}
    for source, tokens in aim.items():
        assert weights[source] == pytest.approx(tokens / sum(aim.values()), abs=0.01)
    blocks = got.filter("source = 'small' AND pass_no = 2").select("place").distinct().collect()
    assert sorted(r["place"] for r in blocks) == list(range(1, len(blocks) + 1))


def test_entropy(spark, docs):
    parts = docs.withColumn("tokens", token_count()).selectExpr("coalesce('s' || source, 'n') AS _source", "tokens")
    high = source_weights(parts, entropy=0.9).collect()
    weights = [r["weight"] for r in high]
    assert sum(weights) == pytest.approx(1) and -sum(w * math.log(w) for w in weights) == pytest.approx(0.9, abs=1e-6)
    flat = source_weights(parts, entropy=99.0).collect()
    assert all(r["weight"] == pytest.approx(1 / len(flat)) for r in flat)
    as_is = source_weights(parts, entropy=0.0).collect()
    total = sum(r["tokens"] for r in as_is)
    assert all(r["weight"] == pytest.approx(r["tokens"] / total) for r in as_is)


def test_nothing_to_mix(spark, docs):
    assert mixed(docs.limit(0), repetitions=2.0).collect() == []
    assert mixed(docs.filter("text IS NULL OR text = ''"), repetitions=2.0).count() == 2
    with pytest.raises(ValueError):
        mixed(docs)
