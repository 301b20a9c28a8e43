"""Decontamination against looking for every window at every place."""

from __future__ import annotations

import hashlib
import random
import re
import time

import numpy as np
import pytest

from closebook.llm.decontaminate import Benchmark, contamination, kept, without_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(doc, items, span=10):
    own, hit, found = words(doc), set(), set()
    for item_id, text in items:
        w = words(text)
        size = min(span, len(w))
        windows = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if size else set()
        for i in range(len(own) - size + 1 if size else 0):
            if tuple(own[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(None if item_id is None else str(item_id))
    ids = sorted(found - {None})
    return len(own), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


@pytest.fixture(scope="module")
def tables():
    rnd = random.Random(8)
    vocab = ["a", "b", "été", "x9", "Über", "7"]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([1, 3, 9, 10, 11, 25, 40])))) for i in range(5, 25)]
    items = [(i, t) for i, t in items if len(t.split()) > 2]
    items += [(100, None), (101, ""), (102, "!!"), (items[0][0], items[0][1]), (items[1][0], "b b b b a a a x9 7 7 7 7"), (None, items[2][1])]
    docs = []
    for i in range(120):
        text = [rnd.choice([*vocab, "longer", "words", "here", "-"]) for _ in range(rnd.randrange(30))]
        if rnd.random() < 0.5:
            item = words(rnd.choice(items)[1])
            low = rnd.randrange(max(1, len(item) - 9))
            text += item[low : low + rnd.choice([8, 9, 10, 12, 40])]
        text += [rnd.choice(vocab) for _ in range(rnd.randrange(5))]
        docs.append((i, rnd.choice([" ", ", ", "\n"]).join(text)))
    docs += [(200, None), (201, ""), (3, docs[3][1]), (3, docs[4][1]), (None, docs[5][1]), (202, "a " * 3000 + "b")]
    return docs, items


@pytest.mark.parametrize("broadcast_bytes", [1 << 24, 0])
def test_all_windows(spark, tables, broadcast_bytes):
    docs, items = tables
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n_hit", "'x' AS _text")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "2 AS doc_id")
    rows = contamination(d, b, broadcast_bytes=broadcast_bytes).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows), key=str)
    want = sorted(((i, *brute(t, items)) for i, t in docs), key=str)
    assert got == want
    assert any(r[2] for r in got) and not all(r[2] for r in got)
    for r in rows:
        assert sum(h["stop"] - h["begin"] for h in r["hits"]) == r["n_hit"]
    clean = without_contaminated(d, b, broadcast_bytes=broadcast_bytes)
    assert clean.columns == d.columns
    assert sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=str) == sorted(((i, t) for i, t in docs if not brute(t, items)[1]), key=str)


def test_empty_tables(spark, tables):
    docs = spark.createDataFrame(tables[0], "doc_id long, text string")
    none_docs, none_items = docs.limit(0), spark.createDataFrame([], "item_id long, text string")
    assert contamination(none_docs, none_items).collect() == []
    assert not any(r["contaminated"] for r in contamination(docs, none_items).collect())


def test_winnowing_keeps_the_smallest_of_each_window():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 9, 300).astype(np.uint64)
    chosen = kept(h, np.ones(300, bool), 5)
    for i in range(296):
        low = h[i : i + 5].min()
        assert all(chosen[i + k] for k in range(5) if h[i + k] == low)


@pytest.mark.parametrize("period", [1, 2, 7])
def test_texts_that_repeat_themselves(period):
    """Linear in the words of both, where pairs of equal n-grams are many."""
    unit = [f"w{i}" for i in range(period)]
    long = [unit[i % period] for i in range(20_000)]
    texts = [" ".join(long), " ".join(["x"] * 50 + long[3:60] + ["y"] + long[:9]), " ".join(long[:9])]
    benchmark = Benchmark.of(["a", "b"], [" ".join(long).encode(), " ".join(long[5:16]).encode()])
    begun = time.perf_counter()
    found = list(benchmark.search([t.encode() for t in texts]))
    assert time.perf_counter() - begun < 10
    assert [(n, int(hit.sum()), items) for n, hit, items in found] == [(20_000, 20_000, {0, 1}), (117, 57, {0, 1}), (9, 0, set())]
    assert found[1][1][50:107].all()
