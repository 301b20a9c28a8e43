"""Held-out accuracy of both classifiers, the automaton against edit distances, and odd rows."""

from __future__ import annotations

import random
import zlib
from pathlib import Path

import numpy as np
import pytest

from closebook.llm import quality, toxicity
from closebook.llm.classify import sigmoid, temperature
from closebook.llm.quality import HASHES, SIZE, add_contexts, pooled, random_vectors, shaped_words
from closebook.llm.toxicity import Automaton, hits_of

SF = Path("/root/testdata/sf0.01")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton():
    rnd = random.Random(3)
    terms = ["scum", "loser", "pathetic", "worthless", "disgusting", "lowei*", "vequ*", "losers"]
    automaton = Automaton(terms)
    for _ in range(5000):
        word = list(rnd.choice(terms).removesuffix("*") + rnd.choice(["", "", "x", "abc"]))
        for _ in range(rnd.randrange(4)):
            place, kind = rnd.randrange(len(word) + 1), rnd.random()
            if kind < 0.4:
                word.insert(place, rnd.choice("aeost"))
            elif kind < 0.7 and word:
                word.pop(place % len(word))
            elif word:
                word[place % len(word)] = rnd.choice("aeost")
        word = "".join(word)
        matches = []
        for i, term in enumerate(terms):
            errors = 0 if term.endswith("*") and word.startswith(term[:-1]) else 99 if term.endswith("*") else distance(word, term)
            if errors <= (0 if term.endswith("*") else Automaton.allowed(len(term))):
                matches.append((errors, i))
        best = min(matches)[::-1] if matches else None
        assert automaton.find(word) == best


def test_quotation_and_abuse():
    automaton = Automaton(["idiot", "trash"])
    _, (hit,) = hits_of('they said "you idi0t" and left', automaton)
    assert hit.quoted and hit.errors == 1
    _, hits = hits_of("you idiot you are trash", automaton)
    assert not any(h.quoted for h in hits) and all(h.company == 1 for h in hits)
    assert hits_of("", automaton) == (0, [])


def measured(spark, scored, label):
    labels = spark.read.parquet(str(SF / "labels.parquet"))
    return scored.join(labels, "doc_id").select("held_out", "score", "predicted", label).collect()


@pytest.mark.skipif(not SF.exists(), reason="test tables absent")
def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(str(SF / f"{t}.parquet")) for t in ("documents", "labels"))
    scored = quality.score(docs, *quality.learn(docs, labels))
    assert scored.count() == docs.count()
    rows = [r for r in measured(spark, scored, "quality") if r["held_out"]]
    assert len(rows) > 50 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in scored.collect())


@pytest.mark.skipif(not SF.exists(), reason="test tables absent")
def test_held_out_toxicity(spark):
    docs, labels = (spark.read.parquet(str(SF / f"{t}.parquet")) for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    scored = toxicity.score(docs, model)
    rows = [r for r in measured(spark, scored, "toxic") if r["held_out"]]
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.95
    assert sum(r["predicted"] and not r["toxic"] for r in rows) <= 1
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in scored.collect())
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == scored.filter("predicted = 0").count()


def test_copied_toxic_text_keeps_its_terms(spark):
    rnd = random.Random(5)
    usual = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("orin", "ulat", "emis", "aved", "itok")]
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 3 != 1]

    def text(*terms):
        words = rnd.choices(usual, k=30) + list(terms)
        rnd.shuffle(words)
        return " ".join(words)

    texts = [(text("vexhound"), 1) for _ in range(12)] + [(text(), 0) for _ in range(80)]
    copied = text("vexhound", "once")
    rows = [(i, t, label) for i, (t, label) in zip(ids, texts + [(copied, 1)] * 100)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    assert model.terms == ["vexhound"]
    scored = toxicity.score(table, model).join(table, "doc_id").collect()
    assert len(scored) == len(rows) and all(r["predicted"] == r["toxic"] for r in scored)


def test_words_below_a_beginning_keep_their_errors(spark):
    rnd = random.Random(6)
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 3 != 1]
    usual = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("orin", "ulat", "emis", "aved", "itok")]
    words = ["zquvander", "zquvollith", "zquvime"]
    texts = [(" ".join([*rnd.choices(usual, k=30), words[i % 3]]), 1) for i in range(45)]
    texts += [(" ".join(rnd.choices(usual, k=30)), 0) for _ in range(120)]
    rows = [(i, t, label) for i, (t, label) in zip(ids, texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    terms = toxicity.learn(table.select("doc_id", "text"), table.select("doc_id", "toxic")).terms
    assert terms[0] == "zquv*" and sorted(terms[1:]) == sorted(words)
    automaton = Automaton(terms)
    assert automaton.find("zqavander") == (terms.index("zquvander"), 1)
    assert automaton.find("zxuwollith") == (terms.index("zquvollith"), 2)
    assert automaton.find("zquvxyz") == (0, 0) and automaton.find("zqavxyz") is None


def test_odd_rows(spark):
    rows = [(1, "good words here"), (1, "good words here"), (2, None), (3, ""), (None, "BAD!!!"), (4, "x " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS label", "3 AS held_out")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None), (77, 0, 1)], "doc_id long, quality int, toxic int")
    for frame in (docs, docs.limit(0)):
        for some in (labels, labels.limit(0)):
            n = frame.count()
            found = quality.score(frame, *quality.learn(frame, some)).collect()
            assert len(found) == n and all(0 <= r["score"] <= 1 for r in found)
            found = toxicity.score(frame, toxicity.learn(frame, some)).collect()
            assert len(found) == n and all(0 <= r["score"] <= 1 for r in found)


def test_context_vectors_are_sums_of_neighbours():
    texts = [b"a b c a", b"", b"B7 %% x"]
    words, bucket = shaped_words(texts)
    total = np.zeros(quality.SHAPES * HASHES * SIZE, np.int64)
    add_contexts(total, words, bucket)
    places, signs = random_vectors()
    want, text = np.zeros((quality.SHAPES * HASHES, SIZE), np.int64), words.text()
    for i in range(len(bucket)):
        for j in range(len(bucket)):
            if 0 < abs(i - j) <= quality.AROUND and text[i] == text[j]:
                np.add.at(want[bucket[i]], places[bucket[j]], signs[bucket[j]])
    assert (total.reshape(want.shape) == want).all()


def test_pooled_is_a_mean():
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(quality.SHAPES * HASHES, SIZE)).astype(np.float32)
    texts = [b"one two two", b"", b"ONE"]
    out = pooled(texts, vectors)
    words, bucket = shaped_words(texts)
    assert np.allclose(out[0, :SIZE], vectors[bucket[:3]].mean(0), atol=1e-5)
    assert not out[1].any() and np.allclose(out[2, :SIZE], vectors[bucket[3]], atol=1e-5)


def test_temperature():
    rng = np.random.default_rng(4)
    z = rng.normal(0, 2, 20_000)
    y = (rng.random(20_000) < sigmoid(z / 2)).astype(float)
    assert 1.7 < temperature(z, y, np.ones(len(y))) < 2.3
