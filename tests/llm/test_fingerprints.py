"""Fingerprints: neighbours against plain Python, and likeness against the number of edits."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from closebook.llm import fingerprints
from closebook.llm.fingerprints import compare_with_next, edited, fingerprint_all, likeness, near_copies


def words(rnd, n):
    return " ".join("".join(rnd.choice("aeiounrst") for _ in range(rnd.randrange(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(2)
    docs = [(i * 2, words(rnd, rnd.choice([1, 5, 60, 300]))) for i in range(60)]
    docs += [(7, None), (9, ""), (11, "é😀x"), (13, docs[3][1]), (15, "a"), (20, "the same id")]
    rnd.shuffle(docs)
    return docs


def test_alone_and_in_company_alike(rows):
    texts = [t or "" for _, t in rows]
    together = fingerprint_all(texts)
    assert together == [fingerprint_all([t])[0] for t in texts]
    assert len({t: f for t, f in zip(texts, together)}) == len(set(texts))


def test_likeness_falls_with_edits():
    rnd = random.Random(3)
    text, means = words(rnd, 400), []
    for edits in (0, 3, 30, 300):
        values = []
        for _ in range(8):
            letters = list(text)
            for _ in range(edits):
                place, kind = rnd.randrange(len(letters)), rnd.random()
                if kind < 0.3:
                    letters[place] = "q"
                elif kind < 0.6:
                    letters.insert(place, "z")
                else:
                    del letters[place]
            values.append(likeness(*fingerprint_all([text, "".join(letters)])))
        means.append(np.mean(values))
    assert means[0] == 1 and means == sorted(means, reverse=True) and means[1] > 0.8 and means[3] < 0.3
    assert likeness(*fingerprint_all([text, words(rnd, 400)])) < 0.1


def test_very_long_text():
    rnd = random.Random(4)
    text = words(rnd, 30_000)
    changed = edited(text, words(rnd, 30_000))
    assert 0.3 < likeness(*fingerprint_all([text, changed])) < 0.75


@pytest.mark.parametrize("chars", [fingerprints.GROUP_CHARS, 500])
def test_neighbours(spark, rows, chars, monkeypatch):
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_chars", "'x' AS fingerprint").repartition(6)
    ordered = [(d, t or "") for d, t in sorted(rows, key=lambda r: r[0]) if d != 20]
    found = {r["doc_id"]: r for r in compare_with_next(table.filter("doc_id <> 20")).collect()}
    assert len(found) == len(ordered)
    own = fingerprint_all([t for _, t in ordered])
    for i, (doc, text) in enumerate(ordered):
        j = (i + 1) % len(ordered)
        changed = edited(text, ordered[j][1])
        row = found[doc]
        assert row["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert row["n_chars"] == len(text) and row["fingerprint"] == own[i].hex()
        assert row["near_next"] == pytest.approx(likeness(own[i], own[j]))
        assert row["near_edited"] == pytest.approx(likeness(own[i], fingerprint_all([changed])[0]))


def test_few_rows(spark):
    def run(rows):
        return compare_with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()

    assert run([]) == []
    (one,) = run([(1, "abcd")])
    assert one["near_next"] == 1 and one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    assert len(run([(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, None)])) == 5


@pytest.mark.parametrize("block", [2000, 2])
def test_near_copies(spark, block):
    rnd = random.Random(9)
    base = [words(rnd, 200) for _ in range(4)]
    docs = [(i, base[i % 4][:-1] + rnd.choice("xyz") if i > 20 else base[i % 4]) for i in range(60)] + [(90, words(rnd, 200)), (91, "")]
    prints = [(d, f.hex()) for (d, _), f in zip(docs, fingerprint_all([t for _, t in docs]))] + [(95, None)]
    got = {r["doc_id"]: r["group_id"] for r in near_copies(spark.createDataFrame(prints, "doc_id long, fingerprint string"), block=block).collect()}
    assert got == {**{i: i % 4 for i in range(60)}, 90: 90, 91: 91, 95: 95}
