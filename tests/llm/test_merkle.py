"""Merkle manifest against a plain build, for several strides and both joins."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from closebook.llm import merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def tampered(row):
    doc, text = row[0], row[4]
    return text.replace("\n", "") if text is not None and doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0 else text


def levels_of(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain(rows):
    groups: dict = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0], leaf_of(row, row[4]), leaf_of(row, tampered(row))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, *x[1:]))
    trees = {g: levels_of([x[1] for x in groups[g]]) for g in order}
    top = levels_of([trees[g][-1][0] for g in order])
    found = []
    for at, g in enumerate(order):
        for i, (doc, leaf, fold) in enumerate(groups[g]):
            proof = ""
            for levels, j in ((trees[g], i), (top, at)):
                for level in levels[:-1]:
                    a = j // 3 * 3
                    left, right = "".join(level[a:j]), "".join(level[j + 1 : a + 3])
                    proof, fold, j = proof + left + right, sha(left + fold + right), j // 3
            found.append((doc, leaf, trees[g][-1][0], top[-1][0], proof, fold))
    nodes = [d for levels in [*trees.values(), top] for level in levels for d in level]
    return sorted(found, key=str), sorted(nodes)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(1)
    made = [
        (rnd.choice([None, *range(40)]), rnd.choice([None, "a", "é", "", "zz", "a", "a", "a"]), rnd.choice([None, "en"]), rnd.choice([None, 5]), rnd.choice([None, "", "x\ny", "a\n"]))
        for _ in range(120)
    ]
    return [*made, made[0], made[0], made[0], (500, "long", "en", 1, "line\n" * 200_000), (501, "lone", None, None, "é\n")]


def climbed(docs, stride, small):
    gone = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    seen = {"text": F.when(gone, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    found = merkle.build(docs, COLUMNS, seen=seen, stride=stride)
    out = merkle.climb(found, small)
    return found, sorted(((r["key"], r["leaf"].hex(), r["subroot"].hex(), found.root.hex(), r["proof"].hex(), r["folded"].hex()) for r in out.collect()), key=str)


@pytest.mark.parametrize(("stride", "small"), [(1, None), (2, False), (6, None)])
def test_proofs(spark, rows, stride, small):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    docs = docs.selectExpr("*", "1 AS tree", "'x' AS digest", "2 AS row_no", "3 AS carried").repartition(5)
    found, got = climbed(docs, stride, small)
    want, nodes = plain(rows)
    assert got == want
    built = merkle.node_rows(found)
    assert sorted(r["digest"].hex() for r in built.collect()) == nodes
    # Every node but a tree's root has its parent among the rows.
    parents = built.selectExpr("tree", "level - 1 AS level", "idx AS parent").distinct()
    assert built.join(parents, ["tree", "level", "parent"]).count() == built.filter("parent IS NOT NULL").count()
    assert built.filter("parent IS NULL").count() == 1 + len({r[1] for r in rows})


def test_small_tables(spark, rows):
    docs = spark.createDataFrame(rows[:1], "doc_id long, source string, lang string, n_chars long, text string")
    assert climbed(docs, 6, None)[1] == plain(rows[:1])[0]
    none = merkle.build(docs.limit(0), COLUMNS)
    assert none.root is None and merkle.climb(none).collect() == [] and merkle.node_rows(none).collect() == []


def test_changed_row_is_found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    seen = {"text": F.when(F.col("doc_id") == 500, F.lit("other")).otherwise(F.col("text"))}
    found = merkle.build(docs, COLUMNS, seen=seen)
    assert [r["key"] for r in merkle.climb(found).filter(F.col("folded") != F.lit(found.root)).collect()] == [500]
