"""Connected components against a plain union of sets."""

from __future__ import annotations

import random

import pytest

from closebook.llm.graph import components


@pytest.mark.parametrize("kind", ["random", "chain", "star", "none"])
def test_components(spark, kind):
    rnd = random.Random(7)
    links = {
        "random": [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)],
        "chain": [(i, i + 1) for i in range(70)],
        "star": [(0, i) for i in range(1, 40)],
        "none": [],
    }[kind]
    rnd.shuffle(links)
    up = {n: n for pair in links for n in pair}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: root(n) for n in up}


def test_nulls(spark):
    got = components(spark.createDataFrame([(1, None), (None, 2), (3, 3)], "a long, b long")).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 2), (3, 3)]
