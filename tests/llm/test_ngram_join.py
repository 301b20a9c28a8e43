"""The similarity join against comparing every pair, and the prefix tree by itself."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from closebook.llm import ngram_join
from closebook.llm.ngram_join import Tree, _sieved, keys_of, one_of_each_group, similarity_groups

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(lowered)
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 90 * len(a | sets[j]):
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return [(d, len(sets[i]), low.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(docs)], [low.get(r) for r in {root(i) for i in range(len(docs)) if sets[i]}]


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(50)]
    base = [[rnd.choice(vocab) for _ in range(n)] for n in (1, 2, 3, 5, 12, 14, 30, 80, 200)]
    docs = []
    for i in range(200):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
            p = rnd.randrange(len(words))
            words[p] = rnd.choice([*vocab, words[p].upper()])
        docs.append((i, rnd.choice(" \n\t").join(words)))
    docs += [(200, None), (201, ""), (202, " \n"), (5, docs[5][1]), (7, docs[9][1]), (None, docs[3][1]), (None, "alone here it is")]
    return docs


@pytest.mark.parametrize("block_bytes", [1 << 21, 2000])
def test_groups(spark, rows, block_bytes):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS component_id", "1 AS digest")
    got = similarity_groups(docs, block_bytes=block_bytes)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert ordered(got.collect()) == ordered(brute(rows)[0])


def test_one_of_each(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id % 3 AS text_hash")
    kept = one_of_each_group(docs)
    assert kept.columns == docs.columns
    want = brute(rows)[1]
    got = [r["doc_id"] for r in kept.collect() if shingles(r["text"])]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sorted(r["doc_id"] for r in kept.collect() if not shingles(r["text"])) == [200, 201, 202]


def test_columns_named_like_helpers_are_kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS _own_text", "'b' AS _bucket", "1 AS _at", "2 AS kept_at")
    kept = one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert all((r["_own_text"], r["_bucket"], r["_at"], r["kept_at"]) == (r["doc_id"], "b", 1, 2) for r in kept.collect())


def test_sieve_loses_no_row(spark):
    docs = spark.range(3000).selectExpr("IF(id = 7, NULL, id) AS doc_id", "'t' AS text")
    extra = spark.range(0, 3000, 10).selectExpr("IF(id = 10, NULL, id) AS _extra_id")
    near, far = _sieved(docs, extra)
    ids = [{r["doc_id"] for r in part.collect()} for part in (near, far)]
    assert {r["_extra_id"] for r in extra.collect()} <= ids[0] and len(ids[0]) < 400
    assert near.columns == far.columns == docs.columns
    assert not ids[0] & ids[1] and len(ids[0] | ids[1]) == 3000


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert similarity_groups(empty).collect() == [] and one_of_each_group(empty).collect() == []


def test_tree():
    rng, rnd = np.random.default_rng(1), random.Random(5)
    for _ in range(30):
        base = [np.unique(rng.integers(0, 1 << 63, rnd.choice([3, 12, 40, 150])).astype(np.uint64)) for _ in range(3)]
        sets = {}
        for _ in range(60):
            b = rnd.choice(base)
            kept = b[rng.random(len(b)) > rnd.choice([0, 0.02, 0.05, 0.1])]
            one = np.unique(np.concatenate([kept, rng.integers(0, 1 << 63, rnd.choice([0, 1, 2, 5])).astype(np.uint64)]))
            if len(one):
                sets[one.tobytes()] = one
        sets = [*sets.values()]
        tree = Tree(sets)
        for one in sets:
            want = {j for j, y in enumerate(sets) if 100 * len(np.intersect1d(one, y)) >= 90 * len(np.union1d(one, y))}
            got = tree.near(one, 90).tolist()
            assert set(got) == want and len(got) == len(want)
            keys = set(keys_of(one, 90).tolist())
            assert all(keys & set(keys_of(sets[j], 90).tolist()) for j in want if sets[j] is not one)


def test_groups_and_buckets_follow_the_data(spark, rows, monkeypatch):
    grams = np.arange(50, dtype=np.uint64).tobytes()
    sets = spark.createDataFrame([(bytes([i // 250, i // 2 % 125]), bytes([i // 250, i % 250]), bytearray(grams)) for i in range(2000)], "cluster binary, digest binary, grams binary")
    held = ngram_join._block_groups(sets, 4096).groupBy("group").agg({"grams": "count"}).collect()
    assert sum(r[1] for r in held) == 2000 and max(r[1] for r in held) * (len(grams) + 64) <= 8 * 4096
    table = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "BUCKET_KEYS", 100)
    sizes = [len(keys_of(one, 90)) for one in ngram_join.sets_of([(t or "").encode() for _, t in rows])]
    assert ngram_join._buckets(ngram_join.with_digests(table), 90) >= sum(sizes) / 100 > 16
    assert ordered(similarity_groups(table).collect()) == ordered(brute(rows)[0])


def test_packed_keys_come_back():
    """Fewer than 15 bytes a key, where each owner has one key in a bucket."""
    rng = np.random.default_rng(3)
    digests = [rng.bytes(15) + b"\0" for _ in range(3000)]
    digests[7] = digests[8][:8] + digests[7][8:]  # one name for two classes
    keys = [rng.integers(0, 1 << 64, int(n), np.uint64) for n in rng.integers(0, 12, 3000)]
    packed = ngram_join._packed(digests, keys, 5000)
    found = set()
    for row in packed.to_pylist():
        key, owner = ngram_join._unpacked(row["keys"], row["owners"], row["names"])
        found |= {(row["bucket"], int(k), o.tobytes()) for k, o in zip(key, owner)}
    wanted = {((int(k) >> 32) * 5000 >> 32, int(k) & (1 << 48) - 1, d[:8]) for d, own in zip(digests, keys) for k in own}
    assert found == wanted
    sent = sum(len(row["keys"]) + len(row["owners"]) + len(row["names"]) for row in packed.to_pylist())
    assert sent < 15.2 * sum(map(len, keys))


def grown_together(pairs):
    """Sizes of the connected components of the pairs."""
    nodes = {n: {n} for pair in pairs for n in pair}
    for a, b in pairs:
        if nodes[a] is not nodes[b]:
            nodes[a] |= nodes[b]
            for n in nodes[b]:
                nodes[n] = nodes[a]
    return sorted(len(c) for c in {id(c): c for c in nodes.values()}.values())


def test_chance_does_not_grow_clusters(spark):
    """Texts that share single n-grams by chance stay apart, near copies meet."""
    rnd = random.Random(8)
    docs = [[f"w{rnd.randrange(30)}" for _ in range(120)] for _ in range(600)]
    for i in range(0, 600, 60):
        docs[i + 1] = [*docs[i][:50], "new", *docs[i][51:]]
    table = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    ids = ngram_join.with_digests(table)
    names = {r["doc_id"]: bytes(r["digest"][:8]) for r in ids.collect()}
    found = [(bytes(r["a"]), bytes(r["b"])) for r in ngram_join.candidates(table, ids, 80, 3).collect()]
    assert grown_together(found)[-1] <= 8
    linked = {frozenset(p) for p in found}
    assert all(frozenset((names[i], names[i + 1])) in linked for i in range(0, 600, 60))
    kept = [r["doc_id"] for r in one_of_each_group(table, 80, 3).select("doc_id").collect()]
    assert sorted(kept) == [i for i in range(600) if i % 60 != 1]


@pytest.mark.parametrize("percent", [80, 90, 95])
def test_similar_sets_have_a_key_with_a_like_mark(percent):
    """Wherever the differences lie, also side by side, and whatever n-grams are frequent."""
    rng, rnd = np.random.default_rng(percent), random.Random(percent)
    checked = 0
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 64, rnd.choice([3, 5, 8, 12, 20, 40, 150, 700]), np.uint64))
        n = len(a)
        most = n * (100 - percent) // 100
        gone = rnd.randint(0, most)
        places = (rnd.randrange(n) + np.arange(gone)) % n if rnd.random() < 0.5 else rng.permutation(n)[:gone]
        b = np.unique(np.concatenate([np.delete(a, places), rng.integers(0, 1 << 64, most - gone, np.uint64)]))
        frequent = rng.random(ngram_join.COUNTERS) < rnd.choice([0, 0.1, 0.6, 1])
        if np.array_equal(a, b) or 100 * len(np.intersect1d(a, b)) < percent * len(np.union1d(a, b)):
            continue
        (key_a, mark_a), (key_b, mark_b) = (ngram_join.marked_keys(s, percent, frequent) for s in (a, b))
        _, at_a, at_b = np.intersect1d(key_a, key_b, return_indices=True)
        assert (np.bitwise_count(mark_a[at_a] ^ mark_b[at_b]) <= ngram_join.MARK_SLICES).any()
        checked += 1
    assert checked > 100


@pytest.mark.parametrize("most", [1 << 15, 40])
def test_stars_connect_like_marks_of_a_key(monkeypatch, most):
    monkeypatch.setattr(ngram_join, "MOST_MARKS", most)
    rng = np.random.default_rng(4)
    key = rng.choice(np.array([1, 2, 3, 4, *range(10, 200)], np.uint64), 1500, p=[0.2, 0.1, 0.02, 0.02, *[0.66 / 190] * 190])
    near = rng.integers(0, 1 << 48, 6, np.uint64)[rng.integers(0, 6, 1500)] ^ np.uint64(1) << rng.integers(0, 48, 1500).astype(np.uint64)
    mark = np.where(rng.random(1500) < 0.6, near, rng.integers(0, 1 << 48, 1500, np.uint64))
    owner = np.arange(1500) % 1400
    for k in np.unique(key):
        at = np.flatnonzero(key == k)
        one = ngram_join._stars(key[at], mark[at], owner[at])
        want = [(int(owner[i]), int(owner[j])) for i in at for j in at if len(at) > most or int(mark[i] ^ mark[j]).bit_count() <= ngram_join.MARK_SLICES]
        assert grown_together([(int(a), int(b)) for a, b in one]) == [n for n in grown_together(want) if n > 1]
    every = ngram_join._stars(key, mark, owner)
    assert {tuple(s) for s in every.tolist()} == {tuple(s) for k in np.unique(key) for s in ngram_join._stars(key[key == k], mark[key == k], owner[key == k]).tolist()}
