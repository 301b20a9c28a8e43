"""Jaccard similarity join on word n-grams with a prefix tree.

N-grams are 64-bit hashes, and their order as numbers is the global order. Documents with equal
sets are one class, known by a digest of the set. Classes are compared as follows.

1. The range of hashes is cut into equal slices, so many that two sets within the similarity
   differ in fewer slices than there are: they agree on a whole slice. Each class gives a key for
   each slice, made of the hashes inside. How many slices depends on the size, by size levels;
   a set also gives keys for the level below if a smaller partner may be there.
   N-grams that very many documents have (a shared passage) would make unrelated documents alike, so
   slices hold the others only, as far as these fill enough slices: two sets differ in no more of
   them than in all. What is frequent, a table of counters of fixed size tells; any choice is exact.
   A slice may hold a single n-gram, which unrelated sets of a large table share by chance, the more of them the
   larger it is, until they hang together in one cluster. So each key has a mark: the parities, by MARK_BITS
   classes of hashes, of the n-grams in the MARK_SLICES slices that follow. With more slices than
   differences, some slice that two sets agree on is followed by few differences for its distance, whatever their places.

2. Classes with a common key, and marks that differ in no more bits than slices, are candidates. Only a star for
   each group of them is written, and the stars' connected components are the candidate clusters: all links lie inside them.
3. A cluster's sets are dealt into blocks of bounded size, and each pair of blocks is one group:
   one block's sets are stored in a prefix tree, the other's are looked up in it. A walk counts
   the overlap of a path once for all sets below it, and leaves a branch when the overlap so far
   and what both sides have left can't reach the similarity. Of the links found, those that
   connect something new inside the group are returned.

Nothing is sampled or capped; a hot cluster is spread over its pairs of blocks.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closebook.llm.graph import components
from closebook.llm.tables import set_aside, summed_tables
from closebook.llm.words import SOLID, mix, ngrams, slices, words_of
from closebook.session import discard, small_batches, staged
from closebook.workers import lean, release

PERCENT = 90
SIZE = 3
BLOCK_BYTES = 1 << 23
NODE = 32
FILTER_BITS = 1 << 24
BATCH_KEYS = 500_000
BATCH_TEXT = 1 << 18
BUCKET_KEYS = 2_000_000
COUNTERS = 1 << 20
# What is sent of a key beside its bucket, and of a digest. Equal ones by accident only make a cluster larger.
KEY_BYTES = 6
NAME_BYTES = 8
MARK_BYTES = 6
MARK_BITS = 8 * MARK_BYTES
MARK_SLICES = 6
# Marks of a key are compared at once up to so many, one after the other up to so many, and beyond that taken as alike.
FEW_MARKS = 16
MOST_MARKS = 1 << 15


# Sets and their digests


def sets_of(texts: list[bytes], size: int = SIZE) -> list[np.ndarray]:
    """Sorted hashes of each text's distinct n-grams; a shorter text is one n-gram."""
    words = words_of(texts, SOLID)
    hashes, counts, bounds = words.hashes(), words.counts, words.bounds
    grams = ngrams(hashes, size)
    found = []
    for i, n in enumerate(counts):
        low = bounds[i]
        if n >= size:
            found.append(np.unique(grams[low : low + n - size + 1]))
        else:
            found.append(ngrams(hashes[low : low + n], int(n)) if n else np.empty(0, np.uint64))
    return found


def digest_of(one: np.ndarray) -> bytes | None:
    return hashlib.blake2b(one.tobytes(), digest_size=16).digest() if len(one) else None


def with_digests(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, text_hash, n_shingles, digest); a document without words has no digest."""

    def run(batches):
        for batch, texts in slices(batches, limit=BATCH_TEXT):
            sets = sets_of(texts, size)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(digest_of, sets), pa.binary())],
                ["doc_id", "text_hash", "n_shingles", "digest"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return hashed.mapInArrow(lean(run), f"doc_id {kind}, text_hash long, n_shingles long, digest binary")


# Keys


def need(a, b, percent: int):
    """Least overlap of sets of sizes a and b within the similarity."""
    return -(-percent * (a + b) // (100 + percent))


def least_partner(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def level(n: int, percent: int) -> tuple[int, int]:
    """First and last size of the level of n. Levels grow a little faster than partners do."""
    starts = _levels.setdefault(percent, [1])
    while starts[-1] <= n:
        low = starts[-1]
        starts.append(max(low, low * (260 - 16 * percent // 10) // 100) + 1)
    place = bisect_right(starts, n) - 1
    return starts[place], starts[place + 1] - 1


_levels: dict[int, list[int]] = {}


def slices_of_level(low: int, high: int, percent: int) -> tuple[int, int]:
    """Number of slices, and how many of them may be empty, in a level of sizes.

    Hashes fall on slices at random, so a share of exp(-(n-grams a slice)) is empty; as many and
    half again are spared for.
    """
    differ = (100 - percent) * (high + 100 * high // percent) // (100 + percent)
    spare = 2 + math.ceil(1.6 * differ * math.exp(-low / (differ + 1)))
    return (differ + 1 + spare if differ else 0), spare


def frequent_counters(docs: DataFrame, size: int = SIZE) -> np.ndarray:
    """For each counter, whether the n-grams that share it are frequent: in more documents than
    twice the mean counter and 50. Counts cover all documents; the table's size is fixed."""

    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for _, texts in slices(batches, limit=BATCH_TEXT):
            np.add.at(total, (np.concatenate(sets_of(texts, size)) & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
        yield total

    total = summed_tables(docs.select("text").filter("text <> ''"), lean(count), COUNTERS)
    return total > 2 * total.mean() + 50


def keys_of(one: np.ndarray, percent: int, frequent: np.ndarray | None = None) -> np.ndarray:
    """Keys of a set: sets within the similarity, and not equal, have one in common."""
    return marked_keys(one, percent, frequent)[0]


def marked_keys(one: np.ndarray, percent: int, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set and the mark of each: sets within the similarity, and not equal, have a key in common
    whose marks differ in MARK_SLICES bits at most.

    Of ``count`` slices two such sets differ in at most ``differ``, by as many n-grams. So at least ``count - differ``
    slices are places from which on, around the ring of slices, any first k hold less than k differences
    (the cycle lemma): the sets agree on the first, and the next MARK_SLICES hold no more differences than there are slices, nor
    do their parities. If one of the sets has no more
    than ``spare`` empty slices, one such place is not empty. A set with more empty slices, for lack of
    rare n-grams, also gives keys for slices of all its n-grams; and if of those too many are
    empty, for the empty ones. Two sets that both lack rare ones so meet there.
    """
    n, found = len(one), []
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    rare = one if frequent is None else one[~frequent[(one & np.uint64(COUNTERS - 1)).astype(np.int64)]]
    own, below = level(n, percent), level(least_partner(n, percent), percent)
    while True:
        low, high = own
        count, spare = slices_of_level(low, high, percent)
        if count:
            keys, marks, places, empty = _slice_keys(rare, count, high, 1)
            found.append((keys, marks[places]))
            if len(empty) > spare:
                keys, marks, places, empty = _slice_keys(one, count, high, 2)
                found.append((keys, marks[places]))
                if len(empty) > spare:
                    found.append((mix(empty * np.uint64(0x9E3779B97F4A7C15) + np.uint64((high << 20) + 3)), marks[empty]))
        if own == below:
            return tuple(map(np.concatenate, zip(*found))) if found else (np.empty(0, np.uint64), np.empty(0, np.uint64))
        own = level(low - 1, percent)


def _slice_keys(grams: np.ndarray, count: int, high: int, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the slices that hold n-grams, marks of all slices, and the numbers of those that hold any and of the empty ones."""
    every = np.arange(count, dtype=np.uint64)
    if not len(grams):
        return np.empty(0, np.uint64), np.zeros(count, np.uint64), every[:0], every
    slot = (grams >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)
    begins = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
    sums, places = np.add.reduceat(mix(grams), begins), slot[begins]
    # Bits of the hash that tell neither its slice nor its counter.
    classes = (grams >> np.uint64(20) & np.uint64(0xFFF)) % np.uint64(MARK_BITS)
    after = min(MARK_SLICES, count - 1)
    ring = np.zeros(count + after, np.uint64)
    ring[places] = np.bitwise_xor.reduceat(np.uint64(1) << classes, begins)
    ring[count:] = ring[:after]
    passed = np.bitwise_xor.accumulate(ring)
    marks = passed[after:] ^ passed[:count]
    return mix(sums + places * np.uint64(0x9E3779B97F4A7C15) + np.uint64((high << 20) + kind)), marks, places, np.setdiff1d(every, places)


def _packed(digests: list[bytes], keys: list[np.ndarray], buckets: int, marks: list[np.ndarray] | None = None) -> pa.RecordBatch:
    """A row for each bucket of keys: keys, a bit for each that tells whether its owner is the next one, names of the owners, marks."""
    sizes = [len(k) for k in keys]
    key, owner = np.concatenate(keys), np.repeat(np.arange(len(keys), dtype=np.uint32), sizes)
    mark = np.zeros(len(key), np.uint64) if marks is None else np.concatenate(marks)
    bucket = (key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    order = np.argsort(bucket, kind="stable")
    key, owner, bucket, mark = key[order], owner[order], bucket[order], mark[order]
    rows = []
    for b, low, high in zip(*_runs(bucket)):
        used, place = np.unique(owner[low:high], return_inverse=True)
        steps = np.packbits(np.diff(place, prepend=0).astype(np.uint8))
        rows.append({"bucket": int(bucket[low]), "keys": _low_bytes(key[low:high], KEY_BYTES), "owners": steps.tobytes(), "names": b"".join(digests[i][:NAME_BYTES] for i in used), "marks": _low_bytes(mark[low:high], MARK_BYTES)})
    return pa.RecordBatch.from_pylist(rows, _PACKED)


def _unpacked(keys: bytes, owners: bytes, names: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a row of ``_packed``, and the name of each one's owner, as a number."""
    key = _from_low_bytes(keys, KEY_BYTES)
    place = np.cumsum(np.unpackbits(np.frombuffer(owners, np.uint8), count=len(key)), dtype=np.int64)
    return key, np.frombuffer(names, np.uint64)[place]


def _low_bytes(numbers: np.ndarray, width: int) -> bytes:
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _from_low_bytes(data: bytes, width: int) -> np.ndarray:
    low = np.frombuffer(data, np.uint8).reshape(-1, width)
    full = np.zeros((len(low), 8), np.uint8)
    full[:, :width] = low
    return full.view("<u8").ravel()


_PACKED = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("owners", pa.binary()), ("names", pa.binary()), ("marks", pa.binary())])


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, begin, end) of runs of equal values."""
    begins = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)
    return np.arange(len(begins)), begins, np.append(begins[1:], len(values))


def _same(key: np.ndarray, mark: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct (owner, smallest owner of the same key and mark) for those with several owners, and keys, marks
    and smallest owners without repeats, by key and owner."""
    order = np.lexsort((owner, mark, key))
    key, mark, owner = key[order], mark[order], owner[order]
    begins = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])]))
    center = np.repeat(owner[begins], np.diff(begins, append=len(key)))
    several = center != owner
    key, mark, first = key[begins], mark[begins], owner[begins]
    order = np.lexsort((first, key))
    return np.unique(np.stack([owner[several], center[several]], 1), axis=0), (key[order], mark[order], first[order])


def _stars(key: np.ndarray, mark: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Distinct (owner, smallest owner of its group) for owners of one key that marks with few differences connect."""
    equal, (key, mark, owner) = _same(key, mark, owner)
    _, begins, ends = _runs(key)
    label = np.arange(len(key))
    many = ends - begins
    stop = np.repeat(np.where(many <= FEW_MARKS, ends, 0), many)
    i, pairs = label, [(label[:0], label[:0])]
    for step in range(1, FEW_MARKS):
        i = i[i + step < stop[i]]
        near = i[np.bitwise_count(mark[i] ^ mark[i + step]) <= MARK_SLICES]
        pairs.append((near, near + step))
    a, b = map(np.concatenate, zip(*pairs))
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        np.minimum.at(label, high, low)
        label = label[label]
        differ = label[a] != label[b]
        a, b = a[differ], b[differ]
    while (label[label] != label).any():
        label = label[label]
    for low, high in zip(begins[many > FEW_MARKS], ends[many > FEW_MARKS]):
        label[low:high] = low + _connected(mark[low:high])
    moved = owner != owner[label]
    return np.unique(np.concatenate([equal, np.stack([owner[moved], owner[label[moved]]], 1)]), axis=0)


def _connected(marks: np.ndarray) -> np.ndarray:
    """For each mark the first one that steps of few differences lead to."""
    label, rest = np.zeros(len(marks), np.int64), np.arange(len(marks))
    while len(rest) and len(marks) <= MOST_MARKS:
        first, rest = rest[0], rest[1:]
        label[first], waiting = first, [first]
        while waiting and len(rest):
            near = np.bitwise_count(marks[rest] ^ marks[waiting.pop()]) <= MARK_SLICES
            label[rest[near]] = first
            waiting += rest[near].tolist()
            rest = rest[~near]
    return label


def most_keys(n: int, percent: int) -> int:
    """More keys than this a set of n n-grams never gives."""
    total, own, below = 0, level(n, percent), level(least_partner(n, percent), percent)
    while n:
        total += 2 * slices_of_level(*own, percent)[0]
        if own == below:
            break
        own = level(own[0] - 1, percent)
    return total


def _buckets(ids: DataFrame, percent: int) -> int:
    """So many buckets that each has BUCKET_KEYS keys at most, as ``n_shingles`` of ids tells."""

    def run(batches):
        known: dict[int, int] = {}
        total = 0
        for batch in batches:
            for n in batch.column("n_shingles").to_pylist():
                if n not in known:
                    known[n] = most_keys(n, percent)
                total += known[n]
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], ["keys"])

    keys = ids.select("n_shingles").mapInArrow(run, "keys long").agg(F.sum("keys")).first()[0] or 0
    return max(4 * int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-keys // BUCKET_KEYS))


def candidates(docs: DataFrame, ids: DataFrame, percent: int = PERCENT, size: int = SIZE) -> DataFrame:
    """(a, b): names (NAME_BYTES of the digest) of classes that share a key with marks of few differences, as stars.

    Keys travel packed, several megabytes a row at most; a key and mark that many classes of a batch share are sent
    for one of them, with the star of the rest beside it. ``ids``, with_digests(docs), tells how
    many buckets the keys take; a task holds one bucket at a time.
    """
    spark = docs.sparkSession
    buckets = _buckets(ids, percent)
    sent_counters = spark.sparkContext.broadcast(np.packbits(frequent_counters(docs, size)))
    pair = "bucket int, keys binary, owners binary, names binary, marks binary, a binary, b binary"

    def emit(batches):
        digests: list[bytes] = []
        keys: list[tuple[np.ndarray, np.ndarray]] = []
        seen: set[bytes] = set()
        total = 0
        frequent = np.unpackbits(sent_counters.value).astype(bool)
        for _, texts in slices(batches, limit=BATCH_TEXT):
            for one in sets_of(texts, size):
                digest = digest_of(one)
                if digest is None or digest in seen:
                    continue
                own = marked_keys(one, percent, frequent)
                if len(own[0]):
                    seen.add(digest)
                    digests.append(digest)
                    keys.append(own)
                    total += len(own[0])
            if total > BATCH_KEYS:
                yield from flush(digests, keys)
                digests, keys, seen, total = [], [], set(), 0
        if digests:
            yield from flush(digests, keys)

    def flush(digests, keys):
        order = np.argsort(np.array(digests, "S16"), kind="stable")
        digests, keys = [digests[i] for i in order], [keys[i] for i in order]
        owner = np.repeat(np.arange(len(keys)), [len(k) for k, _ in keys])
        stars, (key, mark, owner) = _same(*map(np.concatenate, zip(*keys)), owner)
        by_owner = np.argsort(owner, kind="stable")
        bounds = np.searchsorted(owner[by_owner], np.arange(1, len(keys)))
        packed = _packed(digests, np.split(key[by_owner], bounds), buckets, np.split(mark[by_owner], bounds))
        yield _both(packed, stars, digests)

    def match(batches):
        bucket, rows = None, []
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if row["a"] is not None:
                    found.append((row["a"], row["b"]))
                    continue
                if rows and row["bucket"] != bucket:
                    yield from matched(rows)
                    rows = []
                bucket = row["bucket"]
                rows.append((row["keys"], row["owners"], row["names"], row["marks"]))
            if found:
                yield _links(found)
        if rows:
            yield from matched(rows)

    def matched(rows):
        key, owner = map(np.concatenate, zip(*[_unpacked(*row[:3]) for row in rows]))
        mark = _from_low_bytes(b"".join(row[3] for row in rows), MARK_BYTES)
        found = [(a.tobytes(), b.tobytes()) for a, b in _stars(key, mark, owner)]
        if found:
            yield _links(found)

    sent = docs.select("text").mapInArrow(lean(emit), pair).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(lean(match), "a binary, b binary").distinct()


def _links(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    a, b = zip(*pairs)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _both(packed: pa.RecordBatch, stars: np.ndarray, digests: list[bytes]) -> pa.RecordBatch:
    n, m = len(packed), len(stars)
    columns = [pa.concat_arrays([packed.column(c), pa.nulls(m, packed.column(c).type)]) for c in ("keys", "owners", "names", "marks")]
    bucket = pa.concat_arrays([packed.column("bucket"), pa.array(np.arange(m) % 1000, pa.int32())])
    ends = [pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array([digests[i][:NAME_BYTES] for i in stars[:, k]], pa.binary())]) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([bucket, *columns, *ends], ["bucket", "keys", "owners", "names", "marks", "a", "b"])


# The prefix tree


class Tree:
    """Prefix tree of distinct sorted sets.

    A node holds up to NODE n-grams of a path without branches. ``end``: how many n-grams lie on
    the path up to its end; ``least``, ``most``: sizes of the sets below; ``last``: its last
    n-gram; ``whole``: the set that ends there, or -1. Nodes come by depth in nodes, children together.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.grams = np.unique(np.concatenate(sets))
        rows = [np.searchsorted(self.grams, s).astype(np.int32) + 1 for s in sets]
        order = sorted(range(len(rows)), key=lambda i: rows[i].astype(">i4").tobytes())
        rows = [rows[i] for i in order]
        shared = [0] + [_common(a, b) for a, b in zip(rows, rows[1:])]
        sizes = np.array([len(r) for r in rows])
        tokens, parents, ends, least, most, whole = [], [], [], [], [], []
        spans = [(0, len(rows), 0, -1)]  # sets from low to high share ``depth`` n-grams, under a node
        while spans:
            following = []
            for low, high, depth, parent in spans:
                if high - low == 1:
                    common = len(rows[low])
                else:
                    common = min(shared[low + 1 : high])
                end = min(common, depth + NODE)
                node = len(parents)
                if end > depth:
                    tokens.append(rows[low][depth:end])
                    parents.append(parent)
                    ends.append(end)
                    least.append(sizes[low:high].min())
                    most.append(sizes[low:high].max())
                    whole.append(order[low] if len(rows[low]) == end else -1)
                else:
                    node = parent
                if end < common:
                    following.append((low, high, end, node))
                    continue
                first = low + 1 if len(rows[low]) == end else low
                begin = first
                for i in range(first + 1, high + 1):
                    if i == high or shared[i] == end:
                        if begin < high:
                            following.append((begin, i, end, node))
                        begin = i
            spans = following
        self.tokens = np.zeros((len(parents), NODE), np.int32)
        for i, t in enumerate(tokens):
            self.tokens[i, : len(t)] = t
        self.ends, self.least, self.most, self.whole = (np.array(x, np.int64) for x in (ends, least, most, whole))
        self.last = np.array([t[-1] for t in tokens], np.int64)
        parents = np.array(parents, np.int64)
        self.by_parent = np.argsort(parents, kind="stable")
        self.first = np.searchsorted(parents[self.by_parent], np.arange(-1, len(parents) + 1))

    def children(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = self.first[nodes + 1], self.first[nodes + 2]
        many = high - low
        at = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        return self.by_parent[at], np.repeat(np.arange(len(nodes)), many)

    def near(self, one: np.ndarray, percent: int) -> np.ndarray:
        """Places of the sets within the similarity of ``one``."""
        n = len(one)
        place = np.searchsorted(self.grams, one)
        place[place == len(self.grams)] = 0
        known = np.flatnonzero(self.grams[place] == one)
        has = np.zeros(len(self.grams) + 1, bool)
        has[place[known] + 1] = True
        left = n - np.searchsorted(one, self.grams, "right")  # of ``one`` after each n-gram
        nodes, overlap, found = np.array([-1]), np.zeros(1, np.int64), []
        while len(nodes):
            below, parent = self.children(nodes)
            overlap = overlap[parent] + has[self.tokens[below]].sum(1)
            least, most = self.least[below], self.most[below]
            reach = overlap + np.minimum(most - self.ends[below], left[self.last[below] - 1])
            stay = (reach >= need(n, least, percent)) & (100 * most >= percent * n) & (100 * n >= percent * least)
            nodes, overlap = below[stay], overlap[stay]
            full = self.whole[nodes]
            sizes = self.ends[nodes]
            found.append(full[(full >= 0) & (overlap >= need(n, sizes, percent))])
        return np.concatenate(found)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = a[:n] != b[:n]
    return int(differ.argmax()) if differ.any() else n


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))
        self.parts = n

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        self.parts -= i != j
        return i != j


def linked(stored: list[np.ndarray], asked: list[np.ndarray] | None, percent: int) -> Iterator[tuple[int, int]]:
    """(place, place) of links between stored and asked sets, or among the stored ones, that
    connect something new. Asked sets are numbered after the stored ones."""
    tree, others = Tree(stored), stored if asked is None else asked
    offset = 0 if asked is None else len(stored)
    union = Union(len(stored) + (0 if asked is None else len(asked)))
    for i, one in enumerate(others):
        if union.parts == 1:
            return
        for j in tree.near(one, percent):
            if union.join(offset + i, int(j)):
                yield offset + i, int(j)


# The join


def _wanted(digests: DataFrame) -> bytes:
    """A bit map of fixed size of row hashes: a first sieve for the scan that fetches sets."""
    bit = F.pmod(F.col("row"), F.lit(FILTER_BITS))
    maps = digests.groupBy(F.expr(f"bitmap_bucket_number(pmod(row, {FILTER_BITS}))").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    bits = np.zeros((FILTER_BITS // 32768 + 2, 4096), np.uint8)
    for bucket, found in maps.collect():  # a fixed number of rows at most
        bits[bucket] = np.frombuffer(found, np.uint8)
    return bits.tobytes()


def _suspect_sets(docs: DataFrame, ids: DataFrame, clusters: DataFrame, size: int) -> DataFrame:
    """(cluster, digest, grams) of every class whose name is in a cluster, made again from one of its texts."""
    spark = docs.sparkSession
    row = F.xxhash64("doc_id")
    wanted = staged(ids.join(clusters, F.substring("digest", 1, NAME_BYTES) == F.col("node")).groupBy("digest", F.col("component").alias("cluster")).agg(F.min(row).alias("row")), "suspects")
    sent = spark.sparkContext.broadcast(_wanted(wanted))

    def fetch(batches):
        bits = np.frombuffer(sent.value, np.uint8).reshape(-1, 4096)
        for batch in batches:
            at = (np.asarray(batch.column("row")) % FILTER_BITS).astype(np.int64)
            # as Spark's bitmap functions number them: bucket 1 holds 1 to 32768, bucket 0 holds 0
            bucket = np.where(at > 0, 1 + (at - 1) // 32768, 0)
            place = np.where(at > 0, (at - 1) % 32768, 0)
            chosen = np.flatnonzero((bits[bucket, place // 8] >> (place % 8)) & 1)
            seen: set[bytes] = set()
            for _, texts in slices([batch.take(pa.array(chosen))], limit=BATCH_TEXT):
                sets = {digest_of(s): s for s in sets_of(texts, size)}
                new = [d for d in sets if d is not None and d not in seen]
                seen.update(new)
                if new:
                    yield pa.RecordBatch.from_arrays([pa.array(new, pa.binary()), pa.array([sets[d].tobytes() for d in new], pa.binary())], ["digest", "grams"])

    found = docs.select(row.alias("row"), "text").mapInArrow(lean(fetch), "digest binary, grams binary")
    once = found.groupBy("digest").agg(F.first("grams").alias("grams"))
    sets = staged(once.join(wanted.select("digest", "cluster"), "digest"), "sets")
    discard(wanted)
    return sets


def _block_groups(sets: DataFrame, block_bytes: int) -> DataFrame:
    """Sets of clusters with several, by ``group``: a pair of blocks of a cluster, or clusters of one
    block that fell into a bin. Bins are so many that they hold half a block in the mean."""
    total = sets.groupBy("cluster").agg(F.sum(F.length("grams") + F.lit(64)).alias("bytes"), F.count("*").alias("n")).filter("n > 1")
    total = staged(total.select("cluster", "bytes", F.ceil(F.col("bytes") / block_bytes).cast("int").alias("blocks")), "clusters")
    small = total.filter("blocks = 1").agg(F.sum("bytes")).first()[0] or 0
    bins = max(4 * int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * small // block_bytes))
    block = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    dealt = sets.join(total, "cluster").withColumn("block", block)
    # Each block meets every block, itself too: a group for each pair, named by the lower block first.
    with_other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return with_other.select(
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(bins))).otherwise(F.xxhash64("cluster", F.least("block", "other"), F.greatest("block", "other"))).alias("group"),
        "cluster", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") > F.col("other")).alias("asked"), "digest", "grams",
    )


def _block_links(sets: DataFrame, percent: int, block_bytes: int) -> DataFrame:
    """(a, b): links of a spanning forest of each group of blocks."""

    def join(table: pa.Table) -> pa.Table:
        parts: dict[tuple, tuple[dict, dict]] = {}
        for row in table.select(["cluster", "low", "high", "asked", "digest", "grams"]).to_pylist():
            part = parts.setdefault((row["cluster"], row["low"], row["high"]), ({}, {}))
            part[row["asked"]][row["digest"]] = np.frombuffer(row["grams"], np.uint64)
        found = []
        for (_, low, high), (stored, asked) in parts.items():
            if stored and (asked or low == high):
                names = [*stored, *asked]
                links = linked([*stored.values()], None if low == high else [*asked.values()], percent)
                found += [(names[i], names[j]) for i, j in links]
        a, b = zip(*found) if found else ((), ())
        del parts
        release()
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return _block_groups(sets, block_bytes).groupBy("group").applyInArrow(join, "a binary, b binary")


def _grouped(docs: DataFrame, percent: int, size: int, block_bytes: int) -> DataFrame:
    """with_digests(docs) with each class's component, a digest, and its smallest doc_id."""
    with small_batches(docs.sparkSession):
        return _labelled(docs, percent, size, block_bytes)


def _labelled(docs: DataFrame, percent: int, size: int, block_bytes: int) -> DataFrame:
    ids = staged(with_digests(docs, size), "digests")
    stars = staged(candidates(docs, ids, percent, size), "candidates")
    clusters = components(stars)
    sets = _suspect_sets(docs, ids, clusters, size)
    discard(stars, clusters)
    links = staged(_block_links(sets, percent, block_bytes), "links")
    discard(sets)
    labels = components(links).withColumnRenamed("node", "digest")
    classes = ids.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("low"))
    classes = classes.join(labels, "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    lows = classes.groupBy("component").agg(F.min("low").alias("component_id"))
    found = staged(classes.join(lows, "component").drop("low"), "classes")
    discard(links, labels)
    return ids.join(found, "digest", "left")


def similarity_groups(docs: DataFrame, percent: int = PERCENT, size: int = SIZE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document.

    Documents link when 100 * |intersection| >= percent * |union| of their n-gram sets, words being
    runs without white space, A-Z lower-cased. ``component_id`` is the smallest doc_id reachable
    by links. ``docs`` has doc_id and text; other columns are left out. Null, empty and blank
    texts have an empty set, link with nothing and are their own component. Rows with equal sets
    are linked; a repeated doc_id gives a row each. A null doc_id is no smallest one; a
    component that has no other has a null id. A table without rows gives none.
    """
    own = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return _grouped(docs, percent, size, block_bytes).select("doc_id", "n_shingles", own.alias("component_id"))


def _sieved(docs: DataFrame, extra: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two parts: rows whose id may be one of ``extra``, and rows whose id is none.

    A bit map of fixed size of the ids' hashes (513 rows of 4 KB at most) is broadcast; it has no
    bit missing, so only the first part needs the join with ``extra``, and only its texts move.
    """

    def bit(name: str) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(FILTER_BITS))

    maps = extra.groupBy(F.bitmap_bucket_number(bit("_extra_id")).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit("_extra_id"))).alias("_bits"))
    placed = docs.withColumns({"_bucket": F.bitmap_bucket_number(bit("doc_id")), "_at": F.bitmap_bit_position(bit("doc_id"))})
    found = placed.join(F.broadcast(staged(maps, "sieve")), "_bucket", "left")
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    may = F.coalesce(F.getbit(byte, (F.col("_at") % 8).cast("int")) == 1, F.lit(False))
    return tuple(found.filter(keep).select(*docs.columns) for keep in (may, ~may))


def one_of_each_group(docs: DataFrame, percent: int = PERCENT, size: int = SIZE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with all their columns, whatever their names, one row of each component: the smallest doc_id, nulls
    last, and of several such rows the smallest hash of the text. Blank texts all stay.
    """
    docs, named_back = set_aside(docs)
    names = docs.columns
    grouped = _grouped(docs, percent, size, block_bytes)
    rows = staged(grouped.filter("digest IS NOT NULL").select("doc_id", "text_hash", "component"), "rows")
    discard(grouped)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))
    first = rows.groupBy("component").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1")
    extra = rows.join(first, "component").filter(order != F.col("first"))
    extra = staged(extra.select(F.col("doc_id").alias("_extra_id"), F.col("text_hash").alias("_extra_text")).distinct(), "extra")

    def without(df: DataFrame, text: str) -> DataFrame:
        return df.join(extra, F.col("doc_id").eqNullSafe(F.col("_extra_id")) & (F.col(text) == F.col("_extra_text")), "left_anti")

    near, far = _sieved(docs.withColumn("_own_text", F.xxhash64("text")), extra)
    kept = without(near, "_own_text").unionByName(far)
    if without(rows, "text_hash").groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty():
        return named_back(kept.select(*names))
    blank = F.coalesce(F.trim(F.translate("text", "\t\n\x0b\x0c\r", "     ")), F.lit("")) == ""
    return named_back(kept.filter(~blank).dropDuplicates(["doc_id", "_own_text"]).unionByName(kept.filter(blank)).select(*names))
