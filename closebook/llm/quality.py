"""Quality classifier: random-indexing word vectors pooled per document, and a small network.

Words are runs of letters, of digits or of other signs. A word belongs to a bucket by its shape
(lower, upper, capital, other) and a hash of it. Each bucket has a fixed sparse random vector of +1
and -1, and a context vector: the sum, over the whole corpus, of the random vectors of the words
around it. A document is the mean and the spread of the context vectors of its words, with
a few shares of its own. A network of two layers in numpy is fitted on labelled rows and its
probabilities are calibrated by a temperature on rows that the fit didn't use.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closebook.llm.classify import PREDICT_FROM, fold, labelled_sample, sigmoid, temperature
from closebook.llm.tables import summed_tables
from closebook.llm.words import Words, byte_table, joined, mix, slices
from closebook.session import staged

SAMPLE = 6_000  # most labelled documents of each class that the fit reads
HASHES = 2_048  # buckets of each shape
SHAPES = 5
SIZE = 32
SIGNS = 4  # entries of a random vector that are not zero
AROUND = 2
HIDDEN = 24

_UPPER = byte_table(range(0x41, 0x5B))
_KIND = np.full(256, 3, np.uint8)  # other signs
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_KIND[0x30:0x3A] = 2


def shaped_words(texts: list[bytes]) -> tuple[Words, np.ndarray]:
    """Words of the texts and the bucket of each."""
    data, begins = joined(texts)
    kind = np.zeros(len(data) + 2, np.uint8)
    kind[1:-1] = _KIND[data]
    change = np.flatnonzero(kind[1:] != kind[:-1])  # edges between bytes change - 1 and change
    solid = kind[change + 1] != 0
    starts = change[solid]
    ends = change[1:][solid[:-1]] if len(change) else change
    words = Words(data, starts, ends, np.searchsorted(starts, begins))
    capitals = np.concatenate([[0], np.cumsum(_UPPER[data])])
    upper = capitals[ends] - capitals[starts]
    what = kind[starts + 1]
    shape = np.where(what == 1, np.where(upper == 0, 0, np.where((upper == 1) & (ends - starts > 1), 1, 2)), what + 1)
    return words, (shape * HASHES + (words.hashes() >> np.uint64(53)).astype(np.int64)).astype(np.int64)


def random_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the places of its entries, and their signs."""
    h = mix(np.arange(SHAPES * HASHES * SIGNS, dtype=np.uint64) + np.uint64(0xABCDEF12345)).reshape(-1, SIGNS)
    return (h % np.uint64(SIZE)).astype(np.int64), np.where(h >> np.uint64(63), 1, -1).astype(np.int64)


def add_contexts(total: np.ndarray, words: Words, bucket: np.ndarray) -> None:
    """Adds, for each word, the random vectors of the words around it, to the bucket's row."""
    places, signs = random_vectors()
    text = words.text()
    for off in range(1, AROUND + 1):
        if len(bucket) <= off:
            continue
        same = text[:-off] == text[off:]
        left, right = bucket[:-off][same], bucket[off:][same]
        for a, b in ((left, right), (right, left)):
            for k in range(SIGNS):
                total += np.bincount(a * SIZE + places[b, k], weights=signs[b, k], minlength=total.size).astype(np.int64)


def context_vectors(docs: DataFrame) -> np.ndarray:
    """The buckets' context vectors over all texts: a table of fixed size."""

    def count(batches):
        total = np.zeros(SHAPES * HASHES * SIZE, np.int64)
        for _, texts in slices(batches):
            add_contexts(total, *shaped_words(texts))
        yield total

    total = summed_tables(docs.select("text").filter("text <> ''"), count, SHAPES * HASHES * SIZE)
    vectors = total.astype(np.float64)
    vectors = vectors.reshape(SHAPES * HASHES, SIZE)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(norms > 0, norms, 1)).astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """For each text: mean and spread of its words' vectors, likeness of neighbours, share of different
    words, of each shape, and the log of the number of words. Zeros for a text without words."""
    words, bucket = shaped_words(texts)
    counts = words.counts
    n, some = np.maximum(counts, 1)[:, None], np.flatnonzero(counts)
    at = words.bounds[:-1][some]
    out = np.zeros((len(texts), 2 * SIZE + SHAPES + 4), np.float32)
    if not len(some):
        return out
    each = vectors[bucket]
    out[some, :SIZE] = np.add.reduceat(each, at) / n[some]
    squares = np.add.reduceat(each * each, at) / n[some]
    out[some, SIZE : 2 * SIZE] = np.sqrt(np.maximum(0, squares - out[some, :SIZE] ** 2))
    text = words.text()
    shape = bucket // HASHES
    rest = np.zeros((len(texts), SHAPES + 4), np.float32)
    rest[:, :SHAPES] = np.bincount(text * SHAPES + shape, minlength=len(texts) * SHAPES).reshape(-1, SHAPES) / n
    if len(bucket) > 1:
        inside = text[1:] == text[:-1]
        near = np.where(inside, np.einsum("ij,ij->i", each[1:], each[:-1]), 0)
        rest[:, SHAPES] = np.bincount(text[1:], weights=near, minlength=len(texts)) / n[:, 0]
        rest[:, SHAPES + 1] = np.bincount(text[1:], weights=inside & (bucket[1:] == bucket[:-1]), minlength=len(texts)) / n[:, 0]
    different = np.unique(text * (SHAPES * HASHES) + bucket) // (SHAPES * HASHES)
    rest[:, SHAPES + 2] = np.bincount(different, minlength=len(texts)) / n[:, 0]
    rest[:, SHAPES + 3] = np.log1p(counts) / 8
    out[:, 2 * SIZE :] = rest
    return out


@dataclass
class Network:
    """Two layers over standardised inputs; ``heat`` divides the last value before the sigmoid."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    heat: float = 1.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw(x) / self.heat)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, steps: int = 1500, ridge: float = 1e-4, seed: int = 11) -> Network:
        """Adam on the log loss of four fifths of the rows; the temperature on the rest."""
        rng = np.random.default_rng(seed)
        if not len(y) or y.min() == y.max():
            wide = x.shape[1] if x.ndim == 2 else 2 * SIZE + SHAPES + 4
            base = 0.0 if not len(y) else float(6 * y[0] - 3)
            return cls(np.zeros(wide), np.ones(wide), np.zeros((wide, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), base)
        order = rng.permutation(len(y))
        rest, use = order[: len(y) // 5], order[len(y) // 5 :]
        mean, spread = x[use].mean(0), x[use].std(0)
        net = cls(mean, np.where(spread > 1e-6, spread, 1), rng.normal(0, 0.15, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.15, HIDDEN), 0.0)
        params = [net.w1, net.b1, net.w2, np.zeros(1)]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            batch = use[rng.integers(0, len(use), min(512, len(use)))]
            inputs = (x[batch] - net.mean) / net.scale
            hidden = np.tanh(inputs @ params[0] + params[1])
            off = (sigmoid(hidden @ params[2] + params[3][0]) - y[batch]) / len(batch)
            back = np.outer(off, params[2]) * (1 - hidden**2)
            grads = [inputs.T @ back + ridge * params[0], back.sum(0), hidden.T @ off + ridge * params[2], np.array([off.sum()])]
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] -= 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
        held = rest if len(rest) >= 20 else use
        net.heat = temperature(net.raw(x[held]), y[held], np.ones(len(held)))
        return net


def learn(docs: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2, most: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Context vectors of the whole corpus, and a network fitted on at most ``most`` labelled
    documents of each class. Labels of the held-out fold are never read."""
    vectors = context_vectors(docs)
    sample = labelled_sample(labels.select("doc_id", "quality"), "quality", parts, held, most)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        for batch, texts in slices(batches):
            x = pooled(texts, sent.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"])

    found = staged(texts.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, x binary"), "sample")
    rows = found.groupBy("doc_id", "x").agg(F.max("label").alias("label")).orderBy("doc_id", "x").limit(4 * most).collect()  # small rows, at most 2 * most but for repeated ids
    y = np.array([r["label"] for r in rows], np.float64)
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in rows]) if rows else np.zeros((0, 2 * SIZE + SHAPES + 4), np.float32)
    return vectors, Network.fit(x.astype(np.float64), y)


def score(docs: DataFrame, vectors: np.ndarray, network: Network, parts: int = 4, held: int = 2) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted.

    ``docs`` has doc_id and text; other columns are left out. Null and empty texts are scored as texts without
    words. Without labelled rows of both classes all have one score. Repeated rows give a row
    each; a table without rows none.
    """
    sent = docs.sparkSession.sparkContext.broadcast((vectors, network))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        vectors, network = sent.value
        for batch, texts in slices(batches):
            p = network.probability(pooled(texts, vectors).astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p, pa.float64()), pa.array((p >= PREDICT_FROM).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", (fold(docs, parts) == held).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
