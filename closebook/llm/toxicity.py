"""Toxicity by misspelled terms of a lexicon.

The lexicon is learned: words, and beginnings of words, that are significantly more frequent in
toxic documents of the training rows. It is a trie, and the Levenshtein automaton of a
word is run along it: a state is the set of trie nodes that the letters read may have led to, each with its errors.
States are made when first met, numbered and kept once each, so a word costs one look-up a letter.

A found term weighs by how many errors it took and whether its window of words looks like a
quotation (quotation marks or words of saying near it) or like abuse (other terms near it). A
logistic regression on these counts gives the score.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closebook.llm.classify import PREDICT_FROM, fold, labelled_sample, sigmoid, temperature
from closebook.llm.words import slices
from closebook.session import discard, small_batches, staged
from closebook.workers import lean

SAMPLE = 6_000  # most labelled documents of each class that the fit reads
TERMS = 600  # most terms of the lexicon
PREFIX = (4, 5, 6)
WINDOW = 8
SIGNIFICANT = 20.0  # log-likelihood ratio, about one in 10^5 by chance
CACHE_WORDS = 100_000  # words whose matches are remembered, some 100 bytes each
CACHE_NODES = 500_000  # trie nodes in the automaton's remembered states, and steps between them, some 150 bytes each

WORD = re.compile(r"[^\W_]+(?:['’*@$][^\W_]+)*")
# Signs and words of quoting.
QUOTES = '"“”„«»‹›'
SAYING = frozenset("said says wrote called calls quote quoted word term dit écrit sagte schrieb dijo dice escribió".split())


@dataclass
class Automaton:
    """Lexicon trie with a Levenshtein automaton run along it.

    ``terms`` maps a term to its number; one that ends in ``*`` is a beginning, after which any
    letters may follow. ``find`` gives (term, errors) of the best match of a word, or None. Errors
    allowed depend on the length of the term: none below 5 letters, 1 below 9, then 2; a beginning
    allows none.
    """

    terms: list[str]
    edges: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: list[dict[bool, int]] = field(default_factory=lambda: [{}])
    reach: list[int] = field(default_factory=lambda: [0])
    numbers: dict = field(default_factory=dict)
    states: list = field(default_factory=list)
    steps: dict = field(default_factory=dict)
    held: int = 0
    known: dict = field(default_factory=dict)

    def __post_init__(self):
        for number, term in enumerate(self.terms):
            stem, node = term.removesuffix("*"), 0
            for letter in stem:
                if letter not in self.edges[node]:
                    self.edges[node][letter] = len(self.edges)
                    self.edges.append({})
                    self.ends.append({})
                    self.reach.append(0)
                node = self.edges[node][letter]
            self.ends[node][term.endswith("*")] = number
        self._spread(0)
        self.start = self._closed({(0, 0)})
        self._number(self.start)

    @staticmethod
    def allowed(length: int) -> int:
        return 0 if length < 5 else 1 if length < 9 else 2

    def _spread(self, root: int) -> None:
        """For each node the most errors that a term below it allows."""
        order, stack = [], [(root, 0)]
        while stack:
            node, depth = stack.pop()
            order.append((node, depth))
            stack += [(child, depth + 1) for child in self.edges[node].values()]
        for node, depth in reversed(order):
            own = self.allowed(depth) if self.ends[node] else 0
            self.reach[node] = max([own, *(self.reach[c] for c in self.edges[node].values())])

    def _closed(self, state: set[tuple[int, int]]) -> frozenset:
        """With skipped letters of terms, the fewest errors for each node, hopeless ones left out."""
        best: dict[int, int] = {}
        queue = sorted(state, key=lambda s: s[1])
        while queue:
            node, errors = queue.pop()
            if errors > self.reach[node] or best.get(node, 9) <= errors:
                continue
            best[node] = errors
            queue += [(child, errors + 1) for child in self.edges[node].values()]
        return frozenset(best.items())

    def _step(self, state: frozenset, letter: str) -> frozenset:
        following = set()
        for node, errors in state:
            following.add((node, errors + 1))  # a letter too many
            for edge, child in self.edges[node].items():
                following.add((child, errors + (edge != letter)))
        return self._closed(following)

    def _number(self, state: frozenset) -> int:
        """The number of a state, under which it and its best matches are kept once."""
        number = self.numbers.setdefault(state, len(self.states))
        if number == len(self.states):
            self.states.append((state, self._match(state, True), self._match(state, False)))
            self.held += len(state) + 1
        return number

    def _forget(self) -> None:
        """Starts the tables anew once they hold more than CACHE_NODES trie nodes and steps."""
        if self.held + len(self.steps) > CACHE_NODES:
            self.numbers, self.states, self.steps, self.held = {}, [], {}, 0
            self._number(self.start)

    def _match(self, state: frozenset, beginning: bool) -> tuple | None:
        found = [(errors, self.ends[node][beginning]) for node, errors in state if beginning in self.ends[node] and errors <= self._limit(node, beginning)]
        return min(found) if found else None

    def _limit(self, node: int, beginning: bool) -> int:
        term = self.terms[self.ends[node][beginning]]
        return 0 if beginning else self.allowed(len(term))

    def find(self, word: str) -> tuple[int, int] | None:
        """(term, errors), or None."""
        self._forget()
        at, best = 0, None
        for letter in word:
            step = (at, letter)
            following = self.steps.get(step)
            if following is None:
                following = self.steps[step] = self._number(self._step(self.states[at][0], letter))
            at = following
            state, hit, _ = self.states[at]
            if hit and (best is None or hit < best):
                best = hit
            if not state:
                break
        hit = self.states[at][2]
        if hit and (best is None or hit < best):
            best = hit
        return (best[1], best[0]) if best else None

    def among(self, words: set[str]) -> dict[str, tuple[int, int]]:
        """Matches of distinct words; what was found out is kept, up to CACHE_WORDS."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known, found = self.known, {}
        for word in words:
            if word in known:
                hit = known[word]
            else:
                hit = known[word] = self.find(word)
            if hit:
                found[word] = hit
        return found


@dataclass
class Hit:
    """A found term: the word's place, the term, its errors, how quoted and how crowded it is."""

    place: int
    term: int
    errors: int
    quoted: bool
    company: int


def hits_of(text: str, automaton: Automaton) -> tuple[int, list[Hit]]:
    """Number of words, and the hits with their windows."""
    lowered = text.lower()
    words = WORD.findall(lowered)
    found = automaton.among(set(words))
    if not found:
        return len(words), []
    spans = [m.span() for m in WORD.finditer(lowered)]
    places = [i for i, w in enumerate(words) if w in found]
    hits = []
    for k, i in enumerate(places):
        low, high = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
        before, after = lowered[spans[low][0] : spans[i][0]], lowered[spans[i][1] : spans[high - 1][1] + 1]
        quoted = (any(c in QUOTES for c in before) and any(c in QUOTES for c in after)) or not SAYING.isdisjoint(words[low:i])
        company = sum(low <= j < high for j in places[max(0, k - WINDOW) : k + WINDOW + 1]) - 1
        term, errors = found[words[i]]
        hits.append(Hit(i, term, errors, quoted, company))
    return len(words), hits


def features(n_words: int, hits: list[Hit], n_terms: int) -> np.ndarray:
    """Log counts of hits: exact, misspelled by one and by more, quoted ones apart, in company; their
    share of the words; and for each term whether it occurs exactly, and misspelled."""
    x = np.zeros(6 + 2 * n_terms, np.float32)
    for h in hits:
        x[3 if h.quoted else min(h.errors, 2)] += 1
        x[4] += h.company > 0
        x[6 + h.term + (n_terms if h.errors else 0)] = 0.5 if h.quoted else 1.0
    x[5] = 100 * len(hits) / max(1, n_words)
    x[:6] = np.log1p(x[:6])
    return x


@dataclass
class Model:
    """Lexicon, weights of the features, bias and temperature."""

    terms: list[str]
    weights: np.ndarray
    bias: float
    heat: float

    def score(self, text: str, automaton: Automaton) -> tuple[float, list[Hit]]:
        n_words, hits = hits_of(text, automaton)
        z = self.bias + float(features(n_words, hits, len(self.terms)) @ self.weights)
        return float(sigmoid(np.array(z / self.heat))), hits


def _sketched(sample: DataFrame) -> DataFrame:
    """``sample`` with the sketch of each text: copies share it, and count as one text."""

    def run(batches):
        for batch, texts in slices(batches):
            sketches = [_sketch(t.decode()) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sketches, pa.int64())], [*batch.schema.names, "sketch"])

    kind = ", ".join(f"{n} {t}" for n, t in sample.dtypes)
    return sample.mapInArrow(lean(run), f"{kind}, sketch long")


def _term_counts(sample: DataFrame) -> DataFrame:
    """(term, toxic, clean): how many different texts of the sample have each word.

    A word is in a text if any of its copies has it, so copies neither add to a count nor take from it.
    """

    def run(batches):
        seen: set[tuple[str, int, int]] = set()
        for batch in batches:
            labels, sketches = batch.column("label").to_pylist(), batch.column("sketch").to_pylist()
            at = 0
            for part, texts in slices([batch]):
                for text in texts:
                    seen.update((word, labels[at], sketches[at]) for word in set(WORD.findall(text.decode().lower())))
                    at += 1
                    if len(seen) > CACHE_WORDS:
                        yield _term_rows(seen)
                        seen = set()
        if seen:
            yield _term_rows(seen)

    words = sample.select("label", "sketch", "text").mapInArrow(lean(run), "term string, label int, sketch long").distinct()
    return words.groupBy("term").agg(F.sum(1 - F.col("label")).alias("clean"), F.sum("label").alias("toxic"))


def _term_rows(seen: set[tuple[str, int, int]]) -> pa.RecordBatch:
    terms, labels, sketches = zip(*seen)
    return pa.RecordBatch.from_arrays([pa.array(terms), pa.array(labels, pa.int32()), pa.array(sketches, pa.int64())], ["term", "label", "sketch"])


def learn_lexicon(sample: DataFrame, most: int = TERMS) -> list[str]:
    """Significant words and beginnings, the most significant first, at most ``most``.

    ``sample`` has label, text and sketch; texts of one class and sketch count as one text.
    A beginning below a chosen one adds nothing and is left out, as is one that is mostly one
    word. Beginnings are found without errors only, so significant words below a chosen one stay in the
    lexicon beside it, for their misspellings: at most ``most`` of them, besides the others.
    """
    distinct = sample.select("label", "sketch").distinct()
    totals = distinct.agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")).first()
    if not totals["toxic"] or not totals["clean"]:
        return []
    counts = staged(_term_counts(sample), "terms")
    words = counts.filter(F.length("term") >= 3)
    beginnings = None
    for n in PREFIX:
        part = words.filter(F.length("term") > n).groupBy(F.concat(F.substring("term", 1, n), F.lit("*")).alias("term"))
        part = part.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.max("toxic").alias("top")).filter("top < 0.8 * toxic").drop("top")
        beginnings = part if beginnings is None else beginnings.unionByName(part)
    n1, n0 = float(totals["toxic"]), float(totals["clean"])

    def part(a: F.Column, n: float, share: F.Column) -> F.Column:
        """Of the log-likelihood ratio: a of n documents against the share of all."""
        a = F.least(a.cast("double"), F.lit(n))
        none = n - a
        return F.when(a > 0, a * F.log(a / n / share)).otherwise(0.0) + F.when(none > 0, none * F.log(none / n / (1 - share))).otherwise(0.0)

    every = words.select("term", "clean", "toxic").unionByName(beginnings)
    every = every.withColumn("share", (F.least("toxic", F.lit(n1)) + F.least("clean", F.lit(n0))) / (n1 + n0)).filter("share < 1")
    ratio = 2 * (part(F.col("toxic"), n1, F.col("share")) + part(F.col("clean"), n0, F.col("share")))
    chosen = every.withColumn("ratio", ratio).filter((F.col("ratio") > SIGNIFICANT) & (F.col("toxic") / n1 > 10 * F.col("clean") / n0))
    rows = chosen.orderBy(F.desc("ratio"), F.length("term"), "term").limit(10 * most).collect()
    discard(counts)
    terms: list[str] = []
    beside: list[str] = []
    stems: set[str] = set()
    for (term, *_) in rows:
        stem = term.removesuffix("*")
        below = any(stem[:n] in stems for n in range(1, len(stem) + 1))
        if not below and len(terms) < most:
            terms.append(term)
            if term.endswith("*"):
                stems.add(stem)
        elif below and stem == term and Automaton.allowed(len(term)) and len(beside) < most:
            beside.append(term)
    return terms + beside


def _spread_terms(sample: DataFrame, terms: list[str], least: int = 3) -> list[str]:
    """Terms found in at least ``least`` different toxic texts; copies share a sketch, and so count as one."""

    number = {term: i for i, term in enumerate(terms)}

    def run(batches):
        for batch in batches:
            words = [set(WORD.findall((t or "").lower())) for t in batch.column("text").to_pylist()]
            found = [sorted({number[x] for w in ws for x in (w, *(f"{w[:n]}*" for n in PREFIX if len(w) >= n)) if x in number}) for ws in words]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column("sketch")], ["terms", "sketch"])

    found = sample.filter("label = 1").select("text", "sketch").mapInArrow(lean(run), "terms array<int>, sketch long")
    each = found.select(F.explode("terms").alias("term"), "sketch").groupBy("term").agg(F.countDistinct("sketch").alias("texts"))
    spread = each.filter(F.col("texts") >= least).select("term").collect()
    return [terms[i] for i in sorted(r["term"] for r in spread)]


def _sketch(text: str) -> int:
    words = text.lower().split()
    return min((zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))))


def learn(docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1, most: int = SAMPLE) -> Model:
    """Fit lexicon and weights on at most ``most`` labelled documents of each class.

    Rows of the held-out fold are never read. Without rows of both classes every score is 0.5 or
    the only class's.
    """
    with small_batches(docs.sparkSession):
        return _learn(docs, labels, parts, held, most)


def _learn(docs: DataFrame, labels: DataFrame, parts: int, held: int, most: int) -> Model:
    sample = labelled_sample(labels.select("doc_id", "toxic"), "toxic", parts, held, most)
    found = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(sample), "doc_id")
    texts = staged(_sketched(found.select("doc_id", "label", "text")), "sample")
    terms = _spread_terms(texts, learn_lexicon(texts))
    n = len(terms)

    def run(batches):
        automaton = Automaton(terms)
        for batch in batches:
            labels = batch.column("label").to_pylist()
            rows = [features(*hits_of(t or "", automaton), n) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(labels, pa.int32()), pa.array([_sparse(r) for r in rows], pa.binary())], ["doc_id", "label", "x"])

    rows = texts.mapInArrow(lean(run), "doc_id long, label int, x binary").orderBy("doc_id").collect()  # at most 2 * most small rows
    discard(texts)
    y = np.array([r["label"] for r in rows], np.float32)
    if not len(y) or y.min() == y.max():
        return Model([], np.zeros(6, np.float32), 0.0 if not len(y) else float(6 * y[0] - 3), 1.0)
    x = np.zeros((len(rows), 6 + 2 * n), np.float32)
    for i, r in enumerate(rows):
        pairs = np.frombuffer(r["x"], np.float32).reshape(-1, 2)
        x[i, pairs[:, 0].astype(int)] = pairs[:, 1]
    weights, bias = _fit(x, y)
    z = x @ weights + bias
    return Model(terms, weights, bias, temperature(z, y, np.ones(len(y))))


def _sparse(row: np.ndarray) -> bytes:
    at = np.flatnonzero(row)
    return np.stack([at.astype(np.float32), row[at]], 1).tobytes()


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression by gradient steps with momentum; the terms' own weights are held
    smaller than the counts', which speak for terms never seen misspelled."""
    weights, bias = np.zeros(x.shape[1], np.float32), 0.0
    pull = np.full(x.shape[1], ridge, np.float32)
    pull[:6] = ridge / 20
    speed, speed_bias = np.zeros_like(weights), 0.0
    for _ in range(steps):
        off = sigmoid(x @ weights + bias) - y
        speed = 0.9 * speed - 0.5 * (x.T @ off / len(y) + pull * weights / 10)
        speed_bias = 0.9 * speed_bias - 0.5 * float(off.mean())
        weights, bias = weights + speed, bias + speed_bias
    return weights.astype(np.float32), bias


def score(docs: DataFrame, model: Model, parts: int = 3, held: int = 1) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted, n_hits, and the hits as spans of words.

    ``docs`` has doc_id and text; other columns are left out. Null and empty texts are scored as
    texts without hits. Repeated rows give a row each; a table without rows none.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        model = sent.value
        automaton = Automaton(model.terms)
        for batch, texts in slices(batches):
            scores, found = [], []
            for text in texts:
                p, hits = model.score(text.decode(), automaton)
                scores.append(p)
                found.append([{"word": h.place, "term": model.terms[h.term], "errors": h.errors, "quoted": h.quoted} for h in hits])
            predicted = [int(p >= PREDICT_FROM) for p in scores]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array(predicted, pa.int32()), pa.array([len(h) for h in found], pa.int64()), pa.array(found, _HITS)],
                ["doc_id", "held_out", "score", "predicted", "n_hits", "hits"],
            )

    rows = docs.select("doc_id", (fold(docs, parts) == held).alias("held_out"), "text")
    return rows.mapInArrow(lean(run), f"doc_id {kind}, held_out boolean, score double, predicted int, n_hits long, hits array<struct<word:int,term:string,errors:int,quoted:boolean>>")


_HITS = pa.list_(pa.struct([("word", pa.int32()), ("term", pa.string()), ("errors", pa.int32()), ("quoted", pa.bool_())]))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with all their columns, less the documents predicted toxic. Nothing moves."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        automaton = Automaton(model.terms)
        for batch, texts in slices(batches):
            keep = [model.score(t.decode(), automaton)[0] < PREDICT_FROM for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
