"""Benchmark decontamination by winnowing.

Of every ``span - gram + 1`` consecutive n-gram hashes of a text the smallest is kept. The choice
depends on nothing outside the window, so two texts that share ``span`` words keep a common
hash at the same place of it: no shared span of that length is missed. Where a kept hash of a
document is one of the benchmark's, the hit is extended: of the spans of ``span`` words around it those that an item
has too, word by word, are hits, and together they make the whole shared passage. A span is
looked up once, however often it occurs in an item, so texts that repeat themselves take no longer.

An item of fewer than ``span`` words has one window, the whole item: documents are searched for
n-grams of that length, each checked word by word.

A benchmark measured as at most ``broadcast_bytes`` long is sent to the tasks and documents do
not move. A longer one is joined by kept hashes, text by text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closebook.llm.words import ALNUM, Words, ngram_inside, ngrams, slices, text_bytes, words_of
from closebook.session import staged
from closebook.workers import lean

SPAN = 10
GRAM = 6
BROADCAST_BYTES = 16 * 1024 * 1024

RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, hits array<struct<begin:int,stop:int>>"


def kept(hashes: np.ndarray, inside: np.ndarray, window: int) -> np.ndarray:
    """Marks n-grams that are the smallest of some window, with all that tie.

    Windows cut by the end of a text count too, so a short text keeps at least one.
    """
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    value = np.where(inside, hashes, top)
    pad = np.full(window - 1, top)
    padded = np.concatenate([pad, value, pad])
    lowest = padded[: len(padded) - window + 1].copy()
    for k in range(1, window):
        np.minimum(lowest, padded[k : k + len(lowest)], out=lowest)
    chosen = np.zeros(len(value), bool)
    for k in range(window):
        chosen |= value == lowest[k : k + len(value)]
    return chosen & inside


def runs(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of True."""
    edges = np.diff(np.concatenate([[0], equal.view(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


@dataclass
class Lookup:
    """N-gram hashes in order, each with the item and the word it begins at."""

    size: int
    hashes: np.ndarray
    items: np.ndarray
    places: np.ndarray
    filter: np.ndarray

    @classmethod
    def of(cls, size: int, hashes: np.ndarray, items: np.ndarray, places: np.ndarray) -> Lookup:
        """Of equal n-grams of an item the first is kept, which stands for all."""
        order = np.lexsort((places, items, hashes))
        hashes, items, places = hashes[order], items[order], places[order]
        first = np.ones(len(hashes), bool)
        first[1:] = (hashes[1:] != hashes[:-1]) | (items[1:] != items[:-1])
        hashes, items, places = hashes[first], items[first], places[first]
        seen = np.zeros(1 << 16, bool)
        seen[hashes >> np.uint64(48)] = True
        return cls(size, hashes, items, places, seen)

    def pairs(self, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word of the document, item, word of the item) of all equal hashes."""
        own = hashes[at]
        maybe = self.filter[own >> np.uint64(48)]
        at, own = at[maybe], own[maybe]
        low, high = np.searchsorted(self.hashes, own, "left"), np.searchsorted(self.hashes, own, "right")
        many = high - low
        first = np.repeat(low - np.cumsum(many) + many, many)
        found = first + np.arange(many.sum())
        return np.repeat(at, many), self.items[found], self.places[found]


@dataclass
class Benchmark:
    """Items with their words, ready to be searched for."""

    ids: list[str | None]
    words: Words
    hashes: np.ndarray
    long: Lookup
    spans: Lookup
    short: list[Lookup]
    span: int
    gram: int

    @classmethod
    def of(cls, ids: list[str | None], texts: list[bytes], span: int = SPAN, gram: int = GRAM) -> Benchmark:
        words = words_of(texts, ALNUM)
        hashes, item, counts = words.hashes(), words.text(), words.counts
        place = np.arange(len(item)) - words.bounds[:-1][item]
        grams = ngrams(hashes, gram)
        chosen = np.flatnonzero(kept(grams, ngram_inside(words, gram) & (counts[item] >= span)[: len(grams)], span - gram + 1))
        long = Lookup.of(gram, grams[chosen], item[chosen], place[chosen])
        whole = ngrams(hashes, span)
        every = np.flatnonzero(ngram_inside(words, span))
        spans = Lookup.of(span, whole[every], item[every], place[every])
        short = []
        for size in sorted({int(n) for n in counts if 0 < n < span}):
            whole = np.flatnonzero(counts == size)
            short.append(Lookup.of(size, ngrams(hashes, size)[words.bounds[:-1][whole]], whole, np.zeros_like(whole)))
        return cls(ids, words, hashes, long, spans, short, span, gram)

    def search(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, set[int]]]:
        """For each text: its words, which of them are hit, and the items found."""
        words = words_of(texts, ALNUM)
        hashes, text = words.hashes(), words.text()
        hit = np.zeros(len(hashes), bool)
        found: dict[int, set[int]] = {}
        grams = ngrams(hashes, self.gram)
        if len(self.long.hashes) and len(grams):
            at = np.flatnonzero(kept(grams, ngram_inside(words, self.gram), self.span - self.gram + 1))
            self._extend(words, hashes, text, hit, found, np.unique(self.long.pairs(grams, at)[0]))
        for short in self.short:
            grams = ngrams(hashes, short.size)
            at = np.flatnonzero(ngram_inside(words, short.size))
            for place, item, _ in zip(*short.pairs(grams, at)):
                begin = self.words.bounds[item]
                if self._same(words, place, begin, short.size):
                    hit[place : place + short.size] = True
                    found.setdefault(int(text[place]), set()).add(int(item))
        for i in range(len(texts)):
            low, high = words.bounds[i], words.bounds[i + 1]
            yield int(high - low), hit[low:high], found.get(i, set())

    def _extend(self, words: Words, hashes: np.ndarray, text: np.ndarray, hit: np.ndarray, found: dict, anchors: np.ndarray) -> None:
        """Hits of the spans that hold one of the kept n-grams at ``anchors``."""
        whole, inside = ngrams(hashes, self.span), ngram_inside(words, self.span)
        starts = np.unique(anchors[:, None] - np.arange(self.span - self.gram + 1))
        starts = starts[(starts >= 0) & (starts < len(whole))]
        starts = starts[inside[starts]]
        places, items, begins = self.spans.pairs(whole, starts)
        # Spans that follow one another in the document and in the item are compared as one.
        order = np.lexsort((places, places - begins, items))
        places, items, begins = places[order], items[order], begins[order]
        new = np.ones(len(places), bool)
        new[1:] = (places[1:] != places[:-1] + 1) | (begins[1:] != begins[:-1] + 1) | (items[1:] != items[:-1])
        lows = np.flatnonzero(new)
        for low, high in zip(lows, np.append(lows[1:], len(places))):
            place, item, size = places[low], items[low], self.span + high - low - 1
            if self._same(words, place, self.words.bounds[item] + begins[low], size):
                hit[place : place + size] = True
                found.setdefault(int(text[place]), set()).add(int(item))

    def _same(self, words: Words, place: int, begin: int, size: int) -> bool:
        """Whether so many words are equal, as strings."""
        return all(words.string(place + k) == self.words.string(begin + k) for k in range(size))


def _summary(n_words: int, hit: np.ndarray, items: list[str]) -> tuple:
    text = ",".join(items)
    low, high = runs(hit)
    spans = [{"begin": int(a), "stop": int(b)} for a, b in zip(low, high)]
    n_hit = int(hit.sum())
    return n_words, n_hit, len(items), hashlib.sha256(text.encode()).hexdigest(), n_hit > 0, items, spans


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A row per document: its id, counts, items found, and hit words as spans of word numbers.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are left out. Null
    and empty texts have no words: such documents hit nothing, such items are found nowhere.
    Repeated documents give a row each. Items with one id count once; an item without an id
    hits words but is not listed. Neither table needs rows.
    """
    docs, items = docs.select("doc_id", "text"), _items(items)
    if _fits(items, broadcast_bytes):
        return _against_broadcast(docs, items, span, gram)
    return _against_table(docs, items, span, gram)


def without_contaminated(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with all their columns, less the documents with a hit word."""
    items = _items(items)
    if not _fits(items, broadcast_bytes):
        hits = _hits_by_text(docs, items, span, gram).select(F.col("_text").alias("_hit_text")).distinct()
        return docs.join(hits, F.sha2("text", 256) == F.col("_hit_text"), "left_anti")
    sent = _sent(items, span, gram)

    def keep(batches):
        for batch, texts in slices(batches):
            yield batch.filter(pa.array([not hit.any() for _, hit, _ in sent.value.search(texts)], pa.bool_()))

    return docs.mapInArrow(lean(keep), docs.schema)


def _items(items: DataFrame) -> DataFrame:
    return items.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text <> ''").distinct()


def _fits(items: DataFrame, broadcast_bytes: int) -> bool:
    size = items.agg(F.sum(F.octet_length("text") + F.lit(32)).alias("bytes")).first()["bytes"] or 0
    return size <= broadcast_bytes


def _sent(items: DataFrame, span: int, gram: int):
    rows = items.collect()  # measured by _fits
    return items.sparkSession.sparkContext.broadcast(Benchmark.of([r["item_id"] for r in rows], [r["text"].encode() for r in rows], span, gram))


def _against_broadcast(docs: DataFrame, items: DataFrame, span: int, gram: int) -> DataFrame:
    sent = _sent(items, span, gram)
    names = [n.split(" ")[0] for n in RESULT.split(", ")]

    def search(batches):
        benchmark = sent.value
        for batch, texts in slices(batches):
            found = []
            for n_words, hit, items in benchmark.search(texts):
                ids = sorted({benchmark.ids[i] for i in items} - {None})
                found.append(_summary(n_words, hit, ids))
            columns = list(zip(*found))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(_column, names, columns)], ["doc_id", *names])

    return docs.mapInArrow(lean(search), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {RESULT}")


_TYPES = {
    "n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string(), "contaminated": pa.bool_(),
    "items": pa.list_(pa.string()), "hits": pa.list_(pa.struct([("begin", pa.int32()), ("stop", pa.int32())])),
}


def _column(name: str, values) -> pa.Array:
    return pa.array(list(values), _TYPES[name])


def _fingerprints(df: DataFrame, key: str, sizes: list[int], span: int, gram: int, items: bool) -> DataFrame:
    """(key, size, hash) of kept n-grams; of short windows too, by their number of words."""

    def emit(batches):
        for batch, texts in slices(batches):
            words = words_of(texts, ALNUM)
            hashes, text, counts = words.hashes(), words.text(), words.counts
            for size in [0, *sizes]:
                n = size or gram
                grams, inside = ngrams(hashes, n), ngram_inside(words, n)
                if size == 0:
                    chosen = kept(grams, inside, span - gram + 1) & (counts[text[: len(grams)]] >= (span if items else 0)) if len(grams) else inside
                else:
                    chosen = inside & (counts[text[: len(grams)]] == size) if items else inside
                at = np.flatnonzero(chosen)
                found = pa.table({key: batch.column(key).take(text[at]), "size": np.full(len(at), size, np.int32), "hash": grams[at].view(np.int64)})
                yield from found.group_by([key, "size", "hash"]).aggregate([]).select([key, "size", "hash"]).to_batches()

    return df.mapInArrow(emit, f"{key} string, size int, hash long")


def _hits_by_text(docs: DataFrame, items: DataFrame, span: int, gram: int) -> DataFrame:
    """(_text, item_id, spans) for a benchmark of any size. Texts are known by their digest, so
    copies are searched once."""
    docs = docs.select(F.sha2("text", 256).alias("_text"), "text")
    texts = docs.filter("text IS NOT NULL").groupBy("_text").agg(F.first("text").alias("text"))
    items = items.withColumn("_item", F.sha2(F.concat_ws(" ", "item_id", "text"), 256))
    words = F.size(F.expr(r"regexp_extract_all(text, '[0-9A-Za-z\\x{80}-\\x{10FFFF}]+', 0)"))
    sizes = [r["n"] for r in items.select(words.alias("n")).filter(f"n > 0 AND n < {span}").distinct().collect()]
    of_items = _fingerprints(items.select("_item", "text"), "_item", sizes, span, gram, True)
    of_texts = _fingerprints(texts.select("_text", "text"), "_text", sizes, span, gram, False)
    pairs = staged(of_texts.join(of_items, ["size", "hash"]).select("_text", "_item").distinct(), "pairs")
    joined = pairs.join(texts, "_text").join(items.withColumnRenamed("text", "item_text"), "_item")

    def verify(batches):
        for batch in batches:
            found = []
            for key, text, item_id, item in zip(*(batch.column(c).to_pylist() for c in ("_text", "text", "item_id", "item_text"))):
                benchmark = Benchmark.of([item_id], [item.encode()], span, gram)
                for _, hit, items in benchmark.search([text.encode()]):
                    if items:
                        low, high = runs(hit)
                        found.append({"_text": key, "item_id": item_id, "spans": [{"begin": int(a), "stop": int(b)} for a, b in zip(low, high)]})
            schema = pa.schema([("_text", pa.string()), ("item_id", pa.string()), ("spans", _TYPES["hits"])])
            yield pa.RecordBatch.from_pylist(found, schema)

    return joined.mapInArrow(verify, "_text string, item_id string, spans array<struct<begin:int,stop:int>>")


def _against_table(docs: DataFrame, items: DataFrame, span: int, gram: int) -> DataFrame:
    hits = _hits_by_text(docs, items, span, gram)
    docs = docs.withColumn("_text", F.sha2("text", 256))
    merged = hits.groupBy("_text").agg(F.collect_set("item_id").alias("items"), F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    names = [n.split(" ")[0] for n in RESULT.split(", ")]

    def summarise(batches):
        for batch, texts in slices(batches):
            counts = words_of(texts, ALNUM).counts
            found = []
            for n, items, spans in zip(counts, batch.column("items").to_pylist(), batch.column("spans").to_pylist()):
                hit = np.zeros(n, bool)
                for s in spans or ():
                    hit[s["begin"] : s["stop"]] = True
                found.append(_summary(int(n), hit, sorted(items or ())))
            columns = list(zip(*found))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(_column, names, columns)], ["doc_id", *names])

    whole = docs.join(merged, "_text", "left").select("doc_id", "text", "items", "spans")
    return whole.mapInArrow(summarise, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {RESULT}")
