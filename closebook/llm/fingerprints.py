"""Document fingerprints by a randomised edit embedding.

A walker reads a text from the front. At each step it writes the character it stands on, and shared
random bits for (step, character) decide whether it moves on. Two walkers on texts that differ by
a few edits soon stand at the same places again, so few written characters differ: edit distance
becomes Hamming distance.

Of the written characters SLOTS are kept, bit-sampled: each slot has a random order of all steps
and takes the first in that order among the steps of the text. So slots of texts of different lengths
agree as often as the shorter walk is a share of the longer. A slot holds a byte, the hash of its step
and of the characters there; the likeness of two fingerprints is the share of equal slots.

Bands of slots find candidates among fingerprints, which are then verified by that share.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from closebook.llm.graph import components
from closebook.llm.ngram_join import Union
from closebook.llm.words import mix
from closebook.session import staged

SLOTS = 64
SPAN = 6
GROUP_CHARS = 6_000_000
CHECKED = 16  # steps between looks for finished walks, which go on over zeros meanwhile
BANDS = 16
BLOCK = 2_000

_RATE = 1 << 12  # steps whose bits are made at once


class Sampler:
    """For each slot, the steps that come first in its order among all steps up to them.

    After a step that holds the record v (uniform, smaller is earlier), the next record is a
    geometric number of steps on. So a slot has about log(n) records in n steps, and they are made from
    the slot's own seed as far as a text needs.
    """

    def __init__(self, slots: int):
        self.rngs = [np.random.Generator(np.random.PCG64([7, k])) for k in range(slots)]
        self.steps = [[0] for _ in range(slots)]
        self.value = [rng.random() for rng in self.rngs]
        self.reach = 0

    def extend(self, n: int) -> None:
        if n <= self.reach:
            return
        self.reach = max(n, 2 * self.reach, 1 << 16)
        for k, rng in enumerate(self.rngs):
            while self.steps[k][-1] < self.reach:
                gap = rng.geometric(max(self.value[k], 1e-15))
                self.steps[k].append(self.steps[k][-1] + int(gap))
                self.value[k] *= rng.random()
        every = np.unique(np.concatenate(self.steps))
        self.every = every
        self.slot_steps = [np.array(s) for s in self.steps]
        self.places = [np.searchsorted(every, s) for s in self.slot_steps]

    def chosen(self, lengths: np.ndarray) -> np.ndarray:
        """For each walk length and slot, the place in ``every`` of the step kept."""
        found = np.empty((len(lengths), len(self.steps)), np.int64)
        for k, (steps, places) in enumerate(zip(self.slot_steps, self.places)):
            found[:, k] = places[np.searchsorted(steps, np.maximum(lengths, 1), "left") - 1]
        return found


_samplers: dict[int, Sampler] = {}


def _sampler(slots: int) -> Sampler:
    if slots not in _samplers:
        _samplers[slots] = Sampler(slots)
    return _samplers[slots]


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, zeros after each, and where each begins."""
    pad = "\0" * (SPAN + CHECKED)
    data = np.frombuffer(pad.join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + len(pad)
    return data, np.concatenate([[0], np.cumsum(sizes)[:-1]])


def _moves(first: int) -> np.ndarray:
    """For steps from ``first`` on, whether each of 64 kinds of character moves the walker on."""
    steps = np.arange(first, first + _RATE, dtype=np.uint64)
    bits = mix(steps * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03))
    return ((bits[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.int64)


def fingerprint_all(texts: list[str], slots: int = SLOTS) -> list[bytes]:
    """Fingerprints of texts, walked side by side. The longest lead; finished ones drop out.

    A text of n characters is walked until its end, about 2 n steps. An empty one has a
    fingerprint of its own, which no other text has.
    """
    if not texts:
        return []
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    data, begins = _codes([texts[i] for i in order])
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    ends = begins + sizes
    kinds = np.empty(len(data), np.int8)
    for low in range(0, len(data), 1 << 20):
        kinds[low : low + (1 << 20)] = mix(data[low : low + (1 << 20)].astype(np.uint64)) >> np.uint64(58)
    sampler = _sampler(slots)
    alive = np.flatnonzero(sizes > 0)
    here, goal = begins[alive], ends[alive]
    walked = np.zeros(len(order), np.int64)
    sampled: list[tuple[int, np.ndarray, np.ndarray]] = []
    step, place = 0, 0
    while len(alive):
        sampler.extend(step + _RATE + 1)
        moves, wanted = _moves(step), sampler.every
        following = int(wanted[place])
        for row in moves:
            if step == following:
                sampled.append((place, alive, here.copy()))
                place += 1
                following = int(wanted[place])
            here += row.take(kinds.take(here))
            step += 1
            if not step % CHECKED:
                here, goal, alive = _drop_finished(here, goal, alive, walked, step)
                if not len(alive):
                    break
    return _slots(order, sizes, data, sampled, walked, sampler, slots)


def _drop_finished(here, goal, alive, walked, step):
    ended = here >= goal
    if not ended.any():
        return here, goal, alive
    walked[alive[ended]] = step
    stay = ~ended
    return here[stay], goal[stay], alive[stay]


def _slots(order, sizes, data, sampled, walked, sampler, slots) -> list[bytes]:
    held = np.zeros((max(1, len(sampled)), len(order)), np.uint8)
    for place, alive, here in sampled:
        symbol = np.zeros(len(alive), np.uint64)
        for k in range(SPAN):
            symbol = mix(symbol + data[np.minimum(here + k, len(data) - 1)].astype(np.uint64) + np.uint64(k + 1))
        held[place, alive] = (mix(symbol + np.uint64(place * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(56)).astype(np.uint8)
    chosen = sampler.chosen(walked)
    values = held[np.minimum(chosen, len(held) - 1), np.arange(len(order))[:, None]]
    found: list[bytes] = [b""] * len(order)
    for row, i in enumerate(order):
        found[i] = values[row].tobytes() if sizes[row] else b"\0" * slots
    return found


def shares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness of rows of slots: the share of equal ones, less what chance gives."""
    same = (a == b).mean(1)
    return np.maximum(0.0, (same - 1 / 256) / (1 - 1 / 256))


def likeness(a: bytes, b: bytes) -> float:
    return float(shares(np.frombuffer(a, np.uint8)[None], np.frombuffer(b, np.uint8)[None])[0])


# Documents in order, each with its neighbour


_ROW = [("kind", pa.string()), ("part", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("next_fingerprint", pa.binary()), ("text", pa.string())]
_ROWS = pa.schema(_ROW)
_DDL = "kind string, part int, doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, next_fingerprint binary, text string"


def edited(text: str, following: str) -> str:
    """The last half of the code points, rounded down, replaced by the first as many of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _result(part: int, doc: int | None, text: str, own: bytes, changed: str, changed_print: bytes, following: bytes) -> dict:
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return {"kind": "done", "part": part, "doc_id": doc, "n_chars": len(text), "edited_sha256": digest, "fingerprint": own, "edited_fingerprint": changed_print, "next_fingerprint": following}


def _in_order(docs: DataFrame, slots: int) -> DataFrame:
    """Rows of sorted documents: done ones, and of each part the first, and the last, which waits
    for the next part's first."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        waiting: tuple | None = None  # (doc_id, text, fingerprint)
        group: list[tuple] = []
        size = 0

        def flush():
            nonlocal waiting, group, size
            out = []
            texts = [t for _, t in group]
            before = ([waiting[1]] if waiting else []) + texts[:-1]
            after = texts if waiting else texts[1:]
            changed = [edited(a, b) for a, b in zip(before, after)]
            prints = fingerprint_all(texts + changed, slots)
            own = [(doc, text, p) for (doc, text), p in zip(group, prints)]
            if not waiting:
                doc, text, p = own[0]
                out.append({"kind": "first", "part": part, "doc_id": doc, "fingerprint": p, "text": text})
            row = ([waiting] if waiting else []) + own
            for (doc, text, p), (_, _, q), c, cp in zip(row, row[1:], changed, prints[len(texts) :]):
                out.append(_result(part, doc, text, p, c, cp, q))
            waiting, group, size = row[-1], [], 0
            return pa.RecordBatch.from_pylist(out, _ROWS)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                group.append((doc, text))
                size += len(text)
                if size >= GROUP_CHARS:
                    yield flush()
        if group:
            yield flush()
        if waiting:
            doc, text, p = waiting
            yield pa.RecordBatch.from_pylist([{"kind": "last", "part": part, "doc_id": doc, "fingerprint": p, "text": text}], _ROWS)

    return rows.orderBy("doc_id", F.xxhash64("text")).mapInArrow(run, _DDL)


def _across_parts(rows: DataFrame, slots: int) -> DataFrame:
    """The last document of each part with the first of the next part, and of the first part
    with that of the last: two rows a part, so few whatever the data."""
    parts = rows.filter("kind = 'first'").select("part")
    order = Window.orderBy("part")
    following = parts.withColumn("next", F.lead("part").over(order)).withColumn("low", F.min("part").over(Window.partitionBy()))
    following = following.select("part", F.coalesce("next", "low").alias("next"))
    last = rows.filter("kind = 'last'").select("part", "doc_id", "text", "fingerprint")
    first = rows.filter("kind = 'first'").select(F.col("part").alias("next"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    pairs = last.join(following, "part").join(first, "next")

    def run(batches):
        for batch in batches:
            found = batch.to_pylist()
            changed = [edited(r["text"], r["next_text"]) for r in found]
            prints = fingerprint_all(changed, slots)
            out = [_result(r["part"], r["doc_id"], r["text"], r["fingerprint"], c, p, r["next_fingerprint"]) for r, c, p in zip(found, changed, prints)]
            yield pa.RecordBatch.from_pylist(out, _ROWS)

    return pairs.mapInArrow(run, _DDL)


def compare_with_next(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """A row per document: fingerprints of its text and of its edited text, and their likeness.

    ``docs`` has doc_id (an integer) and text; other columns are left out. Documents are in order of doc_id, null
    first, rows with one id by a hash of the text; after the last comes the first, so a single row is its own
    next. Null texts are empty. Empty texts have likeness 1 with each other, 0 with any other.
    A table without rows gives none.
    """
    rows = staged(_in_order(docs, slots), "walks")
    whole = rows.filter("kind = 'done'").unionByName(_across_parts(rows, slots))
    names = ["fingerprint", "edited_fingerprint", "next_fingerprint"]

    def run(batches):
        for batch in batches:
            own, other, following = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, slots) for c in names)
            columns = [batch.column("doc_id"), batch.column("n_chars"), batch.column("edited_sha256")]
            columns += [pa.array([x.hex() for x in batch.column(c).to_pylist()], pa.string()) for c in names[:2]]
            columns += [pa.array(shares(own, other)), pa.array(shares(own, following))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return whole.select("doc_id", "n_chars", "edited_sha256", *names).mapInArrow(run, kinds)


# Banding and verification


def near_copies(prints: DataFrame, least: float = 0.8, bands: int = BANDS, block: int = BLOCK) -> DataFrame:
    """(doc_id, group_id) of ``prints`` (doc_id, fingerprint as hex): groups of near copies.

    Fingerprints that agree on a whole band and have a likeness of at least ``least`` link; a
    group is what links connect, named by its smallest doc_id. Equal fingerprints are one node. A
    band value that more than ``block`` of them share is compared in pairs of blocks, each a
    group of its own, so that every pair is compared and no group is larger than two blocks.
    """
    nodes = prints.filter("fingerprint IS NOT NULL").select("fingerprint").distinct()
    width = F.length("fingerprint") / bands
    cut = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.alias("band"), F.substring(F.col("fingerprint"), (b * width + 1).cast("int"), width.cast("int")).alias("value")))
    banded = staged(nodes.select("fingerprint", F.inline(cut)), "bands")
    sizes = banded.groupBy("band", "value").agg(F.count("*").alias("n")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n")
    dealt = banded.join(sizes, ["band", "value"]).withColumn("own", F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("band", "value", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).alias("asked"), "fingerprint")

    def link(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        names = sorted({r["fingerprint"] for r in rows})
        places = {n: i for i, n in enumerate(names)}
        values = np.frombuffer(bytes.fromhex("".join(names)), np.uint8).reshape(len(names), -1)
        same_block = rows[0]["low"] == rows[0]["high"]
        stored = sorted({places[r["fingerprint"]] for r in rows if same_block or not r["asked"]})
        asked = stored if same_block else sorted({places[r["fingerprint"]] for r in rows if r["asked"]})
        union, found = Union(len(names)), []
        for i in asked:
            if union.parts == 1 or not stored:
                break
            near = shares(values[stored], values[i][None])
            for j in np.flatnonzero(near >= least):
                if union.join(i, stored[j]):
                    found.append((names[i], names[stored[j]]))
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string())})

    links = staged(met.groupBy("band", "value", "low", "high").applyInArrow(link, "a string, b string").distinct(), "near")
    labels = components(links).withColumnRenamed("node", "fingerprint")
    named = prints.select("doc_id", "fingerprint").join(labels, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    lows = named.groupBy("component").agg(F.min("doc_id").alias("group_id"))
    return named.join(lows, named["component"].eqNullSafe(lows["component"])).select("doc_id", F.when(F.col("fingerprint").isNull(), F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id"))
