"""Delimited text in splits, record for record as Python's csv module reads it.

A record may go over several lines, as long as a quoted cell is open. Whether one is open where a
block of a file begins depends on all blocks before it, but at a line's end there are only
two states, so a run of lines is a function from state to state. Files are read once, in Spark's own splits, and cut
into chunks of whole lines, each with its function. Windows over these small
rows, file by file, give the state before each chunk; then every chunk is parsed alone, from its first
true record on. A record that crosses chunks leaves a piece in each, and the pieces are joined.
"""

from __future__ import annotations

import csv
import io
import re
import sys
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from closebook.operators.lookup import lookup_join
from closebook.session import few_listing_tasks, staged, with_settings
from closebook.sources.workbook import header_names
from closebook.workers import LONG_ROWS, lean, one_by_one

# Tasks get this module's functions with the job, so executors need not have the package.
register_pickle_by_value(sys.modules[__name__])

CHUNK_BYTES = 1 << 20
KEY = ["file_path", "block", "chunk"]
CHUNKS = "file_path string, block long, chunk long, text binary, after_out int, after_in int, closes boolean, filled boolean, valid boolean"
RECORDS = "file_path string, block long, row_no long, is_first boolean, cells array<string>"

#: Row numbers of a chunk: its number in the block above, the record's below; joined records come last.
_IN_CHUNK = 32
_JOINED = 1 << 31

# A line that begins outside quotes and ends inside: closed cells, then one that is not.
_OPENED = rb'(?:(?:[^",\r][^,\r]*+|"(?:[^"]++|"")*+"[^,\r]*+)?[,\r])*+"(?:[^"]++|"")*+\Z'
_FROM_OUT = re.compile(_OPENED)
# One that begins inside and ends inside: still the same cell, or a later one.
_FROM_IN = re.compile(rb'(?:[^"]++|"")*+(?:\Z|"[^,\r]*+[,\r]' + _OPENED + rb")")


def after_line(line: bytes, inside: int) -> int:
    """Whether a quoted cell is open after a line (1) or not (0)."""
    if b'"' not in line:
        return inside
    return int((_FROM_IN if inside else _FROM_OUT).match(line) is not None)


def after_lines(text: bytes) -> tuple[int, int, bool]:
    """States after the lines of a text that begin outside and inside quotes; whether the latter ever gets outside."""
    if b'"' not in text:
        return 0, 1, False
    out, in_, closes = 0, 1, False
    for line in text.split(b"\n"):
        if b'"' in line:
            if out == in_:
                out = in_ = after_line(line, out)
            else:
                out, in_ = after_line(line, out), after_line(line, in_)
            closes = closes or not in_
    return out, in_, closes


def pieces(text: bytes, inside: int) -> tuple[bytes | None, bytes, bytes | None]:
    """What closes the record of an earlier chunk, the whole records, and the one left open.

    A chunk that closes nothing is all head. None is for no such piece.
    """
    if b'"' not in text:
        return (text, b"", None) if inside else (None, text, None)
    lines, head, begin = text.split(b"\n"), None, 0
    if inside:
        state = 1
        for i, line in enumerate(lines):
            state = after_line(line, state)
            if not state:
                break
        if state:
            return text, b"", None
        head, begin = b"\n".join(lines[: i + 1]), i + 1
    state, open_at = 0, len(lines)
    for i in range(begin, len(lines)):
        following = after_line(lines[i], state)
        if following and not state:
            open_at = i
        state = following
    tail = b"\n".join(lines[open_at:]) if state else None
    return head, b"\n".join(lines[begin : open_at if state else len(lines)]), tail


def rows_of(text: bytes, latin: bool) -> list[list[str]]:
    """Records that are not blank, as Python's csv reads them."""
    csv.field_size_limit(sys.maxsize)
    return [r for r in csv.reader(io.StringIO(text.decode("latin-1" if latin else "utf-8") + "\n", newline="")) if r]


def _cut(limit: int):
    """Lines (file_path, block, value) to CHUNKS."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lines, size, chunk = None, [], 0, 0

        def packed() -> pa.RecordBatch:
            text = b"\n".join(lines)
            if key[1] == 0 and chunk == 0:
                text = text.removeprefix(b"\xef\xbb\xbf")
            out, in_, closes = after_lines(text)
            try:
                text.decode("utf-8")
                valid = True
            except UnicodeDecodeError:
                valid = False
            row = {"file_path": key[0], "block": key[1], "chunk": chunk, "text": text, "after_out": out, "after_in": in_, "closes": closes, "filled": bool(text.strip(b"\r\n")), "valid": valid}
            return pa.RecordBatch.from_pylist([row], _CHUNKS)

        for batch in batches:
            for at in zip(batch.column("file_path").to_pylist(), batch.column("block").to_pylist(), batch.column("value").to_pylist()):
                if at[:2] != key or size >= limit:
                    if lines:
                        yield packed()
                    chunk = chunk + 1 if at[:2] == key else 0
                    key, lines, size = at[:2], [], 0
                lines.append(at[2])
                size += len(at[2]) + 1
        if lines:
            yield packed()

    return run


_CHUNKS = pa.schema([
    ("file_path", pa.string()), ("block", pa.int64()), ("chunk", pa.int64()), ("text", pa.binary()), ("after_out", pa.int32()),
    ("after_in", pa.int32()), ("closes", pa.bool_()), ("filled", pa.bool_()), ("valid", pa.bool_()),
])


def _records(path: str, block: int, first_no: int, is_first: bool, rows: list[list[str]]) -> pa.RecordBatch:
    n = len(rows)
    flat = pa.array([c for row in rows for c in row], pa.string())
    flat = pc.if_else(pc.equal(flat, ""), pa.scalar(None, pa.string()), flat)
    bounds = [0]
    for row in rows:
        bounds.append(bounds[-1] + len(row))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([path] * n, pa.string()), pa.array([block] * n, pa.int64()), pa.array(range(first_no, first_no + n), pa.int64()),
            pa.array([is_first and i == 0 for i in range(n)], pa.bool_()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat),
        ],
        ["file_path", "block", "row_no", "is_first", "cells"],
    )


def _parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with their state to the records that lie in one chunk."""
    for row in one_by_one(batches):
        whole = pieces(row["text"], row["inside"])[1] if row["inside"] or row["ends"] else row["text"]
        rows = rows_of(whole, row["latin"])
        if rows:
            yield _records(row["file_path"], row["block"], row["chunk"] << _IN_CHUNK, row["first_here"], rows)


def _split_pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks that begin or end inside quotes to the pieces of records they share with others."""
    for row in one_by_one(batches):
        found = []
        head, whole, tail = pieces(row["text"], row["inside"])
        own = {"file_path": row["file_path"], "latin": row["latin"], "place": {"block": row["block"], "chunk": row["chunk"]}}
        if head is not None:
            found.append(own | {"opener": row["opener"], "is_first": False, "text": head})
        if tail is not None:
            found.append(own | {"opener": own["place"], "is_first": row["first_here"] and not rows_of(whole, row["latin"]), "text": tail})
        yield pa.RecordBatch.from_pylist(found, _PIECES)


_PLACE = pa.struct([("block", pa.int64()), ("chunk", pa.int64())])
_PIECES = pa.schema([("file_path", pa.string()), ("latin", pa.bool_()), ("opener", _PLACE), ("place", _PLACE), ("is_first", pa.bool_()), ("text", pa.binary())])
PIECES = "file_path string, latin boolean, opener struct<block:bigint,chunk:bigint>, place struct<block:bigint,chunk:bigint>, is_first boolean, text binary"


def _parse_joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in one_by_one(batches):
        rows = rows_of(b"\n".join(p["text"] for p in row["parts"]), row["latin"])
        if rows:
            yield _records(row["file_path"], row["opener"]["block"], (row["opener"]["chunk"] << _IN_CHUNK) + _JOINED, row["is_first"], rows)


def _name_headers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [header_names(cells) for cells in batch.column("cells").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("file_path"), pa.array(names, pa.list_(pa.string()))], ["file_path", "header"])


def chunks_of(spark: SparkSession, path: str, limit: int = CHUNK_BYTES) -> DataFrame:
    """The files' lines in chunks (CHUNKS), staged, so that all that follows sees one set of splits."""
    with few_listing_tasks(spark):
        text = spark.read.text(path, lineSep="\n")
    lines = text.select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value")
    )
    return staged(lines.mapInArrow(lean(_cut(limit)), CHUNKS), "chunks")


def states_of(chunks: DataFrame) -> DataFrame:
    """Per chunk: ``inside`` and ``ends``, the states before and after it, ``opener``, the chunk in which a record
    open at its begin was opened, ``first_here``, whether it has the file's first filled line, and ``latin``, whether
    some line of the file is no UTF-8.

    The state is that of the last chunk before whose end does not depend on its begin, turned by each
    chunk since that turns it. Windows go over one small row a chunk.
    """
    every = Window.partitionBy("file_path")
    so_far = every.orderBy("block", "chunk").rowsBetween(Window.unboundedPreceding, 0)
    before = every.orderBy("block", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    turns = F.coalesce(F.sum(F.expr("int(after_out = 1 AND after_in = 0)")).over(so_far), F.lit(0))
    fixed = F.expr("CASE WHEN after_out = after_in THEN struct(after_out, turns) END")
    found = chunks.drop("text").withColumn("turns", turns).withColumn("fixed", fixed)
    last = F.last("fixed", ignorenulls=True).over(before)
    since = F.coalesce(F.max("turns").over(before), F.lit(0)) - F.coalesce(last["turns"], F.lit(0))
    found = found.withColumn("inside", ((F.coalesce(last["after_out"], F.lit(0)) + since) % 2).cast("int"))
    found = found.withColumn("ends", F.expr("CASE WHEN inside = 1 THEN after_in ELSE after_out END"))
    opened = F.expr("CASE WHEN ends = 1 AND (inside = 0 OR closes) THEN struct(block, chunk) END")
    found = found.withColumn("opened", opened)
    return found.select(
        *KEY, "inside", "ends", F.last("opened", ignorenulls=True).over(before).alias("opener"),
        (F.col("filled") & ~F.coalesce(F.bool_or("filled").over(before), F.lit(False))).alias("first_here"),
        (~F.bool_and("valid").over(every)).alias("latin"),
    )


def read_records_of(spark: SparkSession, path: str, limit: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(headers, records) of the files at ``path``: (file_path, header), and RECORDS less each file's first.

    Records are ordered within a file by (block, row_no). Blank lines are no records, empty cells are
    NULL. A file with bytes that are no UTF-8 is read as Latin-1. A quoted cell that is never closed
    is an error, which names the files.
    """
    chunks = chunks_of(spark, path, limit)
    states = states_of(chunks)
    # Chunks that are not parsed as outside quotes, in UTF-8, with the header in a file's first chunk.
    usual = "inside = 0 AND ends = 0 AND NOT latin AND first_here = (block = 0 AND chunk = 0)"
    special = staged(states.filter(f"NOT ({usual})"), "chunk_states")
    unclosed = special.groupBy("file_path").agg(F.max_by("ends", F.struct("block", "chunk")).alias("ends"), F.max(F.struct("block", "chunk")).alias("at")).filter("ends = 1")
    last = chunks.groupBy("file_path").agg(F.max(F.struct("block", "chunk")).alias("at"))
    names = [r["file_path"] for r in unclosed.join(last, ["file_path", "at"]).select("file_path").orderBy("file_path").take(20)] if not special.isEmpty() else []
    if names:
        raise ValueError(f"a quoted cell is never closed in {names}")

    known = lookup_join(chunks.select(*KEY, "text"), special, KEY).select(
        *KEY, "text", F.coalesce("inside", F.lit(0)).alias("inside"), F.coalesce("latin", F.lit(False)).alias("latin"),
        F.coalesce("first_here", F.expr("block = 0 AND chunk = 0")).alias("first_here"),
        F.coalesce("ends", F.lit(0)).alias("ends"), "opener",
    )
    parts = [known.drop("opener").mapInArrow(lean(_parse), RECORDS)]
    firsts = [known.filter("first_here").drop("opener").mapInArrow(lean(_parse), RECORDS)]
    if not special.filter("ends = 1").isEmpty():
        shared = known.filter("inside = 1 OR ends = 1").mapInArrow(lean(_split_pieces), PIECES)
        joined = shared.groupBy("file_path", "opener").agg(
            F.array_sort(F.collect_list(F.struct("place", "text"))).alias("parts"), F.bool_or("is_first").alias("is_first"), F.bool_or("latin").alias("latin")
        )
        with with_settings(spark, LONG_ROWS):
            records = staged(joined.mapInArrow(lean(_parse_joined), RECORDS), "joined_records")
        parts.append(records)
        firsts.append(records)
    headers = reduce(DataFrame.unionByName, firsts).filter("is_first").select("file_path", "cells").mapInArrow(_name_headers, "file_path string, header array<string>")
    return headers, reduce(DataFrame.unionByName, parts).filter("NOT is_first").drop("is_first")
