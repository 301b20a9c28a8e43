"""Delimited files in splits and chunks against Python's csv over the whole file."""

from __future__ import annotations

import csv
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from closebook.plans import close
from closebook.schemas import TB
from closebook.sources import delimited as D
from closebook.sources import files

PARTS = ['"', '""', ",", "\n", "\r\n", "a", "bc", " ", 'x"y', '"q\nr"', '"s,""t"" \r\n u"', "é", "12.5", "\r", ',"', '",', "\n\n"]


def plain(content: bytes) -> list[list[str]]:
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = content.decode("latin-1")
    return [r for r in csv.reader(io.StringIO(text, newline="")) if r]


def open_at_end(content: bytes) -> bool:
    state = 0
    for line in content.split(b"\n"):
        state = D.after_line(line, state)
    return bool(state)


def made(seed: int, n: int, closed: bool = True) -> bytes:
    rnd = random.Random(seed)
    while True:
        content = "".join(rnd.choice(PARTS) for _ in range(n)).encode()
        if open_at_end(content) != closed:
            return content


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=30), st.integers(1, 12))
def test_functions_of_chunks(parts, lines_each):
    """Chunks of any size, composed and parsed alone, give csv's records, and whether a cell stays open."""
    content = "".join(parts).encode()
    lines = content.split(b"\n")
    chunks = [b"\n".join(lines[i : i + lines_each]) for i in range(0, len(lines), lines_each)]
    state, rows, open_ = 0, [], []
    for chunk in chunks:
        out, in_, closes = D.after_lines(chunk)
        head, whole, tail = D.pieces(chunk, state)
        if head is not None:
            open_.append(head)
            if tail is not None or closes:
                rows += D.rows_of(b"\n".join(open_), False)
                open_ = []
        rows += D.rows_of(whole, False)
        if tail is not None:
            open_ = [tail]
        state = in_ if state else out
        assert (state == 1) == bool(open_)
    if not state:
        assert rows == plain(content)


@pytest.mark.parametrize(("split", "limit"), [("300", 60), ("16k", 1 << 20)])
def test_files(spark, tmp_path, split, limit):
    contents = {f"f{i:02}.csv": made(i, 30 + 40 * i) for i in range(8)}
    contents |= {
        "bom.csv": b'\xef\xbb\xbf"h\n1",b\n1,2\n', "latin.csv": "h,é\n".encode("latin-1") * 9, "blank.csv": b"\n\r\n\n\nh,b\n1,\"\"\n", "none.csv": b"", "lines.csv": b"\n\n",
        "header.csv": b'"a long\n' + b"header\n" * 30 + b'",b\n1,2\n', "stray.csv": b'a,5" pipe,b\n"x"y"z,1\n' * 20, "long.csv": b'h\n"' + b"word, \"\"word\"\"\r\n" * 100 + b'"\n1\n',
    }
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        headers, records = D.read_records_of(spark, str(tmp_path / "*.csv"), limit)
        got: dict = {}
        blocks = set()
        for r in records.orderBy("file_path", "block", "row_no").collect():
            name = r["file_path"].rsplit("/", 1)[1]
            got.setdefault(name, []).append(r["cells"])
            blocks.add((name, r["block"]))
        names = {r["file_path"].rsplit("/", 1)[1]: r["header"] for r in headers.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, content in contents.items():
        want = [[c or None for c in row] for row in plain(content)]
        assert got.get(name, []) == want[1:], name
        assert names.get(name) == (D.header_names(want[0]) if want else None), name
    if split == "300":
        assert len(blocks) > len(contents)


def test_cell_that_is_never_closed(spark, tmp_path):
    (tmp_path / "good.csv").write_text("a,b\n1,2\n")
    (tmp_path / "bad.csv").write_text('a,b\n1,"2\n3,4\n')
    with pytest.raises(ValueError, match="never closed.*bad.csv"):
        D.read_records_of(spark, str(tmp_path / "*.csv"))


def test_table_of_records_over_several_lines(spark, tmp_path):
    (tmp_path / "t.csv").write_text('Code,Text\nA,"one\ntwo"\nB,\n')
    got = files.read_table(spark, str(tmp_path / "t.csv")).orderBy(*files.ORDER)
    assert [(r["Code"], r["Text"]) for r in got.collect()] == [("A", "one\ntwo"), ("B", None)]
    with pytest.raises(FileNotFoundError):
        files.read_table(spark, str(tmp_path / "none.csv"))


def test_workers_get_few_chunks_at_once(spark, tmp_path, monkeypatch):
    for i in range(120):
        (tmp_path / f"TB_N{i}_202501.csv").write_text(f"Entity,AccountCode,Dr,Cr\nN{i},a,5,0\nN{i},b,0,5\n")
    parse = D._parse

    def checked(batches):
        def few():
            for batch in batches:
                if batch.num_rows > 16:
                    raise ValueError(f"{batch.num_rows} chunks in one batch")
                yield batch

        return parse(few())

    monkeypatch.setattr(D, "_parse", checked)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    done = close.collect_tb(spark, str(tmp_path), "202501", TB.names, str(tmp_path / "out" / "master"))
    assert done.ok and done.metrics["rows"] == 240 and spark.conf.get(name) == before
