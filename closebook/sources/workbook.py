"""Rows of the first sheet of a workbook, decoded from its bytes inside a task.

A sheet holds at most 1,048,576 rows, so one workbook fits one task.
"""

from __future__ import annotations

import csv
import io
import re
import sys
import zipfile
from collections.abc import Iterator
from datetime import datetime, time, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value

from closebook.workers import one_by_one

# Tasks get this module's functions with the job, so executors need not have the package.
register_pickle_by_value(sys.modules[__name__])

BATCH_ROWS = 5_000
Row = list[str | None]


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _texts(node: ElementTree.Element) -> str:
    """All text runs of a string item, phonetic hints left out."""
    runs = []
    for child in node:
        if _local(child.tag) == "t":
            runs.append(child.text or "")
        elif _local(child.tag) == "r":
            runs.append(_texts(child))
    return "".join(runs)


def _column_index(ref: str) -> int:
    index = 0
    for letter in re.match("[A-Z]+", ref).group():
        index = index * 26 + ord(letter) - ord("A") + 1
    return index - 1


def _first_sheet(book: zipfile.ZipFile) -> str:
    workbook = ElementTree.fromstring(book.read("xl/workbook.xml"))
    sheet = next(e for e in workbook.iter() if _local(e.tag) == "sheet")
    rel_id = next(v for k, v in sheet.attrib.items() if _local(k) == "id")
    rels = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(r.attrib["Target"] for r in rels if r.attrib["Id"] == rel_id)
    return target.lstrip("/") if target.startswith("/") else "xl/" + target


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    strings = []
    with book.open("xl/sharedStrings.xml") as stream:
        for _, node in ElementTree.iterparse(stream):
            if _local(node.tag) == "si":
                strings.append(_texts(node))
                node.clear()
    return strings


# The built-in number formats of workbooks that show a date.
DATE_FORMATS = {14, 15, 16, 17, 22, *range(27, 37), *range(50, 59)}


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell styles that show their number as a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    styles = ElementTree.fromstring(book.read("xl/styles.xml"))
    dates = set(DATE_FORMATS)
    for node in styles.iter():
        if _local(node.tag) == "numFmt":
            code = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", node.attrib.get("formatCode", "")).lower()
            if re.search("[yd]|mmm", code):
                dates.add(int(node.attrib["numFmtId"]))
    formats = next((n for n in styles if _local(n.tag) == "cellXfs"), [])
    return {i for i, node in enumerate(formats) if int(node.attrib.get("numFmtId", 0)) in dates}


def _epoch(book: zipfile.ZipFile) -> datetime:
    """Day zero of the book's dates."""
    for node in ElementTree.fromstring(book.read("xl/workbook.xml")):
        if _local(node.tag) == "workbookPr" and node.attrib.get("date1904") in ("1", "true"):
            return datetime(1904, 1, 1)
    return datetime(1899, 12, 30)


def _date_text(number: str, epoch: datetime) -> str:
    """ISO text of a day number; the number itself where it is no date."""
    try:
        at = epoch + timedelta(seconds=round(float(number) * 86400))
    except (ValueError, OverflowError):
        return number
    return at.date().isoformat() if at.time() == time(0) else at.isoformat(" ")


def _cell_text(cell: ElementTree.Element, strings: list[str], dates: set[int], epoch: datetime) -> str | None:
    kind = cell.attrib.get("t", "n")
    for child in cell:
        name = _local(child.tag)
        if name == "is":
            return _texts(child) or None
        if name == "v" and child.text:
            if kind == "s":
                return strings[int(child.text)] or None
            if kind == "b":
                return "True" if child.text == "1" else "False"
            if kind == "n" and int(cell.attrib.get("s", 0)) in dates:
                return _date_text(child.text, epoch)
            return None if kind == "e" else child.text
    return None


def _workbook_rows(content: bytes) -> Iterator[Row]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        strings, dates, epoch = _shared_strings(book), _date_styles(book), _epoch(book)
        with book.open(_first_sheet(book)) as stream:
            blank = 0  # blank rows count only when a filled row follows
            last = 0
            for _, node in ElementTree.iterparse(stream):
                if _local(node.tag) != "row":
                    continue
                number = int(node.attrib.get("r", last + 1))
                cells: Row = []
                for position, cell in enumerate(node):
                    ref = cell.attrib.get("r")
                    at = _column_index(ref) if ref else position
                    cells.extend([None] * (at + 1 - len(cells)))
                    cells[at] = _cell_text(cell, strings, dates, epoch)
                node.clear()
                blank += number - last - 1
                last = number
                if not any(c is not None for c in cells):
                    blank += 1
                    continue
                yield from ([] for _ in range(blank))
                blank = 0
                yield cells


def _csv_rows(content: bytes) -> Iterator[Row]:
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = content.decode("latin-1")
    for row in csv.reader(io.StringIO(text, newline="")):
        if row:
            yield [cell if cell != "" else None for cell in row]


def table_rows(content: bytes) -> Iterator[Row]:
    """Rows of a workbook, or of delimited text under a workbook's name."""
    return _workbook_rows(content) if zipfile.is_zipfile(io.BytesIO(content)) else _csv_rows(content)


def header_names(cells: Row) -> list[str]:
    """Column names of a header row: blanks are numbered, repeats get a suffix."""
    names: list[str] = []
    for position, cell in enumerate(cells):
        name = base = cell if cell else f"Unnamed: {position}"
        repeat = 0
        while name in names:
            repeat += 1
            name = f"{base}.{repeat}"
        names.append(name)
    return names


HEADER_SCHEMA = "file_path string, header array<string>"
ROW_SCHEMA = "file_path string, row_no long, cells array<string>"


def decode_headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file_path, content) -> (file_path, header)."""
    for record in one_by_one(batches):
        header = header_names(next(table_rows(record["content"]), []))
        yield pa.RecordBatch.from_arrays(
            [pa.array([record["file_path"]], pa.string()), pa.array([header], pa.list_(pa.string()))],
            ["file_path", "header"],
        )


def decode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file_path, content) -> one (file_path, row_no, cells) per data row, in small batches."""
    names = ["file_path", "row_no", "cells"]

    def pack(path: str, start: int, rows: list[Row]) -> pa.RecordBatch:
        numbers = pa.array(range(start, start + len(rows)), pa.int64())
        cells = pa.array(rows, pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), numbers, cells], names)

    for record in one_by_one(batches):
        rows = table_rows(record["content"])
        next(rows, None)
        start, chunk = 0, []
        for row in rows:
            chunk.append(row)
            if len(chunk) == BATCH_ROWS:
                yield pack(record["file_path"], start, chunk)
                start, chunk = start + len(chunk), []
        if chunk:
            yield pack(record["file_path"], start, chunk)
