"""Shared session and file builders."""

from __future__ import annotations

import sys
import zipfile
from pathlib import Path
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("closebook-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("work")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _cell(ref: str, value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{ref}"><v>{value}</v></c>'
    if value.startswith("shared:"):
        return f'<c r="{ref}" t="s"><v>{value[7:]}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t>{escape(value)}</t></is></c>'


def _letter(index: int) -> str:
    return chr(ord("A") + index)


@pytest.fixture
def workbook():
    """Writes a minimal workbook: ``workbook(path, rows, shared=[...])``."""

    def write(path, rows, shared=()):
        main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        lines = []
        for number, row in enumerate(rows, start=1):
            if row is None:
                continue
            cells = "".join(_cell(f"{_letter(i)}{number}", v) for i, v in enumerate(row))
            lines.append(f'<row r="{number}">{cells}</row>')
        with zipfile.ZipFile(path, "w") as book:
            book.writestr(
                "xl/workbook.xml",
                f'<workbook {main} xmlns:r="{rel}"><sheets>'
                '<sheet name="TB" sheetId="1" r:id="rId7"/><sheet name="X" sheetId="2" r:id="rId1"/>'
                "</sheets></workbook>",
            )
            book.writestr(
                "xl/_rels/workbook.xml.rels",
                '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                '<Relationship Id="rId1" Type="t" Target="worksheets/sheet2.xml"/>'
                '<Relationship Id="rId7" Type="t" Target="worksheets/sheet1.xml"/></Relationships>',
            )
            book.writestr(
                "xl/worksheets/sheet1.xml",
                f"<worksheet {main}><sheetData>{''.join(lines)}</sheetData></worksheet>",
            )
            if shared:
                items = "".join(f"<si><r><t>{escape(s)}</t></r></si>" for s in shared)
                book.writestr("xl/sharedStrings.xml", f"<sst {main}>{items}</sst>")

    return write
