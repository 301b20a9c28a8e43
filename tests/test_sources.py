"""Readers and writers on real files."""

from __future__ import annotations

import hashlib
import json
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from closebook.operators import columns, fx
from closebook.plans.queries import QUERIES
from closebook.sources import files, sinks
from closebook.sources import workbook as W
from closebook.sources.letter_files import move_all, read_files
from closebook.sources.workbook import header_names


def cells(raw):
    rows = raw.rows.orderBy("file_name", "block", "row_no").collect()
    return [(r["file_name"], r["cells"]) for r in rows]


def test_workbook(spark, tmp_path, workbook):
    path = tmp_path / "TB_US_202501.xlsx"
    workbook(
        path,
        [
            ["EntityCode", "shared:0", None, "Debit"],
            ["US", 10, "x", 1.5],
            None,
            [None, "shared:1", True],
            [None, None],
        ],
        shared=["Account", "a & b"],
    )
    raw = files.read_workbooks(spark, str(tmp_path / "*.xlsx"))
    assert raw.headers.first()["header"] == ["EntityCode", "Account", "Unnamed: 2", "Debit"]
    assert [c for _, c in cells(raw)] == [["US", "10", "x", "1.5"], [], [None, "a & b", "True"]]


def test_delimited_text_under_a_workbook_name(spark, tmp_path):
    (tmp_path / "a.xlsx").write_text('A,"B, b"\n1,\n\n"x\ny",2\n')
    raw = files.read_workbooks(spark, str(tmp_path / "a.xlsx"))
    assert raw.headers.first()["header"] == ["A", "B, b"]
    assert [c for _, c in cells(raw)] == [["1", None], ["x\ny", "2"]]


def test_csv_files_with_different_headers(spark, tmp_path):
    (tmp_path / "TB_A_202501.csv").write_text("Entity,Dr,Cr\nE1,5,0\n")
    (tmp_path / "TB_B C_202501.csv").write_text('Company,"Amount"\nE2,7\n"E,3",-7\n')
    (tmp_path / "TB_D_202502.csv").write_text("Entity\nno\n")
    (tmp_path / "Master_TB_202501.csv").write_text("Entity\nno\n")
    raw = files.read_tb_files(spark, str(tmp_path), "202501")
    headers = {r["file_name"]: r["header"] for r in raw.headers.collect()}
    assert headers == {
        "TB_A_202501.csv": ["Entity", "Dr", "Cr"],
        "TB_B C_202501.csv": ["Company", "Amount"],
    }
    assert cells(raw) == [
        ("TB_A_202501.csv", ["E1", "5", "0"]),
        ("TB_B C_202501.csv", ["E2", "7", None]),
        ("TB_B C_202501.csv", ["E,3", "-7", None]),
    ]
    joined = raw.rows.join(raw.headers.select("file_path", "header"), "file_path")
    assert joined.count() == 3


def test_split_csv_keeps_all_rows(spark, tmp_path):
    lines = "".join(f"{i},{i * 2}\n" for i in range(5000))
    (tmp_path / "TB_A_202501.csv").write_text("Dr,Cr\n" + lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        raw = files.read_delimited(spark, str(tmp_path / "*.csv"))
        assert raw.rows.select("block").distinct().count() > 1
        assert [c for _, c in cells(raw)] == [[str(i), str(i * 2)] for i in range(5000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_no_files(spark, tmp_path):
    assert files.read_tb_files(spark, str(tmp_path), "202501") is None


def test_header_names():
    assert header_names(["A", None, "A", "A"]) == ["A", "Unnamed: 1", "A.1", "A.2"]


@pytest.mark.parametrize("suffix", ["xlsx", "csv"])
def test_rates_file(spark, tmp_path, workbook, suffix):
    path = tmp_path / f"fx.{suffix}"
    if suffix == "xlsx":
        workbook(path, [["ISO Currency", "FX", "Period", "Source"], ["eur", 1.1, "202501", "m"], ["EUR", 1.2, "202501", "m"]])
    else:
        path.write_text("ISO Currency,FX,Period,Source\neur,1.1,202501,m\nEUR,1.2,202501,m\n")
    rates = fx.clean_rates(files.read_table(spark, str(path)), files.ORDER)
    assert {r["CurrencyCode"]: float(r["FXRate"]) for r in rates.collect()} == {"EUR": 1.2}


DOCS = [{"ClientID": "1", "n": [1]}, {"ClientID": "2"}]


@pytest.mark.parametrize(
    "name, text, count",
    [
        ("a.json", json.dumps(DOCS), 2),
        ("b.json", json.dumps({"clients": DOCS}, indent=2), 2),
        ("c.json", json.dumps(DOCS[0]), 1),
        ("d.jsonl", "\n".join(map(json.dumps, DOCS)), 2),
        ("e.csv", "ClientID,x\n1,\n2,y\n", 2),
    ],
)
def test_record_files(spark, tmp_path, name, text, count):
    (tmp_path / name).write_text(text)
    got = files.read_records(spark, str(tmp_path / name), "clients", single=True).orderBy(*files.ORDER)
    ids = [r[0] for r in got.select(F.expr("try_variant_get(record, '$.ClientID', 'string')")).collect()]
    assert ids == ["1", "2"][:count]


def test_template_encodings(spark, tmp_path):
    (tmp_path / "u.dotx").write_bytes("Grüße {{ClientName}}".encode())
    (tmp_path / "l.dotx").write_bytes("Grüße".encode("latin-1"))
    assert files.read_template(spark, str(tmp_path / "u.dotx")) == "Grüße {{ClientName}}"
    assert files.read_template(spark, str(tmp_path / "l.dotx")) == "Grüße"


def test_prior_letters(spark, tmp_path):
    (tmp_path / "Acme_Co_EngagementLetter_FY2024.docx").write_bytes(b"Dear \xff Acme\n2")
    (tmp_path / "other.docx").write_text("x")
    got = files.read_prior_letters(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("Acme_Co", "2024", "Dear  Acme\n2")]
    assert files.read_prior_letters(spark, str(tmp_path / "none")) is None


def test_hashes(spark, tmp_path):
    (tmp_path / "sample.txt").write_bytes(b"hello world")
    row = files.file_hashes(spark, str(tmp_path / "sample.txt")).first()
    assert row["sha256"] == hashlib.sha256(b"hello world").hexdigest()
    assert row["md5"] == hashlib.md5(b"hello world").hexdigest()
    assert files.file_hashes(spark, str(tmp_path / "none")).isEmpty()


def test_expand():
    assert files.expand("{root}/data/{name}.txt", root="base", name="file") == "base/data/file.txt"


def test_write_table_orders_columns_and_replaces(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 3)], ["a", "b", "c"])
    out = str(tmp_path / "sub" / "t")
    sinks.write_table(df, out)
    sinks.write_table(df, out, ["c", "a"])
    assert spark.read.parquet(out).columns == ["c", "a"]
    sinks.write_table(df, out + ".csv", ["b"])
    assert spark.read.csv(out + ".csv", header=True).collect() == [("2",)]


def test_run_log_grows(spark, tmp_path):
    log = str(tmp_path / "logs" / "run_log")
    sinks.append_run_log(spark, log, "a", "202501", "ok", ["done"], {"rows": 4})
    sinks.append_run_log(spark, log, "b", "202501", "error")
    got = spark.read.parquet(log).orderBy("step").collect()
    assert [(r["step"], r["status"], r["messages"], r["metrics"]) for r in got] == [
        ("a", "ok", ["done"], {"rows": "4"}),
        ("b", "error", [], {}),
    ]


def test_letter_files_keep_the_last(spark, tmp_path):
    path = str(tmp_path / "deep" / "x.docx")
    rows = [("C-1", path, "one"), ("C-3", path, "thrée\n"), ("C-2", path, "two")]
    df = spark.createDataFrame(rows, "client_id string, output_path string, letter_text string")
    sinks.write_letters(df, as_files=True, table=str(tmp_path / "t"))
    assert (tmp_path / "deep" / "x.docx").read_text(encoding="utf-8") == "thrée\n"
    assert [p.name for p in (tmp_path / "deep").iterdir()] == ["x.docx"]
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_failed_letters_leave_nothing(spark, tmp_path):
    df = spark.range(40).selectExpr(
        f"concat('{tmp_path}/out/', id, '.docx') AS output_path", "CAST(id AS STRING) AS client_id",
        "CASE WHEN id = 37 THEN raise_error('no text') ELSE 'text' END AS letter_text",
    ).repartition(4)
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "3.docx").write_text("old")
    with pytest.raises(Exception, match="no text"):
        sinks.write_letters(df, as_files=True)
    assert [(p.name, p.read_text()) for p in (tmp_path / "out").iterdir()] == [("3.docx", "old")]
    sinks.write_letters(df.filter("client_id <> '37'"), as_files=True)
    assert len(list((tmp_path / "out").iterdir())) == 39 and (tmp_path / "out" / "3.docx").read_text() == "text"


def test_files_are_read_by_the_paths_of_rows(spark, tmp_path):
    (tmp_path / "a+b.docx").write_text("é" * 700_000)
    (tmp_path / "_c.docx").write_text("")
    rows = [("a+b.docx", 1), ("none.docx", 2), ("_c.docx", 3), ("a+b.docx", 4), (None, 5)]
    df = spark.createDataFrame([(n and f"{tmp_path}/{n}", i) for n, i in rows], "output_path string, id int").coalesce(1)
    got = read_files(df)
    assert got.columns == ["output_path", "id", "content"]
    assert {r["id"]: (r["output_path"], len(r["content"].decode())) for r in got.collect()} == {
        1: (f"{tmp_path}/a+b.docx", 700_000), 3: (f"{tmp_path}/_c.docx", 0), 4: (f"{tmp_path}/a+b.docx", 700_000),
    }


def test_letters_are_read_back_without_a_listing(spark, tmp_path):
    """A listing of the letters goes through the driver, and a scan of them has a task for every 32."""
    spark.range(40).selectExpr("id AS c_custkey", "concat('Customer#', lpad(id, 9, '0')) AS c_name", "cast(id % 25 AS int) AS c_nationkey", "cast(50 * id AS double) AS c_acctbal", "'BUILDING' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(60).selectExpr("id AS p_partkey", "'p' AS p_name", "concat('Brand#', id % 30) AS p_brand", "'STANDARD' AS p_type", "1 AS p_size", "cast(id AS double) AS p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(10).selectExpr("id AS doc_id", "'For {{ClientName}}' AS text", "'en' AS lang", "'src5' AS source", "1L AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["letter_files"](spark, str(tmp_path))
    rows = got.collect()
    assert len(rows) == 40 and all(r["client_name"] in r["letter_text"] and r["output_path"].startswith("/close/letters/") for r in rows)
    assert "binaryFile" not in got._jdf.queryExecution().executedPlan().toString()


def test_mixed_headers_resolve_per_file(spark):
    headers = spark.createDataFrame([("f", ["Entity", "Dr"])], "file_name string, header array<string>")
    assert columns.resolve_headers(headers, ["EntityCode"]).first()["resolved"] == {"EntityCode": "Entity"}


def test_records_of_several_lines_and_other_encodings(spark, tmp_path):
    (tmp_path / "TB_A_202501.csv").write_text('Entity,AccountDesc,Dr,Cr\nA,"Rent\nHQ ""x""",5,0\nA,b,0,5\n')
    (tmp_path / "TB_B_202501.csv").write_bytes("Entity,Café,Dr\nB,Crème,1\n".encode("latin-1"))
    (tmp_path / "TB_C_202501.csv").write_text("Entity,Dr\nC,é\n", encoding="utf-8")
    raw = files.read_tb_files(spark, str(tmp_path), "202501")
    rows = sorted((r["file_name"][3], [c for c in r["cells"] if c]) for r in raw.rows.collect())
    assert rows == [
        ("A", ["A", 'Rent\nHQ "x"', "5", "0"]),
        ("A", ["A", "b", "0", "5"]),
        ("B", ["B", "Crème", "1"]),
        ("C", ["C", "é"]),
    ]
    assert {r["file_name"][3]: r["header"][1] for r in raw.headers.collect()}["B"] == "Café"


@pytest.mark.parametrize("date1904, shift", [("", 0), ('<workbookPr date1904="1"/>', 1462)])
def test_date_cells(tmp_path, date1904, shift):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cells = [(1, 45658 - shift), (2, 45658.5 - shift), (0, 45658), (3, 7)]
    row = "".join(f'<c r="{"ABCD"[i]}1" s="{s}"><v>{v}</v></c>' for i, (s, v) in enumerate(cells))
    with zipfile.ZipFile(tmp_path / "d.xlsx", "w") as book:
        book.writestr(
            "xl/workbook.xml",
            f'<workbook {main} xmlns:r="{rel}">{date1904}<sheets><sheet name="T" sheetId="1" r:id="r1"/></sheets></workbook>',
        )
        book.writestr("xl/_rels/workbook.xml.rels", '<R><S Id="r1" Target="worksheets/s.xml"/></R>')
        book.writestr("xl/worksheets/s.xml", f'<worksheet {main}><sheetData><row r="1">{row}</row></sheetData></worksheet>')
        book.writestr(
            "xl/styles.xml",
            f'<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd hh:mm"/>'
            '<numFmt numFmtId="171" formatCode="0 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/>'
            '<xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>',
        )
    assert list(W.table_rows((tmp_path / "d.xlsx").read_bytes())) == [["2025-01-01", "2025-01-01 12:00:00", "45658", "7"]]


def _tasks_of(spark, run) -> list[int]:
    """Numbers of tasks of the stages that ``run`` starts."""
    group = f"test-{id(run)}"
    spark.sparkContext.setJobGroup(group, "")
    run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    seen = spark.sparkContext.statusTracker()
    stages = [s for j in seen.getJobIdsForGroup(group) for s in seen.getJobInfo(j).stageIds]
    return [seen.getStageInfo(s).numTasks for s in stages if seen.getStageInfo(s)]


def test_listing_takes_few_tasks(spark, tmp_path):
    for i in range(100):
        (tmp_path / f"A{i}_EngagementLetter_FY2024.docx").write_text(f"letter {i}")
    found = []
    tasks = _tasks_of(spark, lambda: found.append(files.read_prior_letters(spark, str(tmp_path))))
    assert tasks and max(tasks) <= 4 * spark.sparkContext.defaultParallelism
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == "10000"
    assert {(r["slug"], r["text"]) for r in found[0].collect()} == {(f"A{i}", f"letter {i}") for i in range(100)}


def test_moves_of_a_task_can_be_repeated(tmp_path):
    staging, out = tmp_path / ".staging", tmp_path / "out"
    (staging / "t").mkdir(parents=True)
    moves = [[f"{staging}/t/{i}", f"{out}/é{i}.docx"] for i in range(3000)]
    for aside, _ in moves:
        Path(aside).write_text("text")
    (staging / "t" / "moves").write_text("".join(json.dumps(m) + "\n" for m in moves))
    move_all(str(staging), "t")
    move_all(str(staging), "t")
    assert len(list(out.iterdir())) == 3000 and (out / "é7.docx").read_text() == "text"
    (out / "é7.docx").unlink()
    with pytest.raises(FileNotFoundError):
        move_all(str(staging), "t")
