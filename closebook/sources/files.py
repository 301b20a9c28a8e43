"""Readers. All cells are read as text; typing happens in the operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from closebook.operators import fx
from closebook.operators.catalog import other_fields
from closebook.session import few_listing_tasks, staged, with_settings
from closebook.sources import delimited as D
from closebook.sources import workbook as W
from closebook.workers import LONG_ROWS

PRIOR_NAME = r"^(.*)_EngagementLetter_FY([0-9]+)\.docx$"


@dataclass
class RawTables:
    """Files whose headers may all differ.

    headers(file_path, file_name, header) has one row per file; rows(file_path, file_name,
    block, row_no, cells) one per data row, ordered within a file by (block, row_no).
    """

    headers: DataFrame
    rows: DataFrame


def expand(template: str, **values: str) -> str:
    """Path template with ``{name}`` fields filled in."""
    return template.format(**values)


def _named(df: DataFrame) -> DataFrame:
    """Add the file name; paths in file metadata are URL-encoded."""
    name = F.url_decode(F.replace(F.element_at(F.split("file_path", "/"), -1), F.lit("+"), F.lit("%2B")))
    return df.withColumn("file_name", name)


def _binary_files(spark: SparkSession, path: str) -> DataFrame | None:
    """Files at ``path`` (a glob may match none) with their metadata path."""
    try:
        with few_listing_tasks(spark):
            files = spark.read.format("binaryFile").load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return files.select(F.col("_metadata.file_path").alias("file_path"), "path", "content")


def read_workbooks(spark: SparkSession, path: str) -> RawTables | None:
    """Workbooks, or delimited text under a workbook's name. One task decodes one file."""
    files = _binary_files(spark, path)
    if files is None:
        return None
    files = files.select("file_path", "content")
    headers = files.mapInArrow(W.decode_headers, W.HEADER_SCHEMA)
    rows = files.mapInArrow(W.decode_rows, W.ROW_SCHEMA).withColumn("block", F.lit(0).cast("long"))
    return RawTables(_named(headers), _named(rows))


def read_delimited(spark: SparkSession, path: str) -> RawTables | None:
    """CSV files with headers of their own, in splits, records of several lines too (see ``delimited``).

    Headers are the first record of each file; rows are as wide as the widest header.
    """
    files = _binary_files(spark, path)
    if files is None:
        return None
    found, rows = D.read_records_of(spark, path)
    # A file without a record has an empty header.
    found = files.select("file_path").join(found, "file_path", "left")
    with with_settings(spark, LONG_ROWS):
        headers = staged(found.withColumn("header", F.coalesce("header", F.array().cast("array<string>"))), "found_headers")
    width = headers.agg(F.max(F.size("header"))).first()[0] or 1
    blank = F.array_repeat(F.lit(None).cast("string"), width)
    cells = F.slice(F.concat("cells", blank), 1, width).alias("cells")
    return RawTables(_named(headers), _named(rows.select("file_path", "block", "row_no", cells)))


def read_tb_files(spark: SparkSession, folder: str, period: str) -> RawTables | None:
    """All ``TB_*_{period}`` files of a folder, workbooks and CSV; None if there are none."""
    stem = f"{folder.rstrip('/')}/TB_*_{period}"
    parts = [read_workbooks(spark, stem + ".xlsx"), read_delimited(spark, stem + ".csv")]
    parts = [p for p in parts if p is not None]
    if not parts:
        return None
    return RawTables(
        reduce(DataFrame.unionByName, [p.headers for p in parts]),
        reduce(DataFrame.unionByName, [p.rows for p in parts]),
    )


ORDER = ["_file", "_block", "_row"]


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """One table with one header, by suffix: ``.xlsx``, ``.csv``, else Parquet.

    Columns ``_file``, ``_block`` and ``_row`` (ORDER) give the order of the rows.
    """
    if path.endswith((".xlsx", ".csv")):
        raw = (read_workbooks if path.endswith(".xlsx") else read_delimited)(spark, path)
        if raw is None:
            raise FileNotFoundError(path)
        header = raw.headers.agg(F.min_by("header", "file_path")).first()[0]
        cells = [F.get("cells", F.lit(i)).alias(name) for i, name in enumerate(header)]
        order = [F.col("file_path").alias("_file"), F.col("block").alias("_block"), F.col("row_no").alias("_row")]
        return raw.rows.select(*cells, *order)
    return spark.read.parquet(path).select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.lit(0).cast("long").alias("_block"),
        F.col("_metadata.row_index").alias("_row"),
    )


def read_rates(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rates, rejected) of a rates table or of ``.json`` payloads; ``rejected`` as in ``fx``."""
    if not path.endswith(".json"):
        rates = read_table(spark, path)
        return rates, fx.too_large_rates(rates, ORDER)
    found = spark.read.text(path, wholetext=True).select(F.col("value").alias("payload"), F.col("_metadata.file_path").alias("origin"))
    rates, rejected = fx.rates_of_payloads(found)
    # Of a code's spellings in one payload the last by name counts.
    placed = rates.select("CurrencyCode", "FXRate", F.col("origin").alias("_file"), F.lit(0).cast("long").alias("_block"), F.col("CurrencyCode").alias("_row"))
    return placed, rejected


def json_records(document: Column, wrapper: str, single: bool) -> Column:
    """Records of a JSON document: a list, an object that wraps one, or, if ``single``, an object."""
    listed = F.try_variant_get(document, "$", "array<variant>")
    wrapped = F.try_variant_get(document, f"$.{wrapper}", "array<variant>")
    error = F.raise_error(F.lit(f"JSON must be a list or contain '{wrapper}'"))
    return F.coalesce(listed, wrapped, F.array(document) if single else error.cast("array<variant>"))


def read_records(spark: SparkSession, path: str, wrapper: str, single: bool = False) -> DataFrame:
    """Records (``record`` VARIANT and the ORDER columns) of a roster or catalogue file.

    ``.json`` is one document, ``.jsonl`` one record per line (for large rosters); ``.csv``,
    ``.xlsx`` and Parquet tables give one record per row. ``single`` also takes a document
    that is one record.
    """
    if path.endswith((".json", ".jsonl")):
        whole = path.endswith(".json")
        lines = spark.read.text(path, wholetext=whole).select(
            F.parse_json("value").alias("doc"),
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_line"),
        )
        if not whole:
            return lines.select(F.col("doc").alias("record"), "_file", "_block", F.col("_line").alias("_row"))
        items = F.posexplode(json_records(F.col("doc"), wrapper, single)).alias("_pos", "record")
        return lines.select("_file", "_block", items).select(
            "record", "_file", "_block", F.col("_pos").cast("long").alias("_row")
        )
    table = read_table(spark, path)
    return table.select(record_of(table, ORDER).alias("record"), *ORDER)


def record_of(df: DataFrame, without: list[str] | None = None) -> Column:
    """All columns of a row as one VARIANT record."""
    names = [c for c in df.columns if c not in (without or [])]
    return F.to_variant_object(F.struct(*[F.col(f"`{c}`") for c in names]))


def read_template(spark: SparkSession, path: str) -> str:
    """Text of one template file, as UTF-8 or else Latin-1."""
    content = F.col("content")
    text = F.when(
        F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")
    ).otherwise(F.decode(content, "ISO-8859-1"))
    return spark.read.format("binaryFile").load(path).select(text).first()[0]


def read_prior_letters(spark: SparkSession, folder: str) -> DataFrame | None:
    """(slug, fiscal_year, text) of a folder of prior letters; malformed bytes are dropped."""
    files = _binary_files(spark, f"{folder.rstrip('/')}/*_EngagementLetter_FY*.docx")
    if files is None:
        return None
    clean = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"))
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(valid, F.decode("content", "UTF-8")).otherwise(clean)
    return prior_letter_keys(_named(files.select("file_path", text.alias("text"))))


def prior_letter_keys(files: DataFrame) -> DataFrame:
    """(slug, fiscal_year, text) of prior letters given as (file_name, text)."""
    return files.filter(F.col("file_name").rlike(PRIOR_NAME)).select(
        F.regexp_extract("file_name", PRIOR_NAME, 1).alias("slug"),
        F.regexp_extract("file_name", PRIOR_NAME, 2).alias("fiscal_year"),
        "text",
    )


def versions_folder(path: str) -> str:
    """Folder of the versions that belong to a catalogue document."""
    return path.rstrip("/") + ".tables"


def pointer_file(path: str) -> str:
    """File that names the current version."""
    return f"{versions_folder(path)}/CURRENT.txt"


def current_version(spark: SparkSession, path: str) -> str | None:
    """The current version of a catalogue; None if it has none."""
    lines = _if_found(lambda: spark.read.text(pointer_file(path)))
    found = None if lines is None else lines.first()
    return found[0] if found else None


def _if_found(read: Callable[[], DataFrame]) -> DataFrame | None:
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Steps and toolsets of a catalogue.

    A catalogue written by ``write_catalog`` is read from the tables of its current version, however large it is. A
    document from elsewhere is one file; a missing or malformed one is empty.
    """
    version = current_version(spark, path)
    if version:
        folder = f"{versions_folder(path)}/{version}"
        return spark.read.parquet(f"{folder}/steps"), spark.read.parquet(f"{folder}/toolsets")
    text = _if_found(lambda: spark.read.text(path, wholetext=True))
    if text is None:
        text = spark.createDataFrame([], "value string")
    elif len(text.select(F.col("_metadata.file_path")).take(2)) > 1:
        raise ValueError(f"{path} holds several files but no tables of a catalogue")
    entries = text.select(
        F.explode(F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>")).alias("entry")
    ).filter("schema_of_variant(entry) LIKE 'OBJECT%'")
    steps = entries.select(
        F.expr("try_variant_get(entry, '$.id', 'string') AS id"),
        F.expr("try_variant_get(entry, '$.name', 'string') AS name"),
        F.expr("try_variant_get(entry, '$.description', 'string') AS description"),
        other_fields("entry", ["id", "name", "description", "toolsets"]).alias("extra"),
    )
    toolsets = entries.selectExpr(
        "try_variant_get(entry, '$.name', 'string') AS name",
        "explode(try_variant_get(entry, '$.toolsets', 'array<variant>')) AS toolset",
    ).select(
        F.expr("try_variant_get(toolset, '$.id', 'string') AS id"),
        "name",
        F.expr("try_variant_get(toolset, '$.tutorial', 'string') AS tutorial"),
        F.expr("try_variant_get(toolset, '$.tools', 'array<string>') AS tools"),
        other_fields("toolset", ["id", "tutorial", "tools"]).alias("extra"),
    )
    return steps, toolsets


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, md5, sha256) of each file; no rows if there is none."""
    files = _binary_files(spark, path)
    if files is None:
        return spark.createDataFrame([], "file_path string, md5 string, sha256 string")
    return files.select(
        "file_path", F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256")
    )
