"""Writers. All go through writes that Spark commits or aborts as a whole."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from closebook.operators.catalog import clean_steps, clean_toolsets
from closebook.operators.letters import clashing_paths
from closebook.operators.lookup import keep_last, lookup_join
from closebook.operators.support import Section, sortable_lines
from closebook.schemas import RUN_LOG
from closebook.session import staged
from closebook.sources.files import current_version, pointer_file, versions_folder
from closebook.sources.letter_files import write_files
from closebook.sources.paths import Files


@dataclass
class Written:
    """Rows of a written table, and a digest of them that their order and partitions do not change."""

    rows: int
    digest: str


class Digest:
    """Digest of a table, taken while it is written: its row hashes (MD5 of the row as JSON) added modulo
    2^128, with their count. Equal rows count as often as they occur.

    ``seen`` is the table to write, ``written`` the result, once it is.
    """

    def __init__(self, df: DataFrame):
        row = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}))
        halves = [F.sum(F.conv(F.substring(row, at, 16), 16, 10).cast("decimal(38,0)")).alias(name) for name, at in (("high", 1), ("low", 17))]
        self.observation = Observation()
        self.seen = df.observe(self.observation, F.count(F.lit(1)).alias("rows"), *halves)

    def written(self) -> Written:
        found = self.observation.get
        total = (int(found["high"] or 0) * 2**64 + int(found["low"] or 0)) % 2**128
        return Written(found["rows"], f"{found['rows']}:{total:032x}")


def digested(df: DataFrame, write: Callable[[DataFrame], None]) -> Written:
    """``write`` the table and take its digest on the way."""
    digest = Digest(df)
    write(digest.seen)
    return digest.written()


def write_table(
    df: DataFrame,
    path: str,
    columns: Sequence[str] | None = None,
    partition_by: Sequence[str] = (),
) -> Written:
    """Replace the table at ``path``; CSV if the path says so, else Parquet."""
    shown = df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df

    def write(seen: DataFrame) -> None:
        writer = seen.write.mode("overwrite").partitionBy(*partition_by)
        if path.endswith(".csv"):
            writer.csv(path, header=True)
        else:
            writer.parquet(path)

    return digested(shown, write)


def write_lines(lines: DataFrame, path: str, order_by: Sequence[str], column: str = "line") -> Written:
    """Replace the text at ``path``; its part files, read in name order, give the lines in order."""
    return digested(lines.orderBy(*order_by).select(column), lambda seen: seen.write.mode("overwrite").text(path))


def write_support(sections: Sequence[Section], path: str) -> Written:
    """Support text of all sections, a blank line after each; part files read in name order.

    The lines are sorted once, and each partition is written as it is.
    """
    lines, order = sortable_lines(sections)
    ends = lines.sparkSession.range(len(sections)).select(F.col("id").cast("int").alias("section"), F.lit("").alias("line"), F.lit(True).alias("_end"))
    both = lines.withColumn("_end", F.lit(False)).unionByName(ends, allowMissingColumns=True)
    return write_lines(both, path, ["section", "_end", *order[1:]])


def write_letters(
    letters: DataFrame, order_by: Sequence[str] = ("client_id",), as_files: bool = False, table: str | None = None
) -> Written | None:
    """Write the letters as a table, as one text file per letter at ``output_path``, or both.

    Of letters with one path the last by ``order_by`` is kept in the file, as a file can hold
    only one. The files need a file system that the executors share.
    """
    written = write_table(letters, table) if table else None
    if as_files:
        texts = letters.select("output_path", "letter_text", *order_by)
        if not clashing_paths(letters).isEmpty():
            texts = keep_last(texts, ["output_path"], order_by)
        write_files(texts.select("output_path", "letter_text"))
    return written


def write_manifest(manifest: DataFrame, exceptions: DataFrame, folder: str) -> dict[str, Written]:
    """Letters and exceptions as JSON lines in ``{folder}/letters`` and ``{folder}/exceptions``."""
    parts = {f"{folder}/letters": manifest, f"{folder}/exceptions": exceptions}
    return {path: digested(df, lambda seen, path=path: seen.write.mode("overwrite").json(path)) for path, df in parts.items()}


def append_run_log(
    spark: SparkSession,
    path: str,
    step: str,
    period: str,
    status: str,
    messages: Sequence[str] = (),
    metrics: dict | None = None,
    input_hashes: dict | None = None,
    output_hashes: dict | None = None,
    logged_at: datetime | None = None,
) -> None:
    """Add one row to the run log."""
    row = (
        step,
        period,
        status,
        [str(m) for m in messages],
        {k: str(v) for k, v in (metrics or {}).items()},
        dict(input_hashes or {}),
        dict(output_hashes or {}),
        logged_at or datetime.now(),
    )
    spark.createDataFrame([row], RUN_LOG).write.mode("append").parquet(path)


CATALOG_ORDER = ["part", "name_key", "rank", "tutorial_key"]


def _sortable(df: DataFrame, column: str) -> DataFrame:
    """Add ``{column}_key``, never NULL and different for NULL and an empty text."""
    return df.withColumn(f"{column}_key", F.coalesce(F.concat(F.lit(" "), column), F.lit("")))


def catalog_lines(steps: DataFrame, toolsets: DataFrame) -> DataFrame:
    """The catalogue document as lines (CATALOG_ORDER and line), to be sorted by CATALOG_ORDER.

    Steps are in name order and their toolsets in tutorial order, without gathering the
    toolsets of a step in one place: each line knows whether it is the first of its kind. A
    NULL name or tutorial sorts as an empty one, before a name that is empty.
    """
    steps = _sortable(clean_steps(steps), "name")
    toolsets = _sortable(_sortable(clean_toolsets(toolsets), "name"), "tutorial")
    first_name = steps.agg(F.min("name_key").alias("first_name"))
    firsts = toolsets.groupBy("name_key").agg(F.min("tutorial_key").alias("first_tutorial"))
    toolsets = lookup_join(toolsets, staged(firsts, "firsts"), ["name_key"])
    steps = steps.withColumn("is_first", F.col("name_key") == F.lit(first_name.first()[0] or ""))

    def json(column: str) -> str:
        return f"substr(to_json(array({column})), 2, length(to_json(array({column}))) - 2)"

    # Other fields follow the known ones, written as they were read.
    steps, toolsets = (df if "extra" in df.columns else df.withColumn("extra", F.lit(None).cast("string")) for df in (steps, toolsets))
    more = "coalesce(concat(', ', substr(extra, 2, length(extra) - 2)), '')"
    opened = steps.withColumn("comma", F.when(F.col("is_first"), "").otherwise(",")).selectExpr(
        "1 AS part",
        "name_key",
        "0 AS rank",
        "'' AS tutorial_key",
        rf"""concat('  ', comma, '{{\n    "id": ', {json('id')}, ',\n    "name": ', {json('name')},
             ',\n    "description": ', {json('description')}, {more}, ',\n    "toolsets": [') AS line""",
    )
    listed = toolsets.selectExpr(
        "1 AS part",
        "name_key",
        "1 AS rank",
        "tutorial_key",
        rf"""concat('      ', CASE WHEN tutorial_key = first_tutorial THEN '' ELSE ',' END, '{{"id": ',
             {json('id')}, ', "tutorial": ', {json('tutorial')}, ', "tools": ', coalesce(to_json(tools), '[]'), {more}, '}}') AS line""",
    )
    closed = steps.selectExpr("1 AS part", "name_key", "2 AS rank", "'' AS tutorial_key", r"'    ]\n  }' AS line")
    ends = steps.sparkSession.createDataFrame(
        [(0, "", 0, "", "["), (2, "", 0, "", "]")],
        "part int, name_key string, rank int, tutorial_key string, line string",
    )
    return ends.unionByName(opened).unionByName(listed).unionByName(closed)


def write_catalog(steps: DataFrame, toolsets: DataFrame, path: str, replaces: str | None = None) -> dict[str, Written]:
    """Write a new version of the catalogue at ``path`` and make it the current one.

    A version is a folder beside the document (``versions_folder``) with the two tables and the document. When
    all three are written, the pointer file is replaced by renaming, which is atomic: a write that is killed leaves
    the old version current, and the tables that are being read stay as they are, also those of the same
    path. The document at ``path`` is moved into place after that. It is for
    readers of JSON, in part files that make one document in name order; ``read_catalog`` takes the tables.
    ``replaces`` is the version that was read ('' for none); if another one is current by then, nothing is replaced.
    """
    files = Files(steps.sparkSession)
    version = f"v-{uuid.uuid4().hex}"
    folder = f"{versions_folder(path)}/{version}"
    written = {}
    for table, rows in (("steps", clean_steps(steps)), ("toolsets", clean_toolsets(toolsets))):
        written[f"{path}/{table}"] = write_table(rows, f"{folder}/{table}")
    written[path] = write_lines(catalog_lines(steps, toolsets), f"{folder}/document", CATALOG_ORDER)
    if replaces is not None and (current_version(steps.sparkSession, path) or "") != replaces:
        raise ValueError(f"the catalogue at {path} was replaced meanwhile; register again")
    files.replace(pointer_file(path), version)
    if files.exists(path):
        files.move(path, f"{folder}/replaced")
    files.move(f"{folder}/document", path)
    return written
