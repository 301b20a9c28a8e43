"""Support text: the rows of several tables as lines, sorted once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from closebook.functions.text import row_line
from closebook.session import staged

_IN_PARTITION = 33  # bits of a monotonic id below the partition number


@dataclass
class Section:
    """A table whose rows are lines, in the order of ``order_by``; all rows, or the first ``limit``."""

    df: DataFrame
    order_by: Sequence[str | Column]
    columns: Sequence[str] | None = None
    limit: int | None = None


def row_lines(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """The line of a row."""
    return row_line([F.col(f"`{c}`") for c in (columns or df.columns)]).alias("line")


def sortable_lines(sections: Sequence[Section], first: int = 0) -> tuple[DataFrame, list[str]]:
    """(section, keys, line) of all sections, not yet sorted, and the columns to sort by.

    Each section has key columns of its own, null in the others' rows, as their types may differ.
    """
    keyed = []
    for i, section in enumerate(sections):
        order = [F.col(c) if isinstance(c, str) else c for c in section.order_by]
        chosen = section.df if section.limit is None else section.df.orderBy(*order).limit(section.limit)
        keys = [c.alias(f"_key_{i}_{n}") for n, c in enumerate(order)]
        keyed.append(chosen.select(F.lit(first + i).alias("section"), *keys, row_lines(section.df, section.columns)))
    lines = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), keyed)
    return lines, ["section", *(c for c in lines.columns if c.startswith("_key_"))]


def support_lines(sections: Sequence[Section], first: int = 0) -> DataFrame:
    """(section, position, line) of all sections, numbered from ``first``.

    All rows are sorted by range in one exchange and staged; a row's position is its place in its partition and the
    rows of its section in the partitions before, so no task sees more than its share. The window
    runs over one row per partition and section.
    """
    rows, order = sortable_lines(sections, first)
    lines = staged(rows.orderBy(*order).select("section", "line", F.monotonically_increasing_id().alias("_id")), "lines")
    within = F.col("_id").bitwiseAND(F.lit(2**_IN_PARTITION - 1))
    lines = lines.withColumns({"_part": F.shiftright("_id", _IN_PARTITION), "_within": within})
    counts = lines.groupBy("section", "_part").agg(F.count("*").alias("_rows"), F.min("_within").alias("_first"))
    before = Window.partitionBy("section").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("section", "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_before"))
    placed = lines.join(F.broadcast(offsets), ["section", "_part"])
    return placed.select("section", (F.col("_before") + F.col("_within") + 1).alias("position"), "line")


def section_lines(
    df: DataFrame,
    order_by: Sequence[str | Column],
    columns: Sequence[str] | None = None,
    section: int = 0,
    limit: int | None = None,
) -> DataFrame:
    """(section, position, line) of one table's rows, of all or of the first ``limit``."""
    return support_lines([Section(df, order_by, columns, limit)], section)
