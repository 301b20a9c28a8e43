"""Number tables of fixed size, added up over all tasks, and input columns kept apart from helper columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN_IN = 64
PARTS = 8


def summed_tables(rows: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], size: int) -> np.ndarray:
    """The sum of the tables of ``size`` integers that ``count`` makes of each task's batches.

    Tables are added in rounds of FAN_IN, in PARTS slices, so no task reads more than so many;
    the driver gets one table, whose size is fixed.
    """
    schema = "slice int, total binary"

    def row(i: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total.astype("<i8").tobytes()], pa.binary())], ["slice", "total"])

    def first(batches):
        for table in count(batches):
            if table.any():
                for i, piece in enumerate(np.split(table, PARTS)):
                    yield row(i, piece)

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, piece in zip(batch.column("slice").to_pylist(), batch.column("total").to_pylist()):
                totals[i] = totals.get(i, 0) + np.frombuffer(piece, "<i8")
        for i, total in totals.items():
            yield row(i, total)

    tasks = rows.rdd.getNumPartitions()
    tables = rows.mapInArrow(first, schema)
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        tables = tables.withColumn("turn", F.pmod(F.spark_partition_id(), F.lit(tasks))).repartition(tasks * PARTS, "turn", "slice").drop("turn").mapInArrow(add, schema)
    total = np.zeros((PARTS, size // PARTS), np.int64)
    for found in tables.repartition(PARTS, "slice").mapInArrow(add, schema).collect():
        total[found["slice"]] += np.frombuffer(found["total"], "<i8")
    return total.reshape(-1)


def set_aside(df: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with the columns renamed that begin with an underscore, as helper columns do, and what names them back."""
    others = {c for c in df.columns if not c.startswith("_")}
    renamed: dict[str, str] = {}
    for c in df.columns:
        if c.startswith("_"):
            new = f"kept{c}"
            while new in others:
                new = f"kept_{new}"
            others.add(new)
            renamed[c] = new
    return df.withColumnsRenamed(renamed), lambda done: done.withColumnsRenamed({new: old for old, new in renamed.items()})
