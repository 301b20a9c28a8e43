"""Memory of the Python workers that tasks run in."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value

# Tasks get this module's functions with the job, so executors need not have the package.
register_pickle_by_value(sys.modules[__name__])

#: Rows in a batch that goes to a worker, where a row may be a whole file or a chunk of one (1 MB).
LONG_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 16}


def release() -> None:
    """Hands freed memory back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable) -> Callable:
    """A task's function of batches, which leaves little memory in the worker that waits for its next task."""

    def lean_run(batches):
        yield from run(batches)
        release()

    return lean_run


def one_by_one(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """Rows as Python values one at a time, for rows that may hold a whole file."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]
