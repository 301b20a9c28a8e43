"""Work folder for tables that a job writes once and reads several times."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="closebook-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the work folder and read back.

    The copy survives lost executors, cuts the lineage, and has a size Spark knows when it
    plans joins with it.
    """
    path = f"{work_folder(df.sparkSession)}/closebook/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def with_settings(spark: SparkSession, values: dict[str, object]) -> Iterator[None]:
    """Settings of the session for what is planned or listed inside, put back after it."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def few_listing_tasks(spark: SparkSession):
    """A path that matches many files is listed by four tasks a core at most, not by a task for each file."""
    return with_settings(spark, {"spark.sql.sources.parallelPartitionDiscovery.parallelism": 4 * spark.sparkContext.defaultParallelism})


SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "1m"}


def small_batches(spark: SparkSession):
    """Jobs inside send rows to Python workers in batches of about 1 MB, whatever a row holds."""
    return with_settings(spark, SMALL_BATCHES)


def small_batches_from_now(spark: SparkSession) -> None:
    """The same for all later jobs of the session, such as the caller's on a table that is returned. A session that has a setting of its own keeps it."""
    for name, value in SMALL_BATCHES.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)


def discard(*tables: DataFrame) -> None:
    """Delete the ``staged`` tables that these read, when nothing reads them any more: long jobs then hold less disk."""
    for table in tables:
        spark = table.sparkSession
        for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            if re.search("/closebook/[a-z_]+-[0-9a-f]{32}$", folder):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
