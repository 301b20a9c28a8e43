"""Files of the session's file systems, from the driver: what Spark's writers have no words for."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    """Move, test and replace single paths through the file system that Spark itself uses for them."""

    def __init__(self, spark: SparkSession):
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._gateway = spark.sparkContext._gateway

    def _at(self, path: str):
        at = self._fs.Path(path)
        return at, at.getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        at, system = self._at(path)
        return system.exists(at)

    def move(self, path: str, to: str) -> None:
        at, system = self._at(path)
        if not system.rename(at, self._fs.Path(to)):
            raise OSError(f"{path} could not be moved to {to}")

    def replace(self, path: str, text: str) -> None:
        """Write a small file aside and rename it over the old one, so that a reader sees either whole."""
        at, system = self._at(path)
        aside = self._fs.Path(f"{path}.{uuid.uuid4().hex}")
        stream = system.create(aside)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self._fs.FileContext.getFileContext(system.makeQualified(at).toUri(), self._conf)
        option = self._gateway.new_array(self._fs.Options.Rename, 1)
        option[0] = self._fs.Options.Rename.OVERWRITE
        context.rename(system.makeQualified(aside), system.makeQualified(at), option)
