"""One file per row, as a set: a data source that shows its files only when all of them are written.

Tasks write into a staging folder beside the files. When all tasks are done, the commit lists their folders, and tasks
of a second job move the files into place; when the first job fails, the abort removes the folder. Attempts that
failed leave their files in the staging folder alone, as only the folders of the commit are moved.
"""

from __future__ import annotations

import io
import json
import sys
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import batched

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import BinaryType, StructField, StructType

from closebook.session import with_settings
from closebook.workers import LONG_ROWS, lean, release

# Tasks get this module's classes with the job, so executors need not have the package.
register_pickle_by_value(sys.modules[__name__])

MOVES_AT_ONCE = 16
READ_BYTES = 1 << 20
COMMITTED = "committed"


def _file_system(path: str):
    """The file system of a path, and the path's name in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


@dataclass
class Staged(WriterCommitMessage):
    """The folder of a task's files, in the staging folder; the file ``moves`` in it lists where they belong."""

    folder: str


class LetterWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.staging = options["staging"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        system, root = _file_system(self.staging)
        name, n = uuid.uuid4().hex, 0
        system.create_dir(f"{root}/{name}", recursive=True)
        with system.open_output_stream(f"{root}/{name}/moves") as moves:
            for batch in iterator:
                for path, text in zip(batch.column("output_path"), batch.column("letter_text")):
                    with system.open_output_stream(f"{root}/{name}/{n}") as stream:
                        stream.write(text.as_buffer())
                    moves.write((json.dumps([f"{root}/{name}/{n}", _file_system(path.as_py())[1]]) + "\n").encode())
                    n += 1
        release()
        return Staged(name)

    def commit(self, messages: list[Staged | None]) -> None:
        """Lists the folders of the tasks that count, for ``move_all``."""
        system, root = _file_system(self.staging)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{COMMITTED}") as stream:
            stream.write("\n".join(m.folder for m in messages if m is not None).encode())

    def abort(self, messages: list[Staged | None]) -> None:
        from pyarrow import fs

        system, root = _file_system(self.staging)
        if system.get_file_info(root).type == fs.FileType.Directory:
            system.delete_dir(root)


class LetterFiles(DataSource):
    """Writes rows with output_path and letter_text; option ``staging`` names the folder for files underway."""

    @classmethod
    def name(cls) -> str:
        return "closebook_letters"

    def writer(self, schema, overwrite: bool) -> LetterWriter:
        return LetterWriter(dict(self.options))


def move_all(staging: str, folder: str) -> None:
    """Move the files of one task's folder into place. What an earlier attempt has moved is in place already."""
    from pyarrow import fs

    system, root = _file_system(staging)
    made: set[str] = set()

    def move(line: bytes) -> None:
        aside, name = json.loads(line)
        parent = name.rsplit("/", 1)[0]
        if parent not in made:
            system.create_dir(parent, recursive=True)
            made.add(parent)
        try:
            system.move(aside, name)
        except FileNotFoundError:
            if system.get_file_info(aside).type != fs.FileType.NotFound or system.get_file_info(name).type != fs.FileType.File:
                raise

    with system.open_input_stream(f"{root}/{folder}/moves") as moves, ThreadPoolExecutor(MOVES_AT_ONCE) as pool:
        for lines in batched(io.BufferedReader(moves), 64 * MOVES_AT_ONCE):
            list(pool.map(move, lines))


def write_files(texts: DataFrame) -> None:
    """Write (output_path, letter_text), paths being distinct, on one file system that the executors share."""
    least = texts.agg(F.min("output_path")).first()[0]
    if least is None:
        return
    spark = texts.sparkSession
    spark.dataSource.register(LetterFiles)
    staging = f"{least.rsplit('/', 1)[0]}/.staging-{uuid.uuid4().hex}"
    with with_settings(spark, LONG_ROWS):
        texts.select("output_path", "letter_text").write.format("closebook_letters").option("staging", staging).mode("append").save()
    system, root = _file_system(staging)
    try:
        with system.open_input_stream(f"{root}/{COMMITTED}") as stream:
            folders = stream.read().decode().split()
        spark.sparkContext.parallelize(folders, max(1, len(folders))).foreach(lambda folder: move_all(staging, folder))
    finally:
        system.delete_dir(root)


def read_files(rows: DataFrame, path: str = "output_path") -> DataFrame:
    """``rows`` with ``content``, the bytes of the file at ``path``; a row whose file is not there, or whose path is null, is left out.

    The rows name the files, so none are listed, and a task reads those of its rows one by one: a listing of very many
    files goes through the driver, and a scan of them has a task for every few.
    """

    def read(batches):
        for batch in batches:
            begin, size, found = 0, 0, []
            for i, name in enumerate(batch.column(path).to_pylist(), 1):
                found.append(None if name is None else _content(name))
                size += len(found[-1] or b"")
                if size >= READ_BYTES or i == batch.num_rows:
                    held = pa.array(found, pa.binary())
                    part = batch.slice(begin, i - begin)
                    yield pa.RecordBatch.from_arrays([*part.columns, held], [*part.schema.names, "content"]).filter(held.is_valid())
                    begin, size, found = i, 0, []

    return rows.mapInArrow(lean(read), StructType([*rows.schema.fields, StructField("content", BinaryType())]))


def _content(path: str) -> bytes | None:
    system, name = _file_system(path)
    try:
        with system.open_input_stream(name) as stream:
            return stream.read()
    except FileNotFoundError:
        return None
