"""A sink that writes one file for each row: one CSV file for each extracted table.

A Python data source, with a writer and a reader.  A task writes its files one after the other, so that one is open at a time, into a folder of its own
below ``_staging``; that folder is named by partition and attempt, so that a repeated or speculative attempt never touches another's.
On commit the driver renames one folder for each task (messages carry a folder and a number of files, no names) and then
writes ``_metadata.json``; on abort it deletes the staging folder, and a failing task deletes its own.  A job that failed leaves no
file in sight.  The store must be able to rename folders (local, NFS, HDFS); an object store that cannot is refused by the rename.

Defined results: a null or empty content is an empty file, a null folder is ``(null)``, and of several rows of one folder
and name all have a file: the later ones get ``_2``, ``_3``, … before the ending.  Names are quoted as in URLs, and one above 200 bytes
is cut and ends with its hash.  No rows give no file but the metadata.

Read back, the driver knows the tasks' folders only: the task that reads one lists it, so that no list of all files is ever made.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import sys
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

LONGEST_NAME = 200
#: What a task that reads files holds of them at a time, besides one more file.
BATCH_FILES, BATCH_BYTES = 1024, 4 << 20

# Workers get these classes by value, so they need no installation of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def store_of(path: str):
    """The file system of a path, and the path inside it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + unquote(path[5:]).lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def safe_name(name: str | None) -> str:
    """A name that any file system takes."""
    if name is None:
        return "(null)"
    safe = quote(name, safe=" ()[],=@-_.")
    # Readers pass over names with these beginnings.
    safe = f"%{ord(safe[0]):02X}{safe[1:]}" if safe[:1] in ("_", ".") else safe
    if len(safe) <= LONGEST_NAME:
        return safe or "(empty)"
    stem, dot, ending = safe.rpartition(".")
    ending = dot + ending if stem and len(ending) <= 8 else ""
    return safe[: LONGEST_NAME - 17 - len(ending)] + "-" + hashlib.sha256(name.encode()).hexdigest()[:16] + ending


@dataclass
class Written(WriterCommitMessage):
    folder: str
    part: str
    files: int


class FileForEachRow(DataSourceWriter):
    def __init__(self, options, overwrite: bool):
        if overwrite:
            raise ValueError("table files are only added to an empty folder")
        self.path = options["path"].rstrip("/")
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"
        # Made here, on the driver, and never by a task: one that goes on after an abort can't bring it back.
        store, staging = store_of(self.staging)
        store.create_dir(staging, recursive=True)

    def write(self, iterator) -> Written:
        from pyarrow import fs

        context = TaskContext.get()
        part = f"part-{context.partitionId():05d}"
        store, staging = store_of(self.staging)
        folder = f"{staging}/{part}-{context.taskAttemptId()}"
        files, made = 0, set()
        try:
            store.create_dir(folder, recursive=False)
            for row in iterator:
                below = f"{folder}/{safe_name(row.folder)}"
                name = safe_name(row.file)
                stem, dot, ending = name.rpartition(".") if "." in name else (name, "", "")
                target, number = f"{below}/{name}", 1
                while store.get_file_info(target).type != fs.FileType.NotFound:
                    number += 1
                    target = f"{below}/{stem}_{number}{dot}{ending}"
                if below not in made:
                    store.create_dir(below, recursive=False)
                    made.add(below)
                with store.open_output_stream(target) as out:
                    out.write((row.value or "").encode())
                files += 1
        except BaseException:
            if store.get_file_info(folder).type != fs.FileType.NotFound:
                store.delete_dir(folder)
            raise
        return Written(folder, part, files)

    def commit(self, messages) -> None:
        store, path = store_of(self.path)
        store.create_dir(path, recursive=True)
        done = [m for m in messages if m is not None]
        for message in done:
            if message.files:
                store.move(message.folder, f"{path}/{message.part}")
        self._clear()
        totals = {"table_count": sum(m.files for m in done), "extraction_date": dt.datetime.now(dt.timezone.utc).isoformat()}
        with store.open_output_stream(f"{path}/_metadata.json") as out:
            out.write(json.dumps(totals).encode())

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        store, staging = store_of(self.staging)
        for wait in (0.1, 0.5, 1, 2, 4, None):
            if store.get_file_info(staging).type == fs.FileType.NotFound:
                return
            try:
                store.delete_dir(staging)
            except OSError:  # a task that has not been stopped yet added a file meanwhile
                if wait is None:
                    raise
                time.sleep(wait)


class TableFiles(DataSource):
    """folder, file, value: one file for each row, below ``path/part-<task>/<folder>/``."""

    @classmethod
    def name(cls) -> str:
        return "table_files"

    def writer(self, schema, overwrite: bool) -> FileForEachRow:
        return FileForEachRow(self.options, overwrite)


class Part(InputPartition):
    def __init__(self, folder: str):
        self.folder = folder


class FilesReader(DataSourceReader):
    """A task for each folder that a task wrote."""

    def __init__(self, options):
        self.path = options["path"].rstrip("/")

    def partitions(self):
        from pyarrow import fs

        store, path = store_of(self.path)
        return [Part(f.base_name) for f in store.get_file_info(fs.FileSelector(path)) if f.base_name.startswith("part-")] or [Part("")]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        if not partition.folder:
            return
        store, path = store_of(self.path)

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.binary()))], names=["folder", "file", "content"])

        rows, size = [], 0
        for below in store.get_file_info(fs.FileSelector(f"{path}/{partition.folder}")):
            if below.type != fs.FileType.Directory:
                continue
            for info in store.get_file_info(fs.FileSelector(below.path)):
                if info.size and info.base_name.endswith(".csv"):
                    with store.open_input_stream(info.path) as file:
                        rows.append((below.base_name, info.base_name, file.read()))
                    size += info.size
                    if len(rows) >= BATCH_FILES or size >= BATCH_BYTES:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


class WrittenFiles(DataSource):
    """folder, file, content: names as they are on the disk, and bytes, of the CSV files that are not empty."""

    @classmethod
    def name(cls) -> str:
        return "written_table_files"

    def schema(self) -> str:
        return "folder string, file string, content binary"

    def reader(self, schema) -> FilesReader:
        return FilesReader(self.options)


def write_files(rows: DataFrame, path: str) -> None:
    """One file for each row of (folder, file, value) below ``path``, which must not hold any yet."""
    from pyarrow import fs

    store, inside = store_of(path)
    if store.get_file_info(inside).type != fs.FileType.NotFound and store.get_file_info(fs.FileSelector(inside)):
        raise FileExistsError(path)
    rows.sparkSession.dataSource.register(TableFiles)
    rows.select(*[F.col(c).cast("string") for c in ("folder", "file", "value")]).write.format("table_files").mode("append").save(path)


def read_files(spark, path: str) -> DataFrame:
    """folder, file, value of everything that ``write_files`` wrote, without the empty files.

    Spark's own file sources keep the status of every file on the driver and plan a task for a few of them; here the driver
    holds one name for each task that wrote.
    """
    spark.dataSource.register(WrittenFiles)
    found = spark.read.format("written_table_files").load(path)
    return found.select(F.url_decode("folder").alias("folder"), F.url_decode("file").alias("file"), F.decode("content", "UTF-8").alias("value"))


def read_totals(path: str) -> dict:
    """What ``_metadata.json`` says: the number of tables and the time."""
    store, inside = store_of(path)
    with store.open_input_stream(f"{inside}/_metadata.json") as file:
        return json.loads(file.read())
