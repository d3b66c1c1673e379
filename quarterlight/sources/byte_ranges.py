"""Files read by byte ranges or by their first line, for files of any size and number.

Two Python data sources whose partitions are lists of files or of ranges, so that tasks open only what was listed and read only
what is asked for.  ``merkle_roots`` makes one fingerprint of a file's ranges: leaves of ``leaf`` bytes are hashed
where they are read, and hashes are combined in order, ``fanout`` at a time, level by level, until a file has one.  Both numbers
are part of the fingerprint; how the file was split for reading is not.
"""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LEAF, FANOUT, SPLIT = 1 << 20, 1024, 1 << 27
FILES_A_TASK, BLOCK = 64, 1 << 16

# Workers get these classes by value, so they need no installation of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def opened(path: str):
    """A file of any store that Arrow knows, open for random access."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + unquote(path[5:]).lstrip("/"))
    if "://" not in path:
        return fs.LocalFileSystem().open_input_file(path)
    store, inside = fs.FileSystem.from_uri(path)
    return store.open_input_file(inside)


class Listed(InputPartition):
    def __init__(self, items: list):
        self.items = items


class FirstLineReader(DataSourceReader):
    def __init__(self, options):
        self.paths = json.loads(options["paths"])

    def partitions(self):
        return [Listed(self.paths[i : i + FILES_A_TASK]) for i in range(0, len(self.paths), FILES_A_TASK)] or [Listed([])]

    def read(self, partition) -> Iterator[tuple]:
        for path in partition.items:
            try:
                file = opened(path)
            except FileNotFoundError:
                continue
            with file:
                head = b""
                while True:
                    block = file.read(BLOCK)
                    head += block
                    ends = [e for e in (head.find(b"\n"), head.find(b"\r")) if e >= 0]
                    if ends or not block:
                        break
            if head:
                yield path, head[: min(ends) if ends else None].decode("utf-8-sig", "replace")


class FirstLines(DataSource):
    """path, header: the first line of each listed file; the bytes read do not grow with a file.  Missing and empty files have no row."""

    @classmethod
    def name(cls) -> str:
        return "first_lines"

    def schema(self) -> str:
        return "path string, header string"

    def reader(self, schema) -> FirstLineReader:
        return FirstLineReader(self.options)


class RangeReader(DataSourceReader):
    def __init__(self, options):
        self.files, self.leaf = json.loads(options["files"]), int(options["leaf"])
        self.split = max(1, int(options["split"]) // self.leaf) * self.leaf

    def partitions(self):
        """Ranges of whole leaves; small files share a partition."""
        out, items, size = [], [], 0
        for path, length in self.files:
            for start in range(0, max(1, length), self.split):
                n = min(self.split, length - start)
                items.append((path, length, start, n))
                size += n
                if size >= self.split or len(items) >= 4096:
                    out.append(Listed(items))
                    items, size = [], 0
        return [*out, Listed(items)] if items or not out else out

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        for path, length, start, n in partition.items:
            with opened(path) as file:
                file.seek(start)
                for at in range(start, max(start + 1, start + n), self.leaf):
                    content = file.read(min(self.leaf, start + n - at)) if n else b""
                    columns = [pa.array([path]), pa.array([length], pa.int64()), pa.array([at // self.leaf], pa.int64()), pa.array([content], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["path", "length", "leaf_ix", "content"])


class FileRanges(DataSource):
    """path, length, leaf_ix, content: the leaves of each listed file; an empty file has one empty leaf."""

    @classmethod
    def name(cls) -> str:
        return "file_ranges"

    def schema(self) -> str:
        return "path string, length long, leaf_ix long, content binary"

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options)


def first_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    spark.dataSource.register(FirstLines)
    return spark.read.format("first_lines").option("paths", json.dumps(sorted(set(paths)))).load()


def file_leaves(spark: SparkSession, files: list[tuple[str, int]], leaf: int = LEAF, split: int = SPLIT) -> DataFrame:
    """Leaves of the listed (path, length); ``split`` is the number of bytes that one task reads."""
    spark.dataSource.register(FileRanges)
    return spark.read.format("file_ranges").option("files", json.dumps(files)).option("leaf", leaf).option("split", split).load()


def merkle_roots(leaves: DataFrame, most_leaves: int, keys: tuple[str, ...] = ("path",), fanout: int = FANOUT) -> DataFrame:
    """keys, n_leaves, root: (keys, leaf_ix, content) combined into one hash of each file.

    ``most_leaves`` bounds the leaves of a file and with it the number of levels.  Only hashes are shuffled; a
    group is one node's children.  A leaf's hash begins with L, a node's with N, so that no node passes for a leaf.
    """
    nodes = leaves.select(*keys, F.col("leaf_ix").alias("ix"), F.sha2(F.concat(F.lit("L").cast("binary"), "content"), 256).alias("hash"), F.lit(1).cast("long").alias("n_leaves"))
    for _ in range(max(1, math.ceil(math.log(max(2, most_leaves), fanout) - 1e-9))):
        children = F.sort_array(F.collect_list(F.struct("ix", "hash")))
        nodes = nodes.groupBy(*keys, (F.expr(f"ix div {fanout}")).alias("ix")).agg(children.alias("children"), F.sum("n_leaves").alias("n_leaves"))
        # The first node of a level stands alone only where it is the whole file; that hash is the root already.
        alone = (F.size("children") == 1) & (F.col("ix") == 0)
        joined = F.array_join(F.transform("children", lambda c: c["hash"]), "")
        nodes = nodes.select(*keys, "ix", F.when(alone, F.col("children")[0]["hash"]).otherwise(F.sha2(F.concat(F.lit("N"), joined), 256)).alias("hash"), "n_leaves")
    return nodes.select(*keys, "n_leaves", F.col("hash").alias("root"))
