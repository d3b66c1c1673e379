"""Small helpers of the text operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch that a Python operator returns at most.
BATCH_ROWS = 2048


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, a missing one as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def fresh(rows: DataFrame, *names: str) -> list[str]:
    """Names for working columns that none of the table's columns has."""
    taken, out = {c.lower() for c in rows.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


_SHIPPED: set[str] = set()


def shipped(spark: SparkSession) -> None:
    """Give the executors this package's source, once for each application, as ``addPyFile`` does for any job.

    Workers then don't depend on the driver's working folder or on an installation.
    """
    context = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if context.applicationId in _SHIPPED or not os.path.isdir(root):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="quarterlight-"), "quarterlight_source.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(root):
            for name in sorted(files):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def map_batches(rows: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` whose functions may use this package."""
    shipped(rows.sparkSession)
    return rows.mapInArrow(fn, schema)


def map_rows(rows: DataFrame, fn: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """``mapInArrow`` with plain tuples: ``fn`` gets an iterator over the rows of a partition and yields rows.

    Batches are converted one at a time, so a task holds one batch of input and one of output.
    """
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def values() -> Iterator[tuple]:
            for batch in batches:
                for start in range(0, batch.num_rows, BATCH_ROWS):
                    part = batch.slice(start, BATCH_ROWS)
                    yield from zip(*(c.to_pylist() for c in part.columns))

        ready: list[tuple] = []
        for row in fn(values()):
            ready.append(row)
            if len(ready) >= BATCH_ROWS:
                yield as_batch(ready)
                ready = []
        if ready:
            yield as_batch(ready)

    def as_batch(ready: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, type=kinds[i]) for i, c in enumerate(zip(*ready))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    kinds = [_arrow_type(part.split(None, 1)[1]) for part in schema.split(",")]
    return map_batches(rows, run, schema)


def _arrow_type(kind: str) -> pa.DataType:
    kind = kind.strip().lower()
    if kind.startswith("array<"):
        return pa.list_(_arrow_type(kind[6:-1]))
    return {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(),
        "boolean": pa.bool_(), "binary": pa.binary(),
    }[kind]
