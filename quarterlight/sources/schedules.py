"""Wide schedule files (tab-separated, one row per institution, one column per code)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quarterlight import dims
from quarterlight.functions import names, text
from quarterlight.sources import byte_ranges


def code_columns(columns: list[str]) -> list[str]:
    """The columns whose names are report codes, in file order."""
    return [c for c in columns if re.match(dims.CODE_COLUMN_PATTERN, c)]


def quality_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if re.match(dims.QUALITY_COLUMN_PATTERN, c)]


def _reader(spark: SparkSession, header: list[str]):
    schema = StructType([StructField(c, StringType()) for c in header])
    # enforceSchema=False makes Spark compare each file's header with the schema, so that files with
    # the same columns in another order fail instead of silently swapping values.
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("enforceSchema", False)


def file_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of one file; Spark reads its first line only."""
    return spark.read.option("sep", "\t").option("header", True).csv(path).columns


def read_wide(
    spark: SparkSession,
    paths: str | list[str],
    rssd_ids: list[str] | None = None,
    header: list[str] | None = None,
) -> DataFrame:
    """Read files that share one header: id, code columns (all text) and lineage columns.

    Columns that are not codes are never materialised, the id filter runs inside the scan, and one
    large file is split over many tasks.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    header = header or file_header(spark, paths[0])
    codes = code_columns(header)
    raw = _reader(spark, header).csv(paths)
    if rssd_ids:
        # On the file's own column, so that the filter is pushed into the scan.
        raw = raw.filter(F.col(dims.ID_COLUMN).isin(*[str(i) for i in rssd_ids]))
    path = F.col("_metadata.file_path")
    kept = raw.select(
        text.null_tokens(F.col(dims.ID_COLUMN)).alias(dims.ID_COLUMN),
        *[text.null_tokens(F.col(f"`{c}`")).alias(c) for c in codes],
        names.file_name(plain_path(path)).alias("source_file"),
        plain_path(path).alias("source_path"),
    )
    # Grows with the position in a file; used only to order repeated rows of one institution there.
    return kept.withColumn("row_seq", F.monotonically_increasing_id())


def with_file_quarter(rows: DataFrame) -> DataFrame:
    """Add ``quarter_key``, read from the file's name; on wide rows this is done once per row and not once per cell."""
    fields = names.listing_fields(F.col("source_file"))
    return rows.withColumn("quarter_key", names.quarter_key(fields["year"], fields["quarter"]))


def list_files(spark: SparkSession, directory: str, pattern: str = "*.txt") -> DataFrame:
    """path, file name, size and modification time of matching files; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(directory)
    )
    return files.select("path", names.file_name(F.col("path")).alias("filename"), "length", "modificationTime")


def plain_path(file_path: Column) -> Column:
    """A ``_metadata.file_path`` in the form in which files are listed: not URL-encoded, one slash after ``file:``."""
    decoded = F.url_decode(F.replace(file_path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^file:/+", "file:/")


def group_by_header(spark: SparkSession, listed: list[tuple[str, str]]) -> dict[tuple[str, tuple[str, ...]], list[str]]:
    """(schedule code, header) -> paths of the listed (code, path), so that each group can be one scan.

    The headers come from one job that opens the listed files and reads their first lines, whatever the number and size of
    the files; a file without a first line, or one that is gone, is grouped under an empty header.
    """
    found = byte_ranges.first_lines(spark, [path for _, path in listed]).collect() if listed else []
    header_of = {r["path"]: tuple(c.strip('"') for c in r["header"].split("\t")) for r in found}
    groups: dict[tuple[str, tuple[str, ...]], list[str]] = {}
    for code, path in listed:
        groups.setdefault((code, header_of.get(path, ())), []).append(path)
    return dict(sorted(groups.items()))


def schedule_files(spark: SparkSession, directory: str, pattern: str = "*.txt") -> list[tuple[str, str, str]]:
    """(schedule code, header group's file path, file name) of a directory, in file-name order.

    The list is one entry per file of the directory, never per row.
    """
    listed = list_files(spark, directory, pattern).select(
        "path", "filename", names.schedule_code(F.col("filename")).alias("schedule_code")
    )
    rows = sorted(listed.collect(), key=lambda r: (r.filename, r.path))
    return [(r.schedule_code or f"File_{i}", r.path, r.filename) for i, r in enumerate(rows)]
