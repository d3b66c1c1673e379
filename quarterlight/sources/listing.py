"""File inventory: which bulk files a folder holds, and their fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterlight.functions import names
from quarterlight.operators.joins import computed_once
from quarterlight.sources import byte_ranges

MIN_BULK_FILES = 10


def fingerprint(content: Column) -> Column:
    """SHA-256 of a whole binary column, whatever its size."""
    return F.sha2(content, 256)


def describe_files(files: DataFrame) -> DataFrame:
    """Add the fields read from ``filename``; files with other names or impossible dates are left out."""
    matched = computed_once(files, "_match", names.listing_match(F.col("filename"))).filter(F.col("_match") != "")
    fields = names.listing_fields(F.col("filename"), F.col("_match"))
    described = matched.withColumns(fields).drop("_match").filter(F.col("schedule_code").isNotNull())
    return described.withColumn("quarter_key", names.quarter_key(F.col("year"), F.col("quarter")))


def scan_directory(spark: SparkSession, directory: str) -> DataFrame:
    """Inventory of the bulk files in a folder with size, time and fingerprint.

    Spark's ``binaryFile`` reads files of up to 2 GiB; ``scan_large_files`` has no such bound.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(directory)
    return describe_files(
        files.select(
            F.col("path").alias("filepath"),
            names.file_name(F.col("path")).alias("filename"),
            F.col("length").alias("file_size"),
            F.col("modificationTime").alias("last_modified"),
            fingerprint(F.col("content")).alias("file_hash"),
        )
    )


def scan_large_files(spark: SparkSession, directory: str, leaf: int = byte_ranges.LEAF, split: int = byte_ranges.SPLIT) -> DataFrame:
    """The same inventory with ``file_hash`` from the Merkle tree of a file's byte ranges: files of any size, read in parallel.

    The list of files, not their contents, is on the driver.  Hashes are comparable among inventories of one ``leaf`` size.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(directory).select("path", "length", "modificationTime")
    listed = [(r["path"], r["length"]) for r in files.collect()]
    leaves = byte_ranges.file_leaves(spark, listed, leaf, split)
    roots = byte_ranges.merkle_roots(leaves, max((-(-n // leaf) for _, n in listed), default=1)).drop("n_leaves")
    return describe_files(
        files.join(roots, "path").select(
            F.col("path").alias("filepath"),
            names.file_name(F.col("path")).alias("filename"),
            F.col("length").alias("file_size"),
            F.col("modificationTime").alias("last_modified"),
            F.col("root").alias("file_hash"),
        )
    )


def folder_check(files: DataFrame, keys: list[str]) -> DataFrame:
    """Per folder: number of bulk schedule files and whether there are enough of them."""
    name = F.col("filename")
    bulk = name.endswith(".txt") & name.contains("FFIEC") & name.contains("Schedule")
    return files.groupBy(*keys).agg(F.count(F.when(bulk, 1)).alias("bulk_files")).withColumn(
        "is_valid", F.col("bulk_files") >= MIN_BULK_FILES
    )
