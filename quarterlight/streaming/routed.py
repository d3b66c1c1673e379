"""One stream over schedule files of every header, in which a re-filed institution and quarter replaces the earlier one.

The stream itself carries new files' paths, never their contents.  Each micro-batch groups its files by schedule and header,
and a group is one scan; so a new column, or a new schedule, needs no stream of its own.  Rows are stored by batch number: a
batch that is run again after a failure writes over its own rows, so nothing is stored twice.

Amendments are settled when rows are read: a filing is one institution in one file, ``filings`` has one row for each, and
the newest filing of (institution, quarter, schedule, part) wins.  Stored cells are not rewritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarterlight.functions import names
from quarterlight.operators import normalize
from quarterlight.plans.reports import header_error
from quarterlight.sources import schedules

_FILES = "path string, modificationTime timestamp, length bigint, content binary"
FILING = ["rssd_id", "quarter_key", "schedule_code", "part"]


def stream_files(spark: SparkSession, directory: str, pattern: str = "*.txt", max_files: int | None = None) -> DataFrame:
    """(path, modified, size) of new files below a folder; the unused content column is not read."""
    reader = spark.readStream.schema(_FILES).format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(directory).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def store_batch(
    files: DataFrame, batch_id: int, institutions: DataFrame, descriptions: DataFrame, output: str, mode: str = "strict"
) -> None:
    """Write the long rows, filings and failures of one micro-batch's files (path, modified, size).

    A file whose name or header is of no use is a failure and keeps no other file from being stored.  The list of a batch's
    files, not their rows, is on the driver.
    """
    spark = files.sparkSession
    code = F.coalesce(names.schedule_code(names.file_name(F.col("path"))), F.lit(""))
    listed = files.select(code.alias("code"), "path", "modified").collect()
    modified = {r["path"]: r["modified"] for r in listed}
    failures, parts = [], []
    for (schedule, header), paths in schedules.group_by_header(spark, sorted((r["code"], r["path"]) for r in listed)).items():
        error = "no schedule in the name" if not schedule else header_error(header)
        if error:
            failures.extend((p, error) for p in paths)
            continue
        wide = schedules.read_wide(spark, paths, header=list(header))
        carry = ["source_file", "source_path", "row_seq"]
        parts.append(normalize.to_long(wide, institutions, descriptions, schedule, carry=carry, mode=mode))
    folder = f"batch={batch_id}"
    spark.createDataFrame(failures, "source_path string, error string").write.mode("overwrite").parquet(f"{output}/failures/{folder}")
    if not parts:
        return
    fields = names.listing_fields(F.col("source_file"))
    quarter = names.quarter_key(fields["year"], fields["quarter"])
    rows = normalize.union_schedules(parts).withColumns({"quarter_key": quarter, "part": fields["part"]})
    rows.write.mode("overwrite").parquet(f"{output}/rows/{folder}")
    times = spark.createDataFrame(sorted(modified.items()), "source_path string, modified timestamp")
    stored = spark.read.parquet(f"{output}/rows/{folder}")
    filed = stored.groupBy(*FILING, "source_path").agg(F.count(F.lit(1)).alias("n_cells")).join(times, "source_path", "left")
    filed.write.mode("overwrite").parquet(f"{output}/filings/{folder}")


def process_new_files(
    spark: SparkSession, directory: str, institutions: DataFrame, descriptions: DataFrame, output: str, checkpoint: str,
    pattern: str = "*.txt", mode: str = "strict", max_files: int | None = None,
) -> StreamingQuery:
    """Store every file not seen before, whatever its header, then stop.  The checkpoint remembers the files."""
    return (
        stream_files(spark, directory, pattern, max_files)
        .writeStream.foreachBatch(lambda df, n: store_batch(df, n, institutions, descriptions, output, mode))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def filings(spark: SparkSession, output: str) -> DataFrame:
    """Every filing with its number of cells, batch, file time and whether it is the current one.

    Of the filings of one institution, quarter, schedule and part the one of the latest batch is current, in a batch the file
    modified last, then the greatest path.  An empty store can't be read.
    """
    every = spark.read.parquet(f"{output}/filings")
    keys = [F.col(c).alias(f"_{c}") for c in FILING]
    newest = every.groupBy(*keys).agg(F.max(F.struct("batch", "modified", "source_path")).alias("newest"))
    match = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in FILING]
    is_newest = (F.col("batch") == F.col("newest.batch")) & (F.col("source_path") == F.col("newest.source_path"))
    return every.join(newest, match).select(*every.columns, is_newest.alias("is_current"))


def current_rows(spark: SparkSession, output: str) -> DataFrame:
    """The long rows of current filings only.

    Rows are matched with one row per filing, not per cell; where filings are few Spark broadcasts them by their true size.
    """
    names_of = {c: f"_{c}" for c in ("batch", "source_path", *FILING)}
    keep = filings(spark, output).filter("is_current").select(*[F.col(c).alias(n) for c, n in names_of.items()])
    match = [F.col(c).eqNullSafe(F.col(n)) for c, n in names_of.items()]
    return spark.read.parquet(f"{output}/rows").join(keep, match, "left_semi")


def failures(spark: SparkSession, output: str) -> DataFrame:
    """(source_path, error, batch) of the files that could not be stored."""
    return spark.read.parquet(f"{output}/failures")
