"""Sinks: long table by schedule, comparison tables, CSV per extracted table, nested JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterlight.functions import names, text
from quarterlight.sinks.table_files import write_files


def write_long(long: DataFrame, path: str, fmt: str = "parquet", partition: str = "schedule_code") -> None:
    """Long table, one folder per schedule, the numeric amount next to the text.

    A rebalance by schedule lets adaptive execution split a large schedule into files of the advisory
    size and join small ones, instead of leaving a schedule to one task.
    """
    out = long.withColumn("amount_value", text.amount_number(F.col("amount")))
    writer = out.hint("rebalance", partition).write.mode("errorifexists").partitionBy(partition)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def write_long_buckets(long: DataFrame, table: str, path: str, buckets: int | None = None, partition: str | None = None) -> DataFrame:
    """The long table bucketed by institution: later groupings and joins by institution read it without a shuffle of their own.

    The one shuffle is made here, by the buckets' own hash, so that a task writes whole buckets; adaptive execution splits a
    bucket that an institution with very many rows makes large, which then has several files.  A filter on
    ``rssd_id`` reads one bucket, one on ``partition`` the folders named.  ``table`` is registered over the files in ``path``.
    One task reads a bucket, so their number is to grow with the data: without ``buckets`` there are as many as the session's shuffle partitions.
    """
    buckets = buckets or int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    writer = long.hint("rebalance", buckets, F.col("rssd_id")).write.mode("errorifexists").bucketBy(buckets, "rssd_id").option("path", path)
    (writer.partitionBy(partition) if partition else writer).saveAsTable(table)
    return long.sparkSession.table(table)


def write_comparison(compared: DataFrame, path: str, members: list[str], together: bool = False) -> None:
    """Comparison tables, one folder per schedule, with numeric columns next to the shown text.

    A group's table of a schedule lies in one file, in order, unless it is split for its size.  ``together`` says that the rows of a
    schedule and group are in one task already; then no row is shuffled.
    """
    numeric = {f"{m}_value": text.amount_number(F.col(m)) for m in members}
    out = compared.withColumns(numeric).withColumns(
        {"grp": F.col("sort_key.grp"), "main": F.col("sort_key.main"), "sub": F.col("sort_key.sub"), "letter": F.col("sort_key.letter")}
    )
    out = out.drop("sort_key")
    out = out if together else out.hint("rebalance", "schedule_code", "peer_group")
    ordered = out.sortWithinPartitions("schedule_code", "peer_group", "grp", "main", "sub", "letter", "mdrm_code")
    ordered.write.mode("errorifexists").partitionBy("schedule_code").parquet(path)


def write_table_csv(grids: DataFrame, path: str, keys: list[str], buckets: int = 64) -> None:
    """The CSV text of every table, one row each (keys, file name, text), in ``buckets`` folders, and the totals as JSON.

    The number of folders does not grow with the tables; ``export_csv`` writes files for a chosen set.  A table is one
    row here, so its lines stay in order and no shuffle is needed; the totals are counted from what was written.
    """
    lines = F.array_join(F.transform("cells", lambda r: text.csv_line(r)), "\n")
    out = grids.select(*keys, names.csv_file_name(F.col("table_name")).alias("file"), lines.alias("value"))
    out = out.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    out.write.mode("errorifexists").partitionBy("bucket").parquet(f"{path}/tables")
    written = grids.sparkSession.read.parquet(f"{path}/tables")
    written.agg(F.count(F.lit(1)).alias("table_count"), F.current_timestamp().alias("extraction_date")).write.json(
        f"{path}/_metadata_json"
    )


def write_csv_files(grids: DataFrame, path: str, key: str) -> None:
    """One CSV file without header for each table, in a folder for each document, and the totals in ``_metadata.json``."""
    lines = F.array_join(F.transform("cells", lambda r: text.csv_line(r)), "\n")
    write_files(grids.select(F.col(key).alias("folder"), names.csv_file_name(F.col("table_name")).alias("file"), lines.alias("value")), path)


def export_csv(written: DataFrame, path: str, keys: list[str]) -> None:
    """One folder with one CSV text per table: for a chosen set of the written tables, not for all of them."""
    written.select(*keys, "file", "value").write.mode("errorifexists").partitionBy(*keys, "file").text(path)


def document_json(grids: DataFrame, keys: list[str]) -> DataFrame:
    """One nested record per document with all its tables.

    A document's tables came out of one input row, so the record is no larger than the document.
    """
    table = F.struct(
        "table_ix",
        F.col("table_name").alias("name"),
        F.col("section"),
        F.struct(F.col("n_rows").alias("rows"), F.col("n_cols").alias("columns"), "has_numbers").alias("metadata"),
        F.col("cells").alias("data"),
    )
    return grids.groupBy(*keys).agg(F.sort_array(F.collect_list(table)).alias("tables"))


def write_document_json(grids: DataFrame, path: str, keys: list[str]) -> None:
    stamped = document_json(grids, keys).withColumn("extraction_date", F.current_timestamp())
    stamped.write.mode("errorifexists").json(path)
