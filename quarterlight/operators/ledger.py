"""Incremental file state: a ledger table of files, their status and their results.

Every function takes a ledger DataFrame and returns the next state; ``write_snapshot`` stores it as a
new snapshot, never over the one being read.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterlight import dims
from quarterlight.functions import names
from quarterlight.operators.joins import lookup_join

LEDGER_SCHEMA = (
    "filepath string, filename string, schedule_code string, report_date string, quarter int, year int,"
    " file_size bigint, file_hash string, last_modified timestamp, is_processed boolean,"
    " processed_date timestamp, row_count bigint, institution_count bigint, created_at timestamp,"
    " updated_at timestamp, processing_status string, error_message string, retry_count int,"
    " last_retry_date timestamp"
)
_FOUND = ("filename", "schedule_code", "report_date", "quarter", "year", "file_size", "file_hash", "last_modified")
_KEPT = (
    "is_processed", "processed_date", "row_count", "institution_count", "created_at", "updated_at",
    "processing_status", "error_message", "retry_count", "last_retry_date",
)


def ledger_columns(spark: SparkSession) -> list[str]:
    return spark.createDataFrame([], LEDGER_SCHEMA).columns


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER_SCHEMA)


def upsert_files(ledger: DataFrame, listing: DataFrame, now: Column | None = None) -> DataFrame:
    """Merge an inventory into the ledger by path.

    New paths are inserted as pending.  A changed fingerprint updates fingerprint and time and makes
    the file pending again; an equal one leaves the row alone.  Rows not listed are kept.
    """
    now = F.current_timestamp() if now is None else now
    found = listing.select("filepath", *[F.col(c).alias(f"new_{c}") for c in _FOUND])
    merged = ledger.withColumn("known", F.lit(True)).join(found, "filepath", "full_outer")
    is_new = F.col("known").isNull()
    changed = ~is_new & F.col("new_file_hash").isNotNull() & ~F.col("file_hash").eqNullSafe(F.col("new_file_hash"))

    def pick(column: str) -> Column:
        new, old = F.col(f"new_{column}"), F.col(column)
        replace = is_new | changed if column in ("file_hash", "last_modified") else is_new
        return F.when(replace, new).otherwise(old)

    fresh = is_new | changed
    columns = {c: pick(c) for c in _FOUND} | {
        "is_processed": F.when(fresh, F.lit(False)).otherwise(F.col("is_processed")),
        "processing_status": F.when(fresh, "pending").otherwise(F.col("processing_status")),
        "retry_count": F.when(is_new, 0).otherwise(F.col("retry_count")),
        "created_at": F.when(is_new, now).otherwise(F.col("created_at")),
        "updated_at": F.when(fresh, now).otherwise(F.col("updated_at")),
    }
    chosen = {c: F.col(c) for c in _KEPT} | columns
    return merged.select("filepath", *[chosen[c].alias(c) for c in (*_FOUND, *_KEPT)])


def in_quarter(ledger: DataFrame, quarter: str | None) -> DataFrame:
    """Rows of a "YYYY-Qn" quarter."""
    if quarter is None:
        return ledger
    year, number = quarter.split("-Q")
    return ledger.filter((F.col("year") == int(year)) & (F.col("quarter") == int(number)))


def in_directory(ledger: DataFrame, directory: str | None) -> DataFrame:
    """Rows below a folder, with their quarter label."""
    kept = ledger if directory is None else ledger.filter(F.col("filepath").startswith(directory.rstrip("/") + "/"))
    return kept.withColumn("quarter_key", names.quarter_key(F.col("year"), F.col("quarter")))


def pending_files(ledger: DataFrame, quarter: str | None = None) -> DataFrame:
    """Files still to do: pending, failed, or left in processing by a run that ended early."""
    return in_quarter(ledger, quarter).filter(F.col("processing_status").isin("pending", "failed", "processing"))


def failed_files(ledger: DataFrame, quarter: str | None = None) -> DataFrame:
    failed = in_quarter(ledger, quarter).filter(F.col("processing_status") == "failed")
    return failed.withColumn("error_message", F.coalesce("error_message", F.lit("Unknown error")))


def reset_failed(ledger: DataFrame, quarter: str | None = None) -> DataFrame:
    hit = F.col("processing_status") == "failed"
    if quarter is not None:
        year, number = quarter.split("-Q")
        hit = hit & (F.col("year") == int(year)) & (F.col("quarter") == int(number))
    return ledger.withColumns(
        {
            "processing_status": F.when(hit, "pending").otherwise(F.col("processing_status")),
            "error_message": F.when(~hit, F.col("error_message")),
        }
    )


def set_status(ledger: DataFrame, outcomes: DataFrame, now: Column | None = None) -> DataFrame:
    """Apply (filepath, status, error): a failure with a message also counts a retry."""
    now = F.current_timestamp() if now is None else now
    joined = ledger.join(outcomes.select("filepath", "status", "error"), "filepath", "left")
    hit = F.col("status").isNotNull()
    failed = hit & (F.col("status") == "failed") & (F.coalesce("error", F.lit("")) != "")
    return joined.withColumns(
        {
            "processing_status": F.coalesce("status", "processing_status"),
            "error_message": F.when(failed, F.col("error")).otherwise(F.col("error_message")),
            "retry_count": F.col("retry_count") + F.when(failed, 1).otherwise(0),
            "last_retry_date": F.when(failed, now).otherwise(F.col("last_retry_date")),
            "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
        }
    ).drop("status", "error")


def mark_processed(ledger: DataFrame, counts: DataFrame, now: Column | None = None) -> DataFrame:
    """Apply (filepath, row_count, institution_count) of processed files."""
    now = F.current_timestamp() if now is None else now
    done = counts.select(
        "filepath", F.col("row_count").alias("new_rows"), F.col("institution_count").alias("new_institutions")
    )
    joined = ledger.join(done, "filepath", "left")
    hit = F.col("new_rows").isNotNull()
    return joined.withColumns(
        {
            "is_processed": hit | F.col("is_processed"),
            "processed_date": F.when(hit, now).otherwise(F.col("processed_date")),
            "row_count": F.coalesce("new_rows", "row_count"),
            "institution_count": F.coalesce("new_institutions", "institution_count"),
            "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
        }
    ).drop("new_rows", "new_institutions")


def processed_before(days_old: int = 90, now: dt.datetime | None = None) -> Column:
    """Whether a row was processed more than ``days_old`` days ago."""
    limit = (now or dt.datetime.now()) - dt.timedelta(days=days_old)
    old = F.col("is_processed") & (F.col("processed_date") < F.lit(str(limit)).cast("timestamp"))
    return F.coalesce(old, F.lit(False))


def purge_old(ledger: DataFrame, days_old: int = 90, now: dt.datetime | None = None) -> DataFrame:
    """Drop processed rows older than ``days_old`` days."""
    return ledger.filter(~processed_before(days_old, now))


def processing_totals(ledger: DataFrame) -> DataFrame:
    """One row: files, processed files."""
    return ledger.agg(
        F.count(F.lit(1)).alias("total_files"), F.count(F.when(F.col("is_processed"), 1)).alias("processed_files")
    )


def processing_by_quarter(ledger: DataFrame) -> DataFrame:
    """Files and processed files per quarter, newest quarter first."""
    return (
        ledger.groupBy("year", "quarter")
        .agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("is_processed"), 1)).alias("processed"))
        .withColumn("quarter_key", names.quarter_key(F.col("year"), F.col("quarter")))
        .orderBy(F.desc("year"), F.desc("quarter"))
    )


def status_counts(ledger: DataFrame, quarter: str | None = None) -> DataFrame:
    """Pending and failed files, as the status display shows them."""
    status = F.col("processing_status")
    return in_quarter(ledger, quarter).agg(
        F.count(F.when(status.isin("pending", "failed", "processing"), 1)).alias("pending"),
        F.count(F.when(status == "failed", 1)).alias("failed"),
    )


def files_by_quarter(files: DataFrame) -> DataFrame:
    """Every file with its quarter label and how many files that quarter has.

    The files of a quarter stay rows: a quarter is not collected into one value.
    """
    sizes = files.groupBy("year", "quarter").agg(F.count(F.lit(1)).alias("files_in_quarter"))
    joined = lookup_join(files, sizes, ["year", "quarter"], how="inner")
    return joined.withColumn("quarter_key", names.quarter_key(F.col("year"), F.col("quarter")))


def available_quarters(files: DataFrame) -> DataFrame:
    """Distinct quarters, newest first."""
    distinct = files.select("year", "quarter").distinct()
    return distinct.withColumn("quarter_key", names.quarter_key(F.col("year"), F.col("quarter"))).orderBy(
        F.desc("year"), F.desc("quarter")
    )


def latest_quarter(files: DataFrame) -> DataFrame:
    """The newest quarter label, by aggregation instead of a sort."""
    return files.agg(F.max(names.quarter_key(F.col("year"), F.col("quarter"))).alias("quarter_key"))


def ledger_order(ledger: DataFrame) -> DataFrame:
    """Newest quarter first, schedules in order inside it."""
    return ledger.orderBy(F.desc("year"), F.desc("quarter"), "schedule_code", "filepath")


def _satisfied(code: Column, exact: bool) -> Column:
    expected = F.array(*[F.lit(c) for c in dims.EXPECTED_SCHEDULES])
    if exact:
        without_part = F.regexp_replace(code, "[0-9]+$", "")
        return F.filter(expected, lambda e: (e == code) | (e == without_part))
    return F.filter(expected, lambda e: F.startswith(code, e))


def quarter_completeness(files: DataFrame, exact: bool = False) -> DataFrame:
    """Found and expected schedules, the missing ones and the percentage, per quarter.

    An expected schedule counts as present when some found code starts with it, so RCA also stands in
    for RC; ``exact`` asks for the code itself, with or without a part number.  Each file row names the
    expected schedules it satisfies, and a quarter gathers at most 39 distinct ones.
    """
    codes = files.select("year", "quarter", "schedule_code").distinct()
    hits = codes.withColumn("hit", F.explode_outer(_satisfied(F.col("schedule_code"), exact)))
    grouped = hits.groupBy("year", "quarter").agg(
        F.countDistinct("schedule_code").alias("found_count"), F.collect_set("hit").alias("present")
    )
    n = len(dims.EXPECTED_SCHEDULES)
    missing = F.array_except(F.array(*[F.lit(c) for c in dims.EXPECTED_SCHEDULES]), "present")
    return grouped.select(
        "year",
        "quarter",
        "found_count",
        F.lit(n).cast("bigint").alias("expected_count"),
        F.array_join(missing, ",").alias("missing_schedules"),
        (F.size(missing) == 0).alias("is_complete"),
        (F.col("found_count") / F.lit(float(n)) * 100).alias("completeness_pct"),
    )


def missing_schedules(files: DataFrame, exact: bool = False) -> DataFrame:
    """(year, quarter, schedule_code) of expected schedules no file satisfies: an equality anti-join."""
    expected = F.explode(F.array(*[F.lit(c) for c in dims.EXPECTED_SCHEDULES])).alias("schedule_code")
    # Both sides start from the same distinct codes, so Spark computes and shuffles those once.
    codes = files.select("year", "quarter", "schedule_code").distinct()
    wanted = codes.select("year", "quarter").distinct().select("year", "quarter", expected)
    present = codes.select(
        "year", "quarter", F.explode(_satisfied(F.col("schedule_code"), exact)).alias("schedule_code")
    ).distinct()
    return wanted.join(present, ["year", "quarter", "schedule_code"], "left_anti")


def pending_batch(files: DataFrame, ledger: DataFrame, quarter: str | None = None, resume: bool = True) -> DataFrame:
    """Files of a batch in schedule order: those still to do, or with ``resume=False`` all not processed."""
    listed = in_quarter(files, quarter)
    if resume:
        return listed.join(pending_files(ledger, quarter).select("filepath"), "filepath", "left_semi").orderBy("schedule_code", "filepath")
    done = ledger.filter(F.col("is_processed")).select("filepath")
    return listed.join(done, "filepath", "left_anti").orderBy("schedule_code", "filepath")


def write_snapshot(ledger: DataFrame, root: str, number: int) -> str:
    """Store a ledger state as snapshot ``number`` below ``root``; existing snapshots are not touched."""
    path = f"{root.rstrip('/')}/snapshot={number}"
    ledger.write.mode("errorifexists").parquet(path)
    return path
