"""The ledger as a log: every batch appends the rows it changes, and nothing stored is written again.

Below a log's folder, ``commits`` holds one small row per batch (version, batch id, time, kind, folder) and ``changes``
one folder of changed rows per batch.  A changed row carries a file's whole new state, or ``removed``.  The state of a
version is its last full snapshot, with the rows of later batches put over it: the last writer of a path wins.

Every folder holds its rows in the log's buckets of ``filepath``, as many as were chosen when it was created, so that a state
is put together, and joined by path, bucket by bucket: stored rows are not shuffled again.  The folders are
partitions of one table that a session registers over them; a folder of a log without buckets is read as it is.

A batch counts once its commit is written; what a run that failed before that left behind is never read.  A batch id that
was committed before changes nothing, so a run can be repeated.  There is one writer at a time.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quarterlight.operators import ledger

COMMIT_SCHEMA = "version bigint, batch_id string, committed_at timestamp, kind string, folder string"
_CHANGE_SCHEMA = ledger.LEDGER_SCHEMA + ", removed boolean, version bigint"
COLUMNS = [c.split()[0] for c in _CHANGE_SCHEMA.split(",")]


def _stamp(now: dt.datetime):
    """A time of the driver as a column, read in the session's time zone."""
    return F.lit(str(now)).cast("timestamp")


def create(start: DataFrame, root: str, now: dt.datetime, buckets: int | None = None) -> None:
    """Begin a log with a ledger (an empty one too) as snapshot of version 0.  Paths of a ledger are unique.

    Without ``buckets`` there are as many as the session has shuffle partitions.
    """
    buckets = buckets or int(start.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    _write(start.withColumn("removed", F.lit(False)), root, 0, "create", now, "snapshot", buckets)


def commits(spark: SparkSession, root: str) -> DataFrame:
    """One row per committed batch: version, batch_id, committed_at, kind, folder."""
    return spark.createDataFrame(_listed(spark, root), COMMIT_SCHEMA)


def state(spark: SparkSession, root: str, version: int | None = None, as_of: dt.datetime | None = None) -> DataFrame:
    """The ledger at a version, at a time (the last batch committed up to it), or now.

    The list of batches, not their rows, is on the driver.  Snapshot rows are unique, so only paths
    that changed since are looked for in it; it is not grouped again.  A version or time before the log gives an empty ledger.
    """
    return _state(spark, root, _listed(spark, root, version, as_of))


def _listed(spark: SparkSession, root: str, version: int | None = None, as_of: dt.datetime | None = None) -> list[Row]:
    """The commits up to a version and a time in order, by one job without a shuffle; of a commit written twice, the first."""
    every = spark.read.schema(COMMIT_SCHEMA).parquet(f"{root}/commits")
    if version is not None:
        every = every.filter(F.col("version") <= version)
    if as_of is not None:
        every = every.filter(F.col("committed_at") <= _stamp(as_of))
    first: dict[tuple[str, bool], Row] = {}
    for row in sorted(every.collect(), key=lambda r: r["version"]):
        first.setdefault((row["batch_id"], row["kind"] == "snapshot"), row)
    return list(first.values())


def _state(spark: SparkSession, root: str, listed: list[Row]) -> DataFrame:
    snapshot = [r for r in listed if r["kind"] == "snapshot"][-1:]
    if not snapshot:
        return ledger.empty_ledger(spark)
    later = [r for r in listed if r["kind"] != "snapshot" and r["version"] > snapshot[0]["version"]]
    base = _changes(spark, root, snapshot).drop("removed", "version")
    if not later:
        return base
    # The last state of every path that changed: partial results before the shuffle, however often a path changed.
    changed = _changes(spark, root, later)
    others = [c for c in changed.columns if c != "filepath"]
    tail = changed.groupBy("filepath").agg(F.max_by(F.struct(*others), "version").alias("row")).select("filepath", "row.*")
    unchanged = base.join(tail.select("filepath"), "filepath", "left_anti")
    return unchanged.unionByName(tail.filter(~F.col("removed")).drop("removed", "version"))


def _buckets(folder: str) -> int | None:
    """The number of buckets that a folder's name ends with."""
    found = re.search(r"-b(\d+)$", folder)
    return int(found[1]) if found else None


def _changes(spark: SparkSession, root: str, batches: list[Row]) -> DataFrame:
    """The rows of batches by one scan, however many they are."""
    folders = [r["folder"] for r in batches]
    kinds = {_buckets(f) for f in folders}
    if len(kinds) > 1 or None in kinds:
        return spark.read.schema(_CHANGE_SCHEMA).parquet(*[f"{root}/changes/{f}" for f in folders])
    quoted = f"{root}/changes".replace("\\", "\\\\").replace("'", "\\'")
    table = f"ledger_log_{hashlib.sha256(root.encode()).hexdigest()[:24]}_{folders[0].rsplit('-', 1)[1]}"
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({_CHANGE_SCHEMA}, folder string) USING parquet PARTITIONED BY (folder)"
        f" CLUSTERED BY (filepath) INTO {kinds.pop()} BUCKETS LOCATION '{quoted}'"
    )
    spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS " + " ".join(f"PARTITION (folder='{f}') LOCATION '{quoted}/{f}'" for f in folders))
    return spark.table(table).filter(F.col("folder").isin(folders)).drop("folder")


def _write(
    rows: DataFrame, root: str, version: int, batch_id: str, now: dt.datetime, kind: str, buckets: int | None, placed: bool = False
) -> None:
    """``placed`` rows lie in the tasks by buckets already, as those of a state do that is only filtered or joined by path."""
    spark, folder = rows.sparkSession, f"{version}-{uuid.uuid4().hex}" + (f"-b{buckets}" if buckets else "")
    rows, path = rows.withColumn("version", F.lit(version)).select(*COLUMNS), f"{root}/changes/{folder}"
    if buckets:
        rows = rows if placed else rows.hint("rebalance", buckets, F.col("filepath"))
        table = f"ledger_rows_{uuid.uuid4().hex}"
        rows.write.bucketBy(buckets, "filepath").option("path", path).saveAsTable(table)
        spark.sql(f"DROP TABLE {table}")  # its files stay
    else:
        rows.write.parquet(path)
    commit = spark.range(1).select(
        F.lit(version).cast("bigint").alias("version"), F.lit(batch_id).alias("batch_id"), _stamp(now).alias("committed_at"),
        F.lit(kind).alias("kind"), F.lit(folder).alias("folder"),
    )
    commit.write.mode("append").parquet(f"{root}/commits")


def append(
    spark: SparkSession, root: str, batch_id: str, now: dt.datetime, change: Callable[[DataFrame], DataFrame], kind: str = "change",
    placed: bool = False,
) -> int:
    """Commit ``change(current state)``, the changed rows only, under ``batch_id`` and return the version.

    The rows may carry ``removed``.  A batch id that is committed already is not worked out again: its version is returned.
    ``placed`` says that a change leaves the state's rows in their tasks, so that they are stored without a shuffle.
    """
    listed = _listed(spark, root)
    batches = {r["batch_id"]: r["version"] for r in listed if r["kind"] != "snapshot"}
    if batch_id in batches:
        return batches[batch_id]
    last = max(batches.values(), default=0)
    rows = change(_state(spark, root, listed))
    if "removed" not in rows.columns:
        rows = rows.withColumn("removed", F.lit(False))
    _write(rows, root, last + 1, batch_id, now, kind, _buckets(listed[-1]["folder"]) if listed else None, placed)
    return last + 1


def _touched(rows: DataFrame, now: dt.datetime) -> DataFrame:
    return rows.filter(F.col("updated_at") == _stamp(now))


def upsert_files(spark: SparkSession, root: str, batch_id: str, listing: DataFrame, now: dt.datetime) -> int:
    """Append new files and files with a changed fingerprint; see ``ledger.upsert_files``."""
    return append(
        spark, root, batch_id, now, lambda s: _touched(ledger.upsert_files(s, listing, _stamp(now)), now), "upsert"
    )


def mark_processed(spark: SparkSession, root: str, batch_id: str, counts: DataFrame, now: dt.datetime) -> int:
    """Append the rows of processed files; see ``ledger.mark_processed``."""
    def change(current: DataFrame) -> DataFrame:
        return ledger.mark_processed(current.join(counts.select("filepath"), "filepath", "left_semi"), counts, _stamp(now))

    return append(spark, root, batch_id, now, lambda s: _touched(change(s), now), "processed", True)


def set_status(spark: SparkSession, root: str, batch_id: str, outcomes: DataFrame, now: dt.datetime) -> int:
    """Append the rows whose status an outcome sets; see ``ledger.set_status``."""
    def change(current: DataFrame) -> DataFrame:
        return ledger.set_status(current.join(outcomes.select("filepath"), "filepath", "left_semi"), outcomes, _stamp(now))

    return append(spark, root, batch_id, now, lambda s: _touched(change(s), now), "status", True)


def reset_failed(spark: SparkSession, root: str, batch_id: str, now: dt.datetime, quarter: str | None = None) -> int:
    """Append the failed rows of a quarter, or all, as pending; no other row is read beyond its status."""
    def change(current: DataFrame) -> DataFrame:
        return ledger.reset_failed(ledger.in_quarter(current, quarter).filter("processing_status = 'failed'"))

    return append(spark, root, batch_id, now, change, "reset", True)


def purge_old(spark: SparkSession, root: str, batch_id: str, now: dt.datetime, days_old: int = 90) -> int:
    """Append the removal of processed rows older than ``days_old`` days; earlier versions keep them."""
    def change(current: DataFrame) -> DataFrame:
        return current.filter(ledger.processed_before(days_old, now)).withColumn("removed", F.lit(True))

    return append(spark, root, batch_id, now, change, "purge", True)


def compact(spark: SparkSession, root: str, now: dt.datetime) -> int:
    """Store the current state as a snapshot of its version, from which later reads begin; earlier versions stay readable.

    A version that has a snapshot gets no second one.
    """
    listed = _listed(spark, root)
    version = max(r["version"] for r in listed)
    if not any(r["kind"] == "snapshot" and r["version"] == version for r in listed):
        whole = _state(spark, root, listed).withColumn("removed", F.lit(False))
        _write(whole, root, version, f"snapshot-{version}", now, "snapshot", _buckets(listed[-1]["folder"]), True)
    return version


def history(spark: SparkSession, root: str, filepaths: DataFrame) -> DataFrame:
    """(version, batch_id, kind, ledger columns, removed) of every change of the given paths, snapshots left out but the first."""
    listed = [r for r in _listed(spark, root) if r["kind"] != "snapshot" or r["version"] == 0]
    rows = _changes(spark, root, listed).join(filepaths.select("filepath").distinct(), "filepath", "left_semi")
    about = spark.createDataFrame(listed, COMMIT_SCHEMA).select("version", "batch_id", "kind")
    return about.join(rows, "version")
