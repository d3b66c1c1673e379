"""End-to-end jobs: directory to long table, metric bundles, batch runs with per-group outcomes."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterlight import dims
from quarterlight.functions import names
from quarterlight.operators import compare, ledger, metrics, normalize, quality, tables
from quarterlight.session import stored
from quarterlight.sources import documents, schedules


def process_file(
    spark: SparkSession, path: str, institutions: DataFrame, descriptions: DataFrame,
    rssd_ids: list[str] | None = None, mode: str = "strict", quarters: bool = False,
) -> DataFrame:
    """Long table of one schedule file, with lineage columns, and with the file's quarter if asked."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    code = _schedule_of(spark, name) or "Unknown"
    wide = schedules.read_wide(spark, path, rssd_ids)
    long = _carried_long(wide, code, institutions, descriptions, mode, quarters)
    return normalize.with_schedule_info(long).withColumn("processing_date", F.current_timestamp())


def _schedule_of(spark: SparkSession, name: str) -> str | None:
    return spark.range(1).select(names.schedule_code(F.lit(name))).first()[0]


def process_file_with_quality(
    spark: SparkSession, path: str, institutions: DataFrame, descriptions: DataFrame,
    rssd_ids: list[str] | None = None,
) -> dict[str, DataFrame]:
    """Strict long table, quality report and the busiest ids of one file."""
    wide = schedules.read_wide(spark, path)
    return {
        "rows": process_file(spark, path, institutions, descriptions, rssd_ids),
        "quality": quality.quality_report(wide),
        "available_ids": quality.available_ids(wide),
    }


def process_directory(
    spark: SparkSession, directory: str, institutions: DataFrame, descriptions: DataFrame,
    rssd_ids: list[str] | None = None, pattern: str = "*.txt", mode: str = "strict", quarters: bool = False,
) -> DataFrame:
    """Long table of every schedule file of a folder: one scan per distinct header, then a union."""
    listed = [(code, path) for code, path, _ in schedules.schedule_files(spark, directory, pattern)]
    order = {code: i for i, code in enumerate(sorted({code for code, _ in listed}))}
    parts = []
    for (code, header), paths in schedules.group_by_header(spark, listed).items():
        long = _long_of(spark, code, header, paths, institutions, descriptions, rssd_ids, mode, quarters)
        parts.append(long.withColumn("schedule_seq", F.lit(order[code])))
    return normalize.union_schedules(parts)


def _long_of(spark, code, header, paths, institutions, descriptions, rssd_ids, mode, quarters=False) -> DataFrame:
    wide = schedules.read_wide(spark, paths, rssd_ids, list(header))
    return _carried_long(wide, code, institutions, descriptions, mode, quarters)


def _carried_long(wide, code, institutions, descriptions, mode, quarters) -> DataFrame:
    """The long table with lineage, and the quarter in the file's name while there is one row per institution."""
    keys = ["quarter_key"] if quarters else []
    wide = schedules.with_file_quarter(wide) if quarters else wide
    carry = ["source_file", "source_path", "row_seq"]
    return normalize.to_long(wide, institutions, descriptions, code, keys=keys, carry=carry, mode=mode)


def header_error(header: tuple[str, ...]) -> str | None:
    """What keeps files with this header from being read, if anything does."""
    if not any(header):
        return "no header line"
    if dims.ID_COLUMN not in header:
        return f"no {dims.ID_COLUMN} column"
    if len(set(header)) < len(header):
        return "repeated column names"
    return None if schedules.code_columns(list(header)) else "no code columns"


def run_batch(
    spark: SparkSession, state: DataFrame, institutions: DataFrame, descriptions: DataFrame, output: str,
    quarter: str | None = None, rssd_ids: list[str] | None = None, mode: str = "strict",
    record: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """Process the pending files of a ledger and return the next ledger state.

    Files of one schedule and header are one job.  Its rows go into a folder of their own below
    ``output/schedule_code=...``, so that earlier runs' rows stay; rows and institutions are counted per file
    from what was written.  A file with a bad header fails alone, before any scan; if a job fails, its files are
    tried one by one and only those that fail again are recorded as failed.  ``record`` gets the state in which
    the files are marked as processing, before the work begins.  The files of the batch, not their rows, are
    listed on the driver.
    """
    todo = ledger.pending_files(state, quarter).select("filepath", "schedule_code").collect()
    if not todo:
        return state
    begun = spark.createDataFrame([(r.filepath, "processing", None) for r in todo], _OUTCOME)
    state = ledger.set_status(state, begun)
    if record:
        record(state)
    run, outcomes, written = uuid.uuid4().hex, [], []

    def attempt(code, header, paths, name) -> str | None:
        target = f"{output.rstrip('/')}/schedule_code={code}/run={run}-{name}"
        try:
            long = _long_of(spark, code, header, paths, institutions, descriptions, rssd_ids, mode)
            long.drop("schedule_code").write.mode("errorifexists").parquet(target)
        except Exception as error:  # noqa: BLE001 - any failure of a file is an outcome, not an end
            return (str(error).splitlines() or [type(error).__name__])[0]
        written.append(target)
        outcomes.extend((p, "completed", None) for p in paths)
        return None

    groups = schedules.group_by_header(spark, sorted((r.schedule_code, r.filepath) for r in todo))
    for number, ((code, header), paths) in enumerate(groups.items()):
        bad = header_error(header)
        if bad:
            outcomes.extend((p, "failed", bad) for p in paths)
        elif error := attempt(code, header, paths, number):
            for i, path in enumerate(paths):
                again = attempt(code, header, [path], f"{number}-{i}") if len(paths) > 1 else error
                if again:
                    outcomes.append((path, "failed", again))
    results = spark.createDataFrame(outcomes, _OUTCOME)
    state = ledger.set_status(state, results)
    if not written:
        return state
    counts = normalize.union_schedules([compare.file_counts(spark.read.parquet(p)) for p in written])
    done = results.filter(F.col("status") == "completed").join(counts, F.col("filepath") == F.col("source_path"))
    return ledger.mark_processed(state, done.select("filepath", "row_count", "institution_count"))


_OUTCOME = "filepath string, status string, error string"


def document_tables(docs: DataFrame, min_rows: int = 3, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows of all tables of filing documents (keys, company, path, content): routed by kind, extracted, named.

    Pages give their financial tables of ``min_rows`` rows or more, named by section; tagged documents give one table per
    fact group with item, value, context and unit; delimited documents give one table per section.  Every row
    carries the document's company, kind and period.
    """
    ids = list(keys)
    routed = docs.withColumn("kind", documents.document_kind(F.col("path"), F.col("content")))
    of = lambda kind: routed.filter(F.col("kind") == kind)
    profiled = tables.table_profile(documents.table_grids(documents.html_tables(of("html"), "content", keys)))
    sections = tables.tables_with_sections(of("html"), "content", keys).select(*ids, "table_ix", "keyword")
    found = tables.financial_tables(profiled, min_rows).join(sections, [*ids, "table_ix"], "left")
    name = names.table_name(F.lit("TABLE"), F.coalesce("keyword", F.lit("Unnamed")), F.col("table_ix"))
    pages = found.select(*ids, name.alias("table_name"), F.posexplode("cells").alias("row_ix", "cells"))
    facts = tables.fact_groups(documents.facts(of("xbrl"), "content", keys), ids)
    tagged = facts.select(*ids, "table_name", F.col("fact_ix").alias("row_ix"), F.array("category", "value", "context", "unit").alias("cells"))
    lines = tables.delimited_sections(documents.delimited_lines(of("delimited"), "content", keys), ids)
    listed = lines.select(*ids, "table_name", F.col("line_no").alias("row_ix"), "cells")
    about = routed.select(*ids, "company", "kind", F.when(F.col("kind") == "xbrl", documents.report_period(F.col("content"))).alias("period_end"))
    return pages.unionByName(tagged).unionByName(listed).join(about, ids)


def dashboard(
    long: DataFrame, peers: DataFrame, keys: list[str], order: str = "row_seq", table: DataFrame | None = None
) -> dict[str, DataFrame]:
    """The named tables of the executive dashboard, over one stored metric table (``table``, or worked out from ``long``)."""
    table = stored(metrics.institution_metrics(long, keys, order) if table is None else table, "metrics")
    members = compare.attach_peers(table, peers)
    ids = ["rssd_id", *keys]
    return {
        "metrics": table,
        "total_assets": compare.share_of_largest(members, [*keys, "peer_group"]).select(
            *ids, "peer_group", "total_assets", "pct_of_largest"
        ),
        "ratios": compare.ratio_table(members, keys),
        "risk_flags": metrics.risk_flags(table, ids),
        "top_items": compare.top_items(long, ids),
    }


def key_metrics(
    long: DataFrame, peers: DataFrame, keys: list[str], order: str = "row_seq", table: DataFrame | None = None
) -> dict[str, DataFrame]:
    """The named tables of the key-metric report, over one stored metric table (``table``, or worked out from ``long``)."""
    table = stored(metrics.institution_metrics(long, keys, order) if table is None else table, "metrics")
    members = compare.attach_peers(table, peers)
    return {
        "metrics": table,
        "sections": compare.metric_sections(members, keys),
        "statistics": compare.peer_statistics(members, keys),
    }


def _cells(df: DataFrame, table: str, columns: list[str], item: Column | None = None) -> DataFrame:
    """One row per cell: the columns are the items, or the members of ``item``; text goes into ``content``."""
    types = dict(df.dtypes)
    none = F.lit(None).cast("string")
    cell = lambda c: F.struct(
        F.lit(table).alias("table"), (F.lit(c) if item is None else item).alias("item"), (none if item is None else F.lit(c)).alias("member"),
        (F.lit(None) if types[c] == "string" else F.col(c)).cast("double").alias("value"), (F.col(c) if types[c] == "string" else none).alias("content"),
    )
    keys = [c for c in df.columns if c not in columns]
    return df.select(*keys, F.inline(F.array(*[cell(c) for c in columns])))


def _member_cells(df: DataFrame, table: str, item: Column, keys: list[str], beside: list[str]) -> DataFrame:
    """One row per member of a group, whatever their number, and one for each column ``beside``; rows that are only labels have none.

    All of them come from one pass, so that the members are brought side by side once.
    """
    types = dict(df.dtypes)

    def cell(member: Column, value: Column | None = None, content: Column | None = None) -> Column:
        value, content = (F.lit(None) if c is None else c for c in (value, content))
        return F.struct(member.alias("member"), value.cast("double").alias("value"), content.cast("string").alias("content"))

    who = lambda i: F.when(i == 0, compare.member_name(0)).otherwise(F.concat(F.lit("peer_"), i.cast("string")))
    members = F.transform("members", lambda v, i: cell(who(i), v))
    others = [cell(F.lit(c), content=F.col(c)) if types[c] == "string" else cell(F.lit(c), F.col(c)) for c in beside]
    rows = df.filter(F.col("members").isNotNull())
    return rows.select(*keys, "peer_group", F.lit(table).alias("table"), item.alias("item"), F.inline(F.concat(members, F.array(*others))))


def bundle_rows(parts: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """All tables of a bundle (``dashboard`` or ``key_metrics``) as one: table, keys, peer_group, rssd_id, item, member, value, content.

    Every table is whole, with all members of its groups; ``peer_group`` and ``rssd_id`` are null where a table has none.
    """
    def of(name: str, df: DataFrame) -> list[DataFrame]:
        if name in ("ratios", "sections"):
            item = F.col("label") if name == "ratios" else F.concat_ws(": ", "section", "label")
            cells = ["peer_avg", "status"] if name == "ratios" else ["peer_avg"]
            return [_member_cells(df, name, item, keys, cells)]
        if name == "statistics":
            return [_cells(df, name, ["mean", "median", "std_dev", "primary_percentile"], F.col("label"))]
        if name == "top_items":
            ranked = df.withColumnRenamed("amount_num", "value")
            return [ranked.withColumns({
                "table": F.lit(name), "item": F.col("mdrm_code"), "member": F.col("rank").cast("string"), "content": F.col("line_item"),
            })]
        return [_cells(df, name, [c for c in df.columns if c not in ("rssd_id", "peer_group", *keys)])]

    shown = ["table", *keys, "peer_group", "rssd_id", "item", "member", "value", "content"]
    rows = None
    for name, df in parts.items():
        for part in of(name, df):
            for missing, kind in (("peer_group", "bigint"), ("rssd_id", "string")):
                if missing not in part.columns:
                    part = part.withColumn(missing, F.lit(None).cast(kind))
            rows = part.select(*shown) if rows is None else rows.unionByName(part.select(*shown))
    return rows
