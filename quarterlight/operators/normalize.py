"""Wide schedule rows to the long table: one row per institution and reported code."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterlight import dims
from quarterlight.functions import names, text
from quarterlight.operators.joins import computed_once, lookup_join
from quarterlight.sources.schedules import code_columns

LONG_COLUMNS = ("rssd_id", "name", "line_item", "description", "mdrm_code", "amount")


def valid_id(rssd_id: Column) -> Column:
    trimmed = text.strip(rssd_id)
    return rssd_id.isNotNull() & (trimmed != "") & (trimmed != "nan")


def unpivot_codes(wide: DataFrame, ids: list[str], codes: list[str] | None = None, in_place: bool = False) -> DataFrame:
    """(ids, mdrm_code, raw): one row per code cell, blank cells included.

    Of an unpivoted table Spark does not know how it is dealt; with ``in_place`` the same rows are generated, and it still knows.
    """
    codes = codes if codes is not None else code_columns(wide.columns)
    if in_place:
        cells = [F.struct(F.lit(c).alias("mdrm_code"), F.col(f"`{c}`").alias("raw")) for c in codes]
        return wide.select(*ids, F.inline(F.array(*cells)))
    return wide.unpivot(ids, codes, "mdrm_code", "raw")


def keep_reported(cells: DataFrame, mode: str = "strict") -> DataFrame:
    """Replace ``raw`` by ``amount`` and ``amount_num``.

    ``strict`` cleans the text and drops cells that are not numbers; ``raw`` drops blank cells only.
    """
    if mode == "raw":
        kept = cells.filter(F.col("raw").isNotNull() & (text.strip(F.col("raw")) != ""))
        return kept.withColumnRenamed("raw", "amount").withColumn("amount_num", text.amount_number(F.col("amount")))
    if mode != "strict":
        raise ValueError(f"mode must be 'strict' or 'raw', not {mode!r}")
    cleaned = computed_once(cells, "amount", text.strict_amount(F.col("raw"))).drop("raw")
    numbers = computed_once(cleaned.filter(F.col("amount").isNotNull()), "amount_num", text.strict_number(F.col("amount")))
    return numbers.filter(F.col("amount_num").isNotNull())


def with_names(rows: DataFrame, institutions: DataFrame) -> DataFrame:
    """Institution name by id; an unknown id is called "Institution <id>"."""
    named = lookup_join(rows, institutions.select("rssd_id", "name"), ["rssd_id"])
    return named.withColumn("name", F.coalesce("name", default_name(F.col("rssd_id"))))


def default_name(rssd_id: Column) -> Column:
    return F.concat(F.lit("Institution "), rssd_id)


def fallback_description(code: Column, schedule_name: Column) -> Column:
    """"<kind> item - <schedule name>" from the code's first four characters."""
    prefix = F.substring(code, 1, 4)
    word = prefix
    for known, phrase in dims.PREFIX_WORDS.items():
        word = F.when(prefix == known, phrase).otherwise(word)
    return F.concat(word, F.lit(" item - "), schedule_name)


def with_schedule_info(rows: DataFrame) -> DataFrame:
    """Schedule name, prefix and description; an unknown schedule is named by its code."""
    info = F.broadcast(dims.schedules(rows.sparkSession))
    joined = rows.join(info, "schedule_code", "left")
    return joined.withColumn("schedule_name", F.coalesce("schedule_name", "schedule_code"))


def with_line_items(rows: DataFrame) -> DataFrame:
    """Line item by (schedule, code); else the first mapped code that ends like the code's number.

    Both lookups are equality joins with fixed tables of at most 704 rows.
    """
    spark = rows.sparkSession
    number = F.when(F.length("mdrm_code") > 4, F.substr(F.col("mdrm_code"), F.lit(5))).otherwise(F.col("mdrm_code"))
    keyed = rows.withColumns({"base_schedule": names.base_schedule(F.col("schedule_code")), "code_suffix": number})
    exact = F.broadcast(dims.line_items(spark).drop("position"))
    similar = F.broadcast(dims.line_item_suffixes(spark))
    joined = keyed.join(exact, ["base_schedule", "mdrm_code"], "left").join(
        similar, ["base_schedule", "code_suffix"], "left"
    )
    return joined.withColumn("line_item", F.coalesce("line_item", "suffix_item", F.lit(""))).drop(
        "base_schedule", "code_suffix", "suffix_item"
    )


def code_dimension(
    spark: SparkSession, codes: list[tuple[str, str]], descriptions: DataFrame, mode: str = "strict"
) -> DataFrame:
    """schedule_code, mdrm_code, code_seq, schedule_seq, line_item, description for header columns.

    It has one row per code column of the files' headers, whatever the data size and however large
    the dictionary is, so joining it to the long table is always a broadcast.
    """
    order = {s: i for i, s in enumerate(sorted({s for s, _ in codes}))}
    listed = dims.literal_rows(
        spark,
        "schedule_code string, schedule_seq int, mdrm_code string, code_seq int",
        [(s, order[s], c, i) for i, (s, c) in enumerate(codes)],
    )
    described = listed.join(descriptions.select("mdrm_code", "description"), "mdrm_code", "left")
    described = with_schedule_info(with_line_items(described))
    known = F.coalesce("description", F.lit(""))
    if mode == "strict":
        fallback = fallback_description(F.col("mdrm_code"), F.col("schedule_name"))
        known = F.when(known == "", fallback).otherwise(known)
    return described.select(
        "schedule_code", "schedule_seq", "mdrm_code", "code_seq", "line_item", known.alias("description")
    )


def to_long(
    wide: DataFrame,
    institutions: DataFrame,
    descriptions: DataFrame,
    schedule_of: str | dict[str, str],
    keys: list[str] | None = None,
    carry: list[str] | None = None,
    mode: str = "strict",
    rssd_ids: list[str] | None = None,
    codes: list[str] | None = None,
    spread: bool = False,
    attach: Callable[[DataFrame], DataFrame] | None = None,
    together: list[str] | None = None,
) -> DataFrame:
    """Wide schedule rows to the long table.

    ``schedule_of`` is the schedule of the file, or a map code -> schedule for a frame that already
    holds several schedules side by side.  ``keys`` are further key columns (such as the quarter) and
    ``carry`` lineage columns to keep.  Names are joined before the unpivot, where there is one row
    per institution; after it only the header-sized code table is joined.

    A row becomes one for each code, so a task that holds few megabytes of wide rows may have to group or sort gigabytes of cells.
    ``spread`` deals the wide rows to as many tasks as the session has shuffle partitions, for a long table that is grouped next.

    ``attach`` joins further columns by ``rssd_id`` while there is one row per institution; they stay in the long table.  ``together``
    names columns among those that the long table is grouped by next: wide rows that agree in them are dealt to one task, so that the
    grouping finds its cells there and shuffles none.  It is for groups of which a task can sort the cells.
    """
    keys, carry = keys or [], carry or []
    codes = codes if codes is not None else code_columns(wide.columns)
    rows = wide
    if rssd_ids:
        rows = rows.filter(F.col(dims.ID_COLUMN).isin(*[str(i) for i in rssd_ids]))
    if mode == "strict":
        rows = rows.filter(valid_id(F.col(dims.ID_COLUMN)))
    rssd = text.strip(F.col(dims.ID_COLUMN)) if mode == "strict" else F.col(dims.ID_COLUMN)
    rows = rows.select(rssd.alias("rssd_id"), *keys, *carry, *[F.col(f"`{c}`") for c in codes])
    rows = with_names(rows, institutions)
    ids = ["rssd_id", "name", *keys, *carry]
    attached = []
    if attach:
        rows = attach(rows)
        attached = [c for c in rows.columns if c not in {*ids, *codes}]
    if spread or together:
        rows = rows.repartition(int(wide.sparkSession.conf.get("spark.sql.shuffle.partitions")), *(together or []))
    of = (lambda c: schedule_of) if isinstance(schedule_of, str) else schedule_of.__getitem__
    dimension = code_dimension(wide.sparkSession, [(of(c), c) for c in codes], descriptions, mode)
    # Before the cleaning, so that a later filter on schedules or codes leaves the other cells uncleaned.
    cells = unpivot_codes(rows, [*ids, *attached], codes, in_place=bool(together)).join(F.broadcast(dimension), "mdrm_code")
    return keep_reported(cells, mode).select(
        "rssd_id", *keys, "name", "schedule_code", "line_item", "description", "mdrm_code", "amount",
        "amount_num", "schedule_seq", "code_seq", *carry, *attached,
    )


def union_schedules(parts: list[DataFrame]) -> DataFrame:
    """Bag union of long tables; a column missing in one part is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def for_institutions(rows: DataFrame, rssd_ids: list[str]) -> DataFrame:
    """Rows of the given institutions only."""
    return rows.filter(F.col("rssd_id").isin(*[str(i) for i in rssd_ids]))


def numeric_amount(rows: DataFrame, column: str = "amount") -> DataFrame:
    """``amount_value`` as number next to the text, null where the text is not a number."""
    return rows.withColumn("amount_value", text.amount_number(F.col(column)))


def cleaning_statistics(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of skipped, withheld, invalid and kept cells of an unpivoted table."""
    status = text.amount_status(F.col("raw"))
    return (
        cells.select(*keys, status.alias("status"))
        .groupBy(*keys)
        .agg(
            F.count("*").alias("cells"),
            *[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("skipped", "withheld", "invalid", "ok")],
        )
    )
