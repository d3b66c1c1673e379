"""Peer groups side by side: metric matrices, statistics, comparison pivots, rankings, validation.

A peer group has one primary (ordinal 0) and its peers; groups are compared all at once.  Averages, statistics and
the ``members`` array cover every member, whatever the group's size; ``columns`` only says how many members are also
shown in a column of their own.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarterlight import dims
from quarterlight.functions import names, ratios
from quarterlight.operators import ranks
from quarterlight.operators.joins import lookup_join
from quarterlight.session import stored


def member_name(ordinal: int) -> str:
    return "primary" if ordinal == 0 else f"peer_{ordinal}"


def peer_groups(members: DataFrame) -> DataFrame:
    """peer_group, rssd_id, ordinal, set_size from (peer_group, rssd_id, seq).

    Repeated members and a peer equal to the primary are left out: each id counts once, at its first
    position.
    """
    first = members.groupBy("peer_group", "rssd_id").agg(F.min("seq").alias("seq"))
    in_order = Window.partitionBy("peer_group").orderBy("seq")
    whole = Window.partitionBy("peer_group")
    return first.select(
        "peer_group",
        "rssd_id",
        (F.row_number().over(in_order) - 1).alias("ordinal"),
        F.count(F.lit(1)).over(whole).cast("int").alias("set_size"),
    )


def large_peer_groups(members: DataFrame) -> DataFrame:
    """The same as ``peer_groups`` for groups of any size: places are counted in ranges, so no task holds a group."""
    first = members.groupBy("peer_group", "rssd_id").agg(F.min("seq").alias("seq"))
    place = F.struct("seq", "rssd_id").alias("place")
    counted = ranks.cumulative(first.select("peer_group", place, F.lit(1).cast("long").alias("n")), ["peer_group"], "place")
    sizes = first.groupBy("peer_group").agg(F.count(F.lit(1)).cast("int").alias("set_size"))
    placed = counted.select("peer_group", "place.rssd_id", (F.col("upto") - 1).cast("int").alias("ordinal"))
    return lookup_join(placed, sizes, ["peer_group"]).select("peer_group", "rssd_id", "ordinal", "set_size")


def attach_peers(rows: DataFrame, peers: DataFrame) -> DataFrame:
    """Rows of peer-group members, with group, ordinal and size (an institution in one group)."""
    return lookup_join(rows, peers, ["rssd_id"], how="inner")


def _side_by_side(peer_metrics: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row per (keys, group) with ``table``, an array of metrics for every member by ordinal (null without data).

    Members meet while there is still one row per institution, so that the shuffle carries that and not
    one row per printed item; the items are laid out afterwards, row by row.
    """
    values = F.array(*[F.col(m).cast("double") for m in metrics])
    grouped = peer_metrics.groupBy(*keys, "peer_group").agg(
        F.max("set_size").alias("set_size"), F.map_from_entries(F.collect_list(F.struct("ordinal", values))).alias("_by")
    )
    table = F.transform(F.sequence(F.lit(0), F.col("set_size") - 1), lambda i: F.try_element_at("_by", i))
    return grouped.withColumn("table", table).drop("_by")


def _laid_out(peer_metrics: DataFrame, keys: list[str], schema: str, items: list[tuple], columns: int) -> DataFrame:
    """Items (label columns ..., metric or None) with ``members``, and a column for each of the first ``columns``.

    A member without data counts as 0; columns beyond the group's size stay null.
    """
    metrics = list(dict.fromkeys(item[-1] for item in items if item[-1]))
    names_ = [field.split()[0] for field in schema.split(",")]
    labels = [dict(zip(names_, item)) | {"ix": metrics.index(item[-1]) if item[-1] else None} for item in items]
    listed = F.from_json(F.lit(json.dumps(labels)), f"array<struct<{dims.schema_fields(schema)}, ix:int>>")
    rows = _side_by_side(peer_metrics, keys, metrics).select("*", F.inline(listed))
    members = F.transform("table", lambda m: F.coalesce(F.get(m, F.col("ix")), F.lit(0.0)))
    rows = rows.select(*keys, "peer_group", "set_size", *names_, "ix", members.alias("members"))
    return rows.withColumns({member_name(i): F.get("members", F.lit(i)) for i in range(columns)})


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return total / F.nullif(F.size(values).cast("double"), F.lit(0.0))


def _peer_average() -> Column:
    peers = F.slice("members", F.lit(2), F.greatest(F.col("set_size") - 1, F.lit(0)))
    return F.when(F.col("set_size") > 1, _mean(peers))


def metric_sections(peer_metrics: DataFrame, keys: list[str], columns: int = dims.MAX_MEMBERS) -> DataFrame:
    """The seven metric sections: label rows with all members, columns for the first ones, and the peer average."""
    items = [
        (s, title, r, label, metric)
        for s, (title, listed) in enumerate(dims.METRIC_SECTIONS)
        for r, (label, metric) in enumerate(listed)
    ]
    matrix = _laid_out(peer_metrics, keys, "section_ix int, section string, row_ix int, label string", items, columns)
    matrix = matrix.withColumn("peer_avg", _peer_average())
    shown = [member_name(i) for i in range(columns)] + ["members", "peer_avg"]
    return matrix.withColumns({c: F.when(F.col("ix").isNotNull(), F.col(c)) for c in shown}).drop("ix")


def ratio_table(peer_metrics: DataFrame, keys: list[str], columns: int = dims.MAX_MEMBERS) -> DataFrame:
    """Six headline ratios: a rating for a group of one, all members, columns for the first ones, the peer average."""
    items = [(i, label, m, m) for i, (label, m) in enumerate(dims.RATIO_TABLE)]
    matrix = _laid_out(peer_metrics, keys, "row_ix int, label string, metric string", items, columns)
    status = F.when(F.col("set_size") == 1, ratios.ratio_status(F.col("metric"), F.col("primary")))
    return matrix.withColumns({"peer_avg": _peer_average(), "status": status}).drop("ix")


def peer_statistics(peer_metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, median, population deviation and the primary's percentile for five metrics, for groups of any size.

    Values are counted and ranked in ranges (``ranks``); a member without data counts as 0, in one row for all of them.
    """
    by = [*keys, "peer_group", "row_ix", "label"]
    items = F.array(
        *[
            F.struct(F.lit(i).alias("row_ix"), F.lit(label).alias("label"), (F.coalesce(F.col(m).cast("double"), F.lit(0.0)) / F.lit(d)).alias("value"))
            for i, (label, m, d) in enumerate(dims.STATISTIC_METRICS)
        ]
    )
    rows = stored(peer_metrics.select(*keys, "peer_group", "ordinal", "set_size", F.inline(items)), "values")
    groups = rows.groupBy(*by).agg(
        F.max("set_size").alias("set_size"), F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.when(F.col("ordinal") == 0, F.col("value"))), F.lit(0.0)).alias("own")
    )
    absent = groups.filter("set_size > n").select(*by, F.lit(0.0).alias("value"), (F.col("set_size") - F.col("n")).alias("n"))
    counts = ranks.value_counts(rows, by).unionByName(absent).groupBy(*by, "value").agg(F.sum("n").alias("n"))
    found = ranks.statistics(stored(counts, "counts"), by, groups.select(*by, "own"))
    return found.select(*by, "mean", "median", "std_dev", F.col("percentile").alias("primary_percentile"))


def percentile_ranks(peer_metrics: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Share of group members whose value is at most the member's own, for every member, in groups of any size."""
    items = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics]
    long = peer_metrics.select(*keys, "peer_group", "rssd_id", F.inline(F.array(*items)))
    return ranks.percentile_ranks(stored(long, "values"), [*keys, "peer_group", "metric"])


def share_of_largest(metrics: DataFrame, keys: list[str], value: str = "total_assets") -> DataFrame:
    """Percent of the largest value among the rows with the same keys; null if that is zero.

    The maximum is an aggregate joined back, not a window, so a large group is never sorted in one
    task; Spark broadcasts the per-key maxima when they are small.
    """
    keyed = metrics if keys else metrics.withColumn("_all", F.lit(1))
    by = keys or ["_all"]
    largest = keyed.groupBy(*by).agg(F.max(value).alias("largest"))
    joined = lookup_join(keyed, largest, by)
    share = F.col(value) / F.nullif(F.col("largest"), F.lit(0.0)) * 100
    return joined.withColumn("pct_of_largest", share).drop("_all")


def comparison(peer_rows: DataFrame, keys: list[str], order: list[str], columns: int = dims.MAX_MEMBERS) -> DataFrame:
    """Line items of each schedule side by side: ``amounts`` of all members, and columns for the first ones.

    Within a member the last row of a key wins; the description is the first one seen, members in
    order.  ``order`` are the columns that order a member's rows.
    """
    seq = F.struct(*[F.col(c) for c in order])
    item = [*keys, "peer_group", "schedule_code", "line_item", "mdrm_code"]
    # Texts are grouped by sorting.  Their hash comes first, so that almost all comparisons are of two numbers.
    peer_rows = peer_rows.withColumn("_item", F.xxhash64(*item))
    # One row per member first, with partial sums on the map side, so that repeated rows never gather.
    each = peer_rows.groupBy("_item", *item, "ordinal").agg(
        F.min_by(F.struct("description"), seq).alias("_d"), F.max("set_size").alias("set_size"), F.max_by("amount", seq).alias("amount")
    )
    grouped = each.groupBy("_item", *item).agg(
        F.min_by("_d", "ordinal")["description"].alias("description"),
        F.max("set_size").alias("set_size"),
        F.map_from_entries(F.collect_list(F.struct("ordinal", "amount"))).alias("_by"),
    )
    cell = lambda i: F.coalesce(F.try_element_at("_by", i), F.lit(dims.MISSING_CELL))
    whole = grouped.withColumn("amounts", F.transform(F.sequence(F.lit(0), F.col("set_size") - 1), cell)).drop("_by", "_item")
    shown = {member_name(i): F.get("amounts", F.lit(i)) for i in range(columns)}
    return whole.withColumns(shown).withColumn("sort_key", names.line_item_key(F.col("line_item")))


def comparison_summary(peer_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Schedules and rows of every member."""
    return peer_rows.groupBy(*keys, "peer_group", "ordinal", "rssd_id").agg(
        F.countDistinct("schedule_code").alias("schedules"), F.count(F.lit(1)).alias("n_rows")
    )


def schedules_in_use(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct schedules over all institutions."""
    return rows.select(*keys, "schedule_code").distinct()


def top_items(long: DataFrame, keys: list[str], schedule: str = "RC", top: int = 5) -> DataFrame:
    """The largest items of a schedule per institution, first reported first among equals.

    Spark limits each task to ``top`` rows per group before the shuffle (window group limit).
    """
    order = Window.partitionBy(*keys).orderBy(F.desc("amount_num"), "code_seq", "mdrm_code")
    ranked = (
        long.filter((F.col("schedule_code") == schedule) & F.col("amount_num").isNotNull())
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top)
    )
    return ranked.select(
        *keys, "rank", "line_item", "description", "mdrm_code", "amount_num"
    )


def validate_peers(peers: DataFrame, metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Two to four members per group, and how far apart their total assets are."""
    sized = attach_peers(metrics.select("rssd_id", *keys, "total_assets"), peers)
    positive = F.when(F.col("total_assets") > 0, F.col("total_assets"))
    checked = sized.groupBy(*keys, "peer_group").agg(
        F.max("set_size").alias("members"),
        F.count(positive).alias("sized"),
        F.max(positive).alias("largest"),
        F.min(positive).alias("smallest"),
    )
    apart = lambda factor: (F.col("sized") >= 2) & (F.col("largest") > F.col("smallest") * factor)
    return checked.withColumns(
        {
            "is_valid": F.col("members").between(dims.MIN_MEMBERS, dims.MAX_MEMBERS),
            "size_warning": F.when(apart(dims.LARGE_SIZE_GAP), "large")
            .when(apart(dims.NOTABLE_SIZE_GAP), "significant")
            .otherwise("none"),
        }
    ).drop("sized")


def amounts_per_schedule(long: DataFrame, keys: list[str]) -> DataFrame:
    """Number of amounts in each schedule (the report's "Total:" row is this count)."""
    return long.groupBy(*keys, "schedule_code").agg(F.count(F.when(F.col("amount") != "", 1)).alias("amounts"))


def report_summary(long: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and institutions per schedule, with the schedule's name."""
    from quarterlight.operators.normalize import with_schedule_info

    counted = long.groupBy(*keys, "schedule_code").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("rssd_id").alias("institutions")
    )
    return with_schedule_info(counted).select(*keys, "schedule_code", "schedule_name", "n_rows", "institutions")


def file_counts(long: DataFrame, file: str = "source_path") -> DataFrame:
    """Rows and distinct institutions that each file produced; files of one name in two folders are two files."""
    return long.groupBy(file).agg(
        F.count(F.lit(1)).alias("row_count"), F.countDistinct("rssd_id").alias("institution_count")
    )
