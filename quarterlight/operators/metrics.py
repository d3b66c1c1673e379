"""Base metrics, ratios and their ratings: one row per institution (and quarter)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterlight import dims
from quarterlight.functions import ratios, text
from quarterlight.operators import normalize
from quarterlight.sources.schedules import code_columns

_CODE_SLOTS = 64  # more than the longest list of alternatives


def metric_code_list() -> list[str]:
    return sorted({c for codes in dims.METRIC_CODES.values() for c in codes})


def first_reported(long: DataFrame, keys: list[str], order: str = "row_seq") -> DataFrame:
    """The first row, by ``order``, of every (institution, schedule, code), its amount parsed or null."""
    order_col = F.col(order)
    return long.groupBy(*keys, "schedule_seq", "mdrm_code").agg(
        F.min_by("amount_num", order_col).alias("value")
    )


def _first_of(codes: tuple[str, ...]) -> Column:
    """Value of the first schedule, then the first listed code, that has a number; else 0.

    The rank is a whole number so that the aggregation can run as a hash aggregation with map-side
    partial results; the rows of one institution are never gathered.
    """
    code_rank = F
    for rank, code in enumerate(codes):
        code_rank = code_rank.when(F.col("mdrm_code") == code, rank)
    rank = F.when(F.col("value").isNotNull(), F.col("schedule_seq") * _CODE_SLOTS + code_rank)
    return F.coalesce(F.min_by("value", rank), F.lit(0.0))


def base_metrics(long: DataFrame, keys: list[str] | None = None, order: str = "row_seq") -> DataFrame:
    """The 34 base metrics of every institution in one pass over the long table."""
    keys = ["rssd_id", *(keys or [])]
    # Other codes fold into one null code, so an institution without any metric code keeps its row.
    code = F.when(F.col("mdrm_code").isin(*metric_code_list()), F.col("mdrm_code"))
    firsts = first_reported(long.withColumn("mdrm_code", code), keys, order)
    aggregates = []
    for metric, codes in dims.METRIC_CODES.items():
        if metric == "total_deposits":
            first, second = (_first_of(c) for c in dims.DEPOSIT_COMPONENTS)
            aggregates.append((first + second).alias(metric))
        else:
            aggregates.append(_first_of(codes).alias(metric))
    return firsts.groupBy(*keys).agg(*aggregates)


def wide_base_metrics(
    frames: list[tuple[DataFrame, str | dict[str, str]]], keys: list[str] | None = None, order: str = "row_seq"
) -> DataFrame:
    """The same base metrics straight from wide schedule rows: (frame, its schedule or code -> schedule).

    Only metric codes are read and cleaned, and one row per institution and file is shuffled instead of
    one row per cell.  ``order`` is the column that orders repeated rows of an institution.
    """
    keys = keys or []
    parts, slots = [], set()
    for wide, schedule_of in frames:
        of = (lambda c, s=schedule_of: s) if isinstance(schedule_of, str) else schedule_of.__getitem__
        codes = [c for c in code_columns(wide.columns) if c in set(metric_code_list())]
        rows = wide.filter(normalize.valid_id(F.col(dims.ID_COLUMN)))
        cells = F.array(*[F.col(f"`{c}`") for c in codes]).cast("array<string>")
        numbers = F.transform(
            F.transform(F.transform(cells, text.strip), text.stripped_amount), text.strict_number
        )
        rows = rows.select(text.strip(F.col(dims.ID_COLUMN)).alias("rssd_id"), *keys, order, numbers.alias("_n"))
        named = {c: f"{of(c)}|{c}" for c in codes}
        slots |= set(named.values())
        parts.append(
            rows.select("rssd_id", *keys, order, *[F.get("_n", F.lit(i)).alias(named[c]) for i, c in enumerate(codes)])
        )

    def reported(slot: str) -> Column:
        value = F.col(f"`{slot}`")
        return F.min_by(value, F.when(value.isNotNull(), F.col(order))).alias(slot)

    grouped = normalize.union_schedules(parts).groupBy("rssd_id", *keys).agg(*[reported(s) for s in sorted(slots)])

    def first_of(codes: tuple[str, ...]) -> Column:
        ranked = sorted((s.split("|")[0], codes.index(s.split("|")[1]), s) for s in slots if s.split("|")[1] in codes)
        return F.coalesce(*[F.col(f"`{s}`") for _, _, s in ranked], F.lit(0.0))

    metrics = {m: first_of(codes) for m, codes in dims.METRIC_CODES.items()}
    first, second = dims.DEPOSIT_COMPONENTS
    metrics["total_deposits"] = first_of(first) + first_of(second)
    return grouped.select("rssd_id", *keys, *[c.alias(m) for m, c in metrics.items()])


def lookup_metrics(long: DataFrame, keys: list[str] | None = None, order: str = "row_seq") -> DataFrame:
    """(keys, metric, value, mdrm_code): which code supplied each plain metric, absent when none did."""
    keys = ["rssd_id", *(keys or [])]
    listed = dims.metric_codes(long.sparkSession).filter(F.col("metric") != "total_deposits")
    matched = (
        first_reported(long.filter(F.col("mdrm_code").isin(*metric_code_list())), keys, order)
        .filter(F.col("value").isNotNull())
        .join(F.broadcast(listed), "mdrm_code")
    )
    rank = F.col("schedule_seq") * _CODE_SLOTS + F.col("code_rank")
    return matched.groupBy(*keys, "metric").agg(
        F.min_by("value", rank).alias("value"), F.min_by("mdrm_code", rank).alias("mdrm_code")
    )


def with_ratios(metrics: DataFrame) -> DataFrame:
    """Add profitability, asset-liability and composition ratios to the base metrics."""
    return metrics.withColumns(
        ratios.profitability(F.col) | ratios.asset_liability(F.col) | ratios.composition(F.col)
    )


def institution_metrics(
    long: DataFrame, keys: list[str] | None = None, order: str = "row_seq"
) -> DataFrame:
    """Base metrics and ratios of every institution (and quarter)."""
    return with_ratios(base_metrics(long, keys, order))


def rate_ratios(metrics: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, label, metric, value, status): the six headline ratios with their ratings."""
    items = F.array(
        *[F.struct(F.lit(l).alias("label"), F.lit(m).alias("metric"), F.col(m).alias("value")) for l, m in dims.RATIO_TABLE]
    )
    rows = metrics.select(*ids, F.inline(items))
    return rows.withColumn("status", ratios.ratio_status(F.col("metric"), F.col("value")))


def benchmark_table(metrics: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, label, value, benchmark, note): headline ratios next to the fixed industry ranges."""
    items = F.array(
        *[
            F.struct(
                F.lit(l).alias("label"), F.col(m).alias("value"), F.lit(b).alias("benchmark"), F.lit(n).alias("note")
            )
            for l, m, b, n in dims.BENCHMARKS
        ]
    )
    return metrics.select(*ids, F.inline(items))


def risk_flags(metrics: DataFrame, ids: list[str]) -> DataFrame:
    """Credit quality, rate gap and liquidity flags of every institution."""
    return metrics.select(
        *ids,
        "npl_ratio",
        ratios.problem_loan_status(F.col("npl_ratio")).alias("npl_status"),
        "ir_sensitivity_ratio",
        "gap_ratio",
        ratios.gap_flag(F.col("gap_ratio")).alias("gap_flag"),
        "earning_asset_yield",
        "cost_of_funds",
        "liquid_assets_ratio",
        ratios.liquidity_flag(F.col("liquid_assets_ratio")).alias("liquidity_flag"),
        "wholesale_funding_ratio",
        ratios.wholesale_flag(F.col("wholesale_funding_ratio")).alias("wholesale_flag"),
        "deposit_stability_ratio",
        ratios.stability_flag(F.col("deposit_stability_ratio")).alias("stability_flag"),
    )
