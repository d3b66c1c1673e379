"""Ranks, medians and shares inside groups of any size.

Equal values are counted first, so that ties are one row.  The distinct values are dealt to ranges (a global sort's
partitions), counted inside each range, and the ranges' totals, one row for each range and group, are added up in order.  No task holds
more than one range, whatever a group's size, and values that are equal are never in two ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quarterlight.session import stored


def value_counts(rows: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """by, value, n: with partial counts on the map side."""
    return rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def cumulative(counts: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Add ``upto``, the number of rows of a group whose value is at most this one (a missing value is the smallest)."""
    # Stored, as a range's number must be the same wherever it is used.
    ranged = stored(counts.repartitionByRange(*by, value).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range", *by).agg(F.sum("n").alias("_total"))
    totals = totals.select("_range", *by, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    local = ranged.withColumn("_local", F.sum("n").over(inside))
    return local.join(totals, ["_range", *by]).withColumn("upto", F.col("_before") + F.col("_local")).drop("_range", "_before", "_local")


def percentile_ranks(rows: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Add ``percentile``: the percentage of a group's rows whose value is at most the row's own."""
    counts = stored(value_counts(rows, by, value), "counts")
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_all"))
    shares = cumulative(counts, by, value).join(totals, by)
    shares = shares.select(*[F.col(c).alias(f"_{c}") for c in (*by, value)], (F.col("upto") / F.col("_all") * 100).alias("percentile"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) if c == value else F.col(c) == F.col(f"_{c}") for c in (*by, value)]
    return rows.join(shares, same, "left").drop(*[f"_{c}" for c in (*by, value)])


def statistics(counts: DataFrame, by: list[str], chosen: DataFrame, value: str = "value") -> DataFrame:
    """by, size, mean, median, std_dev (population), percentile of each group's ``chosen`` (by, own).

    ``counts`` has (by, value, n), without missing values.
    """
    info = counts.groupBy(*by).agg(F.sum("n").alias("size"), (F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("mean"))
    joined = cumulative(counts, by, value).join(info.join(chosen, by, "left"), by)
    n, upto, v = F.col("n"), F.col("upto"), F.col(value)

    def at(rank: Column) -> Column:
        """The value at a rank that counts from one."""
        return F.max(F.when((upto >= rank) & (upto - n < rank), v))

    low, high = F.floor((F.col("size") - 1) / 2) + 1, F.floor(F.col("size") / 2) + 1
    return joined.groupBy(*by).agg(
        F.first("size").alias("size"),
        F.first("mean").alias("mean"),
        ((at(low) + at(high)) / 2).alias("median"),
        F.sqrt(F.sum((v - F.col("mean")) * (v - F.col("mean")) * n) / F.sum(n)).alias("std_dev"),
        (F.sum(F.when(v <= F.col("own"), n).otherwise(0)) / F.sum(n) * 100).alias("percentile"),
    )
