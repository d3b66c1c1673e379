"""Join and running-value helpers that stay balanced when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def lookup_join(rows: DataFrame, lookup: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join rows with a lookup that is unique per key, without any hint.

    Spark broadcasts the lookup when its true size is under ``spark.sql.autoBroadcastJoinThreshold``.  Beyond that
    both sides are shuffled, and adaptive execution splits a key that holds much of the rows by measured sizes
    (``spark.sql.adaptive.skewJoin``), however many tasks that takes.
    """
    return rows.join(lookup, on, how)


def running_values(
    rows: DataFrame,
    keys: list[str],
    order: str,
    sums: dict[str, Column] | None = None,
    carried: dict[str, Column] | None = None,
    block_rows: int = 65536,
) -> DataFrame:
    """Running sums and last-non-null values per key in ``order``, computed block by block.

    ``order`` is a whole-number position, unique per key.  Positions are cut into blocks; a window
    runs inside each (key, block), the blocks are reduced to one row each, and only those block rows
    are scanned per key.  A key with billions of rows is therefore spread over many tasks.
    """
    sums, carried = sums or {}, carried or {}
    block = F.floor(F.col(order) / F.lit(block_rows)).cast("bigint")
    base = rows.withColumn("_block", block)
    cells = {f"_s_{n}": c for n, c in sums.items()} | {f"_c_{n}": c for n, c in carried.items()}
    base = base.withColumns(cells)

    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = base.withColumns(
        {f"_s_{n}": F.sum(f"_s_{n}").over(inside) for n in sums}
        | {f"_c_{n}": F.last(f"_c_{n}", ignorenulls=True).over(inside) for n in carried}
    )

    # max_by skips null orderings, so rows without a value never win.
    totals = base.groupBy(*keys, "_block").agg(
        *[F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums],
        *[
            F.max_by(f"_c_{n}", F.when(F.col(f"_c_{n}").isNotNull(), F.col(order))).alias(f"_u_{n}")
            for n in carried
        ],
    )
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys,
        "_block",
        *[F.sum(f"_t_{n}").over(before).alias(f"_t_{n}") for n in sums],
        *[F.last(f"_u_{n}", ignorenulls=True).over(before).alias(f"_u_{n}") for n in carried],
    )
    joined = local.join(carry, [*keys, "_block"], "left")
    final = {n: F.coalesce(F.col(f"_t_{n}"), F.lit(0)) + F.col(f"_s_{n}") for n in sums} | {
        n: F.coalesce(F.col(f"_c_{n}"), F.col(f"_u_{n}")) for n in carried
    }
    helpers = [f"_{p}_{n}" for n in sums for p in "st"] + [f"_{p}_{n}" for n in carried for p in "cu"]
    return joined.withColumns(final).drop("_block", *helpers)


def computed_once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters use.

    A filter on a plain projected column is pushed below the projection, where its expression is
    evaluated a second time; a generated column is evaluated once.
    """
    return rows.select("*", F.inline(F.array(F.struct(value.alias(name)))))
