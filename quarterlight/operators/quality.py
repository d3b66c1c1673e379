"""Data-quality report of a wide schedule table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterlight import dims
from quarterlight.sources.schedules import quality_columns


def quality_report(wide: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows, institutions, density and the list of issues, per key or for the whole table."""
    keys = keys or []
    codes = quality_columns(wide.columns)
    has_id = dims.ID_COLUMN in wide.columns
    filled = sum((F.count(f"`{c}`") for c in codes), start=F.lit(0).cast("bigint"))
    ids = F.countDistinct(dims.ID_COLUMN) if has_id else F.lit(0).cast("bigint")
    # One distinct column costs no extra rows: partial counts are kept per id, then merged.
    counts = wide.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), filled.alias("filled_cells"), ids.alias("institutions")
    )
    cells = F.col("n_rows") * len(codes)
    density = F.when(cells > 0, F.col("filled_cells") / F.nullif(cells.cast("double"), F.lit(0.0)) * 100)
    report = counts.withColumn("density_pct", F.coalesce(density, F.lit(0.0)))
    shown = F.format_string("%.1f%%", F.col("density_pct"))
    issues = F.when(F.col("n_rows") == 0, F.array(F.lit("No data rows found"))).otherwise(
        F.array_compact(
            F.array(
                F.when(F.col("institutions") == 0, "No valid institution IDs found"),
                F.lit(None if codes else "No MDRM code columns found").cast("string"),
                F.when(F.lit(bool(codes)) & (F.col("density_pct") < 1), F.concat(F.lit("Very low data density: "), shown)).when(
                    F.lit(bool(codes)) & (F.col("density_pct") < 10), F.concat(F.lit("Low data density: "), shown)
                ),
            )
        )
    )
    if not has_id:
        issues = F.concat(F.array(F.lit(f"Missing required {dims.ID_COLUMN} column")), issues)
    return report.withColumn("issues", F.array_join(issues, "; "))


def available_ids(wide: DataFrame, top: int = 10) -> DataFrame:
    """The ids with the most rows."""
    counted = wide.groupBy(dims.ID_COLUMN).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col(dims.ID_COLUMN).isNotNull())
    return counted.orderBy(F.desc("n_rows"), dims.ID_COLUMN).limit(top)
