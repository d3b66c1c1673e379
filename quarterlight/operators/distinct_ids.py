"""Exact numbers of distinct institutions over any union of files, without reading the files' rows again.

The institutions of a file are kept as bitmaps: a whole-number id is one bit of a fixed-size bitmap of its bucket, and files
are put together by "or".  Ids that are not whole numbers in their usual form (letters, leading zeros, more than 18
digits) are kept as they are, once per file, so that counts stay exact for them too.  Null ids don't count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WHOLE = "^(0|[1-9][0-9]{0,17})$"


def id_bitmaps(rows: DataFrame, keys: list[str], id_column: str = "rssd_id") -> DataFrame:
    """(keys, bucket, bitmap, text_id): one row for each bucket of whole-number ids and for each other id.

    Bits are set on the map side, so a file of any number of rows shuffles its bitmaps only.
    """
    value = F.col(id_column)
    number = F.when(value.rlike(_WHOLE), value.try_cast("bigint"))
    coded = rows.filter(value.isNotNull()).select(
        *keys, F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("position"),
        F.when(number.isNull(), value).alias("text_id"),
    )
    return coded.groupBy(*keys, "bucket", "text_id").agg(
        F.bitmap_construct_agg(F.coalesce("position", F.lit(0).cast("bigint"))).alias("bitmap")
    ).select(*keys, "bucket", F.when(F.col("text_id").isNull(), F.col("bitmap")).alias("bitmap"), "text_id")


def merged(bitmaps: DataFrame, keys: list[str]) -> DataFrame:
    """The bitmaps of coarser groups, or of all files (no keys): an "or" with partial results, of the same form."""
    return bitmaps.groupBy(*keys, "bucket", "text_id").agg(F.bitmap_or_agg("bitmap").alias("bitmap")).select(
        *keys, "bucket", F.when(F.col("text_id").isNull(), F.col("bitmap")).alias("bitmap"), "text_id"
    )


def id_counts(bitmaps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, institutions): the number of distinct ids in each group of files; with no keys, one row for all of them."""
    ids = F.coalesce(F.bitmap_count("bitmap"), F.lit(1))
    return merged(bitmaps, keys).groupBy(*keys).agg(F.coalesce(F.sum(ids), F.lit(0)).alias("institutions"))
