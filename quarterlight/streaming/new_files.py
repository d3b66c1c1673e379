"""Incremental pick-up of new schedule files with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from quarterlight import dims
from quarterlight.functions import names, text
from quarterlight.operators import normalize
from quarterlight.sources.schedules import code_columns, with_file_quarter


def stream_wide(spark: SparkSession, directory: str, header: list[str], pattern: str = "*.txt") -> DataFrame:
    """Streaming read of schedule files of one header."""
    schema = StructType([StructField(c, StringType()) for c in header])
    raw = (
        spark.readStream.schema(schema)
        .option("sep", "\t")
        .option("header", True)
        .option("enforceSchema", False)
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .csv(directory)
    )
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return raw.select(
        text.null_tokens(F.col(dims.ID_COLUMN)).alias(dims.ID_COLUMN),
        *[text.null_tokens(F.col(f"`{c}`")).alias(c) for c in code_columns(header)],
        names.file_name(path).alias("source_file"),
    )


def process_new_files(
    spark: SparkSession, directory: str, header: list[str], schedule: str, institutions: DataFrame,
    descriptions: DataFrame, output: str, checkpoint: str, mode: str = "strict", quarters: bool = False,
) -> StreamingQuery:
    """Process every file not seen before, append its long rows to ``output`` (with the file's quarter if asked), then stop.

    The checkpoint remembers processed files, and the file sink's log makes a restarted batch
    exactly-once.
    """
    wide = stream_wide(spark, directory, header)
    wide = with_file_quarter(wide) if quarters else wide
    keys = ["quarter_key"] if quarters else []
    long = normalize.to_long(wide, institutions, descriptions, schedule, keys=keys, carry=["source_file"], mode=mode)
    return (
        long.writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
