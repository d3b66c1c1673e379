"""JSON dictionaries: line-item descriptions, institution names, company tickers, filing indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterlight import dims

_SAMPLE_KEY = "_sample_codes"


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``value`` holds the whole JSON text, ``path`` where it came from."""
    return spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))


def _last_entries(documents: DataFrame, entries, key: str, value: str) -> DataFrame:
    """One row per key: of repeated keys, the last entry of the last file (by path, if the documents have one) counts."""
    path = F.col("path") if "path" in documents.columns else F.lit("")
    listed = documents.select(path.alias("_path"), F.posexplode(entries).alias("_pos", key, value))
    return listed.groupBy(key).agg(F.max_by(value, F.struct("_path", "_pos", value)).alias(value))


def code_descriptions(documents: DataFrame) -> DataFrame:
    """mdrm_code, description from JSON objects {code: description}, also when nested as samples."""
    nested = F.from_json("value", f"struct<`{_SAMPLE_KEY}`: map<string,string>>")[_SAMPLE_KEY]
    entries = F.coalesce(nested, F.from_json("value", "map<string,string>"))
    return _last_entries(documents, entries, "mdrm_code", "description")


def institution_names(documents: DataFrame) -> DataFrame:
    """rssd_id, name from JSON objects {id: name}."""
    return _last_entries(documents, F.from_json("value", "map<string,string>"), "rssd_id", "name")


def company_tickers(documents: DataFrame) -> DataFrame:
    """cik (ten digits), cik_raw, ticker, name from the ticker map."""
    schema = "map<string,struct<cik_str:bigint,ticker:string,title:string>>"
    company = documents.select(F.explode(F.from_json("value", schema)).alias("entry", "c"))
    raw = F.col("c.cik_str").cast("string")
    return company.select(
        F.lpad(raw, 10, "0").alias("cik"),
        raw.alias("cik_raw"),
        F.col("c.ticker").alias("ticker"),
        F.col("c.title").alias("name"),
    )


def filings(documents: DataFrame, cik: str = "cik", part: str | None = None) -> DataFrame:
    """One row per filing from index documents that hold parallel arrays.

    ``seq`` is the position in the index (``part`` orders several index documents of one company).
    """
    schema = (
        "struct<filings: struct<recent: struct<form: array<string>, filingDate: array<string>,"
        " accessionNumber: array<string>, primaryDocument: array<string>>>>"
    )
    recent = F.from_json("value", schema)["filings"]["recent"]
    zipped = F.arrays_zip(
        recent["form"].alias("form"), recent["filingDate"].alias("filingDate"),
        recent["accessionNumber"].alias("accessionNumber"), recent["primaryDocument"].alias("primaryDocument"),
    )
    rows = documents.select(
        F.lpad(F.col(cik).cast("string"), 10, "0").alias("cik"),
        (F.col(part) if part else F.lit(0)).cast("bigint").alias("part"),
        F.posexplode(zipped).alias("pos", "f"),
    )
    accession = F.replace(F.col("f.accessionNumber"), F.lit("-"), F.lit(""))
    return rows.select(
        "cik",
        (F.col("part") * F.lit(1 << 32) + F.col("pos")).alias("seq"),
        F.col("f.form").alias("form"),
        F.try_to_date(F.col("f.filingDate"), "yyyy-MM-dd").alias("filing_date"),
        accession.alias("accession_number"),
        F.col("f.primaryDocument").alias("primary_document"),
        F.concat_ws("/", F.lit(dims.FILING_ARCHIVE), "cik", accession, F.col("f.primaryDocument")).alias("url"),
    )
