"""Lookups of institutions, companies and filings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarterlight import dims
from quarterlight.operators.joins import lookup_join
from quarterlight.operators.normalize import default_name


def search_institutions(institutions: DataFrame, terms: list[str]) -> DataFrame:
    """(term, rssd_id, name) for ids (all digits, equality) and name parts (any case, containment).

    An id that is not listed still gives a row with the default name.  Exact name matches are marked.
    """
    spark = institutions.sparkSession
    ids = [t.strip() for t in terms if t.strip().isdigit()]
    parts = [t.strip() for t in terms if t.strip() and not t.strip().isdigit()]
    lower = F.lower("name")
    hits = F.filter(
        F.array(*[F.lit(p) for p in parts]).cast("array<string>"), lambda p: F.contains(lower, F.lower(p))
    )
    by_name = institutions.select(F.explode(hits).alias("term"), "rssd_id", "name").withColumn(
        "is_exact", F.lower("name") == F.lower("term")
    )
    if not ids:
        return by_name
    wanted = dims.literal_rows(spark, "term string, rssd_id string", [(i, i) for i in ids])
    found = institutions.filter(F.col("rssd_id").isin(*ids)).select("rssd_id", "name")
    by_id = wanted.join(found, "rssd_id", "left").select(
        "term", "rssd_id", F.coalesce("name", default_name(F.col("rssd_id"))).alias("name"), F.lit(True).alias("is_exact")
    )
    return by_name.unionByName(by_id)


def add_peers(primary: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen peers (rssd_id, seq) without repeats and without the primary, in order."""
    once = chosen.groupBy("rssd_id").agg(F.min("seq").alias("seq"))
    return once.join(primary.select("rssd_id"), "rssd_id", "left_anti")


def search_companies(companies: DataFrame, query: str, search_type: str = "ticker") -> DataFrame:
    """Companies by exact ticker, by part of the name, or by CIK with or without leading zeros."""
    if search_type == "ticker":
        hit = F.lower("ticker") == query.lower()
    elif search_type == "name":
        hit = F.lower("name").contains(query.lower())
    elif search_type == "cik":
        hit = (F.col("cik_raw") == query) | (F.col("cik") == query)
    else:
        hit = F.lit(False)
    return companies.filter(hit).select("cik", "ticker", "name")


def recent_filings(filings: DataFrame, filing_type: str = "10-K", count: int = 10) -> DataFrame:
    """The first ``count`` filings of a type in index order, for every company at once."""
    kept = filings if filing_type == "All Types" else filings.filter(F.col("form") == filing_type)
    order = Window.partitionBy("cik").orderBy("seq")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


def filing_as_of(filings: DataFrame, filing_type: str = "10-K", as_of: dt.date | None = None) -> DataFrame:
    """For every company the latest filing of a type, not later than ``as_of`` if given.

    Without a date it is the first filing in index order.
    """
    kept = filings if filing_type == "All Types" else filings.filter(F.col("form") == filing_type)
    row = F.struct("form", "filing_date", "accession_number", "url")
    if as_of is None:
        latest = kept.groupBy("cik").agg(F.min_by(row, "seq").alias("f"))
    else:
        dated = kept.filter(F.col("filing_date") <= F.lit(as_of))
        latest = dated.groupBy("cik").agg(F.max_by(row, F.struct("filing_date", -F.col("seq"))).alias("f"))
    return latest.select("cik", "f.*")


def filings_for_requests(filings: DataFrame, requests: DataFrame, filing_type: str = "10-K") -> DataFrame:
    """As-of join: for every request (cik, as_of, ...) the latest filing with a date up to ``as_of``.

    Filings and request dates are first reduced to one row per company and day, so the window over a
    company sees at most two rows per calendar day, however many filings or requests it has.
    """
    kept = filings if filing_type == "All Types" else filings.filter(F.col("form") == filing_type)
    daily = kept.groupBy("cik", F.col("filing_date").alias("day")).agg(
        F.min_by(F.struct("filing_date", "accession_number", "url"), "seq").alias("filing")
    )
    asked = requests.select("cik", F.col("as_of").alias("day")).distinct()
    # On one day the filing (0) comes before the request (1), because dates may be equal.
    timeline = daily.withColumn("kind", F.lit(0)).unionByName(asked.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    upto = Window.partitionBy("cik").orderBy("day", "kind").rowsBetween(Window.unboundedPreceding, 0)
    carried = timeline.withColumn("filing", F.last("filing", ignorenulls=True).over(upto))
    answers = carried.filter(F.col("kind") == 1).select("cik", F.col("day").alias("as_of"), "filing")
    return lookup_join(requests, answers, ["cik", "as_of"]).select(*requests.columns, "filing.*")
