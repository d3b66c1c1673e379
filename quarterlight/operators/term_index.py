"""Search for a whole table of terms in a whole table of names, by an inverted index of character n-grams.

A name contains a term only if it contains every n-gram of the term, the rarest one too.  So each term is joined, by
equality, with the postings of its rarest n-gram, and the candidates are verified by containment.  A term shorter than
an n-gram is looked up as an n-gram of its own length, which the index holds as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterlight.functions import text
from quarterlight.operators.normalize import default_name
from quarterlight.session import stored

#: Characters of an n-gram.  It must be long enough for few names to share a term's rarest one: with three digits a fixed share of
#: all names does, and candidates grow with names times terms.  Postings grow with it through the shorter n-grams kept for shorter terms.
GRAM = 6


def _grams(value: Column, size: int) -> Column:
    """The distinct n-grams of exactly ``size`` characters."""
    starts = F.sequence(F.lit(1), F.length(value) - size + 1)
    cut = F.array_distinct(F.transform(starts, lambda i: F.substr(value, i, F.lit(size))))
    return F.when(F.length(value) >= size, cut).otherwise(F.array().cast("array<string>"))


def _own_grams(size: int) -> Column:
    """The n-grams that a term (column ``term``) is looked up by."""
    return text.let(F.lower("term"), lambda lower: F.when(F.length(lower) < size, F.array(lower)).otherwise(_grams(lower, size)))


def postings(names: DataFrame, column: str, keys: list[str], size: int = GRAM) -> DataFrame:
    """(gram, keys, column): every n-gram of 1 to ``size`` characters of every name, in lower case, once per name.

    Names that are null have none.  The name stays with its postings, so that candidates are verified where they are found.
    """
    # ``let``: the lambda over the starts would put the name into lower case again for every n-gram.
    every = text.let(F.lower(column), lambda lower: F.flatten(F.array(*[_grams(lower, n) for n in range(1, size + 1)])))
    return names.select(F.explode(every).alias("gram"), *keys, column)


def rarest_grams(terms: DataFrame, counts: DataFrame, size: int = GRAM) -> DataFrame:
    """(term, gram): the n-gram of each term (column ``term``) that the fewest names hold; ties go to the smallest n-gram.

    A term with an n-gram that no name holds can't occur and is left out.
    """
    listed = terms.select("term", F.explode(_own_grams(size)).alias("gram"))
    looked_up = listed.join(counts, "gram", "left")
    best = looked_up.groupBy("term").agg(
        F.min_by("gram", F.struct(F.coalesce("n_names", F.lit(0)).alias("n"), "gram")).alias("gram"),
        F.min(F.coalesce("n_names", F.lit(0))).alias("n_names"),
    )
    return best.filter(F.col("n_names") > 0).select("term", "gram")


def names_with_terms(
    names: DataFrame, terms: DataFrame, column: str, keys: list[str], index: DataFrame | None = None, size: int = GRAM
) -> DataFrame:
    """(term, keys, column) for every name that contains a term, in any case; every pair once per row of ``names``.

    ``terms`` has a column ``term``; repeats count once, and null and empty terms find nothing.  ``index`` is a stored
    result of ``postings`` for searches to come; otherwise only the postings of the terms' own n-grams are kept, and these
    are written once below the shared folder, because they are counted and then joined.
    """
    wanted = terms.select("term").filter(F.col("term") != "").distinct()
    if index is None:
        asked = wanted.select(F.explode(_own_grams(size)).alias("gram")).distinct()
        # Names are small rows that become many: they are spread over the tasks first, however few files they came from.
        spread = names.repartition(names.sparkSession.sparkContext.defaultParallelism * 4)
        index = stored(postings(spread, column, keys, size).join(asked, "gram", "left_semi"), "postings")
    counts = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n_names"))
    # A frequent n-gram is reached only by terms that hold no rarer one; adaptive execution splits it by its measured size.
    candidates = rarest_grams(wanted, counts, size).join(index, "gram")
    return candidates.filter(F.contains(F.lower(column), F.lower("term"))).select("term", *keys, column)


def search_institutions(institutions: DataFrame, terms: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(term, rssd_id, name, is_exact) for a table of terms: ids by equality, all others by containment in the name.

    Terms are trimmed; a term of digits is an id, and one that is not listed still gives a row with the default name.
    Repeated terms count once, null and blank ones not at all.
    """
    trimmed = terms.select(text.strip(F.col("term")).alias("term")).filter(F.col("term") != "").distinct()
    is_id = F.col("term").rlike("^[0-9]+$")
    listed = institutions.select("rssd_id", "name")
    by_name = names_with_terms(listed, trimmed.filter(~is_id), "name", ["rssd_id"], index)
    ids = trimmed.filter(is_id).join(listed, F.col("term") == F.col("rssd_id"), "left")
    by_id = ids.select(
        "term", F.col("term").alias("rssd_id"), F.coalesce("name", default_name(F.col("term"))).alias("name"),
        F.lit(True).alias("is_exact"),
    )
    exact = F.lower("name") == F.lower("term")
    return by_name.select("term", "rssd_id", "name", exact.alias("is_exact")).unionByName(by_id)


def search_companies(companies: DataFrame, requests: DataFrame) -> DataFrame:
    """(search, query, cik, ticker, name) for a table of requests: ``search`` is ticker, name or cik, ``query`` the text.

    Tickers are compared in any case, CIKs with or without leading zeros, names by containment.  Other kinds of search and
    null queries find nothing; an empty name query finds nothing either.  Repeated requests count once.
    """
    asked = requests.select("search", "query").filter(F.col("query").isNotNull()).distinct()
    of = lambda kind: asked.filter(F.col("search") == kind).select("query")
    shown = ["cik", "ticker", "name"]
    by_ticker = of("ticker").join(companies, F.lower("query") == F.lower("ticker")).select("query", *shown)
    numbers = companies.select(F.explode(F.array_distinct(F.array("cik_raw", "cik"))).alias("number"), *shown)
    by_cik = of("cik").join(numbers, F.col("query") == F.col("number")).select("query", *shown)
    by_name = names_with_terms(companies, of("name").withColumnRenamed("query", "term"), "name", ["cik", "ticker"])
    found = [("ticker", by_ticker), ("cik", by_cik), ("name", by_name.select(F.col("term").alias("query"), *shown))]
    parts = [df.select(F.lit(kind).alias("search"), "query", *shown) for kind, df in found]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
