"""Extracted tables: which are financial, their header rows, summaries, and document sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quarterlight import dims
from quarterlight.functions import names, text
from quarterlight.operators.joins import computed_once, lookup_join, running_values
from quarterlight.sources import documents


def is_financial(
    table_text: Column, n_rows: Column, n_cells: Column, min_text: int = 20, min_rows: int = 3, min_cells: int = 6
) -> Column:
    """Enough text, rows and cells, and enough financial words, numbers or years."""
    words = F.array(*[F.lit(w) for w in dims.FINANCIAL_WORDS])

    def judged(lower: Column) -> Column:
        indicators = F.size(F.filter(words, lambda w: F.contains(lower, w)))
        numbers = F.regexp_count(lower, F.lit(dims.NUMERIC_PATTERN))
        years = F.regexp_count(lower, F.lit(dims.YEAR_PATTERN))
        large_enough = (F.length(text.strip(lower)) >= min_text) & (n_rows >= min_rows) & (n_cells >= min_cells)
        telling = (
            ((indicators >= 3) & (numbers >= 5)) | ((years >= 2) & (numbers >= 10)) | (indicators >= 5)
        )
        return large_enough & telling

    # A filter on this is pushed down to where the text is made: without ``let`` it would be made again for every word.
    return text.let(F.lower(table_text), judged)


def table_profile(grids: DataFrame) -> DataFrame:
    """Add text, cell count, has_numbers, is_financial and the header-row positions of parsed tables."""
    body = text.markup_text(F.col("table_html"))
    cells = F.regexp_count(F.col("table_html"), F.lit(r"(?i)<t[dh]\b"))
    profiled = grids.withColumns({"table_text": body, "n_cells": cells})
    has_numbers = F.exists("cells", lambda row: F.exists(row, lambda c: c.rlike(r"\d")))

    def is_header(row: Column) -> Column:
        words = F.filter(row, lambda c: (c != "") & ~c.rlike(dims.HEADER_NUMBER_PATTERN))
        return F.size(words) > F.size(row) * F.lit(0.7)

    top = F.slice("cells", 1, 3)
    positions = F.filter(F.transform(top, lambda row, i: F.when(is_header(row), i)), lambda i: i.isNotNull())
    return profiled.withColumns(
        {
            "has_numbers": has_numbers,
            "header_rows": positions,
            "is_financial": is_financial(F.col("table_text"), F.col("n_rows"), F.col("n_cells")),
        }
    )


def financial_tables(profiled: DataFrame, min_rows: int = 3) -> DataFrame:
    """Financial tables of a usable size."""
    return profiled.filter(F.col("is_financial") & (F.col("n_rows") >= min_rows))


def table_summary(profiled: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, columns, numbers and a preview of the first row for every table."""
    preview = F.array_join(F.filter(F.get("cells", F.lit(0)), lambda c: c != ""), " | ")
    # The second column of a schedule report holds the code.
    codes = F.size(F.filter("cells", lambda r: F.coalesce(F.get(r, F.lit(1)), F.lit("")) != ""))
    return profiled.select(*keys, "n_rows", "n_cols", "has_numbers", preview.alias("preview"), codes.alias("codes"))


def section_totals(summary: DataFrame, keys: list[str]) -> DataFrame:
    return summary.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tables"), F.sum("n_rows").alias("total_rows"), F.max("n_cols").alias("max_cols")
    )


def section_priority(keyword: Column) -> Column:
    """1 to 4 for the primary statements, 10 for everything else."""
    priority = F
    for part, rank in dims.SECTION_PRIORITIES:
        priority = priority.when(keyword.contains(part), rank)
    return priority.otherwise(dims.DEFAULT_SECTION_PRIORITY)


def financial_sections(
    blocks: DataFrame, keys: list[str], keywords: tuple[str, ...] = dims.SECTION_KEYWORDS, limit: int = dims.SECTION_TEXT_LIMIT
) -> DataFrame:
    """Text blocks that contain a keyword, with the first keyword of the list and its priority.

    Blocks over ``limit`` characters are running text rather than headings: they are kept and flagged (``is_heading``).
    """
    listed = F.array(*[F.lit(k) for k in keywords])
    lower = computed_once(computed_once(blocks, "_plain", F.col("text")), "_lower", F.lower("_plain"))
    found = computed_once(lower, "keyword", F.get(F.filter(listed, lambda k: F.contains(F.col("_lower"), k)), F.lit(0)))
    return found.filter(F.col("keyword").isNotNull()).select(
        *keys,
        "block_ix",
        "tag",
        F.col("_lower").alias("shown_text"),
        "keyword",
        (F.length("_plain") <= limit).alias("is_heading"),
        section_priority(F.col("keyword")).alias("priority"),
    )


def section_order(sections: DataFrame) -> DataFrame:
    """Primary statements first; inside a priority the order of the document."""
    keys = [c for c in sections.columns if c not in ("tag", "shown_text", "keyword", "is_heading", "priority", "block_ix")]
    return sections.orderBy("priority", *keys, "block_ix")


def tables_with_sections(
    docs: DataFrame, html: str = "html", keys: tuple[str, ...] = ("doc_id",), limit: int = dims.SECTION_TEXT_LIMIT
) -> DataFrame:
    """keys, table_ix, keyword, priority: the section each table stands in.

    Headings are found as in ``text_blocks``, inline markup included.  The nearest heading with a keyword before a table
    names its section, unless a stop heading (the next item, part, exhibit or the signatures) has ended it since.
    """
    no_comments = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    listed = F.array(*[F.lit(k) for k in dims.SECTION_KEYWORDS])
    stops = F.array(*[F.lit(k) for k in dims.SECTION_STOPS])

    def heading(block: Column) -> Column:
        """The keyword, '' for a stop heading, null for other text."""
        lower, tag = block["text"], block["tag"]
        keyword = F.get(F.filter(listed, lambda k: F.contains(lower, k)), F.lit(0))
        stop = tag.isin(*dims.SECTION_STOP_TAGS) & F.exists(stops, lambda k: F.contains(lower, k))
        return F.when(F.length(lower) <= limit, F.coalesce(keyword, F.when(stop, "")))

    def last_heading(piece: Column) -> Column:
        outside = F.element_at(F.split(piece, r"(?i)</table\s*>"), -1)
        blocks = F.filter(documents.block_pieces(outside), lambda p: p.contains("\u0002"))
        # The markup of a block is cleaned once, however many keywords look at it.
        cleaned = F.transform(blocks, lambda p: F.struct(F.lower(documents.block_text(p)).alias("text"), documents.block_tag(p).alias("tag")))
        return F.try_element_at(F.filter(F.transform(cleaned, heading), lambda h: h.isNotNull()), F.lit(-1))

    # The piece before the n-th opening tag is about table n; its heading is carried over later tables.
    pieces = docs.select(*keys, F.posexplode(F.split(no_comments, r"(?i)<table\b")).alias("table_ix", "_piece"))
    found = pieces.select(*keys, "table_ix", last_heading(F.col("_piece")).alias("_found"))
    order = Window.partitionBy(*keys).orderBy("table_ix")
    carried = F.last("_found", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = found.withColumns({"keyword": F.nullif(carried, F.lit("")), "_more": F.lead(F.lit(1)).over(order)})
    kept = rows.filter("_more is not null").select(*keys, "table_ix", "keyword")
    return kept.withColumn("priority", section_priority(F.col("keyword")))


def fact_groups(
    facts: DataFrame, keys: list[str], min_facts: int = 4, table_prefix: str = dims.FACT_TABLE_PREFIX
) -> DataFrame:
    """Facts of the categories that have at least ``min_facts`` facts, with the category's table name.

    Counts are aggregated and joined back instead of a window, so that a dominant category is spread.
    """
    sizes = facts.groupBy(*keys, "category").agg(F.count(F.lit(1)).alias("n_facts"))
    large = sizes.filter(F.col("n_facts") >= min_facts)
    joined = lookup_join(facts, large, [*keys, "category"], how="inner")
    return joined.withColumn("table_name", F.concat(F.lit(table_prefix), "category"))


def delimited_sections(
    lines: DataFrame, keys: list[str], min_lines: int = 2, table_prefix: str = dims.DELIMITED_TABLE_PREFIX
) -> DataFrame:
    """Sections of delimited documents: keys, section_no, section, table_name, line_no, cells.

    A blank line or a first cell with "Schedule" starts a section; a schedule line also names it and
    the ones after it.  Sections with fewer than ``min_lines`` lines are left out.  The number in a table's name keeps apart
    sections whose names begin alike.
    """
    first = text.strip(F.coalesce(F.get("cells", F.lit(0)), F.lit("")))
    blank = ~F.exists("cells", lambda c: text.strip(c) != "")
    heads = ~blank & (first.contains("Schedule") | first.contains("SCHEDULE"))
    marked = lines.withColumns({"blank": blank, "heads": heads})
    numbered = running_values(
        marked,
        keys,
        "line_no",
        sums={"section_no": (F.col("blank") | F.col("heads")).cast("int")},
        carried={"section": F.when(F.col("heads"), first)},
    ).filter(~F.col("blank"))
    named = numbered.withColumn("section", F.coalesce("section", F.lit(dims.DEFAULT_DELIMITED_SECTION)))
    # Both branches need the numbering; a caller with much data stores ``lines`` first.
    named = named.drop("blank", "heads")
    sizes = named.groupBy(*keys, "section_no").agg(F.count(F.lit(1)).alias("n_lines")).filter(F.col("n_lines") >= min_lines)
    kept = lookup_join(named, sizes, [*keys, "section_no"], how="inner")
    name = F.concat(F.lit(table_prefix), names.section_slug(F.col("section")), F.lit("_"), F.col("section_no").cast("string"))
    return kept.select(*keys, "section_no", "section", name.alias("table_name"), "line_no", "n_lines", "cells")
