"""Filing documents: routing by type, HTML tables, tagged facts, delimited text, positioned words.

A document is one row, so everything that belongs to a single document is worked out inside that row
with array functions; no step here needs a shuffle except the word grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarterlight import dims
from quarterlight.functions import text
from quarterlight.operators.joins import computed_once

_TABLE_EDGE = r"(?i)(?=<table\b|</table\s*>)"
_BLOCK = r"h[1-6]|p|div|span"


def document_kind(path: Column, content: Column | None = None) -> Column:
    """xbrl / pdf / delimited / html, from the file extension (and the content, if given)."""
    lower = F.lower(path)
    xbrl = lower.endswith(".xbrl") | lower.endswith(".xml")
    if content is not None:
        xbrl = xbrl | F.lower(content).contains("<xbrl")
    return (
        F.when(xbrl, "xbrl")
        .when(lower.endswith(".pdf"), "pdf")
        .when(lower.endswith(".sdf") | lower.endswith(".txt"), "delimited")
        .otherwise("html")
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, content, kind: one row per text document."""
    docs = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")
    )
    return docs.withColumn("kind", document_kind(F.col("path"), F.col("content")))


# -- HTML ------------------------------------------------------------------------------------------
def html_tables(docs: DataFrame, html: str = "html", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per table: its number in the document, raw body text and raw row bodies.

    Rows that share an id, or have none, are documents of their own.  The text is cut at every table tag, one row per piece.  The depth after a piece is a running sum, and the table it
    belongs to is the last one opened at that depth, so a nested table's rows are its own and the outer table keeps
    the pieces around it.  The work grows with the pieces, and pieces of one document stay in one partition throughout.
    """
    no_comments = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    docs = docs.withColumn("_doc", F.monotonically_increasing_id())
    pieces = docs.select("_doc", *keys, F.posexplode(F.split(no_comments, _TABLE_EDGE)).alias("_ix", "_piece"))
    tag = F.lower(F.substring("_piece", 1, 7))
    opens, closes = tag.startswith("<table"), tag.startswith("</table")
    so_far = Window.partitionBy("_doc").orderBy("_ix").rowsBetween(Window.unboundedPreceding, 0)
    at_depth = Window.partitionBy("_doc", "_depth").orderBy("_ix").rowsBetween(Window.unboundedPreceding, 0)
    stepped = pieces.withColumn("_step", F.when(opens, 1).when(closes, -1).otherwise(0)).withColumns(
        {"_number": F.sum(F.when(opens, 1).otherwise(0)).over(so_far), "_sum": F.sum("_step").over(so_far)}
    )
    # A closing tag without an open table leaves the depth at zero.
    depth = F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(so_far))
    inside = stepped.withColumn("_depth", depth).filter("_depth > 0")
    owned = inside.withColumn("_owner", F.max(F.when(F.col("_step") == 1, F.col("_number"))).over(at_depth))
    gathered = owned.groupBy("_doc", *keys, "_owner").agg(F.sort_array(F.collect_list(F.struct("_ix", "_piece"))).alias("_ps"))
    tables = gathered.select(
        *keys, (F.col("_owner") - 1).cast("int").alias("table_ix"), F.array_join(F.transform("_ps", lambda p: p["_piece"]), "").alias("table_html")
    )
    rows = F.slice(F.split("table_html", r"(?i)<tr\b[^>]*>"), 2, 2_000_000_000)
    return computed_once(tables, "row_html", rows)


#: The most that HTML lets one cell span.
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534


def _row_cells(row: Column, negatives_first: bool) -> Column:
    """Cells of one row: cleaned text, colspan, rowspan (0: to the end of the table)."""
    pieces = F.slice(F.split(row, r"(?i)<(?=t[dh]\b)"), 2, 2_000_000_000)

    def expand(piece: Column) -> Column:
        tag_end = F.instr(piece, F.lit(">"))
        body = F.get(F.split(F.substring(piece, tag_end + 1, F.length(piece)), r"(?i)</t[dhr]\b", 2), F.lit(0))

        def span(attributes: Column, name: str, most: int) -> Column:
            number = F.nullif(F.regexp_extract(attributes, rf"""(?i){name}\s*=\s*["']?\s*(\d+)""", 1), F.lit(""))
            # A number of too many digits is over the limit too.
            return F.coalesce(F.when(number.isNotNull(), F.least(F.coalesce(number.try_cast("int"), F.lit(most)), F.lit(most))), F.lit(1))

        def spans(attributes: Column) -> Column:
            both = lambda c, r: F.struct(c.alias("colspan"), r.alias("rowspan"))
            read = both(F.greatest(span(attributes, "colspan", MAX_COLSPAN), F.lit(1)), span(attributes, "rowspan", MAX_ROWSPAN))
            return F.when(attributes.contains("="), read).otherwise(both(F.lit(1), F.lit(1)))

        cell = text.cell_text(body, negatives_first)
        return _let(_let(F.substring(piece, F.lit(1), tag_end), spans), lambda s: F.struct(cell.alias("text"), s["colspan"].alias("colspan"), s["rowspan"].alias("rowspan")))

    return F.transform(pieces, expand)


_PLACED = "array<struct<col:int,colspan:int,rowspan:int,text:string>>"


def _let(value: Column, then) -> Column:
    """A value that an expression uses several times, worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _placed_row(open_: Column, cells: Column) -> Column:
    """struct(open, placed): the cells of one row put into the columns that no span from above covers.

    ``open`` has, for each column, how many rows (this one included) are still covered.
    """

    def step(state: Column, cell: Column) -> Column:
        width = F.size(state["open"])
        free = F.get(F.filter(F.sequence(state["x"], F.greatest(state["x"], width)), lambda i: F.coalesce(F.get(state["open"], i), F.lit(0)) == 0), F.lit(0))

        def put(x: Column) -> Column:
            stop = (x + cell["colspan"]).cast("int")
            rows = F.when(cell["rowspan"] == 0, MAX_ROWSPAN).otherwise(cell["rowspan"])
            covered = lambda i: F.coalesce(F.get(state["open"], i), F.lit(0))
            opened = F.transform(
                F.sequence(F.lit(0), F.greatest(width, stop) - 1), lambda i: F.when((i >= x) & (i < stop), F.greatest(covered(i), rows)).otherwise(covered(i))
            )
            entry = F.struct(x.alias("col"), cell["colspan"].alias("colspan"), rows.alias("rowspan"), cell["text"].alias("text"))
            return F.struct(stop.alias("x"), opened.alias("open"), F.concat(state["placed"], F.array(entry)).alias("placed"))

        return _let(free, put)

    begun = F.struct(F.lit(0).alias("x"), open_.alias("open"), F.array().cast(_PLACED).alias("placed"))
    # Where nothing spans, the cells stand one after the other: no column is looked for.
    one = F.lit(1)
    beside = F.transform(cells, lambda c, i: F.struct(i.alias("col"), one.alias("colspan"), one.alias("rowspan"), c["text"].alias("text")))
    opened = F.concat(F.array_repeat(one, F.size(cells)), F.array_repeat(F.lit(0), F.greatest(F.size(open_) - F.size(cells), F.lit(0))))
    plain = F.forall(open_, lambda n: n == 0) & F.forall(cells, lambda c: (c["colspan"] == 1) & (c["rowspan"] == 1))
    placed = F.struct(F.size(cells).alias("x"), opened.alias("open"), beside.cast(_PLACED).alias("placed"))
    return F.when(plain, placed).otherwise(F.aggregate(cells, begun, step))


def placed_cells(tables: DataFrame, negatives_first: bool = False) -> DataFrame:
    """Add ``placed`` (for each row its cells with col, colspan, rowspan, text) and the number of rows and columns.

    One sweep over the rows carries the spans that are still open; its work is that of the grid's area.  Spans are
    bounded as in HTML.  Where a wide cell runs into one that comes from above, both cover the place.
    """
    parsed = computed_once(tables, "_cells", F.transform("row_html", lambda r: _row_cells(r, negatives_first)))

    def row(state: Column, cells: Column) -> Column:
        def next_(r: Column) -> Column:
            below = F.transform(r["open"], lambda n: F.greatest(n - 1, F.lit(0)))
            return F.struct(below.alias("open"), F.concat(state["rows"], F.array(r["placed"])).alias("rows"))

        return _let(_placed_row(state["open"], cells), next_)

    begun = F.struct(F.array().cast("array<int>").alias("open"), F.array().cast(f"array<{_PLACED}>").alias("rows"))
    swept = computed_once(parsed, "_swept", F.aggregate("_cells", begun, row))
    return swept.withColumns({"placed": F.col("_swept.rows"), "n_rows": F.size("_swept.rows"), "n_cols": F.size("_swept.open")}).drop("_cells", "_swept")


def table_grids(tables: DataFrame, negatives_first: bool = False) -> DataFrame:
    """Add ``cells`` (rows of cleaned cells padded to the widest row), row and column counts.

    A spanning cell's text stands in its first place; the other places that it covers are blank.
    """

    def full(cells: Column) -> Column:
        by_place = lambda m: F.transform(F.sequence(F.lit(0), F.col("n_cols") - 1), lambda i: F.coalesce(F.try_element_at(m, i), F.lit("")))
        placed = _let(F.map_from_entries(F.transform(cells, lambda c: F.struct(c["col"], c["text"]))), by_place)
        # Without gaps, the last of so many cells stands in the column of that number.
        n = F.size(cells)
        beside = F.concat(F.transform(cells, lambda c: F.coalesce(c["text"], F.lit(""))), F.array_repeat(F.lit(""), F.col("n_cols") - n))
        return F.when((n == 0) | (F.get(cells, n - 1)["col"] == n - 1), beside).otherwise(placed)

    placed = placed_cells(tables, negatives_first)
    # A table without any cell has rows without places.
    grid = F.when(F.col("n_cols") > 0, F.transform("placed", full)).otherwise(F.transform("placed", lambda r: F.array().cast("array<string>")))
    return computed_once(placed, "cells", grid).drop("placed")


def merged_cells(tables: DataFrame, keys: tuple[str, ...] = ("doc_id", "table_ix"), negatives_first: bool = False) -> DataFrame:
    """keys, row_ix, col_ix, colspan, rowspan, value: the cells that cover more than one place, ends of the table taken into account."""
    placed = placed_cells(tables, negatives_first)
    rows = placed.select(*keys, "n_rows", F.posexplode("placed").alias("row_ix", "_row"))
    cells = rows.select(*keys, "row_ix", F.inline("_row"), F.col("n_rows").alias("_n_rows"))
    cells = cells.withColumn("rowspan", F.least(F.col("rowspan"), F.col("_n_rows") - F.col("row_ix")))
    return cells.filter("colspan > 1 or rowspan > 1").select(*keys, "row_ix", F.col("col").alias("col_ix"), "colspan", "rowspan", F.col("text").alias("value"))


def explode_cells(grids: DataFrame, keys: tuple[str, ...] = ("doc_id", "table_ix")) -> DataFrame:
    """keys, row_ix, col_ix, text: one row per cell."""
    rows = grids.select(*keys, F.posexplode("cells").alias("row_ix", "row"))
    return rows.select(*keys, "row_ix", F.posexplode("row").alias("col_ix", "text"))


def text_blocks(docs: DataFrame, html: str = "html", keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keys, block_ix, tag, text: the text that follows each heading, paragraph, div or span tag.

    A block ends at the next tag of that kind, so nested blocks are reported once, innermost.
    """
    blocks = docs.select(*keys, F.posexplode(block_pieces(html)).alias("block_ix", "piece"))
    blocks = blocks.filter(F.col("piece").contains("\u0002"))
    return blocks.select(*keys, "block_ix", block_tag(F.col("piece")).alias("tag"), block_text(F.col("piece")).alias("text"))


def block_pieces(html: str | Column) -> Column:
    """The text cut at heading, paragraph, div and span tags; pieces that follow an opening one start with its name."""
    plain = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for hidden in ("script", "style"):
        plain = F.regexp_replace(plain, rf"(?is)<{hidden}\b.*?</{hidden}\s*>", "")
    cut = F.regexp_replace(plain, rf"(?i)<({_BLOCK})(?:\s[^>]*)?>", "\u0001$1\u0002")
    cut = F.regexp_replace(cut, rf"(?i)</(?:{_BLOCK})\s*>", "\u0001")
    return F.split(cut, "\u0001")


def block_tag(piece: Column) -> Column:
    return F.lower(F.split(piece, "\u0002", 2)[0])


def block_text(piece: Column) -> Column:
    return text.strip(text.markup_text(F.split(piece, "\u0002", 2)[1]))


# -- tagged facts ----------------------------------------------------------------------------------
def facts(docs: DataFrame, content: str = "content", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """name, value, context, unit, decimals of each prefixed leaf element.

    A document without any prefixed fact falls back to its numeric texts (name ``NumericValue``).
    """
    prefixes = "|".join(dims.FACT_PREFIXES)
    tagged = F.regexp_extract_all(
        F.col(content), F.lit(rf"(?i)<((?:{prefixes}):[\w.-]+[^<>]*)>([^<]*)</(?:{prefixes}):"), F.lit(0)
    )
    numbers = F.filter(
        F.regexp_extract_all(F.col(content), F.lit(r">([^<>]+)"), F.lit(1)), lambda t: text.is_numeric(text.strip(t))
    )
    both = docs.select(*keys, tagged.alias("tagged"), F.when(F.size(tagged) == 0, numbers).alias("numbers"))
    plain = F.transform(F.coalesce("numbers", F.array().cast("array<string>")), lambda n: F.concat(F.lit(">"), n))
    rows = both.select(*keys, F.posexplode(F.concat("tagged", plain)).alias("fact_ix", "raw"))
    raw = F.col("raw")
    is_tag = raw.startswith("<")

    def attribute(name: str) -> Column:
        return F.regexp_extract(raw, rf"""(?i)\s{name}\s*=\s*["']([^"']*)["']""", 1)

    value = F.regexp_extract(raw, r"(?s)>([^<]*)", 1)
    name = F.lower(F.regexp_extract(raw, r"<([\w.:-]+)", 1))
    return rows.select(
        *keys,
        "fact_ix",
        F.when(is_tag, name).otherwise("NumericValue").alias("name"),
        F.when(is_tag, F.substring_index(name, ":", -1)).otherwise("numeric_data").alias("category"),
        text.strip(value).alias("value"),
        F.when(is_tag, attribute("contextref")).otherwise("").alias("context"),
        F.when(is_tag, attribute("unitref")).otherwise("").alias("unit"),
        F.when(is_tag, attribute("decimals")).otherwise("").alias("decimals"),
    )


def report_period(content: Column) -> Column:
    """Instant of the first context that has one."""
    contexts = F.regexp_extract_all(
        content, F.lit(r"(?is)<(?:xbrli:)?context\b.*?</(?:xbrli:)?context\s*>"), F.lit(0)
    )
    instants = F.transform(
        contexts, lambda c: F.regexp_extract(c, r"(?is)<(?:xbrli:)?instant\b[^>]*>([^<]*)<", 1)
    )
    return F.get(F.filter(instants, lambda i: i != ""), F.lit(0))


# -- delimited documents and words -------------------------------------------------------------------
def delimited_lines(docs: DataFrame, content: str = "content", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, line_no, cells: lines of delimited documents, each split by the separator found
    in its document's first line that is not blank."""
    head = F.regexp_extract(content, r"(?m)^(.*\S.*)$", 1)
    separator = F.when(head.contains("\t"), "\t").when(head.contains("|"), "|").otherwise(",")
    body = F.regexp_replace(content, r"\r?\n\z", "")
    lines = docs.select(*keys, separator.alias("sep"), F.posexplode(F.split(body, r"\r?\n")).alias("line_no", "line"))
    line = F.col("line")
    cells = (
        F.when(F.col("sep") == "\t", text.split_delimited(line, "\t"))
        .when(F.col("sep") == "|", text.split_delimited(line, "|"))
        .otherwise(text.split_delimited(line, ","))
    )
    return lines.select(*keys, "line_no", cells.alias("cells"))


def word_rows(words: DataFrame, keys: tuple[str, ...] = ("doc_id", "page_num")) -> DataFrame:
    """Text rows of a page: words of one height from left to right; single words are left out.

    A group is one printed line, and its text is the result row, so its size is that of the output.
    """
    row_top = F.round("top", 1)
    grouped = words.groupBy(*keys, row_top.alias("row_top")).agg(
        F.sort_array(F.collect_list(F.struct("x0", "text"))).alias("ws")
    )
    joined = F.array_join(F.transform("ws", lambda w: w["text"]), " ")
    return grouped.filter(F.size("ws") >= 2).select(*keys, "row_top", joined.alias("row_text"))
