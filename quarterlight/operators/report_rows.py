"""Rows of printed schedules: classification, pattern parsing, splitting, schedule detection, layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterlight import dims
from quarterlight.functions import text
from quarterlight.operators.joins import computed_once, lookup_join, running_values


def _blank(value: Column) -> Column:
    return value.isNull() | (text.strip(value) == "")


def _contains_any(value: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | value.contains(word)
    return hit


def with_dictionary(rows: DataFrame, descriptions: DataFrame, code: str = "code") -> DataFrame:
    """Add ``known`` (description of the upper-cased code, '' if unknown)."""
    lookup = descriptions.select(F.col("mdrm_code").alias("_code"), F.col("description").alias("known"))
    keyed = rows.withColumn("_code", F.upper(text.strip(F.col(code))))
    joined = lookup_join(keyed, lookup, ["_code"])
    return joined.withColumn("known", F.coalesce("known", F.lit(""))).drop("_code")


def description_or_default(rows: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Fill a blank or "." description from the dictionary."""
    joined = rows if "known" in rows.columns else with_dictionary(rows, descriptions)
    trimmed = text.strip(F.coalesce("description", F.lit("")))
    fill = trimmed.isin("", ".") & (F.col("known") != "")
    return joined.withColumn("description", F.when(fill, F.col("known")).otherwise(F.col("description"))).drop("known")


def clean_grid(grid: DataFrame, cells: str = "cells") -> DataFrame:
    """Null cells to blanks, runs of blanks collapsed, all-blank rows dropped."""
    tidy = F.transform(
        cells, lambda c: text.strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    )
    return grid.withColumn(cells, tidy).filter(F.exists(cells, lambda c: c != ""))


def classify_rows(grid: DataFrame, descriptions: DataFrame, cells: str = "cells", keep_known: bool = False) -> DataFrame:
    """Code, amount, description, indent and header / total flags of a row of cells.

    ``keep_known`` leaves the dictionary's description (``known``) for later steps, which then need no join of their own.
    """
    filled = F.filter(
        F.transform(cells, lambda c: text.strip(F.coalesce(c, F.lit("")))), lambda c: c != ""
    )
    is_code = lambda c: c.rlike(dims.CODE_CELL_PATTERN)
    is_amount = lambda c: ~c.rlike(dims.CODE_CELL_PATTERN) & c.rlike(dims.AMOUNT_CELL_PATTERN)
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(""))
    rows = grid.withColumn("_filled", filled).filter(F.size("_filled") > 0)
    words = F.array_join(F.filter("_filled", lambda c: ~is_code(c) & ~is_amount(c)), " ")
    for pattern in dims.TRAILING_NUMBERS:
        words = F.regexp_replace(words, pattern, "")
    parsed = rows.withColumns(
        {
            "code": last(F.filter("_filled", is_code)),
            "amount": last(F.filter("_filled", is_amount)),
            "description": words,
        }
    ).drop("_filled")
    looked_up = with_dictionary(parsed, descriptions)
    description = F.when(
        _blank(F.col("description")) & (F.col("code") != "") & (F.col("known") != ""), F.col("known")
    ).otherwise(F.col("description"))
    filled_in = looked_up.withColumn("description", description)
    filled_in = filled_in if keep_known else filled_in.drop("known")
    filled_in = filled_in.filter((F.col("description") != "") | (F.col("code") != "") | (F.col("amount") != ""))
    d = F.col("description")
    main = d.rlike(dims.MAIN_ITEM_PATTERN)
    indent = F.when(main, 0)
    for pattern, depth in dims.INDENT_PATTERNS:
        indent = indent.when(d.rlike(pattern), depth)
    indent = indent.otherwise(0)
    return filled_in.withColumns(
        {
            "indent": indent,
            "is_section_header": main,
            "is_total": _contains_any(F.upper(d), dims.REPORT_TOTAL_WORDS),
            "description": text.strip(d),
        }
    )


def validate_balance_rows(grid: DataFrame, descriptions: DataFrame, cells: str = "cells") -> DataFrame:
    """Rows of four cells: line item, description, code, amount; other rows and bad codes are dropped."""
    cell = lambda i: text.strip(F.coalesce(F.get(cells, F.lit(i)), F.lit("")))
    skipped = F.exists(cells, lambda c: _contains_any(F.coalesce(c, F.lit("")), dims.WORD_ROW_SKIPS))
    rows = grid.filter((F.size(cells) >= 4) & ~skipped).withColumns(
        {"line_item": cell(0), "description": cell(1), "code": cell(2), "amount": text.parentheses_to_minus(cell(3))}
    )
    valid = rows.filter((F.col("code") == "") | F.col("code").rlike(rf"^{dims.BALANCE_CODE_PATTERN}$"))
    filled = _fill_blank_description(valid, descriptions)
    return filled.withColumns(
        {
            "is_section_header": F.col("code") == "",
            "is_total": _contains_any(F.upper("description"), dims.BALANCE_TOTAL_WORDS),
        }
    )


def _fill_blank_description(rows: DataFrame, descriptions: DataFrame) -> DataFrame:
    joined = with_dictionary(rows, descriptions)
    fill = (F.col("code") != "") & F.col("description").isin("", ".", "-") & (F.col("known") != "")
    return joined.withColumn("description", F.when(fill, F.col("known")).otherwise(F.col("description"))).drop("known")


def _parts(kind: str, line_item: Column, description: Column, code: Column, amount: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), line_item.alias("line_item"), description.alias("description"),
        code.alias("code"), amount.alias("amount"),
    )


def _without_dot(item: Column, drop_dot: bool) -> Column:
    return F.rtrim(item, F.lit(".")) if drop_dot else item


def _pattern_match(line: Column, pattern: str, has_item: bool, drop_dot: bool) -> Column:
    at = 2 if has_item else 1
    item = F.regexp_extract(line, pattern, 1) if has_item else F.lit("")
    return _parts(
        "match",
        _without_dot(item, drop_dot),
        text.strip(F.regexp_extract(line, pattern, at)),
        F.concat(F.regexp_extract(line, pattern, at + 1), F.regexp_extract(line, pattern, at + 2)),
        F.regexp_extract(line, pattern, at + 3),
    )


def _numbered_text(line: Column, kind: str, code: Column, amount: Column, drop_dot: bool) -> Column:
    """Line item and rest of a text, the whole text if it does not start with a number."""
    numbered = line.rlike(dims.LINE_PREFIX_PATTERN)
    item = _without_dot(F.regexp_extract(line, dims.LINE_PREFIX_PATTERN, 1), drop_dot)
    rest = F.regexp_extract(line, dims.LINE_PREFIX_PATTERN, 2)
    return _parts(
        kind, F.when(numbered, item).otherwise(""), F.when(numbered, rest).otherwise(text.strip(line)), code, amount
    )


def _parsed(rows: DataFrame, choice: Column) -> DataFrame:
    """The chosen parts as columns, rows without a choice dropped; the choice is evaluated once."""
    return (
        computed_once(rows, "_r", choice)
        .filter(F.col("_r").isNotNull())
        .select(*rows.columns, "_r.*", (F.col("_r.kind") == "header").alias("is_section_header"))
    )


def parse_word_rows(rows: DataFrame, descriptions: DataFrame, line: str = "row_text") -> DataFrame:
    """Balance-sheet rows from positioned text: the first pattern wins, text without a code is a header."""
    row = F.col(line)
    choice = F
    for pattern, has_item in dims.WORD_ROW_PATTERNS:
        choice = choice.when(row.rlike(pattern), _pattern_match(row, pattern, has_item, False))
    header = ~row.rlike(dims.BALANCE_CODE_PATTERN) & (F.length(row) > 5)
    choice = choice.when(header, _numbered_text(row, "header", F.lit(""), F.lit(""), False))
    out = _parsed(rows.filter(~_contains_any(row, dims.WORD_ROW_SKIPS)), choice)
    out = out.filter(~F.col("is_section_header") | ((F.col("description") != "") & ~F.col("description").rlike(r"^\d+$")))
    tidy = F.regexp_replace(F.regexp_replace("description", r"\s*\.+\s*$", ""), r"\s+", " ")
    out = out.withColumn("description", F.when(F.col("is_section_header"), F.col("description")).otherwise(tidy))
    filled = _fill_blank_description(out.drop("kind"), descriptions)
    total = ~F.col("is_section_header") & _contains_any(F.upper("description"), dims.BALANCE_TOTAL_WORDS)
    return filled.withColumn("is_total", total)


def parse_text_rows(rows: DataFrame, descriptions: DataFrame, line: str = "row_text") -> DataFrame:
    """Balance-sheet rows from plain text lines with one code each (five ordered patterns)."""
    row = F.col(line)
    choice = F.when(
        ~row.rlike(dims.COLLAPSED_CODE_PATTERN), _numbered_text(text.strip(row), "header", F.lit(""), F.lit(""), True)
    )
    for pattern, has_item in dims.TEXT_ROW_PATTERNS:
        choice = choice.when(row.rlike(pattern), _pattern_match(row, pattern, has_item, True))
    # Last resort: any code and any amount, described by the text before the code.
    before = text.strip(F.regexp_extract(row, rf"^(.*?){dims.BALANCE_CODE_PATTERN}", 1))
    any_amount = F.regexp_extract(row, r"[-]?[\d,]+", 0)
    choice = choice.when(
        row.rlike(dims.BALANCE_CODE_PATTERN) & (any_amount != ""),
        _numbered_text(before, "fallback", F.regexp_extract(row, dims.BALANCE_CODE_PATTERN, 0), any_amount, True),
    )
    out = _parsed(rows.filter(~_contains_any(row, dims.TEXT_ROW_SKIPS) & (text.strip(row) != "")), choice)
    out = out.filter(
        ~F.col("is_section_header") | ((F.length("description") > 3) & ~F.col("description").rlike(r"^\d+$"))
    )
    matched = F.col("kind") == "match"
    tidy = F.regexp_replace("description", r"\s*\([^)]+\)\s*:?\s*$", "")
    tidy = text.strip(F.regexp_replace(tidy, r"\s*\.+\s*$", ""))
    out = out.withColumn("description", F.when(matched, tidy).otherwise(F.col("description")))
    joined = with_dictionary(out, descriptions)
    label = F.concat(F.when(matched, "Line item ").otherwise("Item "), F.col("code"))
    blank = (F.col("code") != "") & F.col("description").isin("", ".", "-")
    filled = F.when(blank, F.coalesce(F.nullif("known", F.lit("")), label)).otherwise(F.col("description"))
    joined = joined.withColumn("description", filled)
    total = matched & _contains_any(F.upper("description"), dims.BALANCE_TOTAL_WORDS)
    return joined.withColumn("is_total", total).drop("kind", "known")


def split_collapsed(grid: DataFrame, descriptions: DataFrame, keys: list[str], cells: str = "cells") -> DataFrame:
    """Rows whose first cell with several "code amount" pairs becomes one row per pair.

    The first pair keeps the row's line item and description; later ones are described by the
    dictionary, else by their code.  Rows without such a cell are not part of the result.
    """
    pairs = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(dims.COLLAPSED_PAIR_PATTERN), F.lit(0))
    positions = F.transform(cells, lambda c, i: F.when(F.size(pairs(c)) > 1, i))
    first = F.get(F.filter(positions, lambda i: i.isNotNull()), F.lit(0))
    rows = grid.withColumn("_at", first).filter(F.col("_at").isNotNull())
    before = F.transform(F.slice(cells, F.lit(1), F.col("_at")), lambda c: text.strip(F.coalesce(c, F.lit(""))))
    worded = F.get(F.filter(before, lambda c: (c != "") & ~c.rlike(r"^[\d,]+$")), F.lit(0))
    numbered = F.col("_text").rlike(dims.LINE_PREFIX_PATTERN)
    exploded = rows.select(
        *keys, F.coalesce(worded, F.lit("")).alias("_text"), F.posexplode(pairs(F.get(cells, F.col("_at")))).alias("pair_ix", "_pair")
    )
    first_pair = F.col("pair_ix") == 0
    item = F.when(first_pair & numbered, F.rtrim(F.regexp_extract("_text", dims.LINE_PREFIX_PATTERN, 1), F.lit("."))).otherwise("")
    own = F.when(numbered, F.regexp_extract("_text", dims.LINE_PREFIX_PATTERN, 2)).otherwise(F.col("_text"))
    parsed = exploded.select(
        *keys,
        "pair_ix",
        item.alias("line_item"),
        F.when(first_pair, own).otherwise("").alias("description"),
        F.concat(
            F.regexp_extract("_pair", dims.COLLAPSED_PAIR_PATTERN, 1), F.regexp_extract("_pair", dims.COLLAPSED_PAIR_PATTERN, 2)
        ).alias("code"),
        F.regexp_extract("_pair", dims.COLLAPSED_PAIR_PATTERN, 3).alias("amount"),
    )
    joined = with_dictionary(parsed, descriptions)
    described = (
        F.when(F.col("description") != "", F.col("description"))
        .when(F.col("known") != "", F.col("known"))
        .otherwise(F.concat(F.lit("Line item for "), "code"))
    )
    return joined.withColumns(
        {"description": described, "is_total": _contains_any(F.upper(described), dims.BALANCE_TOTAL_WORDS)}
    ).drop("known")


def page_schedule(page_text: Column) -> Column:
    """Struct (schedule_code, title) named on a page, null for a page without a schedule title."""
    balance = page_text.rlike(dims.BALANCE_TITLE_PATTERN)
    general = page_text.rlike(dims.SCHEDULE_TITLE_PATTERN)
    group = lambda i: F.regexp_extract(page_text, dims.SCHEDULE_TITLE_PATTERN, i)
    base, letter, part = F.upper(group(1)), F.upper(group(2)), group(3)
    code = (
        F.when((letter != "") & (part != ""), F.concat(base, F.lit("-"), letter, F.lit(" "), part))
        .when(letter != "", F.concat(base, F.lit("-"), letter))
        .otherwise(base)
    )
    title = text.strip(F.regexp_replace(group(4), r"\s+", " "))
    return F.when(
        balance, F.struct(F.lit("RC").alias("schedule_code"), F.lit(dims.BALANCE_TITLE).alias("title"))
    ).when(general, F.struct(code.alias("schedule_code"), title.alias("title")))


def carry_schedules(pages: DataFrame, keys: list[str], page: str = "page_num", page_text: str = "page_text") -> DataFrame:
    """Each page's schedule; pages without a title belong to the schedule before them."""
    found = page_schedule(F.col(page_text))
    carried = running_values(pages, keys, page, carried={"schedule": found}, block_rows=1024)
    return carried.select(*pages.columns, "schedule.schedule_code", "schedule.title")


def with_schedule_titles(rows: DataFrame) -> DataFrame:
    """Official title by code, else by the code before " Part ", else the title found in the document."""
    titles = dims.schedule_titles(rows.sparkSession)
    exact = F.broadcast(titles)
    base = F.broadcast(titles.select(F.col("schedule_code").alias("_base"), F.col("proper_name").alias("_base_name")))
    keyed = rows.withColumn("_base", F.get(F.split("schedule_code", " Part "), F.lit(0)))
    joined = keyed.join(exact, "schedule_code", "left").join(base, "_base", "left")
    return joined.withColumn("proper_name", F.coalesce("proper_name", "_base_name", "title", "schedule_code")).drop(
        "_base", "_base_name"
    )


def section_ranges(rows: DataFrame, keys: list[str], order: str = "row_ix") -> DataFrame:
    """Title, first and last row of every section that a header row opens."""
    numbered = running_values(rows, keys, order, sums={"section_no": F.col("is_section_header").cast("int")})
    inside = numbered.filter(F.col("section_no") > 0)
    return inside.groupBy(*keys, "section_no").agg(
        F.min(order).alias("start_ix"), F.max(order).alias("end_ix"), F.min_by("description", order).alias("title")
    )


def report_layout(rows: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Printed columns of schedule rows: four for the balance sheet, three (indented) for the others."""
    joined = rows if "known" in rows.columns else with_dictionary(rows, descriptions)
    fill = _blank(F.col("description")) & (F.col("code") != "") & (F.col("known") != "")
    described = F.when(fill, F.col("known")).otherwise(F.col("description"))
    indented = F.concat(F.repeat(F.lit("    "), F.col("indent")), described)
    balance = F.col("schedule_code") == "RC"
    return joined.withColumns(
        {
            "printed_item": F.when(balance, F.col("line_item")),
            "printed_description": F.when(balance, F.col("description")).otherwise(indented),
            "printed_amount": text.report_amount(F.col("amount")),
        }
    ).drop("known")
