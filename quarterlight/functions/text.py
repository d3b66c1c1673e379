"""Column expressions for amounts and cell texts.  All are built-in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarterlight import dims

_BLANKS = " \t\n\r\f\x0b"
_ENTITIES = (
    ("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
    ("&#39;", "'"), ("&apos;", "'"), ("&#36;", "$"), ("&mdash;", "—"), ("&#8212;", "—"),
    ("&ndash;", "–"), ("&#8211;", "–"), ("&amp;", "&"),
)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once, for expressions that mention it several times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def to_number(text: Column) -> Column:
    """Text to double, null when it is not a number.

    The cast alone would accept a trailing type letter ("5d"), which is not a number in a report.
    """
    return F.when(~text.rlike(r"[0-9.][dDfF]\s*$"), text.try_cast("double"))


def amount_number(amount: Column) -> Column:
    """Amount text with thousands separators to double, else null."""
    return to_number(F.replace(amount, F.lit(","), F.lit("")))


def null_tokens(raw: Column) -> Column:
    """Null for the cell texts that mean "missing" in a tab-separated file."""
    return F.when(~raw.isin(*dims.NULL_TOKENS), raw)


def amount_status(raw: Column) -> Column:
    """skipped / withheld / invalid / ok for one raw cell."""
    text = strip(raw)
    return (
        F.when(raw.isNull() | text.isin(*dims.SKIPPED_AMOUNTS), "skipped")
        .when(F.upper(text).isin(*dims.WITHHELD_AMOUNTS), "withheld")
        .when(strict_number(_digits_with_sign(text)).isNull(), "invalid")
        .otherwise("ok")
    )


def strict_amount(raw: Column) -> Column:
    """Digits, separators and sign of an amount; null for blank and withheld cells.

    The text need not be a number yet; ``strict_number`` of it is null if it is not.
    """
    return stripped_amount(strip(raw))


def stripped_amount(text: Column) -> Column:
    """``strict_amount`` of a text without outer blanks."""
    kept = ~text.isin(*dims.SKIPPED_AMOUNTS) & ~F.upper(text).isin(*dims.WITHHELD_AMOUNTS)
    return F.when(kept, _digits_with_sign(text))


def strict_number(amount: Column) -> Column:
    """Number in a text that ``strict_amount`` has cleaned (no letters are left in it)."""
    return F.replace(amount, F.lit(",")).try_cast("double")


def _digits_with_sign(text: Column) -> Column:
    sign = F.when(text.startswith("(") & text.endswith(")"), "-").otherwise("")
    return F.concat(sign, F.regexp_replace(text, r"[^0-9\-.,]", ""))


def parentheses_to_minus(text: Column) -> Column:
    inner = F.concat(F.lit("-"), F.substring(text, F.lit(2), F.length(text) - 2))
    return F.when(text.startswith("(") & text.endswith(")"), inner).otherwise(text)


def report_amount(raw: Column) -> Column:
    """Amount as printed in a schedule report: minus sign, thousands separators for whole numbers."""
    text = parentheses_to_minus(strip(raw))
    grouped = F.format_number(text.try_cast("decimal(38,0)"), 0)
    return F.when(raw.isNull() | (raw == ""), "").when(text.rlike(r"^-?\d+$"), grouped).otherwise(text)


def format_amount(raw: Column) -> Column:
    """Whole-number display of an amount, truncated toward zero; unparsable text is kept."""
    text = strip(raw)
    number = to_number(parentheses_to_minus(F.replace(F.replace(text, F.lit(",")), F.lit("$"))))
    whole = F.when(F.abs(number) < 9.0e15, number.try_cast("bigint").cast("decimal(38,0)")).otherwise(
        number.try_cast("decimal(38,0)")
    )
    return (
        F.when(raw.isNull() | (text == ""), "")
        .when(F.upper(text).isin("NA", "N/A", "-"), text)
        .otherwise(F.coalesce(F.format_number(whole, 0), text))
    )


#: Words of one blank between them, without anything that ``markup_text`` or ``clean_cell`` changes.
_PLAIN_CELL = r"^[A-Za-z0-9.,-]+(?: [A-Za-z0-9.,-]+)*\z"


def cell_text(html: Column, negatives_first: bool = False) -> Column:
    """``clean_cell`` of ``markup_text``.  Most cells are plain, which one test settles."""

    def cleaned(t: Column) -> Column:
        return F.when(t.rlike(_PLAIN_CELL), t).otherwise(clean_cell(markup_text(t), negatives_first))

    return let(html, cleaned)


def clean_cell(raw: Column, negatives_first: bool = False) -> Column:
    """Cell text without notes and stray blanks.

    Note marks such as (1) go before bracketed negatives are recognised, so "(123)" becomes blank and
    "(1,234)" becomes "-1,234".  ``negatives_first`` turns the two steps round.
    """
    text = strip(F.regexp_replace(raw, r"(?U)\s+", " "))

    def drop_notes(t: Column) -> Column:
        for mark in dims.NOTE_MARKS:
            t = F.regexp_replace(t, mark, "")
        return t

    def negatives(t: Column) -> Column:
        digits = lambda v: F.concat(F.lit("-"), F.regexp_replace(v, r"[^\d,.]", ""))
        return let(t, lambda v: F.when(v.rlike(dims.BRACKETED_NUMBER), digits(v)).otherwise(v))

    text = drop_notes(negatives(text)) if negatives_first else negatives(drop_notes(text))
    text = F.regexp_replace(text, r"\$\s+", r"\$")
    return F.coalesce(strip(F.regexp_replace(text, r"\s+%", "%")), F.lit(""))


def is_numeric(text: Column) -> Column:
    stripped = F.translate(text, ",$%.()", "")
    return F.coalesce((text != "") & to_number(stripped).isNotNull(), F.lit(False))


def cell_flags(text: Column) -> dict[str, Column]:
    """Content flags of one cell: currency, number, percentage, date, code."""
    trimmed = strip(text)
    currency = trimmed.contains("$") | F.lower(trimmed).contains("usd")
    percentage = trimmed.contains("%")
    plain = F.replace(trimmed, F.lit(" "), F.lit("")).rlike(dims.NUMBER_CELL_PATTERN)
    return {
        "is_currency": currency,
        "is_number": currency | percentage | plain,
        "is_percentage": percentage,
        "is_date": trimmed.rlike(dims.DATE_CELL_PATTERN),
        "is_code": text.rlike(dims.GRID_CODE_PATTERN),
    }


def markup_text(html: Column) -> Column:
    """Visible text of a piece of markup: tags removed, common entities decoded."""
    text = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for entity, char in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def csv_line(cells: Column) -> Column:
    """One CSV line from an array of strings, quoted only where needed."""

    def quoted(cell: Column) -> Column:
        doubled = F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(cell.rlike(r'[",\r\n]'), doubled).otherwise(cell)

    return F.array_join(F.transform(cells, lambda c: quoted(F.coalesce(c, F.lit("")))), ",")


def split_delimited(line: Column, separator: str) -> Column:
    """Cells of one delimited line, honouring double quotes."""
    sep = {"|": r"\|", "\t": r"\t"}.get(separator, separator)
    cell = rf'{sep}("[^"]*(?:""[^"]*)*"|[^{sep}]*)'
    raw = F.regexp_extract_all(F.concat(F.lit(separator), line), F.lit(cell), F.lit(1))

    def unquote(c: Column) -> Column:
        inner = F.substring(c, F.lit(2), F.length(c) - 2)
        return F.when(
            (F.length(c) > 1) & c.startswith('"') & c.endswith('"'), F.replace(inner, F.lit('""'), F.lit('"'))
        ).otherwise(c)

    return F.transform(raw, unquote)
