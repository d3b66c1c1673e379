"""Column expressions over file names, schedule codes, quarters and table names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarterlight import dims


def file_name(path: Column) -> Column:
    """Last path component; for a part file written by Spark, the folder that stands for the file."""
    return F.regexp_extract(F.regexp_replace(path, r"/part-[^/]*$", ""), r"([^/]*)$", 1)


def schedule_code(name: Column) -> Column:
    """Schedule code in a file name, null when there is none."""
    named = [F.nullif(F.upper(F.regexp_extract(name, p, 1)), F.lit("")) for p in dims.NAMED_SCHEDULE_PATTERNS]
    upper = F.upper(name)

    def stands_alone(code: Column) -> Column:
        at = F.instr(upper, code)
        before = F.when(at > 1, F.substring(upper, at - 1, F.lit(1))).otherwise("")
        after = F.substring(upper, at + F.length(code), F.lit(1))
        return (at > 0) & ~before.rlike("[A-Z0-9]") & ~after.rlike("[A-Z]")

    scan = F.array(*[F.lit(c) for c in dims.NAME_SCAN_CODES])
    return F.coalesce(*named, F.get(F.filter(scan, stands_alone), F.lit(0)))


def base_schedule(code: Column) -> Column:
    """Schedule code without part numbers; some families keep their first three letters only."""
    upper = F.upper(code)
    family = F.substring(upper, 1, 3)
    return F.when(family.isin(*dims.THREE_LETTER_FAMILIES), family).otherwise(
        F.regexp_replace(upper, r"[0-9]+$", "")
    )


def listing_match(name: Column) -> Column:
    """The part of a bulk file name from the publisher's prefix to the report date, '' if there is none."""
    coded = [c for c in dims.EXPECTED_SCHEDULES if c != dims.BULK_ONLY_SCHEDULE]
    pattern = (
        rf"(?i)FFIEC\s+CDR\s+Call\s+(?:Schedule\s+(?:{'|'.join(coded)})|Bulk\s+{dims.BULK_ONLY_SCHEDULE})"
        r"\s+[0-9]{8}"
    )
    return F.regexp_extract(name, pattern, 0)


def listing_fields(name: Column, match: Column | None = None) -> dict[str, Column]:
    """Schedule, report date, year, quarter and part of a bulk file name; nulls when it is none.

    ``match`` is the name's ``listing_match`` if it has been computed already.
    """
    words = F.split(listing_match(name) if match is None else match, r"\s+")
    code = F.upper(F.try_element_at(words, F.lit(-2)))
    report_date = F.try_element_at(words, F.lit(-1))
    day = F.try_to_date(F.nullif(report_date, F.lit("")), "MMddyyyy")
    part = F.regexp_extract(name, dims.PART_PATTERN, 1)
    known = day.isNotNull()
    return {
        "schedule_code": F.when(known, F.concat(code, part)),
        "report_date": F.when(known, report_date),
        "year": F.year(day),
        "quarter": F.quarter(day),
        "part": F.when(known, F.nullif(part, F.lit("")).cast("int")),
    }


def quarter_key(year: Column, quarter: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("-Q"), quarter.cast("string"))


def sheet_name(name: Column, index: Column) -> Column:
    """Table name usable as a sheet or folder name of at most 31 characters."""
    safe = F.translate(name, dims.SHEET_NAME_INVALID, "_" * len(dims.SHEET_NAME_INVALID))
    long_form = F.concat(F.substring(safe, 1, 27), F.lit("_"), index.cast("string"))
    return F.when(F.length(safe) > dims.SHEET_NAME_LIMIT, long_form).otherwise(safe)


def section_slug(section: Column) -> Column:
    return F.substring(F.replace(F.regexp_replace(section, r"[^\w\s]", ""), F.lit(" "), F.lit("_")), 1, 40)


def table_name(prefix: Column, section: Column, index: Column) -> Column:
    return F.concat_ws("_", prefix, section_slug(section), (index + 1).cast("string"))


def csv_file_name(name: Column) -> Column:
    plain = F.regexp_replace(name, r"[^\w\s-]", "")
    return F.concat(F.regexp_replace(plain, r"[-\s]+", "-"), F.lit(".csv"))


def line_item_key(line_item: Column) -> Column:
    """Sort key struct (grp, main, sub, letter) of a hierarchical line-item number."""
    parts = F.split(line_item, r"\.")
    second, third = F.get(parts, F.lit(1)), F.get(parts, F.lit(2))

    def digits(t: Column) -> Column:
        return F.when(t.rlike("^[0-9]+$"), t.try_cast("int"))

    blank = line_item.isNull() | (line_item == "")
    dotted = ~blank & (F.size(parts) >= 2)
    return F.struct(
        F.when(dotted, 0).otherwise(999).alias("grp"),
        F.when(dotted, F.coalesce(digits(second), F.lit(999))).otherwise(0).alias("main"),
        F.when(dotted, F.coalesce(digits(third), F.lit(0))).otherwise(0).alias("sub"),
        F.when(blank, "")
        .when(~dotted, line_item)
        .when(third.isNull() | third.rlike("^[0-9]+$"), "")
        .otherwise(third)
        .alias("letter"),
    )
