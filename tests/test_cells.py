"""Cell texts, amounts and names: the edge cases of each rule."""

import pytest
from pyspark.sql import functions as F

from quarterlight.functions import names, text
from quarterlight.operators import normalize


def apply(spark, expression, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[1] for r in sorted(df.select("i", expression(F.col("x"))).collect())]


STRICT = [
    ("1234", "1234", "ok"), ("1,234", "1,234", "ok"), ("-5", "-5", "ok"), (".5", ".5", "ok"),
    ("(1,234)", "-1,234", "ok"), ("$12", "12", "ok"), ("12%", "12", "ok"), (" 7 ", "7", "ok"), ("1e5", "15", "ok"),
    ("(-5)", None, "invalid"), ("-", None, "invalid"), ("5-3", None, "invalid"), ("1.2.3", None, "invalid"),
    ("abc", None, "invalid"), (None, None, "skipped"), ("  ", None, "skipped"), (".", None, "skipped"),
    ("NA", None, "skipped"), ("N/A", None, "skipped"), ("ND", None, "withheld"), ("nr", None, "withheld"),
    ("CONF", None, "withheld"),
]


def test_strict_amounts(spark):
    cells = spark.createDataFrame([(i, c[0]) for i, c in enumerate(STRICT)], "i int, raw string")
    kept = {r.i: r.amount for r in normalize.keep_reported(cells).collect()}
    assert [kept.get(i) for i in range(len(STRICT))] == [c[1] for c in STRICT]
    assert apply(spark, text.amount_status, [c[0] for c in STRICT]) == [c[2] for c in STRICT]


def test_raw_mode_keeps_everything_but_blanks(spark):
    cells = spark.createDataFrame([("ND",), (" ",), (None,), ("5d",), ("1,5",)], "raw string")
    kept = {r.amount: r.amount_num for r in normalize.keep_reported(cells, "raw").collect()}
    assert kept == {"ND": None, "5d": None, "1,5": 15.0}
    with pytest.raises(ValueError):
        normalize.keep_reported(cells, "other")


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("  Total  assets\n", "Total assets"), ("Cash (a)", "Cash"), ("Loans (12)", "Loans"), ("Net **", "Net"),
        ("(1,234)", "-1,234"), ("(123)", ""), ("$ 5", "$5"), ("7 %", "7%"), ("", ""), (None, ""), ("( 1,234.5 )", "-1,234.5"),
    ],
)
def test_clean_cell(spark, raw, clean):
    assert apply(spark, text.clean_cell, [raw]) == [clean]


def test_clean_cell_with_negatives_first(spark):
    assert apply(spark, lambda c: text.clean_cell(c, True), ["(123)", "x (1)"]) == ["-123", "x"]


def test_report_and_display_amounts(spark):
    assert apply(spark, text.report_amount, ["(1234)", "1234567", "-7", " 1.5 ", "", None, "0012"]) == [
        "-1,234", "1,234,567", "-7", "1.5", "", "", "12",
    ]
    assert apply(spark, text.format_amount, ["$1,234.9", "(12)", "-0.5", "NA", " x ", "", "-", "1e20", "12d"]) == [
        "1,234", "-12", "0", "NA", "x", "", "-", "100,000,000,000,000,000,000", "12d",
    ]


def test_numeric_and_flags(spark):
    assert apply(spark, text.is_numeric, ["(1,234.5)", "$5%", "", "x", None, "1 2", ".,"]) == [
        True, True, False, False, False, False, False,
    ]
    df = spark.createDataFrame([("$ 5",), ("12%",), ("( 1,2 )",), ("1/2/2024 x",), ("RCON2170",), ("word",)], "x string")
    flags = df.select("x", *[c.alias(n) for n, c in text.cell_flags(F.col("x")).items()]).collect()
    assert [[n for n in ("is_currency", "is_number", "is_percentage", "is_date", "is_code") if r[n]] for r in flags] == [
        ["is_currency", "is_number"], ["is_number", "is_percentage"], ["is_number"], ["is_date"], ["is_code"], [],
    ]


def test_delimited_cells_and_csv(spark):
    lines = ['a,"b, ""c""",', "", ',x', '"q"']
    assert apply(spark, lambda c: text.split_delimited(c, ","), lines) == [["a", 'b, "c"', ""], [""], ["", "x"], ["q"]]
    assert apply(spark, lambda c: text.csv_line(F.split(c, ";")), ['a;b,c;d"e']) == ['a,"b,c","d""e"']


def test_schedule_codes(spark):
    files = [
        "FFIEC CDR Call Schedule RCT 03312025(2 of 2).txt", "call schedule rcri 1.txt", "ScheduleRC2.txt", "x_RCN_1.txt",
        "my rcn.txt", "RCA.txt", "abcRC RC.txt", "nothing.txt", "RC1.txt",
    ]
    # RC is looked for first and only at its first place, so "abcRC RC" has no code.
    assert apply(spark, names.schedule_code, files) == ["RCT", "RCRI", "RC2", "RCN", "RCN", "RCA", None, None, "RC"]
    assert apply(spark, names.base_schedule, ["RCR1", "rcl", "RCT2", "RC12", "RCNII", "RI"]) == [
        "RCR", "RCL", "RCT", "RC", "RCN", "RI",
    ]


def test_listing_fields(spark):
    listed = {
        "FFIEC CDR Call Schedule RCT 03312025(2 of 2).txt": ("RCT2", "03312025", 2025, 1, 2),
        "FFIEC CDR Call Bulk POR 12312024.txt": ("POR", "12312024", 2024, 4, None),
        "ffiec cdr call schedule rc 06302024.txt": ("RC", "06302024", 2024, 2, None),
        "FFIEC CDR Call Schedule RC 13312015.txt": (None,) * 5,
        "FFIEC CDR Call Schedule POR 12312024.txt": (None,) * 5,
        "Readme.txt": (None,) * 5,
    }
    df = spark.createDataFrame([(n,) for n in listed], "filename string")
    got = df.select("filename", *[c.alias(k) for k, c in names.listing_fields(F.col("filename")).items()]).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == listed


def test_line_item_order(spark):
    items = ["RC.10", "RC.2.b", "RC.2.a", "", "RC.2", "X", "RC.x.1", "RC.2.3", "RC.13.a.1"]
    df = spark.createDataFrame([(i,) for i in items], "x string")
    ordered = [r.x for r in df.orderBy(names.line_item_key(F.col("x"))).collect()]
    assert ordered == ["RC.2", "RC.2.a", "RC.2.b", "RC.2.3", "RC.10", "RC.13.a.1", "RC.x.1", "", "X"]


def test_table_names(spark):
    df = spark.createDataFrame([("a:b/c", 1), ("x" * 40, 2)], "n string, i int")
    got = [r[0] for r in df.select(names.sheet_name(F.col("n"), F.col("i"))).collect()]
    assert got == ["a_b_c", "x" * 27 + "_2"]
