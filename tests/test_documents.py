"""Documents: nested tables, ragged rows, facts, sections; running values against brute force."""

import random
import time

from pyspark.sql import functions as F

from quarterlight.functions import text
from quarterlight.operators import joins, report_rows, tables
from quarterlight.sources import documents


def _grid(spark, html):
    docs = spark.createDataFrame([(1, html)], "doc_id int, html string")
    return documents.table_grids(documents.html_tables(docs)).orderBy("table_ix").collect()


def test_colspan_ragged_and_cells(spark):
    html = (
        "<TABLE class='x'><tr><th colspan=\"3\">Head &amp; tail</th></tr><!-- <table> -->"
        "<tr><td>a</td><td><b>(1,234)</b></td></tr>\n<tr><td>$ 5<td>7 %<td>(123)</tr></TABLE>"
    )
    (only,) = _grid(spark, html)
    assert only.cells == [["Head & tail", "", ""], ["a", "-1,234", ""], ["$5", "7%", ""]]
    assert (only.n_rows, only.n_cols) == (3, 3)


def test_nested_tables_keep_their_own_rows(spark):
    html = (
        "<table><tr><td>before</td></tr><tr><td>x<table><tr><td>inner</td></tr></table>y</td></tr>"
        "<tr><td>after</td></tr></table><p>text</p><table></table><table><tr><td>last</td></tr>"
    )
    grids = _grid(spark, html)
    assert [g.cells for g in grids] == [[["before"], ["xy"], ["after"]], [["inner"]], [], [["last"]]]
    assert _grid(spark, "<p>no table</p>") == []


def test_text_blocks_skip_scripts(spark):
    html = "<script>var a='<p>no</p>'</script><h1>Balance Sheets</h1><div>x<p>Deposits &amp; more</p></div>"
    docs = spark.createDataFrame([(1, html)], "page_id int, html string")
    sections = tables.financial_sections(documents.text_blocks(docs), ["page_id"]).collect()
    assert [(s.tag, s.keyword, s.priority) for s in sections] == [("h1", "balance sheets", 10), ("p", "deposits", 10)]


def test_facts_and_period(spark):
    content = (
        "<r><xbrli:context><xbrli:period><xbrli:instant>2024-03-31</xbrli:instant></xbrli:period></xbrli:context>"
        '<US-GAAP:Assets contextRef="c1" unitRef="USD" decimals="-3"> 12 </US-GAAP:Assets></r>'
    )
    docs = spark.createDataFrame([(1, content), (2, "<r><a>5</a><a>word</a></r>")], "doc_id int, content string")
    got = {(r.doc_id, r.category, r.value, r.context, r.unit, r.decimals) for r in documents.facts(docs).collect()}
    assert got == {(1, "instant", "2024-03-31", "", "", ""), (1, "assets", "12", "c1", "USD", "-3"), (2, "numeric_data", "5", "", "", "")}
    assert docs.select(documents.report_period(F.col("content"))).first()[0] == "2024-03-31"


def test_routing(spark):
    paths = ["a.PDF", "b.sdf", "c.txt", "d.xbrl", "e.htm", "f"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(documents.document_kind(F.col("p"))).collect()] == ["pdf", "delimited", "delimited", "xbrl", "html", "html"]


def test_running_values_equal_brute_force(spark):
    rng = random.Random(5)
    data = [(k, i, rng.random() < 0.2, rng.choice([None, None, None, f"v{i}"])) for k in ("hot", "cold") for i in range(200 if k == "hot" else 7)]
    df = spark.createDataFrame(data, "k string, pos int, flag boolean, v string").repartition(5)
    got = joins.running_values(
        df, ["k"], "pos", sums={"n": F.col("flag").cast("int")}, carried={"last": F.col("v")}, block_rows=8
    ).select("k", "pos", "n", "last").collect()
    expected, total, last = {}, {}, {}
    for k, pos, flag, v in data:
        total[k] = total.get(k, 0) + flag
        last[k] = v if v is not None else last.get(k)
        expected[k, pos] = (total[k], last[k])
    assert {(r.k, r.pos): (r.n, r.last) for r in got} == expected


def test_lookup_join_equals_plain_join_without_broadcast(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("x"))
    lookup = spark.createDataFrame([(0, "a"), (1, "b")], "k bigint, name string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = joins.lookup_join(rows, lookup, ["k"]).select("k", "x", "name").collect()
        inner = joins.lookup_join(rows, lookup, ["k"], how="inner").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    expected = [(i % 3, i, {0: "a", 1: "b"}.get(i % 3)) for i in range(1000)]
    assert sorted(map(tuple, left), key=repr) == sorted(expected, key=repr) and inner == 667


def test_delimited_sections(spark):
    content = "h1|a\nh2|b\n\nSchedule RC|x\n1|2\n\nlone|1\n\nSCHEDULE RI|1\n3|4\n"
    docs = spark.createDataFrame([(1, content)], "doc_id int, content string")
    got = tables.delimited_sections(documents.delimited_lines(docs), ["doc_id"]).orderBy("line_no").collect()
    assert [(r.section, r.line_no, r.cells) for r in got] == [
        ("Call_Report_Data", 0, ["h1", "a"]), ("Call_Report_Data", 1, ["h2", "b"]),
        ("Schedule RC", 3, ["Schedule RC", "x"]), ("Schedule RC", 4, ["1", "2"]),
        ("SCHEDULE RI", 8, ["SCHEDULE RI", "1"]), ("SCHEDULE RI", 9, ["3", "4"]),
    ]


def test_report_rows(spark):
    none = spark.createDataFrame([("RCON2170", "Total assets")], "mdrm_code string, description string")
    grid = spark.createDataFrame(
        [
            (0, ["1. Cash", "RCFD0010", "5"]), (1, ["", "RCON2170", "1,000"]), (2, ["(iv) x 3.", None, "7.5"]),
            (3, ["d. y .....", "1.a. z"]), (4, [None, " "]), (5, ["lower case"]),
        ],
        "row_ix int, cells array<string>",
    )
    got = report_rows.classify_rows(grid, none).orderBy("row_ix").collect()
    assert [(r.row_ix, r.description, r.code, r.amount, r.indent, r.is_section_header, r.is_total) for r in got] == [
        (0, "1. Cash", "RCFD0010", "5", 0, True, False), (1, "Total assets", "RCON2170", "1,000", 0, False, True),
        (2, "(iv) x", "", "7.5", 3, False, False), (3, "d. y ..... 1.a. z", "", "", 1, False, False), (5, "lower case", "", "", 1, False, False),
    ]


def test_page_schedule_titles(spark):
    pages = spark.createDataFrame(
        [(1, 0, "cover"), (1, 1, "Schedule RC – Consolidated Balance Sheet"), (1, 2, "more"), (1, 3, "Schedule RI-B Part I Charge-offs"), (2, 0, "x")],
        "doc_id int, page_num int, page_text string",
    )
    carried = report_rows.carry_schedules(pages, ["doc_id"])
    got = report_rows.with_schedule_titles(carried).collect()
    assert sorted((r.doc_id, r.page_num, r.schedule_code, r.proper_name) for r in got if r.schedule_code) == [
        (1, 1, "RC", "Consolidated Balance Sheet"), (1, 2, "RC", "Consolidated Balance Sheet"), (1, 3, "RI-B Part I", "Charge-offs and Recoveries"),
    ]
    assert len(got) == 5


def test_text_row_last_resort(spark):
    none = spark.createDataFrame([], "mdrm_code string, description string")
    df = spark.createDataFrame([("12 Odd line RCON1 no amount",), ("Plain heading",), ("12",), ("RCFD77 5",)], "row_text string")
    got = sorted((r.line_item, r.description, r.code, r.amount, r.is_section_header) for r in report_rows.parse_text_rows(df, none).collect())
    assert got == [("", "Item RCFD77", "RCFD77", "77", False), ("", "Plain heading", "", "", True), ("12", "Odd line", "RCON1", "12", False)]


def test_sections_with_markup_and_stop_headings(spark):
    table = "<table><tr><td>1</td></tr></table>"
    html = (
        f"{table}<p><b>Consolidated Balance Sheets</b></p>{table}<p>text</p>{table}<h2>Signatures</h2>{table}"
        f"<div>Consolidated <i>Statements</i> of Income</div>{table}<h3>Item 9. Exhibits</h3>{table}<p>Item 5 is text</p>{table}"
    )
    docs = spark.createDataFrame([(1, html), (2, "no table")], "doc_id int, html string")
    got = {r.table_ix: r.keyword for r in tables.tables_with_sections(docs).collect()}
    assert got[0] is None and got[3] is None and got[5] is None and got[6] is None
    assert "balance sheet" in got[1] and got[2] == got[1] and "income" in got[4]


def test_tables_grow_in_proportion(spark):
    def seconds(n):
        one = "<table><tr><td>a<table><tr><td>b</td></tr></table></td></tr></table>"
        docs = spark.createDataFrame([(1, one * (n // 2))], "doc_id int, html string")
        start = time.perf_counter()
        assert documents.html_tables(docs).count() == n
        return time.perf_counter() - start

    seconds(100)
    assert seconds(16_000) < 8 * seconds(4_000) + 5


def test_nested_and_unbalanced_tables(spark):
    html = "</table>x<table>A<table>B</table>C</table>y</table><table>D"
    docs = spark.createDataFrame([(1, html)], "doc_id int, html string")
    got = sorted((r.table_ix, r.table_html.replace("<table>", "").replace("</table>", "")) for r in documents.html_tables(docs).collect())
    assert got == [(0, "AC"), (1, "B"), (2, "D")]


def test_a_table_text_is_made_once_for_all_words(spark):
    """The filter on ``is_financial`` is pushed down to where the text is made: it must not be made for every word."""
    grids = documents.table_grids(documents.html_tables(spark.createDataFrame([(1, "<table><tr><td>1</td></tr></table>")], "doc_id int, html string")))
    plan = tables.financial_tables(tables.table_profile(grids)).select("doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction(Contains(lower(" not in plan and "lambdafunction(contains(lower(" not in plan.lower()
    assert "contains(" in plan.lower()


def test_wide_rows_of_plain_cells(spark):
    """Cells without spans are put side by side: no column is looked for, which took the square of a row's width."""
    n = 12_000
    row = lambda r: "<tr>" + "".join(f"<td>{r} {c}</td>" for c in range(n)) + "</tr>"
    spanned = "<table><tr><td rowspan=2>a</td><td>b (1)</td></tr><tr><td> 1&amp;2 </td></tr><tr></tr></table>"
    docs = spark.createDataFrame([(0, f"<table>{row(0)}{row(1)}</table>"), (1, spanned)], "doc_id long, html string")
    began = time.time()
    grids = {r["doc_id"]: r["cells"] for r in documents.table_grids(documents.html_tables(docs)).collect()}
    assert time.time() - began < 10
    assert grids == {0: [[f"{r} {c}" for c in range(n)] for r in (0, 1)], 1: [["a", "b"], ["", "1&2"], ["", ""]]}


def test_plain_cells_are_cleaned_like_all_others(spark):
    cells = [None, "", "a", "a b", "a  b", " a", "a\n", "1,234", "-5", "(5)", "(a) x", "x*", "$ 5", "5 %", "<b>x</b>", "a&amp;b", "é", "a b", "a\tb", "1.5 m", "a b\r"]
    rows = spark.createDataFrame([(c,) for c in cells], "c string")
    for first in (False, True):
        both = rows.select(text.cell_text(F.col("c"), first).alias("now"), text.clean_cell(text.markup_text(F.col("c")), first).alias("then")).collect()
        assert [r["now"] for r in both] == [r["then"] for r in both]
