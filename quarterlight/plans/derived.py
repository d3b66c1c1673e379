"""Call-report shaped views over the general test tables.

The test tables hold no filings, so every view here is computed by Spark from whole tables: suppliers
act as institutions, shipping quarters as report quarters, orders as files, filings and documents.
Groups that are collected into one value are cut by key ranges of a unique key, so they are bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterlight import dims


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Report codes of the wide view: (schedule, code, whole-number formula over the quarter's sums).
# The sums are: total, flag_a, flag_n, flag_r, open_, filled (cents / 100), disc, tax, qty, lines.
WIDE_CODES = (
    ("RC", "RCFD2170", "total + 1000"),
    ("RC", "RCON2170", "total"),
    ("RC", "RCON2122", "flag_a + flag_r"),
    ("RC", "RCON2200", "flag_n"),
    ("RC", "RCON6631", "flag_a"),
    ("RC", "RCON3210", "total div 10"),
    ("RC", "RCON1773", "filled div 5"),
    ("RC", "RCON1754", "open_ div 8"),
    ("RC", "RCON1287", "flag_r div 20"),
    ("RC", "RCON0081", "flag_n div 15"),
    ("RC", "RCFD0071", "flag_a div 25"),
    ("RC", "RCON2604", "flag_n div 6"),
    ("RC", "RCON2800", "open_ div 9"),
    ("RC", "RCON2930", "filled div 11"),
    ("RC", "RCON3381", "total - flag_n div 10"),
    ("RC", "RCON3353", "flag_a + filled div 4"),
    ("RC", "RCONA564", "filled"),
    ("RC", "RCONA579", "open_"),
    ("RC", "RCON1600", "flag_r div 2"),
    ("RC", "RCON3545", "tax div 3"),
    ("RCN", "RCON1403", "flag_r div 40"),
    ("RCN", "RCON1407", "flag_r div 60"),
    ("RCN", "RCFD5389", "flag_n div 90"),
    ("RCRI", "RCOA7206", "8 + qty % 7"),
    ("RCRI", "RCOA7205", "9 + qty % 6"),
    ("RCRI", "RCOA7204", "4 + qty % 5"),
    ("RI", "RIAD4340", "disc - tax"),
    ("RI", "RIAD4074", "tax"),
    ("RI", "RIAD4079", "disc div 3"),
    ("RI", "RIAD4093", "disc div 2"),
    ("RI", "RIAD4230", "disc div 50"),
    ("RI", "RIAD4107", "tax div 2"),
    ("RI", "RIAD4020", "disc div 4"),
    ("RI", "RIAD4065", "lines * 100"),
    ("RI", "RIAD4170", "disc div 7"),
    ("RI", "RIAD4180", "disc div 9"),
)
SCHEDULE_OF = {code: schedule for schedule, code, _ in WIDE_CODES}
QUARTER = ["quarter_key"]


def quarter_sums(lineitem: DataFrame) -> DataFrame:
    """Whole-number sums per supplier and shipping quarter (exact, whatever the row order).

    Cents are shuffled once for each flag and status: what all lines sum to, and the filled ones, follows from these.
    """
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    quarter = F.year("l_shipdate") * 4 + F.quarter("l_shipdate") - 1

    def per_hundred(rate: str) -> Column:
        return F.expr(f"sum(cents * cast(round({rate} * 100) as bigint)) div 10000")

    def cents_where(condition: str) -> Column:
        return F.expr(f"sum(case when {condition} then cents end)")

    def hundreds(value: str) -> Column:
        return F.expr(f"coalesce({value}, 0) div 100")

    sums = (
        lineitem.withColumn("cents", cents)
        .groupBy(F.col("l_suppkey").alias("supp"), quarter.alias("quarter"))
        .agg(
            *[cents_where(f"l_returnflag = '{flag}'").alias(f"sum_{flag.lower()}") for flag in "ANR"],
            # A missing flag or status is another one.
            F.expr("sum(case when l_returnflag in ('A', 'N', 'R') then null else cents end)").alias("other_flag"),
            cents_where("l_linestatus = 'O'").alias("sum_o"),
            F.expr("sum(case when l_linestatus in ('O', 'F') then null else cents end)").alias("other_status"),
            per_hundred("l_discount").alias("disc"),
            per_hundred("l_tax").alias("tax"),
            F.expr("sum(cast(l_quantity as bigint))").alias("qty"),
            F.count(F.lit(1)).alias("lines"),
        )
    )
    flags = ("sum_a", "sum_n", "sum_r", "other_flag")
    # Null only where no line has a price.
    whole = F.when(F.coalesce(*flags).isNotNull(), sum((F.coalesce(f, F.lit(0)) for f in flags[1:]), F.coalesce(flags[0], F.lit(0))))
    return sums.withColumn("cents", whole).select(
        "supp", F.expr("cast(floor(quarter / 4) as int)").alias("y"), F.expr("cast(pmod(quarter, 4) + 1 as int)").alias("q"),
        F.expr("cents div 100").alias("total"), hundreds("sum_a").alias("flag_a"), hundreds("sum_n").alias("flag_n"),
        hundreds("sum_r").alias("flag_r"), hundreds("sum_o").alias("open_"),
        hundreds("cents - coalesce(sum_o, 0) - coalesce(other_status, 0)").alias("filled"),
        "disc", "tax", "qty", "lines",
    )


def _noisy(number: Column, code_ix: Column) -> Column:
    """Cell text; by a fixed rule some cells are blank, withheld, bracketed or malformed."""
    kind = F.pmod(F.col("supp") * 7 + F.col("qix") * 5 + code_ix * 3, F.lit(31))
    plain = number.cast("string")
    # Most cells are plain: the first test settles them.  In a lambda the number is worked out again for every test.
    return (
        F.when(kind > 11, plain)
        .when(kind == 0, F.lit(None).cast("string"))
        .when(kind == 1, "")
        .when(kind == 2, "NA")
        .when(kind == 3, "ND")
        .when(kind == 4, F.concat(F.lit("("), plain, F.lit(")")))
        .when(kind == 5, F.format_number(number, 0))
        .when(kind == 6, "abc")
        .when(kind == 7, ".")
        .when(kind == 8, F.concat(F.lit(" "), plain, F.lit(" ")))
        .when(kind == 9, F.concat(F.lit("$"), plain))
        .when(kind == 10, "conf")
        .when(kind == 11, F.concat(plain, F.lit("%")))
        .otherwise(plain)
    )


def wide_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDRSSD, quarter_key and 36 text code columns of four schedules, plus one column that is no code."""
    sums = quarter_sums(table(spark, sf_dir, "lineitem")).withColumn("qix", F.col("y") * 4 + F.col("q"))
    odd = F.col("supp") + F.col("qix")
    rssd = (
        F.when(F.pmod(odd, F.lit(53)) == 0, " ")
        .when(F.pmod(odd, F.lit(59)) == 0, "nan")
        .otherwise(F.col("supp").cast("string"))
    )
    quarter = F.concat(F.col("y").cast("string"), F.lit("-Q"), F.col("q").cast("string"))
    # One array expression for all cells keeps the generated code small.
    numbers = F.array(*[F.expr(formula) for _, _, formula in WIDE_CODES])
    rows = sums.select(
        rssd.alias(dims.ID_COLUMN), quarter.alias("quarter_key"), F.transform(numbers, _noisy).alias("cells"), "lines"
    )
    cells = [F.get("cells", F.lit(i)).alias(code) for i, (_, code, _) in enumerate(WIDE_CODES)]
    return rows.select(
        dims.ID_COLUMN, "quarter_key", *cells, F.col("lines").cast("string").alias("TEXT1234")
    )


def institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rssd_id, name; every tenth supplier is listed under an outdated id, so that default names occur."""
    current = F.col("s_suppkey").cast("string")
    rssd = F.when(F.col("s_suppkey") % 10 == 3, F.concat(F.lit("old-"), current)).otherwise(current)
    return table(spark, sf_dir, "supplier").select(rssd.alias("rssd_id"), F.col("s_name").alias("name"))


def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mdrm_code, description: parts as dictionary entries RCON0000, RCON0001, ..."""
    p = table(spark, sf_dir, "part")
    number = F.col("p_partkey").cast("string")
    padded = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    return p.select(F.concat(F.lit("RCON"), padded).alias("mdrm_code"), F.col("p_name").alias("description"))


def peer_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """peer_group, rssd_id, seq: of eleven consecutive suppliers, one, four and six form a group; the first is the primary."""
    return table(spark, sf_dir, "supplier").select(
        F.expr("s_suppkey div 11 * 3 + case when s_suppkey % 11 = 0 then 0 when s_suppkey % 11 < 5 then 1 else 2 end").alias("peer_group"),
        F.col("s_suppkey").cast("string").alias("rssd_id"),
        F.expr("cast(s_suppkey % 11 - case when s_suppkey % 11 = 0 then 0 when s_suppkey % 11 < 5 then 1 else 5 end as int)").alias("seq"),
    )


def long_table(spark: SparkSession, sf_dir: str, mode: str = "strict", codes: list[str] | None = None, wide: DataFrame | None = None, **dealt) -> DataFrame:
    """The long table of the wide schedules; ``dealt`` says what ``to_long`` joins before the unpivot and by what it deals the rows."""
    from quarterlight.operators import normalize

    return normalize.to_long(
        wide_schedules(spark, sf_dir) if wide is None else wide, institutions(spark, sf_dir), descriptions(spark, sf_dir), SCHEDULE_OF,
        keys=QUARTER, mode=mode, codes=codes, spread=True, **dealt,
    )


def repeated_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long table with every row twice; the later copy (``row_seq`` 1) has other amounts."""
    rows = long_table(spark, sf_dir).withColumn("row_seq", F.explode(F.array(F.lit(0), F.lit(1))))
    later = F.col("row_seq") == 1
    return rows.withColumns(
        {"amount": F.when(later, F.concat(F.lit("9"), "amount")).otherwise(F.col("amount")),
         "amount_num": F.when(later, F.col("amount_num") * 2 + 1).otherwise(F.col("amount_num"))}
    )


def repeated_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide schedules with every row twice; the later copy (``row_seq`` 1) has a 9 before every number."""
    rows = wide_schedules(spark, sf_dir).withColumn("row_seq", F.explode(F.array(F.lit(0), F.lit(1))))
    later = lambda c: (F.col("row_seq") == 1) & F.col(c).rlike("[0-9]")
    return rows.withColumns({c: F.when(later(c), F.concat(F.lit("9"), c)).otherwise(F.col(c)) for c in SCHEDULE_OF})


def sparse_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide schedule of orders in four parts: filled, nearly empty, almost wholly empty, and without ids."""
    key = F.col("o_orderkey")
    part = (key % 4).cast("int")
    filled = F.when(part.isin(0, 3), F.lit(True)).when(part == 1, key % 12 == 1).otherwise(key % 160 == 2)
    codes = {f"RCON000{i}": F.when(filled if i == 0 else filled & part.isin(0, 3), key.cast("string")) for i in range(8)}
    return table(spark, sf_dir, "orders").select(
        F.when(part != 3, F.col("o_custkey").cast("string")).alias(dims.ID_COLUMN), part.alias("part"), *[c.alias(n) for n, c in codes.items()]
    )


def mixed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, html: a document per part; by its key a financial table with two header rows, one without numbers, one of two rows, or a
    nested one inside a plain one."""
    number = F.col("p_size").cast("string")
    rows = F.concat(F.lit("<tr><td>Total income cost net loan</td><td>1,"), F.lpad(number, 3, "0"), F.lit("</td></tr>"))
    financial = F.concat(
        F.lit("<table><tr><th>Assets</th><th>Year</th></tr><tr><th>Name</th><th>Unit</th></tr>"), F.repeat(rows, 4), F.lit("</table>")
    )
    words = F.lit("<table><tr><td>Name</td><td>Town</td></tr><tr><td>Bob</td><td>Rome</td></tr><tr><td>Eve</td><td>Oslo</td></tr></table>")
    small = F.concat(F.lit("<table><tr><td>Total assets</td><td>"), number, F.lit("</td></tr><tr><td>Net income</td><td>7</td></tr></table>"))
    nested = F.concat(F.lit("</table><table><tr><td>Outer</td><td>"), small, F.lit("</td></tr><tr><td>End</td></tr></table>"))
    kind = F.col("p_partkey") % 4
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("doc_id"), F.when(kind == 0, financial).when(kind == 1, words).when(kind == 2, small).otherwise(nested).alias("html")
    )


def metric_table(spark: SparkSession, sf_dir: str, wide: DataFrame | None = None) -> DataFrame:
    from quarterlight.operators import metrics

    wide = wide_schedules(spark, sf_dir) if wide is None else wide
    base = metrics.wide_base_metrics([(wide.withColumn("row_seq", F.lit(0)), SCHEDULE_OF)], QUARTER)
    return metrics.with_ratios(base)


# -- files -----------------------------------------------------------------------------------------
def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per order: path, name, size, fingerprint, time; some names are not bulk files."""
    codes = F.array(*[F.lit(c) for c in dims.EXPECTED_SCHEDULES])
    key = F.col("o_orderkey")
    # Every quarter lacks about a sixth of the codes: their files carry the next code instead.
    place = F.pmod(key, F.lit(39))
    lacking = (place + F.year("o_orderdate") * 4 + F.quarter("o_orderdate")) % 6 == 0
    code = F.get(codes, F.when(lacking, (place + 1) % 39).otherwise(place).cast("int"))
    kind = F.when(code == "POR", "Bulk").otherwise("Schedule")
    date = F.date_format("o_orderdate", "MMddyyyy")
    part = F.when(key % 11 == 0, F.concat(F.lit("("), (key % 2 + 1).cast("string"), F.lit(" of 2)"))).otherwise("")
    good = F.concat(F.lit("FFIEC CDR Call "), kind, F.lit(" "), code, F.lit(" "), date, part, F.lit(".txt"))
    bad_date = F.concat(F.lit("FFIEC CDR Call Schedule RC 1331"), F.year("o_orderdate").cast("string"), F.lit(".txt"))
    name = (
        F.when(key % 41 == 0, F.concat(F.lit("Readme_"), key.cast("string"), F.lit(".txt")))
        .when(key % 43 == 0, bad_date)
        .when(key % 47 == 0, F.lower(good))
        .otherwise(good)
    )
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.concat_ws("/", F.lit("/bulk"), (key % 20).cast("string"), key.cast("string"), name).alias("filepath"),
        name.alias("filename"),
        F.concat(F.lit("/bulk/"), (key % 20).cast("string")).alias("folder"),
        F.round("o_totalprice").cast("bigint").alias("file_size"),
        F.sha2(key.cast("string"), 256).alias("file_hash"),
        F.col("o_orderdate").cast("timestamp").alias("last_modified"),
        key.alias("order_key"),
        F.col("o_orderstatus").alias("order_status"),
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarterlight.sources import listing

    return listing.describe_files(file_listing(spark, sf_dir))


def stored_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger left by earlier runs: some files were elsewhere then, some had another fingerprint."""
    moved = F.col("order_key") % 5 == 0
    path = F.when(moved, F.concat(F.lit("/old"), F.col("filepath"))).otherwise(F.col("filepath"))
    files = inventory(spark, sf_dir).withColumn("filepath", path)
    done = F.col("order_status") == "F"
    status = F.when(done, "completed").when(F.col("order_status") == "P", "failed").otherwise("pending")
    stamp = F.col("last_modified")
    old_hash = F.when(F.col("order_key") % 7 == 0, "0000").otherwise(F.col("file_hash"))
    return files.select(
        "filepath", "filename", "schedule_code", "report_date", "quarter", "year", "file_size",
        old_hash.alias("file_hash"), "last_modified", done.alias("is_processed"),
        F.when(done, stamp).alias("processed_date"),
        F.when(done, F.col("file_size") % 1000).alias("row_count"),
        F.when(done, F.col("file_size") % 100).alias("institution_count"),
        stamp.alias("created_at"), stamp.alias("updated_at"), status.alias("processing_status"),
        F.when(status == "failed", F.concat(F.lit("error "), F.col("order_key").cast("string"))).alias("error_message"),
        F.when(status == "failed", (F.col("order_key") % 3).cast("int")).otherwise(0).alias("retry_count"),
        F.lit(None).cast("timestamp").alias("last_retry_date"),
    )


# -- companies and filings --------------------------------------------------------------------------
def ticker_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON ticker maps, one document per thousand customer keys."""
    entry = F.struct(
        F.col("c_custkey").cast("string").alias("key"),
        F.struct(
            F.col("c_custkey").alias("cik_str"),
            F.concat(F.substring("c_mktsegment", 1, 2), F.col("c_custkey").cast("string")).alias("ticker"),
            F.col("c_name").alias("title"),
        ).alias("value"),
    )
    customers = table(spark, sf_dir, "customer")
    return customers.groupBy(F.expr("c_custkey div 1000").alias("doc")).agg(
        F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")
    )


def dictionary_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON dictionaries, one per thousand parts; every second one nests its entries."""
    entry = F.struct(F.concat(F.lit("RCON"), F.col("p_partkey").cast("string")), F.col("p_name"))
    parts = table(spark, sf_dir, "part").groupBy(F.expr("p_partkey div 1000").alias("doc")).agg(
        F.map_from_entries(F.collect_list(entry)).alias("m")
    )
    nested = F.to_json(F.struct(F.col("m").alias("_sample_codes")))
    return parts.select("doc", F.when(F.col("doc") % 2 == 0, F.to_json("m")).otherwise(nested).alias("value"))


def institution_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.struct(F.col("s_suppkey").cast("string"), F.col("s_name"))
    return table(spark, sf_dir, "supplier").groupBy(F.expr("s_suppkey div 1000").alias("doc")).agg(
        F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")
    )


FORMS = {"1-URGENT": "10-K", "2-HIGH": "10-Q", "3-MEDIUM": "8-K"}


def filing_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON filing indexes per company and range of 4,096 order keys, newest filing first."""
    o = table(spark, sf_dir, "orders")
    form = F.lit("10-K/A")
    for priority, name in FORMS.items():
        form = F.when(F.col("o_orderpriority") == priority, name).otherwise(form)
    item = F.struct(
        (-F.unix_date(F.to_date("o_orderdate"))).alias("newest"),
        F.col("o_orderkey").alias("k"),
        form.alias("form"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
    )
    rows = o.groupBy("o_custkey", F.expr("o_orderkey div 4096").alias("part")).agg(
        F.sort_array(F.collect_list(item)).alias("f")
    )
    field = lambda fn: F.transform("f", fn)
    recent = F.struct(
        field(lambda x: x["form"]).alias("form"),
        field(lambda x: x["date"]).alias("filingDate"),
        field(lambda x: F.concat(F.lit("0000-"), x["k"].cast("string"))).alias("accessionNumber"),
        field(lambda x: F.concat(F.lit("doc"), x["k"].cast("string"), F.lit(".htm"))).alias("primaryDocument"),
    )
    value = F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings")))
    return rows.select(F.col("o_custkey").alias("cik"), "part", value.alias("value"))


# -- documents --------------------------------------------------------------------------------------
def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("k"), F.round("o_totalprice").cast("bigint").alias("amt"),
        F.to_date("o_orderdate").alias("d"), F.col("o_custkey").alias("c"),
    )


SECTION_HEADS = ("Consolidated Balance Sheets", "Segment Information", "Other matters", "Deposits and borrowings")


def html_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, html: 256 order keys per document, 32 per table, one table row per order."""
    k, amt = F.col("k"), F.col("amt")
    grouped = F.format_number("amt", 0)
    row = F.concat(
        F.lit("<tr><td>Total loans &amp; leases (a)"), (k % 4).cast("string"), F.lit("</td>"),
        F.lit('<td align="right">$ '), grouped, F.lit("</td>"),
        F.when(k % 3 == 0, F.lit('<td colspan="2">')).otherwise("<td>"),
        F.when(k % 5 == 0, F.concat(F.lit("("), grouped, F.lit(")"))).otherwise(F.concat((k % 100).cast("string"), F.lit(" %"))),
        F.lit("</td></tr>"),
    )
    rows = _orders(spark, sf_dir).select(
        F.expr("k div 256").alias("doc_id"), F.expr("k div 32 % 8").alias("t"), k.alias("k"), row.alias("row")
    )
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "row"))), lambda x: x["row"]), "\n")
    heads = F.array(*[F.lit(h) for h in SECTION_HEADS])
    head = F.get(heads, (F.col("t") % 4).cast("int"))
    tables = rows.groupBy("doc_id", "t").agg(ordered.alias("body")).select(
        "doc_id",
        "t",
        F.concat(
            F.lit("<h2>"), head, F.lit("</h2><TABLE border=1><tr><th>Year 2023 vs 2024</th><th>Amount</th><th>Share</th></tr>"),
            "body", F.lit("</TABLE>"),
        ).alias("part"),
    )
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("t", "part"))), lambda x: x["part"]), "\n")
    return tables.groupBy("doc_id").agg(
        F.concat(F.lit("<html><body><!-- <table> -->"), joined, F.lit("</body></html>")).alias("html")
    )


def spanned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, html: one table for each order, with row and column spans of four kinds; ids repeat or are missing."""
    k, amt = F.col("k").cast("string"), F.col("amt").cast("string")
    html = (
        F.when(F.col("k") % 4 == 0, F.concat(F.lit(
            '<table><tr><th rowspan="2">Item</th><th colspan=2>Amounts</th></tr><tr><th>New</th><th>Old</th></tr><tr><td>No '), k,
            F.lit("</td><td>"), amt, F.lit("</td><td>5</td></tr></table>")))
        .when(F.col("k") % 4 == 1, F.concat(F.lit('<p>x</p><table><tr><td rowspan="0">Group '), k, F.lit("</td><td>first</td></tr><tr><td>second</td></tr><tr><td>third</td></tr></table>")))
        .when(F.col("k") % 4 == 2, F.concat(F.lit("<table><tr><td rowspan=2>left</td><td ROWSPAN='9'>"), amt, F.lit(
            "</td><td>right</td></tr><tr><td colspan='2'>wide</td></tr><tr><td>under</td><td>last</td></tr></table>")))
        .otherwise(F.concat(F.lit("<table><tr><td>only "), k, F.lit("</td></tr></table>")))
    )
    return _orders(spark, sf_dir).select(F.when(F.col("k") % 10 != 0, F.expr("k div 2")).alias("doc_id"), html.alias("html"))


def quoted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, content: 128 order keys per document; quoted cells hold separators, quotes and line breaks; every fourth id is missing."""
    k = F.col("k")
    doc = F.expr("k div 128")
    sep = F.when(doc % 3 == 0, "\t").when(doc % 3 == 1, "|").otherwise(",")
    line = (
        F.when(k % 23 == 0, "")
        .when(k % 7 == 0, F.concat(F.lit('"first'), sep, F.lit('line\n\nof ""'), k.cast("string"), F.lit('"""'), sep, F.lit('"\n"'), sep))
        .otherwise(F.concat(k.cast("string"), sep, F.lit('"'), F.col("amt").cast("string"), F.lit('\r\nend"'), F.when(k % 2 == 0, "\r").otherwise("")))
    )
    rows = _orders(spark, sf_dir).select(doc.alias("doc_id"), "k", line.alias("line"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "line"))), lambda r: r["line"]), "\n")
    last = F.when(F.col("doc_id") % 2 == 0, "\n").otherwise("")
    return rows.groupBy("doc_id").agg(body.alias("body")).select(F.when(F.col("doc_id") % 4 != 0, F.col("doc_id")).alias("doc_id"), F.concat("body", last).alias("content"))


def fact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, content: tagged facts of 64 order keys; every fifth document has plain numbers only."""
    k = F.col("k")
    doc = F.expr("k div 64")
    tag = F.when(k % 3 == 0, "us-gaap:Assets").when(k % 3 == 1, "call:RCON2170").otherwise(
        F.concat(F.lit("us-gaap:Item"), (k % 32).cast("string"))
    )
    fact = F.concat(
        F.lit("<"), tag, F.lit(' contextRef="c'), (k % 2).cast("string"), F.lit('" unitRef="USD" decimals="0"> '),
        F.col("amt").cast("string"), F.lit(" </"), tag, F.lit(">"),
    )
    plain = F.concat(F.lit("<v>"), F.col("amt").cast("string"), F.lit("</v>"))
    rows = _orders(spark, sf_dir).select(
        doc.alias("doc_id"), "k", "d", F.when(doc % 5 == 0, plain).otherwise(fact).alias("x")
    )
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda r: r["x"]), "\n")
    grouped = rows.groupBy("doc_id").agg(body.alias("body"), F.min_by("d", "k").alias("d"))
    context = F.when(
        F.col("doc_id") % 5 == 0, ""
    ).otherwise(
        F.concat(
            F.lit("<context id='c0'><period><startDate>x</startDate></period></context>"),
            F.lit("<context id='c1'><period><instant>"), F.date_format("d", "yyyy-MM-dd"),
            F.lit("</instant></period></context>"),
        )
    )
    return grouped.select("doc_id", F.concat(F.lit("<root>"), context, "body", F.lit("</root>")).alias("content"))


def delimited_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, content: 128 order keys per document as lines; separators differ between documents."""
    k = F.col("k")
    doc = F.expr("k div 128")
    sep = F.when(doc % 3 == 0, "\t").when(doc % 3 == 1, "|").otherwise(",")
    line = (
        F.when(k % 23 == 0, "")
        .when(k % 37 == 0, F.concat(F.lit("Schedule RC-"), k.cast("string"), sep, F.lit("x")))
        .otherwise(F.concat(F.lit('"item, '), k.cast("string"), F.lit('"'), sep, F.col("amt").cast("string"), sep))
    )
    rows = _orders(spark, sf_dir).select(doc.alias("doc_id"), "k", line.alias("line"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "line"))), lambda r: r["line"]), "\n")
    return rows.groupBy("doc_id").agg(F.concat(body, F.lit("\n")).alias("content"))


def filed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, company, path, content: pages, tagged and delimited documents side by side."""
    parts = [
        (html_documents(spark, sf_dir).withColumnRenamed("html", "content"), 0, ".htm"),
        (fact_documents(spark, sf_dir), 1, ".xml"),
        (delimited_documents(spark, sf_dir), 2, ".SDF"),
    ]
    rows = [
        df.select(
            (F.col("doc_id") * 3 + i).alias("doc_id"), F.concat(F.lit("Company "), F.col("doc_id").cast("string")).alias("company"),
            F.concat(F.lit("filing"), F.col("doc_id").cast("string"), F.lit(end)).alias("path"), "content",
        )
        for df, i, end in parts
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def text_line() -> Column:
    """A printed balance-sheet line built from an order (k, amt)."""
    k, ks = F.col("k"), F.col("k").cast("string")
    amt = F.format_number("amt", 0)
    code = F.lpad((k % 2000).cast("string"), 4, "0")
    number = (k % 30 + 1).cast("string")
    c = F.concat
    L = F.lit
    return (
        F.when(k % 8 == 0, c(number, L(". Loans and leases RCFD"), code, L(" "), amt))
        .when(k % 8 == 1, c(number, L(".a. Total deposits ..... RCON"), code, L(" -"), amt))
        .when(k % 8 == 2, c(L("(1) Net income item RCFN"), code, L(" "), amt))
        .when(k % 8 == 3, c(L("Other assets RCON"), code, L(" "), amt))
        .when(k % 8 == 4, c(number, L(". Cash and balances group "), ks))
        .when(k % 8 == 5, c(L("Schedule RC Dollar amounts in thousands "), ks))
        .when(k % 8 == 6, c(number, L(". Subtotal (net) RCON"), code, L(" "), amt, L(" "), number, L(".")))
        .otherwise(c(number, L(" . RCON"), code, L(" "), amt))
    )


def text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_num, row_ix, row_text: one printed line per order, 40 to a page."""
    return _orders(spark, sf_dir).select(
        F.expr("k div 400").alias("doc_id"), F.expr("k div 40 % 10").alias("page_num"),
        F.expr("k % 40").alias("row_ix"), text_line().alias("row_text"),
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_num, text, x0, top: the printed lines cut into positioned words."""
    rows = text_rows(spark, sf_dir)
    word = F.posexplode(F.split("row_text", " ")).alias("pos", "text")
    exploded = rows.select("doc_id", "page_num", "row_ix", word)
    return exploded.select(
        "doc_id", "page_num", "text", (F.col("pos") * 50.5).alias("x0"),
        (F.col("row_ix") * 12.0 + F.col("pos") % 2 * 0.01).alias("top"),
    )


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, row_ix, cells: cell rows of printed tables in several shapes."""
    k, amt = F.col("k"), F.format_number("amt", 0)
    code = F.lpad((k % 2000).cast("string"), 4, "0")
    n = (k % 20 + 1).cast("string")
    c, L = F.concat, F.lit
    null = F.lit(None).cast("string")
    cells = (
        F.when(k % 7 == 0, F.array(c(n, L(". Cash and due")), c(L("RCON"), code), amt, L("")))
        .when(k % 7 == 1, F.array(c(n, L(".a")), L("  "), c(L("RCON"), code), c(L("("), amt, L(")"))))
        .when(k % 7 == 2, F.array(L("a. Net income  of   banks ..."), null, c(L("RIAD"), code), amt))
        .when(k % 7 == 3, F.array(L("(1) Trading total"), c(L("RCFD"), code, L(" "), amt, L(" RCON"), code, L(" -12,345"))))
        .when((k % 7 == 4) & (k % 2 == 0), F.array(L("Assets"), L("Total assets"), L(""), L("")))
        .when(k % 7 == 4, F.array(null, L("   "), L("")))
        .when(k % 7 == 5, F.array(L(""), null, c(L("RCON"), code), F.when(k % 2 == 0, amt).otherwise("-")))
        .otherwise(F.array(c(L("Dollar amounts "), k.cast("string")), L("(ii) lower"), L("x"), L("y")))
    )
    return _orders(spark, sf_dir).select(F.expr("k div 64").alias("doc_id"), F.expr("k % 64").alias("row_ix"), cells.alias("cells"))


def pages_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_num, page_text: 16 order keys per document; most pages have no title."""
    k, ks = F.col("k"), F.col("k").cast("string")
    body = F.concat(F.lit("\nRCON2170 "), ks, F.lit("\nsee Schedule RC"))
    head = (
        F.when(k % 9 == 0, "Institution\nSchedule RC - Balance Sheet")
        .when(k % 9 == 3, "Schedule RC-R Part II - Risk weighted   assets (Form Type - 031)")
        .when(k % 9 == 5, "schedule RI - Income statement")
        .when(k % 9 == 7, "Schedule RC-N Past due loans")
        .otherwise("continued")
    )
    return _orders(spark, sf_dir).select(
        F.expr("k div 16").alias("doc_id"), F.expr("k % 16").alias("page_num"), F.concat(head, body).alias("page_text")
    )
