"""The registered queries: every operator over the whole test tables (see ``derived``)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterlight import dims
from quarterlight.functions import names, ratios, text
from quarterlight.operators import compare, distinct_ids, ledger, ledger_log, metrics, normalize, quality, records, report_rows, search, tables, term_index
from quarterlight.plans import derived as D
from quarterlight.plans import reports
from quarterlight.session import new_folder, stored
from quarterlight.sinks import table_files
from quarterlight.sinks import tables as sinks
from quarterlight.sources import byte_ranges, dictionaries, documents, listing, schedules
from quarterlight.streaming import new_files, routed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NOW = dt.datetime(2001, 1, 1)


def now():
    """The time the ledger queries run at, read in the session's time zone."""
    return F.lit(str(NOW)).cast("timestamp")

QUARTER = D.QUARTER
IDS = ["rssd_id", "quarter_key"]
MEMBER_COLUMNS = 6
#: Codes that the amended files of the stream keep.
AMENDED_CODES = ("RCFD2170", "RCON2170", "RCON2122", "RCON2200", "RCON6631")
PAGE_KEYWORDS = ("que", "edthe", "und", "ción", "the")


def query(name: str):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    doubles = {c: F.round(F.col(c), digits) for c, t in df.dtypes if t == "double"}
    return df.withColumns(doubles) if doubles else df


def _raw_cells(spark, sf):
    wide = D.wide_schedules(spark, sf)
    return normalize.unpivot_codes(wide, [dims.ID_COLUMN, "quarter_key"])


def _members(spark, sf):
    peers = compare.peer_groups(D.peer_members(spark, sf))
    return compare.attach_peers(D.metric_table(spark, sf), peers)


def _peer_rows(spark, sf):
    peers = compare.peer_groups(D.peer_members(spark, sf))
    return compare.attach_peers(D.long_table(spark, sf), peers)


def _comparison(spark, sf):
    peers = compare.peer_groups(D.peer_members(spark, sf))
    # Groups are joined to the wide rows, and a group goes to one task: neither the comparison nor its files shuffle a cell.
    rows = D.long_table(spark, sf, attach=lambda wide: compare.attach_peers(wide, peers), together=["peer_group"])
    return compare.comparison(rows, QUARTER, ["code_seq"], MEMBER_COLUMNS)


# -- files written for the source and sink queries ----------------------------------------------------
_WRITTEN: dict[tuple[str, str], str] = {}


def schedule_folder(spark: SparkSession, sf: str) -> str:
    """Folder with one tab-separated file (a Spark-written folder) per schedule and quarter."""
    key = (spark.sparkContext.applicationId, sf)
    if key in _WRITTEN:
        return _WRITTEN[key]
    root = new_folder(spark, "schedules")
    # Stored once: every schedule's files would work out all sums and cells again.
    wide = stored(D.wide_schedules(spark, sf), "wide")
    for schedule in sorted(set(D.SCHEDULE_OF.values())):
        write_schedule(wide, schedule, f"{root}/FFIEC CDR Call Schedule {schedule}")
    _WRITTEN[key] = root
    return root


def write_schedule(wide: DataFrame, schedule: str, target: str, codes: list[str] | None = None, id_name: str = dims.ID_COLUMN) -> None:
    """One file (a Spark-written folder) per quarter with a schedule's codes, or others."""
    year, quarter = F.split("quarter_key", "-Q")[0], F.split("quarter_key", "-Q")[1]
    month_day = F.when(quarter == "1", "0331").when(quarter == "2", "0630").when(quarter == "3", "0930").otherwise("1231")
    codes = codes or [c for c, s in D.SCHEDULE_OF.items() if s == schedule]
    file = F.concat(F.lit(f"FFIEC CDR Call Schedule {schedule} "), month_day, year, F.lit(".txt"))
    (
        wide.select(F.col(dims.ID_COLUMN).alias(id_name), *codes, "TEXT1234", file.alias("f"))
        .repartition("f")
        .write.partitionBy("f")
        .option("sep", "\t").option("header", True).option("extension", "txt")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(target)
    )


# -- S: sources ----------------------------------------------------------------------------------------
@query("S1_read_wide_schedule")
def _(spark, sf):
    wide = schedules.read_wide(spark, f"{schedule_folder(spark, sf)}/FFIEC CDR Call Schedule RC")
    cells = normalize.unpivot_codes(schedules.with_file_quarter(wide), [dims.ID_COLUMN, "quarter_key"])
    return cells.filter(F.col("raw").isNotNull())


@query("S2_read_wide_schedule_strict")
def _(spark, sf):
    path = f"{schedule_folder(spark, sf)}/FFIEC CDR Call Schedule RC"
    long = reports.process_file(spark, path, D.institutions(spark, sf), D.descriptions(spark, sf), quarters=True)
    return long.select(*IDS, "schedule_code", "schedule_name", "mdrm_code", "line_item", "amount")


@query("S3_process_directory")
def _(spark, sf):
    long = reports.process_directory(
        spark, schedule_folder(spark, sf), D.institutions(spark, sf), D.descriptions(spark, sf), quarters=True
    )
    return long.select(
        *IDS, "name", "schedule_code", "schedule_seq", "mdrm_code", "line_item", "description", "amount"
    )


@query("S4_read_large_file")
def _(spark, sf):
    wide = schedules.read_wide(spark, f"{schedule_folder(spark, sf)}/FFIEC CDR Call Schedule RI")
    long = normalize.to_long(
        schedules.with_file_quarter(wide), D.institutions(spark, sf), D.descriptions(spark, sf), "RI", keys=QUARTER
    )
    return long.select(*IDS, "mdrm_code", "amount")


@query("S5_file_inventory")
def _(spark, sf):
    return D.inventory(spark, sf).select(
        "filepath", "schedule_code", "report_date", "year", "quarter", "quarter_key", "part", "file_size"
    )


@query("S6_content_fingerprint")
def _(spark, sf):
    content = F.col("text").cast("binary")
    return D.table(spark, sf, "documents").select("doc_id", listing.fingerprint(content).alias("file_hash"))


@query("S6_merkle_fingerprint")
def _(spark, sf):
    """Every text as a file of 64-byte leaves, four to a node, and the same with another last byte."""
    docs = D.table(spark, sf, "documents").filter("text <> ''").select("doc_id", F.encode("text", "utf-8").alias("content"))
    size = F.octet_length("content")
    changed = F.concat(F.substring(F.col("content"), F.lit(1), size - 1), F.lit("~").cast("binary"))
    files = docs.withColumn("edition", F.lit(0)).unionByName(docs.select("doc_id", changed.alias("content"), F.lit(1).alias("edition")))
    starts = F.posexplode(F.sequence(F.lit(0), size - 1, F.lit(64))).alias("leaf_ix", "start")
    leaves = files.select("doc_id", "edition", "content", starts).withColumn("content", F.expr("substring(content, start + 1, 64)"))
    most = files.agg(F.max(F.ceil(size / 64))).first()[0] or 1
    return byte_ranges.merkle_roots(leaves, most, ("doc_id", "edition"), 4)


@query("S7_code_dictionary")
def _(spark, sf):
    return dictionaries.code_descriptions(D.dictionary_documents(spark, sf))


@query("S8_institution_lookup")
def _(spark, sf):
    return dictionaries.institution_names(D.institution_documents(spark, sf))


@query("S9_company_tickers")
def _(spark, sf):
    return dictionaries.company_tickers(D.ticker_documents(spark, sf))


def _filings(spark, sf):
    return dictionaries.filings(D.filing_documents(spark, sf), part="part")


@query("S10_filing_index")
def _(spark, sf):
    return _filings(spark, sf)


@query("S11_delimited_documents")
def _(spark, sf):
    lines = documents.delimited_lines(D.delimited_documents(spark, sf))
    return lines.select("doc_id", "line_no", F.array_join("cells", "¦").alias("cells"))


@query("S11_quoted_records")
def _(spark, sf):
    found = records.delimited_records(D.quoted_documents(spark, sf), block_chars=1000)
    return found.select("doc_id", "record_no", F.array_join("cells", "¦").alias("cells"))


def _grids(spark, sf):
    return documents.table_grids(documents.html_tables(D.html_documents(spark, sf)))


@query("S12_spanned_cells")
def _(spark, sf):
    return documents.explode_cells(documents.table_grids(documents.html_tables(D.spanned_documents(spark, sf))))


@query("S12_merged_cells")
def _(spark, sf):
    return documents.merged_cells(documents.html_tables(D.spanned_documents(spark, sf)))


@query("S12_html_tables")
def _(spark, sf):
    return documents.explode_cells(_grids(spark, sf))


@query("S13_tagged_facts")
def _(spark, sf):
    return documents.facts(D.fact_documents(spark, sf))


@query("document_tables")
def _(spark, sf):
    # Each kind reads the documents for itself: they are stored once.
    found = reports.document_tables(stored(D.filed_documents(spark, sf), "documents"))
    return found.withColumn("cells", F.array_join("cells", "¦"))


@query("S14_report_period")
def _(spark, sf):
    return D.fact_documents(spark, sf).select("doc_id", documents.report_period(F.col("content")).alias("period_end"))


@query("S15_word_rows")
def _(spark, sf):
    return rounded(documents.word_rows(D.words(spark, sf)))


@query("S16_document_routing")
def _(spark, sf):
    key = F.col("o_orderkey")
    extension = F.get(F.array(*[F.lit(e) for e in (".pdf", ".SDF", ".txt", ".xml", ".htm")]), (key % 5).cast("int"))
    path = F.concat(F.lit("filing"), key.cast("string"), extension)
    # Some say what they are only deep inside.
    content = F.when(key % 7 == 0, F.concat(F.repeat(F.lit(" "), 2000), F.lit("<xbrl>"))).otherwise("plain")
    routed = D.table(spark, sf, "orders").select(documents.document_kind(path, content).alias("kind"), "o_custkey")
    return routed.groupBy("o_custkey", "kind").agg(F.count(F.lit(1)).alias("documents"))


# -- K: sinks ------------------------------------------------------------------------------------------
@query("K1_long_by_schedule")
def _(spark, sf):
    path = new_folder(spark, "long")
    sinks.write_long(D.long_table(spark, sf).drop("schedule_seq", "code_seq"), path)
    return spark.read.parquet(path).select(*IDS, "schedule_code", "mdrm_code", "amount", "amount_value")


def _named_tables(spark, sf):
    profiled = tables.table_profile(_grids(spark, sf))
    section = F.concat(F.lit("section 1 statement of Condition - "), F.col("doc_id").cast("string"))
    return profiled.withColumn("section", section).withColumn(
        "table_name", names.table_name(F.lit("TABLE"), F.col("section"), F.col("table_ix"))
    )


@query("K2_csv_per_table")
def _(spark, sf):
    path = new_folder(spark, "csv")
    sinks.write_table_csv(_named_tables(spark, sf), path, ["doc_id"])
    written = spark.read.parquet(f"{path}/tables")
    total = spark.read.json(f"{path}/_metadata_json").first().table_count
    return written.select("doc_id", "file", F.explode(F.split("value", "\n")).alias("line"), F.lit(total).alias("table_count"))


@query("K2_csv_files")
def _(spark, sf):
    path = new_folder(spark, "csv-files")
    sinks.write_csv_files(_named_tables(spark, sf), path, "doc_id")
    total = table_files.read_totals(path)["table_count"]
    return table_files.read_files(spark, path).select(
        F.col("folder").cast("long").alias("doc_id"), "file", F.explode(F.split("value", "\n")).alias("line"), F.lit(total).cast("long").alias("table_count")
    )


def _bucketed(spark, sf):
    """The repeated long table, stored in buckets of institutions."""
    path = new_folder(spark, "buckets")
    return sinks.write_long_buckets(D.repeated_long(spark, sf), path.rsplit("/", 1)[1].replace("-", "_"), path)


@query("K1_bucketed_metrics")
def _(spark, sf):
    return rounded(metrics.base_metrics(_bucketed(spark, sf), QUARTER))


@query("K1_bucketed_comparison")
def _(spark, sf):
    rows = compare.attach_peers(_bucketed(spark, sf), compare.peer_groups(D.peer_members(spark, sf)))
    return compare.comparison(rows, QUARTER, ["row_seq"], MEMBER_COLUMNS).drop("sort_key", "set_size", "amounts")


@query("K3_nested_json")
def _(spark, sf):
    path = new_folder(spark, "json")
    sinks.write_document_json(_named_tables(spark, sf), path, ["doc_id"])
    schema = (
        "doc_id bigint, tables array<struct<table_ix: int, name: string, section: string,"
        " metadata: struct<rows: int, columns: int, has_numbers: boolean>, data: array<array<string>>>>"
    )
    table = spark.read.schema(schema).json(path).select("doc_id", F.explode("tables").alias("t"))
    return table.select(
        "doc_id", "t.table_ix", "t.name", "t.metadata.rows", "t.metadata.columns", F.posexplode("t.data").alias("row_ix", "row")
    ).withColumn("row", F.array_join("row", "¦"))


@query("K4_comparison_tables")
def _(spark, sf):
    path = new_folder(spark, "comparison")
    shown = [compare.member_name(i) for i in range(MEMBER_COLUMNS)]
    sinks.write_comparison(_comparison(spark, sf), path, shown, together=True)
    return spark.read.parquet(path).select(
        "quarter_key", "peer_group", "schedule_code", "line_item", "mdrm_code", *[f"{m}_value" for m in shown]
    )


@query("K5_table_names")
def _(spark, sf):
    title = F.concat(F.col("p_brand"), F.lit(": ["), F.col("p_name"), F.lit("] / "), F.col("p_type"), F.lit(" sheet?"))
    return D.table(spark, sf, "part").select(
        "p_partkey",
        names.sheet_name(title, F.col("p_size")).alias("sheet_name"),
        names.table_name(F.lit("TABLE"), title, F.col("p_size")).alias("table_name"),
        names.csv_file_name(title).alias("csv_name"),
    )


# -- P: projections, filters, cleaning -------------------------------------------------------------------
@query("P1_unpivot_codes")
def _(spark, sf):
    return normalize.keep_reported(_raw_cells(spark, sf), "raw").drop("amount_num")


@query("P2_code_columns")
def _(spark, sf):
    wide = D.wide_schedules(spark, sf)
    codes = schedules.code_columns(wide.columns)
    return wide.agg(*[F.count(c).alias(c) for c in codes])


@query("P3_institution_filter")
def _(spark, sf):
    rows = normalize.for_institutions(D.long_table(spark, sf), ["1", "7", "9"])
    return rows.select(*IDS, "mdrm_code", "amount")


@query("P4_strict_amounts")
def _(spark, sf):
    return rounded(normalize.keep_reported(_raw_cells(spark, sf)))


@query("P5_blank_ids")
def _(spark, sf):
    kept = D.wide_schedules(spark, sf).filter(normalize.valid_id(F.col(dims.ID_COLUMN)))
    return kept.groupBy(F.col(dims.ID_COLUMN).alias("rssd_id")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("P6_fallback_description")
def _(spark, sf):
    return D.long_table(spark, sf).groupBy("schedule_code", "mdrm_code", "description").agg(F.count(F.lit(1)).alias("n_rows"))


@query("P7_schedule_from_name")
def _(spark, sf):
    key = F.col("order_key")
    odd = F.when(key % 3 == 0, F.concat(F.lit("report_RCN_"), key.cast("string"))).when(
        key % 3 == 1, F.concat(F.lit("bank-ria"), key.cast("string"), F.lit(".RCE7"))
    ).otherwise(F.col("filename"))
    return D.file_listing(spark, sf).select(
        "order_key", names.schedule_code(F.col("filename")).alias("schedule_code"),
        names.schedule_code(odd).alias("odd_code"),
    )


@query("P8_base_schedule")
def _(spark, sf):
    return D.inventory(spark, sf).select("order_key", names.base_schedule(F.col("schedule_code")).alias("base_schedule"))


@query("P9_quarter_from_name")
def _(spark, sf):
    return D.inventory(spark, sf).groupBy("year", "quarter", "part").agg(F.count(F.lit(1)).alias("files"))


@query("P10_report_amounts")
def _(spark, sf):
    return _raw_cells(spark, sf).select(dims.ID_COLUMN, "quarter_key", "mdrm_code", text.report_amount(F.col("raw")).alias("amount"))


@query("P11_format_amounts")
def _(spark, sf):
    return _raw_cells(spark, sf).select(dims.ID_COLUMN, "quarter_key", "mdrm_code", text.format_amount(F.col("raw")).alias("amount"))


@query("P12_clean_cells")
def _(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", F.md5(text.clean_cell(F.col("text")).cast("binary")).alias("clean_md5"))


@query("P13_numeric_test")
def _(spark, sf):
    return _raw_cells(spark, sf).groupBy("mdrm_code").agg(
        F.count(F.when(text.is_numeric(F.col("raw")), 1)).alias("numeric"), F.count(F.lit(1)).alias("cells")
    )


@query("P14_cell_flags")
def _(spark, sf):
    flags = text.cell_flags(F.col("text"))
    cells = documents.explode_cells(_grids(spark, sf)).withColumns(flags)
    return cells.groupBy("doc_id", "col_ix").agg(*[F.count(F.when(F.col(f), 1)).alias(f) for f in flags])


@query("P15_financial_tables")
def _(spark, sf):
    profiled = tables.table_profile(_grids(spark, sf))
    return profiled.select("doc_id", "table_ix", "n_rows", "n_cells", "is_financial")


@query("P15_mixed_tables")
def _(spark, sf):
    profiled = tables.table_profile(documents.table_grids(documents.html_tables(D.mixed_tables(spark, sf))))
    heads = F.array_join(F.col("header_rows").cast("array<string>"), ",")
    return profiled.select("doc_id", "table_ix", "n_rows", "is_financial", "has_numbers", heads.alias("header_rows"))


@query("P16_section_headings")
def _(spark, sf):
    blocks = documents.text_blocks(D.table(spark, sf, "pages"))
    return tables.financial_sections(blocks, ["page_id"], (*dims.SECTION_KEYWORDS, *PAGE_KEYWORDS)).drop("block_ix")


@query("P16_table_sections")
def _(spark, sf):
    return tables.tables_with_sections(D.html_documents(spark, sf))


@query("P17_header_rows")
def _(spark, sf):
    profiled = tables.table_profile(_grids(spark, sf))
    return profiled.select("doc_id", "table_ix", F.array_join(F.col("header_rows").cast("array<string>"), ",").alias("header_rows"))


@query("P18_tables_with_numbers")
def _(spark, sf):
    profiled = tables.table_profile(_grids(spark, sf))
    return profiled.groupBy("doc_id").agg(F.count(F.when(F.col("has_numbers"), 1)).alias("with_numbers"), F.count(F.lit(1)).alias("tables"))


@query("P19_report_rows")
def _(spark, sf):
    return report_rows.classify_rows(D.grids(spark, sf), D.descriptions(spark, sf)).drop("cells")


@query("P20_balance_rows")
def _(spark, sf):
    return report_rows.validate_balance_rows(D.grids(spark, sf), D.descriptions(spark, sf)).drop("cells")


@query("P21_word_row_patterns")
def _(spark, sf):
    return report_rows.parse_word_rows(D.text_rows(spark, sf), D.descriptions(spark, sf)).drop("row_text")


@query("P21_text_row_patterns")
def _(spark, sf):
    return report_rows.parse_text_rows(D.text_rows(spark, sf), D.descriptions(spark, sf)).drop("row_text")


@query("P22_split_collapsed_cells")
def _(spark, sf):
    return report_rows.split_collapsed(D.grids(spark, sf), D.descriptions(spark, sf), ["doc_id", "row_ix"])


@query("P23_page_schedules")
def _(spark, sf):
    found = report_rows.page_schedule(F.col("page_text")).alias("s")
    return D.pages_of_text(spark, sf).select("doc_id", "page_num", found).select("doc_id", "page_num", "s.schedule_code", "s.title")


@query("P24_clean_grid")
def _(spark, sf):
    return report_rows.clean_grid(D.grids(spark, sf)).select("doc_id", "row_ix", F.array_join("cells", "¦").alias("cells"))


@query("P25_schedule_titles")
def _(spark, sf):
    carried = report_rows.carry_schedules(D.pages_of_text(spark, sf), ["doc_id"])
    titled = report_rows.with_schedule_titles(carried.filter(F.col("schedule_code").isNotNull()))
    return titled.groupBy("schedule_code", "proper_name").agg(F.count(F.lit(1)).alias("pages"))


@query("P26_numeric_amounts")
def _(spark, sf):
    return normalize.numeric_amount(_raw_cells(spark, sf), "raw").drop("raw")


@query("P27_folder_check")
def _(spark, sf):
    return listing.folder_check(D.file_listing(spark, sf), ["folder"])


@query("P28_report_layout")
def _(spark, sf):
    rows = report_rows.classify_rows(D.grids(spark, sf), D.descriptions(spark, sf), keep_known=True).drop("cells")
    rows = rows.withColumns(
        {"schedule_code": F.when(F.col("doc_id") % 2 == 0, "RC").otherwise("RCN"), "line_item": F.col("row_ix").cast("string")}
    )
    laid_out = report_rows.report_layout(rows, D.descriptions(spark, sf))
    return laid_out.select("doc_id", "row_ix", "printed_item", "printed_description", "code", "printed_amount")


# -- J: joins and lookups --------------------------------------------------------------------------------
@query("J1_institution_names")
def _(spark, sf):
    return D.long_table(spark, sf).groupBy("rssd_id", "name").agg(F.count(F.lit(1)).alias("n_rows"))


@query("J2_code_descriptions")
def _(spark, sf):
    lines = report_rows.classify_rows(D.grids(spark, sf), D.descriptions(spark, sf), keep_known=True).drop("cells")
    return report_rows.description_or_default(lines, D.descriptions(spark, sf)).select("doc_id", "row_ix", "code", "description")


@query("J3_schedule_info")
def _(spark, sf):
    rows = D.inventory(spark, sf).groupBy("schedule_code").agg(F.count(F.lit(1)).alias("files"))
    return normalize.with_schedule_info(rows).select("schedule_code", "schedule_name", "schedule_prefix", "files")


@query("J4_line_items")
def _(spark, sf):
    key = F.col("p_partkey")
    schedule = F.get(F.array(*[F.lit(s) for s in ("RC", "RI", "RCN", "RCRI", "RCO2")]), (key % 5).cast("int"))
    prefix = F.get(F.array(*[F.lit(s) for s in ("RCON", "RCFD", "RIAD", "RCOA")]), (key % 4).cast("int"))
    codes = D.table(spark, sf, "part").select(
        schedule.alias("schedule_code"), F.concat(prefix, F.lpad((key * 7 % 10000).cast("string"), 4, "0")).alias("mdrm_code")
    )
    return normalize.with_line_items(codes).groupBy("schedule_code", "mdrm_code", "line_item").agg(F.count(F.lit(1)).alias("n_rows"))


@query("J5_metric_lookup")
def _(spark, sf):
    return rounded(metrics.lookup_metrics(D.repeated_long(spark, sf), QUARTER))


@query("J6_institution_search")
def _(spark, sf):
    return search.search_institutions(D.institutions(spark, sf), ["#00000001", "supplier#000000005", "9", "13"])


@query("J7_company_search")
def _(spark, sf):
    companies = dictionaries.company_tickers(D.ticker_documents(spark, sf))
    found = [
        search.search_companies(companies, q, t).withColumn("search", F.lit(t))
        for q, t in (("au17", "ticker"), ("customer#00000001", "name"), ("21", "cik"), ("0000000022", "cik"))
    ]
    return normalize.union_schedules(found)


@query("J6_institution_terms")
def _(spark, sf):
    # Customers' names and segments, searched for terms made of suppliers' keys and segments: long and short, repeated, ids, blanks.
    customers, key = D.table(spark, sf, "customer"), F.col("s_suppkey")
    listed = customers.select(
        F.col("c_custkey").cast("string").alias("rssd_id"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("name")
    )
    number = key.cast("string")
    of_suppliers = F.array(
        F.concat(F.lit(" #"), F.lpad(number, 8, "0")), F.concat(F.lit("R#"), F.lpad(number, 9, "0"), F.lit(" b")),
        F.concat(number, F.lit(" m")), number, (key + 1000000).cast("string"), F.lit(" "), F.lit(None).cast("string"), F.lit("no such"),
    )
    terms = D.table(spark, sf, "supplier").select(F.explode(of_suppliers).alias("term")).unionByName(
        customers.select(F.explode(F.array(F.initcap(F.substring("c_mktsegment", 2, 5)), F.substring("c_mktsegment", 1, 2), F.lit("#"))).alias("term"))
    )
    return term_index.search_institutions(listed, terms)


@query("J7_company_requests")
def _(spark, sf):
    # Stored once: the maps of tickers would be parsed again for each kind of search.
    companies = stored(dictionaries.company_tickers(D.ticker_documents(spark, sf)), "companies")
    number = F.col("s_suppkey").cast("string")
    asked = F.array(
        F.struct(F.lit("ticker").alias("search"), F.concat(F.lit("au"), number).alias("query")),
        F.struct(F.lit("cik").alias("search"), number.alias("query")),
        F.struct(F.lit("cik").alias("search"), F.lpad((F.col("s_suppkey") * 3).cast("string"), 10, "0").alias("query")),
        F.struct(F.lit("name").alias("search"), F.concat(F.lit("R#"), F.lpad(number, 8, "0")).alias("query")),
        F.struct(F.lit("other").alias("search"), number.alias("query")),
    )
    return term_index.search_companies(companies, D.table(spark, sf, "supplier").select(F.inline(asked)))


@query("J8_filing_as_of")
def _(spark, sf):
    return search.filing_as_of(_filings(spark, sf), "10-Q", dt.date(1998, 6, 30)).drop("form")


@query("J8_filings_for_requests")
def _(spark, sf):
    orders = D.table(spark, sf, "orders")
    requests = orders.select(
        F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"), F.to_date("o_orderdate").alias("as_of"),
        F.col("o_orderkey").alias("request"),
    )
    return search.filings_for_requests(_filings(spark, sf), requests, "10-K").drop("url", "as_of")


@query("J9_aligned_amounts")
def _(spark, sf):
    shown = [compare.member_name(i) for i in range(MEMBER_COLUMNS)]
    return _comparison(spark, sf).groupBy("quarter_key", "peer_group", "schedule_code").agg(
        F.count(F.lit(1)).alias("items"),
        *[F.count(F.when(F.col(m) != dims.MISSING_CELL, 1)).alias(f"{m}_items") for m in shown],
    )


@query("J10_missing_schedules")
def _(spark, sf):
    return ledger.missing_schedules(D.inventory(spark, sf))


@query("J11_pending_batch")
def _(spark, sf):
    return ledger.pending_batch(D.inventory(spark, sf), D.stored_ledger(spark, sf)).select("filepath", "schedule_code")


@query("J11_skip_finished")
def _(spark, sf):
    files = ledger.pending_batch(D.inventory(spark, sf), D.stored_ledger(spark, sf), resume=False)
    return files.groupBy("year", "quarter").agg(F.count(F.lit(1)).alias("files"))


@query("J12_peer_rejection")
def _(spark, sf):
    supplier = D.table(spark, sf, "supplier")
    chosen = supplier.select(F.expr("cast(s_suppkey div 2 as string)").alias("rssd_id"), F.col("s_suppkey").alias("seq"))
    primary = supplier.filter("s_suppkey = 3").select(F.col("s_suppkey").cast("string").alias("rssd_id"))
    return search.add_peers(primary, chosen)


# -- A: aggregations -------------------------------------------------------------------------------------
@query("A1_base_metrics")
def _(spark, sf):
    return rounded(metrics.base_metrics(D.repeated_long(spark, sf), QUARTER))


@query("A1_base_metrics_from_wide")
def _(spark, sf):
    return rounded(metrics.wide_base_metrics([(D.repeated_wide(spark, sf), D.SCHEDULE_OF)], QUARTER))


@query("A2_total_deposits")
def _(spark, sf):
    return rounded(metrics.base_metrics(D.repeated_long(spark, sf), QUARTER).select(*IDS, "total_deposits"))


def _ratios(formulas):
    def run(spark, sf):
        columns = list(formulas(F.col))
        return rounded(D.metric_table(spark, sf).select(*IDS, *columns))

    return run


# The formulas need a session for their literals, so only their functions are named here.
query("A3_profitability_ratios")(lambda spark, sf: _ratios(ratios.profitability)(spark, sf))
query("A4_asset_liability_ratios")(lambda spark, sf: _ratios(ratios.asset_liability)(spark, sf))
query("A5_balance_sheet_mix")(lambda spark, sf: _ratios(ratios.composition)(spark, sf))


@query("A6_peer_average")
def _(spark, sf):
    return rounded(compare.ratio_table(_members(spark, sf), QUARTER).select(*QUARTER, "peer_group", "label", "peer_avg"))


@query("A7_peer_statistics")
def _(spark, sf):
    return rounded(compare.peer_statistics(_members(spark, sf), QUARTER), 8)


def _everyone(spark, sf):
    """All institutions as one peer group."""
    members = D.peer_members(spark, sf).select(F.lit(0).alias("peer_group"), "rssd_id", F.col("rssd_id").cast("int").alias("seq"))
    return compare.attach_peers(D.metric_table(spark, sf), compare.large_peer_groups(members))


@query("A7_one_large_group")
def _(spark, sf):
    return rounded(compare.peer_statistics(_everyone(spark, sf), QUARTER), 8)


@query("W7_one_large_group")
def _(spark, sf):
    return rounded(compare.percentile_ranks(_everyone(spark, sf), QUARTER, ["total_assets", "roa", "npl_ratio"]))


@query("A8_amounts_per_schedule")
def _(spark, sf):
    return compare.amounts_per_schedule(D.long_table(spark, sf), QUARTER)


@query("A9_report_summary")
def _(spark, sf):
    return compare.report_summary(D.long_table(spark, sf), QUARTER)


@query("A9_comparison_summary")
def _(spark, sf):
    return compare.comparison_summary(_peer_rows(spark, sf), QUARTER)


@query("A10_file_counts")
def _(spark, sf):
    file = F.concat_ws(" ", "schedule_code", "quarter_key")
    return compare.file_counts(D.long_table(spark, sf).withColumn("source_file", file), "source_file")


@query("A10_distinct_institutions")
def _(spark, sf):
    """Institutions of files, schedules, quarters, years and altogether, all from the files' bitmaps."""
    number = F.col("rssd_id").try_cast("bigint")
    odd = F.when(number % 7 == 0, F.concat(F.lit("0"), "rssd_id")).when(number % 11 == 0, F.concat("rssd_id", F.lit("-A")))
    rows = D.long_table(spark, sf).select("schedule_code", "quarter_key", F.coalesce(odd, (number * 9973).cast("string")).alias("rssd_id"))
    files = stored(distinct_ids.id_bitmaps(rows, ["schedule_code", "quarter_key"]), "bitmaps")
    files = files.withColumn("year", F.substring("quarter_key", 1, 4))
    levels = {"file": ["schedule_code", "quarter_key"], "schedule": ["schedule_code"], "quarter": ["quarter_key"], "year": ["year"], "all": []}
    parts = [
        distinct_ids.id_counts(files, keys).select(F.lit(level).alias("level"), F.concat_ws(" ", F.lit(level), *keys).alias("files"), "institutions")
        for level, keys in levels.items()
    ]
    return normalize.union_schedules(parts)


@query("A11_ledger_statistics")
def _(spark, sf):
    return ledger.processing_by_quarter(D.stored_ledger(spark, sf))


@query("A11_ledger_totals")
def _(spark, sf):
    return ledger.processing_totals(D.stored_ledger(spark, sf))


@query("A12_quarter_completeness")
def _(spark, sf):
    return rounded(ledger.quarter_completeness(D.inventory(spark, sf)))


@query("A13_files_by_quarter")
def _(spark, sf):
    return ledger.files_by_quarter(D.inventory(spark, sf)).select("quarter_key", "filepath", "files_in_quarter")


@query("A14_available_quarters")
def _(spark, sf):
    return ledger.available_quarters(D.inventory(spark, sf))


@query("A15_fact_groups")
def _(spark, sf):
    grouped = tables.fact_groups(documents.facts(D.fact_documents(spark, sf)), ["doc_id"])
    return grouped.select("doc_id", "table_name", "fact_ix", "value", "n_facts")


@query("A16_table_summary")
def _(spark, sf):
    return tables.table_summary(tables.table_profile(_grids(spark, sf)), ["doc_id", "table_ix"])


@query("A16_section_totals")
def _(spark, sf):
    docs = D.html_documents(spark, sf)
    summary = tables.table_summary(tables.table_profile(documents.table_grids(documents.html_tables(docs))), ["doc_id", "table_ix"])
    return tables.section_totals(summary.join(tables.tables_with_sections(docs), ["doc_id", "table_ix"]), ["doc_id", "keyword"])


@query("A17_rows_by_schedule")
def _(spark, sf):
    return D.long_table(spark, sf).groupBy("schedule_code").agg(F.count(F.lit(1)).alias("n_rows"))


@query("A18_cleaning_statistics")
def _(spark, sf):
    return normalize.cleaning_statistics(_raw_cells(spark, sf), ["mdrm_code"])


# -- Q: quality and ratings --------------------------------------------------------------------------------
@query("Q1_quality_report")
def _(spark, sf):
    return rounded(quality.quality_report(D.wide_schedules(spark, sf), QUARTER))


@query("Q1_quality_issues")
def _(spark, sf):
    return rounded(quality.quality_report(D.sparse_schedule(spark, sf), ["part"]))


@query("Q2_available_ids")
def _(spark, sf):
    return quality.available_ids(D.wide_schedules(spark, sf))


@query("Q3_peer_validation")
def _(spark, sf):
    peers = compare.peer_groups(D.peer_members(spark, sf))
    return rounded(compare.validate_peers(peers, D.metric_table(spark, sf), QUARTER))


@query("Q3_size_gaps")
def _(spark, sf):
    place = F.col("rssd_id").cast("bigint") % 11
    apart = D.metric_table(spark, sf).withColumn(
        "total_assets", F.col("total_assets") * F.when(place == 2, 60.0).when(place == 7, 500.0).otherwise(1.0)
    )
    return rounded(compare.validate_peers(compare.peer_groups(D.peer_members(spark, sf)), apart, QUARTER))


@query("Q4_ratio_ratings")
def _(spark, sf):
    return rounded(metrics.rate_ratios(D.metric_table(spark, sf), IDS))


def _flags(*columns):
    def run(spark, sf):
        return rounded(metrics.risk_flags(D.metric_table(spark, sf), IDS).select(*IDS, *columns))

    return run


query("Q5_credit_quality")(_flags("npl_ratio", "npl_status"))
query("Q6_rate_gap")(_flags("ir_sensitivity_ratio", "gap_ratio", "gap_flag", "earning_asset_yield", "cost_of_funds"))
query("Q7_liquidity_flags")(_flags("liquidity_flag", "wholesale_flag", "stability_flag"))


@query("Q8_benchmarks")
def _(spark, sf):
    return rounded(metrics.benchmark_table(D.metric_table(spark, sf), IDS))


# -- W, O: windows and order ---------------------------------------------------------------------------------
@query("W1_share_of_largest")
def _(spark, sf):
    # The largest values and the rows they are joined to need the same table: it is worked out once.
    table = stored(D.metric_table(spark, sf).select(*IDS, "total_assets"), "assets")
    return rounded(compare.share_of_largest(table, QUARTER))


@query("W2_first_reported")
def _(spark, sf):
    return rounded(metrics.first_reported(D.repeated_long(spark, sf), IDS))


@query("W3_delimited_sections")
def _(spark, sf):
    lines = documents.delimited_lines(D.delimited_documents(spark, sf))
    return tables.delimited_sections(lines, ["doc_id"]).drop("cells")


@query("W4_section_ranges")
def _(spark, sf):
    rows = report_rows.classify_rows(D.grids(spark, sf), D.descriptions(spark, sf))
    return report_rows.section_ranges(rows, ["doc_id"])


@query("W5_carried_schedules")
def _(spark, sf):
    return report_rows.carry_schedules(D.pages_of_text(spark, sf), ["doc_id"]).drop("page_text")


@query("W6_table_width")
def _(spark, sf):
    return _grids(spark, sf).select("doc_id", "table_ix", "n_rows", "n_cols", F.size(F.flatten("cells")).alias("padded_cells"))


@query("W7_percentile_ranks")
def _(spark, sf):
    return rounded(compare.percentile_ranks(_members(spark, sf), QUARTER, ["total_assets", "roa", "npl_ratio"]))


@query("O1_top_items")
def _(spark, sf):
    return rounded(compare.top_items(D.long_table(spark, sf, codes=[c for c, s in D.SCHEDULE_OF.items() if s == "RC"]), IDS))


@query("O2_line_item_order")
def _(spark, sf):
    items = D.long_table(spark, sf).groupBy("schedule_code", "line_item").agg(F.count(F.lit(1)).alias("n_rows"))
    keyed = items.withColumn("key", names.line_item_key(F.col("line_item")))
    return keyed.orderBy("key", "schedule_code").select("schedule_code", "line_item", "n_rows", "key.*")


@query("O3_ledger_order")
def _(spark, sf):
    return ledger.ledger_order(D.stored_ledger(spark, sf)).select("year", "quarter", "schedule_code", "filepath")


@query("O4_recent_filings")
def _(spark, sf):
    return search.recent_filings(_filings(spark, sf), "8-K", 3).select("cik", "rank", "filing_date", "accession_number")


@query("O5_latest_quarter")
def _(spark, sf):
    return ledger.latest_quarter(D.inventory(spark, sf))


# -- U, R: sets and reshaping ----------------------------------------------------------------------------------
@query("U1_union_of_schedules")
def _(spark, sf):
    root, inst, desc = schedule_folder(spark, sf), D.institutions(spark, sf), D.descriptions(spark, sf)
    parts = [
        normalize.to_long(schedules.with_file_quarter(schedules.read_wide(spark, f"{root}/FFIEC CDR Call Schedule {s}")), inst, desc, s, keys=QUARTER)
        for s in sorted(set(D.SCHEDULE_OF.values()))
    ]
    return normalize.union_schedules(parts).select(*IDS, "schedule_code", "mdrm_code", "amount")


@query("U2_schedules_in_use")
def _(spark, sf):
    return compare.schedules_in_use(_peer_rows(spark, sf), [*QUARTER, "peer_group"])


@query("U3_expected_minus_found")
def _(spark, sf):
    return ledger.missing_schedules(D.inventory(spark, sf), exact=True)


@query("R2_metric_sections")
def _(spark, sf):
    return rounded(compare.metric_sections(_members(spark, sf), QUARTER, MEMBER_COLUMNS).drop("members"))


@query("R3_comparison")
def _(spark, sf):
    rows = compare.attach_peers(D.repeated_long(spark, sf), compare.peer_groups(D.peer_members(spark, sf)))
    return compare.comparison(rows, QUARTER, ["row_seq"], MEMBER_COLUMNS).drop("sort_key", "set_size", "amounts")


@query("R4_ratio_table")
def _(spark, sf):
    return rounded(compare.ratio_table(_members(spark, sf), QUARTER, MEMBER_COLUMNS).drop("status", "set_size", "members"))


@query("R5_dashboard")
def _(spark, sf):
    peers = compare.peer_groups(D.peer_members(spark, sf))
    parts = reports.dashboard(D.long_table(spark, sf), peers, QUARTER, "code_seq", D.metric_table(spark, sf))
    return rounded(parts["total_assets"].join(parts["risk_flags"], IDS))


@query("R5_key_metrics")
def _(spark, sf):
    peers = compare.peer_groups(D.peer_members(spark, sf))
    parts = reports.key_metrics(D.long_table(spark, sf), peers, QUARTER, "code_seq", D.metric_table(spark, sf))
    return rounded(parts["sections"].drop("set_size", "members"))


def _bundle(make: Callable, uses_long: bool) -> Query:
    def run(spark, sf):
        wide = D.wide_schedules(spark, sf)
        if uses_long:  # the metrics and the long table both read the wide rows
            wide = stored(wide, "wide")
        table = stored(D.metric_table(spark, sf, wide), "metrics")
        parts = make(D.long_table(spark, sf, wide=wide), compare.peer_groups(D.peer_members(spark, sf)), QUARTER, "code_seq", table)
        # Statistics are in millions, with half units in the seventh place.
        digits = F.when(F.col("table") == "statistics", F.round("value", 8)).otherwise(F.round("value", 6))
        return reports.bundle_rows(parts, QUARTER).withColumn("value", digits)

    return run


query("R5_dashboard_rows")(_bundle(reports.dashboard, True))
query("R5_key_metric_rows")(_bundle(reports.key_metrics, False))


# -- I: incremental state ----------------------------------------------------------------------------------------
def _plain(df: DataFrame) -> DataFrame:
    """Timestamps as text, so that results do not depend on session time zones."""
    stamps = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c, t in df.dtypes if t == "timestamp"}
    return df.withColumns(stamps) if stamps else df


_STATE = ("filepath", "file_hash", "is_processed", "processed_date", "row_count", "institution_count",
          "updated_at", "processing_status", "error_message", "retry_count", "last_retry_date")


@query("I1_ledger_upsert")
def _(spark, sf):
    return _plain(ledger.upsert_files(D.stored_ledger(spark, sf), D.inventory(spark, sf), now()).select(*_STATE))


@query("I2_ledger_by_directory")
def _(spark, sf):
    return ledger.in_directory(D.stored_ledger(spark, sf), "/bulk/1").select("filepath", "quarter_key", "processing_status")


@query("I3_mark_processed")
def _(spark, sf):
    state = D.stored_ledger(spark, sf)
    counts = state.filter("processing_status = 'pending'").select(
        "filepath", F.length("filename").cast("bigint").alias("row_count"), F.lit(2).cast("bigint").alias("institution_count")
    )
    return _plain(ledger.mark_processed(state, counts, now()).select(*_STATE))


@query("I4_status_transitions")
def _(spark, sf):
    state = D.stored_ledger(spark, sf)
    failed = F.col("schedule_code").startswith("RC")
    outcomes = state.filter("processing_status <> 'completed'").select(
        "filepath", F.when(failed, "failed").otherwise("completed").alias("status"),
        F.when(failed, "bad file").alias("error"),
    )
    return _plain(ledger.set_status(state, outcomes, now()).select(*_STATE))


@query("I5_pending_files")
def _(spark, sf):
    return ledger.pending_files(D.stored_ledger(spark, sf), "1997-Q2").select("filepath", "schedule_code", "processing_status")


@query("I5_failed_files")
def _(spark, sf):
    return ledger.failed_files(D.stored_ledger(spark, sf)).select("filepath", "error_message")


@query("I5_status_counts")
def _(spark, sf):
    return ledger.status_counts(D.stored_ledger(spark, sf))


@query("I6_reset_failed")
def _(spark, sf):
    state = ledger.reset_failed(D.stored_ledger(spark, sf), "1998-Q1")
    return state.groupBy("year", "quarter", "processing_status").agg(
        F.count(F.lit(1)).alias("files"), F.count("error_message").alias("errors")
    )


@query("I7_purge_old")
def _(spark, sf):
    return ledger.purge_old(D.stored_ledger(spark, sf), 1000, NOW).select("filepath", "processing_status")


@query("I1_ledger_log")
def _(spark, sf):
    """Every version of a log of five batches, one of them repeated, with a snapshot between them."""
    root, inventory = new_folder(spark, "ledger-log"), D.inventory(spark, sf)
    day = lambda n: NOW + dt.timedelta(days=n)
    ledger_log.create(D.stored_ledger(spark, sf), root, day(-1))
    ledger_log.upsert_files(spark, root, "scan", inventory, day(0))
    first = ledger_log.state(spark, root)
    bad = F.col("schedule_code").startswith("RC")
    outcomes = first.filter("processing_status <> 'completed'").select(
        "filepath", F.when(bad, "failed").otherwise("completed").alias("status"), F.when(bad, "bad file").alias("error")
    )
    ledger_log.set_status(spark, root, "outcomes", outcomes, day(1))
    ledger_log.compact(spark, root, day(1))
    ledger_log.set_status(spark, root, "outcomes", outcomes, day(5))  # again: nothing happens
    counts = ledger_log.state(spark, root).filter("processing_status = 'completed' and not is_processed").select(
        "filepath", F.length("filename").cast("bigint").alias("row_count"), F.lit(2).cast("bigint").alias("institution_count")
    )
    ledger_log.mark_processed(spark, root, "counts", counts, day(2))
    ledger_log.reset_failed(spark, root, "reset", day(3), "1998-Q1")
    last = ledger_log.purge_old(spark, root, "purge", day(4), 1000)
    versions = [ledger_log.state(spark, root, n).select(F.lit(n).alias("version"), *_STATE) for n in range(last)]
    versions.append(ledger_log.state(spark, root, as_of=day(4)).select(F.lit(last).alias("version"), *_STATE))
    return _plain(normalize.union_schedules(versions))


@query("I8_batch_run")
def _(spark, sf):
    root = schedule_folder(spark, sf)
    listed = schedules.list_files(spark, root).select(
        F.col("path").alias("filepath"), "filename", F.col("length").alias("file_size"),
        F.col("modificationTime").alias("last_modified"), F.sha2("filename", 256).alias("file_hash"),
    )
    start = ledger.upsert_files(ledger.empty_ledger(spark), listing.describe_files(listed), now())
    snapshots = new_folder(spark, "ledger")
    state = spark.read.parquet(ledger.write_snapshot(start, snapshots, 0))
    after = reports.run_batch(
        spark, state, D.institutions(spark, sf), D.descriptions(spark, sf), new_folder(spark, "batch")
    )
    done = spark.read.parquet(ledger.write_snapshot(after, snapshots, 1))
    return done.groupBy("year", "quarter", "schedule_code", "processing_status").agg(
        F.sum("row_count").alias("row_count"), F.sum("institution_count").alias("institution_count")
    )


@query("I8_batch_retries")
def _(spark, sf):
    """Two runs: files without an id column fail in both, and files that arrive between them are processed by the second."""
    root, wide = new_folder(spark, "batches"), stored(D.wide_schedules(spark, sf), "wide")
    inst, desc = D.institutions(spark, sf), D.descriptions(spark, sf)
    log = f"{root}/log"
    ledger_log.create(ledger.empty_ledger(spark), log, NOW)

    def run(number: int):
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).load(f"{root}/files")
        found = listing.describe_files(files.select(
            F.col("path").alias("filepath"), names.file_name(F.col("path")).alias("filename"), F.col("length").alias("file_size"),
            F.col("modificationTime").alias("last_modified"), listing.fingerprint(F.col("content")).alias("file_hash"),
        ))
        time = NOW + dt.timedelta(days=number)
        ledger_log.upsert_files(spark, log, f"scan {number}", found, time)
        after = lambda state: reports.run_batch(spark, state, inst, desc, f"{root}/out")
        ledger_log.append(spark, log, f"run {number}", time, after, "batch")

    write_schedule(wide, "RC", f"{root}/files/RC")
    write_schedule(wide, "RCRI", f"{root}/files/RCRI", id_name="BANK")
    run(1)
    write_schedule(wide, "RI", f"{root}/files/RI")
    run(2)
    rows = spark.read.parquet(f"{root}/out").groupBy("source_path").agg(F.count(F.lit(1)).alias("stored_rows"))
    state = ledger_log.state(spark, log).join(rows, F.col("filepath") == F.col("source_path"), "left")
    return state.select(
        "year", "quarter", "schedule_code", "processing_status", "error_message", "retry_count", "row_count", "institution_count", "stored_rows"
    )


@query("stream_new_files")
def _(spark, sf):
    root, output, checkpoint = schedule_folder(spark, sf), new_folder(spark, "stream"), new_folder(spark, "stream-checkpoint")
    runs = []
    for schedule in sorted(set(D.SCHEDULE_OF.values())):  # a header, and so a stream, for each schedule
        header = [dims.ID_COLUMN, *[c for c, s in D.SCHEDULE_OF.items() if s == schedule], "TEXT1234"]
        runs.append(new_files.process_new_files(
            spark, f"{root}/FFIEC CDR Call Schedule {schedule}", header, schedule, D.institutions(spark, sf), D.descriptions(spark, sf),
            f"{output}/{schedule}", f"{checkpoint}/{schedule}", quarters=True,
        ))
    for run in runs:
        run.awaitTermination()
    rows = normalize.union_schedules([spark.read.parquet(f"{output}/{s}") for s in sorted(set(D.SCHEDULE_OF.values()))])
    return rows.select(*IDS, "schedule_code", "mdrm_code", "line_item", "amount")


@query("stream_amended_filings")
def _(spark, sf):
    # The second run finds amended files of every ninth institution with fewer codes and a new one, the third nothing new.
    root, wide = new_folder(spark, "incoming"), stored(D.wide_schedules(spark, sf), "wide")
    inst, desc = D.institutions(spark, sf), D.descriptions(spark, sf)

    def run():
        routed.process_new_files(spark, f"{root}/files", inst, desc, f"{root}/out", f"{root}/checkpoint").awaitTermination()

    for schedule in ("RC", "RCN"):
        write_schedule(wide, schedule, f"{root}/files/first {schedule}")
    run()
    amended = wide.filter(F.col(dims.ID_COLUMN).try_cast("int") % 9 == 0).withColumn("RCON9999", F.col("TEXT1234"))
    write_schedule(amended, "RC", f"{root}/files/second RC", [*AMENDED_CODES, "RCON9999"])
    run()
    run()
    return rounded(
        routed.current_rows(spark, f"{root}/out").groupBy("rssd_id", "quarter_key", "schedule_code").agg(
            F.count(F.lit(1)).alias("cells"), F.sum("amount_num").alias("total"),
            F.count(F.when(F.col("mdrm_code") == "RCON9999", 1)).alias("new_cells"), F.max("batch").cast("int").alias("batch"),
        )
    )
