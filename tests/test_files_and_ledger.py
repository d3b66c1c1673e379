"""Files on disk, the ledger over them, batch runs, sinks and the file stream."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quarterlight.operators import compare, ledger
from quarterlight.plans import reports
from quarterlight.sinks import tables as sinks
from quarterlight.sources import dictionaries, documents, listing, schedules
from quarterlight.streaming import new_files

NAME = "FFIEC CDR Call Schedule {} {}.txt"
STAMP = dt.datetime(2025, 1, 1)


@pytest.fixture
def folder(tmp_path):
    bulk = tmp_path / "bulk data"
    bulk.mkdir()
    (bulk / NAME.format("RC", "03312024")).write_text('"IDRSSD"\tRCON2170\tTEXT1\tRCON0081\n1\t10\ta\tNA\n2\t(1,000)\tb\t7\n\t5\t\t5\n')
    (bulk / NAME.format("RC", "06302024")).write_text("IDRSSD\tRCON0081\tRCON2170\n1\t3\t4\n")
    (bulk / NAME.format("RCT", "03312024(1 of 2)")).write_text("IDRSSD\tRIADB904\n1\t6\n")
    (bulk / NAME.format("RCT", "03312024(2 of 2)")).write_text("IDRSSD\tRIADB905\n1\t8\n")
    (bulk / "Readme.txt").write_text("nothing\there\n")
    return str(bulk)


@pytest.fixture
def lookups(spark):
    return (
        spark.createDataFrame([("1", "First")], "rssd_id string, name string"),
        spark.createDataFrame([("RCON2170", "Total assets")], "mdrm_code string, description string"),
    )


def _long(df):
    return sorted((r.rssd_id, r.source_file, r.schedule_code, r.mdrm_code, r.line_item, r.amount) for r in df.collect())


def test_directory_with_differing_headers(spark, folder, lookups):
    got = _long(reports.process_directory(spark, folder, *lookups, pattern="FFIEC*.txt"))
    rc, rc2 = NAME.format("RC", "03312024"), NAME.format("RC", "06302024")
    part = NAME.format("RCT", "03312024({} of 2)")
    assert got == sorted(
        [
            ("1", rc, "RC", "RCON2170", "RC.12", "10"), ("2", rc, "RC", "RCON2170", "RC.12", "-1,000"), ("2", rc, "RC", "RCON0081", "RC.1.a", "7"),
            ("1", rc2, "RC", "RCON0081", "RC.1.a", "3"), ("1", rc2, "RC", "RCON2170", "RC.12", "4"),
            ("1", part.format(1), "RCT", "RIADB904", "RC-T.1", "6"), ("1", part.format(2), "RCT", "RIADB905", "RC-T.2", "8"),
        ]
    )


def test_single_file_and_filter(spark, folder, lookups):
    path = f"{folder}/{NAME.format('RC', '03312024')}"
    parts = reports.process_file_with_quality(spark, path, *lookups, rssd_ids=["2"])
    assert sorted((r.rssd_id, r.amount, r.schedule_name) for r in parts["rows"].collect()) == [
        ("2", "-1,000", "Consolidated Balance Sheet"), ("2", "7", "Consolidated Balance Sheet"),
    ]
    assert parts["quality"].first().issues == "" and parts["available_ids"].count() == 2


def test_header_mismatch_is_an_error(spark, folder):
    header = schedules.file_header(spark, f"{folder}/{NAME.format('RC', '03312024')}")
    wide = schedules.read_wide(spark, f"{folder}/{NAME.format('RC', '06302024')}", header=header)
    with pytest.raises(Exception):
        wide.collect()


def test_scan_and_fingerprint(spark, folder, tmp_path):
    found = listing.scan_directory(spark, folder).collect()
    assert sorted(r.schedule_code for r in found) == ["RC", "RC", "RCT1", "RCT2"]
    content = open(f"{folder}/{NAME.format('RC', '06302024')}", "rb").read()
    assert hashlib.sha256(content).hexdigest() in {r.file_hash for r in found}
    big = b"x" * (1024 * 1024) + b"tail"
    df = spark.createDataFrame([(bytearray(big),)], "content binary")
    assert df.select(listing.fingerprint(F.col("content"))).first()[0] == hashlib.sha256(big).hexdigest()


def test_ledger_life_cycle(spark, folder, tmp_path):
    files = listing.scan_directory(spark, folder)
    state = ledger.upsert_files(ledger.empty_ledger(spark), files, F.lit(STAMP))
    root = str(tmp_path / "ledger")
    state = spark.read.parquet(ledger.write_snapshot(state, root, 0))
    assert state.columns == ledger.ledger_columns(spark)
    assert ledger.pending_files(state).count() == 4
    bad = state.filter("schedule_code = 'RCT1'").select("filepath", F.lit("failed").alias("status"), F.lit("boom").alias("error"))
    rest = state.filter("schedule_code <> 'RCT1'").select("filepath", F.lit("completed").alias("status"), F.lit(None).cast("string").alias("error"))
    state = ledger.set_status(state, bad.unionByName(rest), F.lit(STAMP))
    counts = state.filter("processing_status = 'completed'").select("filepath", F.lit(5).cast("bigint").alias("row_count"), F.lit(1).cast("bigint").alias("institution_count"))
    state = ledger.mark_processed(state, counts, F.lit(STAMP))
    state = spark.read.parquet(ledger.write_snapshot(state, root, 1))
    failed = ledger.failed_files(state, "2024-Q1").first()
    assert (failed.error_message, failed.retry_count) == ("boom", 1)
    assert ledger.status_counts(state).first()[:] == (1, 1)
    again = ledger.upsert_files(state, files.withColumn("file_hash", F.when(F.col("quarter") == 2, "new").otherwise(F.col("file_hash"))), F.lit(STAMP))
    changed = again.filter("quarter = 2").first()
    assert (changed.processing_status, changed.is_processed, changed.file_hash) == ("pending", False, "new")
    assert again.filter("is_processed").count() == 2
    assert ledger.status_counts(ledger.reset_failed(state)).first()[:] == (1, 0)
    with pytest.raises(Exception):
        ledger.write_snapshot(state, root, 1)
    assert ledger.purge_old(state, 90, dt.datetime(2026, 1, 1)).count() == 1


def test_completeness_rules(spark):
    files = spark.createDataFrame([(2024, 1, c) for c in ("RCA", "RCT1", "RCT2", "RI")], "year int, quarter int, schedule_code string")
    loose = ledger.quarter_completeness(files).first()
    missing = loose.missing_schedules.split(",")
    # A part or a longer code stands in for the expected one unless exact matching is asked for.
    assert "RC" not in missing and "RCT" not in missing and loose.found_count == 4
    exact = ledger.quarter_completeness(files, exact=True).first().missing_schedules.split(",")
    assert "RC" in exact and "RCT" not in exact
    assert {r.schedule_code for r in ledger.missing_schedules(files).collect()} == set(missing)


def test_batch_isolates_failures(spark, folder, lookups, tmp_path):
    broken = f"{folder}/{NAME.format('RI', '03312024')}"
    with open(broken, "w") as f:
        f.write("WRONG\tRIAD4340\n1\t2\n")
    state = ledger.upsert_files(ledger.empty_ledger(spark), listing.scan_directory(spark, folder), F.lit(STAMP))
    after = reports.run_batch(spark, state, *lookups, str(tmp_path / "out"))
    got = {r.filename: (r.processing_status, r.row_count) for r in after.collect()}
    assert got[NAME.format("RI", "03312024")] == ("failed", None)
    assert got[NAME.format("RC", "03312024")] == ("completed", 3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7


def test_batch_keeps_earlier_runs_and_retries_single_files(spark, folder, lookups, tmp_path):
    out, seen = str(tmp_path / "out"), []
    state = ledger.upsert_files(ledger.empty_ledger(spark), listing.scan_directory(spark, folder), F.lit(STAMP))
    state = reports.run_batch(spark, state, *lookups, out, quarter="2024-Q1")
    first = spark.read.parquet(out).count()
    bad = f"{folder}/{NAME.format('RC', '09302024')}"
    with open(bad, "w") as f:
        f.write("WRONG\tRCON2170\n1\t2\n")
    state = spark.read.parquet(ledger.write_snapshot(state, str(tmp_path / "ledger"), 0))
    state = ledger.upsert_files(state, listing.scan_directory(spark, folder), F.lit(STAMP))
    state = reports.run_batch(spark, state, *lookups, out, record=lambda s: seen.append({r.processing_status for r in s.collect()}))
    got = {r.filename: r.processing_status for r in state.collect()}
    assert got.pop(NAME.format("RC", "09302024")) == "failed" and set(got.values()) == {"completed"}
    assert "processing" in seen[0]
    assert spark.read.parquet(out).count() == first + 2  # the first run's rows are still there
    with open(bad, "w") as f:
        f.write("IDRSSD\tRCON2170\n1\t2\n")
    state = spark.read.parquet(ledger.write_snapshot(state, str(tmp_path / "ledger"), 1))
    state = reports.run_batch(spark, state, *lookups, out)
    assert {r.processing_status for r in state.collect()} == {"completed"}
    assert spark.read.parquet(out).count() == first + 3


def test_jobs_do_not_grow_with_files(spark, lookups, tmp_path):
    def jobs(n):
        folder = tmp_path / f"many{n}"
        folder.mkdir()
        for i in range(n):
            (folder / NAME.format("RC", f"0331{1900 + i}")).write_text(f"IDRSSD\tRCON2170\n{i}\t10\n")
        spark.sparkContext.setJobGroup(f"files{n}", "")
        rows = reports.process_directory(spark, str(folder), *lookups).count()
        spark.sparkContext.setJobGroup("", "")
        return rows, len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"files{n}"))

    (few, few_jobs), (many, many_jobs) = jobs(3), jobs(200)
    assert (few, many) == (3, 200) and many_jobs <= few_jobs + 2


def test_same_name_in_two_folders(spark, lookups, tmp_path):
    for part, ids in (("a", "1\t1\n2\t2\n"), ("b", "3\t3\n")):
        (tmp_path / "in" / part).mkdir(parents=True)
        (tmp_path / "in" / part / NAME.format("RC", "03312024")).write_text("IDRSSD\tRCON2170\n" + ids)
    long = reports.process_directory(spark, str(tmp_path / "in"), *lookups)
    assert sorted(r.row_count for r in compare.file_counts(long).collect()) == [1, 2]


def test_repeated_dictionary_keys(spark):
    documents_ = spark.createDataFrame([('{"A": "one", "A": "two"}', "f1"), ('{"A": "three"}', "f0"), ('{"B": "b"}', "f2")], "value string, path string")
    assert sorted(r[:] for r in dictionaries.code_descriptions(documents_).collect()) == [("A", "two"), ("B", "b")]
    assert sorted(r[:] for r in dictionaries.institution_names(documents_).collect()) == [("A", "two"), ("B", "b")]


def test_folder_prefix(spark, folder):
    state = spark.createDataFrame([("/bulk/1/x", 2024, 1), ("/bulk/10/x", 2024, 1)], "filepath string, year int, quarter int")
    assert [r.filepath for r in ledger.in_directory(state, "/bulk/1").collect()] == ["/bulk/1/x"]


def test_json_sources(spark, tmp_path):
    (tmp_path / "codes.json").write_text(json.dumps({"_sample_codes": {"RCON1": "one"}, "other": 1}))
    (tmp_path / "names.json").write_text(json.dumps({"1": "First", "2": "Sécond"}))
    (tmp_path / "index.json").write_text(
        json.dumps({"filings": {"recent": {"form": ["10-K", "8-K"], "filingDate": ["2024-02-01", "bad"], "accessionNumber": ["1-2", "3-4"], "primaryDocument": ["a", "b"]}}})
    )
    read = lambda n: dictionaries.read_json_documents(spark, str(tmp_path / n))
    assert dictionaries.code_descriptions(read("codes.json")).collect()[0][:] == ("RCON1", "one")
    assert dictionaries.institution_names(read("names.json")).count() == 2
    rows = dictionaries.filings(read("index.json").withColumn("cik", F.lit(77))).orderBy("seq").collect()
    assert [(r.form, r.accession_number, r.filing_date) for r in rows] == [("10-K", "12", dt.date(2024, 2, 1)), ("8-K", "34", None)]
    assert rows[0].url.endswith("/0000000077/12/a")


def test_document_files(spark, tmp_path):
    (tmp_path / "a b.htm").write_text("<table></table>")
    (tmp_path / "c.sdf").write_text("a|b\n")
    assert {r.kind for r in documents.read_documents(spark, str(tmp_path)).collect()} == {"html", "delimited"}


def test_stream_takes_new_files_once(spark, tmp_path, lookups):
    source, out, check = (tmp_path / n for n in ("in", "out", "check"))
    source.mkdir()
    header = ["IDRSSD", "RCON2170"]

    def run():
        new_files.process_new_files(spark, str(source), header, "RC", *lookups, str(out), str(check)).awaitTermination()
        return sorted((r.rssd_id, r.name, r.amount) for r in spark.read.parquet(str(out)).collect())

    (source / NAME.format("RC", "03312024")).write_text("IDRSSD\tRCON2170\n1\t10\n")
    assert run() == [("1", "First", "10")]
    (source / NAME.format("RC", "06302024")).write_text("IDRSSD\tRCON2170\n2\t20\n")
    assert run() == [("1", "First", "10"), ("2", "Institution 2", "20")]


def test_long_sink_as_csv(spark, tmp_path):
    long = spark.createDataFrame([("1", "RC", "A", "1,0"), ("2", "RI", "B", "x")], "rssd_id string, schedule_code string, mdrm_code string, amount string")
    sinks.write_long(long, str(tmp_path / "csv"), "csv")
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert sorted((r.schedule_code, r.amount, r.amount_value) for r in back.collect()) == [("RC", "1,0", "10.0"), ("RI", "x", None)]


def test_schedules_are_written_from_one_stored_table(spark, monkeypatch):
    """All sums and cells were worked out again for every schedule's files."""
    from quarterlight.plans import catalog

    seen = []
    monkeypatch.setattr(catalog, "_WRITTEN", {})
    monkeypatch.setattr(catalog, "write_schedule", lambda wide, schedule, target: seen.append((schedule, wide.inputFiles())))
    catalog.schedule_folder(spark, "/root/testdata/sf0.001")
    assert len(seen) == 4 and not [f for _, files in seen for f in files if "lineitem" in f]


def test_quarters_are_read_from_names_before_the_unpivot(spark, folder, lookups):
    """The file's quarter was worked out for every cell instead of once for every wide row."""
    long = reports.process_directory(spark, folder, *lookups, pattern="FFIEC*.txt", quarters=True)
    assert {(r.source_file, r.quarter_key) for r in long.collect()} >= {
        (NAME.format("RC", "03312024"), "2024-Q1"), (NAME.format("RC", "06302024"), "2024-Q2")
    }
    assert "quarter_key" not in reports.process_directory(spark, folder, *lookups, pattern="FFIEC*.txt").columns
