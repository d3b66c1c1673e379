"""Search for tables of terms, the ledger as a log, and the stream over all headers."""

import datetime as dt
import itertools
import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarterlight.operators import distinct_ids, ledger, ledger_log, term_index
from quarterlight.plans import reports
from quarterlight.streaming import routed

DAY = dt.datetime(2025, 1, 1)
NAME = "FFIEC CDR Call Schedule {} {}.txt"


def _terms(spark, terms):
    return spark.createDataFrame([(t,) for t in terms], "term string")


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abA é", max_size=9), max_size=12), st.lists(st.text("abB é", max_size=5), max_size=8))
def test_terms_equal_plain_containment(spark, names, terms):
    listed = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    got = term_index.names_with_terms(listed, _terms(spark, terms), "name", ["id"]).collect()
    expected = [(t, i, n) for t in set(terms) if t for i, n in enumerate(names) if t.lower() in n.lower()]
    assert sorted(map(tuple, got)) == sorted(expected)


def test_terms_with_a_stored_index(spark):
    """One index serves several searches; a name that all rows share, repeats and nulls."""
    names = [(i, "First Bank") for i in range(50)] + [(50, None), (51, ""), (52, "Bank of X"), (52, "Bank of X")]
    listed = spark.createDataFrame(names, "id int, name string")
    index = term_index.postings(listed, "name", ["id"]).cache()
    search = lambda *t: sorted((r.term, r.id) for r in term_index.names_with_terms(listed, _terms(spark, t), "name", ["id"], index).collect())
    assert search("BANK OF", None, "", "zzz", "First Bank and more") == [("BANK OF", 52), ("BANK OF", 52)]
    assert len(search("bank", "bank")) == 52
    assert search("x") == [("x", 52), ("x", 52)]
    assert search() == []


def test_institution_terms_need_equality_joins_only(spark):
    institutions = spark.createDataFrame([("1", "First Bank"), ("22", "Bank 1")], "rssd_id string, name string")
    found = term_index.search_institutions(institutions, _terms(spark, [" first bank ", "1", "9", "1", " ", None, "bank"]))
    assert sorted(map(tuple, found.collect())) == [
        ("1", "1", "First Bank", True), ("9", "9", "Institution 9", True), ("bank", "1", "First Bank", False),
        ("bank", "22", "Bank 1", False), ("first bank", "1", "First Bank", True),
    ]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_candidates_of_numbered_names_grow_with_the_terms_only(spark):
    """With n-grams of three characters every term of digits had a fixed share of all names as candidates."""
    listed = spark.range(10000, 18000).selectExpr("id", "format_string('Customer#%09d', id) as name")
    terms = spark.range(100).selectExpr("format_string('R#%09d', 10000 + id * 7) as term")
    index = term_index.postings(listed, "name", ["id"])
    counts = index.groupBy("gram").count().withColumnRenamed("count", "n_names")
    assert term_index.rarest_grams(terms, counts).join(index, "gram").count() <= 2 * 100
    assert term_index.names_with_terms(listed, terms, "name", ["id"]).count() == 100


def _listing(spark, files):
    rows = [(f"/b/{n}", n, "RC", "03312025", 1, 2025, 1, h, DAY) for n, h in files.items()]
    columns = "filepath string, filename string, schedule_code string, report_date string, quarter int, year int, file_size bigint"
    return spark.createDataFrame(rows, columns + ", file_hash string, last_modified timestamp")


def _show(df):
    return {r.filepath: (r.processing_status, r.file_hash, r.retry_count, r.error_message) for r in df.collect()}


def test_log_versions_repeats_and_snapshots(spark, tmp_path):
    root = str(tmp_path / "log")
    at = lambda n: DAY + dt.timedelta(days=n)
    ledger_log.create(ledger.empty_ledger(spark), root, at(0))
    assert ledger_log.upsert_files(spark, root, "scan 1", _listing(spark, {"a": "1", "b": "1", "c": "1"}), at(1)) == 1
    outcomes = spark.createDataFrame(
        [("/b/a", "failed", "bad"), ("/b/b", "completed", None), ("/b/unknown", "failed", "bad")], "filepath string, status string, error string"
    )
    assert ledger_log.set_status(spark, root, "run 1", outcomes, at(2)) == 2
    assert ledger_log.set_status(spark, root, "run 1", outcomes, at(3)) == 2  # a repeated batch
    assert ledger_log.compact(spark, root, at(3)) == 2 == ledger_log.compact(spark, root, at(3))
    assert ledger_log.upsert_files(spark, root, "scan 2", _listing(spark, {"b": "2", "c": "1"}), at(4)) == 3
    counts = spark.createDataFrame([("/b/c", 5, 2)], "filepath string, row_count bigint, institution_count bigint")
    ledger_log.mark_processed(spark, root, "counts", counts, at(5))
    ledger_log.reset_failed(spark, root, "reset", at(6))
    assert ledger_log.purge_old(spark, root, "purge", at(200), 90) == 6

    second = {"/b/a": ("failed", "1", 1, "bad"), "/b/b": ("completed", "1", 0, None), "/b/c": ("pending", "1", 0, None)}
    assert _show(ledger_log.state(spark, root, 0)) == {} == _show(ledger_log.state(spark, root, as_of=at(-1)))
    assert _show(ledger_log.state(spark, root, 2)) == second == _show(ledger_log.state(spark, root, as_of=at(3)))
    assert _show(ledger_log.state(spark, root, 1))["/b/a"] == ("pending", "1", 0, None)
    assert _show(ledger_log.state(spark, root)) == {"/b/a": ("pending", "1", 1, None), "/b/b": ("pending", "2", 0, None)}
    assert "/b/c" in _show(ledger_log.state(spark, root, 5))
    # A removed file that is found again begins anew; only changed rows were stored.
    ledger_log.upsert_files(spark, root, "scan 3", _listing(spark, {"c": "1"}), at(201))
    assert _show(ledger_log.state(spark, root))["/b/c"] == ("pending", "1", 0, None)
    changes = ledger_log.history(spark, root, _listing(spark, {"a": "", "b": "", "c": ""})).collect()
    assert sorted((r.version, r.filename) for r in changes) == [
        (1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (3, "b"), (4, "c"), (5, "a"), (6, "c"), (7, "c")
    ]
    assert sorted(r.removed for r in changes) == [False] * 9 + [True]


def test_stored_rows_of_a_log_are_not_shuffled_again(spark, tmp_path):
    """A state and what is joined with it by path are put together in the log's buckets, after a snapshot too."""
    root = str(tmp_path / "log")
    listing = _listing(spark, {str(i): str(i) for i in range(40)})
    ledger_log.create(ledger.upsert_files(ledger.empty_ledger(spark), listing), root, DAY, 4)
    ledger_log.upsert_files(spark, root, "scan", _listing(spark, {str(i): "x" for i in range(30, 50)}), DAY)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for _ in range(2):
            state = ledger_log.state(spark, root)
            outcomes = spark.range(30, 50).selectExpr("concat('/b/', id) AS filepath", "'completed' AS status", "'' AS error")
            joined = ledger.set_status(state, outcomes)
            plan = joined._jdf.queryExecution().executedPlan().toString()
            # Only what is joined with the state moves.
            assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
            assert joined.filter("processing_status = 'completed'").count() == 20 and joined.count() == 50
            ledger_log.compact(spark, root, DAY)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # A session that does not know the log's table, and a ledger path kept by a log without buckets.
    for table in spark.catalog.listTables():
        if table.name.startswith("ledger_log_"):
            spark.sql(f"DROP TABLE {table.name}")
    assert ledger_log.state(spark, root).count() == 50
    plain = str(tmp_path / "plain")
    ledger_log._write(ledger_log.state(spark, root).withColumn("removed", F.lit(False)), plain, 0, "create", DAY, "snapshot", None)
    assert ledger_log.set_status(spark, plain, "run", state.selectExpr("filepath", "'completed' AS status", "'' AS error").limit(5), DAY) == 1
    assert ledger_log.state(spark, plain).filter("processing_status = 'completed'").count() == 5


def test_log_ignores_what_an_ended_run_left(spark, tmp_path, monkeypatch):
    """A batch whose commit was not written is worked out again, and its rows count once."""
    root = str(tmp_path / "log")
    ledger_log.create(ledger.empty_ledger(spark), root, DAY)
    listing = _listing(spark, {"a": "1"})
    writes = itertools.count()
    whole = ledger_log._stamp
    monkeypatch.setattr(spark, "range", lambda *a: (_ for _ in ()).throw(RuntimeError(f"lost {next(writes)}")))
    with pytest.raises(RuntimeError):
        ledger_log.upsert_files(spark, root, "scan", listing, DAY)
    monkeypatch.undo()
    assert ledger_log._stamp is whole and _show(ledger_log.state(spark, root)) == {}
    assert len(os.listdir(f"{root}/changes")) == 2
    assert ledger_log.upsert_files(spark, root, "scan", listing, DAY) == 1
    assert list(_show(ledger_log.state(spark, root))) == ["/b/a"]


@pytest.fixture
def lookups(spark):
    return (
        spark.createDataFrame([("1", "First")], "rssd_id string, name string"),
        spark.createDataFrame([("RCON2170", "Total assets")], "mdrm_code string, description string"),
    )


def test_stream_routes_headers_and_settles_amendments(spark, tmp_path, lookups):
    files, output, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    (files / "1").mkdir(parents=True)
    (files / "2").mkdir()
    rc = NAME.format("RC", "03312024")
    (files / "1" / rc).write_text("IDRSSD\tRCON2170\tRCON0081\n1\t10\t5\n2\t20\t6\n")
    (files / "1" / NAME.format("RI", "03312024")).write_text("IDRSSD\tRIAD4340\n1\t7\n")
    for part, code in ((1, "RIADB904"), (2, "RIADB905")):  # parts of one schedule stand side by side
        (files / "1" / NAME.format("RCT", f"03312024({part} of 2)")).write_text(f"IDRSSD\t{code}\n4\t{part}\n")
    (files / "1" / "Readme.txt").write_text("nothing\there\n")
    (files / "1" / NAME.format("RCN", "03312024")).write_text("ID\tRCON1403\n1\t7\n")

    def run():
        routed.process_new_files(spark, str(files), *lookups, output, checkpoint).awaitTermination()

    def current():
        rows = routed.current_rows(spark, output).collect()
        assert sorted((r.part, r.mdrm_code) for r in rows if r.schedule_code == "RCT") == [(1, "RIADB904"), (2, "RIADB905")]
        rows = [r for r in rows if r.schedule_code != "RCT"]
        return sorted((r.rssd_id, r.schedule_code, r.mdrm_code, r.amount, r.batch) for r in rows)

    run()
    assert current() == [("1", "RC", "RCON0081", "5", 0), ("1", "RC", "RCON2170", "10", 0), ("1", "RI", "RIAD4340", "7", 0),
                         ("2", "RC", "RCON0081", "6", 0), ("2", "RC", "RCON2170", "20", 0)]
    # Institution 1 files again with a new code and without an old one; institution 3 is new; 2 keeps what it filed.
    (files / "2" / rc).write_text("IDRSSD\tRCON2170\tRCON9999\n1\t11\t1\n3\t30\t\n")
    run()
    amended = [("1", "RC", "RCON2170", "11", 1), ("1", "RC", "RCON9999", "1", 1), ("1", "RI", "RIAD4340", "7", 0),
               ("2", "RC", "RCON0081", "6", 0), ("2", "RC", "RCON2170", "20", 0), ("3", "RC", "RCON2170", "30", 1)]
    assert current() == amended
    run()  # a restart finds nothing
    # A batch that ended before its commit is run again over its own folder.
    again = spark.read.format("binaryFile").load(str(files / "2" / rc)).selectExpr("path", "modificationTime AS modified", "length AS size")
    routed.store_batch(again, 1, *lookups, output)
    assert current() == amended
    assert sorted((r.source_path.rsplit("/", 1)[1], r.error) for r in routed.failures(spark, output).collect()) == [
        (NAME.format("RCN", "03312024"), "no IDRSSD column"), ("Readme.txt", "no schedule in the name")
    ]
    filed = routed.filings(spark, output).filter("rssd_id = '1' and schedule_code = 'RC'").collect()
    assert sorted((r.batch, r.is_current, r.n_cells) for r in filed) == [(0, False, 2), (1, True, 2)]


def test_distinct_ids_of_any_form(spark):
    rows = [("a", "1"), ("a", "1"), ("a", "01"), ("a", None), ("a", "40000"), ("b", "1"), ("b", "x"), ("b", "-1"), ("b", "9" * 19),
            ("c", None), ("c", "0"), ("c", "0"), ("c", "")]
    ids = spark.createDataFrame(rows, "file string, rssd_id string")
    maps = distinct_ids.id_bitmaps(ids, ["file"]).cache()
    assert sorted(map(tuple, distinct_ids.id_counts(maps, ["file"]).collect())) == [("a", 3), ("b", 4), ("c", 2)]
    assert distinct_ids.id_counts(maps, []).first()[0] == len({i for _, i in rows if i is not None})
    assert distinct_ids.id_counts(distinct_ids.merged(maps, []), []).first()[0] == 8
    none = distinct_ids.id_bitmaps(ids.limit(0), ["file"])
    assert distinct_ids.id_counts(none, ["file"]).collect() == [] and distinct_ids.id_counts(none, []).first()[0] == 0


def test_bundles_are_whole(spark):
    """Every table of a bundle, every member of a group, and label rows without members."""
    sections = spark.createDataFrame(
        [("q", 1, "S", "L", [1.0] * 7, 1.0), ("q", 1, "S", "only a label", None, None)],
        "quarter_key string, peer_group bigint, section string, label string, members array<double>, peer_avg double",
    )
    assets = spark.createDataFrame([("q", "7", 1, 5.0, None)], "quarter_key string, rssd_id string, peer_group bigint, total_assets double, flag string")
    rows = reports.bundle_rows({"sections": sections, "total_assets": assets}, ["quarter_key"]).collect()
    of = sorted((r.member, r.value) for r in rows if r.table == "sections" and r.item == "S: L")
    assert of == [("peer_1", 1.0), ("peer_2", 1.0), ("peer_3", 1.0), ("peer_4", 1.0), ("peer_5", 1.0), ("peer_6", 1.0), ("peer_avg", 1.0), ("primary", 1.0)]
    assert sorted((r.rssd_id, r.item, r.value, r.content) for r in rows if r.table == "total_assets") == [
        ("7", "flag", None, None), ("7", "total_assets", 5.0, None)
    ]
    assert len(rows) == 10


def test_members_and_the_cells_beside_them_come_from_one_pass(spark):
    ratios = spark.createDataFrame(
        [("q", 1, "L", [2.0, None], 1.5, "good"), ("q", 2, "L", [], None, None), ("q", 3, "L", None, 1.0, "x")],
        "quarter_key string, peer_group bigint, label string, members array<double>, peer_avg double, status string",
    )
    rows = reports.bundle_rows({"ratios": ratios}, ["quarter_key"])
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert sorted((r.peer_group, r.member, r.value, r.content) for r in rows.collect()) == [
        (1, "peer_1", None, None), (1, "peer_avg", 1.5, None), (1, "primary", 2.0, None), (1, "status", None, "good"),
        (2, "peer_avg", None, None), (2, "status", None, None),
    ]
