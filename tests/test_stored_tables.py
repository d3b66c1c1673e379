"""Sinks of one file a table and of buckets of institutions: commits, aborts, names, and what plans shuffle."""

import glob
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from quarterlight.operators import compare, metrics, normalize
from quarterlight.plans import catalog, derived
from quarterlight.sinks import table_files
from quarterlight.sinks import tables as sinks

SF = "/root/testdata/sf0.001"


def test_one_file_for_each_row(spark, tmp_path):
    rows = [(f"{i % 7}", f"table {i}.csv", f"a,{i}\nb,é") for i in range(50)]
    odd = [(None, "x.csv", None), ("..", "a/b.csv", "y"), (None, "_z.csv", "z"), ("d", "n" * 400 + ".csv", "long"), ("d", "m.csv", "1"), ("d", "m.csv", "2")]
    path = str(tmp_path / "out")
    table_files.write_files(spark.createDataFrame(rows + odd, "folder string, file string, value string").coalesce(3), path)
    files = glob.glob(f"{path}/part-*/*/*.csv")
    assert len(files) == len(rows) + len(odd)
    assert all(len(os.path.basename(f)) <= table_files.LONGEST_NAME for f in files)
    assert json.load(open(f"{path}/_metadata.json"))["table_count"] == len(files)
    assert not glob.glob(f"{path}/_staging*")
    back = {tuple(r) for r in table_files.read_files(spark, path).collect()}
    assert set(rows) <= back
    assert {("..", "a/b.csv", "y"), ("(null)", "_z.csv", "z"), ("d", "m.csv", "1"), ("d", "m_2.csv", "2")} <= back
    with pytest.raises(FileExistsError):
        table_files.write_files(spark.createDataFrame(rows, "folder string, file string, value string"), path)


def test_no_rows_no_files(spark, tmp_path):
    path = str(tmp_path / "none")
    table_files.write_files(spark.createDataFrame([], "folder string, file string, value string"), path)
    assert os.listdir(path) == ["_metadata.json"]
    assert json.load(open(f"{path}/_metadata.json"))["table_count"] == 0


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    path = str(tmp_path / "failed")
    bad = F.when(F.col("id") == 90, F.raise_error(F.lit("torn table"))).otherwise(F.lit("x"))
    rows = spark.range(0, 100, 1, 4).select(F.lit("d").alias("folder"), F.format_string("%d.csv", "id").alias("file"), bad.cast("string").alias("value"))
    with pytest.raises(Exception, match="torn table"):
        table_files.write_files(rows, path)
    assert [f for _, _, names in os.walk(path) for f in names] == []


def exchanges(df):
    """The keys of every shuffle in a plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\(([^\n]*)\), ENSURE", plan), plan


def test_buckets_are_read_without_a_shuffle_by_institution(spark, tmp_path):
    long = derived.repeated_long(spark, SF)
    stored = sinks.write_long_buckets(long, "long_in_buckets", str(tmp_path / "buckets"), 8)
    try:
        spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        keys, plan = exchanges(metrics.base_metrics(stored, ["quarter_key"]))
        assert keys == [] and "Bucketed: true" in plan
        assert len(exchanges(metrics.base_metrics(long, ["quarter_key"]))[0]) > 0
        rows = compare.attach_peers(stored, compare.peer_groups(derived.peer_members(spark, SF)))
        keys, plan = exchanges(compare.comparison(rows, ["quarter_key"], ["row_seq"], 2))
        assert "Bucketed: true" in plan
        # The institutions of the peer list move to the buckets; the long table does not move by institution.
        assert sum(k.startswith("rssd_id") for k in keys) <= 1
        one = stored.filter(F.col("rssd_id") == stored.first()["rssd_id"])
        assert "SelectedBucketsCount: 1 out of 8" in exchanges(one.groupBy("rssd_id").count())[1]
        assert stored.count() == long.count()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE long_in_buckets")


def test_buckets_in_folders_of_schedules(spark, tmp_path):
    long = derived.long_table(spark, SF)
    stored = sinks.write_long_buckets(long, "long_by_schedule", str(tmp_path / "both"), 4, "schedule_code")
    try:
        some = stored.filter("schedule_code = 'RC'")
        assert some.count() == long.filter("schedule_code = 'RC'").count()
        assert "PartitionFilters: [isnotnull(schedule_code" in exchanges(some)[1]
    finally:
        spark.sql("DROP TABLE long_by_schedule")


def test_a_long_table_to_be_grouped_is_spread_over_tasks(spark):
    """The wide rows of one file lie in one task; their cells are dealt to as many tasks as there are shuffle partitions."""
    wide = spark.range(0, 40, 1, 1).selectExpr("cast(id AS string) AS IDRSSD", "cast(id AS string) AS RCON2170", "'x' AS RCON0081", "'5' AS RIAD4340")
    names = spark.createDataFrame([("1", "First")], "rssd_id string, name string")
    codes = spark.createDataFrame([("RCON2170", "Total assets")], "mdrm_code string, description string")
    of = {"RCON2170": "RC", "RCON0081": "RC", "RIAD4340": "RI"}
    long = {spread: normalize.to_long(wide, names, codes, of, spread=spread) for spread in (False, True)}
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert long[False].rdd.getNumPartitions() == 1 and long[True].rdd.getNumPartitions() == n > 1
    got = {spread: sorted(tuple(r) for r in rows.collect()) for spread, rows in long.items()}
    assert got[True] == got[False] and len(got[True]) == 80
    # A filter on the schedule goes below the cleaning of the cells.
    plan = long[True].filter("schedule_code = 'RI'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("regexp_replace") < plan.index("schedule_code#", plan.index("Join Inner")) and "(schedule_code" in plan[plan.index("Join Inner"):]


def test_buckets_grow_with_the_shuffle_partitions(spark, tmp_path):
    stored = sinks.write_long_buckets(derived.long_table(spark, SF), "long_in_default_buckets", str(tmp_path / "default"))
    try:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        about = {r.col_name: r.data_type for r in spark.sql("DESCRIBE EXTENDED long_in_default_buckets").collect()}
        assert about["Num Buckets"] == str(n) and stored.count() > 0
    finally:
        spark.sql("DROP TABLE long_in_default_buckets")


def test_a_comparison_sorts_by_a_number_first(spark):
    rows = compare.attach_peers(derived.repeated_long(spark, SF), compare.peer_groups(derived.peer_members(spark, SF)))
    compared = compare.comparison(rows, ["quarter_key"], ["row_seq"], 2)
    plan = compared._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate(key=[_item#" in plan and "_item" not in compared.columns


def test_written_files_are_listed_by_one_job(spark, tmp_path):
    path = str(tmp_path / "many")
    rows = spark.range(0, 160, 1, 4).selectExpr("concat('d=', id div 2) AS folder", "concat(id, '.csv') AS file", "'x' AS value")
    table_files.write_files(rows, path)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "")
    try:
        back = table_files.read_files(spark, path)
        jobs = len(tracker.getJobIdsForGroup("listing"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 1
    assert {(r.folder, r.file) for r in back.collect()} == {(f"d={i // 2}", f"{i}.csv") for i in range(160)}
    empty = str(tmp_path / "none")
    table_files.write_files(rows.limit(0), empty)
    assert table_files.read_files(spark, empty).collect() == []


def test_written_files_are_listed_by_the_tasks_that_read_them(spark, tmp_path):
    """The driver's plan has one name for each task that wrote, however many files there are."""
    path = str(tmp_path / "listed")
    odd = [("a b", "x+y%.csv", "é\n1"), (None, "null.csv", "2"), ("d", "empty.csv", ""), ("d", "none.csv", None)]
    many = spark.range(0, 2600, 1, 2).selectExpr("concat('f', id div 900) AS folder", "concat(id, '.csv') AS file", "repeat('x', cast(id AS int) + 1) AS value")
    table_files.write_files(many.union(spark.createDataFrame(odd, "folder string, file string, value string").coalesce(1)), path)
    parts = glob.glob(f"{path}/part-*")
    back = table_files.read_files(spark, path)
    assert len(parts) == 3 and back.rdd.getNumPartitions() == len(parts)
    assert len(back.inputFiles()) == 0
    want = [(f"f{i // 900}", f"{i}.csv", "x" * (i + 1)) for i in range(2600)] + [("a b", "x+y%.csv", "é\n1"), ("(null)", "null.csv", "2")]
    assert sorted(tuple(r) for r in back.collect()) == sorted(want)


def small_tables(spark, path):
    """25 suppliers of which two come twice, one has no key, and their lines of nine quarters; some lines have no date or supplier."""
    key = "case when id = 25 then null when id > 25 then id - 20 else id end"
    spark.range(28).selectExpr(f"{key} AS s_suppkey", "concat('Bank ', id) AS s_name").coalesce(1).write.parquet(f"{path}/supplier.parquet")
    spark.range(3000).selectExpr("id AS p_partkey", "concat('part ', id) AS p_name").coalesce(1).write.parquet(f"{path}/part.parquet")
    spark.range(0, 1500, 1, 4).selectExpr(
        "if(id % 101 = 7, null, id % 25) AS l_suppkey", "cast(id * 37.25 AS double) AS l_extendedprice", "cast(id % 11 / 100 AS double) AS l_discount",
        "cast(id % 9 / 100 AS double) AS l_tax", "cast(id % 50 AS double) AS l_quantity", "substring('ANRX', cast(id % 4 AS int) + 1, 1) AS l_returnflag",
        "if(id % 3 = 0, 'O', 'F') AS l_linestatus", "if(id % 97 = 5, null, timestamp'1995-01-15' + make_interval(0, 3 * cast(id div 25 % 9 AS int))) AS l_shipdate",
    ).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_comparison_tables_shuffle_no_cell(spark, tmp_path):
    """Cells of a group are compared, sorted and written where its wide rows were dealt, and give the rows of the joined long table."""
    sf = small_tables(spark, tmp_path / "tables")
    compared = catalog._comparison(spark, sf)
    keys, _ = exchanges(compared)
    assert not [k for k in keys if "_item#" in k] and sum(k.startswith("peer_group#") and "rssd_id" not in k for k in keys) <= 2
    members = [compare.member_name(i) for i in range(catalog.MEMBER_COLUMNS)]
    rows = compare.attach_peers(derived.long_table(spark, sf), compare.peer_groups(derived.peer_members(spark, sf)))
    want = compare.comparison(rows, ["quarter_key"], ["code_seq"], catalog.MEMBER_COLUMNS)
    assert [k for k in exchanges(want)[0] if "_item#" in k]
    assert sorted(map(str, compared.select(*want.columns).collect())) == sorted(map(str, want.collect())) != []
    assert compared.filter("quarter_key is null").count() > 0
    path = str(tmp_path / "written")
    sinks.write_comparison(compared, path, members, together=True)
    back = spark.read.parquet(path).withColumn("file", F.input_file_name())
    assert back.groupBy("schedule_code", "peer_group").agg(F.countDistinct("file").alias("files")).filter("files <> 1").count() == 0
    assert back.count() == want.count()
    for file in glob.glob(f"{path}/*/*.parquet"):
        order = [(r.peer_group, r.grp, r.main, r.sub, r.letter or "", r.mdrm_code) for r in spark.read.parquet(file).coalesce(1).collect()]
        assert order == sorted(order)


def test_cells_unpivoted_in_place_are_the_same(spark):
    wide = spark.createDataFrame([("1", "5", None), ("2", "", "x"), (None, "7", "8")], "IDRSSD string, RCON2170 string, RIAD4340 string")
    got = [sorted(map(str, normalize.unpivot_codes(wide, ["IDRSSD"], None, in_place).collect())) for in_place in (False, True)]
    assert got[0] == got[1] and len(got[0]) == 6


def test_sums_of_lines_with_other_flags_and_gaps(spark):
    """Sums that follow from others are those of the lines themselves: other, empty or missing flags and prices, dates of any year."""
    lines = spark.range(4000).selectExpr(
        "if(id % 31 = 3, null, id % 40) AS l_suppkey", "if(id % 7 < 3 or id % 40 < 4, null, (id * 37 % 9001) / 100.0 - 20) AS l_extendedprice",
        "if(id % 13 = 1, null, id % 11 / 100.0) AS l_discount", "id % 9 / 100.0 AS l_tax", "cast(id % 50 AS double) AS l_quantity",
        "element_at(array('A', 'N', 'R', 'X', null, 'a', ''), cast(id div 3 % 7 AS int) + 1) AS l_returnflag",
        "element_at(array('O', 'F', 'P', null), cast(id div 5 % 4 AS int) + 1) AS l_linestatus",
        "if(id % 23 = 4, null, timestamp'-0002-01-15' + make_interval(id % 3 * 1000, cast(id % 30 AS int))) AS l_shipdate",
    )
    lines.createOrReplaceTempView("lines")
    where = lambda test: f"coalesce(sum(case when {test} then cents end), 0) div 100"
    want = spark.sql(f"""SELECT l_suppkey AS supp, year(l_shipdate) AS y, quarter(l_shipdate) AS q, sum(cents) div 100 AS total,
        {where("l_returnflag = 'A'")} AS flag_a, {where("l_returnflag = 'N'")} AS flag_n, {where("l_returnflag = 'R'")} AS flag_r,
        {where("l_linestatus = 'O'")} AS open_, {where("l_linestatus = 'F'")} AS filled,
        sum(cents * cast(round(l_discount * 100) AS bigint)) div 10000 AS disc, sum(cents * cast(round(l_tax * 100) AS bigint)) div 10000 AS tax,
        sum(cast(l_quantity AS bigint)) AS qty, count(*) AS lines
        FROM (SELECT *, cast(round(l_extendedprice * 100) AS bigint) AS cents FROM lines) GROUP BY 1, 2, 3""")
    got = derived.quarter_sums(lines)
    assert got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert want.filter("total is null").count() > 0 and want.filter("y < 0").count() > 0
