"""Long table, metric lookup, ratios and peer comparison on small fixtures."""

import pytest
from pyspark.sql import functions as F

from quarterlight import dims
from quarterlight.operators import compare, metrics, normalize, quality


@pytest.fixture
def institutions(spark):
    return spark.createDataFrame([("1", "First"), ("2", "Second")], "rssd_id string, name string")


@pytest.fixture
def descriptions(spark):
    return spark.createDataFrame([("RCON2170", "Total assets"), ("RCON0071", "")], "mdrm_code string, description string")


def test_fixed_tables():
    rows = dims.line_item_rows()
    assert len(rows) == 88 and len(dims.EXPECTED_SCHEDULES) == 39 and len(dims.METRIC_CODES) == 34
    items = {(s, c): i for s, c, i, _ in rows}
    assert items["RI", "RIAD4065"] == "RI.1.e" and items["RI", "RIAD4115"] == "RI.1.f"
    assert len(dims.FINANCIAL_WORDS) == 38 and len(dims.SCHEDULES) == 19


def test_long_table(spark, institutions, descriptions, rows):
    wide = spark.createDataFrame(
        [("1", "10", "(2)", "t"), (" 9 ", "5", None, "t"), (" ", "1", "1", "t"), (None, "1", "1", "t")],
        "IDRSSD string, RCON2170 string, RCFD0071 string, TEXT1 string",
    )
    long = normalize.to_long(wide, institutions, descriptions, "RC")
    assert sorted(rows(long, "rssd_id", "name", "line_item", "description", "mdrm_code", "amount")) == [
        ("1", "First", "RC.1.b", "Consolidated item - Consolidated Balance Sheet", "RCFD0071", "-2"),
        ("1", "First", "RC.12", "Total assets", "RCON2170", "10"),
        ("9", "Institution 9", "RC.12", "Total assets", "RCON2170", "5"),
    ]
    raw = normalize.to_long(wide, institutions, descriptions, "Unknown", mode="raw")
    assert sorted(rows(raw.filter("rssd_id = '1'"), "line_item", "description", "amount")) == [("", "", "(2)"), ("", "Total assets", "10")]
    one = normalize.to_long(wide, institutions, descriptions, "RC", rssd_ids=["1"])
    assert one.count() == 2


def test_suffix_of_any_length(spark, rows):
    codes = spark.createDataFrame([("RC", "RCFD0"), ("RI", "RIAD74"), ("RCR1", "RCOB8274"), ("XX", "RCON2170")], "schedule_code string, mdrm_code string")
    mapped = [(s, c, i) for s, c, i, _ in dims.line_item_rows()]

    def slow(schedule, code):
        base = {"RCR1": "RCR"}.get(schedule, schedule)
        return next((i for s, c, i in mapped if s == base and c == code), None) or next(
            (i for s, c, i in mapped if s == base and c.endswith(code[4:])), ""
        )

    for schedule, code, item in rows(normalize.with_line_items(codes), "schedule_code", "mdrm_code", "line_item"):
        assert item == slow(schedule, code)


def _long(spark, cells):
    schema = "rssd_id string, schedule_code string, schedule_seq int, mdrm_code string, amount string, amount_num double, row_seq bigint"
    return spark.createDataFrame(cells, schema)


def test_metric_precedence(spark):
    long = _long(
        spark,
        [
            ("1", "RC", 0, "RCON2170", "7", 7.0, 2), ("1", "RC", 0, "RCON2170", "8", 8.0, 1),
            ("1", "RCX", 1, "RCFD2170", "9", 9.0, 1),
            # The first row of a code decides; when it is no number, the next code is tried, not the next row.
            ("1", "RC", 0, "RCON0081", "x", None, 1), ("1", "RC", 0, "RCON0081", "5", 5.0, 2), ("1", "RC", 0, "RCON0071", "6", 6.0, 1),
            ("1", "RC", 0, "RCFN2200", "3", 3.0, 1), ("1", "RC", 0, "RCON6631", "4", 4.0, 1),
            ("2", "RC", 0, "RCON9999", "1", 1.0, 1),
        ],
    )
    got = {r.rssd_id: r for r in metrics.base_metrics(long).collect()}
    assert got["1"].total_assets == 8.0 and got["1"].cash_and_due == 6.0 and got["1"].total_deposits == 7.0
    assert got["2"].total_assets == 0.0 and got["2"].total_deposits == 0.0


def test_wide_metrics_equal_long_metrics(spark, institutions, descriptions):
    rc = spark.createDataFrame(
        [("1", "1", "100", None, "ND"), ("2", "2", "x", "50", "3"), ("1", "3", "900", "7", "1")],
        "IDRSSD string, seq string, RCFD2170 string, RCON2170 string, RCON0081 string",
    ).withColumn("row_seq", F.col("seq").cast("bigint"))
    ri = spark.createDataFrame([("1", "1", "(4)"), ("2", "2", "8")], "IDRSSD string, seq string, RIAD4340 string").withColumn(
        "row_seq", F.col("seq").cast("bigint")
    )
    parts = [
        normalize.to_long(w, institutions, descriptions, s, carry=["row_seq"]).withColumn("schedule_seq", F.lit(i))
        for i, (s, w) in enumerate((("RC", rc), ("RI", ri)))
    ]
    columns = ["rssd_id", *dims.METRIC_CODES]
    by_long = metrics.base_metrics(normalize.union_schedules(parts)).select(*columns)
    by_wide = metrics.wide_base_metrics([(rc, "RC"), (ri, "RI")], order="row_seq").select(*columns)
    assert sorted(map(tuple, by_long.collect())) == sorted(map(tuple, by_wide.collect()))


def test_zero_means_missing(spark):
    base = {m: 0.0 for m in dims.METRIC_CODES}
    table = spark.createDataFrame(
        [
            tuple((base | {"net_income": -2.0, "total_assets": 100.0}).values()),
            tuple((base | {"net_income": 2.0, "noninterest_income": -5.0, "net_interest_income": 5.0}).values()),
        ],
        ", ".join(f"{m} double" for m in base),
    )
    first, second = metrics.with_ratios(table).orderBy("net_income").collect()
    assert first.roa == -8.0 and first.roe == 0.0 and first.gap_ratio == 0.0
    assert second.roa == 0.0 and second.efficiency_ratio == 0.0 and second.cost_of_funds == 0.0


@pytest.mark.parametrize(
    "metric, value, status",
    [
        ("roa", 1.5, "Excellent"), ("roa", 1.499, "Good"), ("roa", 0.5, "Adequate"), ("roa", -3.0, "Needs Improvement"),
        ("efficiency_ratio", 50.0, "Good"), ("efficiency_ratio", 70.0, "Needs Improvement"), ("loan_deposit_ratio", 90.0, "Good"),
        ("loan_deposit_ratio", 69.9, "Good"), ("loan_deposit_ratio", 105.0, "Adequate"), ("loan_deposit_ratio", 110.0, "Needs Improvement"),
        ("npl_ratio", 1.0, "N/A"),
    ],
)
def test_ratings(spark, metric, value, status):
    from quarterlight.functions import ratios

    assert spark.range(1).select(ratios.ratio_status(F.lit(metric), F.lit(value))).first()[0] == status


def test_peer_groups_and_validation(spark):
    members = spark.createDataFrame(
        [("g", "1", 0), ("g", "2", 1), ("g", "1", 2), ("g", "2", 3), ("h", "7", 0)]
        + [("five", str(10 + i), i) for i in range(5)] + [("wide", "20", 0), ("wide", "21", 1)]
        + [("near", "30", 0), ("near", "31", 1)] + [("close", "40", 0), ("close", "41", 1), ("close", "42", 2)],
        "peer_group string, rssd_id string, seq int",
    )
    peers = compare.peer_groups(members)
    assert sorted((r.peer_group, r.rssd_id, r.ordinal) for r in peers.collect() if r.peer_group in "gh") == [
        ("g", "1", 0), ("g", "2", 1), ("h", "7", 0),
    ]
    sizes = {"1": 1.0, "2": 1.0, "7": 5.0, "20": 1.0, "21": 101.0, "30": 1.0, "31": 51.0, "40": 1.0, "41": 49.0, "42": 0.0}
    sizes |= {str(10 + i): 1.0 for i in range(5)}
    table = spark.createDataFrame([(k, v) for k, v in sizes.items()], "rssd_id string, total_assets double")
    checked = {r.peer_group: (r.is_valid, r.size_warning) for r in compare.validate_peers(peers, table, []).collect()}
    assert checked == {
        "g": (True, "none"), "h": (False, "none"), "five": (False, "none"), "wide": (True, "large"),
        "near": (True, "significant"), "close": (True, "none"),
    }


def test_comparison_keeps_last_value_and_first_description(spark):
    rows = spark.createDataFrame(
        [
            ("g", 2, 0, "RC", "RC.1", "A", "first", "1", 1), ("g", 2, 0, "RC", "RC.1", "A", "second", "2", 2),
            ("g", 2, 1, "RC", "RC.1", "A", "other", "9", 1), ("g", 2, 1, "RC", "RC.2", "B", "only peer", "5", 2),
        ],
        "peer_group string, set_size int, ordinal int, schedule_code string, line_item string, mdrm_code string,"
        " description string, amount string, code_seq int",
    )
    got = {r.mdrm_code: (r.description, r.primary, r.peer_1, r.peer_2) for r in compare.comparison(rows, [], ["code_seq"]).collect()}
    assert got == {"A": ("first", "2", "9", None), "B": ("only peer", "—", "5", None)}


def test_statistics_count_members_without_data(spark):
    row = {"total_assets": 4e6, "roa": 1.0, "roe": 2.0, "efficiency_ratio": 3.0, "npl_ratio": 4.0}
    members = spark.createDataFrame(
        [("g", 0, 3, *row.values()), ("g", 1, 3, *[2 * v for v in row.values()])],
        "peer_group string, ordinal int, set_size int, " + ", ".join(f"{k} double" for k in row),
    )
    roa = compare.peer_statistics(members, []).filter("label = 'ROA (%)'").first()
    assert (roa.mean, roa.median) == (1.0, 1.0)
    assert abs(roa.std_dev - (2 / 3) ** 0.5) < 1e-12 and abs(roa.primary_percentile - 200 / 3) < 1e-9


def test_quality_issues(spark):
    sparse = spark.createDataFrame([(str(i), "1" if i == 0 else None) for i in range(50)], "IDRSSD string, RCON1 string")
    assert quality.quality_report(sparse).first().issues == "Low data density: 2.0%"
    none = spark.createDataFrame([(None, "a")], "IDRSSD string, other string")
    assert quality.quality_report(none).first().issues == "No valid institution IDs found; No MDRM code columns found"
    assert quality.quality_report(sparse.filter("false")).first().issues == "No data rows found"
    assert "Missing required" in quality.quality_report(sparse.drop("IDRSSD")).first().issues
