from datetime import datetime

from pyspark.sql import functions as F

from tidegap.functions.timegrid import MINUTE_US
from tidegap.operators.series import build_series, observed, rows_without_time
from tidegap.plans.grid import Grid
from tidegap.plans.search import parameter_search
from tidegap.sources.tables import (COUNT, TIME, read_counts, read_counts_csv, read_results, read_variant,
                                    write_counts_csv, write_results, write_table, write_variant)


def test_csv_there_and_back(spark, make_series, tmp_path):
    series = make_series({"a": [3, None, 0, 7]})
    write_counts_csv(series, str(tmp_path / "csv"))
    text = "".join(sorted(p.read_text() for p in (tmp_path / "csv").glob("*.csv")))
    assert "COUNT_TIME,NUM_TOTAL" in text and "-1.0" in text
    rows = read_counts_csv(spark, str(tmp_path / "csv"))
    back = build_series(rows, TIME, MINUTE_US, 2, F.max(observed(COUNT)))
    assert [r.value for r in back.orderBy("idx").collect()] == [3, None, 0, 7]


def test_csv_columns_by_name(spark, tmp_path):
    (tmp_path / "x.csv").write_text("LANE,NUM_TOTAL,COUNT_TIME\n1,5,2024-01-01 00:00:00\n")
    (row,) = read_counts_csv(spark, str(tmp_path / "x.csv")).collect()
    assert (row[TIME], row[COUNT]) == (datetime(2024, 1, 1), 5.0)


def test_variant_reads_one_partition(spark, make_series, tmp_path):
    path = str(tmp_path / "variants")
    write_variant(make_series({"a": [1, None]}), path, 0.05)
    write_variant(make_series({"a": [None, None]}), path, 0.1)
    got = read_variant(spark, path, 0.05)
    assert [r.value for r in got.orderBy("idx").collect()] == [1, None]
    assert "missing_ratio" in got._jdf.queryExecution().executedPlan().toString().split(
        "PartitionFilters:")[1]


def test_results_of_several_runs(spark, make_series, tmp_path):
    found = parameter_search(make_series({"a": [1, 5, 2, 4] * 12}), 4, Grid([1], [2], [0]))
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    write_results(found, one, 0.05, started=datetime(2024, 5, 6, 7, 8))
    write_results(found, one, 0.1)
    write_results(found, two, 0.9)
    rows = read_results(spark, one, two)
    tags = {r.ratio_tag: r["count"] for r in rows.groupBy("ratio_tag").count().collect()}
    n = found.count()
    assert n > 0 and tags == {"05": n, "10": n, "90": n}
    assert rows.where("started = '20240506_0708'").count() == n
    assert dict(rows.dtypes)["k"] == "int" and dict(rows.dtypes)["train_index"] == "bigint"


def test_table_hand_over(spark, tmp_path):
    table = spark.createDataFrame([(1, 2.0)], "k int, rmse double")
    assert write_table(table, str(tmp_path / "t")).collect() == table.collect()


def test_csv_is_utc_in_any_zone(spark, tmp_path):
    """Across a change of summer time, with fractions and two series."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    # 2005-04-03 09:30 UTC is half an hour before clocks change in Los Angeles.
    start = 1112520600_250000
    rows = [(name, i, start + i * 1_800_000_000, float(i)) for name in ("b", "a") for i in range(6)]
    series = spark.createDataFrame(rows, "series_id string, idx bigint, us bigint, value double").select(
        "series_id", "idx", F.timestamp_micros("us").alias("ts"), "value")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        write_counts_csv(series, str(tmp_path / "csv"), series_column="LANE")
        back = read_counts_csv(spark, str(tmp_path / "csv"), series="LANE").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    want = [(name, datetime(2005, 4, 3, 9 + (30 + 30 * i) // 60, (30 + 30 * i) % 60, 0, 250000)) for name in "ab" for i in range(6)]
    assert sorted((r.LANE, r[TIME]) for r in back) == want
    lines = [line for p in sorted((tmp_path / "csv").glob("part-*.csv")) for line in p.read_text().split("\n") if line[:1] in "ab"]
    lines = [line for line in lines if line]
    assert lines == sorted(lines)


def test_null_series_keys_and_times(spark):
    rows = [(None, datetime(2024, 1, 1, 0, i), 1.0) for i in range(4)] + [("x", datetime(2024, 1, 1, 0, i), 2.0) for i in range(4)]
    rows += [("x", None, 9.0), ("x", datetime(2024, 1, 1, 0, 5), float("nan"))]
    table = spark.createDataFrame(rows, "s string, t timestamp_ntz, v double")
    assert rows_without_time(table, "t") == 1
    got = build_series(table, "t", MINUTE_US, 2, F.max("v"), "s").collect()
    assert sorted((r.series_id, r.value) for r in got if r.value is not None) == [("(null)", 1.0)] * 4 + [("x", 2.0)] * 4


def test_a_repeated_run_counts_once(spark, make_series, tmp_path):
    found = parameter_search(make_series({"a": [1, 5, 2, 4] * 12}), 4, Grid([1], [2], [0]))
    path = str(tmp_path / "results")
    for ratio in (0.05, 0.1, 0.05):
        write_results(found, path, ratio)
    assert read_results(spark, path).count() == 2 * found.count()


LINES = ["AT,N,LANE", "2024-01-01 00:00:00,5,a", "yesterday,5,a", "2024-01-01 00:01:00,n/a,b", "2024-01-01 00:02:00,,b",
         ",7,a", "2024-01-01 00:03:00", "2024-01-01 00:04:00,1,b,more", '2024-01-01 00:05:00," 8 ","x,y"', "2024-13-01 00:00:00,1,a",
         "2024-01-01 00:06:00,NaN,a", "2024-01-01 00:07:00,-1,a"]


def test_unreadable_lines_are_told(spark, tmp_path):
    """Rows and rejects together are the lines; neither ends the job, in whatever way they are used."""
    (tmp_path / "x.csv").write_text("\n".join(LINES) + "\n")
    rows, rejects = read_counts(spark, str(tmp_path / "x.csv"), "AT", "N", "LANE")
    told = sorted((r.reason, r.line) for r in rejects.collect())
    assert told == [("columns", LINES[6]), ("columns", LINES[7]), ("count", LINES[3]), ("time", LINES[5]),
                    ("time", LINES[8 + 1]), ("time", LINES[2])]
    assert [(r.LANE, r.AT.minute, r.N) for r in rows.orderBy("AT").collect() if r.N == r.N] == [
        ("a", 0, 5.0), ("b", 2, None), ("x,y", 5, 8.0), ("a", 7, -1.0)]
    assert rows.count() + rejects.count() == len(LINES) - 1
    assert rows.agg(F.max("N")).first()[0] is not None and rows.select("LANE").count() == rows.count()
    assert {r.file.rsplit("/", 1)[1] for r in rejects.collect()} == {"x.csv"}


def test_lines_without_header(spark, tmp_path):
    (tmp_path / "x.csv").write_text("\n".join(LINES[1:4]) + "\n")
    rows, rejects = read_counts(spark, str(tmp_path / "x.csv"), "AT", "N", columns=["AT", "N", "LANE"])
    assert rows.columns == ["AT", "N"] and rows.count() == 1 and rejects.count() == 2


def test_only_rejects(spark, tmp_path):
    (tmp_path / "x.csv").write_text("COUNT_TIME,NUM_TOTAL\nx,y\n\n")
    rows, rejects = read_counts(spark, str(tmp_path / "x.csv"))
    assert rows.count() == 0 and [(r.reason, r.line) for r in rejects.collect()] == [("time", "x,y")]
    series = build_series(rows, TIME, MINUTE_US, 2, F.max(observed(COUNT)))
    assert series.count() == 0
