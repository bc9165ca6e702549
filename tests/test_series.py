from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidegap.functions.timegrid import HOUR_US
from tidegap.operators.filling import fill, remaining_missing, write_back
from tidegap.operators.series import (build_series, missing_ratio, missing_slots, observed,
                                      season_stats, trim_series)


def _rows(spark, hours, start=datetime(2024, 1, 1, 5)):
    """Rows at the given hours after ``start`` with the count -1 for every fourth."""
    return spark.createDataFrame(
        [(start + timedelta(hours=h), -1 if h % 4 == 3 else h) for h in hours],
        "ts timestamp_ntz, n int")


def test_grid_has_every_slot(spark):
    series = build_series(_rows(spark, [0, 1, 5, 7]), "ts", HOUR_US, 24, F.max(observed("n")))
    rows = {r.idx: r.value for r in series.collect()}
    assert rows == {5: 0, 6: 1, 7: None, 8: None, 9: None, 10: 5, 11: None, 12: None}
    first = series.where("idx = 5").select(F.unix_seconds("ts")).first()[0]
    assert first == 1704085200  # 2024-01-01 05:00 UTC


def test_before_1970(spark):
    rows = _rows(spark, [0, 1, 30], start=datetime(1969, 12, 30, 23))
    series = build_series(rows, "ts", HOUR_US, 24, F.max(observed("n")))
    assert [r.idx for r in series.orderBy("idx").collect()] == list(range(23, 54))


def test_session_zone_does_not_matter(spark):
    rows = _rows(spark, [0, 1, 2])
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = build_series(rows, "ts", HOUR_US, 24, F.count(F.lit(1))).select("idx").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert sorted(r.idx for r in got) == [5, 6, 7]


def test_trim_starts_at_a_season_and_ends_with_a_value(spark):
    raw = build_series(_rows(spark, range(0, 60)), "ts", HOUR_US, 24, F.max(observed("n")))
    trimmed = trim_series(raw, 24)
    # Hour 59 has the mark for missing, so hour 58 is the last; slot 24 is hour 19.
    rows = sorted((r.idx, r.value) for r in trimmed.collect())
    assert rows[0] == (0, None) and rows[1] == (1, 20) and rows[-1] == (39, 58) and len(rows) == 40


def test_trim_while_building_is_the_same(spark):
    for hours in (range(0, 60), [3, 7, 50], range(40, 90, 7)):
        args = (_rows(spark, hours), "ts", HOUR_US, 24, F.max(observed("n")))
        late = trim_series(build_series(*args), 24)
        early = build_series(*args, trim=True)
        assert sorted(late.collect(), key=str) == sorted(early.collect(), key=str)


def test_long_series_crosses_blocks(spark):
    rows = spark.createDataFrame(
        [("a", datetime(2020, 1, 1)), ("a", datetime(2021, 6, 1)), ("b", datetime(2020, 2, 1))],
        "s string, ts timestamp_ntz")
    series = build_series(rows, "ts", HOUR_US, 24, F.count(F.lit(1)), "s")
    counts = {r.series_id: r["count"] for r in series.groupBy("series_id").count().collect()}
    assert counts == {"a": 517 * 24 + 1, "b": 1}
    assert series.where("value IS NOT NULL").count() == 3
    assert series.select("series_id", "idx").distinct().count() == series.count()


def test_stats_and_missing(make_series):
    series = make_series({"a": [1, None, 3, None, 5, 6, 7]})
    (stats,) = season_stats(series, 2).collect()
    assert (stats.n_slots, stats.n_observed, stats.n_seasons, stats.last_slot) == (7, 5, 3, 0)
    assert (stats.train_min_idx, stats.train_max_idx) == (2, 3)
    (share,) = missing_ratio(series).collect()
    assert share.n_missing == 2 and abs(share.added_missing_ratio - (0.9 - 2 / 7)) < 1e-12
    assert sorted(r.idx for r in missing_slots(series).collect()) == [1, 3]


def test_fill_and_write_back(spark, make_series):
    series = make_series({"a": [1, None, 3, None]})
    found = spark.createDataFrame([("a", 1, 2.5)], "series_id string, q_idx bigint, prediction double")
    filled = fill(series, found)
    assert {r.idx: (r.value, r.is_imputed) for r in filled.collect()} == {
        0: (1, False), 1: (2.5, True), 2: (3, False), 3: (None, False)}
    longer = make_series({"a": [1, None, 3, None, None, 9]})
    back = write_back(longer, filled)
    assert [r.value for r in back.orderBy("idx").collect()] == [1, 2.5, 3, None, None, 9]
    (left,) = remaining_missing(longer, back).collect()
    assert (left.missing_before, left.missing_after) == (3, 2)
