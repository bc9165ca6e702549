"""The two jobs from a CSV to the tables they leave."""

import random
from datetime import datetime, timedelta

import pytest

from run import main


@pytest.fixture(scope="module")
def counts(tmp_path_factory):
    rng = random.Random(8)
    path = tmp_path_factory.mktemp("counts") / "counts.csv"
    start = datetime(2005, 4, 10)
    lines = ["COUNT_TIME,NUM_TOTAL"]
    for i in range(30 * 24 + 5):
        mark = i < 3 or rng.random() < 0.1
        lines.append(f"{start + timedelta(hours=i)},{-1 if mark else 10 + i % 24 + rng.randint(0, 3)}")
    path.write_text("\n".join(lines) + "\n")
    return str(path)


HOURLY = ["--step-seconds", "3600", "--period", "24"]


def test_search(spark, counts, tmp_path):
    out = str(tmp_path)
    main(["search", counts, out, "--trial", "--missing-ratio", "0.2", *HOURLY])
    results = spark.read.parquet(f"{out}/results")
    scores = spark.read.parquet(f"{out}/scores").toPandas()
    best = spark.read.parquet(f"{out}/best_rows").toPandas()
    assert len(scores) == 3 * 3 * 4
    # The series runs from slot 24 to the last count that is not a mark.
    values = [int(line.split(",")[1]) for line in open(counts).read().split()[2::2]]
    slots = max(i for i, n in enumerate(values) if n >= 0) - 24 + 1
    assert len(best) == int(0.05 * slots) and results.count() == len(scores) * len(best)
    assert (best.ground_truth + best.err - best.imputed_prediction).abs().max() < 1e-9
    assert scores.rmse.min() < 3


def test_impute(spark, counts, tmp_path):
    out = str(tmp_path)
    main(["impute", counts, out, "--k", "4", "--d", "4", "--v", "2", *HOURLY])
    filled = spark.read.parquet(f"{out}/filled")
    assert filled.count() == 30 * 24 + 5
    # The three leading marks lie before the first whole season and stay missing, as do
    # the other gaps of that season.
    gone = filled.where("value IS NULL")
    assert 3 <= gone.count() and gone.where("idx >= 24").count() == 0
    rows = spark.read.option("header", True).csv(f"{out}/csv")
    assert rows.columns == ["COUNT_TIME", "NUM_TOTAL"] and rows.count() == filled.count()


def test_search_can_be_repeated(spark, counts, tmp_path):
    out = str(tmp_path)
    for ratio in ("0.2", "0.3", "0.2"):
        main(["search", counts, out, "--trial", "--missing-ratio", ratio, *HOURLY])
    for name in ("results", "scores", "best_rows"):
        by = {r.missing_ratio: r["count"] for r in spark.read.parquet(f"{out}/{name}").groupBy("missing_ratio").count().collect()}
        assert sorted(by) == [0.2, 0.3] and by[0.2] == by[0.3]
    assert by[0.2] * 36 == spark.read.parquet(f"{out}/results").where("missing_ratio = 0.2").count()


def test_unreadable_lines_do_not_end_a_job(spark, counts, tmp_path):
    bad = tmp_path / "bad.csv"
    bad.write_text(open(counts).read() + "yesterday,3\n2005-04-12 00:00:00,n/a\n2005-04-12 00:00:00\n")
    main(["impute", str(bad), str(tmp_path / "out"), "--k", "4", "--d", "4", "--v", "2", *HOURLY])
    assert sorted(r.reason for r in spark.read.parquet(str(tmp_path / "out" / "rejects")).collect()) == ["columns", "count", "time"]
    assert spark.read.parquet(str(tmp_path / "out" / "filled")).count() == 30 * 24 + 5
