"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from checks import queries as q
from checks.compare import session
from tidegap.operators.sampling import mask_to_ratio
from tidegap.operators.scoring import scores
from tidegap.plans.imputation import impute
from tidegap.plans.search import parameter_search

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def impute_series(spark, folder):
    """Hourly counts per event type, a third of them masked, so that there are gaps to fill."""
    series = mask_to_ratio(q.ev_type_hour(spark, folder), 0.35)
    return impute(series, 24, k=4, d=4, v=2)


def knn_errors(spark, folder):
    return parameter_search(mask_to_ratio(q.ev_type_hour(spark, folder), 0.35), 24, q.GRID)


def grid_5min(spark, folder):
    return scores(parameter_search(mask_to_ratio(q.ev_5min(spark, folder), 0.35), 288))


def grid_published_size(spark, folder):
    """Default grid on 51,840 slots in 180 seasons; about 2,600 hold-out points."""
    return scores(parameter_search(q.ev_50s(spark, folder), 288))


def impute_published_size(spark, folder):
    """Every gap of the same series with the chosen triple."""
    return impute(q.ev_50s(spark, folder), 288)


BENCH = {
    "series_build": q.series_build,
    "mask_to_ratio": q.masked,
    "knn_errors": knn_errors,
    "knn_grid": q.default_grid_search,
    "rmse_by_missing_ratio": q.ratio_scores,
    "impute_series": impute_series,
    "impute_5min": q.impute_5min,
    "grid_5min": grid_5min,
    "impute_published_size": impute_published_size,
    "grid_published_size": grid_published_size,
}


def main() -> None:
    spark = session(CPUS)
    q.stats(spark, FOLDER).collect()  # starts the executor threads and loads classes
    q.predictions(spark, FOLDER.replace("sf0.1", "sf0.001")).collect()  # and the Python workers
    times = {}
    for name, query in BENCH.items():
        if len(sys.argv) > 1 and name not in sys.argv[1:]:
            continue
        began = time.time()
        query(spark, FOLDER).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    series = q.ev_50s(spark, FOLDER).agg(
        F.count_if(F.col("value").isNull()), F.count(F.lit(1))).first()
    points = {"impute_published_size": series[0], "grid_published_size": int(0.05 * series[1])}
    print(json.dumps({
        "metric": "headline queries, total time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
        "cpus": int(CPUS),
        "sec_per_point": {n: round(times[n] / c, 5) for n, c in points.items() if n in times and c},
    }))


if __name__ == "__main__":
    main()
