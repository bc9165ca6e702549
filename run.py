"""Jobs on a table of counts.

    spark-submit --py-files tidegap.zip run.py search counts.csv out
    spark-submit --py-files tidegap.zip run.py search counts.csv out --missing-ratio 0.1
    spark-submit --py-files tidegap.zip run.py impute counts.csv out --k 32 --d 4 --v 8

``search`` writes ``out/results`` (errors of every triple), ``out/scores`` and
``out/best_rows``, each with one partition per missing ratio; a repeated search replaces
that of the same ratio. ``impute`` writes ``out/filled``
(Parquet) and ``out/csv``. Both write lines that cannot be read to ``out/rejects``, with
the reason, and go on without them.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession, functions as F

from tidegap.cluster import clear_scratch, pin
from tidegap.operators.filling import write_back
from tidegap.operators.sampling import mask_to_ratio
from tidegap.operators.scoring import best_params, best_rows, scores
from tidegap.operators.series import build_series, observed, trim_series
from tidegap.plans.grid import CHOSEN, TRIAL_GRID
from tidegap.plans.imputation import impute
from tidegap.plans.search import parameter_search
from tidegap.sources.tables import (COUNT, TIME, read_counts, read_results, read_variant,
                                    write_counts_csv, write_of_ratio, write_results, write_table)


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__,
                                     formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("job", choices=["search", "impute"])
    parser.add_argument("counts", help="CSV with header")
    parser.add_argument("out", help="folder for the results")
    parser.add_argument("--time-column", default=TIME)
    parser.add_argument("--count-column", default=COUNT)
    parser.add_argument("--series-column", help="tells series apart; scores are then per series")
    parser.add_argument("--step-seconds", type=int, default=300)
    parser.add_argument("--period", type=int, default=288, help="slots per season")
    parser.add_argument("--missing-ratio", type=float, help="mask to this share before the search")
    parser.add_argument("--variants", help="folder of masked series to read the ratio from")
    parser.add_argument("--trial", action="store_true", help="small grid")
    parser.add_argument("--short", choices=["shrink", "reference"], default="shrink")
    for name in ("k", "d", "v"):
        parser.add_argument(f"--{name}", type=int, default=getattr(CHOSEN, name)[0])
    return parser.parse_args(args)


def _untrimmed(spark: SparkSession, a: argparse.Namespace):
    rows, rejects = read_counts(spark, a.counts, a.time_column, a.count_column, a.series_column)
    rejects = pin(rejects, "rejects")
    for row in rejects.groupBy("reason").count().orderBy("reason").collect():  # three at most
        print(f"{row['count']} lines are left out: {row.reason}")
    rejects.write.mode("overwrite").parquet(f"{a.out}/rejects")
    return build_series(rows, a.time_column, a.step_seconds * 1_000_000, a.period,
                        F.max(observed(a.count_column)), a.series_column)


def search(spark: SparkSession, a: argparse.Namespace) -> None:
    ratio = 0.05 if a.missing_ratio is None else a.missing_ratio
    if a.variants:
        series = read_variant(spark, a.variants, ratio)
    else:
        # Trim before masking: a masked first slot would cost a season.
        series = pin(trim_series(_untrimmed(spark, a), a.period), "series")
        if a.missing_ratio is not None:
            series = mask_to_ratio(series, ratio)
    found = parameter_search(series, a.period, TRIAL_GRID if a.trial else None, short=a.short)
    write_results(found, f"{a.out}/results", ratio)
    results = read_results(spark, f"{a.out}/results").where(F.col("missing_ratio") == ratio)
    keys = ["series_id"] if a.series_column else []
    ranked = write_of_ratio(scores(results, *keys), f"{a.out}/scores", ratio)
    write_of_ratio(best_rows(results, best_params(ranked, *keys)), f"{a.out}/best_rows", ratio)


def fill(spark: SparkSession, a: argparse.Namespace) -> None:
    before = pin(_untrimmed(spark, a), "series")
    filled = impute(trim_series(before, a.period), a.period, a.k, a.d, a.v)
    after = write_table(write_back(before, filled), f"{a.out}/filled")
    write_counts_csv(after, f"{a.out}/csv", series_column=a.series_column)


def main(args: list[str] | None = None) -> None:
    a = arguments(args)
    spark = SparkSession.builder.appName(f"tidegap {a.job}").getOrCreate()
    try:
        (search if a.job == "search" else fill)(spark, a)
    finally:
        clear_scratch(spark)


if __name__ == "__main__":
    main()
