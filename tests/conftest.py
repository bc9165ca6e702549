import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from checks.compare import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    # Few tasks: the inputs are tiny, and a task costs more than its work.
    session_ = session(**{"spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "2"})
    session_.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("scratch")))
    yield session_


@pytest.fixture(scope="session")
def make_series(spark):
    """A series table from {name: [value or None, ...]}, one slot a minute."""

    def make(series):
        rows = [(name, i, None if v is None else float(v))
                for name, values in series.items() for i, v in enumerate(values)]
        table = spark.createDataFrame(rows, "series_id string, idx bigint, value double")
        return table.withColumn("ts", F.timestamp_micros(F.col("idx") * 60_000_000)).select(
            "series_id", "idx", "ts", "value")

    return make


@pytest.fixture(scope="session")
def make_queries(spark):
    def make(rows):
        return spark.createDataFrame(rows, "series_id string, q_idx bigint, truth double")

    return make
