"""Tiles are counted and dealt by cost, whatever the mix of long and short series."""

from pyspark.sql import functions as F

from tidegap.operators.season_blocks import SUMMED_TOGETHER, Shape, _asked, dealt, tiles
from tidegap.operators import season_blocks

SHAPE = Shape(24, 16, 2, query_seasons=8, history_seasons=256)


def mix(spark, short=3000, seasons=30, long=7300):
    """Queries and facts of many short series and a long one; two queries a season."""
    series = spark.range(short).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("series_id"), F.lit(seasons).alias("n"))
    series = series.unionByName(spark.range(1).select(F.lit("long").alias("series_id"), F.lit(long).alias("n")))
    asked = series.withColumn("season", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    queries = asked.select("series_id", F.explode(F.array(*[(F.col("season") * 24 + i).cast("bigint") for i in (5, 17)])).alias("q_idx"))
    facts = series.select("series_id", (F.col("n") * 24).cast("bigint").alias("n_slots"), F.col("n").cast("bigint").alias("_n"),
                          F.lit(0).cast("bigint").alias("_lo"), (F.col("n") - 1).cast("bigint").alias("_hi"))
    return queries, facts


def real_tiles(short=3000, seasons=30, long=7300):
    groups = lambda n: -(-n // SHAPE.query_seasons)
    return short * groups(seasons) + groups(long) * -(-(long - 1) // SHAPE.history_seasons)


def test_tiles_are_those_that_there_are(spark):
    queries, facts = mix(spark)
    found = tiles(_asked(queries, SHAPE), facts, SHAPE).agg(
        F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"), F.countDistinct("series_id", "qc", "hc").alias("keys")).first()
    assert found.n == found.keys == real_tiles()
    # Every query meets every season of its history in every shift, in one tile.
    assert found.cost == (3000 * 60 * 28 + 14600 * 7298) * 5


def test_no_task_has_twice_the_mean(spark):
    queries, facts = mix(spark)
    costs = tiles(_asked(queries, SHAPE), facts, SHAPE).persist()
    for tasks in (7, 64, 2000, 10**9):
        there, parts = dealt(costs, tasks)
        load = there.join(costs, ["series_id", "qc", "hc"]).groupBy("task").agg(F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("n"))
        rows = load.collect()
        assert sum(r.n for r in rows) == real_tiles() and {r.task for r in rows} <= set(range(parts))
        mean = sum(r.cost for r in rows) / parts
        assert max(r.cost for r in rows) <= 2 * mean
        assert parts <= max(tasks, 1) and (tasks > 64 or parts == tasks)


def test_buckets_do_not_change_the_sum(spark, monkeypatch):
    """Many buckets: the running sum goes on from bucket to bucket."""
    queries, facts = mix(spark, short=50, long=600)
    costs = tiles(_asked(queries, SHAPE), facts, SHAPE).persist()
    monkeypatch.setattr(season_blocks, "SUMMED_TOGETHER", 20)
    there, parts = dealt(costs, 30)
    load = [r.cost for r in there.join(costs, ["series_id", "qc", "hc"]).groupBy("task").agg(F.sum("cost").alias("cost")).collect()]
    assert sum(load) == costs.agg(F.sum("cost")).first()[0] and max(load) <= 2 * sum(load) / parts
    assert SUMMED_TOGETHER > 20


def test_nothing_to_deal(spark):
    queries, facts = mix(spark, short=2, seasons=2, long=2)
    there, parts = dealt(tiles(_asked(queries, SHAPE), facts.where("_n >= 3"), SHAPE), 8)
    assert there.count() == 0 and parts == 1
