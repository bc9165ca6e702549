"""Seasons as arrays with a margin on both sides, and their meeting with queries.

A block holds the values of one season and of ``margin`` slots before and after
it, so the window of every candidate of that season, shifted or not, is a slice of
one array. Queries and blocks meet on tiles: a few query seasons against a bounded
number of history seasons. That spreads a long series over many tasks and ships an
array once per tile in place of once per candidate. History is copied once per group
of query seasons; how many form a group follows the number of queries.

The tiles are counted, with the comparisons each will make, and dealt to tasks along the
running sum of these costs. So a task gets its share of the work whatever the mix of long
and short series, and no more tasks are made than there is work for.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window, functions as F

from tidegap.cluster import pin, task_count
from tidegap.functions.timegrid import div
from tidegap.operators.series import attach_facts, season_stats, slot_of_season


#: Queries that a tile should hold where seasons have few.
QUERIES_OF_TILE = 256
#: Comparisons (query, season, shift) that make a task of their own, some minutes of work.
TASK_COST = 1 << 27
#: Rows of the table of tiles that are summed in one place.
SUMMED_TOGETHER = 100_000
#: Columns of queries that bring their own parameters.
OWN = ["k", "d", "v", "width"]


@dataclass(frozen=True)
class Shape:
    """Fixed sizes of one search: slots per season, window side, largest shift."""

    period: int
    width: int
    max_shift: int
    query_seasons: int = 8
    history_seasons: int = 256

    @property
    def margin(self) -> int:
        return self.width + self.max_shift


def _dense_seasons(series: DataFrame, period: int) -> DataFrame:
    """``series_id, season, part``: the values of a season by slot; an absent row is NULL."""
    slot = slot_of_season("idx", period).alias("slot")
    known = F.when(~F.isnan("value"), F.col("value")).alias("value")
    rows = series.groupBy("series_id", div("idx", period).alias("season")).agg(
        F.array_sort(F.collect_list(F.struct(slot, known))).alias("rows"))
    place = F.map_from_entries("rows")
    # Looking up every slot is only needed where some have no row.
    sparse = F.transform(F.sequence(F.lit(0), F.lit(period - 1)), lambda i: F.element_at("by_slot", i))
    return rows.withColumn("by_slot", F.when(F.size("rows") < period, place)).select(
        "series_id", "season",
        F.when(F.col("by_slot").isNull(), F.col("rows")["value"]).otherwise(sparse).alias("part"))


def season_blocks(series: DataFrame, shape: Shape) -> DataFrame:
    """``series_id, season, vals``: ``vals[margin + slot]`` is the value of a slot.

    Every array has ``period + 2 * margin`` places; those of slots without a row, of
    absent seasons and beyond the ends of the series are NULL. A season sends its
    neighbours only the slice that their margins show.
    """
    period, margin = shape.period, shape.margin
    size, reach = period + 2 * margin, -(-margin // period)
    seasons = _dense_seasons(series, period)
    # Where the season begins in the block of the season ``by`` places further on.
    start = F.lit(margin) - F.col("by") * period
    near = (
        seasons.withColumn("by", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
        .withColumn("skip", F.greatest(-start, F.lit(0)))
        .withColumn("from", F.greatest(start, F.lit(0)))
        .withColumn("n", F.least(F.lit(period) - F.col("skip"), F.lit(size) - F.col("from")))
        .where("n > 0")
        .select("series_id", (F.col("season") + F.col("by")).alias("at"), "from",
                F.slice("part", F.col("skip") + 1, F.col("n")).alias("vals"))
    )
    joined = near.groupBy("series_id", "at").agg(
        F.array_sort(F.collect_list(F.struct("from", "vals"))).alias("parts"))
    none = lambda n: F.array_repeat(F.lit(None).cast("double"), n)
    full = F.aggregate("parts", F.array().cast("array<double>"), lambda acc, p: F.concat(
        acc, none(F.greatest(p["from"] - F.size(acc), F.lit(0))), p["vals"]))
    # A season without a row of its own has a block too: shifts reach its neighbours.
    return joined.select(
        "series_id", F.col("at").alias("season"),
        F.slice(F.concat(full, none(F.lit(size))), 1, size).alias("vals"))


def grouped(shape: Shape, queries: DataFrame) -> Shape:
    """The shape with as many query seasons to a tile as hold some hundred queries."""
    asked = queries.select("series_id", div("q_idx", shape.period).alias("season"), "q_idx").distinct()
    per_season = asked.groupBy("series_id", "season").count().agg(
        F.count(F.lit(1)).alias("seasons"), F.sum("count").alias("n")).first()  # two numbers
    seasons, n = per_season[0], per_season[1] or 0
    wanted = QUERIES_OF_TILE * seasons // max(1, n)
    spread = seasons // (2 * task_count(queries.sparkSession))
    return replace(shape, query_seasons=max(1, min(32, wanted, spread)))


def _asked(queries: DataFrame, shape: Shape) -> DataFrame:
    """``series_id, qc, season, slots`` of each query season, and its own parameters if it has any."""
    own = [F.first(c).alias(c) for c in OWN if c in queries.columns]
    season = div("q_idx", shape.period).alias("season")
    return queries.groupBy("series_id", season).agg(
        F.array_sort(F.collect_set(slot_of_season("q_idx", shape.period))).alias("slots"), *own).withColumn(
        "qc", div("season", shape.query_seasons))


def _history(series: DataFrame, period: int) -> DataFrame:
    """Facts of the series that have history: their seasons from the second to the last but one complete."""
    return season_stats(series, period).where("n_seasons >= 3").select(
        "series_id", "n_slots", F.col("n_seasons").alias("_n"),
        F.lit(0).cast("bigint").alias("_lo"),
        div(F.col("n_slots") - 1, period).alias("_hi"))


def tiles(asked: DataFrame, seasons: DataFrame, shape: Shape) -> DataFrame:
    """``series_id, qc, hc, cost`` of each tile that there is, its cost in comparisons."""
    size = F.lit(shape.history_seasons).cast("bigint")
    shifts = 2 * (F.col("v") if "v" in asked.columns else F.lit(shape.max_shift)) + 1
    per_group = (attach_facts(asked, seasons, "season", "_lo", "_hi")
                 .groupBy("series_id", "qc").agg(F.sum(F.size("slots") * shifts).alias("asked"), F.max("_n").alias("_n")))
    chunks = F.sequence(F.lit(0).cast("bigint"), div(F.col("_n") - 2, shape.history_seasons))
    held = F.least((F.col("hc") + 1) * size, F.col("_n") - 1) - F.greatest(F.col("hc") * size, F.lit(1))
    return (per_group.withColumn("hc", F.explode(chunks))
            .select("series_id", "qc", "hc", (F.col("asked") * held).alias("cost")).where("cost > 0"))


def dealt(costs: DataFrame, tasks: int) -> tuple[DataFrame, int]:
    """``series_id, qc, hc, task``, tiles dealt along the running sum of their costs, and the tasks.

    ``tasks`` parts of equal cost are cut out of the sum; a tile goes to the part it
    begins in. There are no more parts than tiles as dear as the dearest, so none costs
    more than twice the mean. The sum is taken within buckets of bounded size, and over
    the buckets.
    """
    facts = costs.agg(F.count(F.lit(1)), F.sum("cost"), F.max("cost")).first()  # three numbers
    n, total, dearest = facts[0], facts[1] or 0, facts[2] or 1
    parts = max(1, min(max(tasks, -(-total // TASK_COST)), total // dearest))
    buckets = max(1, n // SUMMED_TOGETHER)
    keyed = costs.withColumn("bucket", F.pmod(F.xxhash64("series_id", "qc"), F.lit(buckets)))
    within = Window.partitionBy("bucket").orderBy("series_id", "qc", "hc").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("cost").over(within), F.lit(0))
    if buckets > 1:
        up_to = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        # One row for each bucket, a hundred-thousandth of the tiles.
        sums = keyed.groupBy("bucket").agg(F.sum("cost").alias("cost")).select(
            "bucket", F.coalesce(F.sum("cost").over(up_to), F.lit(0)).alias("prior"))
        keyed, before = keyed.join(sums, "bucket"), before + F.col("prior")
    part = F.floor(before.cast("decimal(38,0)") * parts / max(1, total))
    return keyed.select(
        "series_id", "qc", "hc", F.least(part, F.lit(parts - 1)).cast("int").alias("task")), parts


def tile_sides(queries: DataFrame, series: DataFrame, shape: Shape) -> tuple[DataFrame, DataFrame, int]:
    """Query seasons and history seasons of every tile, with ``series_id, qc, hc, task``; the tasks.

    A query season crosses the shuffle as one array with the slots of its queries,
    however many there are. Seasons that serve as history (second to last but one
    complete) go to the tiles that hold queries, so few queries on a long series cost
    little.
    """
    blocks = season_blocks(series, shape)
    asked, seasons = _asked(queries, shape), _history(series, shape.period)
    there, tasks = dealt(pin(tiles(asked, seasons, shape), "tiles"), task_count(series.sparkSession))
    own = [c for c in OWN if c in queries.columns]
    left = asked.join(blocks, ["series_id", "season"]).join(there, ["series_id", "qc"]).select(
        "series_id", "qc", "hc", "task", F.col("season").alias("q_season"), "slots", F.col("vals").alias("q_vals"), *own)
    right = (
        attach_facts(blocks, seasons, "season", "_lo", "_hi", block=32)
        .where(F.least("season", F.col("_n") - 1 - F.col("season")) >= 1)
        .select("series_id", div("season", shape.history_seasons).alias("hc"),
                F.col("season").cast("int").alias("season"), "n_slots", "vals")
        .join(there, ["series_id", "hc"])
        .select("series_id", "qc", "hc", "task", "season", "n_slots", "vals")
    )
    # toDF gives the columns of the two sides identities of their own.
    return left.toDF(*left.columns), right.toDF(*right.columns), tasks


def dealt_tiles(queries: DataFrame, series: DataFrame, shape: Shape) -> DataFrame:
    """Both sides as one table in the order of tiles, each tile whole in its task.

    ``series_id, qc, hc, history, season, slots, n_slots, vals``, and the queries' own
    parameters if they bring any. The number of partitions follows the cost of the tiles:
    a tile holds few bytes and much work.
    """
    left, right, tasks = tile_sides(queries, series, shape)
    own = [c for c in OWN if c in queries.columns]
    none = lambda kind: F.lit(None).cast(kind)
    key = ["series_id", "qc", "hc"]
    both = left.select(*key, "task", F.lit(False).alias("history"), F.col("q_season").cast("int").alias("season"), "slots",
                       none("bigint").alias("n_slots"), F.col("q_vals").alias("vals"), *own).unionByName(
        right.select(*key, "task", F.lit(True).alias("history"), "season", none("array<int>").alias("slots"),
                     "n_slots", "vals", *[none("int").alias(c) for c in own]))
    return both.repartitionById(tasks, F.col("task")).sortWithinPartitions(*key, "history", "season").drop("task")
