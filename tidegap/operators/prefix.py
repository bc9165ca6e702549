"""Running sums over many places of a key, without a task that sees a whole key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Places summed in one window.
TOGETHER = 4096


def with_before(rows: DataFrame, keys: list[str], place: str, n: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``n`` over the smaller places of the same key, as ``name``.

    ``place`` counts from 0 and comes once in each key. Places are summed in blocks of
    ``TOGETHER``. The blocks before block ``b`` are, for each bit that is set in ``b``, one
    aligned run of as many blocks; such runs are plain sums. So there is no window over
    the blocks of a key either. ``rows`` are read several times and should be written; the
    largest place comes to the driver, as with one block there is nothing to join.
    """
    within = Window.partitionBy(*keys, "_block").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(n).over(within), F.lit(0))
    blocked = rows.withColumn("_block", F.expr(f"{place} div {TOGETHER}"))
    if (rows.agg(F.max(place)).first()[0] or 0) < TOGETHER:
        return blocked.withColumn(name, inside).drop("_block")
    sums = blocked.groupBy(*keys, "_block").agg(F.sum(n).alias("_sum"))
    tops = sums.groupBy(*keys).agg(F.max("_block").alias("_top")).where("_top > 0")
    several = sums.join(tops, keys)
    runs = (several.withColumn("_bit", F.expr("explode(sequence(0, length(bin(_top)) - 1))"))
            .withColumn("_run", F.expr("shiftright(_block, _bit)")).where("_run % 2 = 0")
            .groupBy(*keys, "_bit", "_run").agg(F.sum("_sum").alias("_sum")))
    asked = (several.where("_block > 0").withColumn("_bit", F.expr(
        "explode(filter(sequence(0, length(bin(_block)) - 1), b -> shiftright(_block, b) % 2 = 1))"))
        .select(*keys, "_block", "_bit", F.expr("shiftright(_block, _bit) - 1").alias("_run")))
    prior = asked.join(runs, [*keys, "_bit", "_run"]).groupBy(*keys, "_block").agg(F.sum("_sum").alias("_prior"))
    return blocked.join(prior, [*keys, "_block"], "left").withColumn(
        name, inside + F.coalesce("_prior", F.lit(0))).drop("_block", "_prior")
