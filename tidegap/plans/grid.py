"""Parameter grids: neighbours ``k``, compared slots per side ``d``, largest shift ``v``."""

from __future__ import annotations

from dataclasses import dataclass
from math import sqrt

from pyspark.sql import DataFrame, functions as F

from tidegap.functions.ranges import exp_range, exp_range_cover, exp_range_inc
from tidegap.functions.timegrid import div
from tidegap.operators.season_blocks import Shape


@dataclass(frozen=True)
class Grid:
    k: list[int]
    d: list[int]
    v: list[int]

    def shape(self, period: int, width: int | None = None) -> Shape:
        """Window side: the largest ``d`` and half a season, unless given."""
        return Shape(period, width or max(self.d) + period // 2, max(self.v))


# The small grid for trial runs and the triple chosen for filling.
TRIAL_GRID = Grid([2, 4, 8], [2, 4, 8], [0, 2, 4, 8])
CHOSEN = Grid([32], [4], [8])


def _doubling(end: float) -> list[int]:
    values = [4]
    while values[-1] < end:
        values.append(values[-1] * 2)
    return values


def default_grid(period: int, n_seasons: int) -> Grid:
    """Doubling values that cover half the seasons, a quarter season, and its root."""
    return Grid(_doubling(n_seasons // 2), _doubling(period // 4), [0, *_doubling(sqrt(period))])


def _grid_arrays(stats: DataFrame, period: int) -> DataFrame:
    return stats.select(
        "series_id",
        exp_range_cover(4, div("n_seasons", 2)).alias("ks"),
        exp_range_cover(4, F.lit(period // 4)).alias("ds"),
        F.concat(F.array(F.lit(0).cast("bigint")),
                 exp_range_cover(4, F.lit(sqrt(period)))).alias("vs"))


def param_grid(stats: DataFrame, period: int) -> DataFrame:
    """The default grid of every series as rows ``series_id, k, d, v``."""
    rows = _grid_arrays(stats, period)
    for name in ("k", "d", "v"):
        rows = rows.withColumn(name, F.explode(F.col(name + "s").cast("array<int>")))
    return rows.select("series_id", "k", "d", "v")


def exp_ranges(stats: DataFrame) -> DataFrame:
    """Doubling ranges from 4 up to half the seasons of each series, in three kinds."""
    end = div("n_seasons", 2)
    kinds = F.array(*[
        F.struct(F.lit(name).alias("kind"), f(4, end).alias("values"))
        for name, f in (("exclusive", exp_range), ("inclusive", exp_range_inc),
                        ("covering", exp_range_cover))])
    return stats.select("series_id", F.explode(kinds).alias("r")).select(
        "series_id", "r.kind", F.posexplode("r.values").alias("position", "value"))
