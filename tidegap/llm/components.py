"""Connected components of links between BIGINT vertices.

Every round hooks each vertex to its smallest neighbour, follows the hooks to their
ends and contracts the graph; what remains are links between the ends. The smallest
vertex of a component is never hooked, so it names the component. Each table is written
to the shared folder, so a lost executor costs only running tasks and lineage stays
short. Nothing but row counts comes to the driver. A hub with many neighbours is
aggregated map-side; the joins on it are plain joins that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegap.cluster import pin


def _follow(hooks: DataFrame) -> DataFrame:
    """``v, to`` with every ``to`` moved to the end of its chain of hooks."""
    while True:
        onward = hooks.select(F.col("v").alias("to"), F.col("to").alias("next"))
        moved = pin(hooks.join(onward, "to", "left").select(
            "v", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")),
            "chains")
        hooks = moved.select("v", "to")
        if moved.where("moved").isEmpty():
            return hooks


def components(links: DataFrame) -> DataFrame:
    """``v, component`` for every vertex of ``links(a, b)`` that isn't its component's smallest.

    Null ends, loops and repeated links are ignored; an empty input gives no rows.
    """
    links = links.where(F.col("a") != F.col("b"))
    found = None
    while True:
        both = links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("to"))
        hooks = pin(both.groupBy("v").agg(F.min("to").alias("to")), "hooks")
        if hooks.isEmpty():
            return found if found is not None else hooks.select("v", F.col("to").alias("component"))
        hooks = _follow(hooks)
        end = hooks.select(F.col("v").alias("a"), F.col("to").alias("a_end"))
        other = hooks.select(F.col("v").alias("b"), F.col("to").alias("b_end"))
        links = pin(
            links.join(end, "a", "left").join(other, "b", "left")
            .select(F.coalesce("a_end", "a").alias("a"), F.coalesce("b_end", "b").alias("b"))
            .where("a != b").distinct(), "links")
        mapped = hooks.select("v", F.col("to").alias("component"))
        if found is not None:
            later = mapped.select(F.col("v").alias("component"), F.col("component").alias("later"))
            mapped = mapped.unionByName(
                found.join(later, "component", "left")
                .select("v", F.coalesce("later", "component").alias("component")))
        if links.isEmpty():
            return mapped
        found = pin(mapped, "components")
