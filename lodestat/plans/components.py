"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.plans.skew import salted_join
from lodestat.session import materialize


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) with the smallest node of each component as its name.

    ``nodes`` has a column ``node``, ``edges`` columns ``a`` and ``b``. In each round a node takes the least
    label among its neighbours, passes it on to the node its old label names, and follows its label one
    jump further, so long chains shrink by halves. Rounds are written tables, which keeps plans short, and
    stop when nothing changes. Joins are salted, so a hub does not fill one task.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, "edges")
    labels = materialize(nodes.select("node", F.col("node").alias("component")), "components")
    if both.isEmpty():
        return labels
    for _ in range(max_rounds):
        seen = salted_join(both.withColumnRenamed("b", "node"), labels, ["node"], "inner")
        least = seen.groupBy(F.col("a").alias("node")).agg(F.min("component").alias("__l"))
        lower = labels.join(least, "node", "left").select(
            "node", F.col("component").alias("__old"), F.least("component", F.coalesce("__l", "component")).alias("__new")
        )
        lower = materialize(lower, "components-lower")
        hooks = lower.filter("__new < __old").groupBy(F.col("__old").alias("node")).agg(F.min("__new").alias("__h"))
        hooked = lower.join(hooks, "node", "left").select(
            "node", "__old", F.least("__new", F.coalesce("__h", "__new")).alias("component")
        )
        jump = lower.select(F.col("node").alias("component"), F.col("__new").alias("__j"))
        moved = salted_join(hooked, jump, ["component"], "left").select(
            "node", F.least("component", F.coalesce("__j", "component")).alias("component"), "__old"
        )
        moved = materialize(moved, "components")
        if moved.filter(F.col("component") != F.col("__old")).isEmpty():
            return moved.drop("__old")
        labels = moved.drop("__old")
    raise RuntimeError("components did not settle; raise max_rounds")
