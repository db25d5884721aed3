"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link; root is the smallest node that can be reached.

    ``links`` has columns ``a`` and ``b`` of one ordered type. Each round hangs the larger neighbours of a node on
    the smallest node near it (large star), then the smaller ones (small star); it ends when a round changes nothing.
    Minima are combined before the shuffle and written, so a node with very many links only meets them in joins
    that Spark can split. Rounds are written tables, which survive lost executors.
    """
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, before = stored(links, "links"), None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "links-least")
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, "links-large")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "links-least")
        pairs = F.inline(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        links = stored(large.join(least, "a").select(pairs).filter("a <> b").distinct(), "links")
        after = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
