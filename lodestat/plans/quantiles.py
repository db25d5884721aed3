"""Exact interpolated quantiles without holding a group's values in one task.

Pass one takes mergeable quantile sketches, which bracket each wanted rank. Pass two keeps single
values only inside the bracket and collapses everything outside to two rows (count below with its
maximum, count above with its minimum). The bracket is cut into equal slices; slice totals tell which
one or two slices hold the wanted rank, and only the values of those are put in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.plans.skew import join_on, salted_join
from lodestat.session import materialize

ACCURACY = 10_000
SLACK = 5.0 / ACCURACY
SLICES = 4096


def marks(v: Column, probs: dict[str, float]) -> Column:
    """Sketched values a little below and above each wanted rank."""
    fractions = [f for p in probs.values() for f in (max(0.0, p - SLACK), min(1.0, p + SLACK))]
    return F.percentile_approx(v, [float(f) for f in fractions], ACCURACY)


def exact_quantiles(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    bounded_keys: bool = False,
    weight: str | None = None,
    sketch: DataFrame | None = None,
) -> DataFrame:
    """One row per key: ``n`` and a column per entry of ``probs`` (linear interpolation).

    ``bounded_keys`` says the number of keys is fixed (table columns), so brackets may be broadcast. Rows may be distinct values with
    a ``weight``; then ``sketch`` (keys, n, __marks) holds what :func:`marks` found for the values behind them.
    """
    keys = list(keys)
    v = F.col(value)
    rows = rows.select(*keys, value, (F.col(weight) if weight else F.lit(1)).alias("__w")).filter(v.isNotNull())
    if sketch is None:
        sketch = rows.groupBy(*keys).agg(F.count(v).alias("n"), marks(v, probs).alias("__marks"))
    targets = sketch.select(
        *keys,
        "n",
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("name"),
                    F.lit(float(p)).alias("p"),
                    F.element_at("__marks", 2 * i + 1).alias("lo"),
                    F.element_at("__marks", 2 * i + 2).alias("hi"),
                )
                for i, (name, p) in enumerate(probs.items())
            ]
        ).alias("__t"),
    )
    if bounded_keys:
        joined = rows.join(F.broadcast(targets), keys) if keys else rows.crossJoin(F.broadcast(targets))
    else:
        joined = salted_join(rows, targets, keys, "inner")
    hits = joined.select(*keys, value, "__w", "n", F.inline("__t"))
    part = F.try_divide(v - F.col("lo"), F.col("hi") - F.col("lo"))
    slice_of = F.when(F.col("__side") == 0, F.coalesce(F.floor(part * SLICES).cast("int"), F.lit(0))).otherwise(0)
    side = F.when(v < F.col("lo"), -1).when(v > F.col("hi"), 1).otherwise(0)
    ranked = (
        hits.withColumn("__side", side)
        .withColumn("__slice", slice_of)
        .groupBy(*keys, "name", "p", "n", "__side", "__slice", F.when(F.col("__side") == 0, v).alias("__v"))
        .agg(F.sum("__w").alias("__c"), F.min(v).alias("__min"), F.max(v).alias("__max"))
        .withColumn("__v", F.coalesce("__v", F.when(F.col("__side") < 0, F.col("__max")).otherwise(F.col("__min"))))
    )
    h = F.col("p") * (F.col("n") - 1)
    # Written once: it is used twice and holds only the brackets, while its input is the whole table.
    ranked = materialize(ranked, "quantile-brackets")
    slices = ranked.groupBy(*keys, "name", "__side", "__slice").agg(F.sum("__c").alias("__s"), F.max(h).alias("__h"))
    by_slice = Window.partitionBy(*keys, "name").orderBy("__side", "__slice").rowsBetween(Window.unboundedPreceding, 0)
    wanted = (
        slices.withColumn("__end", F.sum("__s").over(by_slice))
        .withColumn("__before", F.col("__end") - F.col("__s"))
        .filter((F.col("__end") > F.floor("__h")) & (F.col("__before") <= F.ceil("__h")))
        .select(*keys, "name", "__side", "__slice", "__before")
    )
    on = [*keys, "name", "__side", "__slice"]
    few = join_on(ranked, F.broadcast(wanted) if bounded_keys else wanted, on)
    inside = Window.partitionBy(*on).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    few = few.withColumn("__cum", F.col("__before") + F.sum("__c").over(inside))
    picked = (
        few.withColumn("__h", h)
        .groupBy(*keys, "name", "n")
        .agg(
            F.min(F.when(F.col("__cum") > F.floor("__h"), F.col("__v"))).alias("__a"),
            F.min(F.when(F.col("__cum") > F.ceil("__h"), F.col("__v"))).alias("__b"),
            F.max("__h").alias("__h"),
        )
        .withColumn("__q", F.col("__a") + (F.col("__h") - F.floor("__h")) * (F.col("__b") - F.col("__a")))
    )
    return picked.groupBy(*keys, "n").agg(
        *[F.max(F.when(F.col("name") == name, F.col("__q"))).alias(name) for name in probs]
    )
