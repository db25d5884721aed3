"""Ordered work over keyed series that stays balanced when one key is huge.

A window partitioned by the series key alone sends a whole series to one task. The helpers here
split a series into time chunks (to number its rows) and then into position blocks (to run frames),
so the largest unit of work depends on a constant, not on how many rows one key owns:

* a chunk is one minute of one series; with distinct (key, ts) it holds at most 6e7 rows, and the
  table of chunk totals has at most one row per key and minute;
* a block is a fixed number of consecutive positions, plus a halo copied from its neighbours.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.functions.columns import micros
from lodestat.session import materialize

CHUNK_MICROS = 60_000_000
BLOCK_ROWS = 1 << 16
SALTS = 16


def join_on(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches NULL keys, keeping one copy of the key columns."""
    cols = list(cols)
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in cols else F.col(c) for c in right.columns])
    left = left.select("*")
    cond = None
    for c in cols:
        term = left[c].eqNullSafe(renamed[f"__r_{c}"])
        cond = term if cond is None else cond & term
    return left.join(renamed, cond, how).drop(*[f"__r_{c}" for c in cols])


def salted_join(rows: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join per-key statistics onto rows; a hot key is spread over ``SALTS`` partitions.

    ``stats`` has one row per key, so replicating it is cheap; rows get a salt from their content.
    The copies come from a cross join, not from ``explode``: Spark's estimate of a cross join counts them, so only a table that is
    small with all its copies is broadcast. With adaptive execution the small side still turns into a broadcast once its measured
    size is below the session threshold.
    """
    keys = list(keys)
    if not keys:
        return rows.crossJoin(F.broadcast(stats))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    salts = rows.sparkSession.range(SALTS).select(F.col("id").cast("int").alias("__salt"))
    copies = stats.crossJoin(F.broadcast(salts))
    return join_on(salted, copies, [*keys, "__salt"], how).drop("__salt")


def fitted_join(rows: DataFrame, stats: DataFrame, keys: Sequence[str], label: str = "fit") -> DataFrame:
    """Left-join a fitted per-key table, written once; the session's byte threshold decides whether it is broadcast."""
    return salted_join(rows, materialize(stats, label), keys, "left")


def _chunked(df: DataFrame, order: str) -> DataFrame:
    """``df`` with ``__chunk``, an order-preserving chunk number: the minute of a time, else a range of values.

    Ranges are cut at sampled splitters, so outliers and long common prefixes do not crowd a chunk; the written
    table fixes which rows share one.
    """
    if isinstance(df.schema[order].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return df.withColumn("__chunk", F.floor(micros(F.col(order)) / F.lit(CHUNK_MICROS)))
    return materialize(df.repartitionByRange(order).withColumn("__chunk", F.spark_partition_id().cast("long")), "ranges")


def with_position(df: DataFrame, keys: Sequence[str], ts: str, name: str = "pos", size: str = "n") -> DataFrame:
    """0-based rank of each row in its series by ``ts`` (distinct per key), and the series length.

    Row numbers are taken inside (key, chunk) and shifted by the running total of earlier chunks.
    """
    keys = list(keys)
    rows = _chunked(df, ts)
    totals = rows.groupBy(*keys, "__chunk").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        "__chunk",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"),
        F.sum("__n").over(Window.partitionBy(*keys)).alias(size),
    )
    inside = Window.partitionBy(*keys, "__chunk").orderBy(ts)
    return (
        join_on(rows, offsets, [*keys, "__chunk"])
        .withColumn(name, (F.col("__off") + F.row_number().over(inside) - 1).cast("long"))
        .drop("__chunk", "__off")
    )


def with_previous(df: DataFrame, keys: Sequence[str], ts: str, name: str = "prev_ts") -> DataFrame:
    """Previous ``ts`` of the series, looked up inside the chunk or from the chunk before it."""
    keys = list(keys)
    rows = _chunked(df, ts)
    last = rows.groupBy(*keys, "__chunk").agg(F.max(ts).alias("__last"))
    order = Window.partitionBy(*keys).orderBy("__chunk")
    carried = last.withColumn("__carry", F.lag("__last").over(order)).drop("__last")
    inside = Window.partitionBy(*keys, "__chunk").orderBy(ts)
    return (
        join_on(rows, carried, [*keys, "__chunk"])
        .withColumn(name, F.coalesce(F.lag(ts).over(inside), F.col("__carry")))
        .drop("__chunk", "__carry")
    )


def with_cumulative(df: DataFrame, keys: Sequence[str], ts: str, weight: str, name: str) -> DataFrame:
    """Exclusive running sum of ``weight`` along the series (``ts`` distinct per key)."""
    keys = list(keys)
    rows = _chunked(df, ts)
    totals = rows.groupBy(*keys, "__chunk").agg(F.sum(weight).alias("__w"))
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "__chunk", F.coalesce(F.sum("__w").over(before), F.lit(0)).alias("__off"))
    inside = Window.partitionBy(*keys, "__chunk").orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)
    return (
        join_on(rows, offsets, [*keys, "__chunk"])
        .withColumn(name, F.col("__off") + F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .drop("__chunk", "__off")
    )


def with_frames(
    df: DataFrame,
    keys: Sequence[str],
    exprs: dict[str, "callable"],
    before: int = 0,
    after: int = 0,
    pos: str = "pos",
) -> DataFrame:
    """Evaluate window expressions that look at most ``before``/``after`` positions away.

    ``exprs`` maps output name to a function of the window spec. Every block carries a halo of the
    neighbouring rows it may look at; halo rows are dropped afterwards.
    """
    keys = list(keys)
    size = max(BLOCK_ROWS, 4 * (before + after + 1))
    own = F.floor(F.col(pos) / size)
    homes = [own]
    if before:
        homes.append(F.floor((F.col(pos) + before) / size))
    if after:
        homes.append(F.floor((F.col(pos) - after) / size))
    spread = df.withColumn("__own", own).withColumn("__block", F.explode(F.array_distinct(F.array(*homes))))
    spec = Window.partitionBy(*keys, "__block").orderBy(pos)
    out = spread.select("*", *[fn(spec).alias(name) for name, fn in exprs.items()])
    return out.filter(F.col("__block") == F.col("__own")).drop("__block", "__own")


def with_running(
    df: DataFrame,
    keys: Sequence[str],
    sums: dict[str, Column],
    pos: str = "pos",
) -> DataFrame:
    """Inclusive running sums along the series: inside the block plus totals of earlier blocks."""
    keys = list(keys)
    rows = df.withColumn("__block", F.floor(F.col(pos) / BLOCK_ROWS))
    for name, expr in sums.items():
        rows = rows.withColumn(f"__v_{name}", expr)
    totals = rows.groupBy(*keys, "__block").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "__block", *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0.0)).alias(f"__o_{n}") for n in sums]
    )
    inside = Window.partitionBy(*keys, "__block").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    out = join_on(rows, offsets, [*keys, "__block"])
    for name in sums:
        out = out.withColumn(name, F.col(f"__o_{name}") + F.sum(f"__v_{name}").over(inside))
    return out.drop("__block", *[f"__{p}_{n}" for n in sums for p in ("v", "o")])


def with_carried(df: DataFrame, keys: Sequence[str], value: str, pos: str = "pos") -> DataFrame:
    """Nearest non-null ``(pos, value)`` at or before and at or after each row, as two structs."""
    keys = list(keys)
    point = F.when(F.col(value).isNotNull(), F.struct(F.col(pos).alias("p"), F.col(value).alias("v")))
    rows = df.withColumn("__block", F.floor(F.col(pos) / BLOCK_ROWS)).withColumn("__pt", point)
    ends = rows.groupBy(*keys, "__block").agg(F.min("__pt").alias("__first"), F.max("__pt").alias("__last"))
    back = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*keys).orderBy("__block").rowsBetween(1, Window.unboundedFollowing)
    carried = ends.select(
        *keys, "__block",
        F.max("__last").over(back).alias("__cb"),
        F.min("__first").over(ahead).alias("__ca"),
    )
    spec = Window.partitionBy(*keys, "__block").orderBy(pos)
    upto, onward = spec.rowsBetween(Window.unboundedPreceding, 0), spec.rowsBetween(0, Window.unboundedFollowing)
    return (
        join_on(rows, carried, [*keys, "__block"])
        .withColumn("before", F.coalesce(F.last("__pt", ignorenulls=True).over(upto), F.col("__cb")))
        .withColumn("after", F.coalesce(F.first("__pt", ignorenulls=True).over(onward), F.col("__ca")))
        .drop("__block", "__pt", "__cb", "__ca")
    )


def block_sums(
    df: DataFrame,
    keys: Sequence[str],
    partial: "callable",
    before: int = 0,
    pos: str = "pos",
) -> DataFrame:
    """Sum fixed-layout number arrays over the blocks of each series.

    ``partial(frame, owned)`` gets one block with its halo (pandas, ordered by position) and a mask of
    the rows the block owns, and returns a 1-d array. Arrays are added per key natively, so the result
    is one array per key however long the series is. Series of one key must agree on the layout.
    """
    import numpy as np
    import pandas as pd

    keys = list(keys)
    rows_per_block = max(BLOCK_ROWS, 4 * (before + 1))
    own = F.floor(F.col(pos) / rows_per_block)
    homes = [own] + ([F.floor((F.col(pos) + before) / rows_per_block)] if before else [])
    spread = df.withColumn("__own", own).withColumn("__block", F.explode(F.array_distinct(F.array(*homes))))
    fields = {f.name: f for f in spread.schema.fields}
    schema = T.StructType([fields[k] for k in keys] + [T.StructField("__a", T.ArrayType(T.DoubleType()))])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(pos)
        owned = (frame["__own"] == frame["__block"]).to_numpy()
        if not owned.any():
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in [*keys, "__a"]})
        out = frame[keys].head(1).reset_index(drop=True)
        out["__a"] = [np.asarray(partial(frame, owned), dtype=float)]
        return out

    parts = spread.groupBy(*keys, "__block").applyInPandas(run, schema)
    summed = parts.select(*keys, F.posexplode("__a").alias("__i", "__s")).groupBy(*keys, "__i").agg(
        F.sum("__s").alias("__s")
    )
    return summed.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__i", "__s"))), lambda e: e["__s"]).alias("sums")
    )
