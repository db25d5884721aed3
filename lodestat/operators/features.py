"""Fitted column transforms and train/test splits.

A transform fits its statistics on ``fit_on`` (default: the frame itself) and applies them to the
frame. Statistics per column are one row; statistics per category are a fitted table joined by
:func:`lodestat.plans.skew.fitted_join`.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.functions.columns import NUMERIC, TEXT, columns_of_kind, present_number, q
from lodestat.operators.encoding import sparse_rows, vector_cells
from lodestat.operators.profile import column_quantiles, iqr_bounds, numeric_long, top_values
from lodestat.plans.quantiles import exact_quantiles
from lodestat.plans.skew import fitted_join, salted_join, with_position
from lodestat.session import materialize

MAX_CATEGORIES = 1000


def select_features(df: DataFrame, target: str | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """Every column but the target and the excluded ones."""
    return df.drop(*[c for c in [target, *exclude] if c])


def class_weights(df: DataFrame, target: str, weight: str = "weight") -> DataFrame:
    """Balanced row weights n / (k * n_class)."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("__c"))
    total = counts.agg(F.sum("__c").alias("__n"), F.count(F.lit(1)).alias("__k"))
    weights = counts.crossJoin(F.broadcast(total)).select(  # one-row side
        target, (F.col("__n") / (F.col("__k") * F.col("__c"))).alias(weight)
    )
    return fitted_join(df, weights, [target], "weights")


def _one_row(stats: DataFrame, columns: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Per-column statistics as one row of ``__<field>_<i>`` columns."""
    return stats.agg(
        *[
            F.max(F.when(F.col("column_name") == c, F.col(f))).alias(f"__{f}_{i}")
            for i, c in enumerate(columns)
            for f in fields
        ]
    )


def _apply(df: DataFrame, stats: DataFrame, columns: Sequence[str], change) -> DataFrame:
    """Replace each column by ``change(column, field)`` with the one-row statistics attached."""
    wide = df.crossJoin(F.broadcast(stats))  # one-row side
    index = {c: i for i, c in enumerate(columns)}
    return wide.select(
        *[
            change(present_number(df, c) if c in index else q(c), lambda f, c=c: F.col(f"__{f}_{index[c]}")).alias(c)
            if c in index
            else q(c)
            for c in df.columns
        ]
    )


def impute_numeric(df: DataFrame, columns: Sequence[str] | None = None, fit_on: DataFrame | None = None) -> DataFrame:
    """Missing numbers replaced by the fitted median."""
    columns = list(columns or columns_of_kind(df, NUMERIC))
    stats = _one_row(column_quantiles(fit_on or df, {"median": 0.5}, columns), columns, ["median"])
    return _apply(df, stats, columns, lambda v, s: F.coalesce(v, s("median")))


def impute_mode(df: DataFrame, columns: Sequence[str] | None = None, fit_on: DataFrame | None = None) -> DataFrame:
    """Missing text replaced by the most frequent value, the smallest on ties."""
    columns = list(columns or columns_of_kind(df, TEXT))
    modes = top_values(fit_on or df, 1, columns)
    stats = modes.agg(
        *[F.max(F.when(F.col("column_name") == c, F.col("value"))).alias(f"__{i}") for i, c in enumerate(columns)]
    )
    wide = df.crossJoin(F.broadcast(stats))  # one-row side
    return wide.select(
        *[F.coalesce(q(c), F.col(f"__{columns.index(c)}")).alias(c) if c in columns else q(c) for c in df.columns]
    )


def _moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    v = F.col("v")
    return numeric_long(df, columns).groupBy("column_name").agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")
    )


def _safe(width: Column) -> Column:
    return F.when(width == 0, F.lit(1.0)).otherwise(width)


def scale_standard(df: DataFrame, columns: Sequence[str] | None = None, fit_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population std, a zero std counting as 1."""
    columns = list(columns or columns_of_kind(df, NUMERIC))
    stats = _one_row(_moments(fit_on or df, columns), columns, ["mean", "std"])
    return _apply(df, stats, columns, lambda v, s: (v - s("mean")) / _safe(s("std")))


def scale_minmax(df: DataFrame, columns: Sequence[str] | None = None, fit_on: DataFrame | None = None) -> DataFrame:
    """(x - min) / (max - min), a zero range counting as 1."""
    columns = list(columns or columns_of_kind(df, NUMERIC))
    stats = _one_row(_moments(fit_on or df, columns), columns, ["min", "max"])
    return _apply(df, stats, columns, lambda v, s: (v - s("min")) / _safe(s("max") - s("min")))


def scale_robust(df: DataFrame, columns: Sequence[str] | None = None, fit_on: DataFrame | None = None) -> DataFrame:
    """(x - median) / IQR, a zero IQR counting as 1."""
    columns = list(columns or columns_of_kind(df, NUMERIC))
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    stats = _one_row(column_quantiles(fit_on or df, probs, columns), columns, list(probs))
    return _apply(df, stats, columns, lambda v, s: (v - s("median")) / _safe(s("q3") - s("q1")))


def clip_outliers(df: DataFrame, columns: Sequence[str] | None = None, fit_on: DataFrame | None = None) -> DataFrame:
    """Values moved to the fences of 1.5 IQR."""
    columns = list(columns or columns_of_kind(df, NUMERIC))
    fences = iqr_bounds(column_quantiles(fit_on or df, {"q1": 0.25, "q3": 0.75}, columns))
    stats = _one_row(fences, columns, ["lower_bound", "upper_bound"])
    return _apply(
        df, stats, columns, lambda v, s: F.when(v.isNotNull(), F.greatest(F.least(v, s("upper_bound")), s("lower_bound")))
    )


def categories(df: DataFrame, column: str) -> list[str]:
    """Sorted distinct values, refused above ``MAX_CATEGORIES`` (use another encoding there)."""
    rows = df.select(q(column).cast("string").alias("v")).filter(F.col("v").isNotNull()).distinct()
    found = [r[0] for r in rows.limit(MAX_CATEGORIES + 1).collect()]
    if len(found) > MAX_CATEGORIES:
        raise ValueError(f"{column} has more than {MAX_CATEGORIES} categories: use target or frequency encoding")
    return sorted(found)


def one_hot(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """One 0/1 column per fitted category; unknown values are all zeros.

    Column names are the cleaned values; where two columns would share a name, the category's number is appended.
    For columns of very many categories see ``one_hot_vector``.
    """
    kept = [c for c in df.columns if c not in set(columns)]
    taken, flags = {c.lower() for c in kept}, []
    for c in columns:
        for code, value in enumerate(categories(fit_on or df, c)):
            name = f"{c}_{re.sub('[^0-9A-Za-z]+', '_', value)}"
            while name.lower() in taken:
                name = f"{name}_{code}"
            taken.add(name.lower())
            flags.append(F.coalesce((q(c).cast("string") == value).cast("int"), F.lit(0)).alias(name))
    return df.select(*[q(c) for c in kept], *flags)


def one_hot_vector(df: DataFrame, column: str, fit_on: DataFrame | None = None) -> DataFrame:
    """A sparse 0/1 vector per row as ``<column>_vector``, for any number of categories; unknown values are all zeros."""
    coded = label_encode(df, column, fit_on)
    size = (fit_on or df).select(q(column)).filter(q(column).isNotNull()).distinct().count()
    code = F.coalesce(q(f"{column}_code"), F.lit(size)).cast("double")
    coded = coded.withColumn("__code", code)
    spark = df.sparkSession
    encoder = OneHotEncoder(inputCols=["__code"], outputCols=[f"{column}_vector"], dropLast=True)
    return encoder.fit(spark.createDataFrame([(float(size),)], "__code double")).transform(coded).drop("__code", f"{column}_code")


def target_encode(df: DataFrame, column: str, target: str, fit_on: DataFrame | None = None) -> DataFrame:
    """Mean target of the category as ``<column>_target``; unknown categories get the overall mean."""
    base = fit_on or df
    means = base.groupBy(column).agg(F.avg(target).alias(f"{column}_target"))
    overall = base.agg(F.avg(target).alias("__all"))
    joined = fitted_join(df, means, [column], "target-encode").crossJoin(F.broadcast(overall))  # one-row side
    return joined.withColumn(f"{column}_target", F.coalesce(f"{column}_target", "__all")).drop("__all")


def frequency_encode(df: DataFrame, column: str, fit_on: DataFrame | None = None) -> DataFrame:
    """Share of rows with the category as ``<column>_freq``; unknown categories get 0."""
    counts = (fit_on or df).groupBy(column).agg(F.count(F.lit(1)).alias("__c"))
    total = counts.agg(F.sum("__c").alias("__n"))
    shares = counts.crossJoin(F.broadcast(total)).select(column, (F.col("__c") / F.col("__n")).alias(f"{column}_freq"))
    return fitted_join(df, shares, [column], "frequency-encode").fillna(0.0, [f"{column}_freq"])


def label_encode(df: DataFrame, column: str, fit_on: DataFrame | None = None) -> DataFrame:
    """Sorted distinct values numbered from 0 as ``<column>_code``.

    Values are numbered in parallel: a range partitioning by value, counts per partition, and the
    running total of earlier partitions.
    """
    values = (fit_on or df).select(column).filter(q(column).isNotNull()).distinct()
    # The written table fixes which values share a range, so counts and row numbers agree.
    ranges = materialize(values.repartitionByRange(column).withColumn("__p", F.spark_partition_id()), "label-ranges")
    before = Window.partitionBy("__all").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranges.groupBy("__p")
        .agg(F.count(F.lit(1)).alias("__c"))
        .withColumn("__all", F.lit(1))  # one row per partition
        .select("__p", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__off"))
    )
    inside = Window.partitionBy("__p").orderBy(column)
    code = (F.col("__off") + F.row_number().over(inside) - 1).cast("long")
    codes = ranges.join(F.broadcast(offsets), "__p").select(column, code.alias(f"{column}_code"))
    return fitted_join(df, codes, [column], "label-encode")


def f_scores(df: DataFrame, target: str, task: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Univariate F per numeric feature: ANOVA across classes, or from the correlation with the target."""
    columns = list(columns or [c for c in columns_of_kind(df, NUMERIC) if c != target])
    rows = df.select(q(target).alias("__t"), *[present_number(df, c).alias(c) for c in columns])
    long = rows.unpivot(["__t"], [q(c) for c in columns], "column_name", "v").filter(F.col("v").isNotNull())
    v = F.col("v")
    if task == "classification":
        per = long.groupBy("column_name", "__t").agg(
            F.count(v).alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("s2")
        )
        tot = per.groupBy("column_name").agg(
            F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"),
            F.sum(F.col("n") * F.col("s2")).alias("ssw"),
        )
        between = per.join(F.broadcast(tot.select("column_name", "grand")), "column_name").groupBy("column_name").agg(
            F.sum(F.col("n") * (F.col("m") - F.col("grand")) * (F.col("m") - F.col("grand"))).alias("ssb")
        )
        score = F.try_divide(F.try_divide(F.col("ssb"), F.col("k") - 1), F.try_divide(F.col("ssw"), F.col("total") - F.col("k")))
        return tot.join(F.broadcast(between), "column_name").select("column_name", score.alias("f_score"))
    if task != "regression":
        raise ValueError(f"unknown task {task!r}")
    per = long.groupBy("column_name").agg(F.count(v).alias("n"), F.corr(v, F.col("__t").cast("double")).alias("r"))
    r2 = F.col("r") * F.col("r")
    return per.select("column_name", F.try_divide(r2 * (F.col("n") - 2), 1 - r2).alias("f_score"))


def estimated_width(df: DataFrame, exclude: Sequence[str] = ()) -> int:
    """Encoded feature count: one per number, up to 20 per text column."""
    text = [c for c in columns_of_kind(df, TEXT) if c not in exclude]
    width = len([c for c in columns_of_kind(df, NUMERIC) if c not in exclude])
    if text:
        wide = df.agg(*[F.least(F.approx_count_distinct(q(c)), F.lit(20)).alias(f"__{i}") for i, c in enumerate(text)])
        width += sum(wide.first())
    return width


def select_k_best(df: DataFrame, target: str, k: int, task: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Features ranked by F with the best ``k`` (at most the estimated encoded width) marked."""
    k = min(k, estimated_width(df, [target]))
    scored = f_scores(df, target, task, columns).withColumn("__s", F.coalesce("f_score", F.lit(-1.0)))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("__s")).alias("s"), "column_name", "f_score")))
    ranked = scored.agg(listed.alias("l")).select(F.posexplode("l").alias("rank", "e"))
    return ranked.select(
        "e.column_name", "e.f_score", (F.col("rank") + 1).alias("rank"), (F.col("rank") < k).alias("selected")
    )


SPARE = 10
POWER_STEPS = 4
TILE = 256


def _summed(parts: DataFrame) -> np.ndarray:
    """Partial tiles (t, s) of the tasks, added by Spark and put together."""

    def added(key, tile):
        total = np.sum([np.frombuffer(s) for s in tile["s"].to_pylist()], axis=0)
        return pa.table({"t": pa.array([key[0].as_py()], pa.int64()), "s": pa.array([total.tobytes()], pa.binary())})

    rows = parts.groupBy("t").applyInArrow(added, "t long, s binary").collect()
    return np.concatenate([np.frombuffer(r["s"]) for r in sorted(rows, key=lambda r: r["t"])])


def _tiled(matrix: np.ndarray) -> pa.RecordBatch:
    starts = list(range(0, len(matrix), TILE))
    return pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array([matrix[t : t + TILE].tobytes() for t in starts], pa.binary())], ["t", "s"])


def principal_components(data: DataFrame, vector: str, n: int, width: int, k: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components, variances) of a vector column of ``n`` rows by a randomised range finder.

    The rows stay where they are. Each power step multiplies them by a width x (k + spare) matrix and adds the products up
    in tiles of the width; only such tall matrices reach the driver, never one of width x width.
    """
    vectors = data.select(F.col(vector).alias("v"))

    def sums(batches):
        total = np.zeros(width)
        for b in batches:
            _, places, numbers = sparse_rows(b["v"])
            total += np.bincount(places.astype(np.int64), numbers, width)
        yield _tiled(total)

    mean = _summed(vectors.mapInArrow(sums, "t long, s binary")) / n

    def step(basis: np.ndarray) -> np.ndarray:
        """Centred rows, transposed, times centred rows, times ``basis``."""
        held = data.sparkSession.sparkContext.broadcast((basis, mean @ basis, mean))

        def products(batches):
            basis, shift, centre = held.value
            out, total = np.zeros(basis.shape), np.zeros(basis.shape[1])
            for b in batches:
                rows, places, numbers = sparse_rows(b["v"])
                rows, places = rows.astype(np.int64), places.astype(np.int64)
                for c in range(basis.shape[1]):
                    y = np.bincount(rows, numbers * basis[places, c], b.num_rows) - shift[c]
                    out[:, c] += np.bincount(places, numbers * y[rows], width)
                    total[c] += y.sum()
            yield _tiled(out - np.outer(centre, total))

        return _summed(vectors.mapInArrow(products, "t long, s binary")).reshape(width, -1)

    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, min(width, k + SPARE))))[0]
    for _ in range(POWER_STEPS):
        basis = np.linalg.qr(step(basis))[0]
    values, axes = np.linalg.eigh(basis.T @ step(basis))
    order = np.argsort(values)[::-1][:k]
    components = basis @ axes[:, order]
    components = components * np.sign(components[np.abs(components).argmax(axis=0), np.arange(components.shape[1])])
    return mean, components, np.maximum(values[order], 0.0) / max(1, n - 1)


def _packed(matrix: np.ndarray) -> pa.Array:
    """Rows of numbers as binary cells."""
    flat = np.ascontiguousarray(matrix, dtype=float)
    offsets = np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1] * 8
    return pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat.tobytes())])


def _unpacked(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist())).reshape(-1, width)


def _spots(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and number of the frequent slots of a batch."""
    lengths = batch["__f"].value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(batch.num_rows), lengths), batch["__f"].flatten().to_numpy(zero_copy_only=False), batch["__x"].flatten().to_numpy(zero_copy_only=False)


def _spread(rows: np.ndarray, places: np.ndarray, numbers: np.ndarray, table: np.ndarray, n: int) -> np.ndarray:
    """A sparse matrix of ``n`` rows times a dense table."""
    return np.stack([np.bincount(rows, numbers * table[places, c], n) for c in range(table.shape[1])], axis=1)


HELD_CELLS = 1 << 22
FREQUENT_SLOTS = 1024


def wide_scores(data: DataFrame, vector: str, n: int, k: int, output: str, frequent: int = FREQUENT_SLOTS, seed: int = 42) -> DataFrame:
    """``data`` with its ``k`` principal component scores as an array, for vectors so wide that no matrix as tall as they are fits a driver.

    The same subspace iteration from the side of the rows: each row keeps its entries of the basis, and a step multiplies them by
    the centred rows and their transpose. Slots that only one row fills come down to one number of that row. The ``frequent``
    most common of the others meet in a table of bounded size; the rest meet by joins on the slot. The largest entry of a component
    among the frequent slots is positive.
    """
    spark, names, width = data.sparkSession, data.columns, min(n, k + SPARE)
    rows = materialize(data.withColumn("__row", F.monotonically_increasing_id()), "wide-rows")
    cells = vector_cells(rows.select("__row", vector), "__row", vector).filter("x <> 0")
    common = materialize(cells.groupBy("i").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "wide-slots")
    top = common.orderBy(F.desc("c"), "i").limit(frequent)
    slots = np.array(sorted(r["i"] for r in top.collect()), dtype=np.int64)  # at most `frequent`
    others = None
    if common.count() > len(slots):
        rest = common.join(F.broadcast(spark.createDataFrame([(int(i),) for i in slots], "i long")), "i", "left_anti")
        others = materialize(salted_join(cells, rest.select("i"), ["i"], "inner").select(F.col("__row"), "i", "x"), "wide-cells")

    def begun(batches):
        for b in batches:
            if not b.num_rows:
                continue
            r, place, x = sparse_rows(b[vector])
            r, place = r.astype(np.int64), place.astype(np.int64)
            at = np.minimum(np.searchsorted(slots, place), max(len(slots) - 1, 0))
            hit = (slots[at] == place) if len(slots) else np.zeros(len(place), bool)
            order = np.flatnonzero(hit & (x != 0))
            counts = np.bincount(r[order], minlength=b.num_rows)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            own = np.bincount(r[~hit], x[~hit] ** 2, b.num_rows)
            first = np.random.default_rng([seed, b["__row"][0].as_py()]).normal(size=(b.num_rows, width))
            yield pa.RecordBatch.from_arrays(
                [b["__row"], pa.ListArray.from_arrays(offsets, pa.array(at[order], pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(x[order])), pa.array(own), pa.nulls(b.num_rows, pa.binary()), _packed(first)],
                ["__row", "__f", "__x", "__d", "__u", "__w"],
            )

    schema = "__row long, __f array<long>, __x array<double>, __d double, __u binary, __w binary"
    state = materialize(rows.select("__row", vector).mapInArrow(begun, schema), "wide-basis")

    def totals(state: DataFrame, last: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sums over rows: products w w and (at the last) u w, w itself, and the frequent slots with w and alone."""
        sizes = [width * width, width * width, width, len(slots) * width, len(slots)]

        def summed(batches):
            out = [np.zeros(s) for s in sizes]
            for b in batches:
                if not b.num_rows:
                    continue
                w = _unpacked(b["__w"], width)
                r, place, x = _spots(b)
                out[0] += (w.T @ w).ravel()
                if last:
                    out[1] += (_unpacked(b["__u"], width).T @ w).ravel()
                out[2] += w.sum(axis=0)
                if len(slots):
                    out[3] += np.stack([np.bincount(place, x * w[r, c], len(slots)) for c in range(width)], axis=1).ravel()
                    out[4] += np.bincount(place, x, len(slots))
            yield _tiled(np.concatenate(out))

        flat = np.split(_summed(state.drop("__row", "__d").mapInArrow(summed, "t long, s binary")), np.cumsum(sizes)[:-1])
        return flat[0].reshape(width, width), flat[1].reshape(width, width), flat[2], flat[3].reshape(-1, width), flat[4]

    def step(state: DataFrame, last: bool) -> tuple[DataFrame, np.ndarray]:
        """The basis w made orthonormal as u (written at the last), its product as the new w, and the frequent slots of the components."""
        gram, _, total, spots, alone = totals(state)
        shift = total / n
        values, axes = np.linalg.eigh(gram - n * np.outer(shift, shift))
        turn = axes * np.where(values > 1e-14 * max(values.max(), 1e-300), 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
        spots = (spots - np.outer(alone, shift)) @ turn
        held = spark.sparkContext.broadcast((shift, turn, spots))
        joined = state
        if others is not None:
            turned = state.select("__row", "__w").mapInArrow(_turned(held, width), ", ".join(["__row long", *[f"__b{j} double" for j in range(width)]]))
            met = materialize(others.join(turned, "__row"), "wide-met")
            sums = met.groupBy("i").agg(*[F.sum(F.col("x") * F.col(f"__b{j}")).alias(f"__s{j}") for j in range(width)])
            back = salted_join(met, sums, ["i"], "inner")  # what the other rows of a slot give
            gained = [F.sum(F.col("x") * (F.col(f"__s{j}") - F.col("x") * F.col(f"__b{j}"))).alias(f"__g{j}") for j in range(width)]
            gained = back.groupBy("__row").agg(*gained).select("__row", F.array(*[f"__g{j}" for j in range(width)]).alias("__gain"))
            joined = state.join(gained, "__row", "left")

        def multiplied(batches):
            shift, turn, spots = held.value
            for b in batches:
                if not b.num_rows:
                    continue
                u = (_unpacked(b["__w"], width) - shift) @ turn
                w = b["__d"].to_numpy()[:, None] * u
                if len(slots):
                    w += _spread(*_spots(b), spots, b.num_rows)
                if "__gain" in b.schema.names:
                    some = b["__gain"].is_valid().to_numpy(zero_copy_only=False)
                    w[some] += b["__gain"].drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                yield pa.RecordBatch.from_arrays([b["__row"], b["__f"], b["__x"], b["__d"], _packed(u) if last else pa.nulls(b.num_rows, pa.binary()), _packed(w)], ["__row", "__f", "__x", "__d", "__u", "__w"])

        return materialize(joined.mapInArrow(multiplied, schema), "wide-basis"), spots

    spots = np.zeros((0, width))
    for i in range(POWER_STEPS + 1):
        state, spots = step(state, i == POWER_STEPS)
    _, cross, total, _, _ = totals(state, last=True)
    shift = total / n
    values, axes = np.linalg.eigh((cross + cross.T) / 2)
    order = np.argsort(values)[::-1][:k]
    values, axes = values[order], axes[:, order]
    signs = np.ones(len(order))
    if len(slots):
        largest = spots @ axes
        signs = np.sign(largest[np.abs(largest).argmax(axis=0), np.arange(len(order))])
        signs[signs == 0] = 1.0
    turn = axes * signs * np.where(values > 1e-14 * max(values.max(), 1e-300), 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
    held = spark.sparkContext.broadcast((shift, turn))

    def scored(batches):
        shift, turn = held.value
        for b in batches:
            if b.num_rows:
                y = (_unpacked(b["__w"], width) - shift) @ turn
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * turn.shape[1], pa.int32()), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([b["__row"], lists], ["__row", "__scores"])

    scores = state.select("__row", "__w").mapInArrow(scored, "__row long, __scores array<double>")
    return rows.join(scores, "__row").select(*[q(c) for c in names], F.col("__scores").alias(output))


def _turned(held, width: int):
    def rows(batches):
        shift, turn, _ = held.value
        for b in batches:
            if b.num_rows:
                u = (_unpacked(b["__w"], width) - shift) @ turn
                yield pa.RecordBatch.from_arrays([b["__row"], *[pa.array(u[:, j]) for j in range(width)]], ["__row", *[f"__b{j}" for j in range(width)]])

    return rows


def pca_reduce(df: DataFrame, features: str = "features", components: int = 50, output: str = "pca", held_cells: int = HELD_CELLS) -> DataFrame:
    """Principal components of a vector or array column, centred: min(components, width, n - 1).

    A basis of more than ``held_cells`` numbers stays with the rows (:func:`wide_scores`).
    """
    from pyspark.ml.functions import array_to_vector

    is_array = df.schema[features].dataType.typeName() == "array"
    data = df.withColumn("__v", array_to_vector(F.transform(features, lambda x: x.cast("double"))) if is_array else F.col(features))
    width = data.select("__v").first()[0].size
    n = data.count()
    k = min(components, width, max(1, n - 1))
    if width * (k + SPARE) > held_cells:
        return wide_scores(data, "__v", n, k, "__pca").withColumn(output, array_to_vector("__pca")).drop("__v", "__pca")
    mean, axes, _ = principal_components(data, "__v", n, width, k)
    held = df.sparkSession.sparkContext.broadcast((axes, mean @ axes))
    names = data.columns

    def project(batches):
        axes, shift = held.value
        for b in batches:
            if not b.num_rows:
                continue
            rows, places, numbers = sparse_rows(b["__v"])
            rows, places = rows.astype(np.int64), places.astype(np.int64)
            y = np.stack([np.bincount(rows, numbers * axes[places, c], b.num_rows) for c in range(axes.shape[1])], axis=1) - shift
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * axes.shape[1], pa.int32()), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], [*names, "__pca"])

    schema = T.StructType([*data.schema.fields, T.StructField("__pca", T.ArrayType(T.DoubleType()))])
    return data.mapInArrow(project, schema).withColumn(output, array_to_vector("__pca")).drop("__v", "__pca")


def log_transform_target(df: DataFrame, target: str, output: str | None = None) -> DataFrame:
    """log(1 + y)."""
    return df.withColumn(output or f"{target}_log", F.log1p(q(target)))


def default_test_size(n: int) -> float:
    """A fifth, or more than that share only as far as ten rows need: min(0.2, max(0.1, 10/n))."""
    return min(0.2, max(0.1, 10 / n)) if n else 0.2


HASH_BUCKETS = 1_000_003


def split_random(
    df: DataFrame, key: Sequence[str], test_size: float | None = None, seed: int = 42, stratify: str | None = None,
    order: Column | None = None,
) -> DataFrame:
    """Adds ``is_test`` from a seeded hash of the key (``order`` replaces the hash).

    Stratified: per class, the rows whose hash lies below the class's own quantile of hashes, which
    needs no ordering of a class.
    """
    size = test_size if test_size is not None else default_test_size(df.count())
    mixed = order if order is not None else F.xxhash64(*key, F.lit(seed))
    h = F.pmod(mixed, F.lit(HASH_BUCKETS))
    if stratify is None:
        return df.withColumn("is_test", h < int(size * HASH_BUCKETS))
    rows = df.withColumn("__h", mixed.cast("double"))
    cuts = exact_quantiles(rows, [stratify], "__h", {"cut": size}).select(stratify, "cut")
    return salted_join(rows, cuts, [stratify], "left").withColumn("is_test", F.coalesce(F.col("__h") < F.col("cut"), F.lit(False))).drop("__h", "cut")


def split_temporal(df: DataFrame, keys: Sequence[str], ts: str = "ts", test_size: float = 0.2) -> DataFrame:
    """Adds ``is_test``: the first floor((1 - test_size) n) rows of each series train, the later ones test."""
    rows = with_position(df, keys, ts)
    return rows.withColumn("is_test", F.col("pos") >= F.floor(F.col("n") * F.lit(1 - test_size))).drop("pos", "n")


def check_class_counts(df: DataFrame, target: str) -> DataFrame:
    """Smallest class, whether stratification holds (>= 5 rows, n >= 100), and the verdict."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("c"))
    out = counts.agg(F.count(F.lit(1)).alias("n_classes"), F.min("c").alias("smallest_class"), F.sum("c").alias("n_rows"))
    verdict = (
        F.when(F.col("smallest_class") < 2, "error")
        .when((F.col("n_rows") < 200) & (F.col("smallest_class") < 10), "warning")
        .otherwise("ok")
    )
    return out.withColumn("stratify", (F.col("smallest_class") >= 5) & (F.col("n_rows") >= 100)).withColumn("verdict", verdict)
