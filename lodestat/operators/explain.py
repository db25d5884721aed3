"""Explanations of fitted models and forecasts as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.operators import metrics as M
from lodestat.operators.forecast import additive_components, additive_fits, arima_fits, ets_fits, forecast_sma
from lodestat.operators.features import split_temporal
from lodestat.operators.series import decomposition_strength, stability
from lodestat.plans.skew import join_on, with_position
from lodestat.session import materialize
from lodestat.sources.tables import metric_sign


def explain_sample(df: DataFrame, key: Sequence[str], n: int = 1000, seed: int = 42, order: Column | None = None) -> DataFrame:
    """``n`` rows in seeded hash order (``order`` replaces the hash)."""
    return df.orderBy(order if order is not None else F.xxhash64(*key, F.lit(seed)), *key).limit(n)


def _long(df: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    return df.select(id_col, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([id_col], list(columns), "feature", "x")


def linear_attribution(df: DataFrame, weights: DataFrame, id_col: str) -> DataFrame:
    """phi = w * (x - mean x) per row and feature; ``weights`` has one row (feature, weight) per column."""
    columns = [r["feature"] for r in weights.select("feature").collect()]
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns]).unpivot([], columns, "feature", "mean")
    fitted = weights.join(means, "feature")
    return _long(df, id_col, columns).join(F.broadcast(fitted), "feature").select(  # one row per feature
        id_col, "feature", (F.col("weight") * (F.col("x") - F.col("mean"))).alias("phi")
    )


def mean_abs(phi: DataFrame) -> DataFrame:
    """Importance of a feature: mean |phi|."""
    return phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("importance"))


def _predict(model: Model, rows: DataFrame, features: str = "features") -> DataFrame:
    """Rows with ``f``: probability of the last class when the model has one, else the prediction."""
    scored = model.transform(rows.withColumn("features", array_to_vector(features)) if features != "features" else rows)
    if "probability" in scored.columns:
        p = vector_to_array("probability")
        return scored.withColumn("f", F.element_at(p, -1))
    return scored.withColumn("f", F.col("prediction"))


def shapley_sampling(
    model: Model, rows: DataFrame, background: DataFrame, id_col: str, permutations: int = 8, seed: int = 42
) -> DataFrame:
    """Sampled Shapley values (Strumbelj and Kononenko 2014): rows (id, feature index, phi, base).

    Per row and permutation, features switch one by one from a background row to the explained row in
    hash order; consecutive differences of the prediction are the contributions. Their sum is the
    prediction minus ``base``, the mean prediction of the background rows used.
    """
    x = rows.select(F.col(id_col).alias("id"), vector_to_array("features").alias("x"))
    held = background.select(F.col(id_col).alias("bid"), vector_to_array("features").alias("z"))
    held = materialize(held, "shapley-background")
    size = held.count()
    numbered = with_position(held, [], "bid", name="slot").drop("n")
    width = len(held.first()["z"])
    work = x.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    work = work.withColumn("slot", F.pmod(F.xxhash64("id", "perm", F.lit(seed)), F.lit(size)))
    work = work.join(numbered, "slot")
    hashes = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.struct(F.xxhash64("id", "perm", j, F.lit(seed + 1)).alias("h"), j.alias("j")))
    order = F.transform(F.array_sort(hashes), lambda e: e["j"])
    work = work.withColumn("order", order).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(width))))
    mixed = F.transform("x", lambda v, j: F.when(F.array_position("order", j) <= F.col("step"), v).otherwise(F.element_at("z", j + 1)))
    cases = work.select("id", "perm", "step", F.element_at("order", F.greatest("step", F.lit(1))).alias("feature"), mixed.alias("__m"))
    scored = _predict(model, cases, "__m").select("id", "perm", "step", "feature", "f")
    by_case = Window.partitionBy("id", "perm").orderBy("step")
    changes = scored.withColumn("d", F.col("f") - F.lag("f").over(by_case))
    base = scored.filter(F.col("step") == 0).groupBy("id").agg(F.avg("f").alias("base"))
    phi = changes.filter(F.col("step") > 0).groupBy("id", "feature").agg(F.avg("d").alias("phi"))
    return phi.join(base, "id")


def permutation_importance(model: Model, rows: DataFrame, id_col: str, task: str, metric: str, seed: int = 42) -> DataFrame:
    """Loss of the metric when one feature's values are exchanged between rows.

    Rows are paired by two hash orders, which permutes the values without moving them through one place. A row is
    scored again only for the slots in which its partner differs, so sparse rows cost their filled slots, not the
    width: the metric of a feature is that of all rows, less what the changed rows gave before, plus what they give now.
    """
    sign = metric_sign(metric)
    base = materialize(rows.select(F.col(id_col).alias("id"), "label", "features"), "importance-rows")
    here = with_position(base.withColumn("__h", F.xxhash64("id", F.lit(seed))), [], "__h").drop("n", "__h")
    there = with_position(base.select(F.xxhash64("id", F.lit(seed + 1)).alias("__h"), F.col("features").alias("z")), [], "__h").drop("n", "__h")
    width = base.first()["features"].size
    paired = model.transform(here.join(there, "pos")).select("label", F.col("prediction").alias("before"), "features", "z")
    paired = materialize(paired, "importance-pairs")
    arrays = paired.select("label", "before", vector_to_array("features").alias("x"), vector_to_array("z").alias("z"))
    other = lambda j: F.get("z", j)
    slots = F.transform("x", lambda v, j: F.struct(j.alias("feature"), other(j).alias("v"), v.eqNullSafe(other(j)).alias("same")))
    cases = arrays.select("label", "before", "x", F.inline(F.filter(slots, lambda c: ~c["same"])))
    swapped = F.transform("x", lambda v, j: F.when(j == F.col("feature"), F.col("v")).otherwise(v))
    scored = model.transform(cases.select("label", "before", "feature", array_to_vector(swapped).alias("features")))
    scored = scored.select("feature", "label", "before", "prediction")
    features = F.explode(F.sequence(F.lit(-1), F.lit(width - 1))).alias("feature")
    combine = _class_importance if task == "classification" else _error_importance
    per = combine(paired, scored, features, metric)
    reference = per.filter(F.col("feature") == -1).select(F.col("score").alias("base_score"))
    return per.filter(F.col("feature") >= 0).crossJoin(F.broadcast(reference)).withColumn(  # one-row side
        "importance", (F.col("base_score") - F.col("score")) * sign
    )


def _class_importance(paired: DataFrame, scored: DataFrame, features: Column, metric: str) -> DataFrame:
    """(feature, score) from confusion counts; feature -1 is the unchanged table."""
    cells = M.confusion(paired, "label", "before").select("y", "p", "n", features)
    one = lambda p, n: F.struct(F.col("label").alias("y"), F.col(p).alias("p"), F.lit(n).cast("long").alias("n"))
    moved = scored.select("feature", F.inline(F.array(one("before", -1), one("prediction", 1)))).groupBy("feature", "y", "p").agg(F.sum("n").alias("n"))
    cells = cells.unionByName(moved).groupBy("feature", "y", "p").agg(F.sum("n").alias("n")).filter("n > 0")
    return M.classification_metrics_of(cells, ["feature"]).select("feature", F.col(metric).alias("score"))


def _error_importance(paired: DataFrame, scored: DataFrame, features: Column, metric: str) -> DataFrame:
    """(feature, score) from sums of row errors; feature -1 is the unchanged table."""
    label = F.col("label")
    before, after = (M.row_errors(label, F.col(p))[metric] for p in ("before", "prediction"))
    zero = F.lit(0.0)
    total = paired.agg(F.coalesce(F.sum(before), zero).alias("s"), F.count(before).alias("n")).select("s", "n", features)
    moved = scored.groupBy("feature").agg(
        (F.coalesce(F.sum(after), zero) - F.coalesce(F.sum(before), zero)).alias("s"), (F.count(after) - F.count(before)).alias("n")
    )
    sums = total.unionByName(moved.select("s", "n", "feature")).groupBy("feature").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return sums.select("feature", M.of_mean_error(metric, F.try_divide(F.greatest("s", zero), "n")).alias("score"))


def coefficient_effects(df: DataFrame, weights: DataFrame) -> DataFrame:
    """Coefficient, sign, magnitude against the spread of |coefficients|, and effect per data std."""
    columns = [r["feature"] for r in weights.select("feature").collect()]
    spread = df.agg(*[F.stddev_pop(F.col(c).cast("double")).alias(c) for c in columns]).unpivot([], columns, "feature", "std")
    size = F.abs("weight")
    unit = weights.agg(F.stddev_pop(size).alias("__u"))
    joined = weights.join(spread, "feature").crossJoin(F.broadcast(unit))  # one-row side
    magnitude = F.when(size > F.col("__u"), "high").when(size > F.col("__u") / 2, "medium").otherwise("low")
    return joined.select(
        "feature",
        F.col("weight").alias("coefficient"),
        size.alias("abs_coefficient"),
        F.when(F.col("weight") > 0, "positive").otherwise("negative").alias("direction"),
        magnitude.alias("magnitude"),
        (F.col("weight") * F.col("std")).alias("effect_per_std"),
    )


def top_features(importance: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` largest importances (ties by feature)."""
    return importance.orderBy(F.desc("importance"), "feature").limit(k)


def explain(model: Model, rows: DataFrame, id_col: str, task: str, metric: str = "f1", n: int = 1000, method: str | None = None) -> DataFrame:
    """(feature index, importance, method); ``n`` is the number of sampled rows that Shapley values are made for.

    Models with coefficients get the exact additive attribution over all rows; others sampled Shapley values, or
    permutation importance over all rows on request.
    """
    coefficients = getattr(model, "coefficients", None)
    if method is None:
        method = "additive" if coefficients is not None and getattr(model, "numClasses", 2) <= 2 else "shapley"
    if method == "additive":
        weights = [(i, float(w)) for i, w in enumerate(coefficients.toArray())]
        w = rows.sparkSession.createDataFrame(weights, "feature int, weight double")
        cells = rows.select(F.posexplode(vector_to_array("features")).alias("feature", "x"))
        means = cells.groupBy("feature").agg(F.avg("x").alias("mean"))
        fitted = w.join(means, "feature")
        out = cells.join(F.broadcast(fitted), "feature").groupBy("feature").agg(
            F.avg(F.abs(F.col("weight") * (F.col("x") - F.col("mean")))).alias("importance")
        )
    elif method == "shapley":
        sample = materialize(explain_sample(rows, [id_col], n), "explain-sample")
        out = mean_abs(shapley_sampling(model, sample, explain_sample(sample, [id_col], 100, 7), id_col, permutations=4))
    elif method == "permutation":
        out = permutation_importance(model, rows, id_col, task, metric).select("feature", "importance")
    else:
        raise ValueError(f"unknown method {method!r}")
    return out.select("feature", "importance", F.lit(method).alias("method"))


def component_contribution(
    df: DataFrame, keys: Sequence[str], seasonalities: Sequence[str] = ("yearly", "weekly"), ts: str = "ts", y: str = "y", fits: DataFrame | None = None
) -> DataFrame:
    """100 * std(component) / std(fitted value) of the additive model, per series and component."""
    keys = list(keys)
    fits = fits if fits is not None else materialize(additive_fits(df, keys, seasonalities, ts, y), "additive-fits")
    parts = additive_components(df.select(*keys, ts), fits, keys, seasonalities, ts)
    names = ["trend", *seasonalities]
    seasonal: Column = sum((F.col(s) for s in seasonalities), F.lit(0.0))
    wide = parts.withColumn("seasonal", seasonal).groupBy(*keys).agg(
        *[(100 * F.try_divide(F.stddev_samp(c), F.stddev_samp("yhat"))).alias(c) for c in [*names, "seasonal"]]
    )
    return wide.unpivot(keys, [*names, "seasonal"], "component", "contribution")


def residual_summary(df: DataFrame, keys: Sequence[str], test_size: float = 0.2, ts: str = "ts", y: str = "y") -> DataFrame:
    """Mean and std of the errors of the moving-average forecast on the last part of each series."""
    keys = list(keys)
    rows = df.filter(F.col(y).isNotNull()).select(*keys, F.col(ts).alias("ts"), F.col(y).alias("y"))
    parts = split_temporal(rows, keys, "ts", test_size)
    train, test = parts.filter(~F.col("is_test")).drop("is_test"), parts.filter("is_test").drop("is_test")
    level = forecast_sma(train, keys, 1).select(*keys, "yhat")
    e = F.col("y") - F.col("yhat")
    return join_on(test, level, keys).groupBy(*keys).agg(
        F.avg(e).alias("residual_mean"), F.stddev_samp(e).alias("residual_std"), F.count(e).alias("n")
    )


def model_parameters(df: DataFrame, keys: Sequence[str], ts: str = "ts", y: str = "y") -> DataFrame:
    """Fitted parameters per series: ARIMA order and weights, smoothing weights, trend change points."""
    keys = list(keys)
    arima = arima_fits(df, keys, ts=ts, y=y).select(*keys, F.struct("p", "d", "q", "aic", "bic", "constant", "ar", "ma").alias("arima"))
    ets = ets_fits(df, keys, ts=ts, y=y).select(
        *keys, F.struct("trend", "seasonal", "seasonal_periods", "alpha", "beta", "gamma", "aic").alias("smoothing")
    )
    additive = additive_fits(df, keys, ts=ts, y=y).select(*keys, F.struct("change_points", "sigma").alias("additive"))
    return join_on(join_on(arima, ets, keys, "left"), additive, keys, "left")


def explain_series(df: DataFrame, keys: Sequence[str], ts: str = "ts", y: str = "y", period: int = 12) -> DataFrame:
    """Per series: parameters, component contributions, residuals, decomposition strengths, reliability."""
    keys = list(keys)
    parts = component_contribution(df, keys, ts=ts, y=y).groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("component", "contribution")))).alias("contributions")
    )
    out = model_parameters(df, keys, ts, y)
    for part in (
        parts,
        residual_summary(df, keys, ts=ts, y=y).drop("n"),
        decomposition_strength(df, keys, ts, y, period),
        stability(df, keys, y),
    ):
        out = join_on(out, part, keys, "left")
    return out
