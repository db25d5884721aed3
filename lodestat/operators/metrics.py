"""Evaluation metrics as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.functions.columns import q
from lodestat.plans.blocks import block_pairs
from lodestat.plans.skew import join_on, salted_join, with_frames, with_position
from lodestat.session import materialize


def confusion(df: DataFrame, y: str = "y", p: str = "p", keys: Sequence[str] = ()) -> DataFrame:
    """Counts per (true, predicted) class."""
    return df.groupBy(*keys, F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def accuracy(df: DataFrame, y: str = "y", p: str = "p", keys: Sequence[str] = ()) -> DataFrame:
    """Share of equal labels."""
    return df.groupBy(*keys).agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"))


def class_scores(df: DataFrame, y: str = "y", p: str = "p", keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, f1 and support per class; 0 when undefined."""
    return class_scores_of(confusion(df, y, p, keys), keys)


def class_scores_of(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """As :func:`class_scores`, from the counts of :func:`confusion`."""
    sides = cells.select(
        *keys,
        F.inline(
            F.array(
                F.struct(
                    F.col("y").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                    F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit"),
                ),
                F.struct(
                    F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                    F.lit(0).cast("long").alias("hit"),
                ),
            )
        ),
    )
    per = sides.groupBy(*keys, "label").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit")
    )
    zero = F.lit(0.0)
    per = per.withColumn("precision", F.coalesce(F.try_divide("hit", "predicted"), zero)).withColumn(
        "recall", F.coalesce(F.try_divide("hit", "support"), zero)
    )
    both = F.col("precision") + F.col("recall")
    return per.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(zero))


def classification_metrics(df: DataFrame, y: str = "y", p: str = "p", keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy and support-weighted precision, recall and f1."""
    return classification_metrics_of(confusion(df, y, p, keys), keys)


def classification_metrics_of(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """As :func:`classification_metrics`, from the counts of :func:`confusion`."""
    n = F.sum("support")
    weighted = [(F.sum(F.col(m) * F.col("support")) / n).alias(m) for m in ("precision", "recall", "f1")]
    return class_scores_of(cells, keys).groupBy(*keys).agg((F.sum("hit") / n).alias("accuracy"), *weighted)


def row_errors(y: Column, p: Column) -> dict[str, Column]:
    """What each regression metric averages; null where a row does not count."""
    size = (F.abs(y) + F.abs(p)) / 2
    return {
        "mae": F.abs(y - p),
        "rmse": (y - p) * (y - p),
        "mape": F.when(y != 0, F.abs((y - p) / y)),
        "smape": F.when(size != 0, F.abs(p - y) / size),
    }


def of_mean_error(name: str, mean: Column) -> Column:
    """The regression metric of the mean of its row errors."""
    return {"mae": mean, "rmse": F.sqrt(mean), "mape": mean * 100, "smape": mean * 100}[name]


def _error_terms(y: Column, p: Column) -> dict[str, Column]:
    return {name: of_mean_error(name, F.avg(e)) for name, e in row_errors(y, p).items()}


def regression_metrics(df: DataFrame, y: str = "y", p: str = "p", keys: Sequence[str] = ()) -> DataFrame:
    """rmse, mae, mape (a != 0) and smape (denominator != 0)."""
    terms = _error_terms(F.col(y), F.col(p))
    return df.groupBy(*keys).agg(*[e.alias(name) for name, e in terms.items()])


def evaluate_forecast(
    df: DataFrame, keys: Sequence[str], ts: str = "ts", a: str = "a", f: str = "f", period: int = 1,
    train: DataFrame | None = None,
) -> DataFrame:
    """mae, rmse, mape, smape, mase and directional accuracy per series.

    The scale of mase is the seasonal-naive error of the evaluated actuals, or of ``train`` when given
    (columns keys, ts, a). With no more points than the period, mase is the mae; a zero scale counts as 1.
    """
    keys = list(keys)
    rows = with_position(df, keys, ts)
    shifted = with_frames(
        rows,
        keys,
        {
            "__a1": lambda w: F.lag(a, 1).over(w),
            "__f1": lambda w: F.lag(f, 1).over(w),
            "__as": lambda w: F.lag(a, period).over(w),
        },
        before=max(1, period),
    )
    step = (F.col(a) - F.col("__a1")) * (F.col(f) - F.col("__f1")) > 0
    out = shifted.groupBy(*keys).agg(
        *[e.alias(name) for name, e in _error_terms(F.col(a), F.col(f)).items()],
        F.avg(F.abs(F.col(a) - F.col("__as"))).alias("__scale"),
        (F.avg(F.when(F.col("__a1").isNotNull(), step.cast("double"))) * 100).alias("directional_accuracy"),
    )
    if train is not None:
        base = with_frames(
            with_position(train, keys, ts), keys, {"__as": lambda w: F.lag(a, period).over(w)}, before=period
        )
        scale = base.groupBy(*keys).agg(F.avg(F.abs(F.col(a) - F.col("__as"))).alias("__scale"))
        out = join_on(out.drop("__scale"), scale, keys, "left")
    safe = F.when(F.col("__scale") == 0, F.lit(1.0)).otherwise(F.col("__scale"))
    return out.withColumn("mase", F.when(F.col("__scale").isNull(), F.col("mae")).otherwise(F.col("mae") / safe)).drop(
        "__scale"
    )


def mase(df: DataFrame, keys: Sequence[str], period: int, **columns: str) -> DataFrame:
    return evaluate_forecast(df, keys, period=period, **columns).select(*keys, "mase")


def directional_accuracy(df: DataFrame, keys: Sequence[str], **columns: str) -> DataFrame:
    return evaluate_forecast(df, keys, **columns).select(*keys, "directional_accuracy")


def overfit_gap(train_scores: DataFrame, val_scores: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """Train and validation score of each model side by side."""
    return (
        train_scores.select(*keys, F.col(metric).alias("train_score"))
        .transform(lambda left: join_on(left, val_scores.select(*keys, F.col(metric).alias("val_score")), keys))
        .withColumn("gap", F.col("train_score") - F.col("val_score"))
    )


def cluster_moments(df: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """Per (label, dimension): n, sum and sum of squares. Combines before the shuffle."""
    return (
        df.select(F.col(label).alias("label"), F.posexplode(features).alias("i", "x"))
        .withColumn("x", F.col("x").cast("double"))
        .groupBy("label", "i")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"))
    )


def calinski_harabasz(df: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """Ratio of between- to within-cluster dispersion (1 when there is none within)."""
    m = cluster_moments(df, features, label)
    total = m.groupBy("i").agg(F.sum("n").alias("N"), F.sum("s").alias("S"), F.sum("ss").alias("SS"), F.count("label").alias("k"),
                               F.sum(F.col("s") * F.col("s") / F.col("n")).alias("C"))
    between = F.sum(F.col("C") - F.col("S") * F.col("S") / F.col("N"))
    within = F.sum(F.col("SS") - F.col("C"))
    out = total.agg(between.alias("b"), within.alias("w"), F.max("k").alias("k"), F.max("N").alias("n"))
    ratio = F.try_divide(F.try_divide(F.col("b"), F.col("k") - 1), F.try_divide(F.col("w"), F.col("n") - F.col("k")))
    return out.select("k", "n", F.when(F.col("w") == 0, F.lit(1.0)).otherwise(ratio).alias("calinski_harabasz"))


def centroids(df: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """(label, size, centroid array)."""
    m = cluster_moments(df, features, label).withColumn("c", F.col("s") / F.col("n"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "c")))
    return m.groupBy("label").agg(F.max("n").alias("size"), F.transform(ordered, lambda e: e["c"]).alias("centroid"))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two array columns."""
    return F.sqrt(squared_distance(a, b))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x.cast("double")
    )


CENTRES_PER_BLOCK = 512


def davies_bouldin(df: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """Mean over clusters of the worst (s_i + s_j) / d_ij.

    Cluster centres are packed into arrays of bounded length and matched on the pack number, so many
    clusters do not turn into a list of pairs.
    """
    cents = centroids(df, features, label)
    rows = salted_join(df.select(F.col(label).alias("label"), F.col(features).alias("__x")), cents, ["label"])
    spread = rows.groupBy("label").agg(
        F.avg(distance(F.col("__x"), F.col("centroid"))).alias("s"), F.first("centroid").alias("centroid")
    )
    packs = spread.agg(F.ceil(F.count(F.lit(1)) / CENTRES_PER_BLOCK).cast("int").alias("packs"))
    numbered = spread.crossJoin(F.broadcast(packs))  # one-row side
    right = (
        numbered.withColumn("pack", F.pmod(F.xxhash64("label"), F.col("packs")).cast("int"))
        .groupBy("pack")
        .agg(F.collect_list(F.struct("label", "s", "centroid")).alias("others"))
    )
    left = numbered.withColumn("pack", F.explode(F.sequence(F.lit(0), F.col("packs") - 1)))
    worst = F.array_max(
        F.transform(
            F.filter("others", lambda o: o["label"] != F.col("label")),
            lambda o: F.try_divide(F.col("s") + o["s"], distance(F.col("centroid"), o["centroid"])),
        )
    )
    per = left.join(right, "pack").groupBy("label").agg(F.max(worst).alias("r"))
    return per.agg(F.count(F.lit(1)).alias("k"), F.avg(F.coalesce("r", F.lit(0.0))).alias("davies_bouldin"))


CLUSTERS_AT_ONCE = 2048


def silhouette(
    df: DataFrame, features: str = "features", label: str = "label", id_col: str | None = None
) -> DataFrame:
    """Mean silhouette with squared Euclidean distance, linear in rows.

    The mean squared distance of a point to a cluster follows from the cluster's size, sum vector and
    sum of squared norms, so no pair of points is formed. The cluster table is broadcast while it has at
    most ``CLUSTERS_AT_ONCE`` rows; beyond that it is matched in packs of that size, and a row's packs are put
    together again by ``id_col`` (numbered and written first if not given).
    """
    m = cluster_moments(df, features, label)
    ordered = F.array_sort(F.collect_list(F.struct("i", "s")))
    stats = m.groupBy("label").agg(
        F.max("n").cast("double").alias("n"),
        F.transform(ordered, lambda e: e["s"]).alias("s"),
        F.sum("ss").alias("ss"),
    )
    packs = -(-stats.count() // CLUSTERS_AT_ONCE) or 1
    packed = (
        stats.withColumn("pack", F.pmod(F.xxhash64("label"), F.lit(packs)).cast("int"))
        .groupBy("pack")
        .agg(F.collect_list(F.struct("label", "n", "s", "ss")).alias("clusters"))
    )
    if packs > 1 and id_col is None:
        id_col, df = "__own", materialize(df.withColumn("__own", F.monotonically_increasing_id()), "silhouette-rows")
    ids = [F.col(id_col).alias("id")] if id_col else []
    rows = df.select(*ids, F.col(label).alias("label"), F.transform(features, lambda v: v.cast("double")).alias("__x"))
    if packs == 1:
        rows = rows.crossJoin(F.broadcast(packed.drop("pack")))
    else:
        rows = rows.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))))
        rows = salted_join(rows, packed, ["pack"], "inner")
    x = F.col("__x")

    def dot(s: Column) -> Column:
        return F.aggregate(F.zip_with(x, s, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)

    rows = rows.withColumn("__xx", F.aggregate("__x", F.lit(0.0), lambda acc, v: acc + v * v)).withColumn(
        "__d",
        F.transform(
            "clusters",
            lambda c: F.struct(
                c["label"].alias("label"),
                c["n"].alias("n"),
                (F.col("__xx") + c["ss"] / c["n"] - 2 * dot(c["s"]) / c["n"]).alias("d"),
            ),
        ),
    )
    own = F.element_at(F.filter("__d", lambda e: e["label"] == F.col("label")), 1)
    others = F.transform(F.filter("__d", lambda e: e["label"] != F.col("label")), lambda e: e["d"])
    if packs > 1:
        own = F.try_element_at(F.filter("__d", lambda e: e["label"] == F.col("label")), F.lit(1))
    out = rows.select(
        *(["id"] if id_col else []), own["n"].alias("n"), own["d"].alias("own"), F.array_min(others).alias("b")
    )
    if packs > 1:
        out = out.groupBy("id").agg(F.max("n").alias("n"), F.max("own").alias("own"), F.min("b").alias("b"))
    return _silhouette_mean(out)


def _silhouette_mean(rows: DataFrame) -> DataFrame:
    """From own-cluster size, mean distance to the own cluster (self included) and to the nearest other."""
    a = F.col("own") * F.col("n") / (F.col("n") - 1)
    s = F.when(F.col("n") <= 1, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("b") - a, F.greatest(a, F.col("b"))), F.lit(0.0))
    )
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(s).alias("silhouette"))


TILE_ROWS = 256


def silhouette_euclidean(
    df: DataFrame, id_col: str, features: str = "features", label: str = "label", noise: object = None
) -> DataFrame:
    """Exact mean silhouette with Euclidean distance, in blocks; rows labelled ``noise`` are left out.

    The work is quadratic by definition; use :func:`silhouette` when that is too much.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(features).alias("x"), F.col(label).cast("string").alias("label"))
    if noise is not None:
        rows = rows.filter(F.col("label") != F.lit(str(noise)))

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        xa, xb = np.stack(a["x"].to_numpy()).astype(float), np.stack(b["x"].to_numpy()).astype(float)
        ids, squares, parts = b["id"].to_numpy()[None, :], (xb**2).sum(1)[None, :], []
        masks = {name: (b["label"] == name).to_numpy() for name in b["label"].unique()}
        for i in range(0, len(xa), TILE_ROWS):
            part, x = a.iloc[i : i + TILE_ROWS], xa[i : i + TILE_ROWS]
            d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + squares - 2 * x @ xb.T, 0))
            d[part["id"].to_numpy()[:, None] == ids] = 0.0
            parts += [pd.DataFrame({"id": part["id"], "label": part["label"], "other": name, "d": d[:, mask].sum(1)}) for name, mask in masks.items()]
        return pd.concat(parts)

    id_type = rows.schema["id"].dataType.simpleString()
    partial = block_pairs(rows, rows, "id", "id", sums, f"id {id_type}, label string, other string, d double")
    sizes = rows.groupBy(F.col("label").alias("other")).agg(F.count(F.lit(1)).alias("n"))
    means = (
        partial.groupBy("id", "label", "other").agg(F.sum("d").alias("d")).join(sizes, "other").withColumn("m", F.col("d") / F.col("n"))
    )
    same = F.col("other") == F.col("label")
    return _silhouette_mean(
        means.groupBy("id").agg(
            F.max(F.when(same, F.col("n"))).alias("n"),
            F.max(F.when(same, F.col("m"))).alias("own"),
            F.min(F.when(~same, F.col("m"))).alias("b"),
        )
    )


def sweep_scores(
    labelled: DataFrame, by: str, id_col: str, features: str = "features", label: str = "label", weight: str | None = None
) -> DataFrame:
    """All three scores of several clusterings of the same rows in one pass: (by, k, silhouette, calinski_harabasz, davies_bouldin).

    ``labelled`` has a row for each clustering (column ``by``) and point; a row counts ``weight`` times. The silhouette is the squared-Euclidean one. Cluster tables
    travel in packs of at most ``CLUSTERS_AT_ONCE`` clusters; a point's packs are put together again by ``id_col``.
    """
    rows = labelled.select(
        q(by).alias("by"), q(id_col).alias("id"), q(label).alias("label"), F.transform(q(features), lambda v: v.cast("double")).alias("x"),
        (F.lit(1) if weight is None else q(weight)).cast("long").alias("w"),
    )
    cells = rows.select("by", "label", "w", F.posexplode("x").alias("i", "v")).groupBy("by", "label", "i")
    w, v = F.col("w"), F.col("v")
    cells = materialize(cells.agg(F.sum("w").alias("n"), F.sum(w * v).alias("s"), F.sum(w * v * v).alias("ss")), "sweep-moments")
    whole = cells.groupBy("by", "i").agg(
        F.sum("n").alias("N"), F.sum("s").alias("S"), F.sum("ss").alias("SS"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("C"),
        F.count(F.lit(1)).alias("k"),
    )
    spread = whole.groupBy("by").agg(
        F.sum(F.col("C") - F.col("S") * F.col("S") / F.col("N")).alias("b"), F.sum(F.col("SS") - F.col("C")).alias("w"),
        F.max("k").alias("k"), F.max("N").alias("n"),
    )
    ratio = F.try_divide(F.try_divide(F.col("b"), F.col("k") - 1), F.try_divide(F.col("w"), F.col("n") - F.col("k")))
    spread = spread.select("by", "k", F.when(F.col("w") == 0, F.lit(1.0)).otherwise(ratio).alias("calinski_harabasz"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "s")))
    stats = cells.groupBy("by", "label").agg(
        F.max("n").cast("double").alias("n"), F.transform(ordered, lambda e: e["s"]).alias("s"), F.sum("ss").alias("ss")
    )
    most = stats.groupBy("by").agg(F.count(F.lit(1)).alias("k")).agg(F.max("k")).first()[0] or 0
    packs = -(-most // CLUSTERS_AT_ONCE) or 1
    packed = stats.withColumn("pack", F.pmod(F.xxhash64("label"), F.lit(packs)).cast("int"))
    packed = packed.groupBy("by", "pack").agg(F.collect_list(F.struct("label", "n", "s", "ss")).alias("clusters"))
    spread_rows = rows.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))))
    joined = salted_join(spread_rows, packed, ["by", "pack"], "inner")
    x = F.col("x")

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda acc, v: acc + v)

    joined = joined.withColumn("xx", dot(x, x)).withColumn(
        "d",
        F.transform(
            "clusters",
            lambda c: F.struct(
                c["label"].alias("label"), c["n"].alias("n"),
                (F.col("xx") + c["ss"] / c["n"] - 2 * dot(x, c["s"]) / c["n"]).alias("d"),
                F.when(c["label"] == F.col("label"), distance(x, F.transform(c["s"], lambda v: v / c["n"]))).alias("to_centre"),
            ),
        ),
    )
    own = F.try_element_at(F.filter("d", lambda e: e["label"] == F.col("label")), F.lit(1))
    other = F.array_min(F.transform(F.filter("d", lambda e: e["label"] != F.col("label")), lambda e: e["d"]))
    per = joined.select("by", "id", "label", "w", own["n"].alias("n"), own["d"].alias("own"), own["to_centre"].alias("to_centre"), other.alias("b"))
    if packs > 1:
        per = per.groupBy("by", "id", "label").agg(*[F.max(c).alias(c) for c in ("w", "n", "own", "to_centre")], F.min("b").alias("b"))
    a = F.col("own") * F.col("n") / (F.col("n") - 1)
    s = F.when(F.col("n") <= 1, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.col("b") - a, F.greatest(a, F.col("b"))), F.lit(0.0)))
    scatter = F.sum(w * F.col("to_centre")) / F.sum(F.when(F.col("to_centre").isNotNull(), w))
    scored = materialize(per.groupBy("by", "label").agg(F.sum(w * s).alias("sil"), F.sum("w").alias("n"), scatter.alias("scatter")), "sweep-scores")
    centres = stats.join(scored.select("by", "label", "scatter"), ["by", "label"])
    centres = centres.select("by", "label", "scatter", F.transform("s", lambda v: v / F.col("n")).alias("centre"))
    right = centres.withColumn("pack", F.pmod(F.xxhash64("label"), F.lit(packs)).cast("int"))
    right = right.groupBy("by", "pack").agg(F.collect_list(F.struct("label", "scatter", "centre")).alias("others"))
    left = centres.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))))
    worst = F.array_max(
        F.transform(
            F.filter("others", lambda o: o["label"] != F.col("label")),
            lambda o: F.try_divide(F.col("scatter") + o["scatter"], distance(F.col("centre"), o["centre"])),
        )
    )
    pairs = left.join(right, ["by", "pack"]).groupBy("by", "label").agg(F.max(worst).alias("r"))
    bouldin = pairs.groupBy("by").agg(F.avg(F.coalesce("r", F.lit(0.0))).alias("davies_bouldin"))
    means = scored.groupBy("by").agg((F.sum("sil") / F.sum("n")).alias("silhouette"))
    return means.join(spread, "by").join(bouldin, "by").select(F.col("by").alias(by), "k", "silhouette", "calinski_harabasz", "davies_bouldin")
