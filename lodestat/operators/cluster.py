"""Clustering: sweeps over MLlib models, exact density clustering, Ward merges, spectral clustering, profiles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml import clustering as MC
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions.columns import NUMERIC, columns_of_kind, present_number
from lodestat.operators import metrics as M
from lodestat.operators.encoding import WIDE_SLOTS, TextCodesModel
from lodestat.operators.ensemble import draws
from lodestat.operators.features import pca_reduce
from lodestat.operators.models import build_features, nearest
from lodestat.operators.profile import numeric_moments
from lodestat.plans.components import connected_components
from lodestat.plans.pivots import CELL_POINTS, Cells, cells_of, choose_pivots, close_pairs, least_of_rows, matrix, met, placed
from lodestat.plans.skew import join_on, salted_join, with_position
from lodestat.session import materialize

MAX_WIDTH = 50
RESULT_SCHEMA = "algorithm string, n_clusters int, silhouette double, calinski_harabasz double, davies_bouldin double, parameters string"


def cluster_vectors(df: DataFrame, id_col: str, exclude: Sequence[str] = ()) -> DataFrame:
    """(id, features): sparse vectors of all columns, imputed, scaled and one-hot encoded."""
    *stages, assembler = build_features(df, None, [id_col, *exclude]).getStages()
    rows = df
    for stage in Pipeline(stages=stages).fit(df).stages:
        if isinstance(stage, TextCodesModel) and sum(stage.sizes) > WIDE_SLOTS:
            dense = [c for c in assembler.getInputCols() if c not in stage.outputs]
            return stage.appended(rows, id_col, dense[0] if dense else None, "features")
        rows = stage.transform(rows)
    return assembler.transform(rows).select(id_col, "features")


def cluster_features(df: DataFrame, id_col: str, exclude: Sequence[str] = (), max_width: int = MAX_WIDTH) -> DataFrame:
    """(id, features array): imputed, scaled and one-hot encoded; principal components above ``max_width`` columns."""
    rows = materialize(cluster_vectors(df, id_col, exclude), "cluster-features")
    if rows.first()["features"].size > max_width:
        rows = pca_reduce(rows, "features", max_width, "pca").select(id_col, F.col("pca").alias("features"))
    return rows.select(id_col, vector_to_array("features").alias("features"))


def evaluate_clusters(assigned: DataFrame, algorithm: str, parameters: dict, noise: int | None = None) -> DataFrame:
    """One metrics row for rows with ``features`` and ``label``; ``noise`` rows are left out."""
    rows = assigned.filter(F.col("label") != noise) if noise is not None else assigned
    s, ch, db = M.silhouette(rows), M.calinski_harabasz(rows), M.davies_bouldin(rows)
    out = s.crossJoin(ch.drop("n")).crossJoin(db.drop("k"))  # one-row sides
    return out.select(
        F.lit(algorithm).alias("algorithm"), F.col("k").cast("int").alias("n_clusters"), "silhouette", "calinski_harabasz", "davies_bouldin",
        F.lit(str(sorted(parameters.items()))).alias("parameters"),
    )


SCORES = ("silhouette", "calinski_harabasz", "davies_bouldin")


FEW_POINTS = 4096


def merged_points(rows: DataFrame) -> DataFrame:
    """Equal rows as one point: (features, w), ``w`` rows each. A few points are kept in order, whatever the cluster."""
    pts = rows.groupBy(F.transform("features", lambda v: v.cast("double")).alias("features")).agg(F.count(F.lit(1)).alias("w"))
    pts = materialize(pts, "points")
    return pts if pts.count() > FEW_POINTS else pts.orderBy("features").coalesce(1)


def _sweep(labelled: DataFrame, id_col: str, algorithm: str, rows: DataFrame | None = None, digits: int = 17) -> tuple[DataFrame, DataFrame]:
    """Score the clusterings of ``labelled`` (id, features, k, label) in one pass and keep the best silhouette.

    Gives its assignment, and a row per k that found two clusters, with all three scores and ``is_best``. With ``rows``, ``labelled``
    has their merged points (features, w, k, label), and the rows get the labels of their points at the end.
    Silhouettes equal to ``digits`` decimals are ties, which go to the smallest k.
    """
    of = (id_col, None) if rows is None else ("features", "w")
    found = M.sweep_scores(labelled.withColumnRenamed("k", "asked"), "asked", of[0], weight=of[1]).filter("k >= 2").collect()  # one row a k
    if not found:
        raise ValueError(f"{algorithm} found no clustering with two clusters")
    best = min(found, key=lambda r: (-round(r["silhouette"], digits), r["asked"]))["asked"]
    scored = [(algorithm, int(r["asked"]), *(r[c] for c in SCORES), r["asked"] == best) for r in sorted(found, key=lambda r: r["asked"])]
    schema = "algorithm string, k int, " + ", ".join(f"{c} double" for c in SCORES) + ", is_best boolean"
    kept = labelled.filter(F.col("k") == best)
    if rows is not None:
        kept = _label_rows(rows, id_col, kept.select(F.col("k").alias("trial"), F.col("features").alias("x"), "w", "label"))
    kept = kept.select(id_col, "features", F.col("label").cast("int").alias("label"))
    return materialize(kept, f"{algorithm}-best"), labelled.sparkSession.createDataFrame(scored, schema)


def _by_k(rows: DataFrame, kept: Sequence[str], labels: dict[int, str]) -> DataFrame:
    """The columns ``kept``, k and label from one label column per k."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).cast("int").alias("label")) for k, c in labels.items()]))
    return rows.select(*kept, each.alias("e")).select(*kept, "e.k", "e.label")


def max_clusters(n: int, limit: int) -> int:
    """Largest k of a sweep: at most ``limit`` and half the rows."""
    return max(2, min(limit, n // 2))


def _vectors(rows: DataFrame) -> DataFrame:
    return rows.withColumn("__v", array_to_vector(F.transform("features", lambda x: x.cast("double"))))


def _model_sweep(rows: DataFrame, id_col: str, ks: Sequence[int] | None, algorithm: str, make) -> tuple[DataFrame, DataFrame]:
    """Fit ``make(k, label column)`` to all rows for each k; the fitted models are small and label everything in one pass.

    k-means gives equal rows equal labels, so they are labelled and scored as one point that counts for all of them.
    """
    data, out, labels = _vectors(rows), _vectors(merged_points(rows)), {}
    for k in ks or range(2, max_clusters(rows.count(), 10) + 1):
        labels[k] = f"__label_{k}"
        out = make(k, labels[k]).fit(data).transform(out)
    labelled = materialize(_by_k(out, ["features", "w"], labels), f"{algorithm}-labels")
    return _sweep(labelled, id_col, algorithm, rows)


def kmeans_sweep(rows: DataFrame, id_col: str, ks: Sequence[int] | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """k-means for k = 2 .. 10, best silhouette."""
    make = lambda k, label: MC.KMeans(k=k, seed=seed, featuresCol="__v", predictionCol=label)
    return _model_sweep(rows, id_col, ks, "kmeans", make)


MIXTURE_ROUNDS, MIXTURE_TOLERANCE = 100, 0.01  # MLlib's defaults
EPSILON = float(np.finfo(float).eps)


@dataclass
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    spreads: np.ndarray

    def chances(self, x: np.ndarray) -> np.ndarray:
        """Weighted densities of the components at the rows of ``x``, with a pseudo-inverse where a spread has no full rank."""
        out = np.empty((len(x), len(self.weights)))
        for j, (weight, mean, spread) in enumerate(zip(self.weights, self.means, self.spreads)):
            values, axes = np.linalg.eigh(spread)
            wide = values > EPSILON * values.max() * len(values)
            if not wide.any():
                raise ValueError("Covariance matrix has no non-zero singular values")
            z = (x - mean) @ (axes[:, wide] / np.sqrt(values[wide]))
            out[:, j] = weight * np.exp(-0.5 * (len(mean) * np.log(2 * np.pi) + np.log(values[wide]).sum() + (z * z).sum(axis=1)))
        return EPSILON + out

    def sums(self, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Log likelihood, then the components' shares, sums and sums of squares, of points that count ``w`` times."""
        p = self.chances(x)
        total = p.sum(axis=1)
        share = p * (w / total)[:, None]
        squares = [(x * share[:, j, None]).T @ x for j in range(share.shape[1])]
        return np.concatenate([[w @ np.log(total)], share.sum(axis=0), (share.T @ x).ravel(), np.ravel(squares)])

    @classmethod
    def of_sums(cls, sums: np.ndarray, k: int, d: int) -> Mixture:
        held, first, second = sums[1 : 1 + k], sums[1 + k : 1 + k + k * d].reshape(k, d), sums[1 + k + k * d :].reshape(k, d, d)
        means = first / held[:, None]
        spreads = (second - held[:, None, None] * means[:, :, None] * means[:, None, :]) / held[:, None, None]
        return cls(held / held.sum(), means, spreads)


def fit_mixtures(points: DataFrame, mixtures: dict[int, Mixture]) -> dict[int, Mixture]:
    """Expectation maximisation from the given mixtures, all in one pass over ``points`` (features, w) a round.

    A mixture is done when its log likelihood settles. Spark adds up the sums; a round brings one number to the driver for each
    parameter.
    """
    found, open_, before = dict(mixtures), sorted(mixtures), dict.fromkeys(mixtures, 0.0)
    for _ in range(MIXTURE_ROUNDS):
        now = {k: found[k] for k in open_}

        def rows(batches, now=now):
            held = {}
            for b in batches:
                if b.num_rows:
                    x, w = matrix(b["features"]), b["w"].to_numpy(zero_copy_only=False).astype(float)
                    for at in range(0, len(x), 4096):
                        for k, m in now.items():
                            held[k] = held.get(k, 0.0) + m.sums(x[at : at + 4096], w[at : at + 4096])
            for k, v in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], ["k", "i", "v"])

        parts = points.select("features", "w").mapInArrow(rows, "k int, i int, v double")
        summed = parts.groupBy("k", "i").agg(F.sum("v").alias("v")).toPandas().sort_values(["k", "i"])
        for k, values in summed.groupby("k")["v"]:
            sums, k = values.to_numpy(), int(k)
            found[k] = Mixture.of_sums(sums, k, found[k].means.shape[1])
            if abs(sums[0] - before[k]) <= MIXTURE_TOLERANCE:
                open_.remove(k)
            before[k] = sums[0]
        if not open_:
            break
    return found


def gmm_sweep(rows: DataFrame, id_col: str, ks: Sequence[int] | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Full-covariance Gaussian mixtures for k = 2 .. 10, best silhouette.

    MLlib draws the first mixture of each k from all rows. Equal rows are then one point that counts for all of them, and the rounds
    of all k are run together over the points.
    """
    data, points, first = _vectors(rows), merged_points(rows), {}
    for k in ks or range(2, max_clusters(rows.count(), 10) + 1):
        drawn = MC.GaussianMixture(k=k, seed=seed, maxIter=0, featuresCol="__v").fit(data)
        parts = drawn.gaussiansDF.collect()  # k rows
        first[k] = Mixture(np.array(drawn.weights), np.array([r["mean"].toArray() for r in parts]), np.array([r["cov"].toArray() for r in parts]))
    fitted = fit_mixtures(points, first)

    def labels(batches):
        for b in batches:
            if b.num_rows:
                x = matrix(b["features"])
                for k, m in fitted.items():
                    label = np.concatenate([m.chances(x[i : i + 4096]).argmax(axis=1) for i in range(0, len(x), 4096)])
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(x), k, np.int32)), pa.array(label.astype(np.int32))], ["features", "w", "k", "label"])

    labelled = points.select("features", "w").mapInArrow(labels, "features array<double>, w long, k int, label int")
    return _sweep(materialize(labelled, "gaussian_mixture-labels"), id_col, "gaussian_mixture", rows, digits=9)


def assign_nearest(rows: DataFrame, centres: dict[int, Sequence[float]]) -> DataFrame:
    """Label of the nearest of a few fixed centres (smallest label on ties)."""
    cells = [
        F.struct(
            M.squared_distance(F.col("features"), F.array(*[F.lit(float(v)) for v in c])).alias("d"), F.lit(label).alias("label")
        )
        for label, c in sorted(centres.items())
    ]
    return rows.withColumn("label", F.array_min(F.array(*cells))["label"])


# --- Density clustering ----------------------------------------------------------------------------

CHUNK_POINTS = 1024
FILE_NUMBERS = 1 << 21  # numbers of the points in a file


def _squares(a: pd.DataFrame, b: pd.DataFrame, limit: float) -> np.ndarray:
    """Squared distances up to ``limit``, without the rounding of the product form; infinite beyond it."""
    x, y = np.stack(a["x"].to_numpy()).astype(float), np.stack(b["x"].to_numpy()).astype(float)
    out = np.full((len(x), len(y)), np.inf)
    row, col, d = close_pairs(x, y, limit)
    out[row, col] = d
    return out


FOREST_EDGES = 1 << 20


def _forest(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least spanning forest of a list of edges, in Boruvka rounds; equal weights count in the order of the list."""
    order = np.argsort(w, kind="stable")
    a, b, w = a[order], b[order], w[order]
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = ends[: len(a)], ends[len(a) :]
    component, kept, open_ = np.arange(len(names)), np.zeros(len(w), bool), np.arange(len(w))
    while True:
        ca, cb = component[one[open_]], component[two[open_]]
        open_ = open_[ca != cb]
        if not len(open_):
            return a[kept], b[kept], w[kept]
        ca, cb = component[one[open_]], component[two[open_]]
        least = np.full(len(names), len(w))
        np.minimum.at(least, ca, open_)
        np.minimum.at(least, cb, open_)
        own = np.flatnonzero(least < len(w))
        edge = least[own]
        kept[edge] = True
        parent = np.arange(len(names))
        parent[own] = component[one[edge]] + component[two[edge]] - own  # the other end
        both = (parent[parent] == np.arange(len(names))) & (parent > np.arange(len(names)))
        parent[both] = np.flatnonzero(both)
        while (parent[parent] != parent).any():
            parent = parent[parent]
        component = parent[component]


@dataclass
class Density:
    """Distinct points with their core distances, and the graph of mutual reachability up to ``reach``.

    ``points``: pid, x, w (rows at that point), cell, chunk, core (squared core distance for each of ``samples``, null beyond ``reach``),
    near (squared distance d and pid n of the nearest points up to ``reach``, as many as the largest of ``samples``).
    ``edges``: s (index in ``samples``), a, b, w (squared mutual reachability). Each task adds the least spanning
    forest of its part of the graph; together they connect, at every distance up to ``reach``, what the whole graph connects.
    """

    points: DataFrame
    edges: DataFrame
    cells: Cells
    chunks: np.ndarray
    samples: list[int]
    reach: float


def density_graph(rows: DataFrame, id_col: str, reach: float, samples: Sequence[int], cell_points: int = CELL_POINTS) -> Density:
    """Core distances for every neighbour count in ``samples`` and the reachability graph, for all distances up to ``reach``.

    Equal points are merged. Points are dealt to cells around pivots and cells are cut into chunks; only cells that can hold
    points within ``reach`` of each other meet, in any number of dimensions. Points meet tile by tile (:func:`met`), and a task
    gives the nearest few of a point and a forest, never the pairs.
    """
    samples = sorted(set(samples))
    pts = rows.groupBy(F.transform("features", lambda v: v.cast("double")).alias("x")).agg(
        F.min(id_col).cast("long").alias("pid"), F.count(F.lit(1)).alias("w")
    )
    pts = materialize(pts, "density-points")
    pivots = choose_pivots(pts, pts.count(), cell_points)
    pts = materialize(placed(pts, pivots), "density-placed")
    cells = cells_of(pts, pivots)
    chunks = np.maximum(1, -(-cells.sizes // CHUNK_POINTS))
    firsts = np.concatenate([[0], np.cumsum(chunks)])
    at_cell = lambda numbers: F.element_at(F.lit(numbers.tolist()), F.col("cell") + 1)
    pts = pts.select("pid", "x", "w", "cell", F.pmod(F.xxhash64("pid"), at_cell(chunks)).cast("int").alias("chunk"))
    pts = pts.withColumn("grp", (at_cell(firsts[:-1]) + F.col("chunk")).cast("long"))
    cell_of = np.repeat(np.arange(len(chunks)), chunks)
    sizes, width = -(-cells.sizes // chunks)[cell_of], pivots.shape[1]
    parts = int(min(firsts[-1], max(2 * rows.sparkSession.sparkContext.defaultParallelism, cells.sizes.sum() * width // FILE_NUMBERS)))
    grouped = lambda df: df.repartition(parts, "grp").sortWithinPartitions("grp")
    pts = materialize(grouped(pts), "density-chunks")
    near, most, limit = cells.near(reach), samples[-1], reach * reach

    def neighbours(meetings):
        parts = []
        for m in meetings:
            row, col, d = close_pairs(m.left["x"], m.right["x"], limit)
            kept = least_of_rows(row, d, most)
            parts.append((row[kept], d[kept], m.right["w"][col[kept]], m.right["pid"][col[kept]]))
            if m.last:
                row, d, w, n = (np.concatenate(v) for v in zip(*parts))
                kept, parts = least_of_rows(row, d, most), []
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (m.left["pid"][row[kept]], d[kept], w[kept], n[kept])], ["pid", "d", "w", "n"])

    found = met(pts, sizes, cell_of, near, width, ["pid", "w"], neighbours, "pid long, d double, w long, n long", "density-near")
    around = found.groupBy("pid").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "w", "n"))), 1, most).alias("n"))
    start = F.struct(F.lit(0).cast("long").alias("held"), F.lit(None).cast("double").alias("d"))

    def core(s: int):
        def step(acc, e):
            more = F.struct((acc["held"] + e["w"]).alias("held"), e["d"].alias("d"))
            return F.when(acc["held"] >= s, acc).otherwise(more)

        last = F.aggregate("n", start, step)
        return F.when(last["held"] >= s, last["d"])

    close = F.transform("n", lambda e: F.struct(e["d"].alias("d"), e["n"].alias("n"))).alias("near")
    cored = around.select("pid", F.array(*[core(s) for s in samples]).alias("core"), close)
    points = materialize(grouped(pts.join(cored, "pid")), "density-cores")

    def reachable(meetings):
        held = [[] for _ in samples]

        def least(s: int) -> None:
            held[s] = [_forest(*(np.concatenate(v) for v in zip(*held[s])))]

        bound = [FOREST_EDGES] * len(samples)
        for m in meetings:
            row, col, d = close_pairs(m.left["x"], m.right["x"], limit)
            a, b = m.left["pid"][row], m.right["pid"][col]
            for s in range(len(samples)):
                w = np.maximum(np.maximum(d, m.left["core"][row, s]), m.right["core"][col, s])
                kept = (w <= limit) & (a != b)
                held[s].append((a[kept], b[kept], w[kept]))
                if sum(len(v[0]) for v in held[s]) > bound[s]:
                    least(s)
                    bound[s] = FOREST_EDGES + 2 * len(held[s][0][0])
        for s in range(len(samples)):
            if held[s]:
                least(s)
                a, b, w = held[s][0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), s, np.int32)), pa.array(a), pa.array(b), pa.array(w)], ["s", "a", "b", "w"])

    body = points.filter(F.exists("core", lambda c: c.isNotNull()))
    edges = met(body, sizes, cell_of, near, width + len(samples), ["pid", "core"], reachable, "s int, a long, b long, w double", "density-edges", half=True)
    return Density(points, edges, cells, chunks, samples, reach)


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Least spanning forest (a, b, w) of a weighted graph in Boruvka rounds.

    Each round every component takes its least edge out (ties by the nodes, so no cycle can close), the edges taken are
    kept, and components merge along them. Rounds at least halve the components and are written tables.
    """
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").filter("a <> b")
    e = materialize(e.groupBy("a", "b").agg(F.min("w").alias("w")).withColumns({"ca": F.col("a"), "cb": F.col("b")}), "forest-edges")
    kept = []
    while not e.isEmpty():
        cheap = F.min(F.struct("w", "a", "b", "ca", "cb")).alias("e")
        ends = e.select("*", F.explode(F.array("ca", "cb")).alias("c"))
        taken = materialize(ends.groupBy("c").agg(cheap).select("e.*").distinct(), "forest-taken")
        kept.append(taken.select("a", "b", "w"))
        nodes = taken.select(F.explode(F.array("ca", "cb")).alias("node")).distinct()
        merged = connected_components(nodes, taken.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        for c in ("ca", "cb"):
            named = merged.select(F.col("node").alias(c), F.col("component").alias("__to"))
            e = salted_join(e, named, [c]).withColumn(c, F.coalesce("__to", c)).drop("__to")
        e = materialize(e.filter("ca <> cb"), "forest-edges")
    out = edges.select("a", "b", "w").limit(0)
    for part in kept:
        out = out.unionByName(part)
    return out


def density_tree(graph: Density, s: int = 0) -> DataFrame:
    """Spanning forest (a, b, w) over mutual reachability for the neighbour count at index ``s``: any distance can be cut from it."""
    return spanning_forest(graph.edges.filter(F.col("s") == s))


def cut(graph: Density, trials: Sequence[tuple[int, float, int]], edges: DataFrame | None = None) -> DataFrame:
    """Labels of the distinct points for each (trial, eps, min_samples): (trial, x, w, label), -1 for noise.

    Clusters of a trial are the components of the edges up to its eps, numbered by their smallest point; a point that is not core
    goes to the first of the clusters it touches. All trials run together.
    """
    spark = graph.points.sparkSession
    table = spark.createDataFrame(
        [(t, float(eps), float(eps) * float(eps), graph.samples.index(m)) for t, eps, m in trials], "trial int, eps double, square double, s int"
    )
    edges = graph.edges if edges is None else edges
    tried = graph.points.join(F.broadcast(table)).withColumn("is_core", F.coalesce(F.element_at("core", F.col("s") + 1) <= F.col("square"), F.lit(False)))
    node = lambda pid: F.struct("trial", F.col(pid).alias("pid"))
    links = edges.join(F.broadcast(table), "s").filter(F.col("w") <= F.col("square")).select(node("a").alias("a"), node("b").alias("b"))
    groups = connected_components(tried.filter("is_core").select(node("pid").alias("node")), links)
    core = groups.select(F.col("node.trial").alias("trial"), F.col("node.pid").alias("pid"), F.col("component.pid").alias("component"))
    # A point that is not core has fewer points around it than its list can hold.
    touched = tried.filter("NOT is_core").select("trial", "square", "pid", F.inline("near")).filter(F.col("d") <= F.col("square"))
    reached = touched.select("trial", F.col("pid").alias("of"), F.col("n").alias("pid")).join(core, ["trial", "pid"])
    reached = reached.groupBy("trial", F.col("of").alias("pid")).agg(F.min("component").alias("component"))
    clusters = materialize(core.unionByName(reached), "density-labels")
    numbers = with_position(clusters.select("trial", "component").distinct(), ["trial"], "component", name="label").drop("n")
    labels = salted_join(clusters, numbers, ["trial", "component"], "inner").select("trial", "pid", F.col("label").cast("int").alias("label"))
    out = graph.points.select("pid", "x", "w").join(F.broadcast(table.select("trial"))).join(labels, ["trial", "pid"], "left")
    return out.select("trial", "x", "w", F.coalesce("label", F.lit(-1)).alias("label"))


def _label_rows(rows: DataFrame, id_col: str, labels: DataFrame) -> DataFrame:
    """(id, features, trial, label) of all rows, through their points (trial, x, w, label).

    The rows of the points that hold more than a thousandth of them stay where they are: these points go to all tasks.
    """
    keyed = rows.select(id_col, "features", F.transform("features", lambda v: v.cast("double")).alias("x"))
    each = labels.groupBy("x").agg(F.max("w").alias("__w"), F.collect_list(F.struct("trial", "label")).alias("tried"))
    each = materialize(each, "point-labels")
    many = F.col("__w") > max(16, rows.count() // 1000)
    hot, rest = F.broadcast(each.filter(many).drop("__w")), each.filter(~many).drop("__w")  # a thousand points at most
    found = join_on(keyed, hot, ["x"], "inner").unionByName(join_on(join_on(keyed, hot.select("x"), ["x"], "left_anti"), rest, ["x"], "inner"))
    return found.select(id_col, "features", F.inline("tried"))


def dbscan(rows: DataFrame, id_col: str, eps: float, min_samples: int, cell_points: int = CELL_POINTS) -> DataFrame:
    """Exact density clustering: (id, label) with -1 for noise; a point counts as its own neighbour."""
    graph = density_graph(rows, id_col, eps, [min_samples], cell_points)
    return _label_rows(rows, id_col, cut(graph, [(0, eps, min_samples)])).select(id_col, "label")


def dbscan_search(rows: DataFrame, id_col: str, trials: int = 20, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Density parameters by random trials, each on all rows; the best noise-free silhouette must be positive.

    eps from 0.1 to 2, min_samples from 2 to min(20, n/10). All trials are cut from one reachability graph and are scored in one
    pass. Gives the assignment (id, label) of the best trial, and the trials.
    """
    n = rows.count()
    space = {"eps": ("float", 0.1, 2.0), "min_samples": ("int", 2, max(2, min(20, n // 10)))}  # fixed values
    drawn = [(i, float(d["eps"]), int(d["min_samples"])) for i, d in enumerate(draws(space, trials, seed))]
    graph = density_graph(rows, id_col, max(e for _, e, _ in drawn), [m for *_, m in drawn])
    labelled = materialize(cut(graph, drawn), "density-trials")
    found = M.sweep_scores(labelled.filter("label >= 0"), "trial", "x", "x", weight="w").select("trial", F.col("k").cast("int").alias("n_clusters"), *SCORES)
    table = rows.sparkSession.createDataFrame(drawn, "trial int, eps double, min_samples int").join(found, "trial", "left")
    silhouette = F.when(F.col("n_clusters") >= 2, F.col("silhouette")).otherwise(-1.0).alias("silhouette")
    table = table.select("trial", "eps", "min_samples", F.coalesce("n_clusters", F.lit(0)).alias("n_clusters"), silhouette, *SCORES[1:])
    table = materialize(table, "density-scores")
    best = table.orderBy(F.desc("silhouette"), "trial").first()
    if best["silhouette"] <= 0:
        raise ValueError("no density clustering with a positive silhouette")
    return _label_rows(rows, id_col, labelled.filter(F.col("trial") == best["trial"])).select(id_col, "label"), table


# --- Hierarchical and spectral ---------------------------------------------------------------------

MICRO_CLUSTERS = 500


def _merge_tree(centres: np.ndarray, weights: np.ndarray, linkage: str) -> list[tuple[int, int]]:
    """Agglomerative merges of weighted centres as (kept, absorbed) indices in order."""
    n = len(centres)
    d = ((centres[:, None, :] - centres[None, :, :]) ** 2).sum(2)
    if linkage == "ward":
        d = d * (weights[:, None] * weights[None, :]) / (weights[:, None] + weights[None, :])
    else:
        d = np.sqrt(d)
    np.fill_diagonal(d, np.inf)
    w, merges = weights.astype(float).copy(), []
    for _ in range(n - 1):
        i, j = divmod(int(np.argmin(d)), n)
        i, j = min(i, j), max(i, j)
        merges.append((i, j))
        dij = d[i, j]
        if linkage == "ward":
            new = ((w[i] + w) * d[i] + (w[j] + w) * d[j] - w * dij) / (w[i] + w[j] + w)
        elif linkage == "complete":
            new = np.maximum(d[i], d[j])
        elif linkage == "average":
            new = (w[i] * d[i] + w[j] * d[j]) / (w[i] + w[j])
        else:
            raise ValueError(f"unknown linkage {linkage!r}")
        gone = np.isinf(d[i]) | np.isinf(d[j])
        new[gone & (np.arange(n) != i)] = np.inf
        w[i] += w[j]
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
    return merges


def hierarchical(
    rows: DataFrame, id_col: str, ks: Sequence[int] | None = None, linkage: str = "ward", micro: int = MICRO_CLUSTERS, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Agglomerative clustering for k = 2 .. 10, best silhouette.

    Merging is a step over at most ``micro`` weighted centres: the distinct points themselves where there are no more
    of them, which gives the exact tree, else k-means centres of all rows.
    """
    n = rows.count()
    merged = merged_points(rows)
    distinct = merged.select("features").limit(micro + 1).collect()  # at most micro + 1 points
    if len(distinct) <= micro:
        points = sorted([float(v) for v in r["features"]] for r in distinct)
        named = rows.sparkSession.createDataFrame([(p, i) for i, p in enumerate(points)], "x array<double>, `__m` int")
        placed = materialize(merged.withColumnRenamed("features", "x").join(F.broadcast(named), "x").select(F.col("x").alias("features"), "w", "__m"), "micro-clusters")
        at = points
    else:
        model = MC.KMeans(k=micro, seed=seed, featuresCol="__v", predictionCol="__m").fit(_vectors(rows))
        placed = materialize(model.transform(_vectors(merged)).select("features", "w", "__m"), "micro-clusters")
        at = model.clusterCenters()
    sizes = {r["__m"]: r["n"] for r in placed.groupBy("__m").agg(F.sum("w").alias("n")).collect()}
    ids = sorted(sizes)
    centres = np.array([at[i] for i in ids])
    merges = _merge_tree(centres, np.array([sizes[i] for i in ids]), linkage)
    ks = [k for k in (ks or range(2, max_clusters(n, 10) + 1)) if k <= len(ids)]

    def names(k: int) -> list[int]:
        parent = list(range(len(ids)))

        def root(v: int) -> int:
            while parent[v] != v:
                v = parent[v]
            return v

        for i, j in merges[: len(ids) - k]:
            parent[root(j)] = root(i)
        order = {r: c for c, r in enumerate(sorted({root(v) for v in range(len(ids))}))}
        return [order[root(v)] for v in range(len(ids))]

    cuts = [names(k) for k in ks]
    pairs = [(m, [(k, labels[at]) for k, labels in zip(ks, cuts)]) for at, m in enumerate(ids)]
    lookup = rows.sparkSession.createDataFrame(pairs, "`__m` int, tried array<struct<k: int, label: int>>")
    labelled = placed.join(F.broadcast(lookup), "__m").select("features", "w", F.inline("tried"))  # at most `micro` rows
    return _sweep(labelled, id_col, "hierarchical", rows)


BLOCK_NODES = 2048  # nodes whose vectors move as one row
FEW_NODES = 1024  # a graph of no more nodes is solved as a matrix
PARTS = 64  # rows at most for the edges out of a block
_END = 1 << 32


def _numbers(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)


def _numbered(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``at``, their place in their block."""
    return nodes.withColumn("at", F.row_number().over(Window.partitionBy("block").orderBy("id")) - 1)


def _by_rows(table: DataFrame) -> DataFrame:
    """``table`` for a join that moves rows by key.

    Spark would send a table of nodes to all tasks, through the driver, if its file is small; repeated numbers make that of millions of rows so.
    """
    return table.hint("merge")


def _packed_edges(both: DataFrame, nodes: DataFrame) -> DataFrame:
    """The normalised graph by the block its edges leave from: (block, part, target, at, weight), arrays in order of ``target``.

    Each block also has one row without edges, part -1.
    """
    end = lambda name, as_: _by_rows(nodes.select(F.col("id").alias(name), F.col("block").alias(f"{as_}block"), F.col("at").alias(f"{as_}at"), F.col("d").alias(f"{as_}d")))
    edges = both.join(end("src", "t"), "src").join(end("dst", "f"), "dst").select(
        F.col("fblock").alias("block"), F.pmod("tblock", F.lit(PARTS)).cast("int").alias("part"),
        F.struct(
            (F.col("tblock") * F.lit(_END) + F.col("tat")).alias("target"), F.col("fat").alias("at"), F.coalesce(F.try_divide("weight", F.sqrt(F.col("td") * F.col("fd"))), F.lit(0.0)).alias("weight")
        ).alias("e"),
    )
    packed = edges.groupBy("block", "part").agg(F.array_sort(F.collect_list("e")).alias("e")).select("block", "part", "e.target", "e.at", "e.weight")
    none = [F.array().cast(f"array<{kind}>").alias(name) for name, kind in (("target", "bigint"), ("at", "int"), ("weight", "double"))]
    own = nodes.select("block").distinct().select("block", F.lit(-1).alias("part"), *none)
    return materialize(packed.unionByName(own), "graph-packed")


def _times(edges: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """One product of the lazy normalised graph with the vectors of its nodes: (block, v), the numbers of a block's nodes in one array.

    A block's products are summed by target before they move, so mostly the vectors themselves do.
    """

    def sent(batches):
        for b in batches:
            for k in range(b.num_rows):
                r = b.slice(k, 1)
                block, part, v = r["block"][0].as_py(), r["part"][0].as_py(), _numbers(r["v"].take(pa.array([0])))
                if part < 0:
                    blocks, places, sums = [block], [None], [v]
                else:
                    target, at, weight = (_numbers(r[c].take(pa.array([0]))) for c in ("target", "at", "weight"))
                    first = np.flatnonzero(np.diff(target, prepend=-1))
                    total = np.add.reduceat(v.reshape(-1, width)[at] * weight[:, None], first, axis=0)
                    goal, place = np.divmod(target[first], _END)
                    cuts = np.flatnonzero(np.diff(goal, prepend=-1))
                    blocks, ends = goal[cuts].tolist(), [*cuts[1:].tolist(), len(goal)]
                    places = [place[i:j].astype(np.int32) for i, j in zip(cuts.tolist(), ends)]
                    sums = [total[i:j].ravel() for i, j in zip(cuts.tolist(), ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(blocks, pa.int64()), pa.array([block * (PARTS + 1) + part + 1] * len(blocks), pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(sums, pa.list_(pa.float64()))],
                    ["block", "sender", "at", "v"],
                )

    def mixed(batches):
        for b in batches:
            for k in range(b.num_rows):
                own, out = None, None
                got = b["got"].take(pa.array([k])).values
                places, sums = got.field("at"), got.field("v")
                for i in range(len(got)):
                    v = sums[i].values.to_numpy(zero_copy_only=False).reshape(-1, width)
                    if places[i].is_valid:
                        out[places[i].values.to_numpy(zero_copy_only=False)] += v
                    else:
                        own, out = v, np.zeros(v.shape)
                yield pa.RecordBatch.from_arrays([b["block"].slice(k, 1), pa.array([((own + out) / 2).ravel()], pa.list_(pa.float64()))], ["block", "v"])

    products = edges.join(_by_rows(vectors), "block").mapInArrow(sent, "block long, sender long, at array<int>, v array<double>")
    # A block's own vectors come first.
    got = F.array_sort(F.collect_list(F.struct(F.col("at").isNotNull().alias("other"), "sender", "at", "v"))).alias("got")
    return products.groupBy("block").agg(got).mapInArrow(mixed, "block long, v array<double>")


def _mapped(vectors: DataFrame, work) -> DataFrame:
    """``work`` on the matrix of each block; the result flat."""

    def rows(batches):
        for b in batches:
            for k in range(b.num_rows):
                out = work(_numbers(b["v"].take(pa.array([k])))).ravel()
                yield pa.RecordBatch.from_arrays([b["block"].slice(k, 1), pa.array([out], pa.list_(pa.float64()))], ["block", "v"])

    return vectors.mapInArrow(rows, "block long, v array<double>")


def _orthonormal(vectors: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """The vectors with orthonormal columns, and the lengths they had along their principal axes; only a width x width matrix is gathered."""

    def squared(v):
        x = v.reshape(-1, width)
        return x.T @ x

    cells = _mapped(vectors, squared).select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    gram = np.zeros(width * width)
    for r in cells.collect():
        gram[r["i"]] = r["x"]
    values, axes = np.linalg.eigh(gram.reshape(width, width))
    values, axes = np.maximum(values[::-1], 1e-300), axes[:, ::-1]
    turn = axes / np.sqrt(values)
    return _mapped(vectors, lambda v: v.reshape(-1, width) @ turn), np.sqrt(values)


def _matrix_vectors(both: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(id, d, v) of a graph of at most ``FEW_NODES`` nodes."""
    held = nodes.select("id", "d").orderBy("id").collect()
    place = {r["id"]: i for i, r in enumerate(held)}
    d = np.array([r["d"] for r in held], dtype=float)
    a = np.zeros((len(held), len(held)))
    for r in both.collect():  # at most FEW_NODES x FEW_NODES
        i, j = place[r["src"]], place[r["dst"]]
        a[i, j] = r["weight"] / (np.sqrt(d[i] * d[j]) or 1.0)
    axes = np.linalg.eigh((a + a.T) / 2)[1][:, ::-1][:, :width]
    axes = np.hstack([axes, np.zeros((len(held), width - axes.shape[1]))])
    kind = nodes.schema["id"].dataType.simpleString()
    return nodes.sparkSession.createDataFrame([(r["id"], float(r["d"]), axes[i].tolist()) for i, r in enumerate(held)], f"id {kind}, d double, v array<double>")


def _contracted(both: DataFrame, nodes: DataFrame, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A smaller graph: a quarter of the nodes, drawn by hash, take in the rest of the nodes next to them.

    Gives its edges (inner ones as loops), its nodes, and the node that each node goes to.
    """
    drawn = lambda c: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(4)) == 0
    to = both.filter(~drawn("src") & drawn("dst")).groupBy(F.col("src").alias("id")).agg(F.max_by("dst", F.struct("weight", "dst")).alias("to"))
    parents = materialize(nodes.select("id", "d", "block").join(_by_rows(to), "id", "left").withColumn("to", F.coalesce("to", "id")), "graph-parents")
    end = lambda name, as_: _by_rows(parents.select(F.col("id").alias(name), F.col("to").alias(as_)))
    edges = both.join(end("src", "a"), "src").join(end("dst", "b"), "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("weight").alias("weight"))
    fewer = parents.groupBy(F.col("to").alias("id")).agg(F.sum("d").alias("d"), F.floor(F.min("block") / 4).alias("block"))
    return materialize(edges, "graph-edges"), materialize(_numbered(fewer), "graph-nodes"), parents


def _graph_vectors(both: DataFrame, nodes: DataFrame, width: int, k: int, rounds: int, steps: int, tol: float, seed: int, depth: int = 0) -> DataFrame:
    """(id, d, v): leading eigenvectors of a graph with all edges both ways and nodes (id, d, block, at)."""
    n = nodes.count()
    if n <= FEW_NODES:
        return _matrix_vectors(both, nodes, width)
    small, fewer, parents = _contracted(both, nodes, seed + 101 * depth)
    if fewer.count() <= 0.9 * n:
        coarse = _graph_vectors(small, fewer, width, k, rounds, steps, tol, seed, depth + 1)
        coarse = coarse.select(F.col("id").alias("to"), F.col("d").alias("e"), "v")
        share = F.coalesce(F.sqrt(F.try_divide("d", "e")), F.lit(0.0))
        start = parents.join(_by_rows(coarse), "to").select("id", F.transform("v", lambda v: v * share).alias("v"))
        most = rounds if depth == 0 else 1
    else:  # hardly any edges between different nodes
        start = nodes.select("id", F.array(*[F.xxhash64("id", F.lit(seed + i)).cast("double") / float(1 << 63) for i in range(width)]).alias("v"))
        most = rounds
    held = nodes.select("id", "block", "at", "d").join(_by_rows(start), "id")
    by_place = F.array_sort(F.collect_list(F.struct("at", "v"))).alias("e")
    vectors = materialize(held.groupBy("block").agg(by_place).select("block", F.flatten("e.v").alias("v")), "graph-vectors")
    edges, before = _packed_edges(both, nodes), None
    for _ in range(most):
        for _ in range(steps):
            vectors = _times(edges, vectors, width)
        vectors = materialize(vectors, "graph-vectors")
        vectors, lengths = _orthonormal(vectors, width)
        if before is not None and np.abs(lengths[:k] - before[:k]).max() < tol:
            break
        before = lengths
    names = nodes.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "id", "d"))).alias("e")).select("block", "e.id", "e.d")
    kind = nodes.schema["id"].dataType.simpleString()

    def apart(batches):
        for b in batches:
            for i in range(b.num_rows):
                ids, d, v = (b[c].take(pa.array([i])).values for c in ("id", "d", "v"))
                yield pa.RecordBatch.from_arrays([ids, d, pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * width, pa.int32()), v)], ["id", "d", "v"])

    return materialize(names.join(_by_rows(vectors), "block").select("id", "d", "v").mapInArrow(apart, f"id {kind}, d double, v array<double>"), "graph-vectors")


def laplacian_vectors(graph: DataFrame, nodes: DataFrame, k: int, rounds: int = 12, steps: int = 4, tol: float = 1e-3, seed: int = 42) -> DataFrame:
    """(id, v): the ``k`` leading eigenvectors of the normalised graph, by block subspace iteration from those of a smaller graph.

    ``graph`` has src, dst and weight, each edge once; ``nodes`` has id and may have ``block``, a number that nodes with
    common edges share (by hash otherwise). The graph is contracted along its edges until few nodes are left, which are solved
    as a matrix; a contracted node never holds nodes that no path joins, so vectors of whole components are exact from there on.
    On the way back a round multiplies ``steps`` times by the lazy normalised graph (I + D^-1/2 W D^-1/2) / 2 and makes the
    columns orthonormal again, once for a contracted graph, until the lengths settle for the graph itself. A few spare columns
    speed this up. Products move one row for each block of nodes.
    """
    both = graph.select("src", "dst", "weight").unionByName(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    both = materialize(both, "graph-edges")
    named = nodes.filter(F.col("id").isNotNull())
    if "block" in nodes.columns:
        named = named.groupBy("id").agg(F.min("block").cast("long").alias("block"))
    else:
        named = named.select("id").distinct()
        named = named.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(-(-named.count() // BLOCK_NODES) or 1)))
    degree = both.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("d"))
    named = named.join(_by_rows(degree), "id", "left").withColumn("d", F.coalesce("d", F.lit(0.0)))
    vectors = _graph_vectors(both, materialize(_numbered(named), "graph-nodes"), k + 3, k, rounds, steps, tol, seed)
    return nodes.select("id").join(_by_rows(vectors), "id").select("id", F.slice("v", 1, k).alias("v"))


def _near_blocks(rows: DataFrame, id_col: str, n: int) -> DataFrame:
    """(id, block): blocks of about ``BLOCK_NODES`` rows that lie around the same pivot."""
    if n <= BLOCK_NODES:
        return rows.select(F.col(id_col).alias("id"), F.lit(0).cast("long").alias("block"))
    points = rows.select(F.col(id_col).alias("id"), F.transform("features", lambda v: v.cast("double")).alias("x"))
    pivots = choose_pivots(points, n, BLOCK_NODES)
    held = materialize(placed(points, pivots).select("id", "cell", "reach"), "graph-cells")
    chunks = np.maximum(1, -(-cells_of(held, pivots).sizes // BLOCK_NODES))
    firsts = np.concatenate([[0], np.cumsum(chunks)])
    table = [(i, int(firsts[i]), int(c)) for i, c in enumerate(chunks)]  # a row for each pivot
    named = held.join(F.broadcast(rows.sparkSession.createDataFrame(table, "cell int, first long, chunks long")), "cell")
    return named.select("id", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("chunks"))).alias("block"))


def spectral(rows: DataFrame, id_col: str, ks: Sequence[int] | None = None, neighbours: int = 10, gamma: float = 1.0, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Spectral clustering of a nearest-neighbour graph with RBF weights, k = 2 .. 8, best silhouette.

    Rows are embedded by the leading eigenvectors of the normalised graph, at unit length, and grouped by k-means there. The
    eigenvectors are found once, for the largest k; a smaller k uses the first of them.
    """
    graph = nearest(rows, rows, neighbours + 1, id_col).filter(F.col("id") != F.col("neighbour"))
    graph = graph.select(
        F.least("id", "neighbour").alias("src"), F.greatest("id", "neighbour").alias("dst"),
        F.exp(-gamma * F.col("distance") * F.col("distance")).alias("weight"),
    ).dropDuplicates(["src", "dst"])
    graph = materialize(graph, "neighbour-graph")
    n = rows.count()
    ks = list(ks or range(2, max_clusters(n, 8) + 1))
    nodes = _near_blocks(rows, id_col, n)
    vectors = materialize(laplacian_vectors(graph, nodes, max(ks), seed=seed), "spectral-vectors")
    data, labels = rows.join(_by_rows(vectors.withColumnRenamed("id", id_col)), id_col), {}
    length = lambda k: F.sqrt(F.aggregate(F.slice("v", 1, k), F.lit(0.0), lambda acc, v: acc + v * v))
    for k in ks:
        unit = F.transform(F.slice("v", 1, k), lambda v: F.coalesce(F.try_divide(v, length(k)), F.lit(0.0)))  # noqa: B023
        data = data.withColumn(f"__v{k}", array_to_vector(unit))
    out = data
    for k in ks:
        labels[k] = f"__label_{k}"
        out = MC.KMeans(k=k, seed=seed, featuresCol=f"__v{k}", predictionCol=labels[k]).fit(data).transform(out)
    return _sweep(_by_k(out, [id_col, "features"], labels), id_col, "spectral")


def cluster_all(rows: DataFrame, id_col: str, algorithms: Sequence[str] = ("kmeans", "density", "hierarchical")) -> tuple[DataFrame, DataFrame]:
    """Run several clusterings and keep the best: its assignment, and (algorithm, n_clusters, scores, error) of each.

    All assignments are scored together by the same functions on the rows; noise counts as a cluster of its own there, so an
    algorithm does not gain by leaving rows out. An algorithm that fails is skipped with its message; if all fail, so does the call.
    """
    runs = {"kmeans": kmeans_sweep, "density": dbscan_search, "hierarchical": hierarchical, "gmm": gmm_sweep, "spectral": spectral}
    found, errors = {}, {}
    for name in algorithms:
        try:
            found[name] = runs[name](rows, id_col)[0].select(id_col, "label")
        except (ValueError, ArithmeticError) as problem:
            errors[name] = str(problem)
    if not found:
        raise ValueError("no clustering succeeded")
    tagged = [df.withColumn("algorithm", F.lit(name)) for name, df in found.items()]
    every = reduce(DataFrame.unionByName, tagged).join(rows.select(id_col, "features"), id_col)
    alike = F.transform("features", lambda v: v.cast("double")).alias("features")
    every = every.groupBy("algorithm", "label", alike).agg(F.count(F.lit(1)).alias("w"))  # equal rows of a cluster score as one
    scores = M.sweep_scores(every, "algorithm", "features", weight="w").select("algorithm", F.col("k").cast("int").alias("n_clusters"), *SCORES)
    failed = rows.sparkSession.createDataFrame([(a, e) for a, e in errors.items()], "algorithm string, error string")
    results = materialize(scores.join(failed, "algorithm", "full"), "clusterings")
    return found[best_clustering(results).first()["algorithm"]], results


def best_clustering(results: DataFrame) -> DataFrame:
    """The row with the highest silhouette (ties by algorithm name)."""
    rest = [c for c in results.columns if c not in ("silhouette", "algorithm")]
    best = results.filter(F.col("silhouette").isNotNull()).agg(
        F.min(F.struct((-F.col("silhouette")).alias("s"), "algorithm", *rest)).alias("b")
    )
    return best.select("b.algorithm", (-F.col("b.s")).alias("silhouette"), *[f"b.{c}" for c in rest])


def cluster_sizes(assigned: DataFrame, label: str = "label") -> DataFrame:
    """Rows and share per cluster."""
    counts = assigned.groupBy(label).agg(F.count(F.lit(1)).alias("size"))
    total = counts.agg(F.sum("size").alias("__t"))
    return counts.crossJoin(F.broadcast(total)).select(label, "size", (F.col("size") / F.col("__t")).alias("share"))


def cluster_profile(assigned: DataFrame, label: str = "label", columns: Sequence[str] | None = None, top: int = 3) -> DataFrame:
    """Mean of each numeric feature per cluster, its distance from the global mean in std, and its rank by that."""
    columns = list(columns or [c for c in columns_of_kind(assigned, NUMERIC) if c != label])
    rows = assigned.select(F.col(label).alias("label"), *[present_number(assigned, c).alias(c) for c in columns])
    means = rows.unpivot(["label"], columns, "column_name", "v").groupBy("label", "column_name").agg(F.avg("v").alias("cluster_mean"))
    overall = numeric_moments(assigned, columns).select("column_name", F.col("mean").alias("global_mean"), "std")
    scored = means.join(F.broadcast(overall), "column_name").withColumn(
        "z", F.coalesce(F.try_divide(F.col("cluster_mean") - F.col("global_mean"), F.col("std")), F.lit(0.0))
    )
    order = Window.partitionBy("label").orderBy(F.desc(F.abs("z")), "column_name")
    return scored.withColumn("rank", F.row_number().over(order)).withColumn("is_top", F.col("rank") <= top).drop("std")
