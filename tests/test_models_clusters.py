"""Properties of models, clusterings and explanations, and brute-force comparisons."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from lodestat.operators import cluster as K
from lodestat.operators import encoding as E
from lodestat.operators import ensemble as J
from lodestat.operators import explain as L
from lodestat.operators import features as X
from lodestat.operators import metrics as M
from lodestat.operators import models as I
from lodestat.plans import blocks
from lodestat.plans import pivots as P
from lodestat.plans.components import connected_components


def cloud(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, features array<double>")


def brute_density(x, eps, min_samples):
    """Core points joined in order of their rows; other points go to the first cluster they touch."""
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= eps * eps
    core = near.sum(1) >= min_samples
    label, cluster = np.full(len(x), -1), 0
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        todo, label[i] = [i], cluster
        while todo:
            j = todo.pop()
            fresh = np.flatnonzero(near[j] & core & (label < 0))
            label[fresh] = cluster
            todo += fresh.tolist()
        cluster += 1
    for i in np.flatnonzero(~core):
        touched = label[near[i] & core]
        label[i] = touched.min() if len(touched) else -1
    return label


def density_cloud(seed, dims):
    rng = np.random.default_rng(seed)
    return np.round(np.vstack([rng.normal(size=(150, dims)), rng.normal(3, 0.3, size=(80, dims)), np.zeros((40, dims))]), 3)


@pytest.mark.parametrize("dims,eps,seed,cell", [(1, 0.0505, 0, 30), (2, 0.2503, 1, 2000), (3, 0.5, 2, 40), (6, 1.6, 3, 50), (64, 9.0, 4, 60)])
def test_dbscan_equals_brute_force(spark, monkeypatch, dims, eps, seed, cell):
    monkeypatch.setattr(K, "CHUNK_POINTS", 25)
    x = density_cloud(seed, dims)
    got = {r["id"]: r["label"] for r in K.dbscan(cloud(spark, x), "id", eps, 5, cell).collect()}
    want = brute_density(x, eps, 5)
    assert want.max() >= 0 and [got[i] for i in range(len(x))] == want.tolist()


def test_one_tree_is_cut_at_any_distance(spark, monkeypatch):
    monkeypatch.setattr(K, "CHUNK_POINTS", 40)
    x = density_cloud(5, 2)
    rows = cloud(spark, x)
    graph = K.density_graph(rows, "id", 0.6, [3, 7], 60)
    tree = K.density_tree(graph, 1).withColumn("s", F.lit(1))
    n = graph.points.count()
    assert tree.count() <= n - 1 < graph.edges.filter("s = 1").count()
    eps = (0.15, 0.3, 0.6)
    labels = K._label_rows(rows, "id", K.cut(graph, [(i, e, 7) for i, e in enumerate(eps)], tree)).collect()
    for i, e in enumerate(eps):
        got = {r["id"]: r["label"] for r in labels if r["trial"] == i}
        assert [got[j] for j in range(len(x))] == brute_density(x, e, 7).tolist()


def test_spanning_forest_is_least(spark):
    rng = np.random.default_rng(2)
    edges = {(int(a), int(b)): float(w) for (a, b), w in zip(rng.integers(0, 60, (300, 2)), rng.integers(1, 9, 300)) if a < b}
    found = K.spanning_forest(spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "a long, b long, w double")).collect()
    parent = list(range(60))

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    total = count = 0
    for (a, b), w in sorted(edges.items(), key=lambda e: e[1]):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            total, count = total + w, count + 1
    assert len(found) == count and sum(r["w"] for r in found) == total


def test_a_crowded_spot_is_spread_over_tasks(spark, monkeypatch):
    """Most points in one spot: chunks bound what a task holds."""
    monkeypatch.setattr(K, "CHUNK_POINTS", 50)
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(0, 0.01, size=(700, 3)), rng.normal(5, 1, size=(60, 3))])
    graph = K.density_graph(cloud(spark, x), "id", 0.05, [4], 200)
    largest = graph.points.groupBy("cell", "chunk").count().agg(F.max("count")).first()[0]
    assert largest < 150
    got = {r["id"]: r["label"] for r in K._label_rows(cloud(spark, x), "id", K.cut(graph, [(0, 0.05, 4)])).collect()}
    assert [got[j] for j in range(len(x))] == brute_density(x, 0.05, 4).tolist()


def test_density_trials_on_all_rows(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 0.2, size=(40, 2)) for c in (0, 4, 8)])
    rows = cloud(spark, x)
    labels, table = K.dbscan_search(rows, "id", trials=6)
    trials = table.orderBy(F.desc("silhouette"), "trial").collect()
    best = trials[0]
    got = {r["id"]: r["label"] for r in labels.collect()}
    assert [got[i] for i in range(len(x))] == brute_density(x, best["eps"], best["min_samples"]).tolist()
    for r in trials:
        want = brute_density(x, r["eps"], r["min_samples"])
        assert r["n_clusters"] == want.max() + 1
    kept = labels.filter("label >= 0").join(rows, "id")
    assert best["silhouette"] == pytest.approx(M.silhouette(kept).first()["silhouette"])
    assert best["calinski_harabasz"] == pytest.approx(M.calinski_harabasz(kept).first()["calinski_harabasz"])
    assert best["davies_bouldin"] == pytest.approx(M.davies_bouldin(kept).first()["davies_bouldin"])


def test_spectral_finds_rings_and_blobs(spark):
    t = np.linspace(0, 2 * np.pi, 60, endpoint=False)
    rings = np.vstack([np.c_[np.cos(t), np.sin(t)], 4 * np.c_[np.cos(t), np.sin(t)]])
    rng = np.random.default_rng(1)
    blobs = np.vstack([rng.normal(c, 0.3, size=(40, 2)) for c in (0, 6, 12)])
    for x, k in ((rings, 2), (blobs, 3)):
        labels, _ = K.spectral(cloud(spark, x), "id", [k], neighbours=6)
        groups = np.array([r["label"] for r in labels.orderBy("id").collect()]).reshape(k, -1)
        assert all(len(set(g)) == 1 for g in groups) and len({g[0] for g in groups}) == k


def test_vectors_of_long_rings_are_those_of_the_components(spark):
    """Rings of 700 nodes: products of the graph alone would need some hundred thousand steps."""
    size, rings = 700, 3
    edges = [(r * size + i, r * size + (i + 1) % size, 1.0) for r in range(rings) for i in range(size)]
    graph = spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in edges], "src long, dst long, weight double")
    found = K.laplacian_vectors(graph, spark.range(size * rings), rings).orderBy("id").collect()
    v = np.array([r["v"] for r in found]).reshape(rings, size, rings)
    assert np.abs(v - v[:, :1]).max() < 1e-6
    assert np.allclose(np.einsum("ria,rib->ab", v, v), np.eye(rings), atol=1e-6)


def test_a_graph_product_moves_a_row_for_each_pair_of_blocks_that_meet(spark):
    """Equal to the product of the matrices, with a node of many edges and one of none; edges do not move as rows."""
    rng, n, width = np.random.default_rng(2), 400, 3
    a = np.triu(rng.random((n, n)) * (rng.random((n, n)) < 0.02), 1)
    a[0, 1:-1], a[:, -1] = 0.5, 0.0
    a += a.T
    d, x = a.sum(1), rng.normal(size=(n, width))
    both = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in np.argwhere(a)], "src long, dst long, weight double")
    nodes = spark.createDataFrame([(i, i // 100, i % 100, float(d[i])) for i in range(n)], "id long, block long, at int, d double")
    vectors = spark.createDataFrame([(b, x[100 * b : 100 * b + 100].ravel().tolist()) for b in range(4)], "block long, v array<double>")
    edges = K._packed_edges(both, nodes)
    assert edges.count() == 4 * 4 + 4
    got = {r["block"]: r["v"] for r in K._times(edges, vectors, width).collect()}
    scale = np.sqrt(np.where(d > 0, d, 1.0))
    assert np.allclose(np.array([got[b] for b in range(4)]).reshape(n, width), (a / np.outer(scale, scale) @ x + x) / 2)


def test_components_of_a_long_chain_and_a_hub(spark):
    nodes = spark.range(300).withColumnRenamed("id", "node")
    edges = [(i, i + 1) for i in range(99)] + [(200, i) for i in range(201, 260)]
    got = {r["node"]: r["component"] for r in connected_components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(100)) and all(got[i] == 200 for i in range(200, 260))
    assert got[150] == 150


def test_nearest_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_POINTS", 16)
    x = np.random.default_rng(4).normal(size=(90, 5))
    rows = cloud(spark, x)
    got = {(r["id"], r["rank"]): r["neighbour"] for r in I.nearest(rows, rows, 3).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    want = np.argsort(d, axis=1, kind="stable")[:, :3]
    assert all(got[(i, r + 1)] == want[i, r] for i in range(90) for r in range(3))


@pytest.mark.parametrize("dims,k", [(2, 3), (64, 5), (3, 1)])
def test_nearest_through_cells_equals_brute_force(spark, monkeypatch, dims, k):
    for module in (blocks, I):
        monkeypatch.setattr(module, "BLOCK_POINTS", 40)
    rng = np.random.default_rng(dims)
    x = np.vstack([rng.normal(size=(150, dims)), np.zeros((30, dims)), rng.normal(9, 0.1, size=(60, dims))])
    y = np.vstack([rng.normal(size=(40, dims)), np.full((5, dims), 30.0), np.zeros((2, dims))])
    got = {(r["id"], r["rank"]): r["neighbour"] for r in I.nearest(cloud(spark, y), cloud(spark, x), k, cell_points=25).collect()}
    want = np.argsort(((y[:, None] - x[None]) ** 2).sum(2), axis=1, kind="stable")[:, :k]
    assert len(got) == len(y) * k
    assert all(got[(i, r + 1)] == want[i, r] for i in range(len(y)) for r in range(k))
    few = I.nearest(cloud(spark, y), cloud(spark, x[:4]), 9, cell_points=2)
    assert few.count() == 4 * len(y)


def test_separated_cells_are_hardly_ever_compared(spark):
    rng = np.random.default_rng(12)
    x = np.vstack([rng.normal(20 * c, 0.5, size=(40, 8)) for c in range(25)])
    base = cloud(spark, x).select("id", F.col("features").alias("x"))
    pivots = P.choose_pivots(base, len(x), 40)
    cells = P.cells_of(P.placed(base, pivots), pivots)
    first = I.first_cells(base, cells, 3)
    bound = F.lit(1.0).alias("bound")
    second = I.second_cells(first.select("*", bound), cells)
    visits = [r["n"] for df in (first, second) for r in df.select(F.size("cells").alias("n")).collect()]
    assert sum(visits) < 0.2 * len(x) * len(pivots)


def test_three_blobs_found(spark):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(c, 0.3, size=(40, 2)) for c in (0, 5, 10)])
    rows = cloud(spark, x)
    for sweep in (K.kmeans_sweep, K.gmm_sweep):
        table = sweep(rows, "id", [2, 3, 4])[1]
        assert table.filter("is_best").first()["k"] == 3
    labels, table = K.hierarchical(rows, "id", [2, 3, 4], micro=30)
    assert table.filter("is_best").first()["k"] == 3 and labels.count() == 120
    row = K.evaluate_clusters(labels, "hierarchical", {}).first()
    assert row["n_clusters"] == 3 and row["silhouette"] > 0.8 and row["davies_bouldin"] < 0.5


def test_silhouette_in_packs_equals_broadcast_form(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = cloud(spark, rng.normal(size=(60, 3))).withColumn("label", F.col("id") % 7)
    once = M.silhouette(rows).first()["silhouette"]
    monkeypatch.setattr(M, "CLUSTERS_AT_ONCE", 3)
    assert M.silhouette(rows, id_col="id").first()["silhouette"] == pytest.approx(once)


def test_planted_outlier_ranks_first(spark):
    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(size=(500, 3)), [[9, 9, 9]]])
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    got = I.isolation_forest(rows, "id", ["a", "b", "c"], 50, 0.01).orderBy(F.desc("score")).first()
    assert got["id"] == 500 and got["is_anomaly"]


@pytest.fixture(scope="module")
def binary(spark):
    rows = spark.range(400).select(
        "id", ((F.col("id") * 37) % 101 / 10.0).alias("a"), ((F.col("id") * 53) % 89 / 10.0).alias("b"),
        F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 17 == 0, None).otherwise("y").alias("c"),
    )
    return I.prepare(rows.withColumn("t", F.when(F.col("a") + F.col("b") > 9, "hi").otherwise("lo")), "t", "classification", ["id"], test_size=0.25)


@pytest.mark.parametrize("family,params", [("logistic", {}), ("forest", {"trees": 10, "depth": 5}), ("mlp", {"hidden": (8,)}), ("gaussian_nb", {})])
def test_probabilities_sum_to_one(binary, family, params):
    from pyspark.ml.functions import vector_to_array

    model = I.fit(binary, family, **params)
    sums = model.transform(binary.val).select(F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda a, v: a + v).alias("s"))
    assert sums.agg(F.max(F.abs(F.col("s") - 1))).first()[0] < 1e-9
    assert I.score(model, binary.val, "classification", "accuracy") > 0.6


def test_metric_of_other_task_raises(binary):
    with pytest.raises(ValueError):
        I.score(I.fit(binary, "logistic"), binary.val, "classification", "rmse")


def test_shapley_adds_up(binary):
    model = I.fit(binary, "forest", trees=5, depth=4)
    sample = L.explain_sample(binary.val, ["id"], 20)
    phi = L.shapley_sampling(model, sample, L.explain_sample(binary.train, ["id"], 15), "id", 3)
    total = phi.groupBy("id").agg(F.sum("phi").alias("s"), F.max("base").alias("base"))
    both = total.join(L._predict(model, sample), "id")
    assert both.agg(F.max(F.abs(F.col("s") + F.col("base") - F.col("f")))).first()[0] < 1e-9


def test_permutation_importance_ranks_used_features(binary):
    model = I.fit(binary, "forest", trees=20, depth=6)
    got = L.permutation_importance(model, binary.train, "id", "classification", "accuracy").orderBy(F.desc("importance"))
    assert {r["feature"] for r in got.limit(2).collect()} == {0, 1}


def wide_rows(spark, n=60, width=1000, filled=6):
    """Sparse rows whose label follows a few slots."""
    r = np.random.default_rng(4)
    x = np.zeros((n, width))
    for row in x:
        row[r.choice(width, filled, replace=False)] = r.normal(size=filled)
    x[:, :4] = r.normal(size=(n, 4))
    y = 3 * x[:, 0] - 2 * x[:, 1] + x[:, 2] + 0.1 * r.normal(size=n)
    rows = [(i, float(y[i]), Vectors.sparse(width, {int(j): float(x[i, j]) for j in np.flatnonzero(x[i])})) for i in range(n)]
    return x, y, spark.createDataFrame(rows, ["id", "label", "features"])


def swapped_in_slot(df, x, j):
    """The rows in the first hash order, with slot j of the rows in the second one."""
    order = lambda seed: [r["id"] for r in df.orderBy(F.xxhash64("id", F.lit(seed))).select("id").collect()]
    first, second = order(42), order(43)
    out = []
    for slot in j:
        z = x[first].copy()
        z[:, slot] = x[second][:, slot]
        out.append(z)
    return first, out


def test_permutation_importance_of_wide_sparse_rows_is_brute_force(spark):
    x, y, df = wide_rows(spark)
    linear = LinearRegression(maxIter=20, regParam=0.1, solver="l-bfgs").fit(df)
    f = lambda z: z @ linear.coefficients.toArray() + linear.intercept
    first, tables = swapped_in_slot(df, x, range(x.shape[1]))
    for metric, error in (("rmse", lambda a, p: np.sqrt(np.mean((a - p) ** 2))), ("smape", lambda a, p: 100 * np.mean(abs(a - p) / ((abs(a) + abs(p)) / 2)))):
        got = {r["feature"]: r["importance"] for r in L.permutation_importance(linear, df, "id", "regression", metric).collect()}
        before = error(y, f(x))
        assert sorted(got) == list(range(x.shape[1]))
        for j, z in enumerate(tables):
            assert abs(got[j] - (error(y[first], f(z)) - before)) < 1e-9
    grades = df.withColumn("label", (F.col("label") > 0).cast("double"))
    logistic = LogisticRegression(maxIter=20, regParam=0.01).fit(grades)
    g = lambda z: z @ logistic.coefficients.toArray() + logistic.intercept > 0
    got = {r["feature"]: r["importance"] for r in L.permutation_importance(logistic, grades, "id", "classification", "accuracy").collect()}
    for j, z in enumerate(tables):
        assert abs(got[j] - (np.mean(g(x) == (y > 0)) - np.mean(g(z) == (y[first] > 0)))) < 1e-9


def test_stack_and_tune(binary):
    out, _ = J.stack(binary, {"a": ("logistic", {}), "b": ("forest", {"trees": 5, "depth": 4})}, ("logistic", {}), "id", 3)
    assert out.count() == binary.val.count()
    assert M.accuracy(out, "label", "prediction").first()[0] > 0.7
    table, _, params = J.tune(binary, "forest", {"trees": ("int", 3, 8), "depth": ("int", 2, 5)}, trials=3, metric="accuracy")
    assert table.count() == 3 and set(params) == {"trees", "depth"}


def test_additive_attribution_is_exact(spark):
    df = spark.createDataFrame([(i, float(i), float(i * i % 7)) for i in range(50)], "id long, a double, b double")
    w = spark.createDataFrame([("a", 2.0), ("b", -1.5)], "feature string, weight double")
    total = L.linear_attribution(df, w, "id").groupBy("id").agg(F.sum("phi").alias("s")).join(df, "id")
    means = df.agg(F.avg("a"), F.avg("b")).first()
    gap = F.abs(F.col("s") - (2.0 * (F.col("a") - means[0]) - 1.5 * (F.col("b") - means[1])))
    assert total.agg(F.max(gap)).first()[0] < 1e-9


def test_vector_helper(spark):
    assert cloud(spark, [[1, 2]]).select(array_to_vector("features")).count() == 1


def test_components_of_very_wide_sparse_rows(spark):
    """5,000 columns: components as a direct decomposition finds them, without a square matrix of the width."""
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(3)
    width, n, k = 5000, 120, 4
    x = np.zeros((n, width))
    for j in range(k):
        x[:, rng.choice(width, 40, replace=False)] += rng.normal(size=(n, 1)) * (3 * (k - j))
    x += (rng.random((n, width)) < 0.002) * rng.normal(size=(n, width))
    rows = [(i, Vectors.sparse(width, np.flatnonzero(r).tolist(), r[r != 0].tolist())) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, ["id", "features"]).withColumn("note", F.lit("n"))
    got = X.pca_reduce(df, "features", k).orderBy("id").collect()
    centred = x - x.mean(0)
    u, s, _ = np.linalg.svd(centred, full_matrices=False)
    want = u[:, :k] * s[:k]
    found = np.array([r["pca"].toArray() for r in got])
    assert np.allclose(np.abs(found), np.abs(want), atol=1e-6 * s[0]) and got[0]["note"] == "n"


def test_dictionary_codes(spark, tmp_path):
    rows = spark.createDataFrame([(i, "abc"[i % 3] if i % 5 else None, f"v{i:03d}") for i in range(60)], "id long, a string, b string")
    fitted = I.build_features(rows, None, ["id"]).fit(rows)
    other = spark.createDataFrame([(1, "b", "v007"), (2, "z", None), (3, None, "new")], rows.schema)
    cells = {}
    for r in E.vector_cells(fitted.transform(other), "id", "features").collect():
        cells.setdefault(r["id"], {})[r["i"]] = r["x"]
    assert cells == {1: {1: 1.0, 3 + 7: 1.0}, 2: {3: 1.0}, 3: {0: 1.0}}
    fitted.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m")).transform(other)
    assert {(r["id"], r["i"]) for r in E.vector_cells(again, "id", "features").collect()} == {(k, i) for k, v in cells.items() for i in v}


def test_mixtures_of_repeated_rows_are_fitted_to_points(spark, monkeypatch):
    """Rows that repeat: MLlib only draws the first mixture, and what is found is what its own rounds find."""
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, 0.6, size=(30, 2)) for c in (0, 5, 10)])
    rows = K.materialize(cloud(spark, np.vstack([x, x[::2], x[::3], x[::3]])), "mixture-rows")
    want, every = {}, K._vectors(rows)
    for k in (3,):
        out = K.MC.GaussianMixture(k=k, seed=42, featuresCol="__v").fit(every).transform(every)
        want[k] = M.silhouette(out.select("id", "features", F.col("prediction").alias("label"))).first()["silhouette"]
    rounds, fit = [], K.MC.GaussianMixture.fit
    monkeypatch.setattr(K.MC.GaussianMixture, "fit", lambda self, df, *a: (rounds.append(self.getMaxIter()), fit(self, df, *a))[1])
    labels, table = K.gmm_sweep(rows, "id", [3])
    assert rounds == [0] and labels.count() == rows.count()
    assert {r["k"]: r["silhouette"] for r in table.collect()} == pytest.approx(want)


def test_far_pairs_are_not_measured():
    """Wide blocks whose points are hardly ever within reach: exact distances of those that are, to the bit, and none of the others."""
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(1024, 64)), rng.normal(size=(1024, 64))
    y[:50] = x[:50] + rng.normal(0, 0.05, size=(50, 64))
    a, b = (pd.DataFrame({"x": list(v)}) for v in (x, y))
    every = np.stack([((v - y) ** 2).sum(axis=1) for v in x])
    limit = float(every[3, 3])  # one pair right at the limit
    got = K._squares(a, b, limit)
    assert (got == np.where(every <= limit, every, np.inf)).all() and got[3, 3] == limit
    assert (K._squares(a, b, 1e9) == every).all()


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_points_meet_tile_by_tile(spark, monkeypatch, shift):
    """No pairs of chunks are dealt to tasks: tiles of a bounded size pass by the points, which finds the same clusters."""

    def dealt(*_):
        raise AssertionError("points move once for each chunk that they meet")

    monkeypatch.setattr(P, "paired", dealt, raising=False)
    for module, name, value in ((K, "CHUNK_POINTS", 25), (P, "TILE_NUMBERS", 150), (P, "NEAR_POINTS", 64), (K, "FOREST_EDGES", 40)):
        monkeypatch.setattr(module, name, value)
    x = np.random.default_rng(9).uniform(0, 8, size=(260, 2)).round(3)
    x = np.vstack([x, x[:30], np.full((20, 2), 4.0)]) + shift
    want = brute_density(x, 0.55, 5)
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= 0.55**2
    assert want.max() >= 3 and (want < 0).any() and (want[near.sum(1) < 5] >= 0).any()  # several clusters, noise and border points
    got = {r["id"]: r["label"] for r in K.dbscan(cloud(spark, x), "id", 0.55, 5, 60).collect()}
    assert [got[i] for i in range(len(x))] == want.tolist()


def test_tiles_are_bounded_whatever_the_number_of_groups():
    ends = P.tile_ends(np.array([40, 70, 10, 500, 30, 30]), 2, 200)
    assert ends == [(0, 1), (1, 3), (3, 4), (4, 6)]


def test_labels_of_rows_are_sent_once(spark):
    """A point's vector is neither copied for each salt nor, if many rows hold it, dealt to one task."""
    rows = cloud(spark, [[float(i % 40 if i % 2 else 7)] for i in range(400)])
    points = rows.groupBy(F.col("features").alias("x")).agg(F.count("*").alias("w")).withColumn("trial", F.lit(0)).withColumn("label", F.element_at("x", 1).cast("int"))
    found = K._label_rows(rows, "id", points)
    assert "CartesianProduct" not in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and "__salt" not in plan
    got = {r["id"]: (r["features"], r["label"]) for r in found.collect()}
    assert got == {i: ([float(i % 40 if i % 2 else 7)], i % 40 if i % 2 else 7) for i in range(400)}


def test_tables_of_nodes_never_pass_through_the_driver(spark, monkeypatch):
    """A row for each node is moved by key, however small the files are; only tables of a fixed size are broadcast."""
    plans, write, by_k = [], K.materialize, K._by_k

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(K, "materialize", lambda df, label: write(seen(df) if label.startswith(("graph-", "spectral-vectors")) else df, label))
    monkeypatch.setattr(K, "_by_k", lambda out, *rest: by_k(seen(out), *rest))
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, 0.5, size=(500, 2)) for c in (0, 8, 16)])
    labels, _ = K.spectral(cloud(spark, x), "id", [3], neighbours=6)
    groups = np.array([r["label"] for r in labels.orderBy("id").collect()]).reshape(3, -1)
    assert all(len(set(g)) == 1 for g in groups) and len({g[0] for g in groups}) == 3
    assert sum("SortMergeJoin" in p for p in plans) > 5 and not any("Broadcast" in p for p in plans)


def test_bounds_of_queries_are_moved_by_key(spark, monkeypatch):
    plans, write = [], I.materialize

    def seen(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(I, "materialize", seen)
    rows = cloud(spark, np.random.default_rng(7).normal(size=(90, 3)))
    assert I.nearest(rows, rows, 3, cell_points=25).count() == 270
    assert any("LeftOuter" in p for p in plans) and not any("LeftOuter, BuildRight" in p for p in plans)
