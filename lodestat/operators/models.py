"""Supervised models on MLlib: feature pipelines, model families, presets, nearest neighbours, isolation forest."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import feature as MF
from pyspark.ml import regression as R
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions.columns import NUMERIC, TEXT, columns_of_kind, q
from lodestat.operators import metrics as M
from lodestat.operators.encoding import TextCodes
from lodestat.operators.features import split_random
from lodestat.operators.profile import column_quantiles, top_values
from lodestat.plans.blocks import BLOCK_POINTS, block_pairs, paired
from lodestat.plans.pivots import CELL_POINTS, Cells, cells_of, choose_pivots, matrix, norms, placed
from lodestat.plans.quantiles import exact_quantiles
from lodestat.session import materialize
from lodestat.sources.tables import metric_sign

# Parameter presets per family.
FOREST_PRESETS = {
    "fast_forest": {"trees": 50, "depth": 8, "min_split": 10},
    "balanced_forest": {"trees": 100, "depth": 15, "min_split": 5},
    "deep_forest": {"trees": 200, "depth": 30, "min_split": 2},
}
BOOSTING_PRESETS = {
    "fast_boost": {"rounds": 100, "rate": 0.1, "depth": 4},
    "balanced_boost": {"rounds": 300, "rate": 0.05, "depth": 6},
    "precise_boost": {"rounds": 500, "rate": 0.01, "depth": 8},
}
LOGISTIC_PRESETS = {"l2": {"C": 1.0, "penalty": "l2"}, "l1": {"C": 1.0, "penalty": "l1"}}


# Per size, the first layer as (multiple of the features, least, most) and the least width of each
# further layer, which halves the one before it.
LAYER_RULES = {
    "simple": ((2, 32, 128), ()),
    "balanced": ((3, 64, 256), (32,)),
    "complex": ((4, 128, 512), (64, 32)),
}


def mlp_layers(n_features: int, size: str = "simple") -> list[int]:
    """Hidden layer widths derived from the feature count."""
    if size not in LAYER_RULES:
        raise ValueError(f"unknown layer preset {size!r}")
    (multiple, least, most), narrower = LAYER_RULES[size]
    widths = [sorted((least, multiple * n_features, most))[1]]
    for floor in narrower:
        widths.append(max(floor, widths[-1] // 2))
    return widths


def _literal(value: object) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(float(value))


def build_features(
    train: DataFrame, target: str | None = None, exclude: Sequence[str] = (), k: int | None = None, task: str = "classification",
    label: str = "label", output: str = "features",
) -> Pipeline:
    """Unfitted feature pipeline with statistics from ``train`` only.

    Numbers: median for missing values, then standard scaling. Text: most frequent value for missing
    values, then one slot per category from a distributed dictionary; a category unseen in training becomes all zeros. Optionally
    the ``k`` best features by univariate F.
    """
    skip = {target, *exclude}
    numbers = [c for c in columns_of_kind(train, NUMERIC) if c not in skip]
    texts = [c for c in columns_of_kind(train, TEXT) if c not in skip]
    fills, stages = [], []
    if numbers:
        medians = {r["column_name"]: r["median"] for r in column_quantiles(train, {"median": 0.5}, numbers).collect()}
        fills += [
            f"coalesce(nanvl(CAST(`{c}` AS DOUBLE), NULL), {_literal(medians.get(c, 0.0) or 0.0)}) AS `__n_{c}`" for c in numbers
        ]
    if texts:
        modes = {r["column_name"]: r["value"] for r in top_values(train, 1, texts).collect()}
        fills += [f"coalesce(`{c}`, {_literal(modes.get(c) or '')}) AS `__t_{c}`" for c in texts]
    stages.append(MF.SQLTransformer(statement=f"SELECT *, {', '.join(fills)} FROM __THIS__"))
    parts = []
    if numbers:
        stages += [
            MF.VectorAssembler(inputCols=[f"__n_{c}" for c in numbers], outputCol="__numbers"),
            MF.StandardScaler(inputCol="__numbers", outputCol="__scaled", withMean=True, withStd=True),
        ]
        parts.append("__scaled")
    if texts:
        stages.append(TextCodes([f"__t_{c}" for c in texts], [f"__o_{c}" for c in texts]))
        parts += [f"__o_{c}" for c in texts]
    if k is None:
        stages.append(MF.VectorAssembler(inputCols=parts, outputCol=output))
    else:
        stages.append(MF.VectorAssembler(inputCols=parts, outputCol="__all"))
        selector = MF.UnivariateFeatureSelector(featuresCol="__all", outputCol=output, labelCol=label, selectionMode="numTopFeatures")
        kind = "categorical" if task == "classification" else "continuous"
        stages.append(selector.setFeatureType("continuous").setLabelType(kind).setSelectionThreshold(k))
    return Pipeline(stages=stages)


def label_stage(target: str, task: str, label: str = "label") -> object:
    """Numeric label column: class index in value order, or the target as a double."""
    if task == "classification":
        return MF.StringIndexer(inputCol=target, outputCol=label, stringOrderType="alphabetAsc", handleInvalid="error")
    return MF.SQLTransformer(statement=f"SELECT *, CAST(`{target}` AS DOUBLE) AS `{label}` FROM __THIS__")


def logistic(c: float = 1.0, penalty: str = "l2", n: int = 1000, max_iter: int = 2000, tol: float = 1e-4, **_: object) -> C.LogisticRegression:
    """Logistic regression; C is the inverse penalty on the summed loss, as for n training rows.

    Features come scaled where they should be, so the penalty is on their coefficients as they are.
    """
    return C.LogisticRegression(
        maxIter=max_iter, tol=tol, regParam=1.0 / (c * n), elasticNetParam=1.0 if penalty == "l1" else 0.0, standardization=False
    )


def make_model(family: str, task: str, n_classes: int = 2, n_features: int = 0, n_rows: int = 1000, seed: int = 42, **p: object) -> Estimator:
    """Estimator of a family; ``p`` are preset or tuned parameters."""
    classify = task == "classification"
    if family in ("logistic", "l1", "l2", "baseline") and classify:
        return logistic(float(p.get("C", 1.0)), str(p.get("penalty", "l1" if family == "l1" else "l2")), n_rows)
    if family in ("linear", "baseline") and not classify:
        return R.LinearRegression(regParam=0.0)
    if family in ("ridge", "l2") and not classify:
        return R.LinearRegression(regParam=float(p.get("alpha", 1.0)) / n_rows, elasticNetParam=0.0, standardization=False)
    if family in ("lasso", "l1") and not classify:
        return R.LinearRegression(regParam=float(p.get("alpha", 1.0)), elasticNetParam=1.0, standardization=False)
    if family == "forest":
        forest = C.RandomForestClassifier if classify else R.RandomForestRegressor
        per_leaf = max(1, int(p.get("min_split", 2)) // 2)
        return forest(numTrees=int(p.get("trees", 100)), maxDepth=min(30, int(p.get("depth", 15))), minInstancesPerNode=per_leaf, seed=seed)
    if family == "boosting":
        boost = C.GBTClassifier if classify else R.GBTRegressor
        model = boost(maxIter=int(p.get("rounds", 100)), stepSize=float(p.get("rate", 0.1)), maxDepth=int(p.get("depth", 4)), seed=seed)
        return C.OneVsRest(classifier=model) if classify and n_classes > 2 else model
    if family == "mlp" and classify:
        hidden = [int(v) for v in p.get("hidden", mlp_layers(n_features))]
        return C.MultilayerPerceptronClassifier(
            layers=[n_features, *hidden, n_classes], maxIter=int(p.get("max_iter", 100)), seed=seed,
            # Steps of a given size are plain gradient descent; without one the solver finds its own.
            **({"solver": "gd", "stepSize": float(p["learning_rate"])} if "learning_rate" in p else {}),
        )
    if family == "linear_svm" and classify:
        model = C.LinearSVC(regParam=1.0 / (float(p.get("C", 1.0)) * n_rows), maxIter=int(p.get("max_iter", 100)), standardization=False)
        return C.OneVsRest(classifier=model) if n_classes > 2 else model
    if family == "gaussian_nb" and classify:
        return C.NaiveBayes(modelType="gaussian")
    raise ValueError(f"no {family} model for {task}")


@dataclass
class Prepared:
    """Training and validation frames with ``features`` and ``label``, and what produced them."""

    task: str
    train: DataFrame
    val: DataFrame
    features: PipelineModel
    n_features: int
    n_classes: int
    n_rows: int
    labels: list[str] = field(default_factory=list)


def prepare(
    df: DataFrame, target: str, task: str, key: Sequence[str], exclude: Sequence[str] = (), k: int | None = None, seed: int = 42,
    test_size: float | None = None,
) -> Prepared:
    """Split, fit the feature pipeline on the training part, transform both parts once.

    A class of one row is an error; with a class below five rows the split is not stratified.
    """
    rows, stratify = df.filter(q(target).isNotNull()), None
    if task == "classification":
        least = rows.groupBy(q(target)).count().agg(F.min("count")).first()[0]
        if least is not None and least < 2:
            raise ValueError(f"a class of {target!r} has only one row; each class needs two at least")
        stratify = target if least and least >= 5 else None
    parts = split_random(rows, key, test_size, seed, stratify)
    parts = materialize(parts, "parts")
    train, val = parts.filter(~F.col("is_test")), parts.filter("is_test")
    features = build_features(train, target, [*key, *exclude, "is_test"], k, task)
    fitted = Pipeline(stages=[label_stage(target, task), *features.getStages()]).fit(train)
    keep = [*key, target, "label", "features"]
    train, val = (materialize(fitted.transform(x).select(*keep), "features") for x in (train, val))
    labels = list(fitted.stages[0].labels) if task == "classification" else []
    return Prepared(task, train, val, fitted, train.first()["features"].size, len(labels) or 1, train.count(), labels)


def fit(prepared: Prepared, family: str, **params: object) -> Model:
    """Fit one family on the prepared training part."""
    model = make_model(family, prepared.task, prepared.n_classes, prepared.n_features, prepared.n_rows, **params)
    return model.fit(prepared.train)


def score(model: Model, rows: DataFrame, task: str, metric: str) -> float:
    """One metric of a fitted model on rows with features and label."""
    metric_sign(metric)
    predicted = model.transform(rows)
    if task == "classification":
        found = M.classification_metrics(predicted, "label", "prediction")
    else:
        found = M.regression_metrics(predicted, "label", "prediction")
    if metric not in found.columns:
        raise ValueError(f"metric {metric!r} does not apply to {task}")
    return float(found.first()[metric])


def pipeline_of(prepared: Prepared, model: Model) -> PipelineModel:
    """Feature steps and model as one scoring pipeline (without the label step)."""
    return PipelineModel(stages=[*prepared.features.stages[1:], model])


RUN_SCHEMA = "run_id string, model string, family string, metric string, train_score double, score double"


def _run(prepared: Prepared, run_id: str, name: str, family: str, metric: str, params: dict) -> tuple[tuple, Model]:
    model = fit(prepared, family, **params)
    row = (
        run_id, name, family, metric,
        score(model, prepared.train, prepared.task, metric),
        score(model, prepared.val, prepared.task, metric),
    )
    return row, model


def train_families(prepared: Prepared, families: dict[str, dict], metric: str, run_id: str = "run") -> tuple[DataFrame, dict[str, Model]]:
    """Fit several families; a leaderboard frame and the fitted models."""
    spark = prepared.train.sparkSession
    rows, models = [], {}
    for family, params in families.items():
        row, models[family] = _run(prepared, run_id, family, family, metric, params)
        rows.append(row)
    return spark.createDataFrame(rows, RUN_SCHEMA), models


def train_architectures(prepared: Prepared, presets: dict[str, tuple[str, dict]], metric: str, run_id: str = "run") -> tuple[DataFrame, dict[str, Model]]:
    """Fit named presets (name -> (family, parameters)) such as the forest or boosting presets."""
    spark = prepared.train.sparkSession
    rows, models = [], {}
    for name, (family, params) in presets.items():
        row, models[name] = _run(prepared, run_id, name, family, metric, params)
        rows.append(row)
    return spark.createDataFrame(rows, RUN_SCHEMA), models


# --- Nearest neighbours ----------------------------------------------------------------------------


TILE_ROWS = 256


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices, so that a table of distances has at most ``TILE_ROWS`` rows."""
    for b in batches:
        for i in range(0, b.num_rows, TILE_ROWS):
            yield b.slice(i, TILE_ROWS)


def _closest(k: int):
    """The ``k`` nearest right rows of each left row of a block, ties by id."""

    def closest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        x, y = np.stack(left["x"].to_numpy()).astype(float), np.stack(right["x"].to_numpy()).astype(float)
        ids, found = right["id"].to_numpy(), []
        take = min(k, len(ids))
        for i in range(0, len(x), TILE_ROWS):
            part = x[i : i + TILE_ROWS]
            d = np.maximum((part**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * part @ y.T, 0.0)
            # Everything up to the k-th distance is kept, so ties are settled by id below.
            kth = np.partition(d, take - 1, axis=1)[:, take - 1 : take]
            at, cols = np.nonzero(d <= kth * (1 + 1e-9) + 1e-12)
            found.append((at + i, cols))
        rows, cols = (np.concatenate(v) for v in zip(*found))
        exact = np.sqrt(((x[rows] - y[cols]) ** 2).sum(1))
        out = pd.DataFrame({"id": left["id"].to_numpy()[rows], "neighbour": ids[cols], "distance": exact})
        return out.sort_values(["id", "distance", "neighbour"]).groupby("id").head(k)

    return closest


def first_cells(queries: DataFrame, cells: Cells, k: int) -> DataFrame:
    """(id, x, cells): for each query the nearest cells that hold ``k`` rows together."""

    def rows(batches):
        for b in _tiles(batches):
            order = np.argsort(norms(matrix(b["x"]), cells.pivots), axis=1, kind="stable")
            held = np.cumsum(cells.sizes[order], axis=1)
            needed = np.minimum((held < k).sum(axis=1) + 1, order.shape[1])
            lists = [o[:n].tolist() for o, n in zip(order, needed)]
            yield pa.RecordBatch.from_arrays([b["id"], b["x"], pa.array(lists, pa.list_(pa.int32()))], ["id", "x", "cells"])

    id_type = queries.schema["id"].dataType.simpleString()
    return queries.select("id", "x").mapInArrow(rows, f"id {id_type}, x array<double>, cells array<int>")


def second_cells(asked: DataFrame, cells: Cells) -> DataFrame:
    """(id, x, cells): the other cells that may hold a row within ``bound`` of the query; a null bound excludes none."""

    def rows(batches):
        for b in _tiles(batches):
            x = matrix(b["x"])
            bound = b["bound"].fill_null(np.inf).to_numpy(zero_copy_only=False)
            wanted = (cells.bounds(x) <= bound[:, None]) & (cells.sizes > 0)[None, :]
            for row, seen in enumerate(b["cells"].to_pylist()):
                wanted[row, seen] = False
            lists = [np.flatnonzero(w).tolist() for w in wanted]
            yield pa.RecordBatch.from_arrays([b["id"], b["x"], pa.array(lists, pa.list_(pa.int32()))], ["id", "x", "cells"])

    id_type = asked.schema["id"].dataType.simpleString()
    return asked.select("id", "x", "cells", "bound").mapInArrow(rows, f"id {id_type}, x array<double>, cells array<int>")


def _visit(asked: DataFrame, base: DataFrame, cells: Cells, k: int) -> DataFrame:
    """The ``k`` nearest rows of each cell chunk that a query visits."""
    spark = asked.sparkSession
    visits = materialize(asked.select("id", "x", F.explode("cells").alias("cell")), "knn-visits")
    counts = visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a cell
    table = [(r["cell"], -(-r["n"] // BLOCK_POINTS), -(-int(cells.sizes[r["cell"]]) // BLOCK_POINTS)) for r in counts]
    sizes = spark.createDataFrame(table, "cell int, na int, nb int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = visits.join(F.broadcast(sizes), "cell").select("id", "x", "cell", part("na").alias("a"), every("nb").alias("b"))
    right = base.join(F.broadcast(sizes), "cell").select("id", "x", "cell", part("nb").alias("b"), every("na").alias("a"))
    id_type = asked.schema["id"].dataType.simpleString()
    base_type = base.schema["id"].dataType.simpleString()
    return paired(left, right, ["cell", "a", "b"], _closest(k), f"id {id_type}, neighbour {base_type}, distance double")


def nearest(
    queries: DataFrame, base: DataFrame, k: int, id_col: str = "id", features: str = "features", cell_points: int = CELL_POINTS
) -> DataFrame:
    """Exact ``k`` nearest base rows per query row: (id, neighbour, distance, rank).

    Base rows are dealt to cells around pivots. A query first meets the cells next to it that hold ``k`` rows; the k-th
    distance there bounds the second round, in which it meets only cells that can hold a row within it. Work runs on chunk
    pairs and returns at most ``k`` rows per query and chunk.
    """
    double = F.transform(features, lambda v: v.cast("double")).alias("x")
    a = queries.select(F.col(id_col).alias("id"), double)
    b = base.select(F.col(id_col).alias("id"), double)
    order = Window.partitionBy("id").orderBy("distance", "neighbour")
    top = lambda df: df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    n = b.count()
    if n <= cell_points:
        types = a.schema["id"].dataType.simpleString(), b.schema["id"].dataType.simpleString()
        return top(block_pairs(a, b, "id", "id", _closest(k), f"id {types[0]}, neighbour {types[1]}, distance double"))
    pivots = choose_pivots(b, n, cell_points)
    held = materialize(placed(b, pivots), "knn-base")
    cells = cells_of(held, pivots)
    asked = materialize(first_cells(a, cells, k), "knn-queries")
    found = materialize(top(_visit(asked, held, cells, k)).drop("rank"), "knn-first")
    kth = found.groupBy("id").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("bound"))
    bounded = asked.join(kth.hint("merge"), "id", "left")  # a row for each query, however small its file
    more = _visit(second_cells(bounded, cells), held, cells, k)
    return top(found.unionByName(more))


def knn_predict(train: DataFrame, test: DataFrame, k: int, label: str, task: str, id_col: str = "id", features: str = "features") -> DataFrame:
    """Majority class (smallest on ties) or mean of the ``k`` nearest training rows."""
    found = nearest(test, train, k, id_col, features)
    voted = found.join(train.select(F.col(id_col).alias("neighbour"), F.col(label).alias("__y")), "neighbour")
    if task == "regression":
        out = voted.groupBy("id").agg(F.avg("__y").alias("prediction"))
    else:
        votes = voted.groupBy("id", "__y").agg(F.count(F.lit(1)).alias("n"))
        out = votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "__y")).alias("v")).select("id", F.col("v.__y").alias("prediction"))
    return out.withColumnRenamed("id", id_col)


def gaussian_moments(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Prior, mean and population variance per class and feature."""
    rows = df.select(q(label).alias("label"), *[q(c).cast("double").alias(c) for c in columns])
    long = rows.unpivot(["label"], [q(c) for c in columns], "feature", "v")
    stats = long.groupBy("label", "feature").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("variance"))
    totals = stats.groupBy("feature").agg(F.sum("n").alias("__t"))
    return stats.join(F.broadcast(totals), "feature").select(
        "label", "feature", (F.col("n") / F.col("__t")).alias("prior"), "mean", "variance"
    )


# --- Isolation forest ------------------------------------------------------------------------------

ISOLATION_SAMPLE = 256
# Fixed values: (trees, contamination) presets.
ISOLATION_PRESETS = {"fast_isolation": (50, 0.1), "balanced_isolation": (100, 0.05), "thorough_isolation": (200, 0.01)}


def _expected_depth(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    c = 2 * (np.log(safe - 1 + (safe <= 1)) + 0.5772156649015329) - 2 * (safe - 1) / safe
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, limit: int, rng: np.random.Generator) -> list[tuple[int, float, int, int, int]]:
    """Random tree as (feature, threshold, left, right, size) nodes; feature -1 marks a leaf."""
    nodes: list = []

    def split(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append(None)
        part = x[rows]
        spread = np.nonzero(part.max(0) > part.min(0))[0] if len(rows) else np.array([], int)
        if depth >= limit or len(rows) <= 1 or not len(spread):
            nodes[at] = (-1, 0.0, -1, -1, len(rows))
            return at
        f = int(rng.choice(spread))
        cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
        goes_left = part[:, f] < cut
        left = split(rows[goes_left], depth + 1)
        right = split(rows[~goes_left], depth + 1)
        nodes[at] = (f, cut, left, right, len(rows))
        return at

    split(np.arange(len(x)), 0)
    return nodes


def isolation_forest(
    df: DataFrame, id_col: str, columns: Sequence[str], trees: int = 100, contamination: float = 0.05, seed: int = 42
) -> DataFrame:
    """Anomaly score per row and a flag for the highest ``contamination`` share (Liu, Ting and Zhou 2008).

    Every tree grows from about 256 rows drawn by hash, so building is one small group per tree; the
    forest itself has a fixed size bound and travels with the scoring code. Missing values count as the
    column's median (0 if it has no value).
    """
    columns = list(columns)
    medians = {r["column_name"]: r["median"] for r in column_quantiles(df, {"median": 0.5}, columns).collect()}
    filled = [F.coalesce(F.nanvl(q(c).cast("double"), F.lit(None)), F.lit(float(medians.get(c) or 0.0))) for c in columns]
    rows = df.select(F.col(id_col).alias("id"), F.array(*filled).alias("x"))
    n = rows.count()
    rate = trees * ISOLATION_SAMPLE / max(1, n)
    whole, rest = int(rate), rate - int(rate)
    extra = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_003)) < int(rest * 1_000_003)).cast("int")
    copies = rows.withColumn("__k", F.lit(whole) + extra).filter(F.col("__k") > 0).withColumn("__j", F.explode(F.sequence(F.lit(1), F.col("__k"))))
    drawn = copies.withColumn("tree", F.pmod(F.xxhash64("id", "__j", F.lit(seed + 1)), F.lit(trees)).cast("int"))
    limit = math.ceil(math.log2(ISOLATION_SAMPLE))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        tree = int(frame["tree"].iloc[0])
        frame = frame.sort_values(["id", "__j"])
        nodes = _grow(np.stack(frame["x"].to_numpy()), limit, np.random.default_rng(seed * 100_003 + tree))
        return pd.DataFrame({"tree": [tree], "nodes": [[list(map(float, node)) for node in nodes]], "size": [len(frame)]})

    grown = drawn.groupBy("tree").applyInPandas(build, "tree int, nodes array<array<double>>, size int").orderBy("tree").collect()
    forest = [(np.array(r["nodes"], dtype=float), r["size"]) for r in grown]
    norm = float(_expected_depth(float(np.mean([s for _, s in forest]))))

    def rate_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            x = np.stack(batch["x"].to_numpy())
            total = np.zeros(len(x))
            for nodes, _ in forest:
                at, depth = np.zeros(len(x), dtype=int), np.zeros(len(x))
                for _ in range(limit):
                    f = nodes[at, 0].astype(int)
                    inner = f >= 0
                    if not inner.any():
                        break
                    value = x[np.arange(len(x)), np.maximum(f, 0)]
                    nxt = np.where(value < nodes[at, 1], nodes[at, 2], nodes[at, 3]).astype(int)
                    at, depth = np.where(inner, nxt, at), depth + inner
                total += depth + _expected_depth(nodes[at, 4])
            score = 2.0 ** (-(total / len(forest)) / norm)
            yield pd.DataFrame({"id": batch["id"], "score": score})

    id_type = rows.schema["id"].dataType.simpleString()
    scored = materialize(rows.mapInPandas(rate_rows, f"id {id_type}, score double"), "isolation-scores")
    cut = exact_quantiles(scored, [], "score", {"cut": 1 - contamination}).select("cut")
    return scored.crossJoin(F.broadcast(cut)).select(  # one-row side
        F.col("id").alias(id_col), "score", (F.col("score") > F.col("cut")).alias("is_anomaly")
    )
