"""Tuning by random draws, voting, averaging and stacking."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml import feature as MF
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.operators.models import Prepared, fit, make_model, mlp_layers, score
from lodestat.plans.skew import join_on
from lodestat.session import materialize
from lodestat.sources.tables import metric_sign

# Search ranges per family as (kind, low, high) or a list of choices.
SPACES = {
    "baseline": {"C": ("log", 1e-3, 1e3)},
    "boosting": {"rate": ("log", 1e-3, 0.3), "rounds": ("int", 100, 600)},
    "forest": {"trees": ("int", 50, 200), "depth": ("int", 3, 25)},
    "mlp": {"hidden": [(128,), (128, 64), (256, 128, 64)], "learning_rate": ("log", 1e-4, 1e-1)},
}
# Fixed values.
DEFAULT_TRIALS, FEW_ROWS, FEW_TRIALS = 20, 100, 5


def draws(space: dict, trials: int, seed: int = 42) -> list[dict]:
    """Random parameter sets from a search space."""
    rng = random.Random(seed)

    def one(spec: object) -> object:
        if isinstance(spec, list):
            return rng.choice(spec)
        kind, low, high = spec
        if kind == "log":
            return math.exp(rng.uniform(math.log(low), math.log(high)))
        if kind == "int":
            return rng.randint(low, high)
        return rng.uniform(low, high)

    return [{name: one(spec) for name, spec in space.items()} for _ in range(trials)]


# How far a preset's value may move, as (kind, (factor, shift) down, (factor, shift) up, least).
MOVES = {
    "rate": ("float", (0.5, 0), (2, 0), 0),
    "rounds": ("int", (1, -100), (1, 200), 50),
    "trees": ("int", (1, -50), (1, 100), 10),
    "depth": ("int", (1, -5), (1, 10), 3),
    "learning_rate": ("log", (0.1, 0), (10, 0), 0),
}


def near(preset: dict) -> dict:
    """Search space close to a preset's values; what has no rule keeps its value."""

    def space(name: str, value: object) -> object:
        if name not in MOVES:
            return [value]
        kind, down, up, least = MOVES[name]
        low, high = (factor * value + shift for factor, shift in (down, up))
        return kind, max(least, low), high

    return {name: space(name, value) for name, value in preset.items()}


TRIAL_SCHEMA = "trial int, family string, params string, score double"


def tune(
    prepared: Prepared, family: str, space: dict | None = None, trials: int | None = None, metric: str = "f1", seed: int = 42, parallelism: int = 2
) -> tuple[DataFrame, Model, dict]:
    """Random search on one holdout: trial table, best model and its parameters.

    ``trials`` are made as asked; by default 20, or 5 below 100 training rows. Each fit is a distributed job, a few
    run side by side.
    """
    sign = metric_sign(metric)
    if trials is None:
        trials = FEW_TRIALS if prepared.n_rows < FEW_ROWS else DEFAULT_TRIALS
    candidates = draws(space if space is not None else SPACES[family], trials, seed)
    spark = prepared.train.sparkSession

    def attempt(params: dict) -> tuple[Model, float]:
        model = fit(prepared, family, **params)
        return model, score(model, prepared.val, prepared.task, metric)

    with ThreadPool(parallelism) as pool:
        done = pool.map(inheritable_thread_target(spark)(attempt), candidates)
    table = spark.createDataFrame(
        [(i, family, str(sorted(p.items())), s) for i, (p, (_, s)) in enumerate(zip(candidates, done))], TRIAL_SCHEMA
    )
    best = max(range(len(done)), key=lambda i: (sign * done[i][1], -i))
    return table, done[best][0], candidates[best]


def vote_soft(predictions: DataFrame, id_col: str, probabilities: str = "probability") -> DataFrame:
    """Mean class probability over models, arg-max class (smallest index on ties)."""
    cells = predictions.select(id_col, F.posexplode(probabilities).alias("cls", "p"))
    means = cells.groupBy(id_col, "cls").agg(F.avg("p").alias("p"))
    best = means.groupBy(id_col).agg(F.max(F.struct("p", (-F.col("cls")).alias("c"))).alias("b"))
    return best.select(id_col, (-F.col("b.c")).alias("prediction"), F.col("b.p").alias("probability"))


def vote_hard(predictions: DataFrame, id_col: str, prediction: str = "prediction") -> DataFrame:
    """Majority class over models, smallest on ties."""
    votes = predictions.groupBy(id_col, prediction).agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy(id_col).agg(F.min(F.struct((-F.col("n")).alias("n"), prediction)).alias("b"))
    return best.select(id_col, F.col(f"b.{prediction}").alias("prediction"))


def average_regressors(predictions: DataFrame, id_col: str, prediction: str = "prediction") -> DataFrame:
    """Mean prediction over models."""
    return predictions.groupBy(id_col).agg(F.avg(prediction).alias("prediction"))


def model_predictions(models: dict[str, Model], rows: DataFrame, id_col: str) -> DataFrame:
    """Long table (id, model, prediction, probability) of fitted models on prepared rows."""
    from pyspark.ml.functions import vector_to_array

    out = None
    for name, model in models.items():
        scored = model.transform(rows)
        has = "probability" in scored.columns
        probability = vector_to_array("probability") if has else F.lit(None).cast("array<double>")
        part = scored.select(id_col, F.lit(name).alias("model"), "prediction", probability.alias("probability"))
        out = part if out is None else out.unionByName(part)
    return out


def _wide(predictions: DataFrame, id_col: str, names: Sequence[str]) -> DataFrame:
    return predictions.groupBy(id_col).agg(
        *[F.max(F.when(F.col("model") == m, F.col("prediction"))).alias(f"p_{m}") for m in names]
    )


def stack(
    prepared: Prepared, models: dict[str, tuple[str, dict]], meta: tuple[str, dict], id_col: str, folds: int = 5
) -> tuple[DataFrame, Model]:
    """Stacked predictions on the validation part and the fitted meta-learner.

    Folds come from a hash of the row id. Each base model predicts the fold it did not see; the
    meta-learner is trained on those predictions, and the base models are refitted on all training rows.
    """
    names = list(models)
    folded = prepared.train.withColumn("__fold", F.pmod(F.xxhash64(id_col), F.lit(folds)))
    outside = None
    for i in range(folds):
        seen, held = folded.filter(F.col("__fold") != i), folded.filter(F.col("__fold") == i)
        fitted = {
            n: make_model(f, prepared.task, prepared.n_classes, prepared.n_features, prepared.n_rows, **p).fit(seen)
            for n, (f, p) in models.items()
        }
        part = model_predictions(fitted, held, id_col)
        outside = part if outside is None else outside.unionByName(part)
    assemble = MF.VectorAssembler(inputCols=[f"p_{n}" for n in names], outputCol="features")
    base = materialize(_wide(outside, id_col, names), "out-of-fold")
    meta_train = assemble.transform(join_on(base, prepared.train.select(id_col, "label"), [id_col]))
    family, params = meta
    if family == "mlp":
        params = {"hidden": mlp_layers(len(names)), **params}
    learner = make_model(family, prepared.task, prepared.n_classes, len(names), prepared.n_rows, **params).fit(meta_train)
    final = {n: fit(prepared, f, **p) for n, (f, p) in models.items()}
    val = join_on(_wide(model_predictions(final, prepared.val, id_col), id_col, names), prepared.val.select(id_col, "label"), [id_col])
    return learner.transform(assemble.transform(val)).select(id_col, "label", "prediction"), learner


def best_model(runs: DataFrame, metric: str, score_col: str = "score") -> DataFrame:
    """The single best row of a run table under the metric's direction (ties by model name)."""
    sign = metric_sign(metric)
    best = runs.filter(F.col(score_col).isNotNull()).agg(F.min(F.struct((F.col(score_col) * -sign).alias("s"), "model")).alias("b"))
    return best.select("b.model", (F.col("b.s") * -sign).alias("score"))
