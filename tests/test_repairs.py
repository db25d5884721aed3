"""Cases that once gave wrong answers or refused their input."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from lodestat.functions.columns import date_formats
from lodestat.operators import cluster as K
from lodestat.operators import features as D
from lodestat.operators import metrics as M
from lodestat.operators import models as I
from lodestat.operators import rules as R
from lodestat.operators.ensemble import near
from lodestat.operators.series_features import prepare_series
from lodestat.plans.skew import with_position


def test_one_hot_keeps_categories_whose_names_collide(spark):
    values = ["A-1", "A 1", "日本", "中国", None, "A-1"]
    df = spark.createDataFrame(list(enumerate(values)), "id long, c string")
    wide = D.one_hot(df, ["c"])
    assert len(wide.columns) == 1 + 4
    rows = {r.id: tuple(r)[1:] for r in wide.collect()}
    assert rows[0] == rows[5] and rows[4] == (0, 0, 0, 0)
    assert len({rows[i] for i in range(4)}) == 4 and all(sum(rows[i]) == 1 for i in range(4))


def test_one_hot_vector_has_no_limit(spark):
    df = spark.range(3000).select(F.col("id"), F.concat(F.lit("v"), F.col("id") % 1500).alias("c"))
    got = D.one_hot_vector(df.union(spark.createDataFrame([(9999, None)], "id long, c string")), "c", fit_on=df)
    rows = {r.id: r.c_vector for r in got.collect()}
    assert all(v.size == 1500 for v in rows.values())
    assert rows[7] == rows[1507] and rows[7].numNonzeros() == 1 and rows[9999].numNonzeros() == 0
    assert len({int(v.indices[0]) for k, v in rows.items() if k != 9999}) == 1500


def test_isolation_forest_with_missing_values(spark):
    rows = [(i, float(i % 10), None if i % 7 == 0 else float(i % 13)) for i in range(400)] + [(1000, 500.0, 500.0), (1001, -400.0, None)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    got = {r.id: r for r in I.isolation_forest(df, "id", ["a", "b"], trees=50, contamination=0.01).collect()}
    assert len(got) == len(rows) and got[1000].is_anomaly and got[1001].is_anomaly


@pytest.mark.parametrize("kind", ["text", "number"])
def test_positions_of_texts_and_outliers(spark, kind):
    keys = [f"CUST{i:06d}" for i in range(3000)] if kind == "text" else [*range(2999), 10**15]
    df = spark.createDataFrame([(k,) for k in reversed(keys)], "k string" if kind == "text" else "k long")
    got = sorted((r.pos, r.k, r.n) for r in with_position(df, [], "k").collect())
    assert got == [(i, k, 3000) for i, k in enumerate(sorted(keys))]


@pytest.mark.parametrize("form", ["01/02/2020", "Jan 2, 2020", "2 Jan 2020", "2020-01-02", "02.01.2020"])
def test_text_dates(spark, form):
    df = spark.createDataFrame([(form, 1.0)] * 4, "day string, y double")
    assert [r.column_name for r in R.detect_date_columns(df.withColumnRenamed("day", "when_x")).collect()] == ["when_x"]
    got = prepare_series(df, [], "day", "y").collect()
    assert [str(r.day)[:10] for r in got] == ["2020-01-02"]


def test_target_falls_back_to_the_last_column(spark):
    df = spark.range(60).select(F.col("id").alias("a_id"), (F.col("id") * 7).alias("b_id"))
    assert [tuple(r) for r in R.rank_targets(df).collect()] == [("b_id", 0, 1)]


def test_forecast_suggested_for_text_dates(spark):
    df = spark.range(60).select(F.concat(F.lit("03/"), F.col("id") % 28 + 1, F.lit("/2021")).alias("taken"), (F.col("id") % 40 * 1.5).alias("sales"))
    assert ("forecasting", "sales") in [(r.type, r.target) for r in R.suggest_tasks(df).collect()]


def test_small_tables_get_the_exact_merge_tree(spark):
    points = [0.0, 0.1, 0.2, 5.0, 5.1, 9.0]
    df = spark.createDataFrame([(i, [p]) for i, p in enumerate(points * 3)], "id long, features array<double>")
    assigned, _ = K.hierarchical(df, "id", [3])
    groups = {}
    for r in assigned.collect():
        groups.setdefault(r.label, set()).add(r.id % 6)
    assert sorted(map(sorted, groups.values())) == [[0, 1, 2], [3, 4], [5]]


def test_best_of_several_clusterings_skips_failures(spark):
    df = spark.createDataFrame([(i, [float(10 * (i % 3)), float(i % 4) / 10]) for i in range(60)], "id long, features array<double>")
    assigned, table = K.cluster_all(df, "id", ("kmeans", "hierarchical"))
    assert {r.algorithm for r in table.collect()} == {"kmeans", "hierarchical"}
    assert assigned.select("label").distinct().count() == 3


def test_layer_widths_and_spaces():
    assert [I.mlp_layers(n) for n in (5, 40, 400)] == [[32], [80], [128]]
    assert I.mlp_layers(100, "balanced") == [256, 128] and I.mlp_layers(10, "complex") == [128, 64, 32]
    assert near({"rounds": 100, "rate": 0.1, "kind": "x"}) == {"rounds": ("int", 50, 300), "rate": ("float", 0.05, 0.2), "kind": ["x"]}


def test_one_date_format_for_a_column(spark):
    rows = [("13/02/2020", "13-02-2020", "02-03-2020", "May 5, 2020"), ("05/02/2020", "05-02-2020", "04-03-2020", "June 6, 2020"), (None, "x", None, None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    got = {r.column_name: r for r in date_formats(df, df.columns).collect()}
    assert got["a"].format.startswith("d/M") and got["a"].parse_share == 1.0 and not got["a"].is_ambiguous
    assert got["b"].format == "d-M-yyyy" and round(got["b"].parse_share, 3) == 0.667
    assert got["c"].format == "M-d-yyyy" and got["c"].is_ambiguous
    assert got["d"].format.startswith("MMM") and not got["d"].is_ambiguous
    assert date_formats(df.limit(0), ["a"]).first().format is None
    series = prepare_series(df.selectExpr("a AS ts", "1.0D AS y"), [], "ts", "y")
    assert sorted(str(r.ts)[:10] for r in series.collect()) == ["2020-02-05", "2020-02-13"]


def test_split_guard(spark):
    df = spark.createDataFrame([(i, float(i), "ab"[i == 7]) for i in range(40)], "id long, x double, y string")
    with pytest.raises(ValueError, match="only one row"):
        I.prepare(df, "y", "classification", ["id"])
    few = df.withColumn("y", F.when(F.col("id") < 3, "b").otherwise("a"))
    assert I.prepare(few, "y", "classification", ["id"], test_size=0.3).n_rows > 0


def test_copies_of_many_categories_are_not_broadcast(spark):
    """Each category travels once per salt; a table that is small only before that must not be broadcast."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1MB")
    try:
        df = spark.range(20_000).select("id", F.format_string("Customer#%09d", "id").alias("name"))
        out = D.label_encode(df, "name")
        assert out.filter(F.col("id") == F.col("name_code")).count() == 20_000
        out.collect()
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
        few = D.label_encode(df.select("id", (F.col("id") % 5).cast("string").alias("name")), "name")
        few.collect()
        assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_scores_of_very_wide_vectors_stay_with_the_rows(spark):
    """A basis kept by the rows gives the scores of the whole matrix, with slots in one row, in many and in a few."""
    rng = np.random.default_rng(3)
    n, width = 120, 400
    x = np.zeros((n, width))
    x[:, :6] = rng.normal(size=(n, 6)) * np.array([20, 15, 11, 8, 6, 4.0]) + 3
    x[np.arange(n), 6 + np.arange(n)] = 1.0
    x[np.arange(n), 200 + np.arange(n) % 30] = rng.normal(size=n)
    rows = [(i % 100, Vectors.sparse(width, {int(j): float(x[i, j]) for j in np.flatnonzero(x[i])})) for i in range(n)]
    df = spark.createDataFrame(rows, ["id", "v"]).withColumn("place", F.monotonically_increasing_id()).repartition(3)
    c = x - x.mean(axis=0)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    for frequent in (8, 1024):
        got = D.wide_scores(df, "v", n, 4, "scores", frequent=frequent).orderBy("place").collect()
        y = np.array([r["scores"] for r in got])
        assert [r["id"] for r in got] == [i % 100 for i in range(n)]
        assert np.allclose(np.abs(y), np.abs(u[:, :4] * s[:4]), atol=1e-6)
    reduced = D.pca_reduce(df, "v", 4, "pca", held_cells=100).orderBy("place").collect()
    assert np.allclose(np.abs([r["pca"].toArray() for r in reduced]), np.abs(u[:, :4] * s[:4]), atol=1e-6)


def test_wide_cluster_vectors_name_no_slots(spark):
    """Slots by the ten thousand carry no names in the schema, and hold what the narrow path holds."""
    df = spark.range(12_000).select("id", (F.col("id") % 7).cast("double").alias("a"), F.format_string("n%05d", "id").alias("name"), (F.col("id") % 3).cast("string").alias("kind"))
    out = K.cluster_vectors(df, "id")
    assert not out.schema["features"].metadata
    values = np.arange(12_000) % 7
    mean, std = values.mean(), values.std(ddof=1)
    for r in out.filter("id IN (0, 5, 11999)").collect():
        want = (r["id"] % 7 - mean) / std
        v = r["features"]
        assert v.size == 1 + 12_000 + 3
        got = dict(zip(v.indices.tolist(), v.values.tolist()))
        parts = sorted(i for i in got if i)
        assert got[0] == pytest.approx(want) and len(parts) == 2 and all(got[i] == 1.0 for i in parts)
        kinds, names = [i for i in parts if i <= 3], [i for i in parts if i > 3]
        assert (kinds, names) == ([1 + r["id"] % 3], [4 + r["id"]]) or parts == [1 + r["id"], 12_001 + r["id"] % 3]


def _peak(work, *frames) -> float:
    import tracemalloc

    tracemalloc.start()
    work(*frames)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 1e6


def _block(seed, n=4096):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"id": np.arange(n) + seed * n, "x": list(rng.normal(size=(n, 8))), "label": [str(i % 5) for i in range(n)]})


def test_silhouette_blocks_hold_few_distances(spark, monkeypatch):
    """A pair of full blocks needs tables of some rows, not of all pairs at once."""
    held = []

    def caught(left, right, left_id, right_id, work, schema):
        held.append(work)
        raise StopIteration

    monkeypatch.setattr(M, "block_pairs", caught)
    with pytest.raises(StopIteration):
        M.silhouette_euclidean(spark.createDataFrame([(1, [1.0], 0)], "id long, features array<double>, label int"), "id")
    assert _peak(held[0], _block(0), _block(1)) < 80


def test_nearest_blocks_hold_few_distances():
    assert _peak(I._closest(5), _block(0), _block(1)) < 80


def test_weighted_points_score_as_repeated_rows(spark):
    """A point that counts w times scores as w equal rows, in every clustering."""
    points = [(t, [float(i % 4) * (3 + t), float(i % 3)], (i + t) % 3, 1 + i % 5) for t in (0, 1) for i in range(12)]
    merged = spark.createDataFrame(points, "trial int, features array<double>, label int, w long")
    rows = merged.withColumn("each", F.explode(F.sequence(F.lit(1).cast("long"), "w"))).withColumn("id", F.monotonically_increasing_id())
    want, got = (df.orderBy("trial").collect() for df in (M.sweep_scores(rows, "trial", "id"), M.sweep_scores(merged, "trial", "features", weight="w")))
    assert len(want) == 2
    for a, b in zip(want, got):
        assert tuple(a) == pytest.approx(tuple(b))
