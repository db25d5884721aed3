import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestat.llm import topk as T


def brute(rows, is_query, k):
    good = [(n, i, [math.floor(256 * np.float32(x)) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, v in good:
        if is_query(i):
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for m, j, w in good if m != n and len(w) == len(v))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard", [40, 4096])
def test_random_and_edges(spark, shard, monkeypatch):
    monkeypatch.setattr(T, "SHARD", shard)
    monkeypatch.setattr(T, "LEAF", 4)
    monkeypatch.setattr(T, "SAMPLE", 50)
    monkeypatch.setattr(T, "BLOCK", 30)
    rng = np.random.default_rng(shard)
    centers = rng.normal(size=(6, 5))
    rows = [(i, [float(x) for x in (centers[i % 6] + rng.normal(size=5) * 0.1).astype(np.float32)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + [rows[10], rows[10]]
    rows += [(2000, None), (2010, []), (2020, [1.0, None, 0.0, 0.0, 0.0]), (2030, [float("nan")] * 5), (None, [1.0] * 5), (2040, [float("inf")] * 5)]
    rows += [(3000, [1.0, 2.0]), (3010, [0.5, -2.0]), (3001, [-1.0, 0.0]), (5000, [0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).withColumn("v", F.lit(1)).repartition(3)
    got = sorted(tuple(r) for r in T.top_k(df, F.col("id") % 10 == 0).collect())
    assert got == brute(rows, lambda i: i % 10 == 0, 5)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert T.top_k(df, F.col("id") % 10 == 0).count() == 0


def test_pruning_skips_far_pairs():
    rng = np.random.default_rng(0)
    points = np.floor(256 * (np.repeat(rng.normal(size=(20, 16)) * 3, 50, axis=0) + rng.normal(size=(1000, 16)) * 0.05))
    data, queries = T.CoverTree(points, 32), T.CoverTree(points[::50], 2)
    scores = points[::50] @ points.T
    scores[np.arange(20), np.arange(0, 1000, 50)] = -np.inf
    best = T.Best(np.arange(0, 1000, 50), np.full(20, -np.inf), 5)
    seen, add = [], best.add
    best.add = lambda own, score, ids, rows: (seen.append(score.size), add(own, score, ids, rows))
    T.search(queries, data, np.arange(1000), np.arange(1000), best)
    assert np.array_equal(best.score, -np.sort(-scores, axis=1)[:, :5])
    assert sum(seen) < scores.size / 3
