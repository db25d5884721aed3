"""Queries H1-H12."""

from pyspark.sql import functions as F

from lodestat.functions.columns import rounded
from lodestat.operators import metrics as M
from lodestat.plans.fixtures import (
    CLASS_PREDICTIONS,
    PREDICTIONS,
    SERIES_PREDICTIONS,
    class_predictions,
    predictions,
    series_predictions,
)
from lodestat.plans.registry import query
from lodestat.sources.tables import load


@query("h1_accuracy", f"SELECT round(avg(CAST(y = p AS INT)), 6) AS accuracy FROM ({CLASS_PREDICTIONS})")
def h1(spark, sf):
    return rounded(M.accuracy(class_predictions(spark, sf)), 6)


@query(
    "h2_classification_metrics",
    f"""WITH t AS ({CLASS_PREDICTIONS}), c AS (SELECT DISTINCT y AS label FROM t UNION SELECT DISTINCT p FROM t),
    s AS (SELECT label, (SELECT COUNT(*) FROM t WHERE y = label) AS support, (SELECT COUNT(*) FROM t WHERE p = label) AS predicted,
      (SELECT COUNT(*) FROM t WHERE y = label AND p = label) AS hit FROM c),
    m AS (SELECT support, hit, coalesce(hit / nullif(predicted, 0), 0) AS pr, coalesce(hit / nullif(support, 0), 0) AS re FROM s)
    SELECT round(sum(hit) / sum(support), 6) AS accuracy, round(sum(pr * support) / sum(support), 6) AS precision,
      round(sum(re * support) / sum(support), 6) AS recall,
      round(sum(coalesce(2 * pr * re / nullif(pr + re, 0), 0) * support) / sum(support), 6) AS f1 FROM m""",
)
def h2(spark, sf):
    return rounded(M.classification_metrics(class_predictions(spark, sf)), 6)


@query(
    "h3_rmse_mae",
    f"SELECT round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae FROM ({PREDICTIONS})",
)
def h3(spark, sf):
    return rounded(M.regression_metrics(predictions(spark, sf)).select("rmse", "mae"))


@query("h4_mape", f"SELECT grp, round(avg(abs((y - p) / y)) FILTER (WHERE y <> 0) * 100, 4) AS mape FROM ({PREDICTIONS}) GROUP BY 1")
def h4(spark, sf):
    return rounded(M.regression_metrics(predictions(spark, sf), keys=["grp"]).select("grp", "mape"))


@query(
    "h5_smape",
    f"""SELECT grp, round(avg(abs(p - y) / ((abs(y) + abs(p)) / 2)) FILTER (WHERE abs(y) + abs(p) <> 0) * 100, 4) AS smape
    FROM ({PREDICTIONS}) GROUP BY 1""",
)
def h5(spark, sf):
    return rounded(M.regression_metrics(predictions(spark, sf), keys=["grp"]).select("grp", "smape"))


def h_sql(period: int) -> str:
    return f"""SELECT series, round(avg(abs(a - f)), 2) AS mae, round(sqrt(avg((a - f) * (a - f))), 2) AS rmse,
      round(avg(abs((a - f) / a)) * 100, 4) AS mape, round(avg(abs(f - a) / ((abs(a) + abs(f)) / 2)) * 100, 4) AS smape,
      round(avg(abs(a - f)) / avg(abs(a - a_s)), 6) AS mase,
      round(avg(CASE WHEN a1 IS NOT NULL THEN CAST((a - a1) * (f - f1) > 0 AS INT) END) * 100, 4) AS directional_accuracy
    FROM (SELECT *, lag(a) OVER w AS a1, lag(f) OVER w AS f1, lag(a, {period}) OVER w AS a_s
      FROM ({SERIES_PREDICTIONS}) WINDOW w AS (PARTITION BY series ORDER BY ts)) GROUP BY series"""


@query("h6_mase", f"SELECT series, mase FROM ({h_sql(7)})")
def h6(spark, sf):
    return rounded(M.mase(series_predictions(spark, sf), ["series"], 7), 6)


@query("h7_directional_accuracy", f"SELECT series, directional_accuracy FROM ({h_sql(1)})")
def h7(spark, sf):
    return rounded(M.directional_accuracy(series_predictions(spark, sf), ["series"]), 4)


@query("h8_evaluate_forecast", h_sql(7))
def h8(spark, sf):
    return rounded(M.evaluate_forecast(series_predictions(spark, sf), ["series"], period=7), 4, mae=2, rmse=2, mase=6)


SQUARED = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2))"


def silhouette_sql(dist: str) -> str:
    return f"""WITH d AS (SELECT a.vec_id, a.label, b.label AS other, sum({dist}) AS s, COUNT(*) AS n
      FROM embeddings a, embeddings b GROUP BY 1, 2, 3),
    p AS (SELECT vec_id, max(CASE WHEN label = other THEN n END) AS n,
      max(CASE WHEN label = other THEN s END) / (max(CASE WHEN label = other THEN n END) - 1) AS a,
      min(CASE WHEN label <> other THEN s / n END) AS b FROM d GROUP BY 1)
    SELECT COUNT(*) AS n, round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM p"""


@query("h9_silhouette_squared", silhouette_sql(SQUARED))
def h9_squared(spark, sf):
    return rounded(M.silhouette(load(spark, sf, "embeddings"), "embedding"), 6)


@query("h9_silhouette_euclidean", silhouette_sql(f"sqrt({SQUARED})"))
def h9_euclidean(spark, sf):
    return rounded(M.silhouette_euclidean(load(spark, sf, "embeddings"), "vec_id", "embedding"), 6)


MOMENTS = """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
  m AS (SELECT label, i, COUNT(*) AS n, avg(x) AS c FROM e GROUP BY 1, 2), g AS (SELECT i, avg(x) AS c FROM e GROUP BY 1)"""


@query(
    "h10_calinski_harabasz",
    MOMENTS
    + """, b AS (SELECT sum(n * (m.c - g.c) ** 2) AS v FROM m JOIN g USING (i)),
  w AS (SELECT sum((x - c) ** 2) AS v FROM e JOIN m USING (label, i)),
  s AS (SELECT COUNT(DISTINCT label) AS k, COUNT(*) AS n FROM embeddings)
  SELECT k, n, round((b.v / (k - 1)) / (w.v / (n - k)), 6) AS calinski_harabasz FROM b, w, s""",
)
def h10(spark, sf):
    return rounded(M.calinski_harabasz(load(spark, sf, "embeddings"), "embedding"), 6)


@query(
    "h11_davies_bouldin",
    MOMENTS
    + """, r AS (SELECT vec_id, label, sqrt(sum((x - c) ** 2)) AS d FROM e JOIN m USING (label, i) GROUP BY 1, 2),
  s AS (SELECT label, avg(d) AS s FROM r GROUP BY 1),
  cc AS (SELECT a.label AS i, b.label AS j, sqrt(sum((a.c - b.c) ** 2)) AS d FROM m a JOIN m b ON a.i = b.i AND a.label <> b.label GROUP BY 1, 2),
  worst AS (SELECT i, max((x.s + y.s) / d) AS r FROM cc JOIN s x ON x.label = i JOIN s y ON y.label = j GROUP BY 1)
  SELECT COUNT(*) AS k, round(avg(r), 6) AS davies_bouldin FROM worst""",
)
def h11(spark, sf):
    return rounded(M.davies_bouldin(load(spark, sf, "embeddings"), "embedding"), 6)


@query(
    "h12_overfit_gap",
    f"""WITH t AS ({PREDICTIONS}) SELECT grp, round(sqrt(avg((y - p) ** 2) FILTER (WHERE id % 5 <> 0)), 4) AS train_score,
      round(sqrt(avg((y - p) ** 2) FILTER (WHERE id % 5 = 0)), 4) AS val_score,
      round(sqrt(avg((y - p) ** 2) FILTER (WHERE id % 5 <> 0)) - sqrt(avg((y - p) ** 2) FILTER (WHERE id % 5 = 0)), 4) AS gap
    FROM t GROUP BY 1""",
)
def h12(spark, sf):
    df = predictions(spark, sf)
    held = F.col("id") % 5 == 0
    return rounded(
        M.overfit_gap(
            M.regression_metrics(df.filter(~held), keys=["grp"]), M.regression_metrics(df.filter(held), keys=["grp"]), ["grp"], "rmse"
        )
    )
