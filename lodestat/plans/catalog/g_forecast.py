"""Queries G1-G10."""

from pyspark.sql import functions as F

from lodestat.functions.columns import rounded
from lodestat.operators import forecast as G
from lodestat.operators.series_features import lag_features
from lodestat.plans.catalog.e_series import POS
from lodestat.plans.fixtures import EVENTS_HOURLY, ORDERS_DAILY, ORDERS_MONTHLY, events_hourly, orders_daily, orders_monthly
from lodestat.plans.registry import query

KEYS = ["series"]


def text_ts(df):
    return df.withColumn("ts", F.col("ts").cast("string"))


SMA = f"""WITH p AS (SELECT series, ts, y, {POS} FROM ({ORDERS_DAILY})),
  l AS (SELECT series, avg(y) AS yhat FROM p WHERE pos >= n - least(7, n // 4) GROUP BY 1), m AS (SELECT series, max(ts) AS last FROM p GROUP BY 1)"""
STEPS = "(SELECT unnest(range(1, 31)) AS step)"


@query(
    "g1_forecast_sma",
    f"""{SMA} SELECT l.series, CAST(step AS INT) AS step, CAST(last + to_days(CAST(step AS INT)) AS VARCHAR) AS ts, round(yhat, 4) AS yhat
    FROM l JOIN m ON m.series = l.series, {STEPS}""",
)
def g1(spark, sf):
    return rounded(text_ts(G.forecast_sma(orders_daily(spark, sf), KEYS, 30)).drop("yhat_lower", "yhat_upper"))


@query(
    "g2_forecast_last_value",
    f"""SELECT series, CAST(step AS INT) AS step, CAST(last + to_hours(step) AS VARCHAR) AS ts, round(v, 6) AS yhat, round(v * 0.9, 6) AS yhat_lower, round(v * 1.1, 6) AS yhat_upper
    FROM (SELECT series, max(ts) AS last, arg_max(y, ts) AS v FROM ({EVENTS_HOURLY}) GROUP BY 1), {STEPS}""",
)
def g2(spark, sf):
    return rounded(text_ts(G.forecast_last_value(events_hourly(spark, sf), KEYS, 30)), 6)


@query("g3_forecast_arima")
def g3(spark, sf):
    return text_ts(G.forecast_arima(orders_daily(spark, sf), KEYS, 30))


@query(
    "g3_ar1_coefficient",
    f"""WITH p AS (SELECT series, y, lag(y) OVER (PARTITION BY series ORDER BY ts) AS q FROM ({ORDERS_DAILY}))
    SELECT series, round(regr_slope(y, q), 8) AS ar1 FROM p WHERE q IS NOT NULL GROUP BY 1""",
)
def g3_ar1(spark, sf):
    lagged = lag_features(orders_daily(spark, sf), KEYS, [1])
    return rounded(lagged.groupBy("series").agg(F.regr_slope("y", "y_lag_1").alias("ar1")), 8)


@query("g4_arima_interval")
def g4(spark, sf):
    out = G.forecast_arima(events_hourly(spark, sf), KEYS, 24)
    return text_ts(out.withColumn("width", F.col("yhat_upper") - F.col("yhat_lower")))


@query("g5_forecast_ets")
def g5(spark, sf):
    return text_ts(G.forecast_ets(orders_monthly(spark, sf), KEYS, 12))


@query(
    "g5_ets_given_weights",
    f"""WITH RECURSIVE p AS (SELECT series, y, {POS} FROM ({ORDERS_MONTHLY})),
    i AS (SELECT series, min(n) AS n, max(y) FILTER (WHERE pos = 0) AS y0, (max(y) FILTER (WHERE pos = least(9, n - 1)) - max(y) FILTER (WHERE pos = 0)) / least(9, min(n) - 1) AS s FROM p GROUP BY 1),
    r AS (SELECT series, n, CAST(-1 AS BIGINT) AS pos, y0 - s AS l, s, 0::DOUBLE AS sse FROM i
      UNION ALL SELECT r.series, r.n, r.pos + 1, r.l + r.s + 0.4 * (y - r.l - r.s), r.s + 0.4 * 0.25 * (y - r.l - r.s), sse + (y - r.l - r.s) ** 2
        FROM r JOIN p ON p.series = r.series AND p.pos = r.pos + 1)
    SELECT series, n, round(l, 2) AS level, round(s, 3) AS slope, round(sqrt(sse / n), 2) AS rmse FROM r WHERE pos = n - 1""",
)
def g5_given(spark, sf):
    fits = G.ets_fits(orders_monthly(spark, sf), KEYS, [("add", "none")], weights=(0.4, 0.25, 0.0))
    state = F.col("state")
    out = fits.select("series", "n", state[0].alias("level"), state[1].alias("slope"), F.sqrt(F.col("sse") / F.col("n")).alias("rmse"))
    return rounded(out, 2, slope=3)


@query(
    "g5_smoothed_level",
    f"""WITH p AS (SELECT series, y, {POS} FROM ({ORDERS_DAILY}))
    SELECT series, round(sum(y * pow(0.7, n - 1 - pos) * CASE WHEN pos = 0 THEN 1 ELSE 0.3 END), 4) AS level FROM p GROUP BY 1""",
)
def g5_level(spark, sf):
    return rounded(G.smoothed_level(orders_daily(spark, sf), KEYS, 0.3))


@query("g6_forecast_additive")
def g6(spark, sf):
    return text_ts(G.forecast_additive(orders_daily(spark, sf), KEYS, 30))


@query("g7_interval_additive")
def g7(spark, sf):
    out = G.forecast_additive(events_hourly(spark, sf), KEYS, 24, ["weekly", "daily"])
    return text_ts(out.withColumn("width", F.col("yhat_upper") - F.col("yhat_lower")))


EVALUATED = f"""WITH p AS (SELECT series, ts, y, {POS} FROM ({ORDERS_DAILY})),
  s AS (SELECT *, floor(n * 0.8) AS cut FROM p), l AS (SELECT series, avg(y) FILTER (WHERE pos >= cut - least(7, cut // 4)) AS sma, arg_max(y, ts) AS last FROM s WHERE pos < cut GROUP BY 1),
  f AS (SELECT s.series, 'sma' AS model, ts, y, sma AS f FROM s JOIN l USING (series) WHERE pos >= cut UNION ALL SELECT s.series, 'last_value', ts, y, last FROM s JOIN l USING (series) WHERE pos >= cut),
  g AS (SELECT series, model, sqrt(avg((y - f) ** 2)) AS rmse, avg(abs(y - f)) AS mae FROM f GROUP BY 1, 2)"""


@query("g8_evaluate_forecasters", f"{EVALUATED} SELECT series, model, round(rmse, 2) AS rmse, round(mae, 2) AS mae, CAST(NULL AS VARCHAR) AS reason FROM g")
def g8(spark, sf):
    out = G.evaluate_forecasters(orders_daily(spark, sf), KEYS)
    return rounded(out.select("series", "model", "rmse", "mae", "reason"), 2)


@query("g8_evaluate_all_forecasters")
def g8_all(spark, sf):
    return G.evaluate_forecasters(orders_monthly(spark, sf), KEYS, list(G.FORECASTERS), period=12, freq="M")


@query("g9_best_forecaster", f"{EVALUATED} SELECT series, arg_min(model, rmse) AS model, round(min(rmse), 2) AS rmse FROM g GROUP BY 1")
def g9(spark, sf):
    return rounded(G.best_forecaster(G.evaluate_forecasters(orders_daily(spark, sf), KEYS), KEYS), 2)


@query(
    "g10_forecast_frame",
    f"""{EVALUATED}, k AS (SELECT *, max(ts) OVER (PARTITION BY series) AS last FROM s)
    SELECT series, CAST(ts AS VARCHAR) AS ts, round(y, 2) AS actual, NULL::DOUBLE AS predicted, 'historical' AS segment FROM s WHERE pos < cut AND pos >= cut - 30
    UNION ALL SELECT s.series, CAST(ts AS VARCHAR), round(y, 2), round(sma, 3), 'validation' FROM s JOIN l ON l.series = s.series WHERE pos >= cut
    UNION ALL SELECT l.series, CAST(m.last + to_days(CAST(step AS INT)) AS VARCHAR), NULL, round(sma, 3), 'future' FROM l JOIN (SELECT series, max(ts) AS last FROM p GROUP BY 1) m ON m.series = l.series, {STEPS}""",
)
def g10(spark, sf):
    out = G.forecast_frame(orders_daily(spark, sf), KEYS, 30)
    return rounded(text_ts(out).drop("lower", "upper"), 2, predicted=3)
