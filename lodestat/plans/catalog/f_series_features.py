"""Queries F1-F12."""

from pyspark.sql import functions as F

from lodestat.functions.columns import rounded
from lodestat.operators import series_features as S
from lodestat.plans.catalog.e_series import ACF, POS, days_sql
from lodestat.plans.fixtures import (
    EVENTS_HOURLY,
    EVENTS_HOURLY_NULLS,
    ORDERS_DAILY,
    events_hourly,
    events_hourly_nulls,
    orders_daily,
)
from lodestat.plans.registry import query
from lodestat.sources.tables import load

KEYS = ["series"]


def text_ts(df):
    return df.withColumn("ts", F.col("ts").cast("string"))


@query(
    "f1_prepare_series",
    """SELECT o_orderpriority, CAST(o_orderdate AS VARCHAR) AS o_orderdate, arg_min(o_totalprice, o_orderkey) AS o_totalprice
    FROM orders GROUP BY o_orderpriority, orders.o_orderdate""",
)
def f1(spark, sf):
    orders = load(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("string"))
    out = S.prepare_series(orders, ["o_orderpriority"], "o_orderdate", "o_totalprice", "o_orderkey")
    return out.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@query(
    "f1_prepare_series_day_first",
    """SELECT o_orderpriority, CAST(o_orderdate AS VARCHAR) AS o_orderdate, arg_min(o_totalprice, o_orderkey) AS o_totalprice
    FROM orders GROUP BY o_orderpriority, orders.o_orderdate""",
)
def f1_day_first(spark, sf):
    """Days before months: most values alone could be read either way."""
    orders = load(spark, sf, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "d/M/yyyy"))
    out = S.prepare_series(orders, ["o_orderpriority"], "o_orderdate", "o_totalprice", "o_orderkey")
    return out.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@query(
    "f2_resample",
    "SELECT event_type, CAST(date_trunc('hour', ts)::TIMESTAMP AS VARCHAR) AS ts, round(avg(value), 6) AS value FROM events GROUP BY 1, date_trunc('hour', events.ts)",
)
def f2(spark, sf):
    return rounded(text_ts(S.resample(load(spark, sf, "events"), ["event_type"], "hour", y="value")), 6)


@query(
    "f3_fill_gaps",
    f"""WITH t AS ({EVENTS_HOURLY}), c AS (SELECT series, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM (SELECT series, min(ts) AS lo, max(ts) AS hi FROM t GROUP BY 1))
    SELECT c.series, CAST(c.ts AS VARCHAR) AS ts, round(y, 6) AS y, y IS NULL AS is_gap FROM c LEFT JOIN t ON t.series = c.series AND t.ts = c.ts""",
)
def f3(spark, sf):
    return rounded(text_ts(S.fill_gaps(events_hourly(spark, sf), KEYS, "H")), 6)


@query(
    "f4_interpolate",
    f"""WITH p AS (SELECT series, ts, y, {POS} FROM ({EVENTS_HOURLY_NULLS})),
    b AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) OVER w AS bp, last_value(y IGNORE NULLS) OVER w AS bv,
      first_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) OVER v AS ap, first_value(y IGNORE NULLS) OVER v AS av FROM p
      WINDOW w AS (PARTITION BY series ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        v AS (PARTITION BY series ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT series, CAST(ts AS VARCHAR) AS ts, round(CASE WHEN y IS NOT NULL THEN y WHEN ap IS NULL THEN bv ELSE bv + (av - bv) * (pos - bp) / (ap - bp) END, 5) AS y FROM b""",
)
def f4(spark, sf):
    return rounded(text_ts(S.interpolate(events_hourly_nulls(spark, sf), KEYS)), 5)


@query(
    "f5_lag_features",
    f"""SELECT series, CAST(ts AS VARCHAR) AS ts, y, lag(y, 1) OVER w AS y_lag_1, lag(y, 7) OVER w AS y_lag_7, lag(y, 30) OVER w AS y_lag_30
    FROM ({ORDERS_DAILY}) t WINDOW w AS (PARTITION BY series ORDER BY t.ts)""",
)
def f5(spark, sf):
    return text_ts(S.lag_features(orders_daily(spark, sf), KEYS, freq="D"))


def rolling_sql() -> str:
    cells, windows = [], []
    for w in (7, 30, 90):
        windows.append(f"w{w} AS (PARTITION BY series ORDER BY t.ts ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)")
        for name, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")):
            cells.append(
                f"CASE WHEN COUNT(y) OVER w{w} = {w} THEN round({fn}(y) OVER w{w} / 1000 / pi(), 4) END AS y_rolling_{name}_{w}"
            )
    return f"SELECT series, CAST(ts AS VARCHAR) AS ts, {', '.join(cells)} FROM ({ORDERS_DAILY}) t WINDOW {', '.join(windows)}"


@query("f6_rolling_features", rolling_sql())
def f6(spark, sf):
    """Rolling values in units of pi thousand, which keeps both engines off decimal rounding ties."""
    out = S.rolling_features(orders_daily(spark, sf), KEYS, freq="D").drop("y")
    cells = [(F.col(c) / 1000 / F.pi()).alias(c) for c in out.columns if c.startswith("y_rolling")]
    return rounded(text_ts(out.select("series", "ts", *cells)), 4)


@query(
    "f7_calendar_features",
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month,
    CAST(isodow(l_shipdate) - 1 AS INT) AS day_of_week, CAST(day(l_shipdate) AS INT) AS day_of_month, CAST(quarter(l_shipdate) AS INT) AS quarter FROM lineitem""",
)
def f7(spark, sf):
    out = S.calendar_features(load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"), "l_shipdate")
    return out.drop("l_shipdate")


@query(
    "f8_cyclical_features",
    """SELECT o_orderkey, round(sin(2 * pi() * month(o_orderdate) / 12), 8) + 0.0 AS month_sin, round(cos(2 * pi() * month(o_orderdate) / 12), 8) + 0.0 AS month_cos,
    round(sin(2 * pi() * (isodow(o_orderdate) - 1) / 7), 8) + 0.0 AS day_of_week_sin, round(cos(2 * pi() * (isodow(o_orderdate) - 1) / 7), 8) + 0.0 AS day_of_week_cos FROM orders""",
)
def f8(spark, sf):
    return rounded(S.cyclical_features(load(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate"), 8)


@query("f9_weekend_flag", "SELECT o_orderkey, CAST(isodow(o_orderdate) >= 6 AS INT) AS is_weekend FROM orders")
def f9(spark, sf):
    return S.weekend_flag(load(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate")


@query(
    "f10_difference",
    f"""SELECT series, CAST(ts AS VARCHAR) AS ts, round(y - 2 * lag(y, 1) OVER w + lag(y, 2) OVER w, 2) + 0.0 AS y_diff
    FROM ({ORDERS_DAILY}) t WINDOW w AS (PARTITION BY series ORDER BY t.ts)""",
)
def f10(spark, sf):
    return rounded(text_ts(S.difference(orders_daily(spark, sf), KEYS, d=2).drop("y")), 2)


def future_sql(source: str, step: str) -> str:
    return f"SELECT series, CAST(step AS INT) AS step, CAST(last + {step} AS VARCHAR) AS ts FROM (SELECT series, max(ts) AS last FROM ({source}) GROUP BY 1), (SELECT unnest(range(1, 31)) AS step)"


@query(
    "f11_future_dates",
    f"{future_sql(ORDERS_DAILY, 'to_days(CAST(step AS INT))')} UNION ALL {future_sql(EVENTS_HOURLY, 'to_hours(step)')}",
)
def f11(spark, sf):
    return text_ts(
        S.future_dates(orders_daily(spark, sf), KEYS, 30).unionByName(S.future_dates(events_hourly(spark, sf), KEYS, 30))
    )


@query(
    "f12_seasonal_period",
    f"""WITH {ACF}, k AS (SELECT series, lag, abs(r) AS s, row_number() OVER (PARTITION BY series ORDER BY abs(r) DESC, lag) AS i FROM r), f AS (SELECT * FROM ({days_sql(ORDERS_DAILY)}))
    SELECT f.series, frequency, CAST(CASE WHEN s > 0.3 THEN lag WHEN frequency = 'D' THEN 7 WHEN frequency = 'W' THEN 4 WHEN frequency = 'M' THEN 12 ELSE 1 END AS INT) AS seasonal_period
    FROM f LEFT JOIN (SELECT * FROM k WHERE i = 1) t ON t.series = f.series""",
)
def f12(spark, sf):
    return S.seasonal_period(orders_daily(spark, sf), KEYS)
