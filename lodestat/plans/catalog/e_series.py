"""Queries E1-E18."""

from pyspark.sql import functions as F

from lodestat.functions.columns import rounded
from lodestat.operators import series as S
from lodestat.plans.fixtures import (
    EVENTS_HOURLY,
    ORDERS_DAILY,
    ORDERS_MONTHLY,
    events_hourly,
    orders_daily,
    orders_monthly,
)
from lodestat.plans.registry import query
from lodestat.sources.tables import load

KEYS = ["series"]
RAW_EVENTS = "SELECT event_type AS series, ts FROM events"


def raw_events(spark, sf):
    return load(spark, sf, "events").select(F.col("event_type").alias("series"), "ts")


def frequency_sql(source: str) -> str:
    return f"""WITH g AS (SELECT series, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY series ORDER BY ts))) / 3600000000 AS h
      FROM ({source})),
    c AS (SELECT series, round(h, 2) AS hours, COUNT(*) AS n FROM g WHERE h IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT *, sum(n) OVER (PARTITION BY series) AS total,
      sum(CASE WHEN hours BETWEEN 672 AND 744 THEN n ELSE 0 END) OVER (PARTITION BY series) AS mon,
      row_number() OVER (PARTITION BY series ORDER BY n DESC, hours) AS rank FROM c),
    f AS (SELECT series, hours AS dominant_interval_hours, n / total AS conf, mon / total >= 0.8 AS calendar_regular,
      CASE WHEN abs(hours - 1) < 0.1 THEN 'H' WHEN abs(hours - 24) < 1 THEN 'D' WHEN hours BETWEEN 160 AND 192 THEN 'W'
        WHEN hours BETWEEN 720 AND 780 THEN 'M' WHEN hours BETWEEN 2160 AND 2208 THEN 'Q' WHEN hours BETWEEN 8640 AND 8928 THEN 'Y'
        ELSE 'unknown' END AS inferred_freq FROM r WHERE rank = 1)
    SELECT f.series, inferred_freq, round(conf, 6) AS frequency_confidence, conf < 0.8 AS irregular_periods, dominant_interval_hours,
      calendar_regular, hours, n AS count, CAST(rank - 1 AS BIGINT) AS rank FROM f JOIN r ON f.series = r.series WHERE rank <= 5"""


def frequency_rows(df):
    out = S.detect_frequency(df, KEYS)
    flat = out.select("*", F.posexplode("common_intervals").alias("rank", "e")).drop("common_intervals")
    return rounded(
        flat.select("*", "e.hours", "e.count").drop("e").withColumn("rank", F.col("rank").cast("long")), 6
    )


@query("e1_detect_frequency", frequency_sql(EVENTS_HOURLY))
def e1(spark, sf):
    return frequency_rows(events_hourly(spark, sf))


@query("e1_detect_frequency_raw", frequency_sql(RAW_EVENTS))
def e1_raw(spark, sf):
    return frequency_rows(raw_events(spark, sf))


@query("e1_detect_frequency_monthly", frequency_sql(ORDERS_MONTHLY))
def e1_monthly(spark, sf):
    return frequency_rows(orders_monthly(spark, sf))


def days_sql(source: str) -> str:
    return f"""WITH g AS (SELECT series, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY series ORDER BY ts)) AS gap FROM (SELECT DISTINCT series, ts FROM ({source}))),
    m AS (SELECT series, gap, row_number() OVER (PARTITION BY series ORDER BY COUNT(*) DESC, gap) AS r FROM g WHERE gap IS NOT NULL GROUP BY 1, 2),
    d AS (SELECT series, gap // 86400000000 AS d, round(gap / 3600000000, 2) AS h FROM m WHERE r = 1)
    SELECT series, CASE WHEN d = 1 THEN 'D' WHEN d BETWEEN 6 AND 8 THEN 'W' WHEN d BETWEEN 28 AND 32 THEN 'M'
      WHEN d BETWEEN 89 AND 92 THEN 'Q' WHEN d BETWEEN 360 AND 370 THEN 'Y' WHEN d = 0 AND abs(h - 1) < 0.1 THEN 'H' ELSE d || 'D' END AS frequency FROM d"""


@query("e2_detect_frequency_days", f"SELECT * FROM ({days_sql(ORDERS_DAILY)}) UNION ALL SELECT * FROM ({days_sql(EVENTS_HOURLY)})")
def e2(spark, sf):
    return S.detect_frequency_days(orders_daily(spark, sf), KEYS).unionByName(
        S.detect_frequency_days(events_hourly(spark, sf), KEYS)
    )


@query(
    "e3_date_range",
    f"""SELECT series, CAST(min(ts) AS VARCHAR) AS start_date, CAST(max(ts) AS VARCHAR) AS end_date,
      (epoch_us(max(ts)) - epoch_us(min(ts))) // 86400000000 AS total_days, COUNT(*) AS total_periods FROM ({RAW_EVENTS}) GROUP BY 1""",
)
def e3(spark, sf):
    out = S.date_range(raw_events(spark, sf), KEYS)
    return out.withColumn("start_date", F.col("start_date").cast("string")).withColumn("end_date", F.col("end_date").cast("string"))


@query(
    "e4_gap_profile",
    f"""WITH g AS (SELECT series, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY series ORDER BY ts))) / 3600000000 AS h FROM ({EVENTS_HOURLY}))
    SELECT series, 'H' AS freq, true AS analysis_possible, COUNT(*) FILTER (WHERE h > 1.5) AS total_gaps,
      round(COUNT(*) FILTER (WHERE h > 1.5) / COUNT(h) * 100, 4) AS gap_percentage,
      round(coalesce(max(h) FILTER (WHERE h > 1.5), 0), 4) AS largest_gap_hours,
      round(coalesce(avg(h) FILTER (WHERE h > 1.5), 0), 4) AS average_gap_hours,
      round(COUNT(*) FILTER (WHERE h <= 1.5) / COUNT(h) * 100, 4) AS regular_intervals FROM g WHERE h IS NOT NULL GROUP BY 1""",
)
def e4(spark, sf):
    return rounded(S.gap_profile(events_hourly(spark, sf), KEYS))


@query(
    "e5_series_stats",
    f"""SELECT series, COUNT(y) AS n, round(avg(y), 2) AS mean, round(stddev_samp(y), 2) AS std, round(min(y), 2) AS min, round(max(y), 2) AS max,
      round(stddev_samp(y) / avg(y), 6) AS cv FROM ({ORDERS_DAILY}) GROUP BY 1""",
)
def e5(spark, sf):
    return rounded(S.series_stats(orders_daily(spark, sf), KEYS), 2, cv=6)


POS = "row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS pos, COUNT(*) OVER (PARTITION BY series) AS n"


@query(
    "e6_trend",
    f"""WITH p AS (SELECT series, y, {POS} FROM ({ORDERS_DAILY})),
    f AS (SELECT series, COUNT(*) AS n, regr_slope(y, pos) AS s, regr_r2(y, pos) AS r FROM p GROUP BY 1)
    SELECT series, n, round(s, 4) AS slope, round(r, 8) AS r_squared, CASE WHEN s > 0 THEN 'increasing' ELSE 'decreasing' END AS direction,
      r > 0.25 AS detected FROM f""",
)
def e6(spark, sf):
    return rounded(S.trend(orders_daily(spark, sf), KEYS), 4, r_squared=8)


DETRENDED = f"""p AS (SELECT series, y, {POS} FROM ({ORDERS_MONTHLY})),
  a AS (SELECT series, pos, n, y - avg(y) OVER w AS d, COUNT(*) OVER w AS c FROM p
    WINDOW w AS (PARTITION BY series ORDER BY pos ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)),
  t AS (SELECT series, pos - 6 AS t, d, n - 11 AS m FROM a WHERE c = 12)"""
SPECTRUM = f"""WITH {DETRENDED},
  b AS (SELECT series, m, k, sqrt(sum(d * cos(2 * pi() * (t * k % m) / m)) ** 2 + sum(d * sin(2 * pi() * (t * k % m) / m)) ** 2) AS mag
    FROM t JOIN (SELECT unnest(range(1, 4000)) AS k) ON k < m // 2 GROUP BY 1, 2, 3),
  pk AS (SELECT *, lag(mag) OVER w AS l, lead(mag) OVER w AS r FROM b WINDOW w AS (PARTITION BY series ORDER BY k)),
  top AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY mag DESC, k) AS rk FROM pk WHERE mag > l AND mag > r),
  kept AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY rk) AS rank FROM top WHERE rk <= 3 AND m / k >= 2 AND m / k <= m / 3)"""


@query(
    "e7_spectral_seasonality",
    f"""{SPECTRUM} SELECT series, CAST(rank AS INT) AS rank, round(m / k, 6) AS period, round(mag, 1) AS strength, round(k / m, 6) AS frequency FROM kept""",
)
def e7(spark, sf):
    return rounded(S.spectral_seasonality(orders_monthly(spark, sf), KEYS), 6, strength=1)


@query(
    "e7_spectral_seasonality_daily",
    f"""{SPECTRUM.replace(ORDERS_MONTHLY, ORDERS_DAILY)} SELECT series, CAST(rank AS INT) AS rank, round(m / k, 6) AS period, round(mag, 1) AS strength, round(k / m, 6) AS frequency FROM kept""",
)
def e7_daily(spark, sf):
    return rounded(S.spectral_seasonality(orders_daily(spark, sf), KEYS), 6, strength=1)


@query(
    "e8_seasonality_type",
    f"""{SPECTRUM.replace(ORDERS_MONTHLY, ORDERS_DAILY)}, s AS (SELECT DISTINCT series FROM p)
    SELECT s.series, m IS NOT NULL AS detected, CASE WHEN m / k BETWEEN 6 AND 8 THEN 'weekly' WHEN m / k BETWEEN 28 AND 32 THEN 'monthly'
      WHEN m / k BETWEEN 90 AND 100 THEN 'quarterly' WHEN m / k BETWEEN 360 AND 370 THEN 'yearly' ELSE 'unknown' END AS season,
      round(m / k, 6) AS dominant_period, round(coalesce(mag, 0), 1) AS strength_score
    FROM s LEFT JOIN (SELECT * FROM kept WHERE rank = 1) x ON x.series = s.series""",
)
def e8(spark, sf):
    return rounded(S.dominant_seasonality(orders_daily(spark, sf), KEYS), 6, strength_score=1)


ACF = f"""p AS (SELECT series, y, {POS} FROM ({ORDERS_DAILY})),
  r AS (SELECT a.series, lag, corr(a.y, b.y) AS r FROM p a JOIN (SELECT unnest(range(1, 50)) AS lag) ON lag < least(a.n // 4, 50)
    JOIN p b ON b.series = a.series AND b.pos = a.pos - lag GROUP BY 1, 2)"""


@query("e9_acf", f"WITH {ACF} SELECT series, CAST(lag AS INT) AS lag, round(r, 6) AS r FROM r")
def e9(spark, sf):
    return rounded(S.acf(orders_daily(spark, sf), KEYS), 6)


@query(
    "e10_acf_seasonality",
    f"""WITH {ACF.replace(ORDERS_DAILY, EVENTS_HOURLY)}, k AS (SELECT series, lag, abs(r) AS s, row_number() OVER (PARTITION BY series ORDER BY abs(r) DESC, lag) AS i FROM r)
    SELECT series, max(s) FILTER (WHERE i = 1) > 0.3 AS detected,
      CASE WHEN max(s) FILTER (WHERE i = 1) > 0.3 THEN CAST(max(lag) FILTER (WHERE i = 1) AS DOUBLE) END AS dominant_period,
      CASE WHEN max(s) FILTER (WHERE i = 1) > 0.3 THEN round(max(s) FILTER (WHERE i = 1), 6) END AS dominant_strength,
      CASE WHEN max(s) FILTER (WHERE i = 1) > 0.3 THEN CAST(COUNT(*) FILTER (WHERE i <= 3 AND s > 0.2) AS INT) END AS n_periods
    FROM k GROUP BY 1""",
)
def e10(spark, sf):
    out = S.acf_seasonality(events_hourly(spark, sf), KEYS)
    return rounded(out.withColumn("n_periods", F.size("periods")).drop("periods", "strengths"), 6).withColumn(
        "n_periods", F.when(F.col("detected"), F.col("n_periods"))
    )


@query("e11_adf_test")
def e11(spark, sf):
    return S.adf_test(orders_daily(spark, sf), KEYS)


@query(
    "e11_dickey_fuller",
    f"""WITH p AS (SELECT series, y, lag(y) OVER (PARTITION BY series ORDER BY ts) AS q FROM ({ORDERS_DAILY})),
    f AS (SELECT series, COUNT(*) AS n, regr_slope(y - q, q) AS b, regr_sxx(y - q, q) AS sxx, regr_syy(y - q, q) AS syy, regr_sxy(y - q, q) AS sxy
      FROM p WHERE q IS NOT NULL GROUP BY 1)
    SELECT series, n, round(b / sqrt((syy - b * sxy) / (n - 2) / sxx), 6) AS df_statistic FROM f""",
)
def e11_zero(spark, sf):
    return rounded(S.dickey_fuller(orders_daily(spark, sf), KEYS), 6)


DF = f"""q AS (SELECT series, y, lag(y) OVER (PARTITION BY series ORDER BY ts) AS q FROM ({ORDERS_DAILY})),
    f AS (SELECT series, COUNT(*) AS n, regr_slope(y - q, q) AS b, regr_sxx(y - q, q) AS sxx, regr_syy(y - q, q) AS syy, regr_sxy(y - q, q) AS sxy FROM q WHERE q IS NOT NULL GROUP BY 1),
    adf AS (SELECT series, b / sqrt((syy - b * sxy) / (n - 2) / sxx) AS t, -2.86154 - 2.8903 / n - 4.234 / n ** 2 - 40.040 / n ** 3 AS c5 FROM f)"""


@query(
    "e11_adf_test_zero_lag",
    f"""WITH {DF} SELECT series, round(t, 5) AS adf_statistic, round(c5, 6) AS adf_critical_5, CAST(0 AS BIGINT) AS adf_lags, t < c5 AS adf_stationary FROM adf""",
)
def e11_adf_zero(spark, sf):
    out = S.adf_test(orders_daily(spark, sf), KEYS, max_lag=0).drop("adf_critical_1", "adf_critical_10")
    return rounded(out, 5, adf_critical_5=6)


KPSS = f"""p AS (SELECT series, {POS}, y - avg(y) OVER (PARTITION BY series) AS e FROM ({ORDERS_DAILY})),
    s AS (SELECT series, n, sum(e) OVER (PARTITION BY series ORDER BY pos) AS s FROM p),
    eta AS (SELECT series, n, sum(s * s) / (n * n) AS eta FROM s GROUP BY 1, 2),
    c AS (SELECT a.series, lag, sum(a.e * b.e) AS g FROM p a JOIN (SELECT unnest(range(0, 13)) AS lag) ON true
      JOIN p b ON b.series = a.series AND b.pos = a.pos - lag GROUP BY 1, 2),
    v AS (SELECT series, sum(CASE WHEN lag = 0 THEN g ELSE 2 * (1 - lag / 13.0) * g END) AS v FROM c GROUP BY 1)"""


@query(
    "e12_kpss_test",
    f"""WITH {KPSS} SELECT series, round(eta / (v / n), 6) AS kpss_statistic, CAST(12 AS BIGINT) AS kpss_lags, eta / (v / n) < 0.463 AS kpss_stationary
    FROM eta JOIN v USING (series)""",
)
def e12(spark, sf):
    return rounded(S.kpss_test(orders_daily(spark, sf), KEYS, lags=12), 6)


@query(
    "e13_stationarity_fixed_lags",
    f"""WITH {DF}, {KPSS}, k AS (SELECT series, eta / (v / n) < 0.463 AS ks FROM eta JOIN v USING (series))
    SELECT series, CASE WHEN t < c5 AND ks THEN 'stationary' WHEN NOT t < c5 AND NOT ks THEN 'non_stationary' ELSE 'inconclusive' END AS conclusion FROM adf JOIN k USING (series)""",
)
def e13_fixed(spark, sf):
    return S.stationarity(orders_daily(spark, sf), KEYS, max_lag=0, lags=12).select("series", "conclusion")


@query("e13_stationarity")
def e13(spark, sf):
    return S.stationarity(orders_daily(spark, sf), KEYS)


@query(
    "e14_series_outliers",
    f"""WITH p AS (SELECT series, ts, y, {POS} FROM ({EVENTS_HOURLY})),
    q AS (SELECT series, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM p GROUP BY 1)
    SELECT series, CAST(ts AS VARCHAR) AS ts, round(y, 6) AS y, pos, round(q1 - 1.5 * (q3 - q1), 6) AS lower_bound, round(q3 + 1.5 * (q3 - q1), 6) AS upper_bound
    FROM p JOIN q USING (series) WHERE y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1)""",
)
def e14(spark, sf):
    out = S.series_outliers(events_hourly(spark, sf), KEYS)
    return rounded(out.withColumn("ts", F.col("ts").cast("string")), 6)


BASIC_RULES = ("irregular", "low_confidence", "gaps", "outliers", "short", "moderate", "long")


@query(
    "e15_ts_recommendations_basic",
    f"""WITH p AS (SELECT series, ts, y, {POS} FROM ({EVENTS_HOURLY})),
    g AS (SELECT series, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY series ORDER BY ts))) / 3600000000 AS h FROM p),
    s AS (SELECT series, COUNT(*) FILTER (WHERE h = 1) / COUNT(h) AS conf, COUNT(*) FILTER (WHERE h > 1.5) / COUNT(h) * 100 AS gaps, COUNT(*) AS n FROM g GROUP BY 1),
    q AS (SELECT series, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM p GROUP BY 1),
    o AS (SELECT p.series, avg(CAST(y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1) AS INT)) AS share FROM p JOIN q USING (series) GROUP BY 1)
    SELECT series, 'irregular' AS rule FROM s WHERE conf < 0.8 UNION ALL SELECT series, 'low_confidence' FROM s WHERE conf < 0.7 UNION ALL SELECT series, 'gaps' FROM s WHERE gaps > 10
    UNION ALL SELECT series, 'outliers' FROM o WHERE share > 0.05 UNION ALL SELECT series, 'short' FROM s WHERE n < 100 UNION ALL SELECT series, 'moderate' FROM s WHERE n BETWEEN 100 AND 499
    UNION ALL SELECT series, 'long' FROM s WHERE n >= 500""",
)
def e15_basic(spark, sf):
    out = S.ts_recommendations(S.profile_series(events_hourly(spark, sf), KEYS), KEYS)
    return out.filter(F.col("rule").isin(*BASIC_RULES)).select("series", "rule")


@query("e15_ts_recommendations")
def e15(spark, sf):
    return S.ts_recommendations(S.profile_series(events_hourly(spark, sf), KEYS), KEYS)


@query(
    "e16_profile_series",
    f"""WITH p AS (SELECT series, ts, y, {POS} FROM ({ORDERS_DAILY})),
    q AS (SELECT series, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM p GROUP BY 1)
    SELECT series, CAST(min(ts) AS VARCHAR) AS start_date, COUNT(*) AS total_periods, round(avg(y), 2) AS mean,
      round(regr_slope(y, pos), 4) AS slope, COUNT(*) FILTER (WHERE y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1)) AS n_outliers,
      round(1 / (1 + var_samp(y) / avg(y) ** 2), 6) AS stability_score
    FROM p JOIN q USING (series) GROUP BY 1""",
)
def e16(spark, sf):
    out = S.profile_series(orders_daily(spark, sf), KEYS).select(
        "series",
        F.col("date_range.start_date").cast("string").alias("start_date"),
        "date_range.total_periods",
        "basic_stats.mean",
        "trend.slope",
        "outliers.n_outliers",
        "stability.stability_score",
    )
    return rounded(out, 2, slope=4, stability_score=6)


def decompose_sql(source: str, minus: str, half: int = 6, period: int = 12) -> str:
    norm = "s - l" if minus == "-" else "s / l"
    return f"""WITH p AS (SELECT series, ts, y, {POS} FROM ({source})),
    t AS (SELECT *, CASE WHEN COUNT(*) OVER w = {2 * half + 1} THEN (sum(y) OVER w - 0.5 * lag(y, {half}) OVER o - 0.5 * lead(y, {half}) OVER o) / {period} END AS trend
      FROM p WINDOW w AS (PARTITION BY series ORDER BY pos ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING), o AS (PARTITION BY series ORDER BY pos)),
    f AS (SELECT series, pos % {period} AS ph, avg(y {minus} trend) AS s FROM t GROUP BY 1, 2),
    l AS (SELECT *, avg(s) OVER (PARTITION BY series) AS l FROM f),
    x AS (SELECT t.series, ts, y, pos, n, trend, {norm} AS seasonal FROM t JOIN l ON l.series = t.series AND ph = pos % {period})"""


@query(
    "e17_decompose",
    decompose_sql(ORDERS_MONTHLY, "-")
    + """, g AS (SELECT series, avg(y) AS g FROM x GROUP BY 1)
    SELECT series, CAST(ts AS VARCHAR) AS ts, pos, n, round(trend / g, 7) AS trend_share, round(seasonal / g, 7) AS seasonal_share,
    round((y - trend - seasonal) / g, 7) AS resid_share FROM x JOIN g USING (series)""",
)
def e17(spark, sf):
    series = orders_monthly(spark, sf)
    level = series.groupBy("series").agg(F.avg("y").alias("g"))
    out = S.decompose(series, KEYS).join(level, "series")
    shares = [(F.col(c) / F.col("g")).alias(f"{c}_share") for c in ("trend", "seasonal", "resid")]
    return rounded(out.select("series", F.col("ts").cast("string").alias("ts"), "pos", "n", *shares), 7)


@query(
    "e17_decompose_multiplicative",
    decompose_sql(ORDERS_MONTHLY, "/")
    + """ SELECT series, pos, round(ln(trend), 7) AS log_trend, round(seasonal, 6) AS seasonal, round(y / trend / seasonal, 6) AS resid FROM x""",
)
def e17_multiplicative(spark, sf):
    out = S.decompose(orders_monthly(spark, sf), KEYS, model="multiplicative")
    return rounded(out.select("series", "pos", F.log("trend").alias("log_trend"), "seasonal", "resid"), 6, log_trend=7)


@query(
    "e17_decomposition_strength",
    decompose_sql(ORDERS_DAILY, "-")
    + """ SELECT series, round(stddev_samp(trend) / stddev_samp(y), 6) AS trend_strength,
    round(stddev_samp(seasonal) / stddev_samp(y), 6) AS seasonal_strength FROM x GROUP BY 1""",
)
def e17_strength(spark, sf):
    return rounded(S.decomposition_strength(orders_daily(spark, sf), KEYS), 6)


@query(
    "e18_stability",
    f"SELECT series, round(1 / (1 + var_samp(y) / avg(y) ** 2), 6) AS stability_score, COUNT(*) AS sample_size FROM ({EVENTS_HOURLY}) GROUP BY 1",
)
def e18(spark, sf):
    return rounded(S.stability(events_hourly(spark, sf), KEYS), 6)
