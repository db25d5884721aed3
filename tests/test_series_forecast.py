"""Planted structure in series is found, and blocks of any size give the same answers."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestat.operators import forecast as G
from lodestat.operators import series as S
from lodestat.operators import series_features as SF
from lodestat.plans import skew, spectrum
from lodestat.plans.spectrum import magnitudes

START = dt.datetime(2022, 1, 1)


def series(spark, values, key="s", step=dt.timedelta(days=1)):
    rows = [(key, START + i * step, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, y double")


def ar1(n, phi=0.6, seed=1):
    rng, y = random.Random(seed), [0.0]
    for _ in range(n - 1):
        y.append(phi * y[-1] + rng.gauss(0, 1))
    return y


@pytest.fixture
def small_blocks(monkeypatch):
    """Make every helper cut the series into many blocks."""
    monkeypatch.setattr(skew, "BLOCK_ROWS", 64)
    monkeypatch.setattr(G, "BLOCK_ROWS", 64)


def test_ar_coefficient_recovered(spark, small_blocks):
    fit = G.arima_fits(series(spark, ar1(1500)), ["k"], [(1, 0, 0)]).first()
    assert fit["ar"][0] == pytest.approx(0.6, abs=0.06)
    assert fit["sigma2"] == pytest.approx(1.0, abs=0.1)


def test_arima_prefers_difference_for_random_walk(spark):
    walk = np.cumsum(np.random.default_rng(3).normal(size=800)) + 100
    out = G.forecast_arima(series(spark, walk), ["k"], 5).orderBy("step").collect()
    assert abs(out[0]["yhat"] - walk[-1]) < 5
    widths = [r["yhat_upper"] - r["yhat_lower"] for r in out]
    assert all(b >= a for a, b in zip(widths, widths[1:]))


def test_horizon_per_series(spark):
    long, short = series(spark, ar1(100), "long"), series(spark, ar1(40, seed=3), "short")
    both = long.unionByName(short)
    steps = spark.createDataFrame([("long", 7), ("short", 2)], "k string, horizon int")
    for name in ("sma", "last_value", "arima"):
        counts = {r["k"]: r["count"] for r in G.FORECASTERS[name](both, ["k"], steps).groupBy("k").count().collect()}
        assert counts == {"long": 7, "short": 2}
    none = spark.createDataFrame([("long", 3), ("short", 0)], "k string, horizon int")
    assert {r["k"] for r in G.forecast_last_value(both, ["k"], none).collect()} == {"long"}


def test_series_of_unlike_lengths_score_as_alone(spark):
    long, short = series(spark, ar1(100), "long"), series(spark, ar1(40, seed=3), "short")
    scores = lambda df: {(r["k"], r["model"]): r["rmse"] for r in G.evaluate_forecasters(df, ["k"], ("sma", "arima")).collect()}
    assert scores(long.unionByName(short)) == pytest.approx(scores(long) | scores(short), rel=1e-9)


def test_short_series_falls_back_to_last_value(spark):
    out = G.forecast_arima(series(spark, [1, 2, 3, 4]), ["k"], 3).collect()
    assert [r["yhat"] for r in out] == [4.0] * 3


def test_ets_blocks_agree_with_one_block(spark, monkeypatch):
    noise = np.random.default_rng(2).normal(0, 0.1, 300)
    y = [10 + 0.1 * t + 3 * math.sin(2 * math.pi * t / 12) + noise[t] for t in range(300)]
    df = series(spark, y)
    whole = G.ets_fits(df, ["k"]).first()
    monkeypatch.setattr(G, "BLOCK_ROWS", 50)
    cut = G.ets_fits(df, ["k"]).first()
    assert (whole["trend"], whole["seasonal"]) == (cut["trend"], cut["seasonal"])
    assert cut["alpha"] == pytest.approx(whole["alpha"], abs=1e-6)
    assert cut["sse"] == pytest.approx(whole["sse"], rel=1e-6, abs=1e-6)
    assert cut["state"] == pytest.approx(whole["state"])
    assert whole["seasonal"] == "add"
    ahead = [r["yhat"] for r in G.forecast_ets(df, ["k"], 12).orderBy("step").collect()]
    truth = [10 + 0.1 * t + 3 * math.sin(2 * math.pi * t / 12) for t in range(300, 312)]
    assert np.abs(np.array(ahead) - truth).max() < 0.5


def direct_sse(y, alpha, beta, start):
    """Squared errors of the level and slope recursions, written out."""
    (level, slope), total = start, 0.0
    for value in y:
        error = value - level - slope
        level, slope, total = level + slope + alpha * error, slope + alpha * beta * error, total + error * error
    return total


def test_ets_weights_are_the_least_squares_ones(spark, monkeypatch):
    """Fitted weights against a fine search, through several levels of joined block maps."""
    rng = np.random.default_rng(11)
    level, slope, y = 20.0, 0.2, []
    for e in rng.normal(0, 1, 1200):
        y.append(level + slope + e)
        level, slope = level + slope + 0.43 * e, slope + 0.43 * 0.12 * e
    monkeypatch.setattr(G, "BLOCK_ROWS", 100)
    monkeypatch.setattr(G, "CHAIN", 3)
    fit = G.ets_fits(series(spark, y), ["k"], [("add", "none")]).first()
    start = G._initial_state(np.array(y), "add", "none", 0)[:2]
    near = [(direct_sse(y, a, b, start), a, b) for a in np.arange(0.33, 0.53, 0.01) for b in np.arange(0.04, 0.22, 0.01)]
    _, a0, b0 = min(near)
    best = min((direct_sse(y, a, b, start), a, b) for a in a0 + np.arange(-0.01, 0.0101, 0.001) for b in b0 + np.arange(-0.01, 0.0101, 0.001))
    assert (fit["alpha"], fit["beta"]) == pytest.approx(best[1:], abs=1e-3)
    assert fit["sse"] <= best[0] * (1 + 1e-9)
    assert fit["sse"] == pytest.approx(direct_sse(y, fit["alpha"], fit["beta"], start), rel=1e-9)


def test_ets_given_weights_through_joined_blocks(spark, monkeypatch):
    y = [10 + 0.1 * t + 3 * math.sin(2 * math.pi * t / 12) for t in range(300)]
    df = series(spark, y)
    whole = G.ets_fits(df, ["k"], [("add", "add")], weights=(0.3, 0.1, 0.2)).first()
    monkeypatch.setattr(G, "BLOCK_ROWS", 25)
    monkeypatch.setattr(G, "CHAIN", 2)
    cut = G.ets_fits(df, ["k"], [("add", "add")], weights=(0.3, 0.1, 0.2)).first()
    assert (whole["alpha"], whole["beta"], whole["gamma"]) == (0.3, 0.1, 0.2)
    assert cut["sse"] == pytest.approx(whole["sse"], rel=1e-9, abs=1e-9)
    assert cut["state"] == pytest.approx(whole["state"])


def test_additive_finds_weekly_shape(spark, small_blocks):
    y = [50 + 0.05 * t + (10 if (t % 7) in (0, 1) else 0) for t in range(700)]
    out = G.forecast_additive(series(spark, y), ["k"], 14, ["weekly"]).orderBy("step").collect()
    truth = [50 + 0.05 * t + (10 if (t % 7) in (0, 1) else 0) for t in range(700, 714)]
    assert np.abs(np.array([r["yhat"] for r in out]) - truth).max() < 1.5
    assert all(r["yhat_lower"] < r["yhat"] < r["yhat_upper"] for r in out)


def direct_kpss(y):
    n, e = len(y), np.asarray(y) - np.mean(y)
    cov = np.array([(e[i:] * e[: n - i]).sum() for i in range(n // 2)])
    lags = S._hobijn_lags(n, cov)
    w = 1 - np.arange(1, lags + 1) / (lags + 1)
    return (np.cumsum(e) ** 2).sum() / n**2 / ((cov[0] + 2 * (w * cov[1 : lags + 1]).sum()) / n)


def test_adf_and_kpss_decisions(spark, small_blocks):
    draws = {
        "still": np.random.default_rng(0).normal(size=600),
        "slow": np.array(ar1(600, 0.2)),  # this draw's mean wanders: KPSS rejects it, ADF does not
        "walk": np.cumsum(np.random.default_rng(5).normal(size=600)),
    }
    df = None
    for name, y in draws.items():
        part = series(spark, y, name)
        df = part if df is None else df.unionByName(part)
    got = {r["k"]: r for r in S.stationarity(df, ["k"]).collect()}
    for name, y in draws.items():
        assert got[name]["kpss_statistic"] == pytest.approx(direct_kpss(y), rel=1e-9)
    names = {(True, True): "stationary", (False, False): "non_stationary"}
    for name, y in draws.items():
        r = got[name]
        both = (r["adf_statistic"] < r["adf_critical_5"], direct_kpss(y) < 0.463)
        assert r["conclusion"] == names.get(both, "inconclusive")
    assert got["still"]["conclusion"] == "stationary" and got["slow"]["conclusion"] == "inconclusive"
    assert got["walk"]["conclusion"] != "stationary"


def test_adf_matches_direct_regression(spark, small_blocks):
    y = ar1(400, seed=9)
    got = S.adf_test(series(spark, y), ["k"]).first()
    z, p = np.array(y), got["adf_lags"]
    dz = np.diff(z)
    t = np.arange(p + 1, len(z))
    x = np.column_stack([np.ones(len(t)), z[t - 1], *[dz[t - 1 - j] for j in range(1, p + 1)]])
    beta, rss, *_ = np.linalg.lstsq(x, dz[t - 1], rcond=None)
    se = math.sqrt(rss[0] / (len(t) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
    assert got["adf_statistic"] == pytest.approx(beta[1] / se, rel=1e-6)


def test_positions_and_frames_across_blocks(spark, small_blocks):
    df = series(spark, range(500))
    out = SF.rolling_features(df, ["k"], [7]).orderBy("ts").collect()
    assert out[5]["y_rolling_mean_7"] is None
    assert [r["y_rolling_mean_7"] for r in out[6:]] == [i - 3 for i in range(6, 500)]
    lagged = SF.lag_features(df, ["k"], [30]).orderBy("ts").collect()
    assert [r["y_lag_30"] for r in lagged] == [None] * 30 + [float(i) for i in range(470)]


def test_interpolation_edges(spark, small_blocks):
    values = [None, 1, None, 3, None, None] + [5] * 200 + [None] * 100
    got = [r["y"] for r in SF.interpolate(series(spark, values), ["k"]).orderBy("ts").collect()]
    assert got[:6] == [None, 1.0, 2.0, 3.0, pytest.approx(3 + 2 / 3), pytest.approx(3 + 4 / 3)]
    assert got[-100:] == [5.0] * 100


@pytest.mark.parametrize("task", [16, 64, 1 << 18])
def test_magnitudes_equal_the_direct_transform(spark, task):
    """Primes, powers of two, their neighbours and short series, below and above the points of a task, in one call."""
    rng = np.random.default_rng(4)
    draws = {m: rng.normal(size=m) for m in (2, 10, 16, 17, 127, 128, 129, 997, 1024, 1030)}
    rows = [(f"s{m}", t, m, float(v)) for m, x in draws.items() for t, v in enumerate(x)]
    rows += [(None, t, m, v) for _, t, m, v in rows if m == 127]
    df = spark.createDataFrame(rows, "k string, __t long, __m long, __d double")
    got = magnitudes(df, ["k"], task=task).orderBy("k", "__k").collect()
    for name, m in [(f"s{m}", m) for m in draws] + [(None, 127)]:
        mine = [(r["__k"], r["__mag"]) for r in got if r["k"] == name]
        direct = np.abs(np.fft.fft(draws[m]))
        assert [k for k, _ in mine] == list(range(1, m // 2))
        assert [v for _, v in mine] == pytest.approx(list(direct[1 : m // 2]), rel=1e-9, abs=1e-9)


def test_blocks_of_the_transform_stay_bounded():
    for m in (5, 997, 1 << 20, (1 << 20) + 1, 123_456_789, 5_000_000_011):
        n1, n2, wide, high = spectrum._sides(m, 1 << 18)
        assert 2 * m - 1 <= n1 * n2 < 4 * m
        assert wide * n1 <= 1 << 18 and high * n2 <= 1 << 18
    for j in (3, (1 << 32) + 7, (1 << 39) + 12345):
        assert int(spectrum._squares(np.array([j]), (1 << 40) - 87)[0]) == j * j % ((1 << 40) - 87)


def test_spectrum_of_one_long_series_in_blocks(spark, monkeypatch):
    y = [math.sin(2 * math.pi * t / 9) + 0.3 * math.sin(2 * math.pi * t / 5) + 0.01 * t for t in range(400)]
    df = series(spark, y)
    whole = S.spectral_seasonality(df, ["k"]).orderBy("rank").collect()
    monkeypatch.setattr(S, "magnitudes", lambda d, keys: magnitudes(d, keys, task=32))
    cut = S.spectral_seasonality(df, ["k"]).orderBy("rank").collect()
    assert [r["period"] for r in whole] == [r["period"] for r in cut]
    assert [r["strength"] for r in whole] == pytest.approx([r["strength"] for r in cut])
    assert whole[0]["period"] == pytest.approx(9, rel=0.05)


def test_monthly_dates_and_frequency(spark):
    ends = [dt.datetime(2020 + m // 12, m % 12 + 1, 28) for m in range(30)]
    df = spark.createDataFrame([("s", e, 1.0) for e in ends], "k string, ts timestamp_ntz, y double")
    assert S.detect_frequency_days(df, ["k"]).first()["frequency"] == "M"
    assert S.detect_frequency(df, ["k"]).first()["calendar_regular"]
    nxt = [r["ts"] for r in SF.future_dates(df, ["k"], 2).orderBy("step").collect()]
    assert nxt == [dt.datetime(2022, 7, 28), dt.datetime(2022, 8, 28)]


def test_null_series_key_is_a_series(spark):
    df = series(spark, range(20)).unionByName(series(spark, range(5), None))
    assert S.trend(df, ["k"]).count() == 2
    assert SF.lag_features(df, ["k"], [1]).count() == 25


def test_single_point_series(spark):
    df = series(spark, [1.0])
    assert S.detect_frequency(df, ["k"]).first()["inferred_freq"] == "unknown"
    assert S.acf_seasonality(df, ["k"]).first()["detected"] is False


def test_decomposition_adds_up(spark):
    df = series(spark, [t + (t % 12) for t in range(96)])
    out = S.decompose(df, ["k"]).filter(F.col("trend").isNotNull())
    worst = out.agg(F.max(F.abs(F.col("y") - F.col("trend") - F.col("seasonal") - F.col("resid")))).first()[0]
    assert worst < 1e-9
