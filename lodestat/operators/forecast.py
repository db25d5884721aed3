"""Forecasts for many keyed series at once.

Model fits reduce each series to small sufficient numbers (cross products, recursion summaries) over
position blocks, so one huge series is worked on by many tasks; only the small systems per series are
solved in one place. All forecasters return rows (keys, step, ts, yhat, yhat_lower, yhat_upper)
for ``horizon`` steps: a number for all series, or rows (keys, horizon).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.functions.columns import micros
from lodestat.operators.features import split_temporal
from lodestat.operators.metrics import evaluate_forecast
from lodestat.operators.series import frame_of, points
from lodestat.operators.series_features import future_dates, with_horizon
from lodestat.plans.skew import BLOCK_ROWS, block_sums, join_on, salted_join, with_position
from lodestat.session import materialize

FORECAST_COLUMNS = ("step", "ts", "yhat", "yhat_lower", "yhat_upper")

# Candidate (p, d, q) orders of the search.
ARIMA_ORDERS = ((0, 1, 1), (1, 1, 0), (1, 1, 1), (2, 1, 2), (0, 1, 2), (2, 1, 0), (1, 0, 1), (0, 0, 1), (1, 0, 0))
# Two-sided normal quantiles of the interval widths.
Z95, Z80 = 1.959963984540054, 1.2815515655446004


def _solve_rows(df: DataFrame, keys: Sequence[str], fields: list[tuple[str, str]], solve: Callable[[pd.Series], dict]) -> DataFrame:
    """One result row per summary row, computed by a small NumPy function."""
    kinds = {f.name: f for f in df.schema.fields}
    extra = T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in fields))
    schema = T.StructType([kinds[k] for k in keys] + extra.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield frame_of([{**{k: r[k] for k in keys}, **solve(r)} for _, r in batch.iterrows()], schema)

    return df.mapInPandas(run, schema)


def _stepped(fits: DataFrame, dates: DataFrame, keys: Sequence[str], lists: Sequence[str]) -> DataFrame:
    """Turn per-series arrays into one row per step with its date."""
    zipped = F.arrays_zip(*lists)
    rows = fits.select(*keys, F.posexplode(zipped).alias("__i", "__z")).select(
        *keys, (F.col("__i") + 1).cast("int").alias("step"), *[F.col(f"__z.{c}").alias(c) for c in lists]
    )
    return join_on(dates, rows, [*keys, "step"])


def forecast_sma(
    df: DataFrame, keys: Sequence[str], horizon: int | DataFrame, window: int | None = None, freq: str | None = None, ts: str = "ts", y: str = "y"
) -> DataFrame:
    """Mean of the last ``window`` values repeated; the default window is min(7, n/4), 3 for tiny series."""
    keys = list(keys)
    auto = F.least(F.lit(7), F.floor(F.col("n") / 4))
    size = F.lit(window) if window else F.when(auto > 0, auto).otherwise(3)
    level = points(df, keys, ts, y).filter(F.col("pos") >= F.col("n") - size).groupBy(*keys).agg(F.avg(y).alias("yhat"))
    none = F.lit(None).cast("double")
    return join_on(future_dates(df, keys, horizon, freq, ts), level, keys).withColumns(
        {"yhat_lower": none, "yhat_upper": none}
    ).select(*keys, "step", F.col(ts).alias("ts"), "yhat", "yhat_lower", "yhat_upper")


def forecast_last_value(
    df: DataFrame, keys: Sequence[str], horizon: int | DataFrame, freq: str | None = None, ts: str = "ts", y: str = "y"
) -> DataFrame:
    """Last value repeated, bounds 10% either side."""
    keys = list(keys)
    last = df.filter(F.col(y).isNotNull()).groupBy(*keys).agg(F.max_by(y, ts).alias("yhat"))
    out = join_on(future_dates(df, keys, horizon, freq, ts), last, keys)
    return out.select(
        *keys, "step", F.col(ts).alias("ts"), "yhat", (F.col("yhat") * 0.9).alias("yhat_lower"), (F.col("yhat") * 1.1).alias("yhat_upper")
    )


# --- ARIMA -----------------------------------------------------------------------------------------

LONG_AR = 12


def _differences(y: np.ndarray, d: int) -> np.ndarray:
    """d-th differences aligned with y; the first d entries are NaN."""
    out = y.astype(float)
    for _ in range(d):
        out = np.concatenate([[np.nan], np.diff(out)])
    return out


def _lagged(w: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate([np.full(min(k, len(w)), np.nan), w[: max(0, len(w) - k)]])


def _gram(columns: list[np.ndarray], owned: np.ndarray) -> np.ndarray:
    x = np.column_stack(columns)
    keep = owned & np.isfinite(x).all(axis=1)
    x = x[keep]
    return np.concatenate([(x.T @ x).ravel(), [len(x)]])


def _innovations(w: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """Residuals of the long autoregression ``phi`` = [constant, lag 1..LONG_AR]."""
    pred = np.full(len(w), phi[0])
    for j in range(1, LONG_AR + 1):
        pred = pred + phi[j] * _lagged(w, j)
    return w - pred


def _least_squares(gram: np.ndarray, idx: list[int]) -> tuple[np.ndarray, float] | None:
    """Coefficients on columns ``idx`` for the last column, and the residual sum of squares."""
    if not idx:
        return np.zeros(0), float(gram[-1, -1])
    a, b = gram[np.ix_(idx, idx)], gram[idx, -1]
    beta, *_ = np.linalg.lstsq(a, b, rcond=1e-12)
    return beta, float(gram[-1, -1] - 2 * beta @ b + beta @ a @ beta)


def _stable(ar: np.ndarray) -> bool:
    if not len(ar) or not np.any(ar):
        return True
    companion = np.zeros((len(ar), len(ar)))
    companion[0] = ar
    companion[1:, :-1] = np.eye(len(ar) - 1)
    return bool(np.max(np.abs(np.linalg.eigvals(companion))) < 0.9999)


def arima_fits(
    df: DataFrame, keys: Sequence[str], orders: Sequence[tuple[int, int, int]] = ARIMA_ORDERS, ts: str = "ts", y: str = "y"
) -> DataFrame:
    """Least-AIC order per series by two-stage least squares (Hannan and Rissanen 1982).

    Stage one fits a long autoregression and takes its residuals as innovations; stage two regresses on
    lags of the series and of the innovations. Both stages need only cross products, and one set of
    cross products per differencing degree serves every candidate order.
    """
    keys = list(keys)
    degrees = sorted({d for _, d, _ in orders})
    most_p, most_q = max(p for p, _, _ in orders), max(q for _, _, q in orders)
    if max(degrees) > 2:
        raise ValueError("differencing beyond 2 is not supported")
    rows = points(df, keys, ts, y)
    scale = rows.groupBy(*keys).agg(F.avg(y).alias("__m"), F.stddev_pop(y).alias("__s"))
    rows = salted_join(rows, scale, keys, "inner").withColumn("__s", F.when(F.col("__s") > 0, F.col("__s")).otherwise(1.0))
    rows = rows.withColumn("z", (F.col(y) - F.col("__m")) / F.col("__s"))
    rows = rows.select(*keys, "pos", "n", "z", "__m", "__s")
    wide = LONG_AR + 2

    def stage_one(frame: pd.DataFrame, owned: np.ndarray) -> np.ndarray:
        z, out = frame["z"].to_numpy(), []
        for d in degrees:
            w = _differences(z, d)
            out.append(_gram([np.ones(len(w)), *[_lagged(w, j) for j in range(1, LONG_AR + 1)], w], owned))
        return np.concatenate(out)

    def long_ar(r: pd.Series) -> dict:
        s, out = np.asarray(r["sums"], dtype=float), []
        for i in range(len(degrees)):
            block = s[i * (wide * wide + 1) : (i + 1) * (wide * wide + 1)]
            beta, _ = _least_squares(block[:-1].reshape(wide, wide), list(range(wide - 1)))
            out.append(beta)
        return {"phi": np.concatenate(out).tolist()}

    before = LONG_AR + max(degrees) + max(most_p, most_q)
    first = _solve_rows(block_sums(rows, keys, stage_one, before=before), keys, [("phi", "array<double>")], long_ar)
    with_phi = salted_join(rows, first, keys, "inner")
    size = 2 + most_p + most_q
    tail = most_p + most_q + 2

    def stage_two(frame: pd.DataFrame, owned: np.ndarray) -> np.ndarray:
        z, phi = frame["z"].to_numpy(), np.asarray(frame["phi"].iloc[0], dtype=float)
        ends = int(frame["pos"].iloc[-1]) == int(frame["n"].iloc[0]) - 1 and bool(owned[-1])
        out = []
        for i, d in enumerate(degrees):
            w = _differences(z, d)
            e = _innovations(w, phi[i * (LONG_AR + 1) : (i + 1) * (LONG_AR + 1)])
            cols = [np.ones(len(w)), *[_lagged(w, j) for j in range(1, most_p + 1)], *[_lagged(e, j) for j in range(1, most_q + 1)], w]
            # Use the same rows for every order: all innovation lags must exist.
            cols_ok = np.isfinite(_lagged(e, max(1, most_q)))
            out.append(_gram(cols, owned & cols_ok))
            last = np.zeros(tail)
            if ends:
                recent_w, recent_e = w[::-1][:most_p], e[::-1][:most_q]
                last[: len(recent_w)] = np.nan_to_num(recent_w)
                last[most_p : most_p + len(recent_e)] = np.nan_to_num(recent_e)
                last[most_p + most_q : most_p + most_q + 2] = np.pad(z[::-1][:2], (0, max(0, 2 - len(z))))[:2]
            out.append(last)
        if int(frame["pos"].iloc[0]) == 0:
            out.append([float(frame["n"].iloc[0]), float(frame["__m"].iloc[0]), float(frame["__s"].iloc[0])])
        else:
            out.append([0.0, 0.0, 0.0])
        return np.concatenate(out)

    def choose(r: pd.Series) -> dict:
        s = np.asarray(r["sums"], dtype=float)
        n, mean, sd = s[-3:]
        per = size * size + 1 + tail
        best, tried = None, 0
        for p, d, q in orders:
            i = degrees.index(d)
            part = s[i * per : (i + 1) * per]
            gram, rows_used, last = part[: size * size].reshape(size, size), part[size * size], part[size * size + 1 :]
            # A constant only without differencing.
            idx = ([0] if d == 0 else []) + list(range(1, 1 + p)) + list(range(1 + most_p, 1 + most_p + q))
            k = len(idx) + 1
            if rows_used < 3 * k + 5:
                continue
            beta, rss = _least_squares(gram, idx)
            shift = 1 if d == 0 else 0
            ar, ma = beta[shift : shift + p], beta[shift + p :]
            if not np.isfinite(beta).all() or not _stable(ar) or not _stable(-ma):
                continue
            tried += 1
            sigma2 = max(rss, 1e-12 * max(1.0, gram[-1, -1])) / rows_used
            llf = -rows_used / 2 * (math.log(2 * math.pi * sigma2 * sd * sd) + 1)
            aic, bic = -2 * llf + 2 * k, -2 * llf + k * math.log(rows_used)
            # Compare on the mean likelihood per row: degrees of differencing drop different rows.
            rank = aic / rows_used
            if best is None or rank < best[0]:
                best = (rank, p, d, q, aic, bic, float(beta[0]) if d == 0 else 0.0, ar, ma, sigma2, last)
        if best is None:
            return {"n": int(n), "reason": "series too short or no stable order"}
        _, p, d, q, aic, bic, const, ar, ma, sigma2, last = best
        return {
            "p": p, "d": d, "q": q, "aic": aic, "bic": bic, "constant": const, "ar": ar.tolist(), "ma": ma.tolist(),
            "sigma2": sigma2 * sd * sd, "n": int(n), "mean": mean, "scale": sd, "orders_fitted": tried,
            "recent_w": last[:most_p].tolist(), "recent_e": last[most_p : most_p + most_q].tolist(),
            "recent_z": last[most_p + most_q :].tolist(), "reason": None,
        }

    sums = block_sums(with_phi, keys, stage_two, before=before)
    return _solve_rows(
        sums,
        keys,
        [
            ("p", "int"), ("d", "int"), ("q", "int"), ("aic", "double"), ("bic", "double"), ("constant", "double"),
            ("ar", "array<double>"), ("ma", "array<double>"), ("sigma2", "double"), ("n", "long"), ("mean", "double"),
            ("scale", "double"), ("orders_fitted", "int"), ("recent_w", "array<double>"), ("recent_e", "array<double>"),
            ("recent_z", "array<double>"), ("reason", "string"),
        ],
        choose,
    )


def _psi_weights(ar: np.ndarray, ma: np.ndarray, d: int, h: int) -> np.ndarray:
    """Moving-average weights of the integrated process, which give the forecast variance."""
    poly = np.concatenate([[1.0], -ar])
    for _ in range(d):
        poly = np.convolve(poly, [1.0, -1.0])
    psi = np.zeros(h)
    for j in range(h):
        psi[j] = 1.0 if j == 0 else (ma[j - 1] if j <= len(ma) else 0.0)
        for i in range(1, min(j, len(poly) - 1) + 1):
            psi[j] -= poly[i] * psi[j - i]
    return psi


def _arima_path(r: pd.Series, horizon: int, z: float) -> dict:
    ar, ma, d = np.asarray(r["ar"], float), np.asarray(r["ma"], float), int(r["d"])
    w, e = list(np.asarray(r["recent_w"], float)), list(np.asarray(r["recent_e"], float))
    steps = []
    for _ in range(horizon):
        nxt = r["constant"] + sum(a * v for a, v in zip(ar, w)) + sum(m * v for m, v in zip(ma, e))
        steps.append(nxt)
        w, e = [nxt, *w][: max(1, len(w))], [0.0, *e][: max(1, len(e))]
    path, recent = np.asarray(steps), np.asarray(r["recent_z"], float)
    if d >= 1:
        start = [recent[0]] if d == 1 else [recent[0] - recent[1], recent[0]]
        for base in start:
            path = base + np.cumsum(path)
    yhat = r["mean"] + r["scale"] * path
    spread = z * np.sqrt(r["sigma2"] * np.cumsum(_psi_weights(ar, ma, d, horizon) ** 2))
    return {"yhat": yhat.tolist(), "yhat_lower": (yhat - spread).tolist(), "yhat_upper": (yhat + spread).tolist()}


def forecast_arima(
    df: DataFrame, keys: Sequence[str], horizon: int | DataFrame, orders: Sequence[tuple[int, int, int]] = ARIMA_ORDERS,
    freq: str | None = None, ts: str = "ts", y: str = "y", fits: DataFrame | None = None,
) -> DataFrame:
    """ARIMA forecast with 95% intervals; series without a usable order fall back to the last value."""
    keys = list(keys)
    fits = fits if fits is not None else arima_fits(df, keys, orders, ts, y)
    fits = materialize(fits, "arima-fits")
    arrays = [(c, "array<double>") for c in ("yhat", "yhat_lower", "yhat_upper")]
    usable = with_horizon(fits.filter("reason IS NULL"), keys, horizon)
    paths = _solve_rows(usable, keys, arrays, lambda r: _arima_path(r, int(r["__steps"]), Z95))
    dates = future_dates(df, keys, horizon, freq, ts).withColumnRenamed(ts, "ts")
    fitted = _stepped(paths, dates, keys, [c for c, _ in arrays])
    failed = fits.filter("reason IS NOT NULL").select(*keys)
    fallback = join_on(forecast_last_value(df, keys, horizon, freq, ts, y), failed, keys)
    return fitted.unionByName(fallback.select(*fitted.columns))


# --- Exponential smoothing -------------------------------------------------------------------------

# Candidate (trend, seasonal) configurations.
ETS_CONFIGS = (("add", "add"), ("add", "none"), ("none", "none"))
# First weights tried, the steps of the rounds that refine them, their bounds, and how many block maps a task joins.
ETS_GRID = (0.02, 0.1, 0.3, 0.6, 0.9)
ETS_STEPS = (0.1, 0.04, 0.015, 0.005, 0.002)
ETS_BOUNDS = (1e-4, 1 - 1e-4)
CHAIN = 64


def _grid(trend: str, seasonal: str) -> np.ndarray:
    b = ETS_GRID if trend == "add" else (0.0,)
    g = ETS_GRID if seasonal == "add" else (0.0,)
    return np.array([(x, u, v) for x in ETS_GRID for u in b for v in g])


def _initial_state(y: np.ndarray, trend: str, seasonal: str, m: int) -> np.ndarray:
    """Level, slope and phase offsets from the first two seasons."""
    state = np.zeros(2 + m)
    if seasonal == "add":
        first, second = y[:m].mean(), y[m : 2 * m].mean()
        state[1] = (second - first) / m if trend == "add" else 0.0
        state[0] = first - state[1] * (m + 1) / 2
        state[2:] = y[:m] - (state[0] + state[1] * np.arange(1, m + 1))
    else:
        state[0] = y[0]
        state[1] = (y[min(len(y) - 1, 9)] - y[0]) / max(1, min(len(y) - 1, 9)) if trend == "add" else 0.0
        state[0] -= state[1]
    return state


def _smooth(y: np.ndarray, starts: np.ndarray, weights: np.ndarray, grid: np.ndarray, trend: str, seasonal: str, m: int, phase: int):
    """Run the additive recursions for every grid point and every start state side by side.

    ``starts`` is (runs, 2 + m) and ``weights`` says how much of y each run sees (1 for the data, 0 for
    the response to a unit start). Returns error products (grid, runs, runs) and end states
    (grid, runs, 2 + m).
    """
    runs, g = len(starts), len(grid)
    level = np.repeat(starts[None, :, 0], g, 0)
    slope = np.repeat(starts[None, :, 1], g, 0)
    season = np.repeat(starts[None, :, 2:], g, 0)
    alpha, beta, gamma = (grid[:, i][:, None] for i in range(3))
    products = np.zeros((g, runs, runs))
    for t, value in enumerate(y):
        j = (phase + t) % m if seasonal == "add" else 0
        base = level + slope
        error = weights[None, :] * value - base
        if seasonal == "add":
            error = error - season[:, :, j]
        products += error[:, :, None] * error[:, None, :]
        level = base + alpha * error
        if trend == "add":
            slope = slope + alpha * beta * error
        if seasonal == "add":
            season[:, :, j] += gamma * error
    return products, np.concatenate([level[:, :, None], slope[:, :, None], season], axis=2)


def _free(trend: str, seasonal: str) -> list[int]:
    """Which of the three weights a configuration has."""
    return [0] + [1] * (trend == "add") + [2] * (seasonal == "add")


def _stencil(centre: np.ndarray, h: float, free: Sequence[int]) -> np.ndarray:
    """Weights around ``centre``: itself, one step either way in each free weight, one step in each pair of them."""
    unit = np.eye(3) * h
    centre = centre.copy()
    centre[list(free)] = np.clip(centre[list(free)], ETS_BOUNDS[0] + h, ETS_BOUNDS[1] - h)
    steps = [np.zeros(3)] + [s * unit[i] for i in free for s in (1, -1)] + [unit[i] + unit[j] for i in free for j in free if i < j]
    return centre + np.array(steps)


def _next_centre(grid: np.ndarray, sse: np.ndarray, h: float, free: Sequence[int]) -> np.ndarray:
    """Least point of the quadratic through a stencil, at most three steps away; without one its best point."""
    d, pairs = len(free), [(a, b) for a in range(len(free)) for b in range(len(free)) if a < b]
    up, down = sse[1 : 1 + 2 * d : 2], sse[2 : 2 + 2 * d : 2]
    hessian = np.diag(up - 2 * sse[0] + down)
    for (a, b), corner in zip(pairs, sse[1 + 2 * d :]):
        hessian[a, b] = hessian[b, a] = corner - up[a] - up[b] + sse[0]
    if not np.isfinite(hessian).all() or np.linalg.eigvalsh(hessian).min() <= 0:
        return grid[int(np.argmin(sse))]
    out = grid[0].copy()
    out[list(free)] += h * np.clip(np.linalg.solve(hessian, (down - up) / 2), -3, 3)
    out[list(free)] = np.clip(out[list(free)], *ETS_BOUNDS)
    return out


def _ets_pass(rows: DataFrame, keys: Sequence[str], weights: Callable[[pd.Series], np.ndarray]) -> DataFrame:
    """Squared errors and end states of a series and configuration at each of the ``weights`` its rows name.

    The recursions are linear in the state, so a block returns error products and end state as functions of the
    state it starts from. Such maps compose, and composing is associative: neighbouring maps are joined in a tree.
    """
    group = [*keys, "trend", "seasonal"]
    fields = {f.name: f for f in rows.schema.fields}
    names = [*group, "__b", "n", "m"]
    schema = T.StructType([fields[c] for c in names] + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("products", "ends")])

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        head, values = frame.iloc[0], frame["y"].to_numpy()
        m = int(head["m"]) if head["seasonal"] == "add" else 0
        dims = 2 + m
        if int(head["__b"]) == 0:
            starts, seen = _initial_state(values, head["trend"], head["seasonal"], m)[None, :], np.ones(1)
        else:
            starts, seen = np.vstack([np.zeros(dims), np.eye(dims)]), np.concatenate([[1.0], np.zeros(dims)])
        phase = int(head["pos"]) % max(m, 1)
        products, ends = _smooth(values, starts, seen, weights(head), head["trend"], head["seasonal"], max(m, 1), phase)
        out = frame[names].head(1).copy()
        out["products"], out["ends"] = [products.ravel()], [ends.ravel()]
        return out

    def compose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("__b")
        head = frame.iloc[0]
        dims = 2 + (int(head["m"]) if head["seasonal"] == "add" else 0)
        products = ends = None
        for first, p, e in zip(frame["__b"] == 0, frame["products"], frame["ends"]):
            runs = 1 if first else 1 + dims
            e = np.asarray(e, dtype=float).reshape(-1, runs, dims)
            p = np.asarray(p, dtype=float).reshape(-1, runs, runs)
            if products is None:
                products, ends = p, e
                continue
            ones = np.zeros((len(ends), ends.shape[1], 1))
            ones[:, 0] = 1
            start = np.concatenate([ones, ends], axis=2)  # (weights, runs, 1 + state) that this block starts from
            products = products + start @ p @ start.transpose(0, 2, 1)
            ends = start @ e
        out = frame[names].head(1).copy()
        out["__b"] = out["__b"] // CHAIN
        out["products"], out["ends"] = [products.ravel()], [ends.ravel()]
        return out

    parts = rows.groupBy(*group, "__b").applyInPandas(block, schema)
    blocks = int(rows.agg(F.max("__b")).first()[0] or 0) + 1
    while blocks > 1:
        parts = parts.groupBy(*group, F.floor(F.col("__b") / CHAIN)).applyInPandas(compose, schema)
        blocks = -(-blocks // CHAIN)
    return parts.drop("__b")


def ets_fits(
    df: DataFrame, keys: Sequence[str], configs: Sequence[tuple[str, str]] = ETS_CONFIGS, period: int | None = None,
    ts: str = "ts", y: str = "y", weights: Sequence[float] | None = None,
) -> DataFrame:
    """Least-AIC additive smoothing per series over configurations, weights fitted to the squared errors.

    Weights start at the best point of a grid and move to the least point of a quadratic through a stencil around
    them, whose spacing shrinks from round to round; each round reads the series once. ``weights`` (level, slope as a share
    of it, season) are taken as given instead. The season length is ``period``, else min(12, n/4) for more than 24 points; a
    season needs two full periods.
    """
    keys = list(keys)
    group = [*keys, "trend", "seasonal"]
    rows = points(df, keys, ts, y)
    m_auto = F.when(F.col("n") > 24, F.least(F.lit(12), F.floor(F.col("n") / 4))).otherwise(0)
    rows = rows.withColumn("m", (F.lit(period) if period else m_auto).cast("int")).withColumn("__b", F.floor(F.col("pos") / BLOCK_ROWS))
    # Every round reads the points again.
    rows = materialize(rows.select(*keys, "pos", "n", "m", "__b", F.col(y).alias("y")), "ets-points")
    cells = F.explode(F.array(*[F.struct(F.lit(t).alias("trend"), F.lit(s).alias("seasonal")) for t, s in configs]))
    rows = rows.withColumn("__c", cells).select(*rows.columns, "__c.trend", "__c.seasonal")
    rows = rows.filter((F.col("seasonal") == "none") | ((F.col("m") > 1) & (F.col("n") >= 2 * F.col("m"))))

    estimate = [("a", "double"), ("b", "double"), ("c", "double"), ("alpha", "double"), ("beta", "double"), ("gamma", "double"), ("sse", "double"), ("state", "array<double>")]
    kept = [*group, "n", "m"]

    def best(r: pd.Series, grid: np.ndarray, h: float | None) -> dict:
        sse = np.asarray(r["products"], dtype=float)
        i = int(np.argmin(sse))
        out = {"alpha": grid[i, 0], "beta": grid[i, 1], "gamma": grid[i, 2], "sse": sse[i]}
        out["state"] = np.asarray(r["ends"], dtype=float).reshape(len(grid), -1)[i].tolist()
        if h is not None and not sse[i] < r["sse"]:
            out = {c: r[c] for c in out}
            out["state"] = list(out["state"])
        centre = grid[i] if h is None else _next_centre(grid, sse, h, _free(r["trend"], r["seasonal"]))
        return {**out, "a": centre[0], "b": centre[1], "c": centre[2]}

    def first(r: pd.Series) -> np.ndarray:
        return _grid(r["trend"], r["seasonal"]) if weights is None else np.array([weights], dtype=float)

    fits = _solve_rows(_ets_pass(rows, keys, first), kept, estimate, lambda r: best(r, first(r), None))
    for h in ETS_STEPS if weights is None else ():

        def around(r: pd.Series, h: float = h) -> np.ndarray:
            return _stencil(np.array([r["a"], r["b"], r["c"]], dtype=float), h, _free(r["trend"], r["seasonal"]))

        fits = materialize(fits, "ets-fits")
        centred = salted_join(rows, fits.select(*group, "a", "b", "c"), group, "inner")
        tried = join_on(_ets_pass(centred, keys, around), fits.drop("n", "m"), group)
        fits = _solve_rows(tried, kept, estimate, lambda r, h=h, around=around: best(r, around(r), h))

    trend, m = (F.col("trend") == "add").cast("int"), F.when(F.col("seasonal") == "add", F.col("m")).otherwise(0)
    total = F.greatest("sse", F.lit(1e-12))
    scored = fits.select(
        *group, m.cast("int").alias("seasonal_periods"), "alpha", "beta", "gamma", total.alias("sse"),
        (F.col("n") * F.log(total / F.col("n")) + 2 * (2 + 2 * trend + (F.col("seasonal") == "add").cast("int") + m)).alias("aic"),
        "n", "state",
    )
    rest = [c for c in scored.columns if c not in keys]
    chosen = scored.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("aic", "trend", "seasonal")).alias("b"))
    return chosen.select(*keys, "b.*")


def forecast_ets(
    df: DataFrame, keys: Sequence[str], horizon: int | DataFrame, configs: Sequence[tuple[str, str]] = ETS_CONFIGS, period: int | None = None,
    freq: str | None = None, ts: str = "ts", y: str = "y", fits: DataFrame | None = None,
) -> DataFrame:
    """Smoothing forecast with bounds 10% either side."""
    keys = list(keys)
    fits = fits if fits is not None else ets_fits(df, keys, configs, period, ts, y)
    dates = future_dates(df, keys, horizon, freq, ts).withColumnRenamed(ts, "ts")
    out = join_on(dates, fits.select(*keys, "trend", "seasonal_periods", "n", "state"), keys)
    m = F.col("seasonal_periods")
    phase = F.pmod(F.col("n") + F.col("step") - 1, F.greatest(m, F.lit(1))).cast("int")
    season = F.when(m > 0, F.element_at("state", phase + 3)).otherwise(0.0)
    yhat = F.col("state")[0] + F.col("step") * F.col("state")[1] + season
    return out.withColumn("yhat", yhat).select(
        *keys, "step", "ts", "yhat", (F.col("yhat") * 0.9).alias("yhat_lower"), (F.col("yhat") * 1.1).alias("yhat_upper")
    )


def smoothed_level(df: DataFrame, keys: Sequence[str], alpha: float, ts: str = "ts", y: str = "y") -> DataFrame:
    """Final level of simple smoothing with a fixed weight, started at the first value."""
    rows = points(df, keys, ts, y)
    age = F.col("n") - 1 - F.col("pos")
    weight = F.pow(F.lit(1 - alpha), age) * F.when(F.col("pos") == 0, 1.0).otherwise(alpha)
    return rows.groupBy(*keys).agg(F.sum(weight * F.col(y)).alias("level"))


# --- Additive trend + seasonality ------------------------------------------------------------------

CHANGE_POINTS = 25
CHANGE_SHARE = 0.8
# Fixed values: (days per cycle, Fourier terms) per seasonality.
SEASONALITIES = {"yearly": (365.25, 10), "weekly": (7.0, 3), "daily": (1.0, 4)}
RIDGE = {"trend": 1e-6, "hinge": 1.0, "season": 1e-2}


def _additive_design(days: np.ndarray, lo: float, hi: float, seasons: Sequence[str]) -> tuple[np.ndarray, dict[str, list[int]]]:
    """Piecewise-linear trend and Fourier columns, with the column numbers of each component."""
    x = (days - lo) / max(hi - lo, 1e-9)
    cols, parts = [np.ones_like(x), x], {"trend": [0, 1]}
    for knot in np.linspace(0, CHANGE_SHARE, CHANGE_POINTS + 2)[1:-1]:
        parts["trend"].append(len(cols))
        cols.append(np.maximum(x - knot, 0))
    for name in seasons:
        cycle, terms = SEASONALITIES[name]
        parts[name] = []
        for k in range(1, terms + 1):
            for fn in (np.sin, np.cos):
                parts[name].append(len(cols))
                cols.append(fn(2 * np.pi * k * days / cycle))
    return np.column_stack(cols), parts


def additive_fits(
    df: DataFrame, keys: Sequence[str], seasonalities: Sequence[str] = ("yearly", "weekly"), ts: str = "ts", y: str = "y"
) -> DataFrame:
    """Additive model per series (form of Taylor and Letham 2018) by ridge on summed cross products."""
    keys, seasons = list(keys), list(seasonalities)
    unknown = set(seasons) - set(SEASONALITIES)
    if unknown:
        raise ValueError(f"unknown seasonality {sorted(unknown)}")
    rows = points(df, keys, ts, y).withColumn("days", micros(F.col(ts)) / 86_400_000_000)
    span = rows.groupBy(*keys).agg(
        F.min("days").alias("lo"), F.max("days").alias("hi"), F.avg(y).alias("m"), F.stddev_pop(y).alias("s"), F.count(y).alias("n_points")
    )
    span = span.withColumn("s", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0))
    rows = salted_join(rows.select(*keys, "pos", "days", F.col(y).alias("y")), span, keys, "inner")
    width = _additive_design(np.zeros(1), 0.0, 1.0, seasons)[0].shape[1]

    def partial(frame: pd.DataFrame, owned: np.ndarray) -> np.ndarray:
        frame = frame[owned]
        head = frame.iloc[0]
        x, _ = _additive_design(frame["days"].to_numpy(), head["lo"], head["hi"], seasons)
        x = np.column_stack([x, (frame["y"].to_numpy() - head["m"]) / head["s"]])
        return (x.T @ x).ravel()

    sums = join_on(block_sums(rows, keys, partial), span, keys)

    def solve(r: pd.Series) -> dict:
        gram = np.asarray(r["sums"], float).reshape(width + 1, width + 1)
        _, parts = _additive_design(np.zeros(1), 0.0, 1.0, seasons)
        penalty = np.full(width, RIDGE["season"])
        penalty[parts["trend"][:2]], penalty[parts["trend"][2:]] = RIDGE["trend"], RIDGE["hinge"]
        a, b = gram[:-1, :-1], gram[:-1, -1]
        beta = np.linalg.solve(a + np.diag(penalty), b)
        rss = float(gram[-1, -1] - 2 * beta @ b + beta @ a @ beta)
        hinges = beta[parts["trend"][2:]]
        return {
            "lo": r["lo"], "hi": r["hi"], "mean": r["m"], "scale": r["s"], "n": int(r["n_points"]), "coefficients": beta.tolist(),
            "sigma": math.sqrt(max(rss, 0.0) / max(1.0, r["n_points"])) * r["s"],
            "change_points": int((np.abs(hinges) > 0.01 * max(1e-9, np.abs(beta).max())).sum()),
        }

    fields = [
        ("lo", "double"), ("hi", "double"), ("mean", "double"), ("scale", "double"), ("n", "long"),
        ("coefficients", "array<double>"), ("sigma", "double"), ("change_points", "int"),
    ]
    return _solve_rows(sums, keys, fields, solve)


def additive_components(rows: DataFrame, fits: DataFrame, keys: Sequence[str], seasonalities: Sequence[str] = ("yearly", "weekly"), ts: str = "ts") -> DataFrame:
    """Fitted value and its components for rows with a time column."""
    keys, seasons = list(keys), list(seasonalities)
    data = salted_join(rows, fits.select(*keys, "lo", "hi", "mean", "scale", "coefficients", "sigma"), keys, "inner")
    data = data.withColumn("__days", micros(F.col(ts)) / 86_400_000_000)
    outputs = ["yhat", "trend", *seasons]
    kept = [f.name for f in rows.schema.fields]
    schema = T.StructType(rows.schema.fields + [T.StructField("sigma", T.DoubleType())] + [T.StructField(c, T.DoubleType()) for c in outputs])
    columns = [f.name for f in schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            beta = np.vstack(batch["coefficients"].to_numpy())
            lo, hi = batch["lo"].to_numpy(), batch["hi"].to_numpy()
            # The scaled time x runs over [0, 1] on the fitted span.
            days = batch["__days"].to_numpy()
            x, parts = _additive_design(days, 0.0, 1.0, seasons)
            unit = (days - lo) / np.maximum(hi - lo, 1e-9)
            trend_cols, _ = _additive_design(unit, 0.0, 1.0, [])
            x[:, parts["trend"]] = trend_cols
            out = batch[[*kept, "sigma"]].copy()
            scale, mean = batch["scale"].to_numpy(), batch["mean"].to_numpy()
            total = np.zeros(len(batch))
            for name in ["trend", *seasons]:
                part = (x[:, parts[name]] * beta[:, parts[name]]).sum(axis=1) * scale
                out[name] = part + mean if name == "trend" else part
                total += part
            out["yhat"] = total + mean
            yield out[columns]

    return data.mapInPandas(run, schema)


def forecast_additive(
    df: DataFrame, keys: Sequence[str], horizon: int | DataFrame, seasonalities: Sequence[str] = ("yearly", "weekly"),
    freq: str | None = None, ts: str = "ts", y: str = "y", fits: DataFrame | None = None,
) -> DataFrame:
    """Trend plus seasonal forecast with 80% bounds from the residual spread."""
    keys = list(keys)
    fits = fits if fits is not None else additive_fits(df, keys, seasonalities, ts, y)
    dates = future_dates(df, keys, horizon, freq, ts).withColumnRenamed(ts, "ts")
    out = additive_components(dates, fits, keys, seasonalities)
    half = F.col("sigma") * Z80
    return out.select(*keys, "step", "ts", "yhat", (F.col("yhat") - half).alias("yhat_lower"), (F.col("yhat") + half).alias("yhat_upper"))


# --- Comparing forecasters -------------------------------------------------------------------------

FORECASTERS: dict[str, Callable[..., DataFrame]] = {
    "sma": forecast_sma,
    "last_value": forecast_last_value,
    "arima": forecast_arima,
    "exponential_smoothing": forecast_ets,
    "additive": forecast_additive,
}


def evaluate_forecasters(
    df: DataFrame, keys: Sequence[str], models: Sequence[str] = ("sma", "last_value"), test_size: float = 0.2, period: int = 1,
    freq: str | None = None, ts: str = "ts", y: str = "y",
) -> DataFrame:
    """Fit each model on the first part of every series and score it on the rest, as many steps as that series has there.

    A model without a forecast for a series keeps its row with NULL scores and a reason.
    """
    keys = list(keys)
    rows = df.filter(F.col(y).isNotNull() & F.col(ts).isNotNull()).select(*keys, F.col(ts).alias("ts"), F.col(y).alias("y"))
    parts = materialize(split_temporal(rows, keys, "ts", test_size), "split")
    train, test = parts.filter(~F.col("is_test")).drop("is_test"), parts.filter("is_test").drop("is_test")
    actual = with_position(test, keys, "ts").select(*keys, "ts", F.col("y").alias("a"), (F.col("pos") + 1).cast("int").alias("step"))
    horizon = parts.groupBy(*keys).agg(F.count_if("is_test").alias("horizon"))
    scored = None
    for name in models:
        fc = FORECASTERS[name](train, keys, horizon, freq=freq).select(*keys, "step", F.col("yhat").alias("f"))
        joined = join_on(actual, fc, [*keys, "step"]).withColumn("model", F.lit(name))
        scored = joined if scored is None else scored.unionByName(joined)
    scores = evaluate_forecast(scored, [*keys, "model"], period=period)
    wanted = test.select(*keys).distinct().withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    out = join_on(wanted, scores, [*keys, "model"], "left")
    return out.withColumn("reason", F.when(F.col("rmse").isNull(), "no forecast"))


def best_forecaster(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Model with the least rmse per series (ties by name)."""
    best = scores.filter(F.col("rmse").isNotNull()).groupBy(*keys).agg(F.min(F.struct("rmse", "model")).alias("b"))
    return best.select(*keys, "b.model", "b.rmse")


def forecast_frame(
    df: DataFrame, keys: Sequence[str], horizon: int, model: str = "sma", history: int = 30, test_size: float = 0.2,
    freq: str | None = None, ts: str = "ts", y: str = "y",
) -> DataFrame:
    """Last training points, the test part with its forecast, and the future, tagged by ``segment``.

    As the model is fitted on the training part only, the future rows repeat its first steps, dated
    after the last observation.
    """
    keys = list(keys)
    rows = df.filter(F.col(y).isNotNull() & F.col(ts).isNotNull()).select(*keys, F.col(ts).alias("ts"), F.col(y).alias("y"))
    parts = materialize(split_temporal(rows, keys, "ts", test_size), "split")
    train, test = parts.filter(~F.col("is_test")).drop("is_test"), parts.filter("is_test").drop("is_test")
    actual = with_position(test, keys, "ts").withColumn("step", (F.col("pos") + 1).cast("int")).drop("pos", "n")
    steps = parts.groupBy(*keys).agg(F.greatest(F.count_if("is_test"), F.lit(horizon)).alias("horizon"))
    fc = materialize(FORECASTERS[model](train, keys, steps, freq=freq), "forecast")
    none = F.lit(None).cast("double")
    recent = with_position(train, keys, "ts").filter(F.col("pos") >= F.col("n") - history)
    past = recent.select(*keys, "ts", F.col("y").alias("actual"), none.alias("predicted"), none.alias("lower"), none.alias("upper"), F.lit("historical").alias("segment"))
    seen = join_on(actual, fc.drop("ts"), [*keys, "step"]).select(
        *keys, "ts", F.col("y").alias("actual"), F.col("yhat").alias("predicted"), none.alias("lower"), none.alias("upper"), F.lit("validation").alias("segment")
    )
    dates = future_dates(rows, keys, horizon, freq, "ts")
    ahead = join_on(dates, fc.drop("ts"), [*keys, "step"]).select(
        *keys, "ts", none.alias("actual"), F.col("yhat").alias("predicted"), F.col("yhat_lower").alias("lower"), F.col("yhat_upper").alias("upper"), F.lit("future").alias("segment")
    )
    return past.unionByName(seen).unionByName(ahead)
