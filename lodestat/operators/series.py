"""Profiling of keyed time series.

Every operator takes ``keys`` (series key columns), a time column and, where needed, a value column.
Windows never span a whole series: see :mod:`lodestat.plans.skew`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.functions.columns import micros
from lodestat.operators.profile import iqr_bounds
from lodestat.plans.quantiles import exact_quantiles
from lodestat.plans.spectrum import magnitudes
from lodestat.session import materialize
from lodestat.plans.skew import (
    block_sums,
    join_on,
    salted_join,
    with_frames,
    with_position,
    with_previous,
    with_running,
)

HOUR = 3_600_000_000
DAY = 24 * HOUR

# Expected hours between points per frequency label.
EXPECTED_HOURS = {"H": 1, "D": 24, "W": 168, "M": 720, "Q": 2190, "Y": 8760}


def points(df: DataFrame, keys: Sequence[str], ts: str = "ts", y: str = "y") -> DataFrame:
    """Non-null points of the series with position and length (``pos``, ``n``)."""
    return with_position(df.filter(F.col(y).isNotNull() & F.col(ts).isNotNull()).select(*keys, ts, y), keys, ts)


def gap_counts(df: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """How often each gap (microseconds) between consecutive times occurs; repeats are gaps of 0."""
    keys = list(keys)
    stamps = df.filter(F.col(ts).isNotNull()).groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("__c"))
    both = F.array(
        F.struct((micros(F.col(ts)) - micros(F.col("prev_ts"))).alias("gap"), F.lit(1).cast("long").alias("n")),
        F.struct(F.lit(0).cast("long").alias("gap"), (F.col("__c") - 1).alias("n")),
    )
    gaps = with_previous(stamps, keys, ts).select(*keys, F.inline(both))
    return gaps.filter(F.col("gap").isNotNull() & (F.col("n") > 0)).groupBy(*keys, "gap").agg(F.sum("n").alias("n"))


def _label_hours(h: Column) -> Column:
    return (
        F.when(F.abs(h - 1) < 0.1, "H")
        .when(F.abs(h - 24) < 1, "D")
        .when(h.between(160, 192), "W")
        .when(h.between(720, 780), "M")
        .when(h.between(2160, 2208), "Q")
        .when(h.between(8640, 8928), "Y")
        .otherwise("unknown")
    )


def detect_frequency(df: DataFrame, keys: Sequence[str], ts: str = "ts", top: int = 5) -> DataFrame:
    """Dominant gap in hours, its share (confidence), frequency label and the most common gaps.

    ``calendar_regular`` marks series whose steps are calendar months of varying length.
    """
    keys = list(keys)
    hours = (
        gap_counts(df, keys, ts)
        .withColumn("hours", F.round(F.col("gap") / HOUR, 2))
        .groupBy(*keys, "hours")
        .agg(F.sum("n").alias("n"))
    )
    totals = hours.groupBy(*keys).agg(
        F.sum("n").alias("__total"),
        F.sum(F.when(F.col("hours").between(28 * 24, 31 * 24), F.col("n")).otherwise(0)).alias("__month"),
    )
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "hours")
    ranked = hours.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= top)
    common = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__r", "hours", "n"))).alias("__top"))
    out = join_on(common, totals, keys)
    dominant = F.col("__top")[0]
    out = out.select(
        *keys,
        _label_hours(dominant["hours"]).alias("inferred_freq"),
        (dominant["n"] / F.col("__total")).alias("frequency_confidence"),
        (dominant["n"] / F.col("__total") < 0.8).alias("irregular_periods"),
        dominant["hours"].alias("dominant_interval_hours"),
        F.transform("__top", lambda e: F.struct(e["hours"].alias("hours"), e["n"].alias("count"))).alias("common_intervals"),
        (F.col("__month") / F.col("__total") >= 0.8).alias("calendar_regular"),
    )
    every = df.filter(F.col(ts).isNotNull()).select(*keys).distinct()
    return join_on(every, out, keys, "left").fillna("unknown", ["inferred_freq"]).fillna(
        0.0, ["frequency_confidence"]
    ).fillna(True, ["irregular_periods"]).fillna(False, ["calendar_regular"])


def detect_frequency_days(df: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Frequency from the modal gap in whole days (repeated dates dropped): D/W/M/Q/Y, H, or "<n>D"."""
    keys = list(keys)
    gaps = gap_counts(df.select(*keys, ts).distinct(), keys, ts)
    modal = gaps.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), "gap")).alias("__m"))
    days = F.floor(F.col("__m.gap") / DAY)
    hours = F.round(F.col("__m.gap") / HOUR, 2)
    label = (
        F.when(days == 1, "D")
        .when(days.between(6, 8), "W")
        .when(days.between(28, 32), "M")
        .when(days.between(89, 92), "Q")
        .when(days.between(360, 370), "Y")
        .when((days == 0) & (F.abs(hours - 1) < 0.1), "H")
        .otherwise(F.concat(days.cast("string"), F.lit("D")))
    )
    every = df.filter(F.col(ts).isNotNull()).select(*keys).distinct()
    return join_on(every, modal.select(*keys, label.alias("frequency")), keys, "left").fillna("unknown", ["frequency"])


def date_range(df: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Start, end, whole days between them, number of periods."""
    days = F.floor((F.max(micros(F.col(ts))) - F.min(micros(F.col(ts)))) / DAY)
    return df.groupBy(*keys).agg(
        F.min(ts).alias("start_date"),
        F.max(ts).alias("end_date"),
        days.alias("total_days"),
        F.count(F.lit(1)).alias("total_periods"),
    )


def gap_profile(df: DataFrame, keys: Sequence[str], ts: str = "ts", freq: str | None = None) -> DataFrame:
    """Gaps longer than 1.5 times the expected interval, for ``freq`` or each series' own frequency."""
    keys = list(keys)
    gaps = gap_counts(df, keys, ts)
    if freq is None:
        rates = detect_frequency(df, keys, ts).select(*keys, F.col("inferred_freq").alias("freq"))
        gaps = salted_join(gaps, rates, keys, "inner")
    else:
        gaps = gaps.withColumn("freq", F.lit(freq))
    expected = F.coalesce(
        *[F.when(F.col("freq") == label, F.lit(float(h))) for label, h in EXPECTED_HOURS.items()],
        F.when(F.col("freq") != "unknown", F.lit(24.0)),
    )
    h = F.col("gap") / HOUR
    wide = h > expected * 1.5
    n, total = F.col("n"), F.sum("n")
    return gaps.groupBy(*keys, "freq").agg(
        (F.max("freq") != "unknown").alias("analysis_possible"),
        F.sum(F.when(wide, n).when(expected.isNotNull(), 0)).alias("total_gaps"),
        (F.sum(F.when(wide, n).when(expected.isNotNull(), 0)) / total * 100).alias("gap_percentage"),
        F.coalesce(F.max(F.when(wide, h)), F.max(F.when(expected.isNotNull(), 0.0))).alias("largest_gap_hours"),
        F.coalesce(
            F.try_divide(F.sum(F.when(wide, h * n)), F.sum(F.when(wide, n))), F.max(F.when(expected.isNotNull(), 0.0))
        ).alias("average_gap_hours"),
        (F.sum(F.when(h <= expected * 1.5, n).when(expected.isNotNull(), 0)) / total * 100).alias("regular_intervals"),
    )


def series_stats(df: DataFrame, keys: Sequence[str], y: str = "y") -> DataFrame:
    """Mean, std, min, max and coefficient of variation; NULL below 10 points."""
    v = F.col(y)
    out = df.filter(v.isNotNull()).groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")
    )
    cv = F.when(F.col("mean") != 0, F.col("std") / F.col("mean")).otherwise(F.lit(float("inf")))
    out = out.withColumn("cv", cv)
    return out.select(*keys, "n", *[F.when(F.col("n") >= 10, F.col(c)).alias(c) for c in ("mean", "std", "min", "max", "cv")])


def trend(df: DataFrame, keys: Sequence[str], ts: str = "ts", y: str = "y") -> DataFrame:
    """Least squares of value on position: slope, R squared, direction; detected above 0.25."""
    fit = points(df, keys, ts, y).groupBy(*keys).agg(
        F.regr_slope(y, "pos").alias("slope"), F.regr_r2(y, "pos").alias("r_squared"), F.count(y).alias("n")
    )
    return fit.withColumn("direction", F.when(F.col("slope") > 0, "increasing").otherwise("decreasing")).withColumn(
        "detected", F.coalesce(F.col("r_squared") > 0.25, F.lit(False))
    )


def spectral_seasonality(df: DataFrame, keys: Sequence[str], ts: str = "ts", y: str = "y", top: int = 3) -> DataFrame:
    """Strongest spectral peaks of the detrended series: rows (keys, rank, period, strength, frequency).

    The trend is a centred mean of width min(n/4, 12). Any length is transformed in n log n steps, see
    :mod:`lodestat.plans.spectrum`.
    """
    keys = list(keys)
    rows = points(df, keys, ts, y).filter(F.col("n") >= 20)
    means = {}
    for w in range(5, 13):
        ahead = (w - 1) // 2
        means[f"__m{w}"] = lambda spec, w=w, ahead=ahead: F.when(
            F.count(y).over(spec.rowsBetween(ahead - w + 1, ahead)) == w, F.avg(y).over(spec.rowsBetween(ahead - w + 1, ahead))
        )
    framed = with_frames(rows, keys, means, before=12, after=12)
    width = F.least(F.floor(F.col("n") / 4), F.lit(12))
    centre = F.coalesce(*[F.when(width == w, F.col(f"__m{w}")) for w in range(5, 13)])
    # n >= 20 and a full window of width w leave the points w//2 .. n - 1 - (w-1)//2.
    d = (
        framed.withColumn("__d", F.col(y) - centre)
        .filter(F.col("__d").isNotNull())
        .select(*keys, (F.col("pos") - F.floor(width / 2)).alias("__t"), F.col("__d"), (F.col("n") - width + 1).alias("__m"))
        .filter(F.col("__m") >= 10)
    )
    bins = magnitudes(d, keys)
    # A peak is compared with its neighbours through their shifted bins: one shuffle, no ordered window.
    near = bins.select(
        *keys, "__m", F.inline(F.array(*[F.struct((F.col("__k") + o).alias("__k"), F.lit(-o).alias("__o"), F.col("__mag").alias("__mag")) for o in (-1, 0, 1)]))
    )
    pick = lambda o: F.max(F.when(F.col("__o") == o, F.col("__mag")))
    peaks = near.groupBy(*keys, "__m", "__k").agg(pick(0).alias("__mag"), pick(-1).alias("__left"), pick(1).alias("__right"))
    peaks = peaks.filter((F.col("__mag") > F.col("__left")) & (F.col("__mag") > F.col("__right")))
    order = Window.partitionBy(*keys).orderBy(F.desc("__mag"), "__k")
    best = peaks.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    period = F.col("__m") / F.col("__k")
    kept = best.withColumn("period", period).filter((F.col("period") >= 2) & (F.col("period") <= F.col("__m") / 3))
    again = Window.partitionBy(*keys).orderBy("rank")
    return kept.withColumn("rank", F.row_number().over(again)).select(
        *keys, "rank", "period", F.col("__mag").alias("strength"), (F.col("__k") / F.col("__m")).alias("frequency")
    )


def seasonality_type(freq: Column, period: Column) -> Column:
    """Name of a seasonal period under a frequency label."""
    return (
        F.when((freq == "D") & period.between(6, 8), "weekly")
        .when((freq == "D") & period.between(28, 32), "monthly")
        .when((freq == "D") & period.between(90, 100), "quarterly")
        .when((freq == "D") & period.between(360, 370), "yearly")
        .when((freq == "W") & period.between(4, 5), "monthly")
        .when((freq == "W") & period.between(12, 14), "quarterly")
        .when((freq == "W") & period.between(50, 54), "yearly")
        .when((freq == "M") & period.between(11, 13), "yearly")
        .otherwise("unknown")
    )


def dominant_seasonality(df: DataFrame, keys: Sequence[str], ts: str = "ts", y: str = "y") -> DataFrame:
    """Per series: whether a spectral season was found, the dominant period, strength and its name."""
    keys = list(keys)
    first = spectral_seasonality(df, keys, ts, y).filter(F.col("rank") == 1).drop("rank", "frequency")
    freq = detect_frequency(df.filter(F.col(y).isNotNull()), keys, ts).select(*keys, "inferred_freq")
    return join_on(freq, first, keys, "left").select(
        *keys,
        F.col("period").isNotNull().alias("detected"),
        F.when(F.col("period").isNull(), "unknown")
        .otherwise(seasonality_type(F.col("inferred_freq"), F.col("period")))
        .alias("season"),
        F.col("period").alias("dominant_period"),
        F.coalesce("strength", F.lit(0.0)).alias("strength_score"),
    )


def acf(df: DataFrame, keys: Sequence[str], ts: str = "ts", y: str = "y", max_lag: int = 50) -> DataFrame:
    """Pearson autocorrelation at lags 1 .. min(n/4, max_lag) - 1: rows (keys, lag, r).

    All lags come from one sort: a bounded frame gives the lagged values and one aggregate correlates.
    """
    keys = list(keys)
    lags = range(1, max_lag)
    shifted = with_frames(
        points(df, keys, ts, y), keys, {f"__l{k}": lambda w, k=k: F.lag(y, k).over(w) for k in lags}, before=max_lag - 1
    )
    wide = shifted.groupBy(*keys).agg(F.max("n").alias("n"), *[F.corr(y, f"__l{k}").alias(f"__r{k}") for k in lags])
    cells = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"__r{k}").alias("r")) for k in lags])
    long = wide.select(*keys, "n", F.inline(cells))
    return long.filter(
        (F.col("lag") < F.least(F.floor(F.col("n") / 4), F.lit(max_lag))) & F.col("r").isNotNull() & ~F.isnan("r")
    ).select(*keys, "lag", "r")


def acf_seasonality(df: DataFrame, keys: Sequence[str], ts: str = "ts", y: str = "y") -> DataFrame:
    """Detected if the strongest |r| exceeds 0.3; then up to three lags with |r| above 0.2."""
    keys = list(keys)
    strengths = acf(df, keys, ts, y).withColumn("s", F.abs("r"))
    order = Window.partitionBy(*keys).orderBy(F.desc("s"), "lag")
    top = strengths.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= 3)
    listed = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__r", "lag", "s"))).alias("t"))
    found = F.col("t")[0]["s"] > 0.3
    strong = F.filter("t", lambda e: e["s"] > 0.2)
    every = df.filter(F.col(y).isNotNull()).select(*keys).distinct()
    out = join_on(every, listed, keys, "left")
    return out.select(
        *keys,
        F.coalesce(found, F.lit(False)).alias("detected"),
        F.when(found, F.col("t")[0]["lag"].cast("double")).alias("dominant_period"),
        F.when(found, F.col("t")[0]["s"]).alias("dominant_strength"),
        F.when(found, F.transform(strong, lambda e: e["lag"].cast("double"))).alias("periods"),
        F.when(found, F.transform(strong, lambda e: e["s"])).alias("strengths"),
    )


def _standardized(df: DataFrame, keys: Sequence[str], ts: str, y: str) -> DataFrame:
    """Points with the value centred and scaled per series (``z``), for stable cross products."""
    rows = points(df, keys, ts, y)
    stats = rows.groupBy(*keys).agg(F.avg(y).alias("__m"), F.stddev_pop(y).alias("__s"))
    return salted_join(rows, stats, keys, "inner").withColumn(
        "z", F.when(F.col("__s") > 0, (F.col(y) - F.col("__m")) / F.col("__s")).otherwise(F.lit(0.0))
    )


def _longest(rows: DataFrame) -> int:
    """Length of the longest series (one small aggregate)."""
    return int(rows.agg(F.max("n")).first()[0] or 0)


def _adf_max_lag(n: int) -> int:
    return max(0, min(math.ceil(12.0 * (n / 100.0) ** 0.25), n // 2 - 2))


# Response-surface coefficients for the constant-only unit-root test (MacKinnon 2010, one variable).
ADF_SURFACE = {
    "1%": (-3.43035, -6.5393, -16.786, -79.433),
    "5%": (-2.86154, -2.8903, -4.234, -40.040),
    "10%": (-2.56677, -1.5384, -2.809),
}


def frame_of(rows: list[dict], schema: T.StructType) -> pd.DataFrame:
    """Result frame of plain records, absent fields NULL."""
    return pd.DataFrame({f.name: pd.Series([r.get(f.name) for r in rows], dtype=object) for f in schema.fields})


def adf_critical(level: str, nobs: float) -> float:
    return sum(c / nobs**i for i, c in enumerate(ADF_SURFACE[level]))


def _adf_solve(gram: np.ndarray, used: int, rows: float) -> tuple[float, float] | None:
    """(t of the level term, AIC) with columns [1, level, lag 1..used] and target last in ``gram``."""
    idx = list(range(2 + used))
    a, b, yy = gram[np.ix_(idx, idx)], gram[idx, -1], gram[-1, -1]
    dof = rows - len(idx)
    if dof <= 0:
        return None
    try:
        beta = np.linalg.solve(a, b)
        inv = np.linalg.inv(a)
    except np.linalg.LinAlgError:
        return None
    rss = float(yy - beta @ b)
    if rss <= 0:
        return None
    t = float(beta[1] / math.sqrt(rss / dof * inv[1, 1])) if inv[1, 1] > 0 else float("nan")
    llf = -rows / 2 * (math.log(2 * math.pi) + math.log(rss / rows) + 1)
    return t, -2 * llf + 2 * len(idx)


def adf_test(df: DataFrame, keys: Sequence[str], ts: str = "ts", y: str = "y", max_lag: int | None = None) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant and AIC-chosen lag; stationary below the 5% value.

    The regressions only need cross products, which are summed over position blocks, so a series of any
    length reduces to one small matrix; lag choice and the final fit are solved on that.
    """
    keys = list(keys)
    rows = _standardized(df, keys, ts, y).filter(F.col("n") >= 10)

    def most_lags(n: int) -> int:
        return _adf_max_lag(n) if max_lag is None else min(max_lag, _adf_max_lag(n))

    cap = most_lags(_longest(rows))
    width = cap + 3

    def design(z: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows t with all p lagged differences available, as indices into z and columns."""
        dz = np.diff(z)
        t = np.arange(p + 1, len(z))
        cols = [np.ones(len(t)), z[t - 1]] + [dz[t - 1 - j] for j in range(1, p + 1)] + [dz[t - 1]]
        return t, np.column_stack(cols) if len(t) else np.zeros((0, p + 3))

    def partial(frame: pd.DataFrame, owned: np.ndarray) -> np.ndarray:
        n = int(frame["n"].iloc[0])
        p = most_lags(n)
        z = frame["z"].to_numpy()
        gram = np.zeros((width, width))
        t, x = design(z, p)
        keep = owned[t] if len(t) else np.zeros(0, bool)
        x = x[keep]
        slots = list(range(2 + p)) + [width - 1]
        gram[np.ix_(slots, slots)] = x.T @ x
        head = np.zeros(cap + 2)
        if int(frame["pos"].iloc[0]) == 0:
            first = z[: cap + 2]
            head[: len(first)] = first
        return np.concatenate([gram.ravel(), [len(x), n if int(frame["pos"].iloc[0]) == 0 else 0], head])

    sums = block_sums(rows, keys, partial, before=cap + 2)

    fields = {f.name: f for f in sums.schema.fields}
    schema = T.StructType(
        [fields[k] for k in keys]
        + [T.StructField(c, T.DoubleType()) for c in ("adf_statistic", "adf_critical_1", "adf_critical_5", "adf_critical_10")]
        + [T.StructField("adf_lags", T.LongType()), T.StructField("adf_stationary", T.BooleanType())]
    )

    def solve(batches):
        for batch in batches:
            out = []
            for _, r in batch.iterrows():
                s = np.asarray(r["sums"], dtype=float)
                gram = s[: width * width].reshape(width, width)
                count, n = s[width * width], int(s[width * width + 1])
                head = s[width * width + 2 :]
                p = most_lags(n)
                fits = [(f[1], k) for k in range(p + 1) if (f := _adf_solve(gram, k, count))]
                rec = {k: r[k] for k in keys}
                if not fits:
                    out.append({**rec, "adf_stationary": None})
                    continue
                used = min(fits)[1]
                # The final fit also uses the first rows, which the common sample leaves out.
                slots = list(range(2 + used)) + [width - 1]
                full = gram[np.ix_(slots, slots)].copy()
                _, extra = design(head[: p + 1], used)
                full += extra.T @ extra
                total = count + len(extra)
                t = _adf_solve(full, used, total)
                stat = t[0] if t else None
                crit = {lvl: adf_critical(lvl, total) for lvl in ADF_SURFACE}
                out.append(
                    {
                        **rec,
                        "adf_statistic": stat,
                        "adf_critical_1": crit["1%"],
                        "adf_critical_5": crit["5%"],
                        "adf_critical_10": crit["10%"],
                        "adf_lags": used,
                        "adf_stationary": None if stat is None else bool(stat < crit["5%"]),
                    }
                )
            yield frame_of(out, schema)

    return sums.mapInPandas(solve, schema)


def dickey_fuller(df: DataFrame, keys: Sequence[str], ts: str = "ts", y: str = "y") -> DataFrame:
    """Zero-lag unit-root statistic: t ratio of the level in a regression of the change on it."""
    keys = list(keys)
    rows = with_frames(points(df, keys, ts, y), keys, {"__p": lambda w: F.lag(y, 1).over(w)}, before=1)
    d = F.col(y) - F.col("__p")
    fit = rows.filter(F.col("__p").isNotNull()).withColumn("__d", d).groupBy(*keys).agg(
        F.count("__d").alias("n"), F.regr_slope("__d", "__p").alias("b"), F.regr_sxx("__d", "__p").alias("sxx"),
        F.regr_syy("__d", "__p").alias("syy"), F.regr_sxy("__d", "__p").alias("sxy"),
    )
    rss = F.col("syy") - F.col("b") * F.col("sxy")
    return fit.select(*keys, "n", F.try_divide(F.col("b"), F.sqrt(F.try_divide(F.try_divide(rss, F.col("n") - 2), F.col("sxx")))).alias("df_statistic"))


def _hobijn_lags(n: int, autocov: np.ndarray) -> int:
    """Data-dependent bandwidth (Hobijn, Franses and Ooms 1998) from raw autocovariance sums."""
    cov_lags = int(n ** (2.0 / 9.0))
    s0, s1 = autocov[0] / n, 0.0
    for i in range(1, cov_lags + 1):
        prod = autocov[i] / (n / 2.0)
        s0 += prod
        s1 += i * prod
    if s0 == 0:
        return 0
    gamma = 1.1447 * ((s1 / s0) ** 2) ** (1.0 / 3.0)
    return max(0, min(int(gamma * n ** (1.0 / 3.0)), n - 1))


# Critical values of the level-stationarity test (Kwiatkowski et al. 1992).
KPSS_CRITICAL = {"10%": 0.347, "5%": 0.463, "2.5%": 0.574, "1%": 0.739}


def kpss_test(df: DataFrame, keys: Sequence[str], ts: str = "ts", y: str = "y", lags: int | None = None) -> DataFrame:
    """Level-stationarity test: squared partial sums over the long-run variance; stationary below the 5% value."""
    keys = list(keys)
    rows = points(df, keys, ts, y).filter(F.col("n") >= 10)
    means = rows.groupBy(*keys).agg(F.avg(y).alias("__m"))
    rows = salted_join(rows, means, keys, "inner").withColumn("e", F.col(y) - F.col("__m"))
    if lags is None:
        n_max = max(_longest(rows), 10)
        # gamma is at most 1.1447 * cov_lags^(2/3), which bounds the lags any series can ask for.
        most = max(1, int(1.1447 * max(1, int(n_max ** (2 / 9))) ** (2 / 3) * n_max ** (1 / 3)) + 1)
        most = min(4 * most, n_max - 1)
    else:
        most = lags

    def partial(frame: pd.DataFrame, owned: np.ndarray) -> np.ndarray:
        e = frame["e"].to_numpy()
        out = np.zeros(most + 1)
        for i in range(min(most, len(e) - 1) + 1):
            out[i] = (e[i:] * e[: len(e) - i])[owned[i:]].sum()
        return out

    autocov = block_sums(rows.select(*keys, "pos", "e"), keys, partial, before=most)
    partial_sums = with_running(rows, keys, {"__s": F.col("e")})
    eta = partial_sums.groupBy(*keys).agg(F.sum(F.col("__s") * F.col("__s")).alias("eta"), F.count("e").alias("n"))
    both = join_on(eta, autocov, keys)
    fields = {f.name: f for f in both.schema.fields}
    schema = T.StructType(
        [fields[k] for k in keys]
        + [T.StructField("kpss_statistic", T.DoubleType()), T.StructField("kpss_lags", T.LongType()), T.StructField("kpss_stationary", T.BooleanType())]
    )

    def finish(batches):
        for batch in batches:
            out = []
            for _, r in batch.iterrows():
                n, cov = int(r["n"]), np.asarray(r["sums"], dtype=float)
                used = min(_hobijn_lags(n, cov) if lags is None else lags, len(cov) - 1, n - 1)
                w = 1 - np.arange(1, used + 1) / (used + 1.0)
                variance = (cov[0] + 2 * (w * cov[1 : used + 1]).sum()) / n
                stat = float(r["eta"]) / n**2 / variance if variance > 0 else None
                rec = {k: r[k] for k in keys}
                out.append({**rec, "kpss_statistic": stat, "kpss_lags": used, "kpss_stationary": None if stat is None else stat < KPSS_CRITICAL["5%"]})
            yield frame_of(out, schema)

    return both.mapInPandas(finish, schema)


def stationarity(
    df: DataFrame, keys: Sequence[str], ts: str = "ts", y: str = "y", max_lag: int | None = None, lags: int | None = None
) -> DataFrame:
    """Both tests with the joint reading: stationary, non_stationary or inconclusive."""
    keys = list(keys)
    a = F.coalesce("adf_stationary", F.lit(False))
    k = F.coalesce("kpss_stationary", F.lit(False))
    both = join_on(adf_test(df, keys, ts, y, max_lag), kpss_test(df, keys, ts, y, lags), keys)
    verdict = F.when(a & k, "stationary").when(~a & ~k, "non_stationary").otherwise("inconclusive")
    return both.withColumn("conclusion", verdict)


def _series_fences(rows: DataFrame, keys: Sequence[str], y: str) -> DataFrame:
    return iqr_bounds(exact_quantiles(rows, keys, y, {"q1": 0.25, "q3": 0.75}))


def series_outliers(df: DataFrame, keys: Sequence[str], ts: str = "ts", y: str = "y") -> DataFrame:
    """Points outside 1.5 IQR of their series with position and bounds."""
    keys = list(keys)
    rows = points(df, keys, ts, y)
    bounds = _series_fences(rows, keys, y).select(*keys, "lower_bound", "upper_bound")
    return salted_join(rows.drop("n"), bounds, keys, "inner").filter(
        (F.col(y) < F.col("lower_bound")) | (F.col(y) > F.col("upper_bound"))
    )


def outlier_counts(df: DataFrame, keys: Sequence[str], ts: str = "ts", y: str = "y") -> DataFrame:
    """Outliers per series and their share of the points."""
    keys = list(keys)
    rows = df.filter(F.col(y).isNotNull() & F.col(ts).isNotNull())
    joined = salted_join(rows.select(*keys, y), _series_fences(rows, keys, y).drop("n"), keys, "inner")
    out = F.count_if((F.col(y) < F.col("lower_bound")) | (F.col(y) > F.col("upper_bound")))
    return joined.groupBy(*keys).agg(
        out.alias("n_outliers"),
        (out / F.count(F.lit(1))).alias("outlier_share"),
        F.max("lower_bound").alias("lower_bound"),
        F.max("upper_bound").alias("upper_bound"),
    )


def profile_series(df: DataFrame, keys: Sequence[str], ts: str = "ts", y: str = "y") -> DataFrame:
    """Everything above, one row per series with a struct per topic."""
    keys = list(keys)
    # Every topic reads the series again: keep its three columns, not the source's lineage.
    df = materialize(df.select(*keys, ts, y), "series")

    def packed(part: DataFrame, name: str) -> DataFrame:
        return part.select(*keys, F.struct(*[c for c in part.columns if c not in keys]).alias(name))

    freq = detect_frequency(df, keys, ts)
    out = packed(date_range(df, keys, ts), "date_range")
    for part, name in (
        (freq, "frequency"),
        (gap_profile(df, keys, ts), "gaps"),
        (series_stats(df, keys, y), "basic_stats"),
        (trend(df, keys, ts, y), "trend"),
        (dominant_seasonality(df, keys, ts, y), "seasonality"),
        (acf_seasonality(df, keys, ts, y), "acf"),
        (stationarity(df, keys, ts, y), "stationarity"),
        (outlier_counts(df, keys, ts, y), "outliers"),
        (stability(df, keys, y), "stability"),
    ):
        out = join_on(out, packed(part, name), keys, "left")
    return out


def ts_recommendations(profile: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Advice rows (keys, rule, message) from :func:`profile_series`."""
    p = F.col
    rules = [
        ("irregular", p("frequency.irregular_periods"), F.lit("steps between points vary; resample to a grain or interpolate")),
        ("low_confidence", p("frequency.frequency_confidence") < 0.7, F.lit("no step dominates; check how the times were recorded")),
        ("gaps", p("gaps.gap_percentage") > 10, F.lit("more than a tenth of the steps are gaps; fill them first")),
        ("trend", p("trend.detected"), F.concat(p("trend.direction"), F.lit(" trend explains the series; pick a model with a trend"))),
        ("seasonality", p("seasonality.detected"), F.concat(p("seasonality.season"), F.lit(" season found; pick a model with a season"))),
        ("non_stationary", p("stationarity.conclusion") == "non_stationary", F.lit("level is not stable; difference or detrend")),
        ("inconclusive", p("stationarity.conclusion") == "inconclusive", F.lit("the two stability tests disagree; look at the series")),
        ("outliers", p("outliers.outlier_share") > 0.05, F.lit("over 5% outliers; prefer robust methods")),
        ("short", p("date_range.total_periods") < 100, F.lit("under 100 points; keep the model simple")),
        ("moderate", p("date_range.total_periods").between(100, 499), F.lit("100 to 499 points; ARIMA, additive and smoothing models fit")),
        ("long", p("date_range.total_periods") >= 500, F.lit("500 points or more; richer models and ensembles are possible")),
    ]
    structs = F.array(*[F.struct(F.lit(n).alias("rule"), m.alias("message"), F.coalesce(h, F.lit(False)).alias("hit")) for n, h, m in rules])
    return profile.select(*keys, F.inline(F.filter(structs, lambda r: r["hit"]))).drop("hit")


def decompose(df: DataFrame, keys: Sequence[str], ts: str = "ts", y: str = "y", period: int = 12, model: str = "additive") -> DataFrame:
    """Classical decomposition: centred moving average, mean by phase, remainder."""
    if model not in ("additive", "multiplicative"):
        raise ValueError(f"unknown model {model!r}")
    keys = list(keys)
    half = period // 2
    additive = model == "additive"

    def centred(w):
        frame = w.rowsBetween(-half, half)
        total = F.sum(y).over(frame)
        if period % 2 == 0:
            total = total - 0.5 * F.lag(y, half).over(w) - 0.5 * F.lead(y, half).over(w)
        return F.when(F.count(y).over(frame) == 2 * half + 1, total / period)

    rows = with_frames(points(df, keys, ts, y), keys, {"trend": centred}, before=half, after=half)
    rows = rows.withColumn("__ph", F.pmod(F.col("pos"), F.lit(period)))
    detrended = F.col(y) - F.col("trend") if additive else F.try_divide(y, "trend")
    phases = rows.groupBy(*keys, "__ph").agg(F.avg(detrended).alias("__s"))
    level = phases.groupBy(*keys).agg(F.avg("__s").alias("__l"))
    phases = join_on(phases, level, keys).select(
        *keys, "__ph", (F.col("__s") - F.col("__l") if additive else F.try_divide("__s", "__l")).alias("seasonal")
    )
    out = salted_join(rows, phases, [*keys, "__ph"], "left").drop("__ph")
    resid = (
        F.col(y) - F.col("trend") - F.col("seasonal") if additive else F.try_divide(F.try_divide(y, "trend"), F.col("seasonal"))
    )
    return out.withColumn("resid", resid)


def decomposition_strength(df: DataFrame, keys: Sequence[str], ts: str = "ts", y: str = "y", period: int = 12, model: str = "additive") -> DataFrame:
    """Standard deviation of trend and seasonal part over that of the series; only above two periods."""
    parts = decompose(df, keys, ts, y, period, model).filter(F.col("n") > 2 * period)
    return parts.groupBy(*keys).agg(
        F.try_divide(F.stddev_samp("trend"), F.stddev_samp(y)).alias("trend_strength"),
        F.try_divide(F.stddev_samp("seasonal"), F.stddev_samp(y)).alias("seasonal_strength"),
    )


def stability(df: DataFrame, keys: Sequence[str], y: str = "y") -> DataFrame:
    """1 / (1 + var / mean^2) and the number of rows."""
    mean = F.avg(y)
    return df.groupBy(*keys).agg(
        (1 / (1 + F.try_divide(F.var_samp(y), mean * mean))).alias("stability_score"), F.count(F.lit(1)).alias("sample_size")
    )
