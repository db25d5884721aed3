"""Preparing series and deriving features from them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.functions.columns import ISO, date_formats, parsed_time
from lodestat.operators.series import acf_seasonality, detect_frequency_days
from lodestat.plans.skew import join_on, with_carried, with_frames, with_position

# Lags and rolling windows per frequency label; other frequencies use DEFAULT_*.
LAGS = {"D": (1, 7, 30), "W": (1, 4, 12), "M": (1, 3, 12)}
DEFAULT_LAGS = (1, 2, 3)
WINDOWS = {"D": (7, 30, 90), "W": (4, 12, 26), "M": (3, 6, 12)}
DEFAULT_WINDOWS = (3, 6, 12)

# Step of one period per frequency label.
STEPS = {
    "H": "INTERVAL 1 HOUR", "D": "INTERVAL 1 DAY", "W": "INTERVAL 7 DAY",
    "M": "INTERVAL 1 MONTH", "Q": "INTERVAL 3 MONTH", "Y": "INTERVAL 12 MONTH",
}
GRAINS = {"hour": "H", "day": "D", "week": "W", "month": "M", "quarter": "Q", "year": "Y"}


def prepare_series(df: DataFrame, keys: Sequence[str], ts: str, y: str, tiebreak: str | None = None) -> DataFrame:
    """Parsed times without repeats: one row per (keys, ts), the first by ``tiebreak`` (else the least value).

    A text column is read in the one format that fits most of it; other values go.
    """
    stamp = F.col(ts)
    if df.schema[ts].dataType.typeName() == "string":
        found = date_formats(df, [ts]).first()["format"]
        stamp = parsed_time(stamp, found or ISO).cast("timestamp_ntz")
    rows = df.withColumn("__ts", stamp).filter(F.col("__ts").isNotNull())
    value = F.min(y) if tiebreak is None else F.min_by(y, tiebreak)
    return rows.groupBy(*keys, F.col("__ts").alias(ts)).agg(value.alias(y))


def resample(df: DataFrame, keys: Sequence[str], grain: str, agg: str = "mean", ts: str = "ts", y: str = "y") -> DataFrame:
    """Values aggregated to a calendar grain (hour, day, week, month, quarter, year)."""
    if grain not in GRAINS:
        raise ValueError(f"unknown grain {grain!r}")
    fn = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}[agg]
    dtype = df.schema[ts].dataType
    start = F.date_trunc(grain, F.col(ts)).cast(dtype)
    return df.groupBy(*keys, start.alias(ts)).agg(fn(y).alias(y))


def fill_gaps(df: DataFrame, keys: Sequence[str], freq: str, ts: str = "ts") -> DataFrame:
    """Every period from first to last per series; missing ones get NULL values and ``is_gap``."""
    keys = list(keys)
    dtype = df.schema[ts].dataType
    span = df.groupBy(*keys).agg(F.min(ts).alias("__lo"), F.max(ts).alias("__hi"))
    calendar = span.select(*keys, F.explode(F.expr(f"sequence(__lo, __hi, {STEPS[freq]})")).alias(ts))
    calendar = calendar.withColumn(ts, F.col(ts).cast(dtype))
    marked = df.withColumn("__here", F.lit(True))
    out = join_on(calendar, marked, [*keys, ts], "left")
    return out.withColumn("is_gap", F.col("__here").isNull()).drop("__here")


def interpolate(df: DataFrame, keys: Sequence[str], ts: str = "ts", y: str = "y") -> DataFrame:
    """Linear by position; leading NULLs stay, trailing ones take the last value."""
    keys = list(keys)
    rows = with_carried(with_position(df, keys, ts), keys, y)
    b, a = F.col("before"), F.col("after")
    between = b["v"] + (a["v"] - b["v"]) * (F.col("pos") - b["p"]) / (a["p"] - b["p"])
    value = F.when(F.col(y).isNotNull(), F.col(y)).when(a.isNull(), b["v"]).otherwise(between)
    return rows.withColumn(y, value).drop("before", "after", "pos", "n")


def lag_features(
    df: DataFrame, keys: Sequence[str], lags: Sequence[int] | None = None, freq: str | None = None, ts: str = "ts", y: str = "y"
) -> DataFrame:
    """Columns ``<y>_lag_<k>``."""
    lags = list(lags or LAGS.get(freq or "", DEFAULT_LAGS))
    exprs = {f"{y}_lag_{k}": lambda w, k=k: F.lag(y, k).over(w) for k in lags}
    return with_frames(with_position(df, keys, ts), keys, exprs, before=max(lags)).drop("pos", "n")


def rolling_features(
    df: DataFrame, keys: Sequence[str], windows: Sequence[int] | None = None, freq: str | None = None, ts: str = "ts", y: str = "y"
) -> DataFrame:
    """Rolling mean, std, min and max over full windows shorter than the series; NULL until full."""
    windows = list(windows or WINDOWS.get(freq or "", DEFAULT_WINDOWS))
    stats = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    exprs = {}
    for size in windows:
        for name, fn in stats.items():

            def full(w, size=size, fn=fn):
                frame = w.rowsBetween(1 - size, 0)
                return F.when((F.col("n") > size) & (F.count(y).over(frame) == size), fn(y).over(frame))

            exprs[f"{y}_rolling_{name}_{size}"] = full
    return with_frames(with_position(df, keys, ts), keys, exprs, before=max(windows) - 1).drop("pos", "n")


def calendar_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """year, month, day_of_week (Monday 0), day_of_month, quarter."""
    t = F.col(ts)
    return df.withColumns(
        {
            "year": F.year(t),
            "month": F.month(t),
            "day_of_week": F.weekday(t),
            "day_of_month": F.dayofmonth(t),
            "quarter": F.quarter(t),
        }
    )


def cyclical_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Sine and cosine of month/12 and weekday/7."""
    month, day = 2 * math.pi * F.month(ts) / 12, 2 * math.pi * F.weekday(ts) / 7
    return df.withColumns(
        {
            "month_sin": F.sin(month),
            "month_cos": F.cos(month),
            "day_of_week_sin": F.sin(day),
            "day_of_week_cos": F.cos(day),
        }
    )


def weekend_flag(df: DataFrame, ts: str = "ts") -> DataFrame:
    """1 on Saturday and Sunday."""
    return df.withColumn("is_weekend", (F.weekday(ts) >= 5).cast("int"))


def difference(df: DataFrame, keys: Sequence[str], d: int = 1, ts: str = "ts", y: str = "y") -> DataFrame:
    """``d``-th difference along the series as ``<y>_diff``; NULL for the first ``d`` points."""
    if d < 1:
        return df.withColumn(f"{y}_diff", F.col(y))

    def diff(w) -> Column:
        out = F.col(y)
        for k in range(1, d + 1):
            out = out + F.lit(float((-1) ** k * math.comb(d, k))) * F.lag(y, k).over(w)
        return out

    return with_frames(with_position(df, keys, ts), keys, {f"{y}_diff": diff}, before=d).drop("pos", "n")


def with_horizon(df: DataFrame, keys: Sequence[str], horizon: int | DataFrame) -> DataFrame:
    """``__steps``, how many steps to forecast per series: a number for all, or rows (keys, horizon); series without steps go."""
    if isinstance(horizon, DataFrame):
        df = join_on(df, horizon.select(*keys, F.col("horizon").cast("int").alias("__steps")), keys)
    else:
        df = df.withColumn("__steps", F.lit(horizon))
    return df.filter(F.col("__steps") >= 1)


def future_dates(
    df: DataFrame, keys: Sequence[str], horizon: int | DataFrame, freq: str | None = None, ts: str = "ts"
) -> DataFrame:
    """The ``horizon`` dates after the last one of each series (see :func:`with_horizon`): rows (keys, step, ts).

    Without ``freq`` each series uses its detected frequency; "<n>D" steps n days, unknown steps a day.
    """
    keys = list(keys)
    dtype = df.schema[ts].dataType
    last = df.groupBy(*keys).agg(F.max(ts).alias("__last"))
    if freq is None:
        last = join_on(last, detect_frequency_days(df, keys, ts).withColumnRenamed("frequency", "__freq"), keys)
    else:
        last = last.withColumn("__freq", F.lit(freq))
    days = F.coalesce(F.regexp_extract("__freq", r"^(\d+)D$", 1).try_cast("int"), F.lit(1))
    steps = with_horizon(last, keys, horizon).withColumn("step", F.explode(F.sequence(F.lit(1), F.col("__steps"))))
    step = F.col("step")
    months = {"M": 1, "Q": 3, "Y": 12}
    hours = F.when(F.col("__freq") == "H", F.make_dt_interval(hours=step))
    month = F.when(F.col("__freq").isin(*months), F.make_ym_interval(months=step * sum(
        (F.when(F.col("__freq") == k, F.lit(v)).otherwise(0) for k, v in months.items()), F.lit(0)
    )))
    day = F.make_dt_interval(days=step * F.when(F.col("__freq") == "W", 7).otherwise(days))
    base = F.col("__last")
    stamp = F.when(hours.isNotNull(), base + hours).when(month.isNotNull(), base + month).otherwise(base + day)
    return steps.select(*keys, step.cast("int").alias("step"), stamp.cast(dtype).alias(ts))


def seasonal_period(df: DataFrame, keys: Sequence[str], ts: str = "ts", y: str = "y") -> DataFrame:
    """Dominant autocorrelation lag if one is strong, else 7, 4 or 12 by frequency, else 1."""
    keys = list(keys)
    found = acf_seasonality(df, keys, ts, y).select(*keys, "dominant_period")
    freq = detect_frequency_days(df, keys, ts)
    default = F.when(F.col("frequency") == "D", 7).when(F.col("frequency") == "W", 4).when(F.col("frequency") == "M", 12).otherwise(1)
    return join_on(freq, found, keys, "left").select(
        *keys, "frequency", F.coalesce(F.col("dominant_period").cast("int"), default).alias("seasonal_period")
    )


def regular_series(df: DataFrame, keys: Sequence[str], grain: str, agg: str = "mean", ts: str = "ts", y: str = "y") -> DataFrame:
    """Resampled, gap-free, interpolated series: at most one point per period of the span."""
    keys = list(keys)
    fine = resample(df, keys, grain, agg, ts, y)
    return interpolate(fill_gaps(fine, keys, GRAINS[grain], ts).drop("is_gap"), keys, ts, y)
