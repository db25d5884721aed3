"""Column profiling: one output row per input column.

Statistics that need one pass come from a single wide aggregate turned into rows; statistics over
distinct values come from (column, value) counts. Both combine on the map side, so a hot value or a
single huge column never lands in one task. Output tables have one row per column, which is what
makes the joins between them broadcasts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions.columns import (
    BOOLEAN,
    DATETIME,
    NUMERIC,
    OTHER,
    TEXT,
    columns_of_kind,
    is_missing,
    kind_of,
    present_number,
    q,
    sample_kurtosis,
    sample_skewness,
)
from lodestat.plans.quantiles import exact_quantiles, marks
from lodestat.plans.skew import with_previous
from lodestat.session import materialize


class _Const:
    """A field that needs no aggregate."""

    def __init__(self, value: object, dtype: str):
        self.column = F.lit(value).cast(dtype)


def _rows_from_wide(df: DataFrame, stats: dict[str, dict[str, Column | _Const]]) -> DataFrame:
    """One aggregate over ``df``; ``stats[column][field]`` becomes row ``column``, column ``field``."""
    aggregates, structs = [], []
    for i, (name, fields) in enumerate(stats.items()):
        aggregates += [e.alias(f"__{i}_{field}") for field, e in fields.items() if not isinstance(e, _Const)]
        structs.append(
            F.struct(
                F.lit(name).alias("column_name"),
                *[
                    (e.column if isinstance(e, _Const) else F.col(f"__{i}_{field}")).alias(field)
                    for field, e in fields.items()
                ],
            )
        )
    if not structs:
        raise ValueError("no column of the required kind")
    return df.agg(*aggregates).select(F.inline(F.array(*structs)))


def _per_column(left: DataFrame, *others: DataFrame) -> DataFrame:
    """Left-join profile tables, each with one row per input column."""
    for other in others:
        left = left.join(F.broadcast(other), "column_name", "left")
    return left


def null_profile(df: DataFrame) -> DataFrame:
    """n_null (NULL, NaN or token), fraction_null, has_nulls, high_null_rate (> 0.5)."""
    wide = _rows_from_wide(
        df,
        {c: {"n_rows": F.count(F.lit(1)), "n_null": F.count_if(is_missing(df, c))} for c in df.columns},
    )
    fraction = F.when(F.col("n_rows") > 0, F.col("n_null") / F.col("n_rows")).otherwise(F.lit(0.0))
    return wide.withColumn("fraction_null", fraction).select(
        "column_name",
        "n_rows",
        "n_null",
        "fraction_null",
        (F.col("n_null") > 0).alias("has_nulls"),
        (F.col("fraction_null") > 0.5).alias("high_null_rate"),
    )


def value_counts_long(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Counts per (column_name, value); values as text, NULL and NaN counted as NULL."""
    columns = list(columns or df.columns)

    def as_text(c: str) -> Column:
        if kind_of(df.schema[c].dataType) == NUMERIC:
            dtype = df.schema[c].dataType
            return F.when(present_number(df, c).isNotNull(), q(c).cast(dtype).cast("string"))
        return q(c).cast("string")

    values = df.select(*[as_text(c).alias(c) for c in columns])
    return values.unpivot([], [q(c) for c in columns], "column_name", "value").groupBy("column_name", "value").count()


def hashed_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Counts per (column_name, distinct value) over 128-bit hashes of the values: h1, h2, count, v and t.

    ``v`` is the number of a numeric column, ``t`` the microseconds of a datetime column; NULL and NaN have null hashes. Long
    texts cost no more than short ones in the shuffle.
    """
    columns = list(columns if columns is not None else df.columns)

    def cell(i: int, c: str) -> Column:
        kind = kind_of(df.schema[c].dataType)
        value = F.when(present_number(df, c).isNotNull(), q(c)) if kind == NUMERIC else q(c).cast("string") if kind == OTHER else q(c)
        some = value.isNotNull()
        return F.struct(
            F.lit(i).alias("i"),
            F.when(some, F.xxhash64(value)).alias("h1"),
            F.when(some, F.xxhash64(F.lit(1), value)).alias("h2"),
            (present_number(df, c) if kind == NUMERIC else F.lit(None).cast("double")).alias("v"),
            (F.unix_micros(q(c).cast("timestamp")) if kind == DATETIME else F.lit(None).cast("long")).alias("t"),
        )

    cells = df.select(F.inline(F.array(*[cell(i, c) for i, c in enumerate(columns)])))
    counts = cells.groupBy("i", "h1", "h2").agg(F.count(F.lit(1)).alias("count"), F.min("v").alias("v"), F.min("t").alias("t"))
    names = F.array(*[F.lit(c) for c in columns])
    return counts.select(F.element_at(names, F.col("i") + 1).alias("column_name"), "h1", "h2", "count", "v", "t")


def distinct_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """n_unique, n_unique_including_null, is_unique_id; sketches instead when ``approx``."""
    if approx:
        wide = _rows_from_wide(
            df,
            {
                c: {
                    "n_rows": F.count(F.lit(1)),
                    "n_unique": F.approx_count_distinct(q(c)),
                    "__raw_null": F.count_if(q(c).isNull()),
                }
                for c in df.columns
            },
        )
        out = wide.withColumn(
            "n_unique_including_null", F.col("n_unique") + (F.col("__raw_null") > 0).cast("int")
        ).drop("__raw_null")
    else:
        out = hashed_values(df).groupBy("column_name").agg(
            F.sum("count").alias("n_rows"),
            F.count("h1").alias("n_unique"),
            F.count(F.lit(1)).alias("n_unique_including_null"),
        )
    nulls = null_profile(df).select("column_name", "n_null")
    unique = (F.col("n_unique") == F.col("n_rows")) & (F.col("n_rows") > 1) & (F.col("n_null") == 0)
    return _per_column(out, nulls).select(
        "column_name", "n_rows", "n_unique", "n_unique_including_null", unique.alias("is_unique_id")
    )


def cardinality_flags(df: DataFrame) -> DataFrame:
    """is_constant (<= 1 value), is_binary (= 2), is_categorical (< min(50, n/10))."""
    return distinct_profile(df).select("column_name", "n_rows", "n_unique", *_cardinality(F.col("n_unique"), F.col("n_rows")))


def _cardinality(n_unique: Column, n_rows: Column) -> list[Column]:
    return [
        (n_unique <= 1).alias("is_constant"),
        (n_unique == 2).alias("is_binary"),
        (n_unique < F.least(F.lit(50.0), n_rows * 0.1)).alias("is_categorical"),
    ]


def numeric_long(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows (column_name, v) of the numeric columns as doubles, missing values left out."""
    columns = list(columns if columns is not None else columns_of_kind(df, NUMERIC))
    wide = df.select(*[present_number(df, c).alias(c) for c in columns])
    return wide.unpivot([], [q(c) for c in columns], "column_name", "v").filter(F.col("v").isNotNull())


def column_quantiles(df: DataFrame, probs: dict[str, float], columns: Sequence[str] | None = None) -> DataFrame:
    """Exact quantiles of numeric columns."""
    return exact_quantiles(numeric_long(df, columns), ["column_name"], "v", probs, bounded_keys=True)


def numeric_moments(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """n, min, max, mean, std (0 for one value), bias-corrected skew and kurtosis."""
    columns = list(columns if columns is not None else columns_of_kind(df, NUMERIC))
    return _rows_from_wide(df, {c: {"n": F.count(present_number(df, c)), **_moment_stats(present_number(df, c))} for c in columns})


def _column_names(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    names = F.explode(F.array(*[F.lit(c) for c in columns])).alias("column_name")
    return df.sparkSession.range(1).select(names)


def _moment_stats(v: Column) -> dict[str, Column]:
    n = F.count(v)
    return {
        "min": F.min(v),
        "max": F.max(v),
        "mean": F.avg(v),
        "std": F.when(n > 1, F.stddev_samp(v)).when(n == 1, F.lit(0.0)),
        "skew": F.when(n == 1, F.lit(0.0)).otherwise(sample_skewness(v)),
        "kurtosis": F.when(n == 1, F.lit(0.0)).otherwise(sample_kurtosis(v)),
    }


def numeric_summary(df: DataFrame) -> DataFrame:
    """Moments plus the exact median."""
    median = column_quantiles(df, {"median": 0.5}).drop("n")
    return _per_column(numeric_moments(df), median).select(
        "column_name", "n", "min", "max", "mean", "median", "std", "skew", "kurtosis"
    )


def numeric_sign_counts(df: DataFrame) -> DataFrame:
    """zero_count, has_zero_values, negative_count."""
    stats = {
        c: {
            "zero_count": F.count_if(present_number(df, c) == 0),
            "negative_count": F.count_if(present_number(df, c) < 0),
        }
        for c in columns_of_kind(df, NUMERIC)
    }
    return _rows_from_wide(df, stats).withColumn("has_zero_values", F.col("zero_count") > 0)


def _numeric_values(df: DataFrame) -> DataFrame:
    """Distinct (column_name, v) of the numeric columns."""
    return numeric_long(df).distinct()


def unique_values_head(df: DataFrame, k: int = 20) -> DataFrame:
    """Sorted first ``k`` distinct values of each numeric column as an array."""
    return _head(_numeric_values(df), k)


def _head(values: DataFrame, k: int = 20) -> DataFrame:
    order = Window.partitionBy("column_name").orderBy("v")
    head = values.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= k)
    return head.groupBy("column_name").agg(F.array_sort(F.collect_list("v")).alias("unique_values"))


def likely_categorical_numeric(df: DataFrame) -> DataFrame:
    """At most 20 distinct values, all integral, min >= 0, max < 100."""
    stats = {}
    for c in columns_of_kind(df, NUMERIC):
        v = present_number(df, c)
        stats[c] = {"all_integral": F.bool_and(v == F.floor(v)), "__min": F.min(v), "__max": F.max(v)}
    uniques = _numeric_values(df).groupBy("column_name").agg(F.count(F.lit(1)).alias("n_unique"))
    flag = (F.col("n_unique") <= 20) & F.col("all_integral") & (F.col("__min") >= 0) & (F.col("__max") < 100)
    return _per_column(_rows_from_wide(df, stats), uniques).select(
        "column_name",
        F.coalesce("n_unique", F.lit(0)).cast("long").alias("n_unique"),
        "all_integral",
        F.coalesce(flag, F.lit(False)).alias("likely_categorical_numeric"),
    )


def iqr_bounds(quartiles: DataFrame) -> DataFrame:
    """Adds the fences of 1.5 IQR to a table with q1 and q3."""
    iqr = F.col("q3") - F.col("q1")
    return quartiles.withColumn("lower_bound", F.col("q1") - 1.5 * iqr).withColumn(
        "upper_bound", F.col("q3") + 1.5 * iqr
    )


def iqr_outliers(df: DataFrame) -> DataFrame:
    """Quartiles, fences, and how many values lie strictly outside; only for n > 4."""
    return _quartiles_and_outliers(df).filter(F.col("n") > 4).drop("median")


# Fixed values.
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def _quartiles_and_outliers(df: DataFrame) -> DataFrame:
    values = numeric_long(df)
    bounds = iqr_bounds(exact_quantiles(values, ["column_name"], "v", QUARTILES, bounded_keys=True))
    return _outliers(values.withColumn("count", F.lit(1)), bounds)


def _outliers(values: DataFrame, bounds: DataFrame) -> DataFrame:
    """Fences and how many values (column_name, v, count) lie outside them."""
    bounds = bounds.select(
        "column_name",
        "n",
        "median",
        *[F.when(F.col("n") > 4, F.col(c)).alias(c) for c in ("q1", "q3", "lower_bound", "upper_bound")],
    )
    outside = (F.col("v") < F.col("lower_bound")) | (F.col("v") > F.col("upper_bound"))
    counts = (
        values.join(F.broadcast(bounds), "column_name")
        .groupBy("column_name")
        .agg(F.when(F.max("n") > 4, F.sum(F.when(outside, F.col("count")).otherwise(0))).alias("outlier_count"))
    )
    return _per_column(bounds, counts).withColumn("outlier_fraction", F.col("outlier_count") / F.col("n"))


def top_values(df: DataFrame, k: int = 20, columns: Sequence[str] | None = None) -> DataFrame:
    """The ``k`` most frequent non-null values of each text column, ties by value.

    Ranks run per column, but Spark cuts each map task to its own ``k`` rows before the shuffle.
    """
    columns = list(columns if columns is not None else columns_of_kind(df, TEXT))
    order = Window.partitionBy("column_name").orderBy(F.desc("count"), "value")
    return (
        value_counts_long(df, columns)
        .filter(F.col("value").isNotNull())
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
    )


def string_lengths(df: DataFrame) -> DataFrame:
    """Average, maximum and minimum length of each text column."""
    return _rows_from_wide(df, {c: _length_stats(c) for c in columns_of_kind(df, TEXT)})


def _length_stats(c: str) -> dict[str, Column]:
    size = F.length(q(c))
    return {
        "avg_string_length": F.avg(size),
        "max_string_length": F.max(size).cast("long"),
        "min_string_length": F.min(size).cast("long"),
    }


def _shape_stats(c: str) -> dict[str, Column]:
    return {
        "__lower": F.bool_or(q(c).rlike("[a-z]")),
        "__upper": F.bool_or(q(c).rlike("[A-Z]")),
        "has_numbers": F.bool_or(q(c).rlike(r"\d")),
        "has_special_chars": F.bool_or(q(c).rlike(r"[^a-zA-Z0-9\s]")),
    }


def text_shape_flags(df: DataFrame) -> DataFrame:
    """Category, free-text and id guesses plus character classes of each text column."""
    text = df.select(*[q(c) for c in columns_of_kind(df, TEXT)])
    wide = _rows_from_wide(text, {c: {**_length_stats(c), **_shape_stats(c)} for c in text.columns})
    return _per_column(wide, distinct_profile(text)).select("column_name", *_text_flags())


def _text_flags() -> list[Column]:
    avg, longest = F.col("avg_string_length"), F.col("max_string_length")
    return [
        ((F.col("n_unique") < F.col("n_rows") * 0.1) & (avg < 50)).alias("likely_categorical"),
        ((avg > 50) | (longest > 200)).alias("likely_free_text"),
        (F.col("__lower") & F.col("__upper")).alias("has_mixed_case"),
        F.col("has_numbers"),
        F.col("has_special_chars"),
        F.col("is_unique_id").alias("likely_id_column"),
    ]


def _datetime_stats(df: DataFrame, c: str, as_of: Column) -> dict[str, Column]:
    t = q(c).cast("timestamp")
    days = F.floor((F.unix_micros(F.max(t)) - F.unix_micros(F.min(t))) / 86_400_000_000)
    return {
        "min_date": F.min(t),
        "max_date": F.max(t),
        "date_range_days": days.cast("long"),
        "has_future_dates": F.bool_or(t > as_of),
    }


def date_frequency(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Label from the most common gap between consecutive sorted dates (smallest gap on ties)."""
    columns = list(columns if columns is not None else columns_of_kind(df, DATETIME))
    dates = df.select(*[q(c).cast("timestamp").alias(c) for c in columns])
    points = (
        dates.unpivot([], [q(c) for c in columns], "column_name", "ts")
        .filter(F.col("ts").isNotNull())
        .groupBy("column_name", "ts")
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    return _frequency(points, columns)


def _frequency(points: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Frequency labels from distinct (column_name, ts) and their counts ``__c``."""
    gaps = with_previous(points, ["column_name"], "ts").select(
        "column_name",
        F.inline(
            F.array(
                F.struct((F.unix_micros("ts") - F.unix_micros("prev_ts")).alias("gap"), F.lit(1).cast("long").alias("n")),
                F.struct(F.lit(0).cast("long").alias("gap"), (F.col("__c") - 1).alias("n")),
            )
        ),
    )
    per_gap = gaps.filter(F.col("gap").isNotNull() & (F.col("n") > 0)).groupBy("column_name", "gap").agg(F.sum("n").alias("n"))
    modal = per_gap.groupBy("column_name").agg(
        F.min(F.struct((-F.col("n")).alias("n"), F.col("gap").alias("gap"))).alias("__m")
    )
    d = F.floor(F.col("__m.gap") / 86_400_000_000)
    label = (
        F.when(d == 1, "daily")
        .when(d.between(6, 8), "weekly")
        .when(d.between(28, 32), "monthly")
        .when(d.between(89, 92), "quarterly")
        .when(d.between(360, 370), "yearly")
        .otherwise(F.concat(F.lit("custom_"), d.cast("string"), F.lit("_days")))
    )
    return _per_column(_column_names(points, columns), modal.select("column_name", label.alias("date_frequency"))).fillna(
        "unknown", ["date_frequency"]
    )


def datetime_summary(df: DataFrame, as_of: str) -> DataFrame:
    """Range in whole days, dates after ``as_of``, frequency label."""
    moment = F.lit(as_of).cast("timestamp")
    wide = _rows_from_wide(df, {c: _datetime_stats(df, c, moment) for c in columns_of_kind(df, DATETIME)})
    return _per_column(wide, date_frequency(df))


def boolean_summary(df: DataFrame) -> DataFrame:
    """true_count, false_count, true_fraction of each boolean column."""
    stats = {
        c: {"true_count": F.count_if(q(c)), "false_count": F.count_if(~q(c))} for c in columns_of_kind(df, BOOLEAN)
    }
    return _rows_from_wide(df, stats).withColumn(
        "true_fraction", F.try_divide(F.col("true_count"), F.col("true_count") + F.col("false_count"))
    )


# The costlier parts of a profile, which a caller may leave out.
PROFILE_PARTS = ("moments", "quartiles", "unique_values", "top_values", "date_frequency")


def profile_table(
    df: DataFrame, as_of: str | None = None, parts: Sequence[str] = PROFILE_PARTS, approx: bool = False
) -> DataFrame:
    """The whole profile, one row per column; fields of other kinds, or of parts left out, are NULL.

    Three passes: one wide aggregate, the counts of distinct values by hash, which also give quartiles, outliers, first values and
    date gaps, and the most frequent texts. ``approx`` takes distinct counts from sketches and quartiles from brackets in more
    passes, so that only ``unique_values`` and ``date_frequency`` shuffle distinct values.
    """
    moment = F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp()
    none = F.lit(None)
    fields = {}
    for position, f in enumerate(df.schema.fields):
        c, kind = f.name, kind_of(f.dataType)
        fields[c] = {
            "position": _Const(position, "int"),
            "kind": _Const(kind, "string"),
            "n_rows": F.count(F.lit(1)),
            "n_null": F.count_if(is_missing(df, c)),
            "n_raw_null": F.count_if(q(c).isNull()),
            **{name: _Const(None, dtype) for name, dtype in _KIND_FIELDS.items()},
        }
        if kind == NUMERIC:
            v = present_number(df, c)
            fields[c].update(
                zero_count=F.when(F.count(v) > 0, F.count_if(v == 0)),
                negative_count=F.when(F.count(v) > 0, F.count_if(v < 0)),
                all_integral=F.bool_and(v == F.floor(v)),
                __code_range=F.bool_and((v >= 0) & (v < 100)),
            )
        elif kind == TEXT:
            fields[c].update(_length_stats(c), **_shape_stats(c))
        elif kind == DATETIME:
            fields[c].update(_datetime_stats(df, c, moment))
        elif kind == BOOLEAN:
            n = F.count(q(c))
            fields[c].update(
                true_count=F.when(n > 0, F.count_if(q(c))),
                false_count=F.when(n > 0, F.count_if(~q(c))),
                true_fraction=F.avg(q(c).cast("double")),
            )
    numbers = columns_of_kind(df, NUMERIC)
    for c in numbers:
        v = present_number(df, c)
        fields[c]["__n"] = F.count(v)
        if "moments" in parts:
            fields[c].update(_moment_stats(v))
        if "quartiles" in parts:
            fields[c]["__marks"] = marks(v, QUARTILES)
    for c in set(df.columns) - set(numbers):
        missing = {"__n": "long", **({m: "double" for m in _MOMENTS} if "moments" in parts and numbers else {})}
        missing |= {"__marks": "array<double>"} if "quartiles" in parts and numbers else {}
        fields[c].update({name: _Const(None, dtype) for name, dtype in missing.items()})
    # Everything that one pass can give: a single row, which is cheap to keep.
    base = materialize(_rows_from_wide(df, fields), "profile-base")
    scalar = [f.name for f in df.schema.fields if kind_of(f.dataType) != OTHER]
    wanted = numbers and {"quartiles", "unique_values"} & set(parts) or columns_of_kind(df, DATETIME) and "date_frequency" in parts
    values = None if approx else hashed_values(df, scalar)
    values = materialize(values, "profile-values") if wanted and not approx else values
    if approx:
        sketches = {c: {"n_unique": F.approx_count_distinct(q(c)), "__gap": F.max(q(c).isNull().cast("int"))} for c in scalar}
        uniques = _rows_from_wide(df, sketches).select(
            "column_name", "n_unique", (F.col("n_unique") + F.coalesce("__gap", F.lit(0))).alias("n_unique_including_null")
        )
    else:
        uniques = values.groupBy("column_name").agg(F.count("h1").alias("n_unique"), F.count(F.lit(1)).alias("n_unique_including_null"))
    extra = [uniques]
    if numbers:
        numeric_values = None if approx else values.filter(F.col("v").isNotNull())
        if "quartiles" in parts and approx:
            extra.append(_quartiles_and_outliers(df).drop("n"))
        elif "quartiles" in parts:
            sketch = base.filter("__n > 0").select("column_name", F.col("__n").alias("n"), "__marks")
            found = exact_quantiles(numeric_values, ["column_name"], "v", QUARTILES, bounded_keys=True, weight="count", sketch=sketch)
            extra.append(_outliers(numeric_values, iqr_bounds(found)).drop("n"))
        if "unique_values" in parts:
            extra.append(unique_values_head(df) if approx else _head(numeric_values))
    if columns_of_kind(df, TEXT) and "top_values" in parts:
        top = top_values(df).groupBy("column_name").agg(
            F.map_from_entries(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("rank", "value", "count"))),
                    lambda e: F.struct(e["value"].alias("key"), e["count"].alias("value")),
                )
            ).alias("top_values")
        )
        extra.append(top)
    if columns_of_kind(df, DATETIME) and "date_frequency" in parts:
        dates = columns_of_kind(df, DATETIME)
        if approx:
            extra.append(date_frequency(df, dates))
        else:
            points = values.filter(F.col("t").isNotNull()).select("column_name", F.timestamp_micros("t").alias("ts"), F.col("count").alias("__c"))
            extra.append(_frequency(points, dates))
    out = _per_column(base, *extra)
    for name, dtype in (
        *[(name, "double") for name in ("min", "max", "mean", "std", "skew", "kurtosis")], ("median", "double"), ("q1", "double"), ("q3", "double"), ("lower_bound", "double"),
        ("upper_bound", "double"), ("outlier_count", "long"), ("outlier_fraction", "double"),
        ("unique_values", "array<double>"), ("top_values", "map<string,bigint>"), ("date_frequency", "string"),
    ):
        if name not in out.columns:
            out = out.withColumn(name, none.cast(dtype))
    fraction = F.when(F.col("n_rows") > 0, F.col("n_null") / F.col("n_rows")).otherwise(F.lit(0.0))
    n_unique, n_rows = F.coalesce("n_unique", F.lit(0)), F.col("n_rows")
    numeric, text = F.col("kind") == NUMERIC, F.col("kind") == TEXT
    codes = (n_unique <= 20) & F.col("all_integral") & F.col("__code_range")
    out = out.withColumns(
        {
            "n_unique": n_unique,
            "n_unique_including_null": F.coalesce("n_unique_including_null", F.lit(0)),
            "fraction_null": fraction,
            "has_nulls": F.col("n_null") > 0,
            "high_null_rate": fraction > 0.5,
            "is_unique_id": (n_unique == n_rows) & (n_rows > 1) & (F.col("n_null") == 0),
            "is_constant": n_unique <= 1,
            "is_binary": n_unique == 2,
            "is_categorical": n_unique < F.least(F.lit(50.0), n_rows * 0.1),
            "likely_categorical_numeric": F.when(numeric, F.coalesce(codes, F.lit(False))),
            "has_zero_values": F.col("zero_count") > 0,
        }
    )
    avg, longest = F.col("avg_string_length"), F.col("max_string_length")
    out = out.withColumns(
        {
            "likely_categorical": F.when(text, (n_unique < n_rows * 0.1) & (avg < 50)),
            "likely_free_text": F.when(text, (avg > 50) | (longest > 200)),
            "has_mixed_case": F.col("__lower") & F.col("__upper"),
            "likely_id_column": F.when(text, F.col("is_unique_id")),
        }
    )
    return out.select(*PROFILE_FIELDS)


_MOMENTS = ("min", "max", "mean", "std", "skew", "kurtosis")

# Profile fields that exist for one kind only, with their types.
_KIND_FIELDS = {
    "zero_count": "long", "negative_count": "long", "all_integral": "boolean", "__code_range": "boolean", "avg_string_length": "double",
    "max_string_length": "long", "min_string_length": "long", "__lower": "boolean", "__upper": "boolean",
    "has_numbers": "boolean", "has_special_chars": "boolean", "min_date": "timestamp", "max_date": "timestamp",
    "date_range_days": "long", "has_future_dates": "boolean", "true_count": "long", "false_count": "long",
    "true_fraction": "double",
}

# Fixed order of the profile's output columns.
PROFILE_FIELDS = (
    "column_name", "position", "kind", "n_rows", "n_null", "n_raw_null", "fraction_null", "has_nulls",
    "high_null_rate", "n_unique", "n_unique_including_null", "is_unique_id", "is_constant", "is_binary",
    "is_categorical", "min", "max", "mean", "median", "std", "skew", "kurtosis", "q1", "q3", "lower_bound",
    "upper_bound", "outlier_count", "outlier_fraction", "has_zero_values", "zero_count", "negative_count",
    "all_integral", "likely_categorical_numeric", "unique_values", "top_values", "avg_string_length",
    "max_string_length", "min_string_length", "likely_categorical", "likely_free_text", "has_mixed_case",
    "has_numbers", "has_special_chars", "likely_id_column", "min_date", "max_date", "date_range_days",
    "has_future_dates", "date_frequency", "true_count", "false_count", "true_fraction",
)
