"""Quality rules, task inference and suggestions derived from the profile.

Each rule is a projection or filter on top of the distributed profile; results are rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions.columns import (
    date_formats,
    BOOLEAN,
    NUMERIC,
    TEXT,
    columns_of_kind,
    kind_of,
    present_number,
    q,
    sample_skewness,
)
from lodestat.operators.profile import null_profile, profile_table
from lodestat.plans.skew import join_on, with_cumulative, with_position

COUNTS_ONLY: tuple[str, ...] = ()


def _hits(df: DataFrame, rules: Sequence[tuple[str, Column, Column, Column]], *keep: str) -> DataFrame:
    """Rows (keep..., rule, value, message) of the rules that apply."""
    cells = F.array(
        *[
            F.struct(
                F.lit(name).alias("rule"), value.cast("double").alias("value"), message.alias("message"),
                F.coalesce(hit, F.lit(False)).alias("hit"),
            )
            for name, hit, value, message in rules
        ]
    )
    return df.select(*keep, F.inline(F.filter(cells, lambda r: r["hit"]))).drop("hit")


def column_issues(df: DataFrame) -> DataFrame:
    """Mostly null (> 0.8), partly null (> 0.4), unique id, very high cardinality text."""
    p = profile_table(df, parts=COUNTS_ONLY)
    null, unique = F.col("fraction_null"), F.col("n_unique")
    return _hits(
        p,
        [
            ("drop", null > 0.8, null, F.lit("over 80% missing; drop it")),
            ("impute", (null > 0.4) & (null <= 0.8), null, F.lit("over 40% missing; impute it")),
            ("exclude", F.col("is_unique_id"), unique, F.lit("every value differs; keep it out of training")),
            ("high_cardinality", (F.col("kind") == TEXT) & (unique > 1000), unique, F.lit("over 1000 distinct texts; derive features or drop it")),
        ],
        "column_name",
    )


def table_issues(df: DataFrame) -> DataFrame:
    """Fewer than 500 rows; more columns than rows."""
    size = df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))
    return _hits(
        size,
        [
            ("small", F.col("n_rows") < 500, F.col("n_rows"), F.lit("under 500 rows; cross-validate and search less")),
            ("wide", F.col("n_cols") > F.col("n_rows"), F.col("n_cols"), F.lit("more columns than rows; select features")),
        ],
    )


def _drop_reasons() -> Column:
    return F.array_compact(
        F.array(
            F.when(F.col("fraction_null") > 0.8, "high null rate"),
            F.when(F.col("is_unique_id"), "unique identifier"),
            F.when(F.col("is_constant"), "constant"),
            F.when(
                (F.col("kind") == TEXT) & (F.col("n_unique") > 1000) & ~F.coalesce("likely_categorical", F.lit(False)),
                "very high cardinality text",
            ),
            F.when(F.col("likely_free_text"), "free text"),
        )
    )


def _features(df: DataFrame, target: str | None, parts: Sequence[str]) -> DataFrame:
    """Profile of the columns other than the target, with the reasons to drop each."""
    p = profile_table(df, parts=parts).withColumn("reasons", _drop_reasons())
    return p.filter(F.col("column_name") != F.lit(target)) if target else p


def drop_suggestions(df: DataFrame, target: str | None = None) -> DataFrame:
    """Columns to drop with their reasons."""
    return _features(df, target, COUNTS_ONLY).filter(F.size("reasons") > 0).select("column_name", "reasons")


def _kept(df: DataFrame, target: str | None, parts: Sequence[str]) -> DataFrame:
    return _features(df, target, parts).filter(F.size("reasons") == 0)


def impute_suggestions(df: DataFrame, target: str | None = None) -> DataFrame:
    """Kept columns with 0.05 < null share <= 0.4: median for numbers, mode otherwise."""
    p = _kept(df, target, COUNTS_ONLY).filter((F.col("fraction_null") > 0.05) & (F.col("fraction_null") <= 0.4))
    strategy = F.when(F.col("kind") == NUMERIC, "median").otherwise("mode")
    return p.select("column_name", strategy.alias("strategy"), F.col("fraction_null").alias("null_fraction"))


def encode_suggestions(df: DataFrame, target: str | None = None) -> DataFrame:
    """Category-like text: one-hot to 10 values, target encoding to 50, else frequency; coded numbers one-hot."""
    p = _kept(df, target, COUNTS_ONLY)
    text = (F.col("kind") == TEXT) & F.coalesce("likely_categorical", F.lit(True))
    coded = (F.col("kind") == NUMERIC) & F.col("likely_categorical_numeric")
    n = F.col("n_unique")
    encoding = F.when(text & (n <= 10), "onehot").when(text & (n <= 50), "target_encoding").when(text, "frequency_encoding").when(coded, "onehot")
    return p.withColumn("encoding", encoding).filter(F.col("encoding").isNotNull()).select(
        "column_name", "kind", "encoding", n.alias("cardinality")
    )


def scale_suggestions(df: DataFrame, target: str | None = None) -> DataFrame:
    """Robust for |skew| > 2 or more than 10% outliers, minmax for non-negative, else standard."""
    p = _kept(df, target, ("moments", "quartiles")).filter((F.col("kind") == NUMERIC) & ~F.col("likely_categorical_numeric"))
    skew = F.abs(F.coalesce("skew", F.lit(0.0)))
    share = F.coalesce("outlier_fraction", F.lit(0.0))
    scaling = F.when((skew > 2) | (share > 0.1), "robust").when(F.coalesce("min", F.lit(0.0)) >= 0, "minmax").otherwise("standard")
    return p.select("column_name", scaling.alias("scaling"), skew.alias("skew"), share.alias("outlier_fraction"))


def outlier_and_zero_flags(df: DataFrame, target: str | None = None) -> DataFrame:
    """More than 20% outliers, high null rate, more than half zeros."""
    p = _kept(df, target, ("quartiles",))
    zero = F.try_divide("zero_count", "n_rows")
    return _hits(
        p,
        [
            ("outliers", F.col("outlier_fraction") > 0.2, F.col("outlier_fraction"), F.lit("many outliers")),
            ("high_null", F.col("high_null_rate"), F.col("fraction_null"), F.lit("high missing value rate")),
            ("zeros", zero > 0.5, zero, F.lit("over half are zero; check that zero is a value")),
        ],
        "column_name",
    )


def feature_selection_advice(df: DataFrame, target: str | None = None) -> DataFrame:
    """Table-level advice: width, many dropped, many imputed, outliers present."""
    p = _features(df, target, ("quartiles",))
    kept = F.size("reasons") == 0
    null = F.col("fraction_null")
    summary = p.agg(
        F.max("n_rows").alias("n_rows"),
        F.count_if(~kept).alias("dropped"),
        F.count_if(kept & (null > 0.05) & (null <= 0.4)).alias("imputed"),
        F.count_if(kept & (F.col("outlier_fraction") > 0.2)).alias("outliers"),
    ).withColumn("n_cols", F.lit(len(df.columns)))
    wide = F.col("n_cols") > 50
    return _hits(
        summary,
        [
            ("many_columns", wide, F.col("n_cols"), F.lit("over 50 columns; select features first")),
            ("wide", ~wide & (F.col("n_cols") > F.col("n_rows")), F.col("n_cols"), F.lit("more columns than rows; select or regularize")),
            ("many_dropped", F.col("dropped") > F.col("n_cols") * 0.5, F.col("dropped"), F.lit("over half of the columns would be dropped; review them")),
            ("many_imputed", F.col("imputed") > 5, F.col("imputed"), F.lit("more than five columns need imputation; model it")),
            ("outliers", F.col("outliers") > 0, F.col("outliers"), F.lit("outliers present; scale robustly")),
        ],
    )


def infer_task(df: DataFrame, target: str | None = None) -> DataFrame:
    """One row: clustering without a target, classification for few classes, else regression."""
    if not target:
        one = df.sparkSession.range(1)
        return one.select(F.lit("clustering").alias("task"), F.lit(None).cast("long").alias("n_classes"))
    kind = kind_of(df.schema[target].dataType)
    v = present_number(df, target) if kind == NUMERIC else q(target)
    values = df.select(v.alias("v")).filter(F.col("v").isNotNull()).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    if kind == NUMERIC:
        few = (F.count("v") <= 10) & F.coalesce(F.bool_and(F.col("v") == F.floor("v")), F.lit(True))
    elif kind in (TEXT, BOOLEAN):
        few = F.count("v") <= 20
    else:
        few = F.lit(False)
    return values.agg(F.count("v").alias("__k"), few.alias("__few")).select(
        F.when(F.col("__few"), "classification").otherwise("regression").alias("task"),
        F.when(F.col("__few"), F.col("__k")).alias("n_classes"),
    )


def target_checks(df: DataFrame, target: str) -> DataFrame:
    """Missing targets (error), class imbalance above 10, classes below 5 rows, |skew| above 2."""
    kind = kind_of(df.schema[target].dataType)
    v = present_number(df, target) if kind == NUMERIC else q(target)
    rows = df.select(v.alias("v"))
    counts = rows.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    present = F.col("v").isNotNull()
    sizes = counts.agg(
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("n_missing"),
        F.min(F.when(present, F.col("n"))).alias("smallest"),
        F.max(F.when(present, F.col("n"))).alias("largest"),
    )
    skew = rows.agg((sample_skewness(F.col("v")) if kind == NUMERIC else F.lit(None).cast("double")).alias("skew"))
    one = sizes.crossJoin(skew).crossJoin(infer_task(df, target))  # one-row sides
    classes = F.col("task") == "classification"
    ratio = F.col("largest") / F.col("smallest")
    return _hits(
        one,
        [
            ("missing_target", F.col("n_missing") > 0, F.col("n_missing"), F.lit("error: target has missing values")),
            ("imbalance", classes & (ratio > 10), ratio, F.lit("warning: largest class over ten times the smallest; weight or resample")),
            ("rare_class", classes & (F.col("smallest") < 5), F.col("smallest"), F.lit("warning: classes with very few samples")),
            ("skewed_target", ~classes & (F.abs("skew") > 2), F.col("skew"), F.lit("warning: long-tailed target; take logs")),
        ],
    )


def problem_features(df: DataFrame, target: str | None = None) -> DataFrame:
    """Columns that are all missing, constant, or more than 90% missing."""
    p = profile_table(df, parts=COUNTS_ONLY)
    if target:
        p = p.filter(F.col("column_name") != target)
    missing = F.try_divide("n_raw_null", "n_rows")
    problem = F.when(missing == 1, "all missing").when(F.col("n_unique") <= 1, "constant").when(missing > 0.9, "mostly missing")
    return p.select("column_name", problem.alias("problem")).filter(F.col("problem").isNotNull())


def correlations(df: DataFrame, target: str) -> DataFrame:
    """Pearson r of every other numeric column with a numeric target, in one aggregate."""
    others = [c for c in columns_of_kind(df, NUMERIC) if c != target]
    t = present_number(df, target)
    wide = df.agg(*[F.corr(present_number(df, c), t).alias(f"__{i}") for i, c in enumerate(others)])
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"__{i}").alias("r")) for i, c in enumerate(others)]
    return wide.select(F.inline(F.array(*cells)))


def leakage_check(df: DataFrame, target: str, threshold: float = 0.95) -> DataFrame:
    """Numeric features whose |r| with the target exceeds the threshold."""
    return correlations(df, target).filter(F.abs("r") > threshold)


def readiness_report(df: DataFrame, target: str | None = None) -> DataFrame:
    """Errors, warnings and suggestions as rows (level, rule, subject, value)."""
    kinds = [kind_of(f.dataType) for f in df.schema.fields]
    features = len([c for c in df.columns if c != target])
    size = df.agg(F.count(F.lit(1)).alias("n_rows"))
    none = F.lit(None).cast("string")
    rows = [
        _hits(
            size,
            [
                ("empty", F.col("n_rows") == 0, F.col("n_rows"), F.lit("error")),
                ("very_small", F.col("n_rows") < 100, F.col("n_rows"), F.lit("warning")),
                ("wide", F.lit(len(df.columns)) > F.col("n_rows"), F.lit(len(df.columns)), F.lit("warning")),
                ("n_features", F.lit(True), F.lit(features), F.lit("info")),
                ("numeric_features", F.lit(not target), F.lit(kinds.count(NUMERIC)), F.lit("info")),
                ("categorical_features", F.lit(not target), F.lit(kinds.count(TEXT)), F.lit("info")),
                ("no_features", F.lit(bool(target) and features == 0), F.lit(0), F.lit("error")),
            ],
        ).select(F.col("message").alias("level"), "rule", none.alias("subject"), "value"),
        problem_features(df, target).select(
            F.lit("warning").alias("level"), F.lit("problem_feature").alias("rule"), F.col("column_name").alias("subject"),
            F.lit(None).cast("double").alias("value"),
        ),
        infer_task(df, target).select(
            F.lit("info").alias("level"), F.concat(F.lit("task_"), "task").alias("rule"), F.lit(target).cast("string").alias("subject"),
            F.col("n_classes").cast("double").alias("value"),
        ),
    ]
    if target:
        rows.append(
            target_checks(df, target).select(
                F.regexp_extract("message", "^(error|warning)", 1).alias("level"), "rule", F.lit(target).alias("subject"), "value"
            )
        )
        if kind_of(df.schema[target].dataType) == NUMERIC and columns_of_kind(df.drop(target), NUMERIC):
            rows.append(
                leakage_check(df, target).select(
                    F.lit("warning").alias("level"), F.lit("leakage").alias("rule"), F.col("column_name").alias("subject"), F.col("r").alias("value")
                )
            )
    out = rows[0]
    for part in rows[1:]:
        out = out.unionByName(part)
    return out


def is_ready(report: DataFrame) -> DataFrame:
    """One row: whether a readiness report has no errors."""
    return report.agg((F.count_if(F.col("level") == "error") == 0).alias("is_ready"))


def feature_composition(df: DataFrame, target: str | None = None) -> DataFrame:
    """Counts of numeric, low- and high-cardinality text and null-heavy features, and a size tier."""
    p = profile_table(df, parts=COUNTS_ONLY)
    feature = F.col("column_name") != F.lit(target) if target else F.lit(True)
    text, null, n = F.col("kind") == TEXT, F.col("fraction_null"), F.max("n_rows")
    return p.agg(
        F.count_if(feature & (F.col("kind") == NUMERIC)).alias("numeric_features"),
        F.count_if(feature & text & (F.col("n_unique") <= 100)).alias("low_cardinality_text"),
        F.count_if(feature & text & (F.col("n_unique") > 100)).alias("high_cardinality_text"),
        F.count_if(feature & (null > 0.2)).alias("missing_features"),
        F.count_if(feature & F.col("kind").isin(NUMERIC, TEXT) & (null > 0.3)).alias("high_missing_features"),
        F.when(n < 1000, "small").when(n < 10000, "medium").otherwise("large").alias("size_tier"),
    )


# Name parts that hint at a target, name parts that rule one out, and exact target names.
TARGET_HINTS = (
    "target", "label", "class", "outcome", "result", "y", "dependent", "churn", "price", "amount", "value", "score",
    "rating", "risk", "default", "fraud", "conversion", "purchase", "success", "failure",
)
NON_TARGET_HINTS = ("id", "key", "name", "date", "time", "created", "updated")
TARGET_NAMES = ("target", "label", "class", "outcome", "result", "y")
DATE_HINTS = ("date", "time")


def _contains_any(c: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(F.lower(c), F.lit(w))
    return hit


def rank_targets(df: DataFrame) -> DataFrame:
    """Candidate targets by score, best first; distinct counts come from the whole table.

    If no column scores, the last column is the one candidate, with score 0.
    """
    p = profile_table(df, parts=COUNTS_ONLY).filter(~_contains_any(F.col("column_name"), NON_TARGET_HINTS))
    n = F.col("n_unique")
    present = F.col("n_rows") - F.col("n_raw_null")
    score = (
        F.when(_contains_any(F.col("column_name"), TARGET_HINTS), 10).otherwise(0)
        + F.when(F.col("column_name") == df.columns[-1], 5).otherwise(0)
        + F.when((n >= 2) & (n <= F.least(F.lit(20.0), present * 0.8)), 3).otherwise(0)
        + F.when(n == 2, 2).otherwise(0)
    )
    ranked = p.withColumn("score", score).filter(F.col("score") > 0).select("column_name", "score", "position")
    last = [(df.columns[-1], 0, len(df.columns) - 1)]
    fallback = df.sparkSession.createDataFrame(last, ranked.schema)
    none = ranked.agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") == 0)
    return ranked.unionByName(fallback.crossJoin(F.broadcast(none)).drop("__n")).orderBy(F.desc("score"), "position")  # one-row sides


def detect_date_columns(df: DataFrame) -> DataFrame:
    """Columns named like dates, typed as dates, or text of which one format reads at least 70%; with that format.

    ``is_ambiguous`` says that month first and day first read the column equally well (month first is taken then).
    """
    known = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(any(h in f.name.lower() for h in DATE_HINTS) or kind_of(f.dataType) == "datetime").alias("by_name_or_type"),
        )
        for f in df.schema.fields
    ]
    columns = df.sparkSession.range(1).select(F.inline(F.array(*known)))
    found = date_formats(df, columns_of_kind(df, TEXT))
    out = columns.join(F.broadcast(found), "column_name", "left")  # one row a column
    out = out.filter(F.col("by_name_or_type") | (F.col("parse_share") >= 0.7))
    return out.select("column_name", "by_name_or_type", "parse_share", "format", F.coalesce("is_ambiguous", F.lit(False)).alias("is_ambiguous"))


def chronological_order(df: DataFrame, keys: Sequence[str], ts: str, order_by: str) -> DataFrame:
    """Share of positions where the stored order holds the same date as date order; ordered above 0.8.

    A row at stored position i agrees when i falls in the range its date takes in sorted order, so
    only the range of each distinct date is needed.
    """
    keys = list(keys)
    rows = with_position(df.filter(F.col(ts).isNotNull()).select(*keys, ts, order_by), keys, order_by, name="__i")
    dates = rows.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("__c"))
    ranges = with_cumulative(dates, keys, ts, "__c", "__lo")
    agree = (F.col("__i") >= F.col("__lo")) & (F.col("__i") < F.col("__lo") + F.col("__c"))
    joined = join_on(rows, ranges, [*keys, ts])
    return joined.groupBy(*keys).agg(F.avg(agree.cast("double")).alias("order_score")).withColumn(
        "is_ordered", F.col("order_score") > 0.8
    )


def sample_null_warning(df: DataFrame, n: int = 5, order_by: Sequence[str] = ()) -> DataFrame:
    """Columns with more than 80% null among the preview rows."""
    rows = df.orderBy(*order_by).limit(n) if order_by else df.limit(n)
    return null_profile(rows).filter(F.col("fraction_null") > 0.8).select("column_name", "fraction_null")


def suggest_tasks(df: DataFrame, limit: int = 5) -> DataFrame:
    """Up to five analysis suggestions (rank, type, target).

    Forecasting for the first two measures of a dated table, prediction of up to three candidate
    targets (the last column if there is none), clustering from 10 rows on, exploration.
    """
    p = profile_table(df, parts=COUNTS_ONLY)
    dated = any(
        kind_of(f.dataType) == "datetime" or any(h in f.name.lower() for h in DATE_HINTS) for f in df.schema.fields
    ) or bool(columns_of_kind(df, TEXT) and not detect_date_columns(df).isEmpty())
    number, n = F.col("kind") == NUMERIC, F.col("n_unique")
    key_like = F.col("is_unique_id") | _contains_any(F.col("column_name"), ("id", "key"))
    order = Window.partitionBy("type").orderBy("position")

    def top(rows: DataFrame, kind: Column, k: int, group: int) -> DataFrame:
        return (
            rows.withColumn("type", F.lit("x"))
            .withColumn("__r", F.row_number().over(order))
            .filter(F.col("__r") <= k)
            .select(F.lit(group).alias("group"), F.col("__r").alias("r"), kind.alias("type"), F.col("column_name").alias("target"))
        )

    task = F.when(n <= 20, "classification").otherwise("regression")
    fits = F.lower("column_name").isin(*TARGET_NAMES) | (number & (n <= 20) & (F.lower("column_name") != "id"))
    last = F.col("column_name") == df.columns[-1]
    candidates = p.withColumn("__fit", fits).withColumn("__last", last)
    any_fit = candidates.agg(F.bool_or("__fit").alias("__any"))
    chosen = candidates.crossJoin(F.broadcast(any_fit)).filter(  # one-row side
        F.col("__fit") | (~F.col("__any") & F.col("__last"))
    )
    out = top(chosen, task, 3, 2)
    if dated:
        out = top(p.filter(number & (n > 20) & ~key_like), F.lit("forecasting"), 2, 1).unionByName(out)
    size = df.agg(F.count(F.lit(1)).alias("__n"))
    none = F.lit(None).cast("string")
    for group, kind, least in ((3, "clustering", 10), (4, "exploration", 0)):
        out = out.unionByName(
            size.filter(F.col("__n") >= least).select(
                F.lit(group).alias("group"), F.lit(1).alias("r"), F.lit(kind).alias("type"), none.alias("target")
            )
        )
    ranked = out.orderBy("group", "r").limit(limit)
    overall = Window.partitionBy("__all").orderBy("group", "r")
    return ranked.withColumn("__all", F.lit(1)).withColumn("rank", F.row_number().over(overall)).select("rank", "type", "target")
