"""Column kinds and small reusable column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text tokens that count as missing.
NULL_TOKENS = ("", "null", "NULL", "None", "NaN", "nan", "NA", "n/a", "N/A")

WHITESPACE = " \t\n\r\f\v"

NUMERIC, TEXT, DATETIME, BOOLEAN, OTHER = "numeric", "text", "datetime", "boolean", "other"


def kind_of(dtype: T.DataType) -> str:
    """Analysis kind of a Spark type."""
    if isinstance(dtype, T.NumericType):
        return NUMERIC
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return TEXT
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN
    return OTHER


def columns_of_kind(df: DataFrame, *kinds: str) -> list[str]:
    return [f.name for f in df.schema.fields if kind_of(f.dataType) in kinds]


def q(name: str) -> Column:
    """Column by exact name, safe for dots and spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def is_missing(df: DataFrame, name: str, tokens: Iterable[str] = NULL_TOKENS) -> Column:
    """NULL, NaN, or (text only) one of the null tokens after trimming."""
    dtype = df.schema[name].dataType
    c = q(name)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    if kind_of(dtype) == TEXT:
        return c.isNull() | stripped(c).isin(*tokens)
    return c.isNull()


def present_number(df: DataFrame, name: str) -> Column:
    """Column as double with NaN folded to NULL."""
    c = q(name).cast("double")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    return c


def sample_skewness(c: Column) -> Column:
    """Bias-corrected skewness (adjusted Fisher-Pearson), 0 for zero variance, NULL below n=3."""
    n = F.count(c).cast("double")
    g1 = F.skewness(c)
    return F.when(n < 3, None).when(F.var_pop(c) == 0, F.lit(0.0)).otherwise(
        g1 * F.sqrt(n * (n - 1)) / (n - 2)
    )


def sample_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis, 0 for zero variance, NULL below n=4."""
    n = F.count(c).cast("double")
    g2 = F.kurtosis(c)
    return F.when(n < 4, None).when(F.var_pop(c) == 0, F.lit(0.0)).otherwise(
        (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    )


def micros(c: Column) -> Column:
    """Microseconds since the epoch for date or timestamp (zoned or not) columns."""
    return F.unix_micros(c.cast("timestamp"))


def rounded(df: DataFrame, digits: int = 4, **per_column: int) -> DataFrame:
    """Round every floating column, folding NaN to NULL and -0.0 to 0.0 (stable comparison)."""
    out = []
    for f in df.schema.fields:
        c = q(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), F.round(c.cast("double"), per_column.get(f.name, digits)) + F.lit(0.0))
        out.append(c.alias(f.name))
    return df.select(*out)


ISO = "iso"
# Text date formats, in order of trial (month first before day first).
DATE_FORMATS = (
    ISO, "M/d/yyyy[ H:mm[:ss]]", "d/M/yyyy[ H:mm[:ss]]", "yyyy/M/d[ H:mm[:ss]]", "d.M.yyyy[ H:mm[:ss]]", "M-d-yyyy", "d-M-yyyy",
    "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "d-MMM-yyyy",
)
# Pairs of formats that read the same texts as different days.
RIVALS = (("M/d/yyyy[ H:mm[:ss]]", "d/M/yyyy[ H:mm[:ss]]"), ("M-d-yyyy", "d-M-yyyy"))


def parsed_time(c: Column, form: str) -> Column:
    """Timestamp of a text in one of ``DATE_FORMATS``; NULL where it does not fit."""
    return F.try_to_timestamp(c) if form == ISO else F.try_to_timestamp(F.trim(c), F.lit(form))


def date_formats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, format, parse_share, is_ambiguous) of text columns: the one format that reads most of a column's values.

    Texts shorter than eight characters or without a separator are no dates. Of formats that read equally many values the first
    is taken; ``is_ambiguous`` says that month first and day first both fit that well. All formats are counted in one pass.
    """
    fits, cells = [], []
    for i, name in enumerate(columns):
        shaped = (F.length(q(name)) >= 8) & q(name).rlike("[-/. ]")
        fits.append(F.count(q(name)).alias(f"__{i}_n"))
        fits += [F.count_if(shaped & parsed_time(q(name), f).isNotNull()).alias(f"__{i}_{j}") for j, f in enumerate(DATE_FORMATS)]
        counts = [F.col(f"__{i}_{j}") for j in range(len(DATE_FORMATS))]
        best = F.array_max(F.array(*[F.struct(c.alias("n"), F.lit(-j).alias("j"), F.lit(f).alias("f")) for j, (c, f) in enumerate(zip(counts, DATE_FORMATS))]))
        tied = F.lit(False)
        for pair in RIVALS:
            a, b = (counts[DATE_FORMATS.index(f)] for f in pair)
            tied = tied | (best["f"].isin(*pair) & (a == b))
        some = best["n"] > 0
        cells.append(
            F.struct(
                F.lit(name).alias("column_name"), F.when(some, best["f"]).alias("format"),
                F.try_divide(best["n"], F.col(f"__{i}_n")).alias("parse_share"), (some & tied).alias("is_ambiguous"),
            )
        )
    schema = "column_name string, format string, parse_share double, is_ambiguous boolean"
    if not cells:
        return df.sparkSession.createDataFrame([], schema)
    return df.agg(*fits).select(F.inline(F.array(*cells)))
