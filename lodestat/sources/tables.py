"""Table sources, sinks, previews and samples."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.functions.columns import NULL_TOKENS, TEXT, is_missing, kind_of, q, stripped


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return read_table(spark, f"{sf_dir}/{name}.parquet", "parquet")


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    schema: T.StructType | str | None = None,
    null_tokens: Iterable[str] | None = None,
) -> DataFrame:
    """Read a table; CSV has a header and, without ``schema``, inferred types.

    A table without columns is an error. Give a schema for large CSV input: inference reads it twice.
    """
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", schema is None)
    df = reader.format(fmt).load(path)
    if not df.columns:
        raise ValueError(f"no columns in {path}")
    return normalize_nulls(df, null_tokens) if null_tokens is not None else df


def normalize_nulls(df: DataFrame, tokens: Iterable[str] = NULL_TOKENS) -> DataFrame:
    """Text columns with the null tokens (after trimming) folded to NULL."""
    tokens = list(tokens)
    return df.select(
        *[
            F.when(~stripped(q(f.name)).isin(tokens), q(f.name)).alias(f.name)
            if kind_of(f.dataType) == TEXT
            else q(f.name)
            for f in df.schema.fields
        ]
    )


def table_info(df: DataFrame) -> DataFrame:
    """Per column: type, null count, whether any null; with the table's row and column counts."""
    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(q(f.name).isNull()).alias(f"__n{i}") for i, f in enumerate(df.schema.fields)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
                F.lit(kind_of(f.dataType)).alias("kind"),
                F.col(f"__n{i}").alias("n_null"),
            )
            for i, f in enumerate(df.schema.fields)
        ]
    )
    return counts.select("n_rows", F.lit(len(df.columns)).cast("long").alias("n_cols"), F.inline(rows)).withColumn(
        "has_nulls", F.col("n_null") > 0
    )


def preview(df: DataFrame, n: int = 5, order_by: Sequence[str] = ()) -> DataFrame:
    """First ``n`` rows (by ``order_by`` when given)."""
    return df.orderBy(*order_by).limit(n) if order_by else df.limit(n)


def sample_rows(
    df: DataFrame, key: Sequence[str], head: int = 3, extra: int = 5, seed: int = 42, rank_by=None
) -> DataFrame:
    """The first ``head`` rows by ``key`` plus ``extra`` others in seeded hash order.

    ``rank_by`` replaces the hash by another ordering expression.
    """
    first = df.orderBy(*key).limit(head)
    order = rank_by if rank_by is not None else F.xxhash64(*key, F.lit(seed))
    rest = df.join(F.broadcast(first.select(*key)), list(key), "left_anti").orderBy(order, *key).limit(extra)
    return first.withColumn("part", F.lit("first")).unionByName(rest.withColumn("part", F.lit("other")))


def dataset_fingerprint(df: DataFrame, portable: bool = False) -> DataFrame:
    """Order-free content fingerprint: row count, sum and xor of row hashes.

    ``portable`` hashes the text form with MD5 (60 bits), which other engines can reproduce.
    """
    h = F.xxhash64(*[q(c) for c in df.columns])
    if portable:
        text = F.concat_ws("|", *[F.coalesce(q(c).cast("string"), F.lit("")) for c in df.columns])
        h = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash_sum"),
        F.bit_xor(h).alias("hash_xor"),
    ).withColumn("n_cols", F.lit(len(df.columns)))


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "error") -> None:
    """Write a result table as Parquet."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


# Metrics where a larger score is better.
HIGHER_IS_BETTER = ("accuracy", "precision", "recall", "f1", "silhouette", "r2")
LOWER_IS_BETTER = ("rmse", "mae", "mse", "mape", "smape", "mase", "log_loss", "davies_bouldin")


def metric_sign(metric: str) -> int:
    """+1 when larger is better, -1 when smaller is; unknown names raise."""
    if metric in HIGHER_IS_BETTER:
        return 1
    if metric in LOWER_IS_BETTER:
        return -1
    raise ValueError(f"unknown metric {metric!r}")


def append_run(runs: DataFrame, path: str) -> None:
    """Append run records to the run table."""
    runs.write.mode("append").parquet(path)


def leaderboard(runs: DataFrame, metric: str, keys: Sequence[str] = ("run_id",), score: str = "score") -> DataFrame:
    """Best model per run under the metric's direction (ties: smallest model name)."""
    sign = metric_sign(metric)
    best = runs.filter(F.col(score).isNotNull()).groupBy(*keys).agg(
        F.min(F.struct((F.col(score) * -sign).alias("s"), F.col("model").alias("m"))).alias("__b"),
        F.count(F.lit(1)).alias("n_models"),
    )
    return best.select(
        *keys, F.col("__b.m").alias("model"), (F.col("__b.s") * -sign).alias("score"), "n_models"
    )
