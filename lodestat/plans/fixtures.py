"""Input frames derived from the given tables, each with the same derivation as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.sources.tables import load

# Columns per table by kind, as the SQL side needs them spelled out.
NUMERIC_COLUMNS = {
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
    "part": ["p_partkey", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_totalprice"],
    "customer": ["c_custkey", "c_nationkey", "c_acctbal"],
}
TEXT_COLUMNS = {
    "part": ["p_name", "p_brand", "p_type"],
    "customer": ["c_name", "c_mktsegment"],
    "orders": ["o_orderstatus", "o_orderpriority"],
    "documents": ["text", "lang", "source"],
}

CUSTOMER_NULLS = """SELECT c_custkey, c_name, c_nationkey,
  CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal,
  CASE c_custkey % 11 WHEN 0 THEN 'N/A' WHEN 1 THEN ' ' WHEN 2 THEN NULL ELSE c_mktsegment END AS c_mktsegment,
  CASE WHEN c_custkey % 10 = 0 THEN 'x' END AS note
FROM customer"""


def customer_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with NULLs by key mod 7, null tokens by key mod 11 and a mostly empty column."""
    k = F.col("c_custkey")
    return load(spark, sf, "customer").select(
        "c_custkey",
        "c_name",
        "c_nationkey",
        F.when(k % 7 != 0, F.col("c_acctbal")).alias("c_acctbal"),
        F.when(k % 11 == 0, "N/A")
        .when(k % 11 == 1, " ")
        .when(k % 11 == 2, None)
        .otherwise(F.col("c_mktsegment"))
        .alias("c_mktsegment"),
        F.when(k % 10 == 0, "x").alias("note"),
    )


ORDERS_DAILY = """SELECT o_orderpriority AS series, o_orderdate AS ts,
  CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS y
FROM orders GROUP BY 1, 2"""


def orders_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Daily order value per priority: five long, almost regular series."""
    return (
        load(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("series"), F.col("o_orderdate").alias("ts"))
        .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("y"))
    )


ORDERS_MONTHLY = """SELECT o_orderpriority AS series, date_trunc('month', o_orderdate)::TIMESTAMP AS ts,
  CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS y
FROM orders GROUP BY 1, 2"""


def orders_monthly(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly order value per priority."""
    month = F.date_trunc("month", F.col("o_orderdate")).cast("timestamp_ntz")
    return (
        load(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("series"), month.alias("ts"))
        .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("y"))
    )


EVENTS_HOURLY = """SELECT event_type AS series, date_trunc('hour', ts)::TIMESTAMP AS ts,
  CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS y
FROM events GROUP BY 1, 2"""


def events_hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly mean event value per type, with missing hours."""
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")
    return (
        load(spark, sf, "events")
        .groupBy(F.col("event_type").alias("series"), hour.alias("ts"))
        .agg((F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("y"))
    )


EVENTS_HOURLY_NULLS = f"""SELECT series, ts,
  CASE WHEN epoch(ts)::BIGINT // 3600 % 7 <> 0 THEN y END AS y FROM ({EVENTS_HOURLY})"""


def events_hourly_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly series with every seventh hour's value missing."""
    hours = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)
    return events_hourly(spark, sf).withColumn("y", F.when(hours % 7 != 0, F.col("y")))


PREDICTIONS = """SELECT o_orderkey AS id, o_orderpriority AS grp, o_orderdate AS ts, o_totalprice AS y,
  o_totalprice + (o_orderkey % 5 - 2) * 1000.0 AS p FROM orders"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Regression truth and a deterministic shift of it."""
    o = load(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("grp"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_totalprice").alias("y"),
        (F.col("o_totalprice") + (F.col("o_orderkey") % 5 - 2) * 1000.0).alias("p"),
    )


CLASS_PREDICTIONS = """SELECT o_orderkey AS id, o_orderstatus AS y,
  CASE WHEN o_orderkey % 5 = 0 THEN 'F' WHEN o_orderkey % 5 = 1 THEN 'O' ELSE o_orderstatus END AS p FROM orders"""


def class_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Class truth with two of five labels overwritten."""
    k = F.col("o_orderkey")
    return load(spark, sf, "orders").select(
        k.alias("id"),
        F.col("o_orderstatus").alias("y"),
        F.when(k % 5 == 0, "F").when(k % 5 == 1, "O").otherwise(F.col("o_orderstatus")).alias("p"),
    )


SERIES_PREDICTIONS = f"""SELECT series, ts, y AS a,
  y * (1 + (epoch(ts)::BIGINT // 86400 % 5 - 2) * 0.05) AS f FROM ({ORDERS_DAILY})"""


def series_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Daily actuals and a forecast that wobbles around them."""
    day = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400)
    return orders_daily(spark, sf).select(
        "series", "ts", F.col("y").alias("a"), (F.col("y") * (1 + (day % 5 - 2) * 0.05)).alias("f")
    )
