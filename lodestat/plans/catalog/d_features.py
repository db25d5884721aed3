"""Queries D1-D18."""

from pyspark.sql import functions as F

from lodestat.functions.columns import rounded
from lodestat.operators import features as X
from lodestat.plans.fixtures import CUSTOMER_NULLS, ORDERS_DAILY, customer_nulls, orders_daily
from lodestat.plans.registry import query
from lodestat.sources.tables import load


@query("d1_select_features", "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem")
def d1(spark, sf):
    return X.select_features(
        load(spark, sf, "lineitem"),
        "l_extendedprice",
        ["l_partkey", "l_suppkey", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    )


@query(
    "d2_class_weights",
    """WITH c AS (SELECT quality, COUNT(*) AS c FROM labels GROUP BY 1)
    SELECT doc_id, l.quality, round((SELECT sum(c) FROM c) / ((SELECT COUNT(*) FROM c) * c.c), 6) AS weight FROM labels l JOIN c ON c.quality = l.quality""",
)
def d2(spark, sf):
    return rounded(X.class_weights(load(spark, sf, "labels"), "quality").drop("toxic"), 6)


@query(
    "d3_impute_numeric",
    f"""WITH t AS ({CUSTOMER_NULLS}) SELECT c_custkey, round(coalesce(c_acctbal, (SELECT quantile_cont(c_acctbal, 0.5) FROM t)), 4) AS c_acctbal FROM t""",
)
def d3(spark, sf):
    return rounded(X.impute_numeric(customer_nulls(spark, sf), ["c_acctbal"]).select("c_custkey", "c_acctbal"))


@query(
    "d4_impute_mode",
    f"""WITH t AS ({CUSTOMER_NULLS}) SELECT c_custkey,
      coalesce(c_mktsegment, (SELECT c_mktsegment FROM t WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1)) AS c_mktsegment, coalesce(note, 'x') AS note FROM t""",
)
def d4(spark, sf):
    return X.impute_mode(customer_nulls(spark, sf), ["c_mktsegment", "note"]).select("c_custkey", "c_mktsegment", "note")


SCALED = ["p_size", "p_retailprice"]


def part(spark, sf):
    return load(spark, sf, "part").select("p_partkey", *SCALED)


def scaled_sql(template: str) -> str:
    cells = ", ".join(f"round({template.format(c=c)}, 6) + 0.0 AS {c}" for c in SCALED)
    quant = ", ".join(
        f"quantile_cont(CAST({c} AS DOUBLE), 0.25) AS {c}_q1, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS {c}_q2, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS {c}_q3, "
        f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s, min({c}) AS {c}_lo, max({c}) AS {c}_hi"
        for c in SCALED
    )
    return f"SELECT p_partkey, {cells} FROM part, (SELECT {quant} FROM part)"


@query("d5_scale_standard", scaled_sql("({c} - {c}_m) / {c}_s"))
def d5(spark, sf):
    return rounded(X.scale_standard(part(spark, sf), SCALED), 6)


@query("d6_scale_minmax", scaled_sql("({c} - {c}_lo) / ({c}_hi - {c}_lo)"))
def d6(spark, sf):
    return rounded(X.scale_minmax(part(spark, sf), SCALED), 6)


@query("d7_scale_robust", scaled_sql("({c} - {c}_q2) / ({c}_q3 - {c}_q1)"))
def d7(spark, sf):
    return rounded(X.scale_robust(part(spark, sf), SCALED), 6)


@query(
    "d8_one_hot",
    "SELECT o_orderkey, "
    + ", ".join(f"CAST(o_orderstatus = '{v}' AS INT) AS o_orderstatus_{v}" for v in "FOP")
    + " FROM orders",
)
def d8(spark, sf):
    return X.one_hot(load(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"])


@query(
    "d9_target_encode",
    "SELECT p_partkey, part.p_brand, round(m, 6) AS p_brand_target FROM part JOIN (SELECT p_brand, avg(p_retailprice) AS m FROM part GROUP BY 1) e ON e.p_brand = part.p_brand",
)
def d9(spark, sf):
    df = load(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    return rounded(X.target_encode(df, "p_brand", "p_retailprice").drop("p_retailprice"), 6)


@query(
    "d10_frequency_encode",
    "SELECT p_partkey, p_name, round(COUNT(*) OVER (PARTITION BY p_name) / COUNT(*) OVER (), 8) AS p_name_freq FROM part",
)
def d10(spark, sf):
    return rounded(X.frequency_encode(load(spark, sf, "part").select("p_partkey", "p_name"), "p_name"), 8)


@query("d11_label_encode", "SELECT p_partkey, p_name, dense_rank() OVER (ORDER BY p_name) - 1 AS p_name_code FROM part")
def d11(spark, sf):
    return X.label_encode(load(spark, sf, "part").select("p_partkey", "p_name"), "p_name")


@query("d11_label_encode_wide", "SELECT c_custkey, c_name, dense_rank() OVER (ORDER BY c_name) - 1 AS c_name_code FROM customer")
def d11_wide(spark, sf):
    return X.label_encode(load(spark, sf, "customer").select("c_custkey", "c_name"), "c_name")


K_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
ANOVA = (
    "SELECT '{c}' AS column_name, (sum(n * (m - g) ** 2) / (COUNT(*) - 1)) / (sum(n * s2) / (sum(n) - COUNT(*))) AS f_score "
    "FROM (SELECT l_returnflag, COUNT(*) AS n, avg({c}) AS m, var_pop({c}) AS s2 FROM lineitem GROUP BY 1), (SELECT avg({c}) AS g FROM lineitem)"
)
REGRESSION = "SELECT '{c}' AS column_name, corr({c}, l_extendedprice) ** 2 * (COUNT(*) - 2) / (1 - corr({c}, l_extendedprice) ** 2) AS f_score FROM lineitem"


def ranked_sql(template: str, columns, k: int) -> str:
    rows = " UNION ALL ".join(template.format(c=c) for c in columns)
    return f"""SELECT column_name, round(f_score, 5) AS f_score, CAST(row_number() OVER (ORDER BY f_score DESC, column_name) AS INT) AS rank,
      row_number() OVER (ORDER BY f_score DESC, column_name) <= {k} AS selected FROM ({rows})"""


@query("d12_select_k_best_classification", ranked_sql(ANOVA, K_COLUMNS, 2))
def d12(spark, sf):
    return rounded(X.select_k_best(load(spark, sf, "lineitem"), "l_returnflag", 2, "classification", K_COLUMNS), 5)


K_OTHERS = [c for c in K_COLUMNS if c != "l_extendedprice"]


@query("d12_select_k_best_regression", ranked_sql(REGRESSION, K_OTHERS, 3))
def d12_regression(spark, sf):
    return rounded(X.select_k_best(load(spark, sf, "lineitem"), "l_extendedprice", 3, "regression", K_OTHERS), 5)


@query(
    "d13_pca_reduce",
    """WITH e AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
    v AS (SELECT var_samp(x::DOUBLE) AS v FROM e GROUP BY i)
    SELECT round(sum(v), 4) AS total_variance, CAST(count(*) AS INT) AS components, 0.0 AS largest_correlation, 0.0 AS largest_mean, true AS descending FROM v""",
)
def d13(spark, sf):
    """All components of the vectors: their variances add up to that of the columns, and they do not correlate."""
    from pyspark.ml.functions import vector_to_array

    out = X.pca_reduce(load(spark, sf, "embeddings"), "embedding", 64)
    return component_checks(out.select(vector_to_array("pca").alias("c")), 64)


def component_checks(rows, k):
    """Of all components: the sum of variances, the largest mean and correlation with the next one, and whether variances descend."""
    cells = rows.select(F.posexplode(F.zip_with("c", F.slice("c", 2, k), lambda x, y: F.struct(x.alias("x"), y.alias("y"))))).select("pos", "col.*")
    each = cells.groupBy("pos").agg(F.var_samp("x").alias("v"), F.abs(F.avg("x")).alias("m"), F.corr("x", "y").alias("r"))
    listed = F.array_sort(F.collect_list(F.struct("pos", "v")))
    found = each.agg(F.sum("v").alias("v"), F.max("m").alias("m"), F.max(F.abs("r")).alias("r"), listed.alias("l"))
    ordered = F.transform("l", lambda e: e["v"])
    return found.select(
        F.round("v", 4).alias("total_variance"), F.lit(k).alias("components"), F.round("r", 4).alias("largest_correlation"), F.round("m", 4).alias("largest_mean"),
        (F.reverse(F.array_sort(ordered)) == ordered).alias("descending"),
    )


@query("d13_pca_reduce_rows")
def d13_rows(spark, sf):
    from pyspark.ml.functions import vector_to_array

    out = X.pca_reduce(load(spark, sf, "embeddings"), "embedding", 50)
    return out.select("vec_id", vector_to_array("pca").alias("pca"))


@query(
    "d14_clip_outliers",
    """SELECT event_id, round(greatest(least(value, q3 + 1.5 * (q3 - q1)), q1 - 1.5 * (q3 - q1)), 4) AS value
    FROM events, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)""",
)
def d14(spark, sf):
    return rounded(X.clip_outliers(load(spark, sf, "events").select("event_id", "value"), ["value"]))


@query("d15_log_transform_target", "SELECT event_id, round(ln(1 + value), 8) AS value_log FROM events")
def d15(spark, sf):
    return rounded(X.log_transform_target(load(spark, sf, "events").select("event_id", "value"), "value").drop("value"), 8)


@query(
    "d16_split_random_keyed",
    "SELECT o_orderkey, o_orderkey * 7919 % 1000003 < 200000 AS is_test FROM orders",
)
def d16_keyed(spark, sf):
    out = X.split_random(load(spark, sf, "orders"), ["o_orderkey"], 0.2, order=F.col("o_orderkey") * 7919)
    return out.select("o_orderkey", "is_test")


@query(
    "d16_split_stratified_keyed",
    """WITH h AS (SELECT o_orderkey, o_orderstatus, CAST(o_orderkey * 7919 % 10007 AS DOUBLE) AS h FROM orders), c AS (SELECT o_orderstatus, quantile_cont(h, 0.2) AS cut FROM h GROUP BY 1)
    SELECT o_orderkey, h < cut AS is_test FROM h JOIN c USING (o_orderstatus)""",
)
def d16_stratified_keyed(spark, sf):
    out = X.split_random(
        load(spark, sf, "orders"), ["o_orderkey"], 0.2, stratify="o_orderstatus", order=F.col("o_orderkey") * 7919 % 10007
    )
    return out.select("o_orderkey", "is_test")


@query("d16_split_random")
def d16(spark, sf):
    out = X.split_random(load(spark, sf, "orders"), ["o_orderkey"], seed=7)
    return out.groupBy("is_test").agg(F.count(F.lit(1)).alias("n"))


@query("d16_split_stratified")
def d16_stratified(spark, sf):
    out = X.split_random(load(spark, sf, "orders"), ["o_orderkey"], 0.2, 7, "o_orderstatus")
    return out.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("is_test").cast("double")).alias("share"))


@query(
    "d17_split_temporal",
    f"""SELECT series, CAST(ts AS VARCHAR) AS ts, y, row_number() OVER w - 1 >= floor(COUNT(*) OVER (PARTITION BY series) * 0.8) AS is_test
    FROM ({ORDERS_DAILY}) t WINDOW w AS (PARTITION BY series ORDER BY t.ts)""",
)
def d17(spark, sf):
    return X.split_temporal(orders_daily(spark, sf), ["series"]).withColumn("ts", F.col("ts").cast("string"))


@query(
    "d18_check_class_counts",
    """SELECT COUNT(*) AS n_classes, min(c) AS smallest_class, CAST(sum(c) AS BIGINT) AS n_rows, min(c) >= 5 AND sum(c) >= 100 AS stratify,
    CASE WHEN min(c) < 2 THEN 'error' WHEN sum(c) < 200 AND min(c) < 10 THEN 'warning' ELSE 'ok' END AS verdict
    FROM (SELECT quality, COUNT(*) AS c FROM labels GROUP BY 1)""",
)
def d18(spark, sf):
    return X.check_class_counts(load(spark, sf, "labels"), "quality")
