"""Queries A1-A8 and B1-B15."""

from pyspark.sql import functions as F

from lodestat.functions.columns import NULL_TOKENS, rounded
from lodestat.operators import profile as P
from lodestat.plans.fixtures import CUSTOMER_NULLS, NUMERIC_COLUMNS, TEXT_COLUMNS, customer_nulls
from lodestat.plans.registry import query
from lodestat.session import scratch_path
from lodestat.sources import tables as S

TOKENS = ", ".join(f"'{t}'" for t in NULL_TOKENS)


def each(columns, template: str) -> str:
    """UNION ALL of a template over columns."""
    return "\nUNION ALL\n".join(template.format(c=c) for c in columns)


@query(
    "a1_read_table",
    """SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty
    FROM lineitem GROUP BY 1, 2""",
)
def a1(spark, sf):
    df = S.read_table(spark, f"{sf}/lineitem.parquet", "parquet")
    return df.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("sum_qty")
    )


@query(
    "a2_normalize_nulls",
    f"""SELECT c_custkey, c_acctbal,
      CASE WHEN trim(c_mktsegment) NOT IN ({TOKENS}) THEN c_mktsegment END AS c_mktsegment, note
    FROM ({CUSTOMER_NULLS})""",
)
def a2(spark, sf):
    return S.normalize_nulls(customer_nulls(spark, sf).select("c_custkey", "c_acctbal", "c_mktsegment", "note"))


@query(
    "a3_table_info",
    "WITH t AS (" + CUSTOMER_NULLS + ") "
    + each(
        [("c_custkey", "bigint"), ("c_acctbal", "double"), ("c_mktsegment", "string"), ("note", "string")],
        "SELECT '{c[0]}' AS column_name, '{c[1]}' AS data_type, COUNT(*) AS n_rows, CAST(4 AS BIGINT) AS n_cols, "
        "COUNT(*) - COUNT({c[0]}) AS n_null, COUNT(*) > COUNT({c[0]}) AS has_nulls FROM t",
    ),
)
def a3(spark, sf):
    return S.table_info(customer_nulls(spark, sf).select("c_custkey", "c_acctbal", "c_mktsegment", "note")).drop("kind")


@query("a4_preview", "SELECT * EXCLUDE (o_orderdate) FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def a4(spark, sf):
    return S.preview(S.load(spark, sf, "orders"), 5, [F.desc("o_totalprice"), "o_orderkey"]).drop("o_orderdate")


@query(
    "a5_sample_rows",
    """WITH f AS (SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 3)
    SELECT *, 'first' AS part FROM f UNION ALL
    SELECT * FROM (SELECT c_custkey, c_name, 'other' AS part FROM customer
      WHERE c_custkey NOT IN (SELECT c_custkey FROM f) ORDER BY c_custkey * 7919 % 10007, c_custkey LIMIT 5)""",
)
def a5(spark, sf):
    df = S.load(spark, sf, "customer").select("c_custkey", "c_name")
    return S.sample_rows(df, ["c_custkey"], rank_by=F.col("c_custkey") * 7919 % 10007)


@query("a6_dataset_fingerprint")
def a6(spark, sf):
    return S.dataset_fingerprint(S.load(spark, sf, "lineitem"))


@query(
    "a6_dataset_fingerprint_portable",
    """WITH h AS (SELECT CAST('0x' || substr(md5(o_orderkey || '|' || o_custkey || '|' || o_orderstatus || '|' || o_orderpriority), 1, 15) AS BIGINT) AS h FROM orders)
    SELECT COUNT(*) AS n_rows, CAST(sum(CAST(h AS HUGEINT)) AS VARCHAR) AS hash_sum, bit_xor(h) AS hash_xor, 4 AS n_cols FROM h""",
)
def a6_portable(spark, sf):
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    return S.dataset_fingerprint(S.load(spark, sf, "orders").select(*cols), portable=True)


@query(
    "a7_write_table",
    "SELECT p_brand, COUNT(*) AS n, MIN(p_retailprice) AS lo, MAX(p_retailprice) AS hi FROM part GROUP BY 1",
)
def a7(spark, sf):
    path = scratch_path(spark, "part")
    S.write_table(S.load(spark, sf, "part"), path)
    return (
        S.read_table(spark, path, "parquet")
        .groupBy("p_brand")
        .agg(F.count(F.lit(1)).alias("n"), F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    )


@query(
    "a8_leaderboard",
    """WITH runs AS (SELECT o_orderpriority AS run_id, o_orderstatus AS model, stddev_samp(o_totalprice) AS score
      FROM orders GROUP BY 1, 2)
    SELECT run_id, arg_min(model, score) AS model, round(min(score), 2) AS score, COUNT(*) AS n_models
    FROM runs GROUP BY 1""",
)
def a8(spark, sf):
    runs = (
        S.load(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("run_id"), F.col("o_orderstatus").alias("model"))
        .agg(F.stddev_samp("o_totalprice").alias("score"))
    )
    path = scratch_path(spark, "runs")
    S.append_run(runs, path)
    return rounded(S.leaderboard(S.read_table(spark, path, "parquet", runs.schema), "rmse"), 2)


NULLS_ALL = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "note"]
NULL_TEST = "({c} IS NULL OR trim(CAST({c} AS VARCHAR)) IN (" + TOKENS + "))"


@query(
    "b1_null_profile",
    "WITH t AS (" + CUSTOMER_NULLS + ") SELECT column_name, n_rows, n_null, "
    "round(n_null / n_rows, 6) AS fraction_null, n_null > 0 AS has_nulls, n_null / n_rows > 0.5 AS high_null_rate FROM ("
    + each(
        NULLS_ALL,
        "SELECT '{c}' AS column_name, COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE " + NULL_TEST + ") AS n_null FROM t",
    )
    + ")",
)
def b1(spark, sf):
    return rounded(P.null_profile(customer_nulls(spark, sf)), 6)


B2_COLUMNS = ["l_partkey", "l_linenumber", "l_returnflag", "l_linestatus"]


@query(
    "b2_value_counts_long",
    each(
        B2_COLUMNS,
        "SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, COUNT(*) AS count FROM lineitem GROUP BY 2",
    ),
)
def b2(spark, sf):
    return P.value_counts_long(S.load(spark, sf, "lineitem"), B2_COLUMNS)


UNIQUES = (
    "SELECT '{c}' AS column_name, COUNT(*) AS n_rows, COUNT(DISTINCT {c}) AS n_unique, "
    "COUNT(DISTINCT {c}) + CAST(COUNT(*) > COUNT({c}) AS BIGINT) AS n_unique_including_null, "
    "COUNT(*) FILTER (WHERE " + NULL_TEST + ") AS n_null FROM t"
)


@query(
    "b3_distinct_profile",
    "WITH t AS (" + CUSTOMER_NULLS + ") SELECT column_name, n_rows, n_unique, n_unique_including_null, "
    "n_unique = n_rows AND n_rows > 1 AND n_null = 0 AS is_unique_id FROM (" + each(NULLS_ALL, UNIQUES) + ")",
)
def b3(spark, sf):
    return P.distinct_profile(customer_nulls(spark, sf))


@query("b3_distinct_profile_approx")
def b3_approx(spark, sf):
    return P.distinct_profile(S.load(spark, sf, "lineitem"), approx=True)


LINEITEM_ALL = NUMERIC_COLUMNS["lineitem"] + ["l_returnflag", "l_linestatus", "l_shipdate"]


@query(
    "b4_cardinality_flags",
    "SELECT column_name, n_rows, n_unique, n_unique <= 1 AS is_constant, n_unique = 2 AS is_binary, "
    "n_unique < least(50, n_rows * 0.1) AS is_categorical FROM ("
    + each(
        LINEITEM_ALL,
        "SELECT '{c}' AS column_name, COUNT(*) AS n_rows, COUNT(DISTINCT {c}) AS n_unique FROM lineitem",
    )
    + ")",
)
def b4(spark, sf):
    return P.cardinality_flags(S.load(spark, sf, "lineitem"))


B5 = (
    "SELECT '{c}' AS column_name, COUNT({c}) AS n, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
    "round(avg({c}), 3) AS mean, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 3) AS median, "
    "round(stddev_samp({c}), 3) AS std, round(skewness({c}), 4) AS skew, round(kurtosis({c}), 4) AS kurtosis FROM t"
)


@query("b5_numeric_summary", "WITH t AS (SELECT * FROM lineitem) " + each(NUMERIC_COLUMNS["lineitem"], B5))
def b5(spark, sf):
    return rounded(P.numeric_summary(S.load(spark, sf, "lineitem")), 3, skew=4, kurtosis=4)


@query(
    "b5_numeric_summary_nulls",
    "WITH t AS (" + CUSTOMER_NULLS + ") " + each(["c_custkey", "c_nationkey", "c_acctbal"], B5),
)
def b5_nulls(spark, sf):
    return rounded(P.numeric_summary(customer_nulls(spark, sf)), 3, skew=4, kurtosis=4)


@query(
    "b6_numeric_sign_counts",
    each(
        NUMERIC_COLUMNS["lineitem"],
        "SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} = 0) AS zero_count, "
        "COUNT(*) FILTER (WHERE {c} < 0) AS negative_count, COUNT(*) FILTER (WHERE {c} = 0) > 0 AS has_zero_values FROM lineitem",
    ),
)
def b6(spark, sf):
    return P.numeric_sign_counts(S.load(spark, sf, "lineitem"))


@query(
    "b7_unique_values_head",
    "SELECT column_name, CAST(v AS DOUBLE) AS v, r FROM ("
    + each(
        NUMERIC_COLUMNS["lineitem"],
        "SELECT '{c}' AS column_name, v, row_number() OVER (ORDER BY v) - 1 AS r FROM (SELECT DISTINCT {c} AS v FROM lineitem)",
    )
    + ") WHERE r < 20",
)
def b7(spark, sf):
    return P.unique_values_head(S.load(spark, sf, "lineitem")).select(
        "column_name", F.posexplode("unique_values").alias("r", "v")
    ).withColumn("r", F.col("r").cast("long"))


@query(
    "b8_likely_categorical_numeric",
    "SELECT column_name, n_unique, all_integral, n_unique <= 20 AND all_integral AND lo >= 0 AND hi < 100 "
    "AS likely_categorical_numeric FROM ("
    + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, COUNT(DISTINCT {c}) AS n_unique, bool_and({c} = floor({c})) AS all_integral, "
        f"min({c}) AS lo, max({c}) AS hi FROM {t}"
        for t in ("part", "lineitem")
        for c in NUMERIC_COLUMNS[t]
    )
    + ")",
)
def b8(spark, sf):
    return P.likely_categorical_numeric(S.load(spark, sf, "part")).unionByName(
        P.likely_categorical_numeric(S.load(spark, sf, "lineitem"))
    )


B9 = (
    "SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS v, q1, q3, n FROM t, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, "
    "quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3, COUNT({c}) AS n FROM t) WHERE {c} IS NOT NULL"
)


@query(
    "b9_iqr_outliers",
    "WITH t AS (SELECT p_size, p_retailprice, value FROM part CROSS JOIN (SELECT 1) x LEFT JOIN events ON event_id = p_partkey) "
    "SELECT column_name, n, round(q1, 4) AS q1, round(q3, 4) AS q3, round(q1 - 1.5 * (q3 - q1), 4) AS lower_bound, "
    "round(q3 + 1.5 * (q3 - q1), 4) AS upper_bound, "
    "COUNT(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outlier_count, "
    "round(COUNT(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) / n, 6) AS outlier_fraction FROM ("
    + each(["p_size", "p_retailprice", "value"], B9)
    + ") GROUP BY column_name, n, q1, q3",
)
def b9(spark, sf):
    part, events = S.load(spark, sf, "part"), S.load(spark, sf, "events")
    df = part.join(events, F.col("event_id") == F.col("p_partkey"), "left").select("p_size", "p_retailprice", "value")
    return rounded(P.iqr_outliers(df), 4, outlier_fraction=6)


@query(
    "b10_top_values",
    "SELECT column_name, value, count, rank FROM ("
    + each(
        TEXT_COLUMNS["part"],
        "SELECT '{c}' AS column_name, {c} AS value, COUNT(*) AS count, "
        "row_number() OVER (ORDER BY COUNT(*) DESC, {c}) AS rank FROM part GROUP BY {c}",
    )
    + ") WHERE rank <= 20",
)
def b10(spark, sf):
    return P.top_values(S.load(spark, sf, "part")).withColumn("rank", F.col("rank").cast("long"))


@query(
    "b11_string_lengths",
    each(
        TEXT_COLUMNS["documents"],
        "SELECT '{c}' AS column_name, round(avg(length({c})), 4) AS avg_string_length, max(length({c})) AS max_string_length, "
        "min(length({c})) AS min_string_length FROM documents",
    ),
)
def b11(spark, sf):
    return rounded(P.string_lengths(S.load(spark, sf, "documents")), 4)


B12 = (
    "SELECT '{c}' AS column_name, COUNT(DISTINCT {c}) < COUNT(*) * 0.1 AND avg(length({c})) < 50 AS likely_categorical, "
    "avg(length({c})) > 50 OR max(length({c})) > 200 AS likely_free_text, "
    "bool_or(regexp_matches({c}, '[a-z]')) AND bool_or(regexp_matches({c}, '[A-Z]')) AS has_mixed_case, "
    "bool_or(regexp_matches({c}, '[0-9]')) AS has_numbers, "
    "bool_or(regexp_matches({c}, '[^a-zA-Z0-9\\s]')) AS has_special_chars, "
    "COUNT(DISTINCT {c}) = COUNT(*) AND COUNT(*) > 1 AND COUNT(*) FILTER (WHERE " + NULL_TEST + ") = 0 AS likely_id_column "
)


@query(
    "b12_text_shape_flags",
    each(TEXT_COLUMNS["documents"], B12 + "FROM documents")
    + "\nUNION ALL\n"
    + each(TEXT_COLUMNS["customer"], B12 + "FROM customer"),
)
def b12(spark, sf):
    return P.text_shape_flags(S.load(spark, sf, "documents")).unionByName(
        P.text_shape_flags(S.load(spark, sf, "customer"))
    )


def date_label(table: str, c: str) -> str:
    return f"""(SELECT CASE WHEN d = 1 THEN 'daily' WHEN d BETWEEN 6 AND 8 THEN 'weekly' WHEN d BETWEEN 28 AND 32 THEN 'monthly'
      WHEN d BETWEEN 89 AND 92 THEN 'quarterly' WHEN d BETWEEN 360 AND 370 THEN 'yearly' ELSE 'custom_' || d || '_days' END
      FROM (SELECT g // 86400000000 AS d FROM (SELECT epoch_us({c}) - lag(epoch_us({c})) OVER (ORDER BY {c}) AS g FROM {table})
      WHERE g IS NOT NULL GROUP BY g ORDER BY COUNT(*) DESC, g LIMIT 1))"""


def date_row(table: str, c: str) -> str:
    return f"""SELECT '{c}' AS column_name, CAST(min({c}) AS VARCHAR) AS min_date, CAST(max({c}) AS VARCHAR) AS max_date,
      (epoch_us(max({c})) - epoch_us(min({c}))) // 86400000000 AS date_range_days,
      max({c}) > TIMESTAMP '2000-01-01' AS has_future_dates, {date_label(table, c)} AS date_frequency FROM {table}"""


@query(
    "b13_datetime_summary",
    "\nUNION ALL\n".join(
        [
            date_row("lineitem", "l_shipdate"),
            date_row("events", "ts"),
            date_row("(SELECT DISTINCT o_orderdate AS day FROM orders)", "day"),
        ]
    ),
)
def b13(spark, sf):
    out = None
    for df in (
        S.load(spark, sf, "lineitem"),
        S.load(spark, sf, "events"),
        S.load(spark, sf, "orders").select(F.col("o_orderdate").alias("day")).distinct(),
    ):
        part = P.datetime_summary(df, "2000-01-01 00:00:00")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("min_date", F.col("min_date").cast("string")).withColumn(
        "max_date", F.col("max_date").cast("string")
    )


BOOLS = "SELECT l_discount > 0.05 AS discounted, CASE WHEN l_orderkey % 7 <> 0 THEN l_returnflag = 'R' END AS returned FROM lineitem"


@query(
    "b14_boolean_summary",
    f"WITH t AS ({BOOLS}) "
    + each(
        ["discounted", "returned"],
        "SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c}) AS true_count, COUNT(*) FILTER (WHERE NOT {c}) AS false_count, "
        "round(COUNT(*) FILTER (WHERE {c}) / COUNT({c}), 6) AS true_fraction FROM t",
    ),
)
def b14(spark, sf):
    df = S.load(spark, sf, "lineitem").select(
        (F.col("l_discount") > 0.05).alias("discounted"),
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_returnflag") == "R").alias("returned"),
    )
    return rounded(P.boolean_summary(df), 6)


def profile_sql(table: str, numeric, text, dates) -> str:
    """Profile rows with all fields; lists and maps as text."""
    fields = {
        "min": ("DOUBLE", "min(x)"), "max": ("DOUBLE", "max(x)"), "mean": ("DOUBLE", "round(avg(x), 3)"),
        "median": ("DOUBLE", "round(quantile_cont(x, 0.5), 3)"), "std": ("DOUBLE", "round(stddev_samp(x), 3)"),
        "skew": ("DOUBLE", "round(skewness(x), 4)"), "kurtosis": ("DOUBLE", "round(kurtosis(x), 4)"),
        "q1": ("DOUBLE", "round(quantile_cont(x, 0.25), 3)"), "q3": ("DOUBLE", "round(quantile_cont(x, 0.75), 3)"),
        "lower_bound": ("DOUBLE", "round(2.5 * quantile_cont(x, 0.25) - 1.5 * quantile_cont(x, 0.75), 3)"),
        "upper_bound": ("DOUBLE", "round(2.5 * quantile_cont(x, 0.75) - 1.5 * quantile_cont(x, 0.25), 3)"),
        "outlier_count": ("BIGINT", "(SELECT COUNT(*) FILTER (WHERE x < a - 1.5 * (b - a) OR x > b + 1.5 * (b - a)) FROM {src}, (SELECT quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM {src}))"),
        "zero_count": ("BIGINT", "COUNT(*) FILTER (WHERE x = 0)"), "negative_count": ("BIGINT", "COUNT(*) FILTER (WHERE x < 0)"),
        "has_zero_values": ("BOOLEAN", "COUNT(*) FILTER (WHERE x = 0) > 0"), "all_integral": ("BOOLEAN", "bool_and(x = floor(x))"),
        "likely_categorical_numeric": ("BOOLEAN", "COUNT(DISTINCT x) <= 20 AND bool_and(x = floor(x)) AND min(x) >= 0 AND max(x) < 100"),
        "unique_values": ("VARCHAR", "(SELECT string_agg(CAST(CAST(round(x * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY x) FROM (SELECT DISTINCT x FROM {src} WHERE x IS NOT NULL ORDER BY x LIMIT 20))"),
    }
    texts = {
        "avg_string_length": ("DOUBLE", "round(avg(length(s)), 4)"), "max_string_length": ("BIGINT", "max(length(s))"), "min_string_length": ("BIGINT", "min(length(s))"),
        "likely_categorical": ("BOOLEAN", "COUNT(DISTINCT s) < COUNT(*) * 0.1 AND avg(length(s)) < 50"), "likely_free_text": ("BOOLEAN", "avg(length(s)) > 50 OR max(length(s)) > 200"),
        "has_mixed_case": ("BOOLEAN", "bool_or(regexp_matches(s, '[a-z]')) AND bool_or(regexp_matches(s, '[A-Z]'))"), "has_numbers": ("BOOLEAN", "bool_or(regexp_matches(s, '[0-9]'))"),
        "has_special_chars": ("BOOLEAN", "bool_or(regexp_matches(s, '[^a-zA-Z0-9\\s]'))"), "likely_id_column": ("BOOLEAN", "COUNT(DISTINCT s) = COUNT(*) AND COUNT(*) > 1 AND COUNT(*) FILTER (WHERE bad) = 0"),
        "top_values": ("VARCHAR", "(SELECT string_agg(s || '=' || n, ',' ORDER BY n DESC, s) FROM (SELECT s, COUNT(*) AS n FROM {src} WHERE s IS NOT NULL GROUP BY s ORDER BY n DESC, s LIMIT 20))"),
    }
    times = {
        "min_date": ("VARCHAR", "CAST(min(d) AS VARCHAR)"), "max_date": ("VARCHAR", "CAST(max(d) AS VARCHAR)"), "date_range_days": ("BIGINT", "(epoch_us(max(d)) - epoch_us(min(d))) // 86400000000"),
        "has_future_dates": ("BOOLEAN", "max(d) > TIMESTAMP '2000-01-01'"), "date_frequency": ("VARCHAR", "{label}"),
    }
    booleans = {"true_count": "BIGINT", "false_count": "BIGINT", "true_fraction": "DOUBLE"}
    parts = []
    for position, c in enumerate([*numeric, *text, *dates]):
        kind = "numeric" if c in numeric else "text" if c in text else "datetime"
        short = {"numeric": "x", "text": "s", "datetime": "d"}[kind]
        src = f"(SELECT {'CAST(' + c + ' AS DOUBLE)' if kind == 'numeric' else c} AS {short}, {NULL_TEST.format(c=c)} AS bad FROM {table})"
        own = {"numeric": fields, "text": texts, "datetime": times}[kind]
        cells = [
            f"{e.format(src=src, label=date_label(table, c)) if name in own else f'CAST(NULL AS {t})'} AS {name}"
            for group in (fields, texts, times) for name, (t, e) in group.items()
        ]
        cells += [f"CAST(NULL AS {t}) AS {name}" for name, t in booleans.items()]
        u, n = f"COUNT(DISTINCT {short})", "COUNT(*)"
        parts.append(
            f"SELECT '{c}' AS column_name, '{kind}' AS kind, {n} AS n_rows, COUNT(*) FILTER (WHERE bad) AS n_null, {n} - COUNT({short}) AS n_raw_null, "
            f"COUNT(*) FILTER (WHERE bad) / {n} AS fraction_null, COUNT(*) FILTER (WHERE bad) > 0 AS has_nulls, COUNT(*) FILTER (WHERE bad) > 0.5 * {n} AS high_null_rate, "
            f"{u} AS n_unique, {u} + CAST({n} > COUNT({short}) AS BIGINT) AS n_unique_including_null, {u} = {n} AND {n} > 1 AND COUNT(*) FILTER (WHERE bad) = 0 AS is_unique_id, "
            f"{u} <= 1 AS is_constant, {u} = 2 AS is_binary, {u} < least(50, {n} * 0.1) AS is_categorical, {', '.join(cells)} FROM {src}"
        )
    return "SELECT *, CASE WHEN kind = 'numeric' THEN round(outlier_count / n_rows, 6) END AS outlier_fraction FROM (" + "\nUNION ALL\n".join(parts) + ")"


def profile_rows(df):
    """The profile without positions, as the SQL has it."""
    hundredths = F.transform("unique_values", lambda v: F.round(v * 100).cast("long").cast("string"))
    tops = F.transform(F.map_entries("top_values"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    out = P.profile_table(df, "2000-01-01 00:00:00").drop("position").withColumns(
        {
            "unique_values": F.array_join(hundredths, ","), "top_values": F.array_join(tops, ","),
            "min_date": F.col("min_date").cast("string"), "max_date": F.col("max_date").cast("string"),
        }
    )
    digits = {"skew": 4, "kurtosis": 4, "avg_string_length": 4, "outlier_fraction": 6, "fraction_null": 6}
    return rounded(out, 3, **digits)


@query(
    "b15_profile_table",
    profile_sql("lineitem", NUMERIC_COLUMNS["lineitem"], ["l_returnflag", "l_linestatus"], ["l_shipdate"]),
)
def b15(spark, sf):
    return profile_rows(S.load(spark, sf, "lineitem"))


@query("b15_profile_table_approx")
def b15_approx(spark, sf):
    return P.profile_table(S.load(spark, sf, "lineitem"), "2000-01-01 00:00:00", approx=True)


@query(
    "b15_profile_table_orders",
    profile_sql("orders", NUMERIC_COLUMNS["orders"], TEXT_COLUMNS["orders"], ["o_orderdate"]),
)
def b15_orders(spark, sf):
    return profile_rows(S.load(spark, sf, "orders"))
