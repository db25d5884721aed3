"""Queries C1-C19."""

from pyspark.sql import functions as F

from lodestat.functions.columns import rounded
from lodestat.operators import rules as R
from lodestat.plans.catalog.a_b_tables_profile import NULL_TEST, each
from lodestat.plans.fixtures import CUSTOMER_NULLS, customer_nulls
from lodestat.plans.registry import query
from lodestat.sources.tables import load

CUSTOMER = [("c_custkey", "n"), ("c_name", "t"), ("c_nationkey", "n"), ("c_acctbal", "n"), ("c_mktsegment", "t"), ("note", "t")]
PART = [("p_partkey", "n"), ("p_name", "t"), ("p_brand", "t"), ("p_type", "t"), ("p_size", "n"), ("p_retailprice", "n")]
LINEITEM = [
    ("l_orderkey", "n"), ("l_partkey", "n"), ("l_suppkey", "n"), ("l_linenumber", "n"), ("l_quantity", "n"),
    ("l_extendedprice", "n"), ("l_discount", "n"), ("l_tax", "n"), ("l_returnflag", "t"), ("l_linestatus", "t"), ("l_shipdate", "d"),
]
EVENTS = [("event_id", "n"), ("ts", "d"), ("user_id", "n"), ("event_type", "t"), ("value", "n"), ("props", "t")]


def profile(source: str, columns, spread: bool = False) -> str:
    """CTE text ``t`` and ``p``: one row per column with what the rules read."""
    rows = []
    for position, (c, kind) in enumerate(columns):
        num = f"CAST({c} AS DOUBLE)" if kind == "n" else "CAST(NULL AS DOUBLE)"
        txt = c if kind == "t" else "CAST(NULL AS VARCHAR)"
        rows.append(
            f"SELECT '{c}' AS column_name, '{kind}' AS kind, {position} AS position, COUNT(*) AS n_rows, "
            f"COUNT(*) FILTER (WHERE {NULL_TEST.format(c=c)}) AS n_null, COUNT(*) - COUNT({c}) AS raw_null, "
            f"COUNT(DISTINCT {c}) AS n_unique, avg(length({txt})) AS avg_len, max(length({txt})) AS max_len, "
            f"COUNT(*) FILTER (WHERE {num} = 0) AS zeros, coalesce(bool_and({num} = floor({num}) AND {num} >= 0 AND {num} < 100), false) AS codes"
            + (
                f", min({num}) AS lo, abs(coalesce(skewness({num}), 0)) AS skew, coalesce((SELECT COUNT(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) / COUNT(v) "
                f"FROM (SELECT {num} AS v FROM t), (SELECT quantile_cont({num}, 0.25) AS q1, quantile_cont({num}, 0.75) AS q3 FROM t)), 0) AS share"
                if spread
                else ""
            )
            + " FROM t"
        )
    return (
        f"WITH t AS ({source}), p0 AS ({' UNION ALL '.join(rows)}), "
        "p AS (SELECT *, n_null / n_rows AS frac, n_unique = n_rows AND n_rows > 1 AND n_null = 0 AS is_id, "
        "kind = 'n' AND n_unique <= 20 AND codes AS coded, kind = 't' AND n_unique < n_rows * 0.1 AND avg_len < 50 AS cat, "
        "kind = 't' AND (avg_len > 50 OR max_len > 200) AS free FROM p0), "
        "d AS (SELECT *, frac > 0.8 OR is_id OR n_unique <= 1 OR (kind = 't' AND n_unique > 1000 AND NOT cat) OR coalesce(free, false) AS dropped FROM p)"
    )


def union(*parts: str) -> str:
    return " UNION ALL ".join(parts)


@query(
    "c1_column_issues",
    profile(CUSTOMER_NULLS, CUSTOMER)
    + union(
        " SELECT column_name, 'drop' AS rule, round(frac, 6) AS value FROM p WHERE frac > 0.8",
        "SELECT column_name, 'impute', round(frac, 6) FROM p WHERE frac > 0.4 AND frac <= 0.8",
        "SELECT column_name, 'exclude', CAST(n_unique AS DOUBLE) FROM p WHERE is_id",
        "SELECT column_name, 'high_cardinality', CAST(n_unique AS DOUBLE) FROM p WHERE kind = 't' AND n_unique > 1000",
    ),
)
def c1(spark, sf):
    return rounded(R.column_issues(customer_nulls(spark, sf)).drop("message"), 6)


@query(
    "c2_table_issues",
    """SELECT 'supplier' AS tbl, 'small' AS rule, CAST(COUNT(*) AS DOUBLE) AS value FROM supplier HAVING COUNT(*) < 500
    UNION ALL SELECT 'region', 'small', CAST(COUNT(*) AS DOUBLE) FROM region HAVING COUNT(*) < 500
    UNION ALL SELECT 'part', 'small', CAST(COUNT(*) AS DOUBLE) FROM part HAVING COUNT(*) < 500""",
)
def c2(spark, sf):
    out = None
    for name in ("supplier", "region", "part"):
        part = R.table_issues(load(spark, sf, name)).select(F.lit(name).alias("tbl"), "rule", "value")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "c3_drop_suggestions",
    profile(CUSTOMER_NULLS, CUSTOMER)
    + union(
        " SELECT column_name, 'high null rate' AS reason FROM p WHERE frac > 0.8",
        "SELECT column_name, 'unique identifier' FROM p WHERE is_id",
        "SELECT column_name, 'constant' FROM p WHERE n_unique <= 1",
        "SELECT column_name, 'very high cardinality text' FROM p WHERE kind = 't' AND n_unique > 1000 AND NOT cat",
        "SELECT column_name, 'free text' FROM p WHERE free",
    ),
)
def c3(spark, sf):
    return R.drop_suggestions(customer_nulls(spark, sf)).select("column_name", F.explode("reasons").alias("reason"))


@query(
    "c4_impute_suggestions",
    profile(CUSTOMER_NULLS, CUSTOMER)
    + " SELECT column_name, CASE WHEN kind = 'n' THEN 'median' ELSE 'mode' END AS strategy, round(frac, 6) AS null_fraction FROM d WHERE NOT dropped AND frac > 0.05 AND frac <= 0.4",
)
def c4(spark, sf):
    return rounded(R.impute_suggestions(customer_nulls(spark, sf)), 6)


@query(
    "c5_encode_suggestions",
    profile("SELECT * FROM part", PART)
    + """, e AS (SELECT column_name, CASE kind WHEN 'n' THEN 'numeric' ELSE 'text' END AS kind, n_unique AS cardinality,
    CASE WHEN kind = 't' AND coalesce(cat, true) THEN CASE WHEN n_unique <= 10 THEN 'onehot' WHEN n_unique <= 50 THEN 'target_encoding' ELSE 'frequency_encoding' END
      WHEN coded THEN 'onehot' END AS encoding FROM d WHERE NOT dropped)
    SELECT column_name, kind, encoding, cardinality FROM e WHERE encoding IS NOT NULL""",
)
def c5(spark, sf):
    return R.encode_suggestions(load(spark, sf, "part"))


@query(
    "c6_scale_suggestions",
    profile("SELECT * FROM events", EVENTS, spread=True)
    + """ SELECT column_name, CASE WHEN skew > 2 OR share > 0.1 THEN 'robust' WHEN lo >= 0 THEN 'minmax' ELSE 'standard' END AS scaling,
    round(skew, 4) AS skew, round(share, 6) AS outlier_fraction FROM d WHERE NOT dropped AND kind = 'n' AND NOT coded""",
)
def c6(spark, sf):
    return rounded(R.scale_suggestions(load(spark, sf, "events")), 4, outlier_fraction=6)


ZEROED = "SELECT l_orderkey, l_quantity, CASE WHEN l_partkey % 5 < 3 THEN 0.0 ELSE l_tax END AS mostly_zero, CASE WHEN l_partkey % 5 < 3 THEN NULL ELSE l_discount END AS half_null, CASE WHEN l_partkey % 4 = 0 THEN l_extendedprice * 10 ELSE 100 + l_linenumber END AS spiky FROM lineitem"


def zeroed(spark, sf):
    k = F.col("l_partkey")
    return load(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_quantity",
        F.when(k % 5 < 3, 0.0).otherwise(F.col("l_tax")).alias("mostly_zero"),
        F.when(k % 5 >= 3, F.col("l_discount")).alias("half_null"),
        F.when(k % 4 == 0, F.col("l_extendedprice") * 10).otherwise(100.0 + F.col("l_linenumber")).alias("spiky"),
    )


ZERO_COLUMNS = [("l_orderkey", "n"), ("l_quantity", "n"), ("mostly_zero", "n"), ("half_null", "n"), ("spiky", "n")]


@query(
    "c7_outlier_and_zero_flags",
    profile(ZEROED, ZERO_COLUMNS, spread=True)
    + union(
        " SELECT column_name, 'outliers' AS rule, round(share, 6) AS value FROM d WHERE NOT dropped AND share > 0.2",
        "SELECT column_name, 'high_null', round(frac, 6) FROM d WHERE NOT dropped AND frac > 0.5",
        "SELECT column_name, 'zeros', round(zeros / n_rows, 6) FROM d WHERE NOT dropped AND zeros / n_rows > 0.5",
    ),
)
def c7(spark, sf):
    return rounded(R.outlier_and_zero_flags(zeroed(spark, sf)).drop("message"), 6)


@query(
    "c8_feature_selection_advice",
    profile(ZEROED, ZERO_COLUMNS, spread=True)
    + """, s AS (SELECT COUNT(*) FILTER (WHERE dropped) AS dropped, COUNT(*) FILTER (WHERE NOT dropped AND frac > 0.05 AND frac <= 0.4) AS imputed,
      COUNT(*) FILTER (WHERE NOT dropped AND share > 0.2) AS outliers, COUNT(*) AS n_cols FROM d)
    SELECT 'many_dropped' AS rule, CAST(dropped AS DOUBLE) AS value FROM s WHERE dropped > n_cols * 0.5 UNION ALL SELECT 'many_imputed', imputed FROM s WHERE imputed > 5
    UNION ALL SELECT 'outliers', outliers FROM s WHERE outliers > 0""",
)
def c8(spark, sf):
    return R.feature_selection_advice(zeroed(spark, sf)).drop("message")


TASK_TARGETS = [("orders", "o_orderstatus"), ("orders", "o_totalprice"), ("lineitem", "l_linenumber"), ("lineitem", "l_discount"), ("customer", "c_name")]


@query(
    "c9_infer_task",
    "SELECT tbl, target, CASE WHEN few THEN 'classification' ELSE 'regression' END AS task, CASE WHEN few THEN k END AS n_classes FROM ("
    + union(
        "SELECT 'orders' AS tbl, 'o_orderstatus' AS target, COUNT(DISTINCT o_orderstatus) <= 20 AS few, COUNT(DISTINCT o_orderstatus) AS k FROM orders",
        "SELECT 'orders', 'o_totalprice', COUNT(DISTINCT o_totalprice) <= 10 AND bool_and(o_totalprice = floor(o_totalprice)), COUNT(DISTINCT o_totalprice) FROM orders",
        "SELECT 'lineitem', 'l_linenumber', COUNT(DISTINCT l_linenumber) <= 10, COUNT(DISTINCT l_linenumber) FROM lineitem",
        "SELECT 'lineitem', 'l_discount', COUNT(DISTINCT l_discount) <= 10 AND bool_and(l_discount = floor(l_discount)), COUNT(DISTINCT l_discount) FROM lineitem",
        "SELECT 'customer', 'c_name', COUNT(DISTINCT c_name) <= 20, COUNT(DISTINCT c_name) FROM customer",
    )
    + ") UNION ALL SELECT 'customer', NULL, 'clustering', NULL",
)
def c9(spark, sf):
    parts = [(t, c, R.infer_task(load(spark, sf, t), c)) for t, c in TASK_TARGETS]
    parts.append(("customer", None, R.infer_task(load(spark, sf, "customer"))))
    out = None
    for t, c, df in parts:
        row = df.select(F.lit(t).alias("tbl"), F.lit(c).cast("string").alias("target"), "task", "n_classes")
        out = row if out is None else out.unionByName(row)
    return out


RARE = "SELECT doc_id, CASE WHEN doc_id % 300 = 0 THEN NULL WHEN doc_id < 3 THEN 'rare' WHEN doc_id % 20 = 1 THEN 'b' ELSE 'a' END AS cls FROM documents"


@query(
    "c10_target_checks",
    f"""WITH c AS (SELECT cls, COUNT(*) AS n FROM ({RARE}) GROUP BY 1), s AS (SELECT sum(n) FILTER (WHERE cls IS NULL) AS miss, min(n) FILTER (WHERE cls IS NOT NULL) AS lo, max(n) FILTER (WHERE cls IS NOT NULL) AS hi FROM c)
    SELECT 'cls' AS target, 'missing_target' AS rule, round(CAST(miss AS DOUBLE), 4) AS value FROM s WHERE miss > 0 UNION ALL SELECT 'cls', 'imbalance', round(hi / lo, 4) FROM s WHERE hi / lo > 10
    UNION ALL SELECT 'cls', 'rare_class', CAST(lo AS DOUBLE) FROM s WHERE lo < 5
    UNION ALL SELECT 'value', 'skewed_target', round(skewness(value), 4) FROM events HAVING abs(skewness(value)) > 2""",
)
def c10(spark, sf):
    k = F.col("doc_id")
    docs = load(spark, sf, "documents").select(
        "doc_id", F.when(k % 300 == 0, None).when(k < 3, "rare").when(k % 20 == 1, "b").otherwise("a").alias("cls")
    )
    out = R.target_checks(docs, "cls").withColumn("target", F.lit("cls"))
    more = R.target_checks(load(spark, sf, "events"), "value").withColumn("target", F.lit("value"))
    return rounded(out.unionByName(more).drop("message"), 4)


SPARSE = "SELECT c_custkey, c_name, CAST(NULL AS DOUBLE) AS empty, 1 AS one, CASE WHEN c_custkey % 20 = 0 THEN c_acctbal END AS rare FROM customer"


@query(
    "c11_problem_features",
    f"WITH t AS ({SPARSE}) SELECT * FROM ("
    + each(
        ["c_custkey", "c_name", "empty", "one", "rare"],
        "SELECT '{c}' AS column_name, CASE WHEN COUNT({c}) = 0 THEN 'all missing' WHEN COUNT(DISTINCT {c}) <= 1 THEN 'constant' "
        "WHEN 1 - COUNT({c}) / COUNT(*) > 0.9 THEN 'mostly missing' END AS problem FROM t",
    )
    + ") WHERE problem IS NOT NULL",
)
def c11(spark, sf):
    df = load(spark, sf, "customer").select(
        "c_custkey", "c_name", F.lit(None).cast("double").alias("empty"), F.lit(1).alias("one"),
        F.when(F.col("c_custkey") % 20 == 0, F.col("c_acctbal")).alias("rare"),
    )
    return R.problem_features(df)


LEAKY = "SELECT o_orderkey, o_custkey, o_totalprice, o_totalprice * 2 + o_custkey AS doubled, -o_totalprice + o_orderkey % 7 AS negated FROM orders"


@query(
    "c12_leakage_check",
    f"WITH t AS ({LEAKY}) SELECT * FROM ("
    + each(["o_orderkey", "o_custkey", "doubled", "negated"], "SELECT '{c}' AS column_name, round(corr({c}, o_totalprice), 6) AS r FROM t")
    + ") WHERE abs(r) > 0.95",
)
def c12(spark, sf):
    return rounded(R.leakage_check(leaky(spark, sf), "o_totalprice"), 6)


def leaky(spark, sf):
    p = F.col("o_totalprice")
    return load(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", p, (p * 2 + F.col("o_custkey")).alias("doubled"), (-p + F.col("o_orderkey") % 7).alias("negated")
    )


@query(
    "c13_readiness_report",
    f"""WITH t AS ({LEAKY}) SELECT 'info' AS level, 'n_features' AS rule, CAST(NULL AS VARCHAR) AS subject, CAST(4 AS DOUBLE) AS value
    UNION ALL SELECT 'info', 'task_regression', 'o_totalprice', NULL
    UNION ALL SELECT 'warning', 'leakage', column_name, r FROM ("""
    + each(["o_orderkey", "o_custkey", "doubled", "negated"], "SELECT '{c}' AS column_name, round(corr({c}, o_totalprice), 6) AS r FROM t")
    + ") WHERE abs(r) > 0.95",
)
def c13(spark, sf):
    return rounded(R.readiness_report(leaky(spark, sf), "o_totalprice"), 6)


@query(
    "c14_feature_composition",
    profile(CUSTOMER_NULLS, CUSTOMER)
    + """ SELECT COUNT(*) FILTER (WHERE kind = 'n' AND f) AS numeric_features, COUNT(*) FILTER (WHERE kind = 't' AND n_unique <= 100 AND f) AS low_cardinality_text,
    COUNT(*) FILTER (WHERE kind = 't' AND n_unique > 100 AND f) AS high_cardinality_text, COUNT(*) FILTER (WHERE frac > 0.2 AND f) AS missing_features,
    COUNT(*) FILTER (WHERE frac > 0.3 AND f) AS high_missing_features, CASE WHEN max(n_rows) < 1000 THEN 'small' WHEN max(n_rows) < 10000 THEN 'medium' ELSE 'large' END AS size_tier
    FROM (SELECT *, column_name <> 'c_acctbal' AS f FROM p)""",
)
def c14(spark, sf):
    return R.feature_composition(customer_nulls(spark, sf), "c_acctbal")


HINTS = ", ".join(f"'{h}'" for h in R.TARGET_HINTS)
NOT_HINTS = ", ".join(f"'{h}'" for h in R.NON_TARGET_HINTS)


@query(
    "c15_rank_targets",
    profile("SELECT * FROM lineitem", LINEITEM)
    + f""", s AS (SELECT column_name, position, CASE WHEN list_bool_or(list_transform([{HINTS}], lambda h: contains(column_name, h))) THEN 10 ELSE 0 END
      + CASE WHEN position = 10 THEN 5 ELSE 0 END + CASE WHEN n_unique >= 2 AND n_unique <= least(20, (n_rows - raw_null) * 0.8) THEN 3 ELSE 0 END + CASE WHEN n_unique = 2 THEN 2 ELSE 0 END AS score
      FROM p WHERE NOT list_bool_or(list_transform([{NOT_HINTS}], lambda h: contains(column_name, h))))
    SELECT column_name, score, position FROM s WHERE score > 0""",
)
def c15(spark, sf):
    return R.rank_targets(load(spark, sf, "lineitem"))


DATED = "SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS VARCHAR) ELSE 'unknown' END AS shipped, o_orderpriority FROM orders"


@query(
    "c16_detect_date_columns",
    f"""WITH t AS ({DATED}), d AS (SELECT o_orderdate AS day FROM orders)
    SELECT 'o_orderdate' AS column_name, true AS by_name_or_type, CAST(NULL AS DOUBLE) AS parse_share, CAST(NULL AS VARCHAR) AS format, false AS is_ambiguous
    UNION ALL """
    + " UNION ALL ".join(
        f"SELECT '{c}', false, round(avg(CAST(length({c}) >= 8 AND regexp_matches({c}, '[-/ ]') AND TRY_CAST({c} AS TIMESTAMP) IS NOT NULL AS INT)), 6) AS s, 'iso', false FROM t HAVING s >= 0.7"
        for c in ("shipped", "o_orderpriority")
    )
    + """ UNION ALL SELECT 'european', false, 1.0, 'd/M/yyyy[ H:mm[:ss]]', max(day(day)) <= 12 FROM d
    UNION ALL SELECT 'unclear', false, 1.0, 'M/d/yyyy[ H:mm[:ss]]', true""",
)
def c16(spark, sf):
    early = F.least(F.dayofmonth("o_orderdate"), F.lit(12))
    df = load(spark, sf, "orders").select(
        "o_orderkey", "o_orderdate",
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate").cast("string")).otherwise("unknown").alias("shipped"),
        "o_orderpriority",
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("european"),
        F.concat_ws("/", F.lit("03"), F.lpad(early.cast("string"), 2, "0"), F.lit("2021")).alias("unclear"),
    )
    return rounded(R.detect_date_columns(df), 6)


@query(
    "c17_chronological_order",
    """WITH a AS (SELECT event_type, ts, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events),
    b AS (SELECT event_type, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS i FROM events),
    o AS (SELECT o_orderpriority AS event_type, o_orderdate AS ts, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS i FROM orders),
    s AS (SELECT o_orderpriority AS event_type, o_orderdate AS ts, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) AS i FROM orders)
    SELECT event_type AS series, round(avg(CAST(a.ts = b.ts AS INT)), 6) AS order_score, avg(CAST(a.ts = b.ts AS INT)) > 0.8 AS is_ordered FROM a JOIN b USING (event_type, i) GROUP BY 1
    UNION ALL SELECT event_type, round(avg(CAST(o.ts = s.ts AS INT)), 6), avg(CAST(o.ts = s.ts AS INT)) > 0.8 FROM o JOIN s USING (event_type, i) GROUP BY 1""",
)
def c17(spark, sf):
    events = R.chronological_order(load(spark, sf, "events"), ["event_type"], "ts", "event_id")
    orders = R.chronological_order(load(spark, sf, "orders"), ["o_orderpriority"], "o_orderdate", "o_orderkey")
    return rounded(events.toDF("series", "order_score", "is_ordered").unionByName(orders.toDF("series", "order_score", "is_ordered")), 6)


@query(
    "c18_sample_null_warning",
    f"""WITH t AS (SELECT * FROM ({CUSTOMER_NULLS}) ORDER BY c_custkey DESC LIMIT 8) SELECT * FROM ("""
    + each(
        ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "note"],
        "SELECT '{c}' AS column_name, round(COUNT(*) FILTER (WHERE " + NULL_TEST + ") / COUNT(*), 6) AS fraction_null FROM t",
    )
    + ") WHERE fraction_null > 0.8",
)
def c18(spark, sf):
    return rounded(R.sample_null_warning(customer_nulls(spark, sf), 8, [F.desc("c_custkey")]), 6)


@query(
    "c19_suggest_tasks",
    profile("SELECT * FROM lineitem", LINEITEM)
    + """, f AS (SELECT 1 AS g, row_number() OVER (ORDER BY position) AS r, 'forecasting' AS type, column_name AS target FROM p
      WHERE kind = 'n' AND n_unique > 20 AND NOT is_id AND NOT contains(column_name, 'id') AND NOT contains(column_name, 'key')),
    c AS (SELECT 2 AS g, row_number() OVER (ORDER BY position) AS r, CASE WHEN n_unique <= 20 THEN 'classification' ELSE 'regression' END AS type, column_name AS target FROM p
      WHERE kind = 'n' AND n_unique <= 20),
    u AS (SELECT * FROM f WHERE r <= 2 UNION ALL SELECT * FROM c WHERE r <= 3 UNION ALL SELECT 3, 1, 'clustering', NULL UNION ALL SELECT 4, 1, 'exploration', NULL)
    SELECT CAST(row_number() OVER (ORDER BY g, r) AS INT) AS rank, type, target FROM (SELECT * FROM u ORDER BY g, r LIMIT 5)""",
)
def c19(spark, sf):
    return R.suggest_tasks(load(spark, sf, "lineitem"))
