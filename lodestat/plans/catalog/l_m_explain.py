"""Queries L1-L11, M1 and M2."""

from pyspark.sql import functions as F

from lodestat.functions.columns import rounded
from lodestat.operators import explain as L
from lodestat.operators import models as I
from lodestat.plans.catalog.g_forecast import EVALUATED
from lodestat.plans.catalog.i_j_models import quality
from lodestat.plans.fixtures import orders_daily, orders_monthly
from lodestat.plans.registry import query
from lodestat.session import scratch_path
from lodestat.sources.tables import load
from lodestat.streaming import scoring

KEYS = ["series"]
WEIGHTS = {"l_quantity": 2.5, "l_extendedprice": -0.001, "l_discount": 40.0, "l_tax": -3.0}


def weights(spark):
    return spark.createDataFrame(list(WEIGHTS.items()), "feature string, weight double")


@query(
    "l1_explain_sample_keyed",
    "SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey * 7919 % 10007, o_orderkey LIMIT 1000)",
)
def l1_keyed(spark, sf):
    return L.explain_sample(load(spark, sf, "orders"), ["o_orderkey"], order=F.col("o_orderkey") * 7919 % 10007).select("o_orderkey")


@query("l1_explain_sample")
def l1(spark, sf):
    return L.explain_sample(load(spark, sf, "orders"), ["o_orderkey"])


@query(
    "l2_linear_attribution",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg(abs({w} * ({c} - m))), 4) AS importance FROM lineitem, (SELECT avg({c}) AS m FROM lineitem)"
        for c, w in WEIGHTS.items()
    ),
)
def l2(spark, sf):
    li = load(spark, sf, "lineitem").withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return rounded(L.mean_abs(L.linear_attribution(li, weights(spark), "id")))


@query("l3_shapley_sampling")
def l3(spark, sf):
    p = quality(spark, sf)
    model = I.fit(p, "forest", trees=5, depth=4)
    return L.shapley_sampling(model, L.explain_sample(p.val, ["doc_id"]), L.explain_sample(p.train, ["doc_id"], 50), "doc_id", 4)


@query("l4_permutation_importance")
def l4(spark, sf):
    p = quality(spark, sf)
    return L.permutation_importance(I.fit(p, "forest", trees=5, depth=4), p.val, "doc_id", "classification", "f1")


@query(
    "l5_coefficient_effects",
    f"""WITH w(feature, weight) AS (VALUES {', '.join(f"('{c}', {w}::DOUBLE)" for c, w in WEIGHTS.items())}), u AS (SELECT stddev_pop(abs(weight)) AS u FROM w),
    s AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, stddev_pop({c}) AS s FROM lineitem" for c in WEIGHTS)})
    SELECT w.feature, weight AS coefficient, abs(weight) AS abs_coefficient, CASE WHEN weight > 0 THEN 'positive' ELSE 'negative' END AS direction,
      CASE WHEN abs(weight) > u THEN 'high' WHEN abs(weight) > u / 2 THEN 'medium' ELSE 'low' END AS magnitude, round(weight * s, 5) AS effect_per_std FROM w JOIN s ON s.feature = w.feature, u""",
)
def l5(spark, sf):
    return rounded(L.coefficient_effects(load(spark, sf, "lineitem"), weights(spark)), 5)


@query(
    "l6_top_features",
    "SELECT p_brand AS feature, round(avg(p_retailprice), 6) AS importance FROM part GROUP BY 1 ORDER BY avg(p_retailprice) DESC, 1 LIMIT 10",
)
def l6(spark, sf):
    importance = load(spark, sf, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.avg("p_retailprice").alias("importance"))
    return rounded(L.top_features(importance), 6)


@query("l7_component_contribution")
def l7(spark, sf):
    return L.component_contribution(orders_daily(spark, sf), KEYS)


@query(
    "l8_residual_summary",
    f"{EVALUATED} SELECT series, round(avg(y - f), 2) AS residual_mean, round(stddev_samp(y - f), 2) AS residual_std, COUNT(*) AS n FROM f WHERE model = 'sma' GROUP BY 1",
)
def l8(spark, sf):
    return rounded(L.residual_summary(orders_daily(spark, sf), KEYS), 2)


@query("l9_model_parameters")
def l9(spark, sf):
    return L.model_parameters(orders_monthly(spark, sf), KEYS)


@query("l10_explain")
def l10(spark, sf):
    p = quality(spark, sf)
    linear = L.explain(I.fit(p, "logistic"), p.val, "doc_id", "classification")
    forest = L.explain(I.fit(p, "forest", trees=5, depth=4), p.val, "doc_id", "classification", method="permutation")
    return linear.unionByName(forest)


@query("l11_explain_series")
def l11(spark, sf):
    return L.explain_series(orders_monthly(spark, sf), KEYS)


def exact_line(spark, sf):
    """A target that is an exact linear form of two columns."""
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    y = F.col("o_totalprice") / F.pi() + F.col("o_custkey") * 3.0
    return I.prepare(o.withColumn("y", y), "y", "regression", ["o_orderkey"], ["o_orderpriority"], test_size=0.2)


LINE = "SELECT o_orderkey, round(o_totalprice / pi() + o_custkey * 3.0, 2) AS prediction FROM orders"


@query("m1_score_batch", LINE)
def m1(spark, sf):
    p = exact_line(spark, sf)
    path = scratch_path(spark, "model")
    scoring.save_model(I.pipeline_of(p, I.fit(p, "linear")), path)
    rows = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    return rounded(scoring.score_batch(path, rows).select("o_orderkey", "prediction"), 2)


@query("m2_score_stream", LINE)
def m2(spark, sf):
    p = exact_line(spark, sf)
    model = I.pipeline_of(p, I.fit(p, "linear"))
    source = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    inbox, out, marks = (scratch_path(spark, name) for name in ("stream-in", "stream-out", "stream-checkpoint"))
    source.write.parquet(inbox)
    stream = spark.readStream.schema(source.schema).parquet(inbox)
    scoring.score_stream(model, stream, out, marks, ["o_orderkey"], available_now=True).awaitTermination()
    return rounded(spark.read.parquet(out), 2)
