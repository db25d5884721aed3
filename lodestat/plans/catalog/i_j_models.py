"""Queries I1-I12 and J1-J6."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lodestat.functions.columns import rounded
from lodestat.operators import ensemble as J
from lodestat.operators import models as I
from lodestat.operators.encoding import vector_cells
from lodestat.plans.registry import query
from lodestat.sources.tables import load


def segment_rows(spark, sf):
    """Documents with their quality label: text categories plus sizes."""
    docs = load(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", F.size(F.split("text", r"\s+")).alias("n_words"))
    return docs.join(load(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


def price_rows(spark, sf):
    return load(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")


def quality(spark, sf):
    return I.prepare(segment_rows(spark, sf), "quality", "classification", ["doc_id"], test_size=0.2)


def status(spark, sf):
    """Three classes that depend on the price."""
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    tier = F.when(F.col("o_totalprice") < 150000, "a").when(F.col("o_totalprice") < 350000, "b").otherwise("c")
    return I.prepare(o.withColumn("tier", tier), "tier", "classification", ["o_orderkey"], test_size=0.2)


def price(spark, sf):
    li = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    y = F.col("o_totalprice") * 0.5 + F.pmod("o_custkey", F.lit(97)) * 10.0
    return I.prepare(li.withColumn("y", y), "y", "regression", ["o_orderkey"], test_size=0.2)


def scored(prepared, model, key):
    out = model.transform(prepared.val)
    probability = vector_to_array("probability") if "probability" in out.columns else F.lit(None).cast("array<double>")
    return out.select(key, "label", "prediction", probability.alias("probability"))


BRANDS = "(SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, COUNT(*) OVER () AS k FROM (SELECT DISTINCT p_brand AS v FROM part))"
TYPES = "(SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT DISTINCT p_type AS v FROM part))"


@query(
    "i1_build_features_flat",
    f"""WITH b AS {BRANDS}, t AS {TYPES}
    SELECT p_partkey, CAST(0 AS BIGINT) AS i, round((p_size - m) / s, 5) AS x FROM part, (SELECT avg(p_size) AS m, stddev_samp(p_size) AS s FROM part)
    UNION ALL SELECT p_partkey, 1 + b.i, 1.0 FROM part JOIN b ON v = p_brand UNION ALL SELECT p_partkey, 1 + k + t.i, 1.0 FROM part JOIN t ON v = p_type, (SELECT DISTINCT k FROM b)""",
)
def i1_flat(spark, sf):
    df = load(spark, sf, "part").select("p_partkey", "p_size", "p_brand", "p_type")
    fitted = I.build_features(df, None, ["p_partkey"]).fit(df)
    cells = fitted.transform(df).select("p_partkey", F.posexplode(vector_to_array("features")).alias("i", "x"))
    return rounded(cells.filter((F.col("i") == 0) | (F.col("x") != 0)).withColumn("i", F.col("i").cast("long")), 5)


SEGMENT_ROWS = r"""SELECT doc_id, lang, source, n_chars, len(string_split_regex(text, '[ \t\n\x0B\f\r]+')) AS n_words FROM documents JOIN labels USING (doc_id)"""


@query(
    "i1_build_features",
    f"""WITH d AS ({SEGMENT_ROWS}), l AS (SELECT lang AS v, row_number() OVER (ORDER BY lang) - 1 AS i, COUNT(*) OVER () AS k FROM (SELECT DISTINCT lang FROM d)),
    s AS (SELECT source AS v, row_number() OVER (ORDER BY source) - 1 AS i FROM (SELECT DISTINCT source FROM d))
    SELECT doc_id, CAST(0 AS BIGINT) AS i, round((n_chars - a) / b, 5) AS x FROM d, (SELECT avg(n_chars) AS a, stddev_samp(n_chars) AS b FROM d)
    UNION ALL SELECT doc_id, 1, round((n_words - a) / b, 5) FROM d, (SELECT avg(n_words) AS a, stddev_samp(n_words) AS b FROM d)
    UNION ALL SELECT doc_id, 2 + l.i, 1.0 FROM d JOIN l ON v = lang UNION ALL SELECT doc_id, 2 + k + s.i, 1.0 FROM d JOIN s ON v = source, (SELECT DISTINCT k FROM l)""",
)
def i1(spark, sf):
    df = segment_rows(spark, sf)
    fitted = I.build_features(df, "quality", ["doc_id"]).fit(df)
    return rounded(vector_cells(fitted.transform(df), "doc_id", "features"), 5)


@query("i2_fit_logistic")
def i2(spark, sf):
    p = quality(spark, sf)
    return scored(p, I.fit(p, "logistic", **{"C": 1.0, "penalty": "l1"}), "doc_id")


@query("i3_fit_linear")
def i3(spark, sf):
    p = price(spark, sf)
    return scored(p, I.fit(p, "linear"), "o_orderkey")


@query("i3_fit_ridge_lasso")
def i3_penalized(spark, sf):
    p = price(spark, sf)
    ridge, lasso = (scored(p, I.fit(p, f, alpha=1.0), "o_orderkey").withColumn("model", F.lit(f)) for f in ("ridge", "lasso"))
    return ridge.unionByName(lasso)


@query(
    "i3_linear_one_feature",
    "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem",
)
def i3_one(spark, sf):
    from pyspark.ml.feature import VectorAssembler

    rows = load(spark, sf, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("label"))
    model = I.make_model("linear", "regression").fit(VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(rows))
    fitted = [(float(model.coefficients[0]), float(model.intercept))]
    return rounded(spark.createDataFrame(fitted, "slope double, intercept double"), 4, intercept=2)


@query("i4_fit_forest")
def i4(spark, sf):
    p = quality(spark, sf)
    return scored(p, I.fit(p, "forest", **I.FOREST_PRESETS["fast_forest"]), "doc_id")


@query("i5_fit_boosting")
def i5(spark, sf):
    p = quality(spark, sf)
    return scored(p, I.fit(p, "boosting", rounds=10, rate=0.1, depth=4), "doc_id")


@query("i5_fit_boosting_multiclass")
def i5_multi(spark, sf):
    p = status(spark, sf)
    return scored(p, I.fit(p, "boosting", rounds=3, rate=0.3, depth=3), "o_orderkey")


@query("i6_fit_mlp")
def i6(spark, sf):
    p = quality(spark, sf)
    return scored(p, I.fit(p, "mlp"), "doc_id")


@query("i7_fit_linear_svm")
def i7(spark, sf):
    p = quality(spark, sf)
    return scored(p, I.fit(p, "linear_svm"), "doc_id")


DIST = "sqrt(list_sum(list_transform(list_zip(t.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)))"
NEAREST = f"""n AS (SELECT t.vec_id, b.vec_id AS neighbour, b.label, {DIST} AS d FROM embeddings t, embeddings b WHERE t.vec_id % 5 = 0 AND b.vec_id % 5 <> 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbour) AS rank FROM n)"""


def knn_parts(spark, sf):
    e = load(spark, sf, "embeddings")
    return e.filter(F.col("vec_id") % 5 != 0), e.filter(F.col("vec_id") % 5 == 0)


@query(
    "i8_knn_predict",
    f"""WITH {NEAREST}, v AS (SELECT vec_id, label, COUNT(*) AS c FROM r WHERE rank <= 5 GROUP BY 1, 2)
    SELECT vec_id, label AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, label) AS i FROM v) WHERE i = 1""",
)
def i8(spark, sf):
    train, test = knn_parts(spark, sf)
    return I.knn_predict(train, test, 5, "label", "classification", "vec_id", "embedding")


@query("i8_knn_regression", f"WITH {NEAREST} SELECT vec_id, round(avg(label), 6) AS prediction FROM r WHERE rank <= 5 GROUP BY 1")
def i8_regression(spark, sf):
    train, test = knn_parts(spark, sf)
    return rounded(I.knn_predict(train, test, 5, "label", "regression", "vec_id", "embedding"), 6)


@query(
    "i9_gaussian_nb_moments",
    " UNION ALL ".join(
        f"SELECT l_returnflag AS label, '{c}' AS feature, round(COUNT(*) / (SELECT COUNT(*) FROM lineitem), 6) AS prior, round(avg({c}), 4) AS mean, round(var_pop({c}) / avg({c}) ** 2, 8) AS relative_variance FROM lineitem GROUP BY 1"
        for c in ("l_quantity", "l_extendedprice", "l_discount")
    ),
)
def i9(spark, sf):
    m = I.gaussian_moments(load(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], "l_returnflag")
    relative = (F.col("variance") / (F.col("mean") * F.col("mean"))).alias("relative_variance")
    return rounded(m.select("label", "feature", "prior", "mean", relative), 4, prior=6, relative_variance=8)


@query("i9_fit_gaussian_nb")
def i9_model(spark, sf):
    p = quality(spark, sf)
    return scored(p, I.fit(p, "gaussian_nb"), "doc_id")


@query("i10_isolation_forest")
def i10(spark, sf):
    trees, contamination = I.ISOLATION_PRESETS["fast_isolation"]
    return I.isolation_forest(load(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"), "l_quantity", "l_extendedprice", "l_discount", "l_tax"
    ), "id", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], trees, contamination)


@query("i11_train_families")
def i11(spark, sf):
    p = quality(spark, sf)
    families = {"baseline": {}, "boosting": {"rounds": 5, "depth": 3}, "mlp": {"hidden": (16,), "max_iter": 20}}
    return I.train_families(p, families, "f1")[0]


@query("i12_train_architectures")
def i12(spark, sf):
    p = quality(spark, sf)
    forest = {name: ("forest", {**preset, "trees": 10}) for name, preset in I.FOREST_PRESETS.items()}
    return I.train_architectures(p, forest, "accuracy")[0]


@query("j1_tune")
def j1(spark, sf):
    p = quality(spark, sf)
    return J.tune(p, "baseline", trials=4, metric="f1")[0]


PROBS = """SELECT o_orderkey AS id, m AS model, [((o_orderkey * 7 + m * 3) % 11) / 20.0, ((o_orderkey * 5 + m) % 13) / 25.0, 1 - ((o_orderkey * 7 + m * 3) % 11) / 20.0 - ((o_orderkey * 5 + m) % 13) / 25.0] AS p
  FROM orders, (SELECT unnest([1, 2, 3]) AS m)"""


def probabilities(spark, sf):
    k, m = F.col("id"), F.col("model")
    a, b = ((k * 7 + m * 3) % 11) / 20.0, ((k * 5 + m) % 13) / 25.0
    return (
        load(spark, sf, "orders")
        .select(F.col("o_orderkey").alias("id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("model"))
        .withColumn("p", F.array(a, b, 1 - a - b))
    )


@query(
    "j2_vote_soft",
    f"""WITH c AS (SELECT id, unnest(p) AS p, unnest([0, 1, 2]) AS cls FROM ({PROBS})), a AS (SELECT id, cls, round(avg(p), 9) AS p FROM c GROUP BY 1, 2)
    SELECT id, prediction, round(p, 6) AS probability FROM (SELECT id, CAST(cls AS INT) AS prediction, p, row_number() OVER (PARTITION BY id ORDER BY p DESC, cls) AS r FROM a) WHERE r = 1""",
)
def j2(spark, sf):
    return rounded(J.vote_soft(probabilities(spark, sf).withColumn("p", F.transform("p", lambda x: F.round(x, 12))), "id", "p"), 6)


VOTES = "SELECT o_orderkey AS id, m AS model, (o_orderkey * 7 + m * (o_orderkey % 5)) % 4 AS prediction FROM orders, (SELECT unnest([1, 2, 3, 4]) AS m)"


def votes(spark, sf):
    k = F.col("id")
    return (
        load(spark, sf, "orders")
        .select(F.col("o_orderkey").alias("id"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("model"))
        .withColumn("prediction", (k * 7 + F.col("model") * (k % 5)) % 4)
    )


@query(
    "j3_vote_hard",
    f"""SELECT id, prediction FROM (SELECT id, prediction, row_number() OVER (PARTITION BY id ORDER BY COUNT(*) DESC, prediction) AS r FROM ({VOTES}) GROUP BY 1, 2) WHERE r = 1""",
)
def j3(spark, sf):
    return J.vote_hard(votes(spark, sf), "id")


@query("j4_average_regressors", f"SELECT id, round(avg(prediction), 6) AS prediction FROM ({VOTES}) GROUP BY 1")
def j4(spark, sf):
    return rounded(J.average_regressors(votes(spark, sf), "id"), 6)


@query("j5_stack")
def j5(spark, sf):
    p = quality(spark, sf)
    models = {"logit": ("logistic", {}), "forest": ("forest", {"trees": 5, "depth": 4})}
    return J.stack(p, models, ("logistic", {}), "doc_id", folds=3)[0]


RUNS = "SELECT o_orderpriority AS model, avg(o_totalprice) / 1e6 AS score FROM orders GROUP BY 1"


@query(
    "j6_best_model",
    f"""SELECT 'f1' AS metric, arg_max(model, score) AS model, round(max(score), 6) AS score FROM ({RUNS})
    UNION ALL SELECT 'rmse', arg_min(model, score), round(min(score), 6) FROM ({RUNS})""",
)
def j6(spark, sf):
    runs = load(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg((F.avg("o_totalprice") / 1e6).alias("score"))
    out = J.best_model(runs, "f1").withColumn("metric", F.lit("f1")).unionByName(J.best_model(runs, "rmse").withColumn("metric", F.lit("rmse")))
    return rounded(out, 6)
