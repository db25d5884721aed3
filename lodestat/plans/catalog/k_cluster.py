"""Queries K1-K10."""

from pyspark.sql import functions as F

from lodestat.functions.columns import rounded
from lodestat.operators import cluster as K
from lodestat.operators.encoding import vector_cells
from lodestat.plans.registry import query
from lodestat.sources.tables import load

BLOBS = "SELECT c_custkey AS id, (c_custkey % 3) * 10.0 + (c_custkey % 7) * 0.1 AS a, (c_custkey % 3) * 10.0 + (c_custkey % 11) * 0.1 AS b FROM customer"


def blobs(spark, sf):
    """Three separated groups."""
    k = F.col("c_custkey")
    a, b = (k % 3) * 10.0 + (k % 7) * 0.1, (k % 3) * 10.0 + (k % 11) * 0.1
    return load(spark, sf, "customer").select(k.alias("id"), a.alias("a"), b.alias("b"), F.array(a, b).alias("features"))


def vectors(spark, sf):
    return load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("features"))


BLOB_CLUSTERS = "SELECT c_custkey AS id, c_custkey % 3 AS cluster FROM customer"


def by_first_member(assigned):
    """Clusters named by their smallest id, which does not depend on label numbers."""
    first = assigned.groupBy("label").agg(F.min("id").alias("cluster"))
    return assigned.join(F.broadcast(first), "label").select("id", "cluster")


@query("k2_kmeans_clusters", BLOB_CLUSTERS)
def k2_clusters(spark, sf):
    return by_first_member(K.kmeans_sweep(blobs(spark, sf), "id")[0])


@query("k3_gmm_clusters", BLOB_CLUSTERS)
def k3_clusters(spark, sf):
    return by_first_member(K.gmm_sweep(blobs(spark, sf), "id")[0])


@query("k4_dbscan_clusters", BLOB_CLUSTERS)
def k4_clusters(spark, sf):
    return by_first_member(K.dbscan(blobs(spark, sf), "id", 1.5, 5))


@query("k6_hierarchical_clusters", BLOB_CLUSTERS)
def k6_clusters(spark, sf):
    return by_first_member(K.hierarchical(blobs(spark, sf), "id")[0])


NAMES = "(SELECT c_name AS v, row_number() OVER (ORDER BY c_name) - 1 AS i, COUNT(*) OVER () AS k FROM (SELECT DISTINCT c_name FROM customer))"
SEGMENTS = "(SELECT c_mktsegment AS v, row_number() OVER (ORDER BY c_mktsegment) - 1 AS i FROM (SELECT DISTINCT c_mktsegment FROM customer))"


@query(
    "k1_cluster_features",
    f"""WITH n AS {NAMES}, s AS {SEGMENTS}
    SELECT c_custkey, CAST(0 AS BIGINT) AS i, round((c_nationkey - a) / b, 5) AS x FROM customer, (SELECT avg(c_nationkey) AS a, stddev_samp(c_nationkey) AS b FROM customer)
    UNION ALL SELECT c_custkey, 1, round((c_acctbal - a) / b, 5) FROM customer, (SELECT avg(c_acctbal) AS a, stddev_samp(c_acctbal) AS b FROM customer)
    UNION ALL SELECT c_custkey, 2 + n.i, 1.0 FROM customer JOIN n ON v = c_name
    UNION ALL SELECT c_custkey, 2 + k + s.i, 1.0 FROM customer JOIN s ON v = c_mktsegment, (SELECT DISTINCT k FROM n)""",
)
def k1(spark, sf):
    return rounded(vector_cells(K.cluster_vectors(load(spark, sf, "customer"), "c_custkey"), "c_custkey", "features"), 5)


@query("k1_cluster_features_reduced")
def k1_reduced(spark, sf):
    """A slot for every customer name, brought down to 50 components."""
    return K.cluster_features(load(spark, sf, "customer"), "c_custkey")


@query("k2_kmeans_sweep")
def k2(spark, sf):
    return K.kmeans_sweep(blobs(spark, sf), "id")[1]


CENTRES = {0: (0.0, 0.0), 1: (12.0, 9.0), 2: (25.0, 15.0)}


@query(
    "k2_assign_nearest",
    f"""SELECT id, CAST(label AS INT) AS label FROM (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY (a - x) ** 2 + (b - y) ** 2, label) AS r
    FROM ({BLOBS}), (VALUES (0, 0.0, 0.0), (1, 12.0, 9.0), (2, 25.0, 15.0)) c(label, x, y)) WHERE r = 1""",
)
def k2_assign(spark, sf):
    return K.assign_nearest(blobs(spark, sf), CENTRES).select("id", "label")


@query("k3_gmm_sweep")
def k3(spark, sf):
    return K.gmm_sweep(blobs(spark, sf), "id")[1]


DENSITY = """RECURSIVE p AS (SELECT s_suppkey AS id, s_acctbal / 1000 AS x, s_nationkey / 4.0 AS y FROM supplier),
  n AS (SELECT a.id AS i, b.id AS j FROM p a, p b WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 0.36),
  core AS (SELECT i FROM n GROUP BY 1 HAVING COUNT(*) >= 3),
  reach(i, j) AS (SELECT i, i FROM core UNION SELECT r.i, n.j FROM reach r JOIN n ON n.i = r.j JOIN core c ON c.i = n.j),
  comp AS (SELECT j AS id, min(i) AS c FROM reach GROUP BY 1),
  border AS (SELECT n.i AS id, min(c) AS c FROM n JOIN comp ON comp.id = n.j WHERE n.i NOT IN (SELECT i FROM core) GROUP BY 1),
  lab AS (SELECT * FROM comp UNION ALL SELECT * FROM border)"""


@query(
    "k4_dbscan",
    f"""WITH {DENSITY} SELECT p.id, CAST(coalesce(dense_rank() OVER (ORDER BY c) - 1, -1) AS INT) AS label FROM p JOIN lab USING (id)
    UNION ALL SELECT id, -1 FROM p WHERE id NOT IN (SELECT id FROM lab)""",
)
def k4(spark, sf):
    s = load(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.array(F.col("s_acctbal") / 1000, F.col("s_nationkey") / 4.0).alias("features")
    )
    return K.dbscan(s, "id", 0.6, 3)


@query("k4_dbscan_vectors")
def k4_vectors(spark, sf):
    return K.dbscan(vectors(spark, sf), "id", 1.1, 4)


@query("k5_dbscan_search")
def k5(spark, sf):
    return by_first_member(K.dbscan_search(blobs(spark, sf), "id")[0])


@query("k6_hierarchical")
def k6(spark, sf):
    return K.hierarchical(blobs(spark, sf), "id")[0].select("id", "label")


def squares(spark, sf):
    """Three separated squares, filled without repeats."""
    k = F.col("p_partkey")
    place = lambda seed: (k % 3) * 10.0 + F.pmod(F.xxhash64(k, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return load(spark, sf, "part").select(k.alias("id"), F.array(place(1), place(2)).alias("features"))


@query("k7_spectral")
def k7(spark, sf):
    return by_first_member(K.spectral(squares(spark, sf), "id", [2, 3, 4])[0])


@query("k8_cluster_all", BLOB_CLUSTERS)
def k8_all(spark, sf):
    return by_first_member(K.cluster_all(blobs(spark, sf), "id")[0])


@query(
    "k8_best_clustering",
    "SELECT arg_max(algorithm, silhouette) AS algorithm, round(max(silhouette), 6) AS silhouette FROM (SELECT c_mktsegment AS algorithm, avg(c_acctbal) / 10000 AS silhouette FROM customer GROUP BY 1)",
)
def k8(spark, sf):
    results = load(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("algorithm")).agg((F.avg("c_acctbal") / 10000).alias("silhouette"))
    return rounded(K.best_clustering(results), 6)


@query(
    "k9_cluster_sizes",
    "SELECT label, COUNT(*) AS size, round(COUNT(*) / (SELECT COUNT(*) FROM embeddings), 6) AS share FROM embeddings GROUP BY 1",
)
def k9(spark, sf):
    return rounded(K.cluster_sizes(load(spark, sf, "embeddings")), 6)


PROFILED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "k10_cluster_profile",
    "SELECT * EXCLUDE (zz), CAST(row_number() OVER (PARTITION BY label ORDER BY abs(zz) DESC, column_name) AS INT) AS rank, row_number() OVER (PARTITION BY label ORDER BY abs(zz) DESC, column_name) <= 2 AS is_top FROM ("
    + " UNION ALL ".join(
        f"SELECT l_linenumber AS label, '{c}' AS column_name, round(avg({c}), 4) AS cluster_mean, round(g, 4) AS global_mean, round((avg({c}) - g) / s, 6) AS z, (avg({c}) - g) / s AS zz "
        f"FROM lineitem, (SELECT avg({c}) AS g, stddev_samp({c}) AS s FROM lineitem) GROUP BY l_linenumber, g, s"
        for c in PROFILED
    )
    + ")",
)
def k10(spark, sf):
    out = K.cluster_profile(load(spark, sf, "lineitem").select(F.col("l_linenumber").alias("label"), *PROFILED), top=2)
    return rounded(out, 4, z=6)
