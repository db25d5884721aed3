import random

import numpy as np
from pyspark.sql import functions as F

from lodestat.llm import quality as Q
from lodestat.llm.queries import QUERIES
from tests.conftest import SF


def test_gradient():
    rng = np.random.default_rng(0)
    w, cuts, grades = rng.normal(size=6), np.array([-0.5, 0.7, 1.5]), rng.integers(0, 4, 9)
    owner, index = np.sort(rng.integers(0, 9, 40)), rng.integers(0, 6, 40)
    base, by_weight, by_cut = Q.loss_and_gradient(w, cuts, grades, owner, index)
    for k in range(6):
        e = np.eye(6)[k] * 1e-6
        assert abs((Q.loss_and_gradient(w + e, cuts, grades, owner, index)[0] - base) / 1e-6 - by_weight[k]) < 1e-3
    for k in range(3):
        e = np.eye(3)[k] * 1e-6
        assert abs((Q.loss_and_gradient(w, cuts + e, grades, owner, index)[0] - base) / 1e-6 - by_cut[k]) < 1e-3


def corpus(n, seed):
    r, rows = random.Random(seed), []
    for i in range(n):
        grade = r.randrange(3)
        words = [f"w{r.randrange(300)}" for _ in range(r.randint(5, 60))]
        for _ in range(2 - grade):
            words.insert(r.randrange(len(words)), r.choice(["vile", "awful", "nasty"]) if grade == 0 else r.choice(["meh", "dull"]))
        rows.append((i, " ".join(words), grade))
    return rows


def test_held_out_accuracy(spark):
    rows = spark.createDataFrame(corpus(1500, 1), "doc_id long, text string, grade int").withColumn("__x", F.lit(1))
    model = Q.fit(rows.filter("doc_id % 4 > 0"), rows, F.col("grade"), 3)
    assert np.all(np.diff(model.thresholds) > 0)
    got = Q.score(rows.filter("doc_id % 4 = 0"), model, 2).collect()
    assert np.mean([round(r["__expected"]) == r.grade for r in got]) > 0.95
    assert np.mean([(r["__tail"] > 0.5) == (r.grade == 2) for r in got]) > 0.97


def test_edges(spark):
    texts = [(1, "fine words here"), (2, "vile words"), (3, None), (4, ""), (4, ""), (None, "fine"), (5, "x" * 200000 + " y" * 30000), (6, "!!! ### 日本")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("grade", F.lit("g")).withColumn("id", F.lit(0))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 1), (3, None, 0), (9, 1, 0), (None, 1, 1), (4, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    got = Q.digest(Q.graded(docs, labels, steps=5)).collect()
    assert len(got) == len(texts) and all(0 <= r.p_top <= 1 and 0 <= r.expected_grade <= 2 for r in got)
    for none in (labels.limit(0), labels.filter("doc_id = 1")):
        assert {(r.expected_grade, r.p_top, r.keep) for r in Q.digest(Q.graded(docs, none)).collect()} == {(None, None, True)}
        assert Q.select(docs, none).count() == len(texts)
    assert Q.graded(docs.limit(0), labels).count() == 0


def test_query(spark):
    got = QUERIES["op10_quality_classifier"](spark, SF)
    assert got.columns == ["doc_id", "expected_grade", "p_top", "keep"]
    labels = {r.doc_id: r.quality == 1 and r.toxic == 0 for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = got.collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert np.mean([r.keep == labels[r.doc_id] for r in rows if r.doc_id in labels]) > 0.9
