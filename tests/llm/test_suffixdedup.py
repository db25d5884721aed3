import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestat.llm import suffixdedup as S
from lodestat.llm.queries import QUERIES
from tests.conftest import SF


def brute(rows, length=200):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(t)))
        out.append((d, len(t), int(gone.sum()), int(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    assert got(QUERIES["op8_suffix_dedup"](spark, SF)) == want
    assert any(r[2] for r in want)


@pytest.mark.parametrize("bucket", [3, 4000])
def test_random_edits(spark, bucket, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_RUNS", bucket)
    r = random.Random(bucket)
    rows, base = [], ["".join(r.choice("abcdé ") for _ in range(400)) for _ in range(6)]
    for i in range(60):
        t = "".join(r.choice("abcd ") for _ in range(r.randint(0, 80)))
        for _ in range(r.randint(0, 3)):
            b = r.choice(base)
            x = r.randint(0, 200)
            piece = list(b[x : x + r.randint(20, 300)])
            for _ in range(r.randint(0, 2)):
                piece[r.randrange(len(piece))] = "X"
            t += "".join(piece) + "".join(r.choice("abcd ") for _ in range(r.randint(0, 80)))
        rows.append((i, t))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(S.digest(S.deduplicate(docs))) == brute(rows)


def test_edges(spark):
    hot = "This very common line stands in a third of all texts, word for word, each time."
    r = random.Random(3)
    noise = lambda n: "".join(chr(r.randint(97, 122)) for _ in range(n))
    rows = [(1, None), (2, ""), (3, "a" * 199), (4, "b" * 200), (5, "c" * 201), (6, "c" * 50), (7, "xyz" * 3000), (None, "é" * 300), (8, "日本" * 40)]
    rows += [(9, noise(500))] * 2 + [(10, noise(100))] * 2 + [(100 + i, noise(150) + hot + noise(150)) for i in range(150)]
    rows += [(300 + i, noise(150) + hot * 3 + noise(150)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("a", F.lit("a"))
    assert got(S.digest(S.deduplicate(docs))) == brute(rows)
    assert S.deduplicate(docs.limit(0)).count() == 0
