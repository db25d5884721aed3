import hashlib
import re

from pyspark.sql import functions as F

from lodestat.llm import decontaminate as D
from lodestat.llm.queries import QUERIES
from tests.conftest import SF

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CAPS = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, window=10):
    words = lambda t: WORDS.findall((t or "").translate(CAPS))
    sets = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        if item is not None and n:
            sets.setdefault(str(item), set()).update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, wins in sets.items():
            n = len(next(iter(wins)))
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit.update(range(i, i + n))
                    found.add(item)
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_query_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = [tuple(r) for r in QUERIES["op7_benchmark_decontamination"](spark, SF).collect()]
    want = brute(docs, items)
    assert sorted(got, key=repr) == want
    assert any(r[5] for r in want)


DOCS = [
    (1, "A b c d e f g h i j k l"),
    (2, "x A-b  c,d e f g\nh i j"),
    (2, "x A-b  c,d e f g\nh i j"),
    (3, None),
    (4, ""),
    (5, "short Item here"),
    (None, "short item"),
    (6, "é日本 short item short item"),
    (7, "z " * 50000 + "a b c d e f g h i j " * 3),
]
ITEMS = [(1, "a b c d e f g h i j"), (1, "a b c d e f g h i j"), (2, "b c d e f g h i j k l"), (3, "short item"), (None, "z z"), (4, None), (5, " -- "), (20, "Short Item")]


def frames(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("item_id", F.lit(0)).withColumn("n", F.lit(1))
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("words", F.lit("x"))


def test_edge_cases_and_blocks(spark):
    docs, items = frames(spark)
    want = brute(DOCS, ITEMS)
    for size in (D.SET_BYTES, 200):
        got = D.digest(D.contamination(docs, items, set_bytes=size))
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_removal_and_empty_tables(spark):
    docs, items = frames(spark)
    kept = {r.doc_id for r in D.remove_documents(docs, items).collect()}
    assert kept == {3, 4}
    cut = {r.doc_id: r.text for r in D.remove_spans(docs, items).collect()}
    assert cut[1] == "" and cut[5] == " here" and cut[3] is None
    assert D.contamination(docs.limit(0), items).count() == 0
    assert D.remove_documents(docs, items.limit(0)).count() == len(DOCS)
