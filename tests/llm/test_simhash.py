import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lodestat.llm import simhash as S
from lodestat.llm.queries import QUERIES
from tests.conftest import SF

CAPS = {c: c + 32 for c in range(65, 91)}


def print_of(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(CAPS))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def roots(prints):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def brute(docs):
    docs = sorted(docs)
    prints = [print_of(t) for _, t in docs]
    return sorted((docs[i][0], f"{prints[i]:016x}", docs[r][0]) for i, r in enumerate(roots(prints)))


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in QUERIES["op5_simhash"](spark, SF).collect())
    assert got == brute(docs)
    assert any(r[0] != r[2] for r in got)


def test_edges(spark):
    texts = ["", None, " \t\n", "one", "One two", "a b c", "A  b\x0bc", "é É", "w " * 70000, "x y z " * 9, "x y z " * 10]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("x")).withColumn("fp", F.lit(1)).withColumn("first", F.lit(1)).withColumn("root", F.lit(1))
    assert sorted(tuple(r) for r in S.digest(S.near_duplicates(docs)).collect()) == brute(rows)
    assert S.near_duplicates(docs.limit(0)).count() == 0
    assert S.near_duplicates(docs.unionByName(docs)).count() == 2 * len(rows)


def test_links_of_crowded_buckets(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 6, dtype=np.int64).tolist()
    prints = set(base)
    for b in base:
        for _ in range(60):
            f = b
            for k in rng.integers(0, 64, rng.integers(1, 5)).tolist():
                f ^= (1 << k) if k < 63 else -(1 << 63)
            prints.add(f)
    prints = sorted(prints)
    want = {}
    for f, r in zip(prints, roots([p & 0xFFFFFFFFFFFFFFFF for p in prints])):
        want.setdefault(r, []).append(f)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    for bucket in (0, 3, 1000):
        found = {}
        for r in S.components(S.links(df, bucket)).collect():
            found.setdefault(r.root, []).append(r.node)
        assert sorted(sorted(x) for x in found.values()) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def test_segments_within_two_bits_share_an_index():
    code, rng = S.Golay(), np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 2000)
    sets = [set(r[r >= 0]) for r in code.indices(words)]
    assert {len(s) for s in sets} == {1, 6}
    for k in range(2):
        flip = (1 << rng.integers(0, 23, 2000)) | (1 << rng.integers(0, 23, 2000))
        other = [set(r[r >= 0]) for r in code.indices(words ^ flip)]
        assert all(a & b for a, b in zip(sets, other))
