import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestat.llm import divergence as D


def brute(rows, least=10, ranks=10):
    """rows: (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [(a, s, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(lower))) for a, s, t in rows]
    docs, counts, out = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, ts in words:
        docs[lang].update(set(ts))
        counts[lang, source].update(ts)
    for lang in {r[0] for r in words}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        groups = sorted(s for a, s in counts if a == lang)
        total = Counter()
        for s in groups:
            total.update(counts[lang, s])

        def shares(c):
            n = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // n for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in groups}, shares(total)
        price = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = [(-sum(price(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s]
            terms = [(-price(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, top in (("pair", pairs, None), ("term", terms, ranks)):
                out |= {(lang, s, part, o, -v, k) for k, (v, _, o) in enumerate(sorted(found)[:top], 1)}
    return out


def held(spark, rows, **options):
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("term", F.lit(1)).withColumn("n", F.lit("x"))
    got = D.audit(docs, **options).collect()
    want = brute(rows, options.get("least", 10))
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_groups_nulls_and_texts_without_terms(spark):
    r = random.Random(3)
    vocabulary = ["alpha", "Beta", "gämma", "δ", "日本", "x1y", "it's", "ÄÖ", "tail"]
    rows = [(r.choice(["en", None, "de"]), r.choice(["a", "b", "c", None, "é"]), " ".join(r.choices(vocabulary, k=r.randint(0, 12)))) for _ in range(150)]
    rows += [("en", "empty", None), ("en", "empty", ""), ("zz", "a", "rare words"), ("zz", "b", "12 34"), ("one", "only", "alpha " * 5)] + rows[:20]
    held(spark, rows)


def test_many_sources_in_tiles(spark):
    r = random.Random(5)
    rows = [("en", f"s{k}", " ".join(r.choices("abcdefghij", k=30))) for k in range(23) for _ in range(2)]
    rows += [("en", "s0", " ".join(r.choices("abcdefghij", [40, 1, 1, 1, 1, 1, 1, 1, 1, 1], k=50)))] * 300
    held(spark, rows, tile=4)


def test_a_full_filter_changes_nothing(spark):
    rows = [("en", "ab"[k % 2], "word other " + "q" * (k % 5 + 1)) for k in range(40)]
    held(spark, rows, bits=1 << 15)


def test_empty_table(spark):
    assert D.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_very_long_text(spark):
    held(spark, [("en", "a", "Deep " * 300_000 + "z" * 2_000_000)] + [("en", "b", "deep sea")] * 10)


@pytest.mark.parametrize("seed", range(40))
def test_gallop_and_shares(seed):
    r = np.random.default_rng(seed)
    hay = np.unique(r.integers(0, 500, r.integers(1, 200)))
    needles = np.unique(r.integers(0, 500, r.integers(0, 60)))
    assert (D.gallop(needles, hay) == np.searchsorted(hay, needles)).all()
    counts = r.integers(0, 1 << 40, 50)
    total = int(counts.sum() + 100)
    assert D.shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 2) // total for c in counts]
