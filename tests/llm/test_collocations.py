import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestat.llm import collocations as C


def brute(rows, least=10, top=2000, share=50):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, out = defaultdict(Counter), []
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for n in (1, 2, 3):
                f["und" if lang is None else lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    for lang, c in f.items():
        n, found = sum(v for k, v in c.items() if len(k) == 1), []
        long = {k: v for k, v in c.items() if len(k) > 1 and v >= least}
        for k, a in long.items():
            if any(len(t) > len(k) and any(t[i : i + len(k)] == k for i in range(len(t) - len(k) + 1)) and 100 * v >= share * a for t, v in long.items()):
                continue
            score, _, l, r = min((10**6 * a * a // (c[k[:i]] * c[k[i:]]), i, c[k[:i]], c[k[i:]]) for i in range(1, len(k)))  # noqa: E741
            found.append((-score, -a, " ".join(k).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):  # noqa: E741
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def held(spark, rows, **options):
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("f", F.lit(1)).withColumn("w1", F.lit("x"))
    got = C.mine(docs, **options)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, **{k: v for k, v in options.items() if k in ("least", "top", "share")})


WORDS = ["New", "york", "the", "of", "a\x01b", "a", "é", "日本", "it's", "CITY", "\xa0", "-"]


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed):
    r = random.Random(seed)
    marks = [" ", " ", "  ", "\t", ". ", ",", "\n", " ? "]
    rows = []
    for _ in range(150):
        text = "".join(r.choice(WORDS) + r.choice(marks) for _ in range(r.randint(0, 30)))
        rows.append((r.choice(["en", None, ""]), text + "new york city" * r.randint(0, 2)))
    held(spark, rows + rows[:30] + [("en", None), ("fr", ""), ("de", ".,;")])


def test_one_hot_phrase_and_few_ranges(spark):
    r = random.Random(9)
    rows = [("en", "the " + " the ".join(r.choices("abcdefghijklmnop", k=20))) for _ in range(200)] + [("en", "hot cold")] * 500
    held(spark, rows)
    held(spark, rows, top=7)


def test_a_full_filter_changes_nothing(spark):
    r = random.Random(4)
    held(spark, [("en", " ".join(r.choices("abcdefgh", k=40))) for _ in range(60)], bits=1 << 15)


def test_empty_table(spark):
    assert C.mine(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_slices_keep_every_phrase():
    r = random.Random(2)
    text = "".join(r.choice(["ab", "c", "d" * 30, "e"]) + r.choice([" ", "\xff", "  ", " \xff"]) for _ in range(300)).encode("latin-1")
    for n in (1, 2, 3):
        for size in (20, 50, 200):
            total = Counter()
            for part in C.slices(text, size, n):
                for piece in part.split(b"\xff"):
                    w = piece.split()
                    total.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
            want = Counter()
            for piece in text.split(b"\xff"):
                w = piece.split()
                want.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
            assert total == want


def test_very_long_text(spark):
    held(spark, [("en", "deep blue sea " * 200_000 + "z" * 1_000_000)])
