import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestat.llm import linededup as L


def brute(rows, min_lines, long_line, long_words):
    """Kept texts, in row order; rows are (id, text)."""
    seqs = []
    for k, (doc, text) in enumerate(rows):
        lines = [] if text is None else text.split("\n")
        seqs.append((doc is None, doc or 0, k, [i for i, x in enumerate(lines) if x.strip(" ")], lines))
    first, gone = {}, defaultdict(set)
    for _, _, k, at, lines in sorted(seqs, key=lambda s: s[:3]):
        own = [lines[i] for i in at]
        for p in range(len(own)):
            for n, ok in ((min_lines, True), (1, len(own[p]) >= long_line or len([w for w in own[p].split(" ") if w]) >= long_words)):
                if ok and p + n <= len(own):
                    key = tuple(own[p : p + n])
                    if first.setdefault((n, key), (k, p)) != (k, p):
                        gone[k].update(range(p, p + n))
    out = []
    for _, _, k, at, lines in seqs:
        cut = {at[p] for p in gone[k]}
        kept = [x for i, x in enumerate(lines) if i not in cut]
        text = "\n".join(kept)
        out.append(None if rows[k][1] is None else rows[k][1] if not cut else "" if not text.replace("\n", "").strip(" ") else text)
    return out


def check(spark, rows, min_lines=2, long_line=250, long_words=20):
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, pos int").coalesce(1)
    docs = docs.withColumn("row", F.lit("r")).withColumn("__row", F.lit(0)).withColumn("c", F.lit(0))
    got = L.deduplicate(docs, min_lines=min_lines, long_line=long_line, long_words=long_words)
    assert got.columns == docs.columns
    assert [r.text for r in sorted(got.collect(), key=lambda r: r.pos)] == brute(rows, min_lines, long_line, long_words)


@pytest.mark.parametrize("min_lines", [1, 2, 3, 5])
def test_random(spark, min_lines):
    r = random.Random(min_lines)
    rows = [(i, "\n".join(r.choice(["a", "b", "c", "d", " ", ""]) for _ in range(r.randint(0, 14)))) for i in range(60)]
    check(spark, rows, min_lines)


def test_edges(spark):
    long = "x" * 300
    rows = [(5, "a\nb"), (1, "a\nb"), (1, "a\nb"), (None, "a\nb\nz"), (2, None), (3, ""), (4, "\n\n"), (6, long), (7, f"q\n{long}\n\nr"), (8, "h\n" * 5000), (9, "h"), (10, "日本\né\na"), (11, "日本\né")]
    check(spark, rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert L.report(docs.limit(0)).count() == 0 and L.deduplicate(docs.limit(0)).count() == 0
    assert L.report(docs).count() == len(rows)


def test_hot_line_and_copies(spark):
    rows = [(i, "hot\nhot") for i in range(400)] + [(1000 + i, f"u{i}\nhot\nv{i}") for i in range(300)]
    check(spark, rows)


def test_very_many_lines(spark):
    """Two equal texts of very many lines and one that shares every other line: linear in the lines."""
    import time

    lines = [f"line {k}" for k in range(200_000)]
    rows = [(1, "\n".join(lines)), (2, "\n\n".join(lines)), (3, "\n".join(x for k, x in enumerate(lines) if k % 4 < 2)), (4, "other\ntext")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    start = time.time()
    got = {r.doc_id: r for r in L.report(docs).collect()}
    assert (got[2].n_lines, got[2].n_removed, got[2].n_runs, got[2].longest_run) == (200_000, 200_000, 1, 200_000)
    assert (got[3].n_removed, got[4].n_removed) == (100_000, 0) and got[1].n_removed == 0
    cut = {r.doc_id: r.text for r in L.deduplicate(docs).collect()}
    assert cut[2] == "" and cut[3] == "" and cut[1] == rows[0][1]
    assert time.time() - start < 120


def test_single_lines_by_words(spark):
    passage = " ".join(["to"] * 25)
    rows = [(i, f"a{i}\n{passage}\nb{i}\n{' '.join(['to'] * 19)}") for i in range(5)]
    check(spark, rows)
    check(spark, [(i, f"u{i}\nw {i // 2} x\nw {i // 2} x y\nz{i}\nw 0 x\nv") for i in range(8)], min_lines=3, long_words=3)


@pytest.mark.parametrize("min_lines", [1, 2, 3])
def test_runs_against_brute_force(spark, min_lines):
    """Every run equals its source, which comes before, for exactly its length, and does not go on to the left with it."""
    r = random.Random(min_lines)
    base = [[r.choice("abcdef") + str(r.randint(0, 30)) for _ in range(40)] for _ in range(4)]
    texts = []
    for _ in range(40):
        one, two = r.choice(base), r.choice(base)
        k, j = r.randint(0, 39), r.randint(0, 39)
        texts.append(one[k : k + r.randint(1, 30)] + two[j : j + r.randint(0, 30)])
    texts.append(["p"] * 50)
    docs = spark.createDataFrame([(i, "\n".join(x)) for i, x in enumerate(texts)], "doc_id long, text string").coalesce(1)
    lines = L.sequences(docs.withColumn("__row", F.col("doc_id")), "doc_id", "text")
    seen = {}
    for row, own in enumerate(texts):
        for p in range(len(own)):
            for n in range(min_lines, len(own) - p + 1):
                seen.setdefault(tuple(own[p : p + n]), (row, p))
    covered = set()
    for run in L.copied_runs(lines, min_lines).collect():
        one, two = texts[run.row][run.pos :], texts[run.first_row][run.first_pos :]
        n = next((k for k, (x, y) in enumerate(zip(one, two)) if x != y), min(len(one), len(two)))
        assert run.length == n >= min_lines and (run.first_row, run.first_pos) < (run.row, run.pos)
        covered |= {(run.row, run.pos + k) for k in range(n)}
    want = set()
    for row, own in enumerate(texts):
        for p in range(len(own) - min_lines + 1):
            if seen[tuple(own[p : p + min_lines])] != (row, p):
                want |= {(row, p + k) for k in range(min_lines)}
    assert covered == want
