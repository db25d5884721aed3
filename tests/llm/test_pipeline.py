import random

import pytest

import corpus_pipeline as P
from lodestat.llm import simhash as S
from lodestat.llm.common import stored, table
from tests.conftest import SF
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_linededup import brute as cut_lines
from tests.llm.test_packing import held
from tests.llm.test_simhash import brute as brute_prints


@pytest.fixture(scope="module")
def steps(spark):
    """Input and output of each stage."""
    docs, out = table(spark, SF, "documents"), []
    for name, stage in P.STAGES:
        docs = stored(stage(spark, docs, SF), "t")
        out.append(docs)
    return [table(spark, SF, "documents"), *out]


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(steps):
    assert all(d.columns == steps[0].columns for d in steps[:-1])


def test_quality(spark, steps):
    kept, labels = set(rows(steps[1])), spark.read.parquet(f"{SF}/labels.parquet").collect()
    good = {r.doc_id for r in labels if r.quality == 1 and r.toxic == 0}
    bad = {r.doc_id for r in labels} - good
    assert len(good & kept) > 0.97 * len(good) and len(bad & kept) < 0.3 * len(bad)


def test_line_dedup(steps):
    before, after = sorted(rows(steps[1]).items()), rows(steps[2])
    want = cut_lines([(d, r.text) for d, r in before], 2, 250, 20)
    for (d, r), text in zip(before, want):
        if text == "" and r.text != "":
            assert d not in after
        else:
            assert after[d].text == text and after[d].n_chars == len(text)


def firsts(docs):
    """Ids that stay of (id, text)."""
    return {int(c) for _, _, c in brute_prints(docs)}


def test_near_dedup(steps):
    before, after = [(d, r.text) for d, r in rows(steps[2]).items()], set(rows(steps[3]))
    assert after == firsts(before)


def test_decontamination(spark, steps):
    before = [(d, r.text) for d, r in rows(steps[3]).items()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(rows(steps[4])) == {r[0] for r in leaks(before, items) if not r[5]}


def test_packing(steps):
    held(steps[5].collect(), [(d, r.text) for d, r in rows(steps[4]).items()])


def test_run_is_the_stages(spark, steps):
    key = lambda r: (r.doc_id, r.piece, r.length, r.ids_crc32)
    assert sorted(map(key, P.run(spark, SF).collect())) == sorted(map(key, steps[5].collect()))


def test_near_dedup_keeps_one_row_of_each_group(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(200)]
    texts = [" ".join(base[:k] + [word()] + base[k + 1 :]) for k in range(40)] + [" ".join(base)] * 30
    texts += [" ".join(word() for _ in range(120)) for _ in range(50)] + ["", None, "", "One two", "one  TWO", "x y z w"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("row", P.F.lit(1)).withColumn("id", P.F.lit("i"))
    kept = sorted(x.doc_id for x in S.keep_first(docs).collect())
    assert kept == sorted(firsts(list(enumerate(texts))))
    assert S.keep_first(docs.limit(0)).count() == 0
    assert S.keep_first(docs.unionByName(docs)).count() == len(kept)
    assert S.keep_first(docs.withColumn("doc_id", P.F.lit(None).cast("long"))).count() == len(kept)


ODD = {"row": 1, "id": "i", "root": 2.0, "__row": 3, "__text": "t", "term": 4, "length": 5, "__fp": 6, "key": "k", "n": 7, "line": "l", "pos": 8}


def test_all_stages_on_odd_tables(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, extra columns with clashing names, and no rows at all."""
    folder = str(tmp_path)
    for name in ("labels", "benchmark"):
        table(spark, SF, name).write.parquet(f"{folder}/{name}.parquet")
    own = table(spark, SF, "documents")
    long = " ".join(f"word{k}" for k in range(120_000)) + "\nline\n" * 3
    made = spark.createDataFrame(
        [(-1, None, None, None, None), (-2, "", "en", "s", 0), (None, "good plain text", None, None, 15), (-3, long, "en", "s", len(long)), (-4, " \n\n ", "", "", 4)],
        own.schema,
    )
    docs = own.unionByName(own.limit(40)).unionByName(made)
    for name, value in ODD.items():
        docs = docs.withColumn(name, P.F.lit(value))
    for odd in (docs, docs.limit(0)):
        path = f"{folder}/documents-{odd is docs}"
        odd.write.parquet(path)
        step = spark.read.parquet(path)
        before = step.columns
        for k, (_, stage) in enumerate(P.STAGES):
            step = stored(stage(spark, step, folder), "odd")
            assert k == 4 or step.columns == before
            if k == 2 and odd is docs:
                ids = [r.doc_id for r in step.select("doc_id").collect()]
                assert len(ids) == len(set(ids))
        assert (step.count() > 0) == (odd is docs)
