from lodestat.llm import rollup as R

SCHEMA = "source string, lang string, version string, tokens long, old long"


def totals(r):
    return sorted((tuple(x) for x in r.totals().collect()), key=repr)


def test_batches(spark, tmp_path):
    r = R.Rollup(spark, str(tmp_path / "r"))
    assert totals(r) == []
    a = spark.createDataFrame([("s", "en", "v1", 5, 3), ("s", "en", "v1", 7, 7), (None, None, "v1", None, 0), ("t", "fr", "v1", 2, 2)], SCHEMA)
    assert r.commit("1", R.inserted(a, "old")) and not r.commit("1", R.inserted(a))
    assert totals(r) == sorted([("s", "en", "v1", 10, 2), (None, None, "v1", 0, 1), ("t", "fr", "v1", 2, 1)], key=repr)
    assert r.commit("2", R.revised(a, "old", "tokens"))
    assert r.commit("3", R.deleted(a.filter("source = 't'")))
    want = sorted([("s", "en", "v1", 12, 2), (None, None, "v1", 0, 1)], key=repr)
    assert totals(r) == want
    assert r.commit("4", R.inserted(a.limit(0))) and totals(r) == want
    c = r.compact(str(tmp_path / "c"))
    assert totals(c) == want and not c.commit("2", R.inserted(a))


def test_failed_batch_is_retried(spark, tmp_path):
    r = R.Rollup(spark, str(tmp_path / "r"))
    a = spark.createDataFrame([("s", "en", "v1", 5, 3)], SCHEMA)
    a.write.parquet(str(tmp_path / "r" / "batch=1"))
    (tmp_path / "r" / "batch=1" / "_SUCCESS").rename(tmp_path / "lost-mark")
    assert totals(r) == []
    assert r.commit("1", R.inserted(a)) and totals(r) == [("s", "en", "v1", 5, 1)]


def test_token_counts(spark):
    texts = [None, "", "a b-c\n", "é日 x1", "w " * 10000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select(*[R.token_count(df.text, v) for v in R.VERSIONS]).collect()
    assert [tuple(r) for r in got] == [(0, 0), (0, 0), (2, 3), (2, 2), (10000, 10000)]


def test_compact_is_safe_on_retry_and_beside_new_batches(spark, tmp_path):
    r = R.Rollup(spark, str(tmp_path / "r"))
    a = spark.createDataFrame([("s", "en", "v1", 5, 3)], SCHEMA)
    r.commit("1", R.inserted(a))
    c = r.compact(str(tmp_path / "c"))
    r.commit("2", R.inserted(a))
    again = r.compact(str(tmp_path / "c"))
    for x in (c, again, R.Rollup(spark, str(tmp_path / "c"))):
        assert totals(x) == [("s", "en", "v1", 5, 1)]
        assert not x.commit("1", R.inserted(a))
    assert again.commit("2", R.inserted(a)) and not again.commit("2", R.inserted(a))
    assert totals(again) == [("s", "en", "v1", 10, 2)]
    twice = again.compact(str(tmp_path / "d"))
    assert totals(twice) == [("s", "en", "v1", 10, 2)] and not twice.commit("1", R.inserted(a)) and not twice.commit("2", R.inserted(a))
    empty = R.Rollup(spark, str(tmp_path / "e")).compact(str(tmp_path / "f"))
    assert totals(empty) == []
