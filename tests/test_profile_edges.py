"""Nulls, tokens, constants, single rows, ties and empty groups."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestat.operators import features as X
from lodestat.operators import metrics as M
from lodestat.operators import profile as P
from lodestat.operators import rules as R
from lodestat.plans.quantiles import exact_quantiles
from lodestat.sources import tables as S


def rows_by(df, key="column_name"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_null_tokens_count_as_null_but_stay_distinct_values(spark):
    df = spark.createDataFrame([("a",), (" N/A ",), ("",), (None,), ("nan",)], "t string")
    assert rows_by(P.null_profile(df))["t"]["n_null"] == 4
    assert rows_by(P.distinct_profile(df))["t"]["n_unique"] == 4
    assert [r.t for r in S.normalize_nulls(df).collect()].count(None) == 4


def test_constant_and_single_row(spark):
    df = spark.createDataFrame([(3.0, 1)], "x double, k long")
    row = rows_by(P.numeric_summary(df))["x"]
    assert (row["n"], row["std"], row["skew"], row["median"]) == (1, 0.0, 0.0, 3.0)
    same = spark.createDataFrame([(5.0,)] * 6, "x double")
    row = rows_by(P.numeric_summary(same))["x"]
    assert (row["std"], row["skew"], row["kurtosis"]) == (0.0, 0.0, 0.0)
    assert rows_by(P.cardinality_flags(same))["x"]["is_constant"]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    assert rows_by(P.null_profile(df))["x"]["n_null"] == 2
    assert rows_by(P.numeric_summary(df))["x"]["mean"] == 2.0


def test_all_null_column_profiles(spark):
    df = spark.createDataFrame([(None, None, 1), (None, None, 2)], "x double, t string, k long")
    got = rows_by(P.profile_table(df))
    assert got["x"]["n_unique"] == 0 and got["x"]["median"] is None
    assert got["t"]["avg_string_length"] is None and got["k"]["is_unique_id"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "x double, t string, d timestamp, b boolean")
    got = rows_by(P.profile_table(df))
    assert all(r["n_rows"] == 0 and r["fraction_null"] == 0.0 for r in got.values())
    assert R.is_ready(R.readiness_report(df, "x")).first()[0] is False


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [5.0] * 9 + [1.0], list(map(float, range(101))), [0.1 * i * i for i in range(57)]])
def test_exact_quantiles(spark, values):
    import numpy as np

    df = spark.createDataFrame([("g", v) for v in values] + [("h", 7.0)], "k string, v double")
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = rows_by(exact_quantiles(df, ["k"], "v", probs), "k")
    for name, p in probs.items():
        assert got["g"][name] == pytest.approx(np.quantile(values, p))
        assert got["h"][name] == 7.0


def test_top_value_ties_are_by_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "t string")
    assert [r.value for r in P.top_values(df, 2).orderBy("rank").collect()] == ["c", "a"]


def test_boolean_and_datetime_kinds(spark):
    df = spark.createDataFrame([(True, dt.datetime(2024, 1, d)) for d in (1, 2, 3)] + [(None, None)], "b boolean, d timestamp")
    assert rows_by(P.boolean_summary(df))["b"]["true_fraction"] == 1.0
    got = rows_by(P.datetime_summary(df, "2024-01-02 00:00:00"))["d"]
    assert got["date_frequency"] == "daily" and got["has_future_dates"] and got["date_range_days"] == 2


def test_unknown_category_is_all_zero(spark):
    train = spark.createDataFrame([("x",), ("y",)], "c string")
    test = spark.createDataFrame([("z",), ("x",), (None,)], "c string")
    got = [tuple(r) for r in X.one_hot(test, ["c"], train).collect()]
    assert got == [(0, 0), (1, 0), (0, 0)]


def test_unknown_metric_raises():
    with pytest.raises(ValueError):
        S.metric_sign("silly")


def test_null_keys_survive_joins(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, t long")
    out = X.frequency_encode(df, "k")
    assert sorted(r["k_freq"] for r in out.collect()) == pytest.approx([1 / 3, 2 / 3, 2 / 3])
    weights = X.class_weights(df, "k")
    assert weights.count() == 3


def test_csv_source(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id,v,t\n1,2.5,N/A\n2,,x\n")
    df = S.read_table(spark, str(path), null_tokens=("N/A",))
    assert dict(df.dtypes) == {"id": "int", "v": "double", "t": "string"}
    assert df.filter(F.col("t").isNull()).count() == 1


def test_mase_falls_back_to_mae_for_short_series(spark):
    df = spark.createDataFrame([("s", dt.datetime(2024, 1, d), float(d), d + 1.0) for d in (1, 2)], "k string, ts timestamp, a double, f double")
    assert M.mase(df, ["k"], 7).first()["mase"] == 1.0


def test_profile_reads_its_input_three_times(spark):
    rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            rows.add(b.num_rows)
            yield b

    df = spark.range(1000).selectExpr("id", "id % 7 / 2.0D AS x", "concat('t', id % 5) AS s", "timestamp_seconds(id * 86400) AS d", "id % 2 = 0 AS b")
    got = P.profile_table(df.mapInArrow(counted, df.schema), "2000-01-01").collect()
    assert len(got) == 5 and rows.value <= 3 * 1000
    few = spark.sparkContext.accumulator(0)
    rows = few
    P.profile_table(df.mapInArrow(counted, df.schema), parts=()).collect()
    assert few.value <= 2 * 1000
