"""Physical plans: no window over everything, no Python in SQL operators, bounded ranks before shuffles."""

import re

import pytest

from lodestat.operators import profile as P
from lodestat.operators import series as S
from lodestat.operators import series_features as F2
from lodestat.plans.fixtures import orders_daily
from lodestat.sources.tables import load
from tests.conftest import SF


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


KEYED = {
    "trend": lambda d: S.trend(d, ["series"]),
    "acf": lambda d: S.acf(d, ["series"]),
    "lags": lambda d: F2.lag_features(d, ["series"], [1, 7]),
    "rolling": lambda d: F2.rolling_features(d, ["series"], [7]),
    "frequency": lambda d: S.detect_frequency(d, ["series"]),
    "interpolate": lambda d: F2.interpolate(d, ["series"]),
    "decompose": lambda d: S.decompose(d, ["series"]),
}


@pytest.mark.parametrize("name", KEYED)
def test_keyed_operators_stay_keyed_and_native(spark, name):
    text = plan(KEYED[name](orders_daily(spark, SF)))
    assert "SinglePartition" not in text
    assert "Python" not in text and "InPandas" not in text


def test_row_windows_never_partition_by_the_series_alone(spark):
    text = plan(F2.rolling_features(orders_daily(spark, SF), ["series"], [7]))
    specs = re.findall(r"windowspecdefinition\(([^)]*)\)", text)
    wide = [s for s in specs if "__chunk" not in s and "__block" not in s]
    # Totals per series run over the chunk table, one row per chunk, not over the data rows.
    assert wide == [] or all("series" in s for s in wide)
    assert any("__block" in s for s in specs)


def test_top_values_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(P.top_values(load(spark, SF, "part"), 5))


def test_profile_reads_only_needed_columns(spark):
    text = plan(P.string_lengths(load(spark, SF, "documents").select("lang", "source")))
    assert "ReadSchema: struct<lang:string,source:string>" in text
