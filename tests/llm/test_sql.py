"""Corpus queries that have SQL give the same rows as DuckDB."""

import pytest

from lodestat.llm.queries import ORACLES, QUERIES
from tests.conftest import SF
from tests.test_oracle import canonical


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(got.columns) == sorted(columns)
    assert canonical(got.collect(), got.columns) == canonical(result.fetchall(), columns)
