"""Every registered query that has SQL gives the same rows as DuckDB."""

import math

import pytest

from lodestat.plans import registry
from tests.conftest import SF

registry.load_catalog()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    result = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(got.columns) == sorted(columns)
    assert canonical(got.collect(), got.columns) == canonical(result.fetchall(), columns)
