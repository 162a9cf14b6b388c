"""Every registered query of the engine against its SQL."""

import math

import pytest

from voxelarium import registry


def norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    if isinstance(x, (list, tuple)):
        return tuple(norm(y) for y in x)
    if isinstance(x, dict):
        return tuple(norm(y) for y in x.values())
    return x


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, sf, duck):
    df = registry.QUERIES[name](spark, sf)
    rows = df.collect()
    assert rows
    if name in registry.ORACLES:
        r = duck.sql(registry.ORACLES[name])
        assert sorted(r.columns) == sorted(df.columns)
        want = sorted((norm(tuple(x)) for x in r.fetchall()), key=repr)
        assert sorted((norm(tuple(x[c] for c in r.columns)) for x in rows), key=repr) == want


def test_oracles_name_queries():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
