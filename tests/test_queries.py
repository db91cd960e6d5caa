"""Every registered query of the engine's own operators against its SQL, on the smallest tables."""

import os

import pytest

from kumoji import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"align_benchmark"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canonical(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - SLOW))
def test_query(name, spark, duck):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = canonical(map(tuple, got.select(*(f"`{c}`" for c in columns)).collect()))
    if name in registry.ORACLES:
        want = duck.sql(registry.ORACLES[name])
        assert sorted(want.columns) == columns
        assert rows == canonical(want.select(*(f'"{c}"' for c in columns)).fetchall())


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
