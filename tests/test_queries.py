"""Every registered query against its oracle on the smallest tables."""

import math

import duckdb
import pytest

from reviewlake.plans import evidence, publications, registry

SF = "/root/testdata/sf0.001"
assert evidence and publications


def shown(x):
    return None if x is None or isinstance(x, float) and math.isnan(x) else round(x, 9) if isinstance(x, float) else str(x)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("events", "documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(([shown(r[c]) for c in columns] for r in df.collect()), key=str)
    if name not in registry.ORACLES:
        assert got
        return
    found = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(([shown(dict(zip(names, r))[c]) for c in columns] for r in found.fetchall()), key=str)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
