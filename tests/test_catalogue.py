"""Every keyspace query against its SQL on the smallest tables, and cases that the tables lack."""

import math
import os

import duckdb
import pytest

from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"


def _plain(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "~" if math.isnan(v) else repr(round(v, 6))
    return repr(round(float(v), 6)) if hasattr(v, "as_tuple") and "." in str(v) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    frame = catalogue.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(tuple(_plain(r[c]) for c in columns) for r in frame.collect())
    if name in catalogue.oracle_sql():
        found = duck.execute(catalogue.oracle_sql()[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert got == sorted(tuple(_plain(r[names.index(c)]) for c in columns) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
