"""Every query with an oracle returns what the oracle returns."""

import decimal
import math

import duckdb
import pytest

from permrisk.plans import fitted, registry
from permrisk.plans.graph import TABLES


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 5)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


#: too few rows in the smallest tables for the branch that the oracle tells
LARGER = {"model_calibrated": "/root/testdata/sf0.01"}


def connected(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def oracle(sf):
    return connected(sf)


@pytest.mark.parametrize("name", [n for n, (_, sql) in registry.QUERIES.items() if sql])
def test_same_as_oracle(spark, sf, oracle, name):
    run, sql = registry.QUERIES[name]
    if name in LARGER:
        sf, oracle = LARGER[name], connected(LARGER[name])
    got = run(spark, sf)
    cursor = oracle.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(repr([plain(r[names.index(c)]) for c in sorted(names)]) for r in cursor.fetchall())
    assert sorted(repr([plain(r[c]) for c in sorted(names)]) for r in got.collect()) == want


@pytest.mark.parametrize("name", [n for n, (_, sql) in registry.QUERIES.items() if not sql and n not in fitted.QUERIES])  # those: tests/models
def test_rows_without_oracle(spark, sf, name):
    assert registry.QUERIES[name][0](spark, sf).count() > 0
