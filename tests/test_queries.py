"""Every query with SQL against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from corvane.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def plain(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return [plain(y) for y in x]
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    return float(x) if isinstance(x, (int, float, np.number)) else x


def rows(frame):
    names = sorted(frame.columns)
    return sorted(repr([plain(x) for x in r]) for r in frame[names].itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLE_SQL[name])
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: TYPES.get(t, kinds.get(c)) for c, t in got.dtypes} == kinds
    assert rows(got.toPandas()) == rows(want.df())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
