"""Every registered query against its DuckDB oracle on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from fraudlake.plans import ORACLE, QUERIES
from fraudlake.sources.fixtures import TABLES

from conftest import SF_SMALL



def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v if v is None or isinstance(v, (int, str, bool)) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_is_registered_with_survey_id():
    from fraudlake.plans import SURVEY_ID
    assert set(SURVEY_ID) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
    assert len(QUERIES) >= 100


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() >= 1


# Spark type name -> DuckDB type name of the same values
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
         "array<double>": "DOUBLE[]", "array<bigint>": "BIGINT[]", "array<int>": "INTEGER[]"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    cols = sdf.columns
    stypes = dict(sdf.dtypes)
    srows = sdf.collect()
    rel = duck.sql(ORACLE[name])
    dtypes = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    res = duck.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(cols) == sorted(dcols)
    assert {c: TYPES.get(t, t) for c, t in stypes.items()} == dtypes
    key = sorted(cols)
    a = sorted((tuple(_norm(r[cols.index(c)]) for c in key) for r in srows), key=repr)
    b = sorted((tuple(_norm(r[dcols.index(c)]) for c in key) for r in drows), key=repr)
    assert a == b
