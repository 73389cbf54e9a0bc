"""Plan properties that must hold for the registered queries: no cartesian
products or nested-loop joins, no row-at-a-time Python UDFs, and column
pruning down to the Parquet scan."""

import re

import pytest

from fraudlake.plans import QUERIES

from conftest import SF_SMALL


def _plan(spark, name):
    return QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_or_row_udf(spark, name):
    plan = _plan(spark, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan, f"{name}: {bad}"


@pytest.mark.parametrize("name,table_cols", [
    ("score_stats", {"l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"}),
    ("dedup_first", {"o_orderkey"}),
    ("age_retention", {"o_orderkey", "o_orderdate"}),
])
def test_scans_read_only_needed_columns(spark, name, table_cols):
    plan = _plan(spark, name)
    scans = re.findall(r"FileScan parquet [^\[]*\[([^\]]*)\]", plan)
    read = {c.split("#")[0] for s in scans for c in s.split(",")}
    assert read == table_cols


def test_retention_filter_reaches_the_scan(spark):
    plan = _plan(spark, "age_retention")
    assert "GreaterThanOrEqual(o_orderdate" in plan
