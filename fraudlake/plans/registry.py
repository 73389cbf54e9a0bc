"""Query registry: one Spark plan and (where SQL can say it) one DuckDB oracle.

``register`` stores a callable ``(spark, sf_dir) -> DataFrame`` under a key of
SURVEY section 2 and the equivalent DuckDB SQL. Floating columns listed in
``rounded`` are rounded to the same digits on both sides, so the comparison is
insensitive to summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudlake.session import ensure_checkpoint_dir
from fraudlake.sources.fixtures import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SURVEY_ID: dict[str, str] = {}


def dbl(x: float) -> str:
    """A DuckDB double literal equal to the Python float."""
    return f"cast('{x!r}' as double)"


def register(name: str, survey_id: str, sql: str | None = None,
             rounded: dict[str, int] | None = None, views: tuple[str, ...] = ()):
    """``views`` names fixture views that the oracle SQL reads (added as CTEs)."""
    rounded = dict(rounded or {})
    if sql is not None:
        sql = with_views(sql, *views)

    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # checkpoint() needs a folder; the cluster's setting wins, tests get one
            ensure_checkpoint_dir(spark)
            df = fn(spark, sf_dir)
            if rounded:
                df = df.select(*[F.round(F.col(c), rounded[c]).alias(c) if c in rounded
                                 else F.col(c) for c in df.columns])
            return df

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        SURVEY_ID[name] = survey_id
        if sql is not None:
            if rounded:
                rep = ", ".join(f"round({c}, {d}) as {c}" for c, d in rounded.items())
                ORACLE[name] = f"select * replace ({rep}) from (\n{sql}\n) q"
            else:
                ORACLE[name] = sql
        return run

    return deco
