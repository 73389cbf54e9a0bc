"""Small DataFrame helpers shared by operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def combine_one_row(*parts: DataFrame) -> DataFrame:
    """Merge one-row aggregates with distinct column names into one row.

    The rows are stacked (missing columns null) and folded with one global
    aggregate: no join at all.
    """
    from functools import reduce

    cols = [c for p in parts for c in p.columns]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols])
