"""Helpers shared by the text operators: table reads, written intermediates,
word and line expressions, and range buckets over a sort key."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudlake.session import scratch_path

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"            # the class [\x20\x09-\x0D]
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """``df`` written as Parquet to the shared scratch folder and read back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    path = scratch_path(df.sparkSession, name)
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, all other characters as they are."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """Maximal runs outside [\\x20\\x09-\\x0D]; null gives an empty array."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACE_RUN), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def at_most_count(x: Column, bounds: list) -> Column:
    """How many of the sorted ``bounds`` are <= ``x``: a block of about
    sqrt(n) bounds is picked first, then searched, so the cost per row is
    2 sqrt(n) comparisons and the expression stays small for any n."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    top, every = F.lit(bounds[step - 1::step]), F.lit(bounds)
    blocks = F.size(F.filter(top, lambda b: b <= x))
    rest = F.size(F.filter(F.slice(every, blocks * step + 1, F.lit(step)), lambda b: b <= x))
    return blocks * step + rest


def id_bounds(df: DataFrame, col: str, buckets: int) -> list[int]:
    """Up to ``buckets - 1`` cut values of an integer column (approximate
    quantiles; only their number is fixed, it follows the shuffle partitions)."""
    cuts = [i / buckets for i in range(1, buckets)]
    if not cuts:
        return []
    got = df.agg(F.percentile_approx(col, cuts, max(10_000, 20 * buckets))).first()[0]
    return sorted(set(got or []))


def set_aside(docs: DataFrame, own: list[str]):
    """``docs`` with every column outside ``own`` under a neutral name, and the function
    that undoes it, with added columns behind (in place of own ones of those names):
    columns an operator adds cannot clash with extra ones."""
    names = {c: f"_extra{i}" for i, c in enumerate(docs.columns) if c not in own}

    def back(out: DataFrame, *added: str) -> DataFrame:
        kept = [F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns if c not in added]
        return out.select(*kept, *added)

    return docs.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in docs.columns]), back
