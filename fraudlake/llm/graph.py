"""Connected components of an edge table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudlake.llm.common import written

MAX_STEPS = 60


def _nearest(edges: DataFrame) -> DataFrame:
    """Smallest neighbour of every left end."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long); the root is the smallest
    node of the component.

    Large star: a node hands its larger neighbours to the smallest node next to
    it; small star: it hands its smaller ones over. Both keep components and
    together reach stars in a number of steps that grows with the logarithm of
    the longest chain. Every step is a grouped minimum (combined before the
    shuffle) and a join back, written to shared storage.
    """
    e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                .distinct(), "edges")
    mark = None
    for _ in range(MAX_STEPS):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = _nearest(both).select(F.col("u").alias("a"), F.least("u", "m").alias("m"))
        large = both.join(m, both["u"] == m["a"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), "large-star")
        m = _nearest(large).select(F.col("u").alias("a"), "m")
        joined = large.join(m, large["u"] == m["a"])
        small = joined.select("u", F.col("m").alias("v")).unionByName(
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        e = written(small.distinct(), "small-star")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root")))
