"""Contiguous balanced shards from global byte-size prefix sums.

Documents in ascending id order are laid on one line of bytes; equal cuts of
that line give the shards. The running sum is built in two levels: sums inside
range buckets of the id, plus the totals of all earlier buckets. Only the
bucket totals (a number that follows the shuffle partitions) meet in one
place; every row-level step is distributed and carries ids and sizes, no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudlake.llm.common import at_most_count, id_bounds, shuffle_partitions, written


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size (UTF-8 bytes plus 1) and CRC-32 of the text; null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"),
                       (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
                       F.crc32(F.encode(text, "UTF-8")).alias("crc"))


def assign_shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Law ``bytes``: id, size, crc, shard (0 .. n_shards-1), slot, start byte.

    A document goes to the shard that holds the middle of its byte span, so
    every cut lies within half a document of the equal target and shards are
    contiguous in ascending id order. ``slot`` counts from 0 in that order.
    Rows that repeat an id are separate rows ordered by (size, crc); null ids
    come first. An empty table gives no rows. Shards can stay empty when there
    are fewer documents than shards or one document spans several targets.
    """
    narrow = written(sized(docs, id_col, text_col), "shard-sizes")
    buckets = 4 * shuffle_partitions(docs.sparkSession)
    bounds = id_bounds(narrow, "id", buckets)
    narrow = narrow.withColumn("bucket", F.coalesce(at_most_count(F.col("id"), bounds), F.lit(0)))

    # per-partition totals -> offsets: at most `buckets` rows, hence one small window
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = narrow.groupBy("bucket").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    everything = Window.partitionBy()
    offsets = totals.select("bucket",
                            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte_offset"),
                            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row_offset"),
                            F.sum("bytes").over(everything).alias("total"))
    inside = Window.partitionBy("bucket").orderBy(F.col("id").asc_nulls_first(), "size", "crc") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = narrow.select("*", F.sum("size").over(inside).alias("upto"),
                           F.count("*").over(inside).alias("nth")) \
        .join(F.broadcast(offsets), "bucket")
    # twice the middle of the byte span keeps the cut in exact integers
    placed = placed.select(
        "id", "size", "crc", (F.col("byte_offset") + F.col("upto") - F.col("size")).alias("start"),
        (F.col("row_offset") + F.col("nth") - 1).alias("row"),
        F.least(F.lit(n_shards - 1), F.expr(
            f"cast(((2 * (byte_offset + upto) - size) * {n_shards}) div (2 * total) as int)"))
        .alias("shard"))
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))    # n_shards rows
    return placed.join(F.broadcast(firsts), "shard") \
        .select("id", "size", "crc", "start", "shard", (F.col("row") - F.col("first_row")).alias("slot"))


def shard_of(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The shard of every row of ``docs`` as an expression over its columns.

    Shards are ranges of (id, size, crc), so the at most ``n_shards`` first rows of the
    shards decide; nothing is joined. Rows that equal such a first row can belong to
    several shards: they are interchangeable and dealt over these at random, in
    proportion to the rows that each takes.
    """
    key = ["id", "size", "crc"]
    placed = written(assign_shards(docs, n_shards, id_col, text_col), "shards")
    first = placed.where(F.col("slot") == 0).select(*[F.col(c).alias(f"first_{c}") for c in key]).distinct()
    same = F.col("id").eqNullSafe(F.col("first_id"))
    for c in key[1:]:
        same = same & (F.col(c) == F.col(f"first_{c}"))
    ties: dict[tuple, list[tuple[int, int]]] = {}
    for r in placed.join(F.broadcast(first), same).groupBy(*key, "shard").count().orderBy("shard").collect():
        ties.setdefault((r["id"], r["size"], r["crc"]), []).append((r["shard"], r["count"]))

    types = {c: t for c, t in placed.dtypes}
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own = F.struct(F.col(f"`{id_col}`").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                   F.crc32(F.encode(text, "UTF-8")).alias("crc"))
    chance = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30)) / F.lit(float(1 << 30))
    out = F.lit(0)
    for values, shares in sorted(ties.items(), key=lambda x: (x[1][0][0], x[1][-1][0])):
        bound = F.struct(*[F.lit(v).cast(types[c]).alias(c) for c, v in zip(key, values)])
        rows, pick = sum(n for _, n in shares), F.lit(shares[-1][0])
        for shard, _ in reversed(shares[:-1]):
            upto = sum(n for s, n in shares if s <= shard)
            pick = F.when(chance < upto / rows, shard).otherwise(pick)
        out = F.when(own == bound, pick).when(own > bound, shares[-1][0]).otherwise(out)
    return out.cast("int")


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Write ``docs`` as one folder per shard (``shard=k``, in place of a column of that
    name), every row once, files in id order. A shard is written by several tasks."""
    tasks = max(n_shards, shuffle_partitions(docs.sparkSession))
    order = [F.col("shard"), F.col(f"`{id_col}`"), F.monotonically_increasing_id()]
    docs.withColumn("shard", shard_of(docs, n_shards, id_col, text_col)) \
        .repartitionByRange(tasks, *order).sortWithinPartitions("shard", F.col(f"`{id_col}`")) \
        .write.partitionBy("shard").mode("overwrite").parquet(path)
