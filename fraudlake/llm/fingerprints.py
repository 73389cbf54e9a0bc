"""One-permutation MinHash fingerprints of whole texts.

Every five-word shingle is hashed once; the top bits of the hash name one of
256 bins and the smallest hash of a bin is its value. Empty bins borrow from a
full one by optimal densification: bin b tries the bins drawn by a hash of
(b, attempt) until it meets a full one, the same draws for every document.
Only the 4 low bits of each value are kept, packed 16 to a long, and likeness
corrects for the chance agreement of 1/16 that 4 bits have.

All of it is one projection per row: no shuffle by shingle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudlake.llm.common import (at_most_count, id_bounds, let, shuffle_partitions,
                                  words)

BINS, BITS, SHINGLE = 256, 4, 5
PROBES = 16          # densification draws tried before the exact remainder rule


def shingle_hashes(hashed_words: Column, n: int = SHINGLE) -> Column:
    """Hashes of the n-word windows; a shorter text is one shingle, none has none."""
    size = F.size(hashed_words)
    windows = F.transform(F.sequence(F.lit(0), size - n),
                          lambda i: F.xxhash64(*[F.get(hashed_words, i + k) for k in range(n)]))
    whole = F.array(F.xxhash64(hashed_words))
    return F.when(size >= n, windows).when(size > 0, whole).otherwise(F.expr("array()").cast("array<bigint>"))


def _bin(x: Column) -> Column:
    """Top 8 bits, counted so that the sorted order of signed longs is the bin order."""
    return F.shiftright(x, 56).cast("int") + BINS // 2


def _pack(dense: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda g: F.aggregate(
        F.slice(dense, g * 16 + 1, 16), F.lit(0).cast("long"),
        lambda acc, v: F.shiftleft(acc, BITS).bitwiseOR(v)))


def _densified(mins: Column) -> Column:
    """Low bits per bin, empty bins filled. ``mins``: smallest hash of every full bin."""
    low = F.lit(2 ** BITS - 1).cast("long")
    # one entry per bin, its own smallest hash if it is full, else that of a neighbour
    spread = F.flatten(F.transform(mins, lambda x, i: F.array_repeat(x, F.coalesce(
        _bin(F.get(mins, i + 1)), F.lit(BINS)) - F.when(i == 0, F.lit(0)).otherwise(_bin(x)))))

    def fill(entries: Column) -> Column:
        def own(b: Column) -> Column:
            return let(F.get(entries, b), lambda e: F.when(_bin(e) == b, e.bitwiseAND(low)))

        def one(e: Column, b: Column) -> Column:
            draws = [own(F.pmod(F.hash(b, F.lit(t)), F.lit(BINS))) for t in range(PROBES)]
            # few bins are full when all draws miss: the remaining draws are a random
            # order of the full bins, so its first one is their smallest hash with b
            last = F.array_min(F.transform(mins, lambda x: F.xxhash64(b, _bin(x)).bitwiseAND(
                F.lit(-2 ** BITS).cast("long")).bitwiseOR(x.bitwiseAND(low))))
            return F.when(_bin(e) == b, e.bitwiseAND(low)) \
                .otherwise(F.coalesce(*draws, last.bitwiseAND(low)))
        return F.transform(entries, one)

    return let(spread, fill)


def fingerprint(text: Column) -> Column:
    """Packed fingerprint (16 longs = 256 bins x 4 bits) of a text; empty array
    for a text without words. Null counts as empty."""
    hashed = F.transform(words(text), lambda w: F.xxhash64(w))
    ordered = let(hashed, lambda h: F.sort_array(shingle_hashes(h)))
    mins = let(ordered, lambda s: F.filter(
        s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1)))))
    return let(mins, lambda m: F.when(F.size(m) == 0, F.expr("array()").cast("array<bigint>"))
               .otherwise(let(_densified(m), _pack)))


def to_hex(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness in 0..1 from two packed fingerprints.

    Agreeing bins = zero nibbles of the xor. With r the chance agreement 2^-4,
    the estimate is (agreement - r) / (1 - r), cut at 0. Two texts without words
    are alike (1); one with and one without are not (0).
    """
    ones = F.lit(0x1111111111111111).cast("long")

    def differing(x: Column) -> Column:
        any_bit = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)) \
            .bitwiseOR(F.shiftrightunsigned(x, 3))
        return F.bit_count(any_bit.bitwiseAND(ones))

    differ = F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0),
                         lambda acc, x: acc + let(x, differing).cast("int"))
    r = 2.0 ** -BITS
    share = (F.lit(BINS) - differ) / F.lit(float(BINS))
    both = F.greatest(F.lit(0.0), (share - r) / (1.0 - r))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)) \
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both)


def with_next(df: DataFrame, id_col: str, cols: list[str], derived: dict[str, Column] | None = None) -> DataFrame:
    """Adds ``next_<col>`` of the row with the next larger id (after the last: the first),
    and the ``derived`` columns with their ``next_<name>``: they are computed once a row,
    after the few copies are picked.

    Rows are dealt into id-range buckets, so the window is bounded; each bucket
    gets a copy of the first row of the next one. Ties of the id are ordered by
    the hash of ``cols``. A single row is its own successor. Null ids come first.
    """
    spark = df.sparkSession
    buckets = 4 * shuffle_partitions(spark)
    bounds = id_bounds(df, id_col, buckets)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-2 ** 63))
    placed = df.select(*[c for c in df.columns], key.alias("_key"),
                       F.coalesce(at_most_count(F.col(id_col), bounds), F.lit(0)).alias("_bucket"),
                       F.lit(False).alias("_copy"), F.xxhash64(*cols).alias("_tie"))
    # smallest key per bucket: at most `buckets` rows on the driver
    ids = df.select(key.alias("_key"), F.coalesce(at_most_count(F.col(id_col), bounds), F.lit(0))
                    .alias("_bucket"))
    firsts = sorted((r["_bucket"], r["k"]) for r in
                    ids.groupBy("_bucket").agg(F.min("_key").alias("k")).collect())
    if firsts:
        moves = [(k, firsts[i - 1][0]) for i, (_, k) in enumerate(firsts)]
        moves = spark.createDataFrame(moves, "_key long, _to int")
        copies = placed.join(F.broadcast(moves), "_key") \
            .withColumn("_bucket", F.col("_to")).withColumn("_copy", F.lit(True)).drop("_to")
        placed = placed.unionByName(copies)
    derived = derived or {}
    placed = placed.withColumns(derived)
    w = Window.partitionBy("_bucket").orderBy("_copy", "_key", "_tie")
    out = placed.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in [*cols, *derived]])
    return out.where(~F.col("_copy")).drop("_key", "_bucket", "_copy", "_tie")


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited text, and the packed fingerprints of the text, the
    edited text and the next document's text (null text: empty)."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pairs = with_next(base, "id", ["text"], {"fp": fingerprint(F.col("text"))})
    pairs = pairs.withColumn("n_chars", F.char_length("text").cast("long"))
    edit = F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 4 as int)), "
                  "substring(next_text, 1, cast(n_chars div 4 as int)))")
    pairs = pairs.select("id", "n_chars", edit.alias("edited"), "fp", "next_fp")
    return pairs.withColumn("edited_fp", fingerprint(F.col("edited")))
