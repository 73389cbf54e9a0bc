"""SimHash near-duplicates with Golay-code keys.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. The binary
Golay code (23, 12, 7) is perfect: each 23-bit word has one codeword within
three bits. d(s) is the number of that codeword, K(s) the numbers met by s and
the words one bit away: one or six of them. If two segments differ in at most
one bit, d of the one is in K of the other.

Two fingerprints that differ in at most three bits either have at most one
differing bit in every segment, or one segment holds two or more and the other
two at most one between them. Keys for the first case are codeword numbers of
all three segments (36 bits); for the second, one segment as it is beside a
codeword number of another (30 or 35 bits), for each ordered pair of segments.
Per fingerprint that makes about 70 keys, and any linked pair meets in a bucket.

Buckets never emit all their pairs. Members are first checked against three
pivots of their bucket; the links found make components. Only buckets that
still hold several components are searched further: members outside the
bucket's largest component are joined with members of other components and
checked bit by bit, so every link that could join two components is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudlake.llm.common import set_aside, written
from fraudlake.llm.graph import components

SHINGLE, MAX_BITS = 3, 3
SEED = 42
SEGMENTS = ((0, 23), (23, 23), (46, 18))     # offset, bits
GOLAY = 0xC75                                # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
BLOCK = 65_536                               # hashes turned into bits at a time
BROADCAST_KEYS = 1_000_000                   # bucket keys (8 bytes each) sent to all tasks at most


# --- fingerprints ------------------------------------------------------------------
def fingerprint(text: str, n: int = SHINGLE) -> int:
    """Unsigned fingerprint: A-Z lower-cased, words at [\\x20\\x09-\\x0D], n-word
    shingles with repeats; bit set where over half the shingle hashes set it."""
    import xxhash

    w = text.encode("utf-8", "surrogatepass").lower().split()   # bytes: ASCII rules only
    if not w:
        return 0
    shingles = list(map(b" ".join, zip(*(w[i:] for i in range(n))))) if len(w) >= n else [b" ".join(w)]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(shingles), BLOCK):
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles[at:at + BLOCK], repeat(SEED)), dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 n: int = SHINGLE) -> DataFrame:
    """(id, fp) with fp as a signed long; null or wordless text has fp 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py() or "", n) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, fp bigint")


# --- Golay keys --------------------------------------------------------------------
def _remainder(x: np.ndarray) -> np.ndarray:
    """Polynomial remainder of 23-bit words by the generator."""
    x = x.copy()
    for bit in range(22, 10, -1):
        x ^= np.where(x >> bit & 1, GOLAY << (bit - 11), 0)
    return x


class Golay:
    """Decoder by syndrome: the 2048 remainders name the error patterns of up to three bits."""

    def __init__(self) -> None:
        patterns = np.array([sum(1 << b for b in bits) for k in range(4)
                             for bits in combinations(range(23), k)], dtype=np.int64)
        self.error = np.zeros(2048, dtype=np.int64)
        self.error[_remainder(patterns)] = patterns
        self.high = _remainder(np.arange(4096, dtype=np.int64) << 11)

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Number (12 bits) of the codeword within three bits of each word."""
        return (x ^ self.error[(x & 2047) ^ self.high[x >> 11]]) >> 11

    def near(self, x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Codeword numbers of the words within one bit: (rows, values) without repeats."""
        flips = np.array([0, *(1 << b for b in range(bits))], dtype=np.int64)
        d = np.sort(self.decode(x[:, None] ^ flips[None, :]), axis=1)
        new = np.ones(d.shape, dtype=bool)
        new[:, 1:] = d[:, 1:] != d[:, :-1]
        rows, cols = np.nonzero(new)
        return rows, d[rows, cols]


def _cross(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int) -> tuple:
    """Row-wise products of two (rows, values) lists, rows ascending in both."""
    nb = np.bincount(b[0], minlength=n)
    first = np.concatenate([[0], np.cumsum(nb)[:-1]])
    take = nb[a[0]]
    rows = np.repeat(a[0], take)
    step = np.arange(len(rows)) - np.repeat(np.cumsum(take) - take, take)
    return rows, np.repeat(a[1], take), b[1][first[rows] + step]


def golay_keys(fp: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, side) of unsigned fingerprints; a linked pair has a key in common,
    once on the left (side 0) of one and the right (side 1) of the other."""
    n = len(fp)
    seg = [((fp >> np.uint64(o)) & np.uint64((1 << b) - 1)).astype(np.int64) for o, b in SEGMENTS]
    d = [golay.decode(s) for s in seg]
    near = [golay.near(s, b) for s, (_, b) in zip(seg, SEGMENTS)]
    every = np.arange(n)
    out = []
    r, k3 = near[2]
    out.append((r, d[0][r] << 24 | d[1][r] << 12 | k3, 0))
    r, k1, k2 = _cross(near[0], near[1], n)
    out.append((r, k1 << 24 | k2 << 12 | d[2][r], 1))
    family = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                family += 1
                tag = family << 40
                out.append((every, tag | seg[i] << 12 | d[j], 0))
                r, k = near[j]
                out.append((r, tag | seg[i][r] << 12 | k, 1))
    return (np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out]),
            np.concatenate([np.full(len(o[0]), o[2], dtype=np.int8) for o in out]))


def keyed(classes: DataFrame) -> DataFrame:
    """(key, side, fp) of every distinct fingerprint."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for b in batches:
            fp = b.column(0).to_numpy()
            rows, keys, side = golay_keys(fp.view(np.uint64), golay)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(side), pa.array(fp[rows])],
                                             names=["key", "side", "fp"])

    return classes.select("fp").mapInArrow(run, "key bigint, side tinyint, fp bigint")


def _apart(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def links(classes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(node, root) over fingerprints that are linked to another one; ``classes`` has
    distinct fp with the number of docs. Exact for ``max_bits`` up to 3."""
    if max_bits > 3:
        raise ValueError("the keys cover up to 3 differing bits")
    keys = keyed(classes)
    # buckets with at least two fingerprints; most keys have one and end here
    live = written(keys.groupBy("key").agg(F.min("fp").alias("p1"), F.max("fp").alias("p2"))
                   .where("p1 <> p2").select("key"), "golay-live")
    if live.count() <= BROADCAST_KEYS:
        live = F.broadcast(live)
    members = keys.join(live, "key").join(classes.select("fp", "docs"), "fp")
    members = written(members.select("key", "side", "fp", "docs"), "golay-members")
    buckets = members.groupBy("key").agg(
        F.min("fp").alias("p1"), F.max("fp").alias("p2"),
        F.max(F.struct("docs", "fp"))["fp"].alias("p3"),
        F.min("side").alias("s1"), F.max("side").alias("s2")).where("s1 <> s2").drop("s1", "s2")
    members = written(members.join(buckets, "key"), "golay-pivots")
    star = members.select("fp", F.explode(F.array("p1", "p2", "p3")).alias("p")) \
        .where((F.col("fp") != F.col("p")) & (_apart("fp", "p") <= max_bits))
    comps = components(star.select(F.col("fp").alias("u"), F.col("p").alias("v")))
    comps = written(comps, "golay-stars")

    # the rest: buckets that span components
    labelled = members.select("key", "side", "fp").join(comps, F.col("fp") == F.col("node"), "left") \
        .select("key", "side", "fp", F.coalesce("root", "fp").alias("comp"))
    labelled = written(labelled, "golay-labelled")
    sizes = labelled.groupBy("key", "comp").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("comps"), F.max(F.struct("n", "comp"))["comp"].alias("big")) \
        .where("comps > 1").select("key", "big")
    rest = written(labelled.join(mixed, "key"), "golay-mixed")
    a = rest.where("comp <> big").select("key", F.col("side").alias("side_a"), F.col("fp").alias("fp_a"),
                                         F.col("comp").alias("u"))
    b = rest.select("key", F.col("side").alias("side_b"), F.col("fp").alias("fp_b"), F.col("comp").alias("v"))
    found = a.join(b, "key").where((F.col("u") != F.col("v")) & (F.col("side_a") != F.col("side_b"))
                                   & (_apart("fp_a", "fp_b") <= max_bits)).select("u", "v")
    found = written(found.distinct(), "golay-found")
    if found.isEmpty():
        return comps
    merged = written(components(found), "golay-merged").select(F.col("node").alias("c"), F.col("root").alias("top"))
    nodes = comps.unionByName(merged.join(comps, F.col("c") == F.col("node"), "left_anti")
                              .select(F.col("c").alias("node"), F.col("c").alias("root")))
    return nodes.join(merged, F.col("root") == F.col("c"), "left") \
        .select("node", F.coalesce("top", "root").alias("root"))


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, n: int = SHINGLE, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id, fp, component): the smallest id that can be reached over links of at most
    ``max_bits`` differing fingerprint bits, itself included.

    Equal fingerprints are one class, so copies cost one row each and no pairs.
    Null and wordless texts share fingerprint 0 and link like any other. Repeated
    ids keep their rows; null ids take part and are never the smallest. An empty
    table gives no rows.
    """
    prints = written(fingerprints(docs, id_col, text_col, n), "simhash")
    classes = written(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("docs")),
                      "simhash-classes")
    roots = written(links(classes, max_bits), "simhash-roots")
    named = classes.join(roots, F.col("fp") == F.col("node"), "left") \
        .select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = written(named, "simhash-named")
    smallest = named.groupBy("root").agg(F.min("first").alias("component"))
    answer = written(named.join(smallest, "root").select("fp", "component"), "simhash-components")
    return prints.join(answer, "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS, n: int = SHINGLE, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: the document with the smallest id of each group.
    Of rows that repeat that id one stays; where a whole group has null ids, one of them."""
    docs, back = set_aside(docs, [id_col, text_col])
    found = written(near_duplicates(docs, max_bits, n, id_col, text_col), "simhash-found")
    stays = F.col("id").eqNullSafe(F.col("component"))
    ids = found.groupBy("id").agg(F.max(stays).alias("stays"), F.count("*").alias("n"))
    dropped = written(ids.where(~F.col("stays")).select(F.col("id").alias("_id")), "simhash-dropped")
    # a merge join at every size; adaptive execution splits an id that has very many rows
    kept = docs.join(dropped.hint("merge"), F.col(id_col).eqNullSafe(F.col("_id")), "left_anti")
    if not ids.where("stays and n > 1").isEmpty():          # an id that stays has several rows
        kept = kept.dropDuplicates([id_col])
    return back(kept)
