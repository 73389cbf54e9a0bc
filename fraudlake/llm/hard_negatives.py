"""Hard negatives by inner product, through cover trees.

Every vector x of integers gets one more component, sqrt(M^2 - |x|^2) with M the largest
norm, so that all lie on a sphere and the inner product with an anchor (whose extra
component is 0) falls with the distance. The rows are dealt into cells around pivots and
a cell into chunks of bounded size. A task builds the cover tree of one chunk: a node
covers its points within a radius, its children are centres chosen farthest first, each
at least as far from the others as the radius that they leave. The radius as an angle
bounds the inner products below a node on both sides. The search goes best bound first,
takes into each node only those anchors whose window the bounds still meet, and leaves
are computed exactly. The same bounds leave out whole cells.

Anchors move to the cells in blocks of bounded size. Three passes: positives in the cell
with the best bound, positives in the other cells that can still hold one, negatives.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudlake.llm.common import written

CHUNK_ROWS = 16_384         # rows of one tree
BLOCK_ROWS = 8_192          # searches that meet a tree in one task
MAX_CELLS = 256
LEAF, FAN = 64, 16
SHRINK = 2.0                # children cover half the radius of their parent, if FAN of them can
EXACT = 2.0 ** 46           # products below it are exact as doubles, and so are their sort keys
SLACK = 1e-6
LEAST, MOST = -2 ** 63, 2 ** 63 - 1


class CoverTree:
    """Cover tree over the rows of ``x`` (whole numbers), which the extra component lifts
    onto the sphere of radius sqrt(``m2``)."""

    def __init__(self, x: np.ndarray, m2: float, leaf: int = LEAF, fan: int = FAN):
        self.radius = math.sqrt(m2) or 1.0
        x = x.astype(np.float64)
        extra = np.sqrt(np.maximum(m2 - np.einsum("ij,ij->i", x, x), 0.0))
        lifted = np.hstack([x, extra[:, None]])
        self.start, self.end, self.children = [], [], []
        centres, covers, order = [], [], []

        def node(centre: int, cover: float) -> int:
            centres.append(centre)
            covers.append(cover)
            self.start.append(0)
            self.end.append(0)
            self.children.append([])
            return len(centres) - 1

        def away(rows: np.ndarray, centre: int) -> np.ndarray:
            return np.linalg.norm(lifted[rows] - lifted[centre], axis=1)

        todo = []
        if len(x):
            everything = np.arange(len(x))
            gap = away(everything, 0)
            todo = [(node(0, float(gap.max())), everything, gap)]
        while todo:
            at, rows, gap = todo.pop()
            mine, own = np.zeros(len(rows), dtype=np.int64), [centres[at]]
            if len(rows) > leaf:
                while len(own) < fan and gap.max() > (covers[at] / SHRINK if len(own) > 1 else 0.0):
                    far = int(rows[np.argmax(gap)])
                    d = away(rows, far)
                    nearer = d < gap
                    mine[nearer], gap = len(own), np.where(nearer, d, gap)
                    own.append(far)
            if len(own) == 1:           # few points, or all the same
                self.start[at], self.end[at] = len(order), len(order) + len(rows)
                order.extend(rows.tolist())
                continue
            for k, c in enumerate(own):
                part = mine == k
                if part.any():
                    child = node(c, float(gap[part].max()))
                    self.children[at].append(child)
                    todo.append((child, rows[part], gap[part]))
        self.order = np.array(order, dtype=np.int64)
        self.centres = x[np.array(centres, dtype=np.int64)]
        self.angle = angles(np.array(covers), self.radius)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return sphere_bounds(q, self.centres, self.angle, self.radius)


def angles(chord: np.ndarray, radius: float) -> np.ndarray:
    return 2 * np.arcsin(np.clip(chord / (2 * radius), 0.0, 1.0))


def sphere_bounds(q: np.ndarray, centres: np.ndarray, angle: np.ndarray,
                  radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of every row of ``q`` with the points of the sphere
    within ``angle`` of every centre, with some slack for rounding."""
    q = q.astype(np.float64)
    norm = np.linalg.norm(q, axis=1)[:, None]
    length = norm * radius
    phi = np.arccos(np.clip(q @ centres.T / np.where(length > 0, length, 1.0), -1.0, 1.0))
    slack = SLACK * length + SLACK
    return (length * np.cos(np.minimum(phi + angle, np.pi)) - slack,
            length * np.cos(np.maximum(phi - angle, 0.0)) + slack)


def search(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, m2: float, q: pd.DataFrame, qv: np.ndarray,
           same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every row of ``q`` (id, label, low, high) with vector ``qv``: the first ``k`` rows of
    (``ids``, ``labels``, ``x``) with low <= inner product <= high, of the same label and
    another id or of another label. Returns row numbers of ``q``, ids, inner products."""
    by_id = np.argsort(ids, kind="stable")
    ids, labels, x = ids[by_id], labels[by_id], x[by_id]
    n, exact = len(ids), m2 < EXACT and float(np.abs(qv).max(initial=0)) ** 2 * max(1, qv.shape[1]) < EXACT
    kind = np.int64 if exact else object
    never = -2 ** 62 if exact else -2 ** 200
    xs, qs = (x.astype(np.float64), qv.astype(np.float64)) if exact else (x.astype(object), qv.astype(object))
    tree = CoverTree(x, m2)
    low, high = q["low"].to_numpy(), q["high"].to_numpy()
    least, most = tree.bounds(qv)
    best = np.full((len(q), k), never, dtype=kind)       # product * n + (n - 1 - row), descending
    own_id, own_label = q["id"].to_numpy(), q["label"].to_numpy()

    def floor(rows: np.ndarray) -> np.ndarray:
        """No smaller product can enter the result."""
        got = best[rows, -1]
        return np.maximum(low[rows], np.where(got > never, got // n, LEAST).astype(np.int64))

    def meets(node: int, rows: np.ndarray) -> np.ndarray:
        return rows[(most[rows, node] >= floor(rows)) & (least[rows, node] <= high[rows])]

    def look(node: int, rows: np.ndarray) -> None:
        at = tree.order[tree.start[node]:tree.end[node]]
        for part in np.array_split(rows, -(-len(rows) * len(at) // 4_000_000) or 1):
            product = qs[part] @ xs[at].T
            if exact:
                product = product.astype(np.int64)
            fits = (product >= low[part][:, None]) & (product <= high[part][:, None])
            alike = labels[at][None, :] == own_label[part][:, None]
            fits &= (alike & (ids[at][None, :] != own_id[part][:, None])) if same else ~alike
            some = fits.any(axis=1)
            if some.any():
                keys = np.where(fits[some], product[some] * n + (n - 1 - at)[None, :], never)
                both = np.sort(np.hstack([best[part[some]], keys.astype(kind)]), axis=1)
                best[part[some]] = both[:, :-k - 1:-1]

    def first_leaf() -> None:
        """Every search alone down to the leaf with its best bound."""
        todo = [(0, np.arange(len(q)))]
        while todo:
            node, rows = todo.pop()
            below = tree.children[node]
            if not below:
                first[rows] = node
                look(node, rows)
                continue
            reach = np.where(least[rows][:, below] <= high[rows][:, None], most[rows][:, below], -np.inf)
            pick = np.argmax(reach, axis=1)
            todo += [(c, rows[pick == j]) for j, c in enumerate(below) if (pick == j).any()]

    if n and len(q):
        first = np.empty(len(q), dtype=np.int64)
        first_leaf()
        heap = [(0.0, 0, np.arange(len(q)))]
        while heap:
            _, node, rows = heapq.heappop(heap)
            rows = meets(node, rows)
            if not len(rows):
                continue
            if not tree.children[node]:
                rows = rows[first[rows] != node]
                if len(rows):
                    look(node, rows)
            for c in tree.children[node]:
                into = meets(c, rows)
                if len(into):
                    heapq.heappush(heap, (-float(np.minimum(most[into, c], high[into]).max()), c, into))
    row, col = np.nonzero(best > never)
    got = best[row, col]
    where = (n - 1 - got % n).astype(np.int64) if len(got) else np.zeros(0, dtype=np.int64)
    return row, ids[where], (got // n if len(got) else got)


# --- rows, cells and passes -----------------------------------------------------------------

def whole_numbers(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                  scale: int = 256) -> DataFrame:
    """id, label, v: every component x as floor(``scale`` * x), x as double. Rows with a null
    id, label or vector, with a null or non-finite component, or with one of 2^62 and more
    after scaling take no part."""
    def scaled(x: Column) -> Column:
        return F.floor(x.cast("double") * scale)

    v = F.col(f"`{vec_col}`")
    unfit = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double"))
                     | (F.abs(x.cast("double") * scale) >= F.lit(2.0 ** 62)))
    return rows.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull()
                      & v.isNotNull() & ~unfit).select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label_col}`").cast("bigint").alias("label"),
        F.transform(v, scaled).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an array<bigint> column, shorter ones filled up with zeros."""
    out = np.zeros((len(column), width), dtype=np.int64)
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, dtype=np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().to_numpy()
    return out


def as_matrix(column: pd.Series, width: int) -> np.ndarray:
    return matrix(pa.array(column, pa.list_(pa.int64())), width)


class Cells:
    """The points, written with their cell; per cell the pivot, the angle that covers its
    points and the number of rows. At most ``MAX_CELLS`` of them, so they go along with
    the closures."""

    def __init__(self, points: DataFrame, chunk_rows: int):
        points = written(points.withColumn("norm2", F.aggregate(
            "v", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))), "vectors")
        n, width, m2 = points.agg(F.count("*"), F.max(F.size("v")), F.max("norm2")).first()
        self.n, self.width, self.m2, self.chunk_rows = n, width or 0, m2 or 0.0, chunk_rows
        self.radius = math.sqrt(self.m2) or 1.0
        if not n:
            return
        cells = min(MAX_CELLS, -(-n // chunk_rows))
        picked = points.orderBy(F.xxhash64("id"), "id").limit(cells).select("v").collect()
        self.pivots = as_matrix(pd.Series([r.v for r in picked]), self.width).astype(np.float64)
        lift, pivots, width, m2 = self.lift, self.pivots, self.width, self.m2

        def assign(batches):
            lifted = lift(pivots, m2)
            for b in batches:
                x = lift(matrix(b.column(2), width).astype(np.float64), m2)
                product = x @ lifted.T
                cell = np.argmax(product, axis=1)
                chord = np.linalg.norm(x - lifted[cell], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), b.column(2), pa.array(cell, pa.int32()), pa.array(chord, pa.float64())],
                    names=["id", "label", "v", "cell", "chord"])

        dealt = points.select("id", "label", "v").mapInArrow(
            assign, "id bigint, label bigint, v array<bigint>, cell int, chord double")
        self.points = written(dealt.withColumn("nth", F.monotonically_increasing_id()), "cells")
        got = {r.cell: r for r in self.points.groupBy("cell").agg(
            F.count("*").alias("rows"), F.max("chord").alias("chord")).collect()}
        self.kept = sorted(got)
        self.pivots = self.pivots[self.kept]
        self.angle = angles(np.array([got[c].chord for c in self.kept]), self.radius)
        self.chunks = {c: -(-got[c].rows // chunk_rows) for c in self.kept}

    @staticmethod
    def lift(x: np.ndarray, m2: float) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(m2 - np.einsum("ij,ij->i", x, x), 0.0))[:, None]])


SEARCH = "qid bigint, id bigint, label bigint, v array<bigint>, low bigint, high bigint"


def routed(searches: DataFrame, cells: Cells, which: str) -> DataFrame:
    """The searches (``SEARCH``) once per cell that their bounds allow: only the ``best`` cell,
    all ``other`` ones, or ``all``."""
    pivots, angle, radius, width, kept = cells.pivots, cells.angle, cells.radius, cells.width, np.array(cells.kept)

    def run(batches):
        for b in batches:
            low, high = b.column(4).to_numpy(), b.column(5).to_numpy()
            least, most = sphere_bounds(matrix(b.column(3), width), pivots, angle, radius)
            best = np.argmax(most, axis=1)
            go = (most >= low[:, None]) & (least <= high[:, None])
            if which != "all":
                chosen = np.zeros_like(go)
                chosen[np.arange(len(best)), best] = True
                go &= chosen if which == "best" else ~chosen
            row, col = np.nonzero(go)
            part = pa.Table.from_batches([b]).take(pa.array(row)).append_column("cell", pa.array(kept[col], pa.int32()))
            yield from part.to_batches()

    return searches.mapInArrow(run, SEARCH + ", cell int")


def searched(searches: DataFrame, cells: Cells, which: str, same: bool, k: int, block_rows: int) -> DataFrame:
    """qid, found, product: the first ``k`` of every search in every chunk that it meets."""
    spark = searches.sparkSession
    to = written(routed(searches, cells, which), "searches")
    met = {r.cell: -(-r["count"] // block_rows) for r in to.groupBy("cell").count().collect()}
    plan = F.broadcast(spark.createDataFrame(
        [(c, cells.chunks[c], met[c]) for c in cells.kept if c in met], "cell int, chunks int, blocks int"))
    points = cells.points.join(plan, "cell").select(
        "cell", F.pmod(F.xxhash64("nth"), "chunks").cast("int").alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "label", "v")
    asked = to.join(plan, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
        F.pmod(F.xxhash64("qid"), "blocks").cast("int").alias("block"), "qid", "id", "label", "v", "low", "high")
    width, m2 = cells.width, cells.m2

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"qid": [], "found": [], "product": []}).astype("int64")
        row, found, product = search(left["id"].to_numpy(), left["label"].to_numpy(), as_matrix(left["v"], width),
                                     m2, right, as_matrix(right["v"], width), same, k)
        return pd.DataFrame({"qid": right["qid"].to_numpy()[row], "found": found, "product": product.astype(np.int64)})

    keys = ["cell", "chunk", "block"]
    return points.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(
        run, "qid bigint, found bigint, product bigint")


def first_of(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of every search, with their rank from 1."""
    w = Window.partitionBy("qid").orderBy(F.desc("product"), "found")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(points: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80,
         high: int = 100, chunk_rows: int = CHUNK_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score (all bigint,
    rank int) of ``points`` (id, label, v, as ``whole_numbers`` gives them).

    An anchor is a row that satisfies ``is_anchor``; repeated equal anchors count once. Its
    positives are the first ``positives`` rows with its label and another id by inner product,
    ties by smaller id; a positive's negatives the first ``negatives`` of the rows with another
    label and ``low`` * positive <= 100 * negative <= ``high`` * positive. Repeated rows are
    candidates each. Shorter vectors count as filled up with zeros; a negative positive score
    has no negatives where low < high. An empty table gives no rows.
    """
    spark = points.sparkSession
    cells = Cells(points, chunk_rows)
    if not cells.n:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, "
                                         "positive_score bigint, negative_score bigint")
    anchors = written(cells.points.where(is_anchor).groupBy("id", "label", "v").agg(F.lit(1).alias("one"))
                      .select(F.monotonically_increasing_id().alias("qid"), "id", "label", "v"), "anchors")
    anything = [F.lit(LEAST).alias("low"), F.lit(MOST).alias("high")]
    near = written(first_of(searched(anchors.select("*", *anything), cells, "best", True, positives, block_rows),
                            positives), "near_positives")
    # the last of a full set is a bound for the other cells
    bound = near.where(F.col("rank") == positives).select("qid", F.col("product").alias("low"))
    more = anchors.join(bound, "qid", "left").select(
        "qid", "id", "label", "v", F.coalesce("low", F.lit(LEAST)).alias("low"), F.lit(MOST).alias("high"))
    far = searched(more, cells, "other", True, positives, block_rows)
    score = F.col("product").cast("decimal(20,0)")
    chosen = written(first_of(near.drop("rank").unionByName(far), positives).join(anchors, "qid").select(
        F.monotonically_increasing_id().alias("qid"), "id", "label", "v", F.col("found").alias("positive_id"),
        F.col("product").alias("positive_score"), F.ceil(score * low / 100).cast("bigint").alias("low"),
        F.floor(score * high / 100).cast("bigint").alias("high")), "positives")
    found = first_of(searched(chosen.select("qid", "id", "label", "v", "low", "high"), cells, "all", False,
                              negatives, block_rows), negatives)
    return found.join(chosen.drop("low", "high"), "qid").select(
        F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("found").alias("negative_id"),
        "positive_score", F.col("product").alias("negative_score"))
