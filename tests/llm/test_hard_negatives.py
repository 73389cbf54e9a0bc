"""Hard negatives: cover trees and the whole operator against brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fraudlake.llm import hard_negatives as hn
from fraudlake.llm.queries import QUERIES

from conftest import SF_SMALL


def brute(rows, is_anchor, positives=5, negatives=5, low=80, high=100):
    rows = [(i, l, [int(x) for x in v]) for i, l, v in rows]

    def product(a, b):
        return sum(x * y for x, y in zip(a, b))

    out = []
    for a in {(i, l, tuple(v)) for i, l, v in rows if is_anchor(i)}:
        scored = [(-product(a[2], v), i, l) for i, l, v in rows]
        same = sorted(s for s in scored if s[2] == a[1] and s[1] != a[0])[:positives]
        other = sorted(s for s in scored if s[2] != a[1])
        for p, pid, _ in same:
            fit = [s for s in other if low * -p <= 100 * -s[0] <= high * -p][:negatives]
            out += [(a[0], pid, n + 1, s[1], -p, -s[0]) for n, s in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame(rows, "id bigint, label bigint, v array<bigint>")
    got = hn.mine(df, F.col("id") % 10 == 0, **kw)
    return sorted(map(tuple, got.collect()))


def clustered(seed, n, d, groups=6, spread=10, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-60, 60, (groups, d))
    return [(int(i), int(rng.integers(labels)), (centres[rng.integers(groups)] + rng.integers(-spread, spread, d)).tolist())
            for i in rng.permutation(n)]


@pytest.mark.parametrize("seed,d,n,spread", [(1, 3, 500, 5), (2, 16, 900, 20), (3, 1, 300, 9), (4, 40, 400, 60)])
def test_tree_bounds_and_search(seed, d, n, spread):
    rows = clustered(seed, n, d, spread=spread)
    ids, labels = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    x = np.array([r[2] for r in rows])
    m2 = float((x * x).sum(axis=1).max())
    tree = hn.CoverTree(x, m2, leaf=8, fan=4)
    assert sorted(tree.order.tolist()) == list(range(n))
    q = x[:40]
    least, most = tree.bounds(q)
    below = {}
    for node in reversed(range(len(tree.children))):
        kids = tree.children[node]
        below[node] = sum((below[c] for c in kids), []) if kids else tree.order[tree.start[node]:tree.end[node]].tolist()
        products = q @ x[below[node]].T
        assert (products >= least[:, [node]]).all() and (products <= most[:, [node]]).all()
    for same in (True, False):
        lows = np.linspace(-200, 3000, 40).astype(np.int64)
        frame = pd.DataFrame({"id": ids[:40], "label": labels[:40], "low": lows, "high": hn.MOST if same else lows + 900})
        got = {}
        for r, i, p in zip(*hn.search(ids, labels, x, m2, frame, q, same, 3)):
            got.setdefault(int(r), []).append((-int(p), int(i)))
        for r in range(40):
            want = sorted((-int(p), int(i)) for p, i, l in zip(x @ q[r], ids, labels)
                          if lows[r] <= p <= frame["high"][r] and ((l == labels[r] and i != ids[r]) if same else l != labels[r]))
            assert got.get(r, []) == want[:3]


def test_search_leaves_nodes_out(monkeypatch):
    """On clustered rows most leaves are never looked at."""
    rows = clustered(7, 4_000, 24, groups=40, spread=4, labels=3)
    ids, labels, x = (np.array([r[j] for r in rows]) for j in range(3))
    seen = []
    count = np.hstack
    monkeypatch.setattr(hn.np, "hstack", lambda parts: (seen.append(parts[1].shape), count(parts))[1])
    frame = pd.DataFrame({"id": ids[:20], "label": labels[:20], "low": hn.LEAST, "high": hn.MOST})
    hn.search(ids, labels, x, float((x * x).sum(axis=1).max()), frame, x[:20], True, 5)
    looked = sum(s[0] * s[1] for s in seen if len(s) == 2 and s[1] > 1)
    assert 0 < looked < 0.5 * 20 * len(rows)


@pytest.mark.parametrize("chunk,block", [(16_384, 8_192), (64, 7)])
def test_mining_small_chunks_and_blocks(spark, chunk, block):
    rows = clustered(11, 400, 8)
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(want) > 300
    assert mined(spark, rows, chunk_rows=chunk, block_rows=block) == want


def test_hot_copies_ties_and_odd_vectors(spark):
    rows = [(i, i % 2, [3, 4]) for i in range(150)]                      # a third and more: the same vector
    rows += [(i, i % 3, [0, 0]) for i in range(150, 190)]                # zero scores
    rows += [(i, i % 3, [-5, i % 4]) for i in range(190, 230)]           # negative scores
    rows += [(300, 1, [3]), (301, 0, []), (302, 1, [1, 1, 1])]           # other lengths
    rows += [(20, 0, [3, 4]), (20, 0, [3, 4]), (40, 1, [9, 9])]          # repeated ids
    padded = [(i, l, (v + [0, 0, 0])[:3]) for i, l, v in rows]
    want = brute(padded, lambda i: i % 10 == 0)
    assert len(want) > 300
    assert mined(spark, rows, chunk_rows=50, block_rows=5) == want


def test_products_beyond_doubles(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 2, [int(x) for x in rng.integers(2 ** 28, 2 ** 30, 3)]) for i in range(60)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0) != []


def test_rows_that_take_no_part(spark):
    rows = [(0, 1, [0.5, 0.25]), (1, 1, [0.5, 0.3]), (2, 2, [0.5, 0.26]), (3, None, [1.0, 1.0]), (4, 2, None),
            (5, 2, [None, 1.0]), (6, 2, [float("nan"), 1.0]), (7, 2, [float("inf"), 0.0]), (None, 2, [0.5, 0.2]),
            (8, 2, [3e38, 0.0]), (9, 2, [-0.001, 0.999])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows],
                               "vec_id bigint, label int, embedding array<float>, cell int, qid string")
    got = hn.whole_numbers(df)
    assert sorted((r.id, r.v) for r in got.collect()) == [
        (0, [128, 64]), (1, [128, 76]), (2, [128, 66]), (9, [-1, 255])]
    # row 9 (16 192) is below four fifths of the positive's 21 248
    assert [tuple(r) for r in hn.mine(got, F.col("id") == 0).collect()] == [
        (0, 1, 1, 2, 128 * 128 + 64 * 76, 128 * 128 + 64 * 66)]
    assert hn.mine(got.limit(0), F.col("id") == 0).collect() == []
    assert hn.mine(got, F.col("id") == 77).collect() == []


def test_query(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()
    whole = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, [math.floor(256 * x) for x in r.embedding])
             for r in rows if r.label is not None and r.embedding is not None
             and all(x is not None and math.isfinite(x) for x in r.embedding)]
    got = QUERIES["op13_hard_negatives"](spark, SF_SMALL)
    assert sorted(map(tuple, got.collect())) == brute(whole, lambda i: i % 100 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
