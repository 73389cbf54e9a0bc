"""The federated round loop: weighted positives, evaluation, rejected updates, client minimum."""

import math

import numpy as np
from pyspark.sql import functions as F

from fraudlake.operators import rounds as R


def rows(spark, far=False):
    rnd = np.random.default_rng(5)
    out = []
    for c, n in (("a", 40), ("b", 25), ("c", 10)):
        for _ in range(n):
            x = rnd.normal(size=2)
            x = x * (1e6 if far and c == "c" else 1.0)
            out.append((c, [float(v) for v in x], int(x[0] + rnd.normal() > 0.8)))
    return out, spark.createDataFrame(out, "bank_id string, x array<double>, label int")


def brute(data, rounds, lr, pw):
    g, hist = np.zeros(3), []
    for _ in range(rounds):
        local = {}
        for c in sorted({r[0] for r in data}):
            x = np.array([[*r[1], 1.0] for r in data if r[0] == c])
            y = np.array([r[2] for r in data if r[0] == c], dtype=float)
            p = 1 / (1 + np.exp(-x @ g))
            w = np.where(y == 1, pw, 1.0)
            loss = -(y * pw * np.log(p) + (1 - y) * np.log(1 - p)).mean()
            local[c] = (len(y), loss, g - lr * (x * (w * (p - y))[:, None]).mean(0))
        n = sum(v[0] for v in local.values())
        g = sum(v[0] * v[2] for v in local.values()) / n
        hist.append((local, g))
    return hist


def test_weighted_rounds_and_evaluation(spark):
    data, df = rows(spark)
    got = R.federated_linear(spark, df, 2, rounds=3, lr=0.7, pos_weight=4.0, validation=df).collect()
    for k, (local, g) in enumerate(brute(data, 3, 0.7, 4.0), 1):
        mine = {r.client_id: r for r in got if r.round == k}
        for c, (n, loss, w) in local.items():
            assert mine[c].n == n and abs(mine[c].train_loss - loss) < 1e-9
            assert np.allclose([*mine[c].w, mine[c].b], w)
        assert np.allclose([*mine["global"].w, mine["global"].b], g)
        x, y = np.array([[*r[1], 1.0] for r in data]), np.array([r[2] for r in data])
        p = 1 / (1 + np.exp(-x @ g))
        loss = -(y * 4.0 * np.log(p) + (1 - y) * np.log(1 - p)).mean()
        assert abs(mine["global"].val_loss - loss) < 1e-9
        z = (x @ g)[[r[0] == "a" for r in data]]
        ya = y[[r[0] == "a" for r in data]]
        pairs = [(p > q) + 0.5 * (p == q) for p in z[ya == 1] for q in z[ya == 0]]
        assert abs(mine["a"].val_auroc - np.mean(pairs)) < 1e-9


def test_invalid_updates_are_left_out(spark):
    data, df = rows(spark, far=True)
    got = R.federated_linear(spark, df, 2, rounds=1, lr=0.7).collect()
    assert {r.client_id for r in got} == {"a", "b", "global"}
    want = brute([r for r in data if r[0] != "c"], 1, 0.7, 1.0)[0][1]
    g = next(r for r in got if r.client_id == "global")
    assert g.n == 65 and np.allclose([*g.w, g.b], want)


def test_too_few_clients_keep_the_model(spark, tmp_path):
    _, df = rows(spark, far=True)
    path = str(tmp_path / "state")
    got = R.federated_linear(spark, df, 2, rounds=2, min_clients=3, state_path=path).collect()
    assert [(r.round, r.client_id, r.n, r.w, r.b) for r in got] == \
        [(1, "global", 0, [0.0, 0.0], 0.0), (2, "global", 0, [0.0, 0.0], 0.0)]
    assert spark.read.parquet(path).count() == 2
    assert not R.valid_update([1.0, math.nan], 0.0) and not R.valid_update([1.0], -100.0)
