"""Private rounds against numpy, and their limits: no noise, no budget, odd clients."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fraudlake.operators import private_rounds as PR
from fraudlake.operators import privacy as PV
from fraudlake.operators import rounds as R

SCHEMA = "TransactionID long, bank_id string, label int, x array<double>"


def uniform(*parts):
    return (int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) + 0.5) / 2 ** 32


def normal(*parts, seed):
    return math.sqrt(-2 * math.log(uniform(*parts, seed))) * math.cos(2 * math.pi * uniform(*parts, f"{seed}b"))


def make(n=300, dim=3, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * [1, 5, 0.1]
    y = (x[:, 0] + rng.normal(size=n) > 0).astype(int)
    return [(i, f"bank_{1 + i % 3}" if i % 50 else "hot", int(y[i]), [float(v) for v in x[i]]) for i in range(n)]


def brute(rows, rounds, steps, lr, q, clip, sigma, seed, budgets, spent):
    dim = len(rows[0][3])
    clients = sorted({r[1] for r in rows})
    size = {c: sum(r[1] == c for r in rows) for c in clients}
    model, out = np.zeros(dim + 1), []
    for rnd in range(1, rounds + 1):
        active = [c for c in clients if spent[rnd - 1] < budgets.get(c, math.inf)]
        if not active:
            break
        local = {}
        for c in active:
            w, seen, cut = model.copy(), 0, 0
            for step in range(1, steps + 1):
                total = np.zeros(dim + 1)
                for i, bank, y, x in rows:
                    if bank == c and (q >= 1 or uniform(i, rnd, step, "row", seed) < q):
                        v = np.array([*x, 1.0])
                        g = (1 / (1 + math.exp(-v @ w)) - y) * v
                        norm = math.sqrt(g @ g)
                        seen, cut = seen + 1, cut + (norm > clip)
                        total += g * min(1.0, clip / norm)
                total += [sigma * clip * normal(c, rnd, step, k, seed=seed) for k in range(dim + 1)]
                w = w - lr * total / (min(q, 1) * size[c])
            local[c] = w
            out.append((rnd, c, size[c], seen, cut, *w))
        model = sum(size[c] * local[c] for c in active) / sum(size[c] for c in active)
        out.append((rnd, "global", sum(size[c] for c in active), 0, 0, *model))
    return out


@pytest.mark.parametrize("steps,q", [(1, 0.3), (2, 0.5), (1, 1.0)])
def test_rounds_against_numpy(spark, steps, q):
    rows = make()
    df = spark.createDataFrame(rows, SCHEMA)
    budgets = {"bank_2": 0.0, "bank_3": 1e9}
    got = PR.private_rounds(spark, df, 3, 3, steps, 1.5, q, 0.8, 1.3, budgets=budgets, seed=11).collect()
    spent = PR.spent_by_round(spark, [], 3, steps, q, 1.3, 1e-5)
    want = brute(rows, 3, steps, 1.5, q, 0.8, 1.3, 11, budgets, spent)
    assert [(r.round, r.client_id, r.n) for r in got] == [w[:3] for w in want]
    assert "bank_2" not in {r.client_id for r in got}
    for r, w in zip(got, want):
        assert np.allclose([*r.w, r.b], w[5:], rtol=1e-9, atol=1e-9)
        assert r.client_id == "global" or (r.sampled, r.clipped) == w[3:5]
        assert r.epsilon_spent == pytest.approx(spent[r.round])
    assert any(r.clipped for r in got) and any(r.clipped < r.sampled for r in got)


def test_epsilon_is_the_ledgers(spark):
    steps = spark.createDataFrame([("c", "r", k, 4, 0.1, 1.1) for k in (1, 2, 3)],
                                  "client_id string, run_id string, round int, steps long, q double, sigma double")
    want = [r.epsilon_spent for r in PV.epsilon_ledger(steps, 1e-5).orderBy("round").collect()]
    assert PR.spent_by_round(spark, [], 3, 4, 0.1, 1.1, 1e-5) == [0.0, *want]
    assert want[0] < want[1] < want[2]


def test_without_noise_and_clipping_it_is_the_plain_round(spark):
    df = spark.createDataFrame(make(), SCHEMA)
    private = PR.private_rounds(spark, df, 3, 2, 2, 0.5, q=1.0, clip=1e9, sigma=1e-30)
    plain = R.federated_linear(spark, df, 3, 2, 2, 0.5).collect()
    got = {(r.round, r.client_id): [*r.w, r.b] for r in private.collect()}
    assert got.keys() == {(r.round, r.client_id) for r in plain}
    assert all(np.allclose(got[r.round, r.client_id], [*r.w, r.b]) for r in plain)


def test_budgets_stop_clients_and_then_the_rounds(spark):
    df = spark.createDataFrame(make(), SCHEMA)
    spent = PR.spent_by_round(spark, [], 5, 1, 0.2, 1.1, 1e-5)
    budgets = {"bank_1": spent[1], "bank_2": (spent[1] + spent[2]) / 2}
    got = PR.private_rounds(spark, df, 3, 5, 1, q=0.2, sigma=1.1, budgets=budgets, global_budget=spent[3]).collect()
    rounds = {c: max(r.round for r in got if r.client_id == c) for c in ("bank_1", "bank_2", "bank_3", "hot", "global")}
    # a budget is reached, not passed, by bank_1's first round
    assert rounds == {"bank_1": 1, "bank_2": 2, "bank_3": 3, "hot": 3, "global": 3}


def test_odd_clients(spark):
    rows = [*make(40), (1000, None, 1, [1.0, 1.0, 1.0]), (1001, "lone", 1, [1e4, 0.0, 0.0]), (1001, "lone", 1, [1e4, 0.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("sampled", F.lit("mine"))
    got = PR.private_rounds(spark, df, 3, 2, q=0.01, lr=0.01).collect()      # some clients sample no row: noise alone
    assert {r.client_id for r in got} == {"bank_1", "bank_2", "bank_3", "hot", "lone", "global"}
    assert min(r.sampled for r in got) == 0 and all(abs(v) < 100 for r in got for v in r.w)
    wild = PR.private_rounds(spark, df, 3, 1, q=1.0, lr=1e6, min_clients=2).collect()
    assert [(r.client_id, r.n) for r in wild] == [("global", 0)] and wild[0].w == [0.0, 0.0, 0.0]
    assert PR.private_rounds(spark, df.limit(0), 3, 2).collect() == []
