"""Private federated rounds.

A local step samples the rows of every client independently with probability q, clips
each row's gradient, adds them up and adds Gaussian noise, all in one aggregate: clipping
is a factor per row inside the gradient sums, so no per-row gradient is ever a row of its
own. The ledger of the steps taken decides before every round which clients still have
budget; the others stop and the rounds go on without them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudlake.functions.hashrand import normal_pair, uniform
from fraudlake.operators.metrics import sigmoid
from fraudlake.operators.privacy import epsilon_ledger
from fraudlake.operators.rounds import l2, linear_logit, valid_update


def sampled(rows: DataFrame, rnd: int, step: int, q: float, seed: int, key: str) -> DataFrame:
    """The rows that take part in a step: each with probability ``q``, by its key."""
    draw = uniform(F.col(key).cast("string"), F.lit(str(rnd)), F.lit(str(step)), F.lit("row"), seed=seed)
    return rows if q >= 1 else rows.where(draw < F.lit(q))


def private_gradients(rows: DataFrame, weights: DataFrame, dim: int, rnd: int, step: int, q: float, clip: float,
                      sigma: float, seed: int, client_col: str = "bank_id", x_col: str = "x", y_col: str = "label",
                      key: str = "TransactionID") -> DataFrame:
    """Per client of ``weights`` (client, w, b): rows sampled, rows clipped, and ``noisy``, the
    sum of the clipped row gradients (weights, then bias) plus noise of deviation
    ``sigma * clip`` in every coordinate. A client without sampled rows gets noise alone."""
    part = sampled(rows, rnd, step, q, seed, key).join(F.broadcast(weights), client_col)
    err = sigmoid(linear_logit(F.col(x_col), F.col("w"), F.col("b"))) - F.col(y_col).cast("double")
    norm = F.abs("_err") * F.sqrt(F.lit(1.0) + F.pow(l2(F.col("_x")), 2))
    part = part.select(client_col, F.col(x_col).alias("_x"), err.alias("_err"))
    # the row's gradient is err * (x, 1)
    part = part.select(client_col, "_x", (F.col("_err") * F.when(norm > clip, F.lit(clip) / norm).otherwise(1.0))
                       .alias("_scaled"), (norm > clip).alias("_clipped"))
    sums = part.groupBy(client_col).agg(
        F.count(F.lit(1)).alias("sampled"), F.count_if("_clipped").alias("clipped"),
        F.array(*[F.sum(F.col("_scaled") * F.col("_x")[i]) for i in range(dim)], F.sum("_scaled")).alias("_sum"))

    def noise(i: int) -> Column:
        at = [F.col(client_col), *[F.lit(str(v)) for v in (rnd, step, i)]]
        return F.lit(sigma * clip) * normal_pair(uniform(*at, seed=seed), uniform(*at, seed=f"{seed}b"))

    every = weights.select(client_col).join(sums, client_col, "left")          # one row per client
    return every.select(client_col, F.coalesce("sampled", F.lit(0)).alias("sampled"),
                        F.coalesce("clipped", F.lit(0)).alias("clipped"),
                        F.array(*[F.coalesce(F.col("_sum")[i], F.lit(0.0)) + noise(i) for i in range(dim + 1)])
                        .alias("noisy"))


SCHEMA = ("round int, client_id string, n long, sampled long, clipped long, w array<double>, b double, "
          "epsilon_spent double")


def spent_by_round(spark, clients: list[str], rounds: int, local_steps: int, q: float, sigma: float,
                   delta: float) -> list[float]:
    """Epsilon after 0, 1, ... rounds, by the ledger; alike for all clients that go on."""
    plan = spark.range(1, rounds + 1).select(
        F.lit("any").alias("client_id"), F.lit("run").alias("run_id"), F.col("id").cast("int").alias("round"),
        F.lit(local_steps).cast("long").alias("steps"), F.lit(min(1.0, q)).alias("q"), F.lit(sigma).alias("sigma"))
    return [0.0, *[r.epsilon_spent for r in epsilon_ledger(plan, delta).orderBy("round").collect()]]


def private_rounds(spark, features: DataFrame, dim: int, rounds: int = 1, local_steps: int = 1, lr: float = 0.5,
                   q: float = 0.1, clip: float = 1.0, sigma: float = 1.1, delta: float = 1e-5,
                   budgets: dict[str, float] | None = None, global_budget: float = float("inf"), seed: int = 7,
                   min_clients: int = 1, client_col: str = "bank_id", x_col: str = "x", y_col: str = "label",
                   key: str = "TransactionID") -> DataFrame:
    """Rounds of a logistic model with private gradients and example-weighted averaging.

    A step moves a client's weights by ``lr`` times the noisy gradient sum over the expected
    sample size ``q * n``. Before a round, clients whose spent epsilon has reached their
    budget (``budgets``, else ``global_budget``) stop. Updates with a weight that is not
    finite or too large are left out; with fewer than ``min_clients`` left the global model
    stays. Returns a row per round and client that took part (its local weights) and one
    ``global`` row per round, whose ``epsilon_spent`` is the largest of the round's clients.
    Rounds end when no client has budget. Only weight vectors reach the driver.
    """
    rows = features.select(client_col, key, x_col, y_col).where(F.col(client_col).isNotNull()).checkpoint(eager=True)
    size = {r[client_col]: r["count"] for r in rows.groupBy(client_col).count().collect()}
    spent = spent_by_round(spark, sorted(size), rounds, local_steps, q, sigma, delta)
    left = {c: (budgets or {}).get(c, global_budget) for c in sorted(size)}
    model = [0.0] * (dim + 1)
    out = []
    for rnd in range(1, rounds + 1):
        active = [c for c in left if spent[rnd - 1] < left[c]]
        if not active:
            break
        local, seen = {c: list(model) for c in active}, {c: (0, 0) for c in active}
        for step in range(1, local_steps + 1):
            weights = spark.createDataFrame([(c, w[:-1], w[-1]) for c, w in local.items()],
                                            f"{client_col} string, w array<double>, b double")
            got = private_gradients(rows, weights, dim, rnd, step, q, clip, sigma, seed, client_col, x_col, y_col, key)
            for r in got.collect():
                c = r[client_col]
                local[c] = [w - lr * g / (min(1.0, q) * size[c]) for w, g in zip(local[c], r["noisy"])]
                seen[c] = (seen[c][0] + r["sampled"], seen[c][1] + r["clipped"])
        good = {c: w for c, w in local.items() if valid_update(w[:-1], w[-1])}
        if len(good) >= max(1, min_clients):
            total = sum(size[c] for c in good)
            model = [sum(size[c] * w[i] for c, w in good.items()) / total for i in range(dim + 1)]
            out += [(rnd, c, size[c], *seen[c], w[:-1], w[-1], spent[rnd]) for c, w in sorted(good.items())]
        else:
            total = 0
        out.append((rnd, "global", total, *(sum(s[k] for s in seen.values()) for k in (0, 1)), model[:-1], model[-1],
                    spent[rnd]))
    return spark.createDataFrame(out, SCHEMA)
