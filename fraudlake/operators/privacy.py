"""Differential-privacy bookkeeping on tables.

Clipping and noisy sums work on exploded update vectors. The ledger is a
Renyi-DP accountant for the Poisson-subsampled Gaussian mechanism at integer
orders (published bound): per order alpha

    A_alpha = sum_k C(alpha, k) (1-q)^(alpha-k) q^k exp((k^2 - k) / (2 sigma^2))
    rdp(alpha) = log(A_alpha) / (alpha - 1)

composed additively over steps and converted with
``eps = min_alpha rdp + log((alpha-1)/alpha) - (log delta + log alpha)/(alpha-1)``.
It is an upper bound, not a numerical accountant's digits.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fraudlake.functions.hashrand import normal_pair, uniform
from fraudlake.operators.rounds import explode_weights, l2

MAX_ORDER = 64


def clip_rows(df: DataFrame, clip: float = 1.0, w_col: str = "w") -> DataFrame:
    """Scale each vector to L2 norm <= clip (zero vectors unchanged)."""
    norm = l2(F.col(w_col))
    factor = F.when(norm > 0, F.least(F.lit(1.0), F.lit(clip) / norm)).otherwise(F.lit(1.0))
    return (df.withColumn("norm_before", norm)
            .withColumn(w_col, F.transform(w_col, lambda x: x * factor))
            .withColumn("norm_after", l2(F.col(w_col))))


def noisy_sum(updates: DataFrame, clip: float = 1.0, sigma: float = 1.1, seed: int = 7,
              keys: tuple[str, ...] = ("round", "tensor")) -> DataFrame:
    """Sum of clipped vectors per key and position, plus N(0, (sigma*clip)^2)
    noise per coordinate from md5 uniforms (Box-Muller)."""
    clipped = clip_rows(updates, clip).drop("norm_before", "norm_after")
    x = explode_weights(clipped)
    s = x.groupBy(*keys, "pos").agg(F.sum("v").alias("clean_sum"))
    parts = [F.col(k).cast("string") for k in keys] + [F.col("pos").cast("string")]
    z = normal_pair(uniform(*parts, seed=seed), uniform(*parts, seed=f"{seed}b"))
    return s.withColumn("noisy_sum", F.col("clean_sum") + F.lit(sigma * clip) * z)


def noise_check(noisy: DataFrame, keys: tuple[str, ...] = ("round", "tensor"),
                min_distance: float = 1e-6) -> DataFrame:
    """Mean L2 distance between clean and noisy vectors; noise present flag."""
    d = noisy.groupBy(*keys).agg(
        F.sqrt(F.sum((F.col("noisy_sum") - F.col("clean_sum")) ** 2)).alias("dist"))
    return d.agg(F.avg("dist").alias("mean_distance")).withColumn(
        "noise_added", F.col("mean_distance") > F.lit(min_distance))


def rdp_orders(pairs: DataFrame, max_order: int = MAX_ORDER) -> DataFrame:
    """RDP of one subsampled-Gaussian step per row of ``pairs`` (q, sigma and any
    other columns) and integer order: one row per input row and order, computed
    in place. Log-space sum over k with the log binomial built by recurrence."""
    a = pairs.select("*", F.explode(F.sequence(F.lit(2), F.lit(max_order))).alias("alpha"))
    logc = F.expr("aggregate(sequence(1, alpha), array(cast(0.0 as double)), "
                  "(acc, k) -> concat(acc, array(acc[k - 1] + ln(cast(alpha - k + 1 as double) / k))))")
    terms = F.expr(
        "transform(_logc, (lc, k) -> lc + (alpha - k) * ln(1.0 - q) + k * ln(q) "
        "+ (cast(k as double) * k - k) / (2.0 * sigma * sigma))")
    lse = F.expr("array_max(_terms) + ln(aggregate(_terms, cast(0.0 as double), "
                 "(s, t) -> s + exp(t - array_max(_terms))))")
    full = F.col("alpha") / (F.lit(2.0) * F.col("sigma") * F.col("sigma"))
    out = (a.withColumn("_logc", logc).withColumn("_terms", terms)
           .withColumn("rdp", F.when(F.col("q") >= 1.0, full)
                       .otherwise(lse / (F.col("alpha") - F.lit(1)))))
    return out.drop("_logc", "_terms")


def epsilon_ledger(steps: DataFrame, delta: float = 1e-5, max_order: int = MAX_ORDER,
                   run_cols: tuple[str, ...] = ("client_id", "run_id"),
                   order_col: str = "round") -> DataFrame:
    """Epsilon spent after each step row per run (restarts per run).

    ``steps`` rows: run columns, ``round``, ``steps`` (count), ``q``, ``sigma``.
    RDP is composed by a running sum per (run, order) over rounds: the table
    is rounds x orders, never rows of the data.
    """
    per = rdp_orders(steps, max_order)
    w = Window.partitionBy(*run_cols, "alpha").orderBy(order_col).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    cum = per.withColumn("cum_rdp", F.sum(F.col("steps") * F.col("rdp")).over(w))
    a = F.col("alpha").cast("double")
    eps = (F.col("cum_rdp") + F.log((a - 1) / a)
           - (F.lit(math.log(delta)) + F.log(a)) / (a - 1))
    return (cum.groupBy(*run_cols, order_col)
            .agg(F.min(eps).alias("epsilon_spent"), F.max("steps").alias("steps"))
            .withColumn("delta", F.lit(delta)))


def budget_join(ledger: DataFrame, budgets: DataFrame, global_budget: float,
                client_col: str = "client_id") -> DataFrame:
    """C4: per-client budget with the global value as fallback (budget table is
    configuration, one row per client: broadcast)."""
    j = ledger.join(F.broadcast(budgets), client_col, "left")
    return j.withColumn("budget_source", F.when(F.col("budget").isNull(), F.lit("global"))
                        .otherwise(F.lit("bank"))) \
        .withColumn("budget", F.coalesce(F.col("budget"), F.lit(float(global_budget))))


def budget_status(df: DataFrame, strict: bool = False) -> DataFrame:
    """P5: remaining = max(0, budget - spent); exhausted when spent >= budget
    (``strict``: spent > budget)."""
    spent, total = F.col("epsilon_spent"), F.col("budget")
    exhausted = spent > total if strict else spent >= total
    return df.withColumn("remaining", F.greatest(F.lit(0.0), total - spent)) \
        .withColumn("exhausted", exhausted)


def enforce_budget(df: DataFrame) -> DataFrame:
    """Keep client-rounds whose spent epsilon is still below the budget."""
    return df.where(F.col("epsilon_spent") < F.col("budget"))


def privacy_summary(status: DataFrame, client_col: str = "client_id",
                    order_col: str = "round") -> DataFrame:
    """Latest ledger row per client with totals."""
    cols = [c for c in status.columns if c not in (client_col,)]
    return status.groupBy(client_col).agg(
        F.max_by(F.struct(*cols), F.col(order_col)).alias("_l"),
        F.sum("steps").alias("total_steps"), F.count(F.lit(1)).alias("rounds")) \
        .select(client_col, "_l.*", "total_steps", "rounds")


def utility_curve(results: DataFrame, metric_cols: list[str]) -> DataFrame:
    """One point per epsilon, the latest result (ts, then seq) wins; ascending."""
    last = results.groupBy("epsilon").agg(
        F.max_by(F.struct(*metric_cols), F.struct("ts", "seq")).alias("_p"))
    return last.select("epsilon", *[F.col(f"_p.{c}").alias(c) for c in metric_cols]) \
        .orderBy("epsilon")


def utility_summary(curve: DataFrame, metric: str = "auprc") -> DataFrame:
    """P10: count, ranges, metric change from min to max epsilon (0 with < 2
    points) and the best epsilon (smallest on ties)."""
    agg = curve.agg(
        F.count(F.lit(1)).alias("points"),
        F.min("epsilon").alias("min_epsilon"), F.max("epsilon").alias("max_epsilon"),
        F.min(metric).alias(f"min_{metric}"), F.max(metric).alias(f"max_{metric}"),
        F.max_by(metric, "epsilon").alias("_at_max"), F.min_by(metric, "epsilon").alias("_at_min"),
        F.max(F.struct(F.col(metric), (-F.col("epsilon")).alias("_ne"))).alias("_best"))
    return agg.select(
        "points", "min_epsilon", "max_epsilon", f"min_{metric}", f"max_{metric}",
        F.when(F.col("points") >= 2, F.col("_at_max") - F.col("_at_min")).otherwise(F.lit(0.0))
        .alias("utility_gain"),
        (-F.col("_best._ne")).alias("best_epsilon"))
