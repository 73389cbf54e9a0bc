"""Federated-round operators on tables.

Clients are values of ``client_id``; model updates are rows
``(round, client_id, tensor, w ARRAY<DOUBLE>, num_examples)``. Element-wise
work is exploded to ``(…, pos, value)`` so it is spread over parameters and
clients instead of being held in one row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudlake.operators.metrics import bce_terms, ranking_metrics, sigmoid

# fixed values: metric keys aggregated by maximum instead of weighted mean
MAX_KEYS = ("epsilon", "delta")


def long_metrics(df: DataFrame, id_cols: list[str], metric_cols: list[str]) -> DataFrame:
    """Wide metrics -> (id..., key, value); null values are missing keys (dropped)."""
    stack = ", ".join(f"'{c}', cast(`{c}` as double)" for c in metric_cols)
    return df.selectExpr(*id_cols, f"stack({len(metric_cols)}, {stack}) as (key, value)") \
        .where(F.col("value").isNotNull())


def aggregate_metrics(long: DataFrame, round_col: str = "round", client_col: str = "client_id",
                      n_col: str = "num_examples", max_keys: tuple[str, ...] = MAX_KEYS,
                      keys: str = "first") -> DataFrame:
    """H1/H2: example-weighted mean per (round, key); ``max_keys`` by maximum.

    A client without a key counts 0 for it but its examples stay in the
    denominator. Key set per round: keys of the lexicographically first client
    (``keys="first"``) or of any client (``"union"``).
    """
    clients = long.groupBy(round_col, client_col).agg(F.max(n_col).alias("_n"))
    totals = clients.groupBy(round_col).agg(F.sum("_n").alias("_total"),
                                            F.min(client_col).alias("_first"))
    # the smallest client of a key is the round's first one if that has the key
    sums = long.groupBy(round_col, "key").agg(
        F.sum(F.col(n_col) * F.col("value")).alias("_nv"), F.max("value").alias("_max"),
        F.min(client_col).alias("_smallest"))
    j = sums.join(totals, round_col)
    if keys == "first":
        j = j.where(F.col("_smallest") == F.col("_first"))
    value = F.when(F.col("key").isin(*max_keys), F.col("_max")).otherwise(
        F.col("_nv") / F.col("_total"))
    return j.select(round_col, "key", value.alias("value"))


def explode_weights(updates: DataFrame, w_col: str = "w") -> DataFrame:
    keep = [c for c in updates.columns if c != w_col]
    return updates.select(*keep, F.posexplode(w_col).alias("pos", "v"))


def fedavg(updates: DataFrame, weighted: bool = True, round_col: str = "round",
           n_col: str = "num_examples") -> DataFrame:
    """H3: element-wise (example-weighted) mean per (round, tensor, pos) in long form."""
    x = explode_weights(updates)
    n = F.col(n_col).cast("double") if weighted else F.lit(1.0)
    return x.groupBy(round_col, "tensor", "pos").agg(
        (F.sum(n * F.col("v")) / F.sum(n)).alias("value"))


def to_vectors(long: DataFrame, keys: list[str], pos_col: str = "pos",
               value_col: str = "value") -> DataFrame:
    """Long (pos, value) -> one ordered array per key."""
    return long.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(pos_col, value_col)))
                                   .alias("_pv")).select(*keys, F.col(f"_pv.{value_col}").alias("w"))


def min_clients(updates: DataFrame, minimum: int = 2, round_col: str = "round",
                client_col: str = "client_id") -> DataFrame:
    """H4: rounds with at least ``minimum`` clients complete; others are skipped."""
    per = updates.groupBy(round_col).agg(F.count_distinct(client_col).alias("n_clients"))
    return per.withColumn("status", F.when(F.col("n_clients") >= minimum, F.lit("completed"))
                          .otherwise(F.lit("skipped")))


def weight_checks(updates: DataFrame, max_abs: float = 100.0, round_col: str = "round",
                  w_col: str = "w") -> DataFrame:
    """H5: reject NaN/Inf, wrong length (vs the modal length per round and
    tensor, smallest on ties) or max |w| >= ``max_abs``."""
    sized = updates.withColumn("_len", F.size(w_col))
    modal = sized.groupBy(round_col, "tensor").agg(
        F.mode("_len", deterministic=True).alias("_modal"))
    j = sized.join(modal, [round_col, "tensor"])
    nonfinite = F.exists(w_col, lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    too_big = F.array_max(F.transform(w_col, lambda x: F.abs(x))) >= F.lit(max_abs)
    reason = (F.when(nonfinite, F.lit("nan_or_inf"))
              .when(F.col("_len") != F.col("_modal"), F.lit("wrong_shape"))
              .when(too_big, F.lit("too_large")))
    return j.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull()) \
        .drop("_len", "_modal")


def l2(w: Column) -> Column:
    return F.sqrt(F.aggregate(w, F.lit(0.0), lambda acc, x: acc + x * x))


def norm_outliers(updates: DataFrame, k: float = 2.0, round_col: str = "round",
                  w_col: str = "w", method: str = "sd") -> DataFrame:
    """H6: norm per update; outlier when |norm - mean| > k * population sd
    within (round, tensor). Needs >= 6 clients to ever fire with k = 2.

    ``method="mad"``: |norm - median| > k * median absolute deviation, which a
    single extreme client cannot mask (groups hold one row per client)."""
    normed = updates.withColumn("norm", l2(F.col(w_col)))
    keys = [round_col, "tensor"]
    if method == "mad":
        med = normed.groupBy(*keys).agg(F.percentile("norm", 0.5).alias("_mu"))
        dev = normed.join(med, keys).withColumn("_d", F.abs(F.col("norm") - F.col("_mu")))
        mad = dev.groupBy(*keys).agg(F.percentile("_d", 0.5).alias("_sd"))
        j = dev.drop("_d").join(mad, keys)
    else:
        stats = normed.groupBy(*keys).agg(F.avg("norm").alias("_mu"),
                                          F.stddev_pop("norm").alias("_sd"))
        j = normed.join(stats, keys)
    return j.withColumn("outlier", F.abs(F.col("norm") - F.col("_mu")) > F.lit(k) * F.col("_sd")) \
        .drop("_mu", "_sd")


def weight_change(updates: DataFrame, round_col: str = "round", client_col: str = "client_id",
                  w_col: str = "w") -> DataFrame:
    """H7: L2 norm of the change from the previous round, over all tensors.

    The previous round is the last one the client took part in, so a missed
    round costs no row. A full join on (client, tensor, pos) keeps the work
    spread over parameters; a position that only one of the two vectors has
    counts as 0 in the other. A client's first round has no row."""
    x = explode_weights(updates.select(round_col, client_col, "tensor", w_col), w_col)
    # one row per client and round
    w = Window.partitionBy(client_col).orderBy(round_col)
    rounds = updates.select(client_col, round_col).distinct() \
        .withColumn("_next", F.lead(round_col).over(w)).where(F.col("_next").isNotNull())
    later = x.join(rounds.select(client_col, F.col("_next").alias(round_col)), [client_col, round_col])
    prev = x.join(rounds, [client_col, round_col]).select(
        F.col("_next").alias(round_col), client_col, "tensor", "pos", F.col("v").alias("_pv"))
    j = later.join(prev, [round_col, client_col, "tensor", "pos"], "full")
    change = F.coalesce("v", F.lit(0.0)) - F.coalesce("_pv", F.lit(0.0))
    return j.groupBy(round_col, client_col).agg(F.sqrt(F.sum(change ** 2)).alias("weight_change"))


def sample_counts(updates: DataFrame, round_col: str = "round", client_col: str = "client_id",
                  n_col: str = "num_examples") -> DataFrame:
    """H8: training rows per client per round."""
    return updates.groupBy(client_col, round_col).agg(F.sum(n_col).alias("samples"))


def linear_logit(x: Column, w: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(x, w, lambda a, c: a * c), F.lit(0.0), lambda s, v: s + v) + b


def score_rows(df: DataFrame, weights: list[float], bias: float, x_col: str = "x") -> DataFrame:
    """probability = sigmoid(w.x + b); class = probability > 0.5."""
    w = F.array(*[F.lit(float(v)) for v in weights])
    z = linear_logit(F.col(x_col), w, F.lit(float(bias)))
    return df.withColumn("logit", z).withColumn("probability", sigmoid(F.col("logit"))) \
        .withColumn("predicted_class", (F.col("probability") > 0.5).cast("int"))


def local_gradients(df: DataFrame, weights: DataFrame, dim: int, x_col: str = "x",
                    y_col: str = "label", client_col: str = "bank_id",
                    pos_weight: float | None = None) -> DataFrame:
    """One distributed pass: per client, sums of the gradient and of the loss.

    ``weights`` has one row per client ``(client, w ARRAY, b)`` and is broadcast
    (bounded by the number of clients). ``pos_weight`` weighs the positive rows
    in both."""
    j = df.join(F.broadcast(weights), client_col)
    z = linear_logit(F.col(x_col), F.col("w"), F.col("b"))
    r = j.select(client_col, F.col(x_col).alias("_x"), F.col(y_col).cast("double").alias("_y"),
                 z.alias("_z"))
    p = sigmoid(F.col("_z"))
    err = p - F.col("_y") if pos_weight is None else \
        (1 - F.col("_y")) * p - float(pos_weight) * F.col("_y") * (1 - p)
    return r.groupBy(client_col).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(err).alias("g_b"),
        F.array(*[F.sum(err * F.col("_x")[i]) for i in range(dim)]).alias("g_w"),
        F.sum(bce_terms(F.col("_z"), F.col("_y"), pos_weight)).alias("loss_sum"))


def evaluate_linear(df: DataFrame, weights: list[float], bias: float, x_col: str = "x",
                    y_col: str = "label", client_col: str = "bank_id",
                    pos_weight: float | None = None) -> DataFrame:
    """Validation of one model per client: rows, loss, AP, AUROC (null with one class)."""
    scored = score_rows(df.select(client_col, x_col, F.col(y_col).cast("double").alias("label")),
                        weights, bias, x_col)
    loss = scored.groupBy(client_col).agg(
        F.count(F.lit(1)).alias("n"), F.avg(bce_terms(F.col("logit"), F.col("label"), pos_weight)).alias("loss"))
    rank = ranking_metrics(scored, "logit", "label", [client_col]).select(
        client_col, "average_precision", "auroc")
    return loss.join(rank, client_col)          # one row per client on either side


MAX_ABS_WEIGHT = 100.0        # fixed value: larger weights make an update invalid (H5)


def valid_update(w: list[float], b: float) -> bool:
    """H5 on one update: finite and below the largest accepted weight."""
    return all(math.isfinite(v) and abs(v) < MAX_ABS_WEIGHT for v in [*w, b])


def federated_linear(spark, features: DataFrame, dim: int, rounds: int = 1,
                     local_steps: int = 1, lr: float = 0.5, mu: float = 0.0,
                     client_col: str = "bank_id", x_col: str = "x", y_col: str = "label",
                     state_path: str | None = None, checkpoint_every: int = 5,
                     pos_weight: float | None = None, min_clients: int = 1,
                     validation: DataFrame | None = None) -> DataFrame:
    """H9: FedAvg/FedProx rounds of a logistic model.

    Positive rows count ``pos_weight`` times in gradient and loss. An update with
    a weight that is not finite or too large (H5) is left out; with fewer than
    ``min_clients`` valid updates (H4) the global model stays as it was and the
    round has a global row with ``n`` = 0 only. With ``validation`` rows the new
    global model is evaluated per client and, weighted by rows, as a whole (H2).

    Each local step is one job (broadcast client weights, per-row gradient,
    grouped sums); only weight vectors reach the driver. The proximal term
    ``mu (w - w_global)`` is applied for real (``mu=0`` is plain FedAvg).
    Aggregation is example-weighted (H3). Returns one row per (round, client)
    plus the global model. With ``state_path`` the rows are appended every
    ``checkpoint_every`` rounds (A10) and a restarted run resumes after the
    last saved round.
    """
    from fraudlake.session import path_exists

    feats = features.select(client_col, x_col, y_col).checkpoint(eager=True)
    clients = [r[0] for r in feats.select(client_col).distinct().collect()]
    clients.sort()
    g_w, g_b = [0.0] * dim, 0.0
    out, start, saved = [], 1, 0
    if state_path and path_exists(spark, state_path):
        prev = spark.read.parquet(state_path).where(F.col("round") <= rounds)
        out = [tuple(r) for r in prev.select(*[f.split()[0] for f in _FED_SCHEMA.split(", ")])
               .orderBy("round", "client_id").collect()]
        last = max((r for r in out if r[1] == "global"), key=lambda r: r[0], default=None)
        if last is not None:
            start, g_w, g_b = last[0] + 1, list(last[4]), last[5]
        saved = len(out)
    for rnd in range(start, rounds + 1):
        local = {c: (list(g_w), g_b) for c in clients}
        stats = {}
        for _ in range(local_steps):
            wdf = spark.createDataFrame(
                [(c, local[c][0], local[c][1]) for c in clients],
                f"{client_col} string, w array<double>, b double")
            grads = {r[client_col]: r for r in local_gradients(
                feats, wdf, dim, x_col, y_col, client_col, pos_weight).collect()}
            for c in clients:
                gr = grads.get(c)
                if gr is None:
                    continue
                n = gr["n"]
                w, b = local[c]
                nw = [w[i] - lr * (gr["g_w"][i] / n + mu * (w[i] - g_w[i])) for i in range(dim)]
                nb = b - lr * (gr["g_b"] / n + mu * (b - g_b))
                local[c] = (nw, nb)
                stats[c] = (n, gr["loss_sum"] / n)
        stats = {c: s for c, s in stats.items() if valid_update(*local[c])}
        total = sum(stats[c][0] for c in stats)
        if len(stats) < max(1, min_clients):
            out.append((rnd, "global", 0, None, g_w, g_b, None, None, None))
        else:
            g_w = [sum(stats[c][0] * local[c][0][i] for c in stats) / total for i in range(dim)]
            g_b = sum(stats[c][0] * local[c][1] for c in stats) / total
            checks = {} if validation is None else {
                r[client_col]: (r["n"], r["loss"], r["average_precision"], r["auroc"])
                for r in evaluate_linear(validation, g_w, g_b, x_col, y_col, client_col, pos_weight).collect()}
            for c in clients:
                if c in stats:
                    out.append((rnd, c, *stats[c], *local[c], *checks.get(c, (0, None, None, None))[1:]))
            out.append((rnd, "global", total, sum(n * loss for n, loss in stats.values()) / total,
                        g_w, g_b, *(_weighted(checks, k) for k in (1, 2, 3))))
        if state_path and (rnd % checkpoint_every == 0 or rnd == rounds):
            spark.createDataFrame(out[saved:], _FED_SCHEMA).write.mode("append") \
                .parquet(state_path)
            saved = len(out)
    return spark.createDataFrame(out, _FED_SCHEMA)


_FED_SCHEMA = ("round int, client_id string, n long, train_loss double, w array<double>, "
               "b double, val_loss double, val_ap double, val_auroc double")


def _weighted(checks: dict, k: int) -> float | None:
    """Row-weighted mean of one validation metric over the clients that have it."""
    some = [(v[0], v[k]) for v in checks.values() if v[k] is not None]
    return sum(n * v for n, v in some) / sum(n for n, _ in some) if some else None


def best_run(metrics: DataFrame, run_col: str = "client_id", epoch_col: str = "round") -> DataFrame:
    """Epoch with the highest AUPRC per run (smallest epoch on ties), with AUROC."""
    best = metrics.groupBy(run_col).agg(
        F.max(F.struct(F.col("auprc"), (-F.col(epoch_col)).alias("_neg"), F.col("auroc")))
        .alias("_b"))
    return best.select(run_col, (-F.col("_b._neg")).alias("best_epoch"),
                       F.col("_b.auprc").alias("best_auprc"), F.col("_b.auroc").alias("auroc"))
