"""Model-quality metrics over a distributed score table.

Scores never leave the cluster: ranking metrics are computed on the
per-distinct-score table with exact prefix sums (:func:`prefix_sums`), the
threshold metrics in one aggregate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudlake.functions.buckets import count_less_array
from fraudlake.functions.vectorized import bootstrap_walk
from fraudlake.operators.rank import prefix_sums

EPS = 1e-7


def logit(p: Column) -> Column:
    """ln(p/(1-p)) on p clamped to [1e-7, 1-1e-7]."""
    q = F.least(F.greatest(p, F.lit(EPS)), F.lit(1.0 - EPS))
    return F.log(q / (F.lit(1.0) - q))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def score_groups(df: DataFrame, score_col: str = "score", label_col: str = "label",
                 group_cols: list[str] | None = None, weight_col: str | None = None) -> DataFrame:
    """One row per (group, distinct score) with positive and negative weights."""
    g = list(group_cols or [])
    y = F.col(label_col).cast("long")
    wt = F.lit(1).cast("long") if weight_col is None else F.col(weight_col)
    return df.groupBy(*g, F.col(score_col).cast("double").alias("score")).agg(
        F.sum(wt * y).alias("pos"), F.sum(wt * (F.lit(1) - y)).alias("neg"))


def ranking_metrics(df: DataFrame, score_col: str = "score", label_col: str = "label",
                    group_cols: list[str] | None = None) -> DataFrame:
    """G1 + G2 per group: step average precision and Mann-Whitney AUROC.

    AP = sum over distinct scores (desc) of (R_n - R_{n-1}) * P_n;
    AUROC counts tied pairs 1/2. Undefined (one class) -> null.
    """
    g = list(group_cols or [])
    # the per-score table is read by the bucket-bound pass and the final pass;
    # it is small (distinct scores), so it is written once to the checkpoint dir
    t = score_groups(df, score_col, label_col, g).checkpoint(eager=True)
    c = prefix_sums(t, g, "score", ["pos", "neg"], descending=True)
    return _finish_ranking(c, g)


def _finish_ranking(c: DataFrame, g: list[str]) -> DataFrame:
    cp, cn = F.col("cum_pos").cast("double"), F.col("cum_neg").cast("double")
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    agg = c.groupBy(*g).agg(
        F.sum(F.when(pos > 0, pos * cp / (cp + cn)).otherwise(F.lit(0.0))).alias("_ap"),
        F.sum(neg * (cp - F.lit(0.5) * pos)).alias("_auc"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    P, N = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    return agg.select(
        *g,
        F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"),
        F.when(P > 0, F.col("_ap") / P).alias("average_precision"),
        F.when((P > 0) & (N > 0), F.col("_auc") / (P * N)).alias("auroc"))


def confusion(df: DataFrame, prob_col: str = "score", label_col: str = "label",
              group_cols: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Counts at ``prob > threshold``; precision/recall/F1 are 0 when undefined."""
    g = list(group_cols or [])
    pred = F.col(prob_col) > F.lit(threshold)
    y = F.col(label_col) == 1
    agg = df.groupBy(*g).agg(
        F.count_if(~pred & ~y).alias("tn"), F.count_if(pred & ~y).alias("fp"),
        F.count_if(~pred & y).alias("fn"), F.count_if(pred & y).alias("tp"))
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    prec = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    rec = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    out = agg.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * F.col("precision") * F.col("recall"),
                                 F.col("precision") + F.col("recall")), F.lit(0.0))
    return out.withColumn("f1", f1)


def bce_terms(x: Column, y: Column, pos_weight: float | None = None) -> Column:
    """Per-row stable logit cross-entropy (optionally positive-weighted)."""
    yd = y.cast("double")
    soft = F.log1p(F.exp(-F.abs(x)))
    if pos_weight is None:
        return F.greatest(x, F.lit(0.0)) - x * yd + soft
    p = F.lit(float(pos_weight))
    return (F.lit(1.0) - yd) * x + (F.lit(1.0) + (p - F.lit(1.0)) * yd) * (
        soft + F.greatest(-x, F.lit(0.0)))


def bce_loss(df: DataFrame, logit_col: str = "logit", label_col: str = "label",
             group_cols: list[str] | None = None, pos_weight: float | None = None) -> DataFrame:
    """Mean cross-entropy on logits."""
    return df.groupBy(*(group_cols or [])).agg(
        F.avg(bce_terms(F.col(logit_col), F.col(label_col), pos_weight)).alias("bce_loss"))


def focal_loss(df: DataFrame, logit_col: str = "logit", label_col: str = "label",
               alpha: float = 0.25, gamma: float = 2.0,
               group_cols: list[str] | None = None) -> DataFrame:
    """Mean of alpha_t * (1 - p_t)^gamma * bce."""
    x, y = F.col(logit_col), F.col(label_col).cast("double")
    p = sigmoid(x)
    pt = p * y + (F.lit(1.0) - p) * (F.lit(1.0) - y)
    at = F.lit(alpha) * y + F.lit(1.0 - alpha) * (F.lit(1.0) - y)
    term = at * F.pow(F.lit(1.0) - pt, F.lit(gamma)) * bce_terms(x, F.col(label_col))
    return df.groupBy(*(group_cols or [])).agg(F.avg(term).alias("focal_loss"))


def accuracy(df: DataFrame, prob_col: str = "score", label_col: str = "label",
             group_cols: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Share of rows whose class at ``prob > threshold`` equals the label."""
    pred = (F.col(prob_col) > F.lit(threshold)).cast("int")
    return df.groupBy(*(group_cols or [])).agg(
        F.avg((pred == F.col(label_col)).cast("double")).alias("accuracy"))


def score_stats(df: DataFrame, prob_col: str = "score",
                group_cols: list[str] | None = None) -> DataFrame:
    """Mean and population sd of predictions."""
    return df.groupBy(*(group_cols or [])).agg(
        F.avg(prob_col).alias("mean_score"), F.stddev_pop(prob_col).alias("sd_score"),
        F.count(F.lit(1)).alias("n"))


def predictions_by_class(df: DataFrame, prob_col: str = "score", client_col: str = "bank_id",
                         threshold: float = 0.5) -> DataFrame:
    """Predicted fraud / legitimate counts per client."""
    cls = F.when(F.col(prob_col) > F.lit(threshold), F.lit("fraud")).otherwise(F.lit("legitimate"))
    return df.groupBy(client_col, cls.alias("predicted_class")).agg(
        F.count(F.lit(1)).alias("predictions"))


def per_bank_eval(df: DataFrame, prob_col: str = "score", label_col: str = "label",
                  bank_col: str = "bank_id", threshold: float = 0.5) -> DataFrame:
    """G1-G4 per bank plus the unweighted mean over banks (bank ``mean``).

    One pass over the rows: everything is derived from the per-(bank, score)
    table of positive and negative counts (threshold metrics and the loss are
    functions of the score), which is checkpointed once.
    """
    g = [bank_col]
    t = score_groups(df, prob_col, label_col, g).checkpoint(eager=True)
    rk = _finish_ranking(prefix_sums(t, g, "score", ["pos", "neg"], descending=True), g)
    x = logit(F.col("score"))
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    above = F.col("score") > F.lit(threshold)
    th = t.groupBy(*g).agg(
        F.sum(F.when(above, F.col("pos")).otherwise(0)).cast("double").alias("_tp"),
        F.sum(F.when(above, F.col("neg")).otherwise(0)).cast("double").alias("_fp"),
        F.sum(F.when(~above, F.col("pos")).otherwise(0)).cast("double").alias("_fn"),
        (F.sum(pos * bce_terms(x, F.lit(1)) + neg * bce_terms(x, F.lit(0)))
         / F.sum(pos + neg)).alias("bce_loss"))
    prec = F.coalesce(F.try_divide(F.col("_tp"), F.col("_tp") + F.col("_fp")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("_tp"), F.col("_tp") + F.col("_fn")), F.lit(0.0))
    th = th.withColumn("precision", prec).withColumn("recall", rec).withColumn(
        "f1", F.coalesce(F.try_divide(F.lit(2.0) * F.col("precision") * F.col("recall"),
                                      F.col("precision") + F.col("recall")), F.lit(0.0)))
    per = rk.join(th, bank_col).select(
        bank_col, "n_pos", "n_neg", "average_precision", "auroc", "precision", "recall", "f1",
        "bce_loss")
    metrics = ["average_precision", "auroc", "precision", "recall", "f1", "bce_loss"]
    mean = per.agg(F.lit("mean").alias(bank_col), F.sum("n_pos").alias("n_pos"),
                   F.sum("n_neg").alias("n_neg"), *[F.avg(m).alias(m) for m in metrics])
    return per.unionByName(mean)


SCORES_PER_TASK = 20_000      # distinct scores that one task walks
REPLICATES_PER_TASK = 32      # replicates of a task at least


def bootstrap_ci(df: DataFrame, score_col: str = "score", label_col: str = "label",
                 n_boot: int = 1000, seed: int = 42, level: float = 0.95,
                 scores_per_task: int | None = None) -> DataFrame:
    """Poisson bootstrap of AP and AUROC with percentile intervals.

    A resample of n rows with replacement is approximated by independent
    Poisson(1) row weights; the sum over a (score, label) group of size c is
    Poisson(c), so one draw per group and replicate suffices. Draws come from md5 of
    (score, label, replicate, seed), so any partitioning gives the same result. Scores are
    never binned. Replicates with a single class are skipped; rows with a null score or
    label take no part.

    Two passes over the distinct scores, cut into ranges: the first adds up every range's
    weights per replicate, the second walks each range downwards with a running sum per
    replicate, starting at the weights of the ranges above. Only totals are shuffled,
    ranges x replicates; draws exist a few hundred scores at a time. A task takes one range
    and one block of replicates, so few scores are spread over the cluster as well.
    """
    scores_per_task = scores_per_task or SCORES_PER_TASK
    s, y = F.col(score_col).cast("double"), F.col(label_col).cast("long")
    base = df.select(s.alias("score"), y.alias("label")).where("score is not null and label is not null")
    # one pass over the rows: counts per distinct score, written once
    groups = base.groupBy("score").agg(F.sum("label").alias("n_pos"), F.sum(1 - F.col("label")).alias("n_neg")) \
        .checkpoint(eager=True)
    n_ranges = -(-groups.count() // scores_per_task)
    bounds: list[float] = []
    if n_ranges > 1:
        bounds = sorted(set(groups.agg(F.percentile_approx(
            "score", [i / n_ranges for i in range(1, n_ranges)], 20 * n_ranges)).first()[0]))
    wanted = -(-2 * df.sparkSession.sparkContext.defaultParallelism // max(1, n_ranges))
    block = -(-n_boot // max(1, min(wanted, n_boot // REPLICATES_PER_TASK)))        # replicates of a task
    n_blocks = -(-n_boot // block)
    # score enters the hash as an integer (1e-12 units) so the key text is the
    # same in every engine
    groups = groups.withColumn("range", count_less_array(F.col("score"), bounds)) \
        .withColumn("key", F.round(F.col("score") * F.lit(1e12)).cast("long")) \
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))) \
        .repartition(max(1, n_ranges * n_blocks), "range", "block")

    def replicates(of: int) -> list[int]:
        return list(range(of * block, min(n_boot, (of + 1) * block)))

    def totals(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        reps = replicates(key[1])
        pos, neg, _, _ = bootstrap_walk(part, None, reps, seed)
        return pd.DataFrame({"range": key[0], "block": key[1], "rep": reps, "pos": pos, "neg": neg})

    def walk(key: tuple, part: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        reps = replicates(key[1])
        start = np.zeros((len(reps), 2), dtype=np.int64)
        start[above["rep"].to_numpy() - reps[0]] = above[["pos", "neg"]].to_numpy()
        pos, neg, steps, pairs = bootstrap_walk(part, start, reps, seed)
        return pd.DataFrame({"rep": reps, "pos": pos, "neg": neg, "steps": steps, "pairs": pairs})

    def walk_all(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return walk(key, part, pd.DataFrame({"rep": [], "pos": [], "neg": []}, dtype=np.int64))

    out = "rep int, pos bigint, neg bigint, steps double, pairs double"
    keys = ["range", "block"]
    if n_ranges <= 1:
        parts = groups.groupBy(*keys).applyInPandas(walk_all, out)
    else:
        higher = Window.partitionBy("rep").orderBy(F.col("range").desc()).rowsBetween(
            Window.unboundedPreceding, -1)
        above = groups.groupBy(*keys).applyInPandas(
            totals, "range int, block int, rep int, pos bigint, neg bigint").select(
            *keys, "rep", *[F.coalesce(F.sum(c).over(higher), F.lit(0)).alias(c) for c in ("pos", "neg")])
        parts = groups.groupBy(*keys).cogroup(above.groupBy(*keys)).applyInPandas(walk, out)
    P, N = F.col("pos").cast("double"), F.col("neg").cast("double")
    rep_metrics = parts.groupBy("rep").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "steps", "pairs")]) \
        .where("pos > 0 and neg > 0").select((F.col("steps") / P).alias("average_precision"),
                                             (F.col("pairs") / (P * N)).alias("auroc"))
    lo, hi = (1.0 - level) / 2.0, 1.0 - (1.0 - level) / 2.0
    return rep_metrics.agg(
        F.count(F.lit(1)).alias("n_valid"),
        F.percentile("average_precision", F.lit(lo)).alias("ap_lower"),
        F.percentile("average_precision", F.lit(hi)).alias("ap_upper"),
        F.percentile("auroc", F.lit(lo)).alias("auroc_lower"),
        F.percentile("auroc", F.lit(hi)).alias("auroc_upper"))
