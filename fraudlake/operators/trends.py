"""Round-history trends: convergence, history, baseline comparison, summaries
(SURVEY 2.9). Inputs are per-round metric tables (rounds x runs rows), so
windows here run over aggregated round rows, never over raw data rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("auprc", "auroc", "loss")


def convergence(df: DataFrame, run_col: str = "client_id", round_col: str = "round",
                metric: str = "auprc", window: int = 3, threshold: float = 0.01) -> DataFrame:
    """Population sd of the last ``window`` rounds as of each round;
    fewer rounds -> (False, 1.0)."""
    w = Window.partitionBy(run_col).orderBy(round_col).rowsBetween(-(window - 1), 0)
    seen = Window.partitionBy(run_col).orderBy(round_col).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_n", F.count(F.lit(1)).over(seen)) \
        .withColumn("_sd", F.stddev_pop(metric).over(w))
    score = F.when(F.col("_n") < window, F.lit(1.0)).otherwise(F.col("_sd"))
    return out.withColumn("convergence_score", score) \
        .withColumn("converged", (F.col("_n") >= window) & (F.col("_sd") < threshold)) \
        .drop("_n", "_sd")


def history(df: DataFrame, run_col: str = "client_id", round_col: str = "round",
            metrics=METRICS) -> DataFrame:
    """Per run and metric, rounds and values sorted by round."""
    parts = []
    for m in metrics:
        h = df.groupBy(run_col).agg(F.sort_array(F.collect_list(F.struct(round_col, m))).alias("_h"))
        parts.append(h.select(run_col, F.lit(m).alias("metric"),
                              F.col(f"_h.{round_col}").alias("rounds"),
                              F.col(f"_h.{m}").alias("values")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def baseline_join(current: DataFrame, baseline: DataFrame, run_col: str = "client_id",
                  metrics=METRICS) -> DataFrame:
    """Current metrics beside the baseline of the same run (shared metrics only)."""
    b = baseline.select(run_col, *[F.col(m).alias(f"{m}_baseline") for m in metrics
                                   if m in baseline.columns])
    c = current.select(run_col, *[F.col(m).alias(f"{m}_current") for m in metrics
                                  if m in current.columns])
    return c.join(b, run_col)


def degradation(joined: DataFrame, run_col: str = "client_id", metrics=METRICS) -> DataFrame:
    """% degradation: (base - cur)/base*100, for loss (cur - base)/base*100."""
    cols = []
    for m in metrics:
        if f"{m}_current" not in joined.columns or f"{m}_baseline" not in joined.columns:
            continue
        cur, base = F.col(f"{m}_current"), F.col(f"{m}_baseline")
        d = (cur - base) if m == "loss" else (base - cur)
        cols.append(F.try_divide(d * 100.0, base).alias(f"{m}_degradation_pct"))
    return joined.select("*", *cols)


def metric_summary(df: DataFrame, run_col: str = "client_id", round_col: str = "round",
                   metrics=METRICS) -> DataFrame:
    """Mean, population sd, min, max and final (highest round) per run and metric."""
    parts = []
    for m in metrics:
        parts.append(df.groupBy(run_col).agg(
            F.lit(m).alias("metric"), F.count(F.lit(1)).alias("num_rounds"),
            F.avg(m).alias("mean"), F.stddev_pop(m).alias("std"), F.min(m).alias("min"),
            F.max(m).alias("max"), F.max_by(m, round_col).alias("final")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def final_round(df: DataFrame, baseline: DataFrame, run_col: str = "client_id",
                round_col: str = "round", metrics=METRICS) -> DataFrame:
    """Metrics of the highest round with its convergence state and the
    baseline comparison."""
    conv = convergence(df, run_col, round_col)
    last = conv.groupBy(run_col).agg(F.max_by(F.struct(
        round_col, *metrics, "convergence_score", "converged"), F.col(round_col)).alias("_l"))
    last = last.select(run_col, "_l.*")
    deg = degradation(baseline_join(last, baseline, run_col, metrics), run_col, metrics)
    return last.join(deg.select(run_col, *[c for c in deg.columns if c.endswith("_pct")]), run_col)


def rounds_completed(outcomes: DataFrame, run_col: str = "client_id",
                     round_col: str = "round") -> DataFrame:
    """Highest successful round so far (null before the first success)."""
    w = Window.partitionBy(run_col).orderBy(round_col).rowsBetween(Window.unboundedPreceding, 0)
    return outcomes.withColumn("rounds_completed", F.max(
        F.when(F.col("status") == "success", F.col(round_col))).over(w))
