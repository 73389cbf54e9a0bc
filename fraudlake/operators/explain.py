"""Explanations: additive attributions, top features, importance, audit rows
(SURVEY 2.11, 2.10).

For a linear logit the exact Shapley value of feature j against a background
mean is ``w_j (x_j - mean_j)``; it is computed per row with array
expressions (no shuffle). The model-agnostic sampled form for the probability
runs as Arrow batches in :mod:`fraudlake.functions.vectorized`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudlake.operators.metrics import sigmoid
from fraudlake.operators.rounds import linear_logit


def background_mean(background: DataFrame, dim: int, x_col: str = "x") -> list[float]:
    """Mean feature vector of the background sample (d numbers to the driver)."""
    row = background.agg(*[F.avg(F.col(x_col)[i]).alias(f"m{i}") for i in range(dim)]).first()
    return [float(row[f"m{i}"]) for i in range(dim)]


def attribute_linear(df: DataFrame, weights: list[float], bias: float, mean: list[float],
                     x_col: str = "x") -> DataFrame:
    """Contributions ``w_j (x_j - mean_j)``, base ``b + w.mean`` and logit;
    contributions + base = logit."""
    w = F.array(*[F.lit(float(v)) for v in weights])
    m = F.array(*[F.lit(float(v)) for v in mean])
    diff = F.zip_with(F.col(x_col), m, lambda a, b: a - b)
    contrib = F.zip_with(diff, w, lambda d, wi: d * wi)
    base = float(bias) + sum(float(a) * float(b) for a, b in zip(weights, mean))
    return (df.withColumn("contributions", contrib)
            .withColumn("base_value", F.lit(base))
            .withColumn("logit", linear_logit(F.col(x_col), w, F.lit(float(bias)))))


def _items(names: list[str], contrib: str, x_col: str) -> Column:
    return F.array(*[F.struct(
        (F.lit(0.0) - F.abs(F.col(contrib)[i])).alias("_neg_abs"), F.lit(i).alias("_pos"),
        F.lit(n).alias("feature"), F.col(contrib)[i].alias("shap_value"),
        F.col(x_col)[i].alias("feature_value"),
        F.abs(F.col(contrib)[i]).alias("abs_contribution")) for i, n in enumerate(names)])


def top_features(names: list[str], k: int = 10, contrib: str = "contributions",
                 x_col: str = "x") -> Column:
    """Top ``k`` features by |contribution| per row; ties keep feature order.

    A per-row sort of a d-element array: no shuffle."""
    ranked = F.slice(F.sort_array(_items(names, contrib, x_col)), 1, k)
    return F.transform(ranked, lambda s: F.struct(
        s["feature"].alias("feature"), s["shap_value"].alias("shap_value"),
        s["feature_value"].alias("feature_value"),
        s["abs_contribution"].alias("abs_contribution")))


def feature_names(top: Column) -> Column:
    return F.array_join(F.transform(top, lambda s: s["feature"]), ",")


def explain_rows(attributed: DataFrame, names: list[str], k: int = 10,
                 x_col: str = "x") -> DataFrame:
    """Prediction, class (> 0.5), confidence max(p, 1-p), top-k features,
    all feature values and the base value."""
    p = sigmoid(F.col("logit"))
    return attributed.select(
        "*", p.alias("prediction"), (p > 0.5).cast("int").alias("predicted_class"),
        F.greatest(p, F.lit(1.0) - p).alias("confidence"),
        top_features(names, k, "contributions", x_col).alias("top_features"),
        F.col(x_col).alias("feature_values"))


def global_importance(attributed: DataFrame, names: list[str]) -> DataFrame:
    """Mean |contribution| per feature, descending (aggregates partially per task)."""
    e = attributed.select(F.posexplode("contributions").alias("pos", "c"))
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("pos") + 1)
    return e.groupBy(name.alias("feature")).agg(F.avg(F.abs("c")).alias("importance"))


def global_top(importance: DataFrame, n: int = 10) -> DataFrame:
    """T4: top ``n`` features overall (a top-n, ties by name)."""
    return importance.orderBy(F.col("importance").desc(), "feature").limit(n)


def explain_summary(explained: DataFrame) -> DataFrame:
    """Number of explanations, fraud rate, mean prediction and, per feature,
    the sum of |contribution| over appearances in top lists / explanations."""
    # the totals are one row: fetched once and used as literals
    tot = explained.agg(F.count(F.lit(1)).alias("n"),
                        F.avg(F.col("predicted_class").cast("double")).alias("fraud_rate"),
                        F.avg("prediction").alias("mean_prediction")).first()
    feats = explained.select(F.explode("top_features").alias("t")).groupBy(
        F.col("t.feature").alias("feature")).agg(F.sum("t.abs_contribution").alias("_s"))
    return feats.select(
        "feature", F.lit(tot["n"]).cast("long").alias("n_explanations"),
        F.lit(tot["fraud_rate"]).cast("double").alias("fraud_rate"),
        F.lit(tot["mean_prediction"]).cast("double").alias("mean_prediction"),
        (F.col("_s") / F.lit(tot["n"])).alias("avg_importance"))


def audit_trail(explained: DataFrame, key: str, ts, user: str, model_type: str,
                top: int = 5) -> DataFrame:
    """One audit row per explained transaction with the first ``top`` features."""
    return explained.select(
        F.col(key).alias("transaction_id"), F.lit(ts).cast("timestamp").alias("ts"),
        F.lit(user).alias("user"), "prediction", "predicted_class", "confidence",
        feature_names(F.slice("top_features", 1, top)).alias("top_features"),
        F.lit(model_type).alias("model_type"))


# fixed values: fields an explanation must carry
REQUIRED_FIELDS = ["prediction", "prediction_class", "confidence", "top_features",
                   "all_shap_values"]


def explanation_complete(expl: DataFrame, required: list[str] = REQUIRED_FIELDS) -> DataFrame:
    """Missing required fields per explanation (comma separated)."""
    missing = F.array_compact(F.array(*[
        F.when(F.col(c).isNull(), F.lit(c)) if c in expl.columns else F.lit(c)
        for c in required]))
    return expl.withColumn("missing_fields", F.array_join(missing, ",")) \
        .withColumn("complete", F.size(missing) == 0)


def union_banks(frames: list[DataFrame]) -> DataFrame:
    """Combine per-bank tables by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
