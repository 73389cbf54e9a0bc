"""Registered queries: evaluation metrics on the line-item score view."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraudlake.operators import metrics as M
from fraudlake.plans.registry import register
from fraudlake.sources import fixtures as fx

LI = ("lineitem_scores",)

RANK_SQL = """
sg as (select score, sum(label) as pos, count(*) - sum(label) as neg
   from lineitem_scores group by score),
cum as (select *, sum(pos) over w as cp, sum(neg) over w as cn from sg
   window w as (order by score desc rows between unbounded preceding and current row)),
rk as (select cast(sum(pos) as bigint) as n_pos, cast(sum(neg) as bigint) as n_neg,
   sum(case when pos > 0 then pos * cp / (cp + cn) else 0 end) / sum(pos) as average_precision,
   sum(neg * (cp - 0.5 * pos)) / (cast(sum(pos) as double) * sum(neg)) as auroc from cum)"""

LOGIT_SQL = ("ln(least(greatest(score, 1e-7), 1 - 1e-7) / "
             "(1 - least(greatest(score, 1e-7), 1 - 1e-7)))")


def scores(spark, sf_dir):
    return fx.lineitem_scores(spark, sf_dir)


@register("average_precision", "G1", views=LI, rounded={"average_precision": 9},
          sql=RANK_SQL + "\nselect n_pos, n_neg, average_precision from rk")
def q_average_precision(spark, sf_dir):
    """G1: step-form average precision over all line-item scores."""
    return M.ranking_metrics(scores(spark, sf_dir)).select("n_pos", "n_neg", "average_precision")


@register("auroc", "G2", views=LI, rounded={"auroc": 9},
          sql=RANK_SQL + "\nselect n_pos, n_neg, auroc from rk")
def q_auroc(spark, sf_dir):
    """Mann-Whitney AUROC with ties counted 1/2."""
    return M.ranking_metrics(scores(spark, sf_dir)).select("n_pos", "n_neg", "auroc")


@register("confusion", "G3", views=LI, rounded={"precision": 9, "recall": 9, "f1": 9}, sql="""
c as (select count(*) filter (where score <= 0.5 and label <> 1) as tn,
   count(*) filter (where score > 0.5 and label <> 1) as fp,
   count(*) filter (where score <= 0.5 and label = 1) as fn,
   count(*) filter (where score > 0.5 and label = 1) as tp from lineitem_scores),
p as (select *, coalesce(tp / nullif(cast(tp + fp as double), 0), 0) as precision,
   coalesce(tp / nullif(cast(tp + fn as double), 0), 0) as recall from c)
select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1 from p""")
def q_confusion(spark, sf_dir):
    """Confusion counts at p > 0.5 with precision, recall, F1."""
    return M.confusion(scores(spark, sf_dir))


@register("bce_loss", "G4", views=LI, rounded={"bce_loss": 9, "bce_loss_weighted": 9}, sql=f"""
x as (select {LOGIT_SQL} as x, cast(label as double) as y from lineitem_scores)
select avg(greatest(x, 0) - x * y + ln(1 + exp(-abs(x)))) as bce_loss,
  avg((1 - y) * x + (1 + (15.0 - 1) * y) * (ln(1 + exp(-abs(x))) + greatest(-x, 0)))
    as bce_loss_weighted from x""")
def q_bce_loss(spark, sf_dir):
    """Mean logit cross-entropy, plain and with positive weight 15."""
    df = scores(spark, sf_dir).withColumn("logit", M.logit(F.col("score")))
    return df.agg(
        F.avg(M.bce_terms(F.col("logit"), F.col("label"))).alias("bce_loss"),
        F.avg(M.bce_terms(F.col("logit"), F.col("label"), 15.0)).alias("bce_loss_weighted"))


@register("focal_loss", "G5", views=LI, rounded={"focal_loss": 9}, sql=f"""
x as (select {LOGIT_SQL} as x, cast(label as double) as y from lineitem_scores),
p as (select *, 1 / (1 + exp(-x)) as p from x)
select avg((0.25 * y + 0.75 * (1 - y)) * pow(1 - (p * y + (1 - p) * (1 - y)), 2)
  * (greatest(x, 0) - x * y + ln(1 + exp(-abs(x))))) as focal_loss from p""")
def q_focal_loss(spark, sf_dir):
    """Focal loss, alpha 0.25, gamma 2."""
    df = scores(spark, sf_dir).withColumn("logit", M.logit(F.col("score")))
    return M.focal_loss(df)


@register("accuracy", "G8", views=LI, rounded={"accuracy": 9}, sql="""
select avg(case when (case when score > 0.5 then 1 else 0 end) = label then 1.0 else 0.0 end)
  as accuracy from lineitem_scores""")
def q_accuracy(spark, sf_dir):
    """Share of correct classes at p > 0.5."""
    return M.accuracy(scores(spark, sf_dir))


@register("score_stats", "G9", views=LI, rounded={"mean_score": 9, "sd_score": 9}, sql="""
select avg(score) as mean_score, stddev_pop(score) as sd_score, count(*) as n
from lineitem_scores""")
def q_score_stats(spark, sf_dir):
    """Mean and population sd of predictions."""
    return M.score_stats(scores(spark, sf_dir))


@register("predictions_by_class", "G10", views=LI, sql="""
select 'bank_' || cast(order_id % 3 + 1 as varchar) as bank_id,
  case when score > 0.5 then 'fraud' else 'legitimate' end as predicted_class,
  count(*) as predictions from lineitem_scores group by 1, 2""")
def q_predictions_by_class(spark, sf_dir):
    """Predicted fraud / legitimate counts per client."""
    df = scores(spark, sf_dir).withColumn(
        "bank_id", F.concat(F.lit("bank_"), (F.col("order_id") % 3 + 1).cast("string")))
    return M.predictions_by_class(df)


def _u(seed: str) -> str:
    return ("((('0x' || substr(md5(cast(cast(round(score * 1e12) as bigint) as varchar) || ':' || "
            "cast(label as varchar) || ':' || cast(rep as varchar) || ':' || '" + seed +
            "'), 1, 8))::bigint + 0.5) / 4294967296.0)")


BOOT_SQL = f"""
g as (select score, label, count(*) as c from lineitem_scores group by score, label),
lam as (select distinct cast(c as double) as lam from g),
pk as (select lam, unnest(range(0, cast(ceil(lam + 10 * sqrt(lam) + 10) as bigint) + 1)) as k
   from lam),
pc as (select lam, k, sum(exp(k * ln(lam) - lam - lgamma(k + 1))) over (partition by lam
     order by k rows between unbounded preceding and current row) as cdf from pk),
cdfs as (select lam, list(cdf order by k) as cdf from pc group by lam),
reps as (select score, label, cast(c as double) as lam, unnest(range(0, 1000)) as rep from g),
dr as (select r.score, r.label, r.rep, len(list_filter(d.cdf, lambda x: x < {_u('42')})) as w
   from reps r left join cdfs d on r.lam = d.lam),
per as (select rep, score, sum(w * label) as pos, sum(w * (1 - label)) as neg from dr
   group by rep, score),
cum as (select *, sum(pos) over w as cp, sum(neg) over w as cn from per
   window w as (partition by rep order by score desc
                rows between unbounded preceding and current row)),
rm as (select rep, sum(case when pos > 0 then pos * cp / (cp + cn) else 0 end) / sum(pos) as ap,
   sum(neg * (cp - 0.5 * pos)) / (cast(sum(pos) as double) * sum(neg)) as auc
   from cum group by rep having sum(pos) > 0 and sum(neg) > 0)
select count(*) as n_valid, quantile_cont(ap, 0.025) as ap_lower,
  quantile_cont(ap, 0.975) as ap_upper, quantile_cont(auc, 0.025) as auroc_lower,
  quantile_cont(auc, 0.975) as auroc_upper from rm"""


@register("bootstrap_ci", "G7", views=LI, sql=BOOT_SQL,
          rounded={c: 9 for c in ("ap_lower", "ap_upper", "auroc_lower", "auroc_upper")})
def q_bootstrap_ci(spark, sf_dir):
    """1000-replicate Poisson bootstrap percentile intervals of AP and AUROC."""
    return M.bootstrap_ci(scores(spark, sf_dir), n_boot=1000, seed=42)
