"""Registered queries: convergence and trend operators and C5."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraudlake.operators import trends as W
from fraudlake.plans.q_rounds import RM
from fraudlake.plans.registry import register
from fraudlake.sources import fixtures as fx

ME = ("metric_events",)
MET = ["auprc", "auroc", "loss"]
R9 = {f"{m}_{s}": 9 for m in MET for s in ("current", "baseline", "degradation_pct")}

CONV_SQL = """
conv as (select *, case when n < 3 then 1.0 else sd end as convergence_score,
   n >= 3 and sd < 0.01 as converged from (
   select *, count(*) over (partition by client_id order by round
       rows between unbounded preceding and current row) as n,
     stddev_pop(auprc) over (partition by client_id order by round
       rows between 2 preceding and current row) as sd from round_metrics))"""

BASE_SQL = """
base as (select client_id, avg(auprc) as auprc, avg(auroc) as auroc, avg(loss) as loss
   from round_metrics where round <= 5 group by client_id),
cur as (select client_id, arg_max(auprc, round) as auprc, arg_max(auroc, round) as auroc,
   arg_max(loss, round) as loss from round_metrics group by client_id),
bj as (select c.client_id, c.auprc as auprc_current, c.auroc as auroc_current,
   c.loss as loss_current, b.auprc as auprc_baseline, b.auroc as auroc_baseline,
   b.loss as loss_baseline from cur c join base b on c.client_id = b.client_id)"""

DEG_COLS = """(auprc_baseline - auprc_current) * 100.0 / auprc_baseline as auprc_degradation_pct,
  (auroc_baseline - auroc_current) * 100.0 / auroc_baseline as auroc_degradation_pct,
  (loss_current - loss_baseline) * 100.0 / loss_baseline as loss_degradation_pct"""


def rm(spark, sf_dir):
    return fx.round_metrics(spark, sf_dir)


def baseline(spark, sf_dir):
    return rm(spark, sf_dir).where("round <= 5").groupBy("client_id").agg(
        *[F.avg(m).alias(m) for m in MET])


def current(spark, sf_dir):
    return rm(spark, sf_dir).groupBy("client_id").agg(
        *[F.max_by(m, "round").alias(m) for m in MET])


@register("convergence", "W1", views=RM, rounded={"auprc": 9, "convergence_score": 9},
          sql=CONV_SQL + """
select client_id, round, auprc, convergence_score, converged from conv""")
def q_convergence(spark, sf_dir):
    """Sd of the last 3 rounds' AUPRC < 0.01; fewer rounds -> (false, 1.0)."""
    return W.convergence(rm(spark, sf_dir)).select(
        "client_id", "round", "auprc", "convergence_score", "converged")


@register("history", "W2", views=RM, sql="\nunion all\n".join(
    f"select client_id, '{m}' as metric, list(round order by round) as rounds, "
    f"list_transform(list({m} order by round), lambda x: round(x, 9)) as values "
    f"from round_metrics group by client_id" for m in MET))
def q_history(spark, sf_dir):
    """Per client and metric, rounds and values in round order."""
    h = W.history(rm(spark, sf_dir))
    return h.withColumn("values", F.transform("values", lambda x: F.round(x, 9)))


@register("baseline_join", "C5", views=RM,
          rounded={k: v for k, v in R9.items() if not k.endswith("_pct")}, sql=BASE_SQL + "\nselect * from bj")
def q_baseline_join(spark, sf_dir):
    """Final-round metrics beside the baseline (mean of rounds 1-5) per client."""
    return W.baseline_join(current(spark, sf_dir), baseline(spark, sf_dir))


@register("degradation", "W3", views=RM, rounded=R9, sql=BASE_SQL + f"""
select *, {DEG_COLS} from bj""")
def q_degradation(spark, sf_dir):
    """% degradation against the baseline (loss in the other direction)."""
    return W.degradation(W.baseline_join(current(spark, sf_dir), baseline(spark, sf_dir)))


@register("metric_summary", "W4", views=RM,
          rounded={"mean": 9, "std": 9, "min": 9, "max": 9, "final": 9}, sql="\nunion all\n".join(
              f"select client_id, '{m}' as metric, count(*) as num_rounds, avg({m}) as mean, "
              f"stddev_pop({m}) as std, min({m}) as min, max({m}) as max, "
              f"arg_max({m}, round) as final from round_metrics group by client_id" for m in MET))
def q_metric_summary(spark, sf_dir):
    """Mean, population sd, min, max, final per client and metric."""
    return W.metric_summary(rm(spark, sf_dir))


@register("final_round", "W5", views=RM,
          rounded={"auprc": 9, "auroc": 9, "loss": 9, "convergence_score": 9,
                   **{f"{m}_degradation_pct": 9 for m in MET}},
          sql=CONV_SQL + ",\n" + BASE_SQL + f""",
last as (select client_id, arg_max(round, round) as round, arg_max(auprc, round) as auprc,
   arg_max(auroc, round) as auroc, arg_max(loss, round) as loss,
   arg_max(convergence_score, round) as convergence_score,
   arg_max(converged, round) as converged from conv group by client_id),
deg as (select client_id, {DEG_COLS} from bj)
select l.*, d.auprc_degradation_pct, d.auroc_degradation_pct, d.loss_degradation_pct
from last l join deg d on l.client_id = d.client_id""")
def q_final_round(spark, sf_dir):
    """Final-round metrics with convergence and baseline comparison."""
    return W.final_round(rm(spark, sf_dir), baseline(spark, sf_dir))


@register("rounds_completed", "W6", views=ME, sql="""
o as (select client_id, cast(day(ts) as int) as round,
   case when count(*) filter (where status = 'failed') > 0 then 'failed' else 'success' end
     as status from metric_events group by client_id, cast(day(ts) as int))
select client_id, round, status, max(case when status = 'success' then round end) over (
  partition by client_id order by round rows between unbounded preceding and current row)
  as rounds_completed from o""")
def q_rounds_completed(spark, sf_dir):
    """Highest successful round so far per client (round = day of events)."""
    ev = fx.metric_events(spark, sf_dir)
    o = ev.groupBy("client_id", F.dayofmonth("ts").cast("int").alias("round")).agg(
        F.when(F.count_if(F.col("status") == "failed") > 0, F.lit("failed"))
        .otherwise(F.lit("success")).alias("status"))
    return W.rounds_completed(o)
