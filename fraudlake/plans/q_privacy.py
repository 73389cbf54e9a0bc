"""Registered queries: privacy operators and the budget join (C4)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fraudlake.functions.hashrand import uniform_sql
from fraudlake.operators import privacy as PV
from fraudlake.plans.q_rounds import RM, UP
from fraudlake.plans.registry import register
from fraudlake.sources import fixtures as fx

# fixed values: privacy options (batch size, noise multiplier, delta, clip norm, seed)
BATCH = 10
SIGMA = 1.1
DELTA = 1e-5
CLIP = 1.0
SEED = 7
# fixture: per-bank budgets and the global fallback; one bank stays inside its budget,
# one leaves its own and one the global budget on the way
BUDGETS = {"bank_1": 50.0, "bank_3": 8.0}
GLOBAL_BUDGET = 11.0


def steps_table(spark, sf_dir, run_every: int | None = None):
    rm = fx.round_metrics(spark, sf_dir)
    run = (F.lit("run_1") if run_every is None else
           F.concat(F.lit("run_"), F.floor((F.col("round") - 1) / run_every).cast("string")))
    return rm.select("client_id", run.alias("run_id"), "round",
                     F.ceil(F.col("num_examples") / F.lit(BATCH)).cast("long").alias("steps"),
                     F.least(F.lit(1.0), F.lit(float(BATCH)) / F.col("num_examples")).alias("q"),
                     F.lit(SIGMA).alias("sigma"))


def ledger(spark, sf_dir, run_every=None):
    return PV.epsilon_ledger(steps_table(spark, sf_dir, run_every), DELTA)


def budgets(spark):
    return spark.createDataFrame(list(BUDGETS.items()), "client_id string, budget double")


def status(spark, sf_dir):
    return PV.budget_status(PV.budget_join(ledger(spark, sf_dir), budgets(spark), GLOBAL_BUDGET))


def ledger_sql(run_expr: str = "'run_1'", steps: str | None = None) -> str:
    steps = steps or f"""steps as (select client_id, {run_expr} as run_id, round,
   cast(ceil(num_examples / {BATCH}) as bigint) as steps,
   least(1.0, {float(BATCH)} / num_examples) as q, {SIGMA} as sigma from round_metrics)"""
    return f"""
{steps},
pairs as (select distinct q, sigma from steps),
pa as (select q, sigma, unnest(range(2, {PV.MAX_ORDER + 1})) as a from pairs),
ak as (select q, sigma, a, unnest(range(0, a + 1)) as k from pa),
terms as (select q, sigma, a, lgamma(a + 1) - lgamma(k + 1) - lgamma(a - k + 1)
     + (a - k) * ln(1.0 - q) + k * ln(q) + (k * k - k) / (2.0 * sigma * sigma) as t from ak),
tm as (select q, sigma, a, max(t) as m from terms group by q, sigma, a),
rdp as (select t.q, t.sigma, t.a, case when t.q >= 1.0 then t.a / (2.0 * t.sigma * t.sigma)
     else (tm.m + ln(sum(exp(t.t - tm.m)))) / (t.a - 1) end as rdp
   from terms t join tm on t.q = tm.q and t.sigma = tm.sigma and t.a = tm.a
   group by t.q, t.sigma, t.a, tm.m),
cum as (select s.client_id, s.run_id, s.round, s.steps, r.a,
     sum(s.steps * r.rdp) over (partition by s.client_id, s.run_id, r.a order by s.round
       rows between unbounded preceding and current row) as cum_rdp
   from steps s join rdp r on s.q = r.q and s.sigma = r.sigma),
ledger as (select client_id, run_id, round, min(cum_rdp + ln((a - 1.0) / a)
     - ({math.log(DELTA)!r} + ln(cast(a as double))) / (a - 1.0)) as epsilon_spent,
   max(steps) as steps, {DELTA!r} as delta from cum group by client_id, run_id, round)"""


BUDGET_SQL = ledger_sql() + ",\nbudgets as (select * from (values " + ", ".join(
    f"('{k}', cast({v!r} as double))" for k, v in BUDGETS.items()) + f""") b(client_id, budget)),
joined as (select l.*, coalesce(b.budget, cast({GLOBAL_BUDGET!r} as double)) as budget,
   case when b.budget is null then 'global' else 'bank' end as budget_source
   from ledger l left join budgets b on l.client_id = b.client_id),
status as (select *, greatest(0.0, budget - epsilon_spent) as remaining,
   epsilon_spent >= budget as exhausted from joined)"""

E6 = {"epsilon_spent": 6}


@register("clip_rows", "P1", views=UP, rounded={"norm_before": 9, "norm_after": 9}, sql=f"""
n as (select round, client_id, w, sqrt(list_sum(list_transform(w, lambda x: x * x))) as nb
   from updates),
c as (select round, client_id, nb, list_transform(w, lambda x: x * case when nb > 0
     then least(1.0, {CLIP} / nb) else 1.0 end) as cw from n)
select round, client_id, nb as norm_before,
  sqrt(list_sum(list_transform(cw, lambda x: x * x))) as norm_after from c""")
def q_clip_rows(spark, sf_dir):
    """Per-update L2 clipping to norm 1."""
    return PV.clip_rows(fx.updates(spark, sf_dir), CLIP).select(
        "round", "client_id", "norm_before", "norm_after")


_U1 = uniform_sql(["round", "tensor", "pos"], SEED)
_U2 = uniform_sql(["round", "tensor", "pos"], f"{SEED}b")
NOISY_SQL = f"""
n as (select round, tensor, w, sqrt(list_sum(list_transform(w, lambda x: x * x))) as nb
   from updates),
c as (select round, tensor, list_transform(w, lambda x: x * case when nb > 0
     then least(1.0, {CLIP} / nb) else 1.0 end) as cw from n),
ux as (select round, tensor, unnest(cw) as v, unnest(range(0, len(cw))) as pos from c),
s as (select round, tensor, pos, sum(v) as clean_sum from ux group by round, tensor, pos),
noisy as (select *, clean_sum + {SIGMA * CLIP!r} * sqrt(-2.0 * ln({_U1}))
     * cos(6.283185307179586 * {_U2}) as noisy_sum from s)"""


@register("noisy_sum", "P2", views=UP, rounded={"clean_sum": 9, "noisy_sum": 9},
          sql=NOISY_SQL + "\nselect round, tensor, cast(pos as integer) as pos, clean_sum, "
                                   "noisy_sum from noisy")
def q_noisy_sum(spark, sf_dir):
    """Clipped sum per round and position plus seeded Gaussian noise (sigma 1.1)."""
    return PV.noisy_sum(fx.updates(spark, sf_dir), CLIP, SIGMA, SEED).select(
        "round", "tensor", "pos", "clean_sum", "noisy_sum")


@register("noise_check", "P3", views=UP, rounded={"mean_distance": 6}, sql=NOISY_SQL + """,
d as (select round, tensor, sqrt(sum((noisy_sum - clean_sum) * (noisy_sum - clean_sum))) as dist
   from noisy group by round, tensor)
select avg(dist) as mean_distance, avg(dist) > 1e-6 as noise_added from d""")
def q_noise_check(spark, sf_dir):
    """The noisy sums differ from the clean ones (mean L2 distance)."""
    return PV.noise_check(PV.noisy_sum(fx.updates(spark, sf_dir), CLIP, SIGMA, SEED))


@register("epsilon_ledger", "P4", views=RM, rounded=E6, sql=ledger_sql() + """
select client_id, run_id, round, epsilon_spent, steps from ledger""")
def q_epsilon_ledger(spark, sf_dir):
    """Cumulative RDP epsilon per client after every round (q = 10/n, sigma 1.1)."""
    return ledger(spark, sf_dir).select("client_id", "run_id", "round", "epsilon_spent", "steps")


@register("ledger_reset", "P8", views=RM, rounded=E6, sql=ledger_sql(
    "'run_' || cast(floor((round - 1) / 10) as bigint)") + """
select client_id, run_id, round, epsilon_spent from ledger""")
def q_ledger_reset(spark, sf_dir):
    """A new run (every 10 rounds) starts its ledger at 0."""
    return ledger(spark, sf_dir, run_every=10).select("client_id", "run_id", "round",
                                                      "epsilon_spent")


@register("budget_join", "C4", views=RM, rounded=E6, sql=BUDGET_SQL + """
select client_id, round, epsilon_spent, budget, budget_source from joined""")
def q_budget_join(spark, sf_dir):
    """C4: per-bank budget with the global fallback."""
    j = PV.budget_join(ledger(spark, sf_dir), budgets(spark), GLOBAL_BUDGET)
    return j.select("client_id", "round", "epsilon_spent", "budget", "budget_source")


@register("budget_status", "P5", views=RM, rounded={**E6, "remaining": 6}, sql=BUDGET_SQL + """
select client_id, round, epsilon_spent, budget, remaining, exhausted from status""")
def q_budget_status(spark, sf_dir):
    """P5: remaining budget and exhausted flag (spent >= budget)."""
    return status(spark, sf_dir).select("client_id", "round", "epsilon_spent", "budget",
                                        "remaining", "exhausted")


@register("enforce_budget", "P6", views=RM, sql=BUDGET_SQL + """
select client_id, round from joined where epsilon_spent < budget""")
def q_enforce_budget(spark, sf_dir):
    """Client-rounds still inside their budget."""
    j = PV.budget_join(ledger(spark, sf_dir), budgets(spark), GLOBAL_BUDGET)
    return PV.enforce_budget(j).select("client_id", "round")


@register("privacy_summary", "P7", views=RM, rounded={**E6, "remaining": 6}, sql=BUDGET_SQL + """
select client_id, arg_max(round, round) as round, arg_max(epsilon_spent, round) as epsilon_spent,
  arg_max(budget, round) as budget, arg_max(remaining, round) as remaining,
  arg_max(exhausted, round) as exhausted, cast(sum(steps) as bigint) as total_steps,
  count(*) as rounds
from status group by client_id""")
def q_privacy_summary(spark, sf_dir):
    """One row per client with its latest ledger state and totals."""
    s = status(spark, sf_dir).select("client_id", "round", "epsilon_spent", "budget",
                                     "remaining", "exhausted", "steps")
    return PV.privacy_summary(s).select("client_id", "round", "epsilon_spent", "budget",
                                        "remaining", "exhausted", "total_steps", "rounds")


@register("budget_alert", "M11", views=RM, rounded={"remaining": 6}, sql=BUDGET_SQL + """
, latest as (select client_id, arg_max(remaining, round) as remaining,
   arg_max(exhausted, round) as exhausted from status group by client_id)
select client_id, remaining, exhausted, case when exhausted then 'budget_exhausted'
  else 'budget_low' end as alert from latest where remaining < 0.1 or exhausted""")
def q_budget_alert(spark, sf_dir):
    """Clients whose remaining budget is < 0.1 or exhausted."""
    s = status(spark, sf_dir)
    latest = s.groupBy("client_id").agg(F.max_by("remaining", "round").alias("remaining"),
                                        F.max_by("exhausted", "round").alias("exhausted"))
    return latest.where((F.col("remaining") < 0.1) | F.col("exhausted")).withColumn(
        "alert", F.when(F.col("exhausted"), F.lit("budget_exhausted"))
        .otherwise(F.lit("budget_low")))


RESULT_COLS = ["auprc", "auroc", "loss"]


def results(spark, sf_dir):
    ev = fx.read(spark, sf_dir, "events")
    return ev.select(F.pow(F.lit(2.0), F.col("user_id") % 5 - 1).alias("epsilon"), "ts",
                     F.col("event_id").alias("seq"),
                     (1 - F.col("value") / 1000).alias("auprc"),
                     (1 - F.col("value") / 2000).alias("auroc"),
                     (F.col("value") / 100).alias("loss"))


CURVE_SQL = """
with results as (select power(2.0, user_id % 5 - 1) as epsilon, ts, event_id as seq,
   1 - value / 1000 as auprc, 1 - value / 2000 as auroc, value / 100 as loss from events),
curve as (select epsilon, first(auprc order by ts desc, seq desc) as auprc,
   first(auroc order by ts desc, seq desc) as auroc,
   first(loss order by ts desc, seq desc) as loss from results group by epsilon)"""


@register("utility_curve", "P9", rounded={"auprc": 9, "auroc": 9, "loss": 9},
          sql=CURVE_SQL + "\nselect epsilon, auprc, auroc, loss from curve order by epsilon")
def q_utility_curve(spark, sf_dir):
    """One privacy-utility point per epsilon, latest result wins."""
    return PV.utility_curve(results(spark, sf_dir), RESULT_COLS)


@register("utility_summary", "P10", rounded={"min_auprc": 9, "max_auprc": 9, "utility_gain": 9},
          sql=CURVE_SQL + """
select count(*) as points, min(epsilon) as min_epsilon, max(epsilon) as max_epsilon,
  min(auprc) as min_auprc, max(auprc) as max_auprc,
  case when count(*) >= 2 then arg_max(auprc, epsilon) - arg_min(auprc, epsilon) else 0.0 end
    as utility_gain,
  first(epsilon order by auprc desc, epsilon asc) as best_epsilon from curve""")
def q_utility_summary(spark, sf_dir):
    """P10: ranges, utility change from min to max epsilon, best epsilon."""
    return PV.utility_summary(PV.utility_curve(results(spark, sf_dir), RESULT_COLS))
