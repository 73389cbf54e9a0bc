"""Registered queries: batch monitoring operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraudlake.operators import monitor as M
from fraudlake.operators import rounds as R
from fraudlake.operators import trends as W
from fraudlake.plans.q_rounds import RM
from fraudlake.plans.q_trends import CONV_SQL
from fraudlake.plans.registry import register
from fraudlake.sources import fixtures as fx

ME = ("metric_events",)
ROUND_TYPES = ["aggregation", "evaluation", "full_round", "training"]
# fixed values: alert rules (metric, threshold, comparison, severity, message)
RULES = [
    ("auprc", 0.95, "lt", "warning", "Local AUPRC below 0.95"),
    ("failures", 600.0, "gt", "critical", "Too many failed rounds"),
    ("duration", 100.0, "gt", "warning", "Slow training round"),
    ("failures", 0.0, "eq", "info", "No failed rounds"),
]
ALERT_VALUE = 20.0
ALERT_FOR_SECONDS = 600


def events(spark, sf_dir):
    return fx.metric_events(spark, sf_dir)


@register("counter_total", "M1", views=ME, rounded={"value_total": 6}, sql="""
select client_id, round_type, status, count(*) as total, sum(value) as value_total
from metric_events group by client_id, round_type, status""")
def q_counter_total(spark, sf_dir):
    """M1: counter totals per label set."""
    return M.counter_total(events(spark, sf_dir))


@register("gauge_last", "M2", views=ME, sql="""
select client_id, round_type, arg_max(value, ts) as value, max(ts) as ts
from metric_events group by client_id, round_type""")
def q_gauge_last(spark, sf_dir):
    """M2: latest gauge value per label set."""
    return M.gauge_last(events(spark, sf_dir))


@register("histogram", "M3", views=ME, rounded={"sum": 6}, sql="""
b as (select unnest([1.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0, 600.0, 'inf'::double]) as le)
select round_type, b.le, count(*) filter (where value <= b.le) as bucket_count,
  (select sum(value) from metric_events m2 where m2.round_type = m.round_type) as sum,
  (select count(*) from metric_events m2 where m2.round_type = m.round_type) as count
from metric_events m join b on true group by round_type, b.le""")
def q_histogram(spark, sf_dir):
    """M3: cumulative duration buckets with sum and count per round type."""
    return M.histogram(events(spark, sf_dir))


def cumulative_series(spark, sf_dir):
    """A counter per client that restarts every day (sample = running total)."""
    ev = events(spark, sf_dir).withColumn("_day", F.to_date("ts"))
    out = M.running_sum(ev, ["client_id", "_day"], ["ts", "seq"], "value",
                        F.date_trunc("hour", F.col("ts")), "_cum")
    return out.withColumn("value", F.col("_cum")).drop("_cum", "_day")


RATE_SQL = """
k as (select client_id, round_type, ts, value, unnest(range(0, 5)) as k from metric_events),
w as (select client_id, round_type, value,
   date_trunc('minute', ts) - to_minutes(cast(k as integer)) as window_start from k)"""


@register("rate_5m", "M4", views=ME, rounded={"rate": 6}, sql=RATE_SQL + """
select client_id, window_start, window_start + interval 5 minute as window_end,
  sum(value) / 300.0 as rate from w group by client_id, window_start""")
def q_rate_5m(spark, sf_dir):
    """M4: per-second increase over 5-minute windows every minute, computed from a
    cumulative counter with daily resets (increments recovered by reset rule)."""
    inc = M.increments_from_cumulative(cumulative_series(spark, sf_dir), ["client_id"])
    return M.rate(inc, ["client_id"])


@register("avg_duration", "M5", views=ME, rounded={"avg_duration": 6}, sql=RATE_SQL + """
select round_type, window_start, window_start + interval 5 minute as window_end,
  sum(value) / count(*) as avg_duration from w group by round_type, window_start""")
def q_avg_duration(spark, sf_dir):
    """M5: mean round duration per round type over 5-minute sliding windows."""
    return M.avg_duration(events(spark, sf_dir))


@register("success_rate", "M6", views=ME, rounded={"success_rate": 9}, sql="""
select client_id, date_trunc('hour', ts) as window_start,
  date_trunc('hour', ts) + interval 1 hour as window_end,
  count(*) filter (where status = 'success') / count(*) as success_rate, count(*) as rounds
from metric_events group by client_id, date_trunc('hour', ts)""")
def q_success_rate(spark, sf_dir):
    """M6: successful share of rounds per client and hour."""
    return M.success_rate(events(spark, sf_dir))


GAUGE_SQL = """
lg as (select client_id, arg_max(value, ts) as v from metric_events
   where round_type = 'evaluation' group by client_id),
fl as (select client_id, count(*) filter (where status = 'failed') as f from metric_events
   group by client_id),
tr as (select client_id, arg_max(value, ts) as v from metric_events
   where round_type = 'training' group by client_id),
vals as (select client_id, 'auprc' as metric, 1 - v / 500 as value from lg
   union all select client_id, 'failures', cast(f as double) from fl
   union all select client_id, 'duration', v from tr)"""


def gauges(spark, sf_dir):
    ev = events(spark, sf_dir)
    lg = ev.where(F.col("round_type") == "evaluation").groupBy("client_id").agg(
        (1 - F.max_by("value", F.struct("ts", "seq")) / 500).alias("value")) \
        .withColumn("metric", F.lit("auprc"))
    fl = ev.groupBy("client_id").agg(
        F.count_if(F.col("status") == "failed").cast("double").alias("value")) \
        .withColumn("metric", F.lit("failures"))
    tr = ev.where(F.col("round_type") == "training").groupBy("client_id").agg(
        F.max_by("value", F.struct("ts", "seq")).alias("value")) \
        .withColumn("metric", F.lit("duration"))
    return lg.unionByName(fl).unionByName(tr)


@register("sum_avg_by", "M7", views=ME, rounded={"avg_local_auprc": 9}, sql=GAUGE_SQL + """
select (select cast(sum(f) as bigint) from fl) as total_failures,
  (select avg(value) from vals where metric = 'auprc') as avg_local_auprc""")
def q_sum_avg_by(spark, sf_dir):
    """M7: sum of failures over clients and mean of the latest local AUPRC."""
    g = gauges(spark, sf_dir)
    return g.agg(F.sum(F.when(F.col("metric") == "failures", F.col("value"))).cast("long")
                 .alias("total_failures"),
                 F.avg(F.when(F.col("metric") == "auprc", F.col("value"))).alias("avg_local_auprc"))


RULES_SQL = "(values " + ", ".join(
    f"('{m}', cast({t!r} as double), '{o}', '{s}', '{msg}')" for m, t, o, s, msg in RULES) + \
    ") r(metric, threshold, op, severity, message)"


@register("threshold_alerts", "M8", views=ME, rounded={"value": 9}, sql=GAUGE_SQL + f"""
select v.client_id, v.metric, v.value, r.threshold, r.op, r.severity, r.message
from vals v join {RULES_SQL} on v.metric = r.metric
where (r.op = 'gt' and v.value > r.threshold) or (r.op = 'lt' and v.value < r.threshold)
   or (r.op = 'eq' and v.value = r.threshold)""")
def q_threshold_alerts(spark, sf_dir):
    """M8: rule table applied to the latest gauges."""
    rules = spark.createDataFrame(RULES, "metric string, threshold double, op string, "
                                         "severity string, message string")
    return M.threshold_alerts(gauges(spark, sf_dir), rules)


@register("alert_for", "M9", views=ME, sql=f"""
s as (select client_id, ts, seq, value > {ALERT_VALUE} as cond from metric_events),
l as (select *, max(case when not cond then {{'ts': ts, 'seq': seq}} end) over (
     partition by client_id order by ts, seq rows between unbounded preceding and current row)
   as lf from s),
t as (select * from l where cond),
p as (select client_id, lf, min(ts) as pending_since from t group by client_id, lf)
select t.client_id, t.ts, t.seq, p.pending_since from t join p
  on t.client_id = p.client_id and t.lf is not distinct from p.lf
where epoch_us(t.ts) - epoch_us(p.pending_since) >= {ALERT_FOR_SECONDS * 1_000_000}""")
def q_alert_for(spark, sf_dir):
    """M9: value > 20 held for 10 minutes per client (any lower sample resets)."""
    ev = events(spark, sf_dir)
    return M.alert_for(ev, F.col("value") > ALERT_VALUE, ALERT_FOR_SECONDS).select(
        "client_id", "ts", "seq", "pending_since")


@register("compound_alert", "M10", views=RM, sql=CONV_SQL + """
select client_id, round from conv where round > 20 and not converged""")
def q_compound_alert(spark, sf_dir):
    """More than 20 rounds and still not converged."""
    conv = W.convergence(fx.round_metrics(spark, sf_dir))
    return M.compound_alert(conv).select("client_id", "round")


# fixture: round times of two kinds stand for the gauges; the events are minutes apart
RATIO = {"threshold": 0.9, "for_seconds": 3600, "step_seconds": 600, "lookback_seconds": 7200}
_STEP = RATIO["step_seconds"] * 1_000_000


@register("ratio_alert", "M10", views=ME, rounded={"ratio": 9}, sql=f"""
e as (select client_id, epoch_us(ts) as us, seq, round_type, value from metric_events
   where ts is not null and round_type in ('training', 'evaluation')),
st as (select client_id, unnest(range((min(us) // {_STEP} + 1) * {_STEP}, max(us) + 1, {_STEP})) as t
   from e group by client_id),
g as (select client_id, round_type, us, arg_max(value, seq) as value from e where value is not null
   group by client_id, round_type, us),
u as (select st.client_id, t, case when t - us < {RATIO["lookback_seconds"]}000000 then value end as used
   from st asof left join (select * from g where round_type = 'training') x
   on st.client_id = x.client_id and st.t >= x.us),
a as (select u.client_id, t, used, case when t - us < {RATIO["lookback_seconds"]}000000 then value end as available
   from u asof left join (select * from g where round_type = 'evaluation') x
   on u.client_id = x.client_id and u.t >= x.us),
c as (select *, coalesce(used > {RATIO["threshold"]} * available, false) as cond from a),
l as (select *, max(case when not cond then t end) over (partition by client_id order by t) as lf from c),
p as (select *, min(t) over (partition by client_id, lf) as since from l where cond)
select client_id, make_timestamp(t) as ts, used, available, used / available as ratio,
  make_timestamp(since) as pending_since from p where t - since >= {RATIO["for_seconds"]}000000""")
def q_ratio_alert(spark, sf_dir):
    """Last used value over 0.9 x last available value for an hour, at 10-minute steps."""
    ev = events(spark, sf_dir)
    used, available = (ev.where(F.col("round_type") == t) for t in ("training", "evaluation"))
    return M.ratio_alert(used, available, **RATIO)


@register("failures_by_type", "M12", views=ME, sql="""
select client_id, failure_type, count(*) as failures from metric_events
where status = 'failed' group by client_id, failure_type""")
def q_failures_by_type(spark, sf_dir):
    """Failures per client and failure type."""
    return M.failures_by_type(events(spark, sf_dir))


@register("health_summary", "M13", views=ME, rounded={"success_rate": 9}, sql="""
select client_id, """ + ", ".join(
    f"arg_max(value, ts) filter (where round_type = '{t}') as {t}" for t in ROUND_TYPES) + """,
  count(*) as rounds, count(*) filter (where status = 'success') / count(*) as success_rate,
  case when count(*) filter (where status = 'success') / count(*) >= 0.75 then 'healthy'
    else 'degraded' end as health
from metric_events group by client_id""")
def q_health_summary(spark, sf_dir):
    """Latest gauges per round type as columns, success rate and health."""
    return M.health_summary(events(spark, sf_dir), ROUND_TYPES)


@register("low_auprc", "M14", views=ME, rounded={"auprc": 9}, sql="""
d as (select client_id, cast(ts as date) as day, 1 - arg_max(value, ts) / 100 as auprc
   from metric_events where round_type = 'evaluation' group by client_id, cast(ts as date))
select client_id, day, auprc from d where auprc < 0.5""")
def q_low_auprc(spark, sf_dir):
    """Days on which a client's latest local AUPRC was below 0.5."""
    ev = events(spark, sf_dir).where(F.col("round_type") == "evaluation")
    d = ev.groupBy("client_id", F.to_date("ts").alias("day")).agg(
        (1 - F.max_by("value", F.struct("ts", "seq")) / 100).alias("auprc"))
    return d.where(F.col("auprc") < 0.5)


MET = ["auprc", "auroc", "loss"]


@register("metric_log", "M15", views=RM, rounded={"value": 9}, sql="""
long as (select client_id, round, num_examples, 'auprc' as key, auprc as value
     from round_metrics
   union all select client_id, round, num_examples, 'auroc', auroc from round_metrics
   union all select client_id, round, num_examples, 'loss', loss from round_metrics)
select client_id || '_' || key as key, cast(round as bigint) as step, value from long
union all
select 'global_' || key, cast(round as bigint), sum(num_examples * value) / sum(num_examples)
from long group by key, round
union all
select 'system_num_clients', cast(round as bigint), cast(count(distinct client_id) as double)
from round_metrics group by round""")
def q_metric_log(spark, sf_dir):
    """Long run log with client, global (weighted) and system keys per round."""
    rm = fx.round_metrics(spark, sf_dir)
    long = R.long_metrics(rm, ["client_id", "round", "num_examples"], MET)
    per_client = M.metric_log(long, F.col("client_id"))
    glob = M.metric_log(R.aggregate_metrics(long, max_keys=(), keys="union"), F.lit("global"))
    system = rm.groupBy("round").agg(F.count_distinct("client_id").cast("double").alias("value")) \
        .select(F.lit("system_num_clients").alias("key"), F.col("round").cast("long").alias("step"),
                "value")
    return per_client.unionByName(glob).unionByName(system)


@register("flatten_params", "M16", views=RM, rounded={"value_num": 9}, sql="""
p as (select client_id, count(*) as rounds, sum(num_examples) as examples, avg(loss) as loss_mean,
   arg_max(loss, round) as loss_last, sum(epsilon) as epsilon_total from round_metrics
   group by client_id)
select client_id, 'client.id' as key, null::double as value_num, client_id as value_str from p
union all select client_id, 'client.rounds', cast(rounds as double), null from p
union all select client_id, 'training.examples', cast(examples as double), null from p
union all select client_id, 'training.loss.mean', loss_mean, null from p
union all select client_id, 'training.loss.last', loss_last, null from p
union all select client_id, 'privacy.epsilon_total', epsilon_total, null from p""")
def q_flatten_params(spark, sf_dir):
    """Nested per-client parameters flattened to dotted keys."""
    rm = fx.round_metrics(spark, sf_dir)
    nested = rm.groupBy("client_id").agg(
        F.struct(F.col("client_id").alias("id"), F.count(F.lit(1)).alias("rounds")).alias("client"),
        F.struct(F.sum("num_examples").alias("examples"),
                 F.struct(F.avg("loss").alias("mean"), F.max_by("loss", "round").alias("last"))
                 .alias("loss")).alias("training"),
        F.struct(F.sum("epsilon").alias("epsilon_total")).alias("privacy"))
    return M.flatten_params(nested, ["client_id"])
