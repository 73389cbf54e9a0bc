"""Registered queries: streaming jobs run to completion with availableNow."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from fraudlake.operators.monitor import LE_BOUNDS
from fraudlake.plans.q_ingest import REASON_SQL
from fraudlake.plans.q_monitor import ALERT_FOR_SECONDS, ALERT_VALUE, ME, RATE_SQL
from fraudlake.plans.registry import ORACLE, register
from fraudlake.session import scratch_path
from fraudlake.streaming import streams as S


def _ntz(df, cols):
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in cols else F.col(c)
                       for c in df.columns])


@register("stream_window_metrics", "M17", views=ME, rounded={"value_sum": 6}, sql="""
w as (select date_trunc('minute', ts) as window_start,
   date_trunc('minute', ts) + interval 1 minute as window_end, round_type, count(*) as rounds,
   count(*) filter (where status = 'failed') as failures, sum(value) as value_sum
   from metric_events group by date_trunc('minute', ts), round_type)
select * from w
where window_end <= (select max(ts) from metric_events) - interval 10 minute""")
def q_stream_window_metrics(spark, sf_dir):
    """File stream -> 10-minute watermark -> 1-minute windows -> Parquet sink
    (append: only windows the watermark closed are emitted)."""
    out = S.stream_window_metrics(spark, os.path.join(sf_dir, "events.parquet"),
                                  scratch_path(spark, "stream-windows"))
    return _ntz(out, ("window_start", "window_end")).select(
        "window_start", "window_end", "round_type", "rounds", "failures", "value_sum")


@register("stream_rate_5m", "M17", views=ME, rounded={"rate": 6}, sql=RATE_SQL + """
, r as (select client_id, window_start, window_start + interval 5 minute as window_end,
   sum(value) / 300.0 as rate from w group by client_id, window_start)
select * from r
where window_end <= (select max(ts) from metric_events) - interval 10 minute""")
def q_stream_rate_5m(spark, sf_dir):
    """Sliding 5-minute rates per client from a file stream; only
    windows closed by the watermark are emitted (append mode)."""
    out = S.stream_rates(spark, os.path.join(sf_dir, "events.parquet"),
                         scratch_path(spark, "stream-rates"))
    return _ntz(out, ("window_start", "window_end")).select(
        "client_id", "window_start", "window_end", "rate")


def _all_windows(spark, sf_dir, name, plan):
    """Closed windows of the stream and, flushed, the open ones."""
    events = os.path.join(sf_dir, "events.parquet")
    return S.with_open_windows(spark, S.run_windows(spark, events, scratch_path(spark, name), plan), events, plan)


@register("stream_counters", "M17", views=ME, rounded={"value_total": 6}, sql="""
select date_trunc('minute', ts) as window_start, date_trunc('minute', ts) + interval 1 minute as window_end,
  client_id, round_type, status, count(*) as total, sum(value) as value_total
from metric_events group by date_trunc('minute', ts), client_id, round_type, status""")
def q_stream_counters(spark, sf_dir):
    """Counters per window from a file stream, the open windows flushed at its end."""
    return _ntz(_all_windows(spark, sf_dir, "stream-counters", S.counters), ("window_start", "window_end"))


@register("stream_histogram", "M17", views=ME, rounded={"sum": 6}, sql=f"""
b as (select unnest([{", ".join(f"cast('{'Infinity' if b == float('inf') else b}' as double)" for b in LE_BOUNDS)}]) as le),
w as (select date_trunc('hour', ts) as window_start, round_type, value from metric_events)
select window_start, window_start + interval 1 hour as window_end, round_type, le,
  count(*) filter (where value <= le) as bucket_count, sum(value) as sum, count(*) as count
from w, b group by window_start, round_type, le""")
def q_stream_histogram(spark, sf_dir):
    """Cumulative buckets per hour and round type from a file stream, flushed at its end."""
    out = S.le_rows(_all_windows(spark, sf_dir, "stream-histogram", S.bucket_counts))
    return _ntz(out, ("window_start", "window_end"))


@register("stream_quarantine", "M18", views=("dirty",), sql=REASON_SQL + """
select case when reject_reason is null then 'good' else 'quarantine' end as "table",
  reject_reason as reason, count(*) as records from reasons
group by case when reject_reason is null then 'good' else 'quarantine' end, reject_reason""")
def q_stream_quarantine(spark, sf_dir):
    """Arriving record files typed, filtered and split into good and
    quarantine tables in foreachBatch (idempotent per batch id)."""
    return S.stream_quarantine(spark, os.path.join(sf_dir, "orders.parquet"),
                               scratch_path(spark, "stream-quarantine"))


@register("alert_for_stream", "M9")
def q_alert_for_stream(spark, sf_dir):
    """M9 (stream): sustained-condition alert with per-client state and
    event-time timeout (applyInPandasWithState)."""
    out = S.stream_alert_for(spark, os.path.join(sf_dir, "events.parquet"),
                             scratch_path(spark, "stream-alert"), ALERT_VALUE, ALERT_FOR_SECONDS)
    return _ntz(out, ("ts", "pending_since")).select("client_id", "ts", "seq", "pending_since")


# the streaming alert must equal the batch rule on the same events
ORACLE["alert_for_stream"] = ORACLE["alert_for"]
