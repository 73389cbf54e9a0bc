"""Monitoring over a metric event stream.

Every function takes a DataFrame of events ``(seq, ts, client_id, round_type,
status, failure_type, value)`` and works on batch and streaming input alike
where Spark allows it. Series-ordered operations (previous sample, running
maxima) use two levels: a window inside (series, time bucket) plus a carry
from a small per-bucket summary, so a busy series is spread over its buckets
instead of landing in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: histogram bucket bounds (seconds) of round durations
LE_BOUNDS = [1.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0, 600.0, float("inf")]


def _ts(c: str = "ts") -> Column:
    return F.col(c)


def micros(c: Column) -> Column:
    """Microseconds since the epoch for timestamp or timestamp_ntz (UTC session)."""
    return F.unix_micros(c.cast("timestamp"))


# --- two-level series helpers ------------------------------------------------------------

def running_max(df: DataFrame, series: list[str], order: list[str], value: Column,
                bucket: Column, out: str) -> DataFrame:
    """Inclusive running max of ``value`` along ``order`` within each series."""
    d = df.withColumn("_bkt", bucket).withColumn("_val", value)
    w = Window.partitionBy(*series, "_bkt").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = d.withColumn("_local", F.max("_val").over(w))
    summ = d.groupBy(*series, "_bkt").agg(F.max("_val").alias("_bmax"))
    ws = Window.partitionBy(*series).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    carry = summ.select(*series, "_bkt", F.max("_bmax").over(ws).alias("_carry"))
    j = local.join(carry, [*series, "_bkt"], "left")
    res = F.when(F.col("_local").isNull(), F.col("_carry")).when(
        F.col("_carry").isNull(), F.col("_local")).otherwise(F.greatest("_local", "_carry"))
    return j.withColumn(out, res).drop("_bkt", "_val", "_local", "_carry")


def running_sum(df: DataFrame, series: list[str], order: list[str], value: str,
                bucket: Column, out: str) -> DataFrame:
    """Inclusive running sum of ``value`` along ``order`` within each series
    (window inside (series, bucket) plus the totals of earlier buckets)."""
    d = df.withColumn("_bkt", bucket)
    w = Window.partitionBy(*series, "_bkt").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = d.withColumn("_local", F.sum(value).over(w))
    summ = d.groupBy(*series, "_bkt").agg(F.sum(value).alias("_btot"))
    ws = Window.partitionBy(*series).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    carry = summ.select(*series, "_bkt", F.sum("_btot").over(ws).alias("_carry"))
    j = local.join(carry, [*series, "_bkt"], "left")
    return j.withColumn(out, F.col("_local") + F.coalesce(F.col("_carry"), F.lit(0.0))) \
        .drop("_bkt", "_local", "_carry")


def previous_value(df: DataFrame, series: list[str], order: list[str], value: str,
                   bucket: Column, out: str) -> DataFrame:
    """Value of the previous sample of the series (null for the first)."""
    d = df.withColumn("_bkt", bucket)
    w = Window.partitionBy(*series, "_bkt").orderBy(*order)
    local = d.withColumn("_lag", F.lag(value).over(w))
    summ = d.groupBy(*series, "_bkt").agg(
        F.max_by(F.col(value), F.struct(*order)).alias("_last"))
    ws = Window.partitionBy(*series).orderBy("_bkt")
    carry = summ.select(*series, "_bkt", F.lag("_last").over(ws).alias("_carry"))
    j = local.join(carry, [*series, "_bkt"], "left")
    first = F.row_number().over(w) == 1
    return j.withColumn(out, F.when(first, F.col("_carry")).otherwise(F.col("_lag"))) \
        .drop("_bkt", "_lag", "_carry")


# --- M1-M3 ---------------------------------------------------------------------------------

def counter_total(ev: DataFrame, labels=("client_id", "round_type", "status")) -> DataFrame:
    """M1: events and value sum per label set (labels are plain columns)."""
    return ev.groupBy(*labels).agg(F.count(F.lit(1)).alias("total"),
                                   F.sum("value").alias("value_total"))


def gauge_last(ev: DataFrame, labels=("client_id", "round_type"), value: str = "value") -> DataFrame:
    """M2: latest value per label set (ts, then seq)."""
    return ev.groupBy(*labels).agg(F.max_by(F.col(value), F.struct("ts", "seq")).alias("value"),
                                   F.max("ts").alias("ts"))


def histogram(ev: DataFrame, by: str = "round_type", value: str = "value",
              bounds=LE_BOUNDS) -> DataFrame:
    """M3: cumulative ``le`` bucket counts plus sum and count, one aggregate."""
    agg = ev.groupBy(by).agg(*[F.count_if(F.col(value) <= F.lit(b)).alias(f"_le{i}")
                               for i, b in enumerate(bounds)],
                             F.sum(value).alias("sum"), F.count(F.lit(1)).alias("count"))
    stack = ", ".join(f"cast({b!r} as double), _le{i}" if b != float("inf")
                      else f"cast('Infinity' as double), _le{i}" for i, b in enumerate(bounds))
    return agg.selectExpr(by, f"stack({len(bounds)}, {stack}) as (le, bucket_count)",
                          "sum", "count")


# --- M4-M7: windowed rates -------------------------------------------------------------------

def increments_from_cumulative(df: DataFrame, series: list[str], value: str = "value",
                               order=("ts", "seq"), bucket: Column | None = None) -> DataFrame:
    """Counter samples -> increments; a drop means a reset (use the new value);
    the first sample counts from 0."""
    bucket = F.date_trunc("minute", F.col("ts")) if bucket is None else bucket
    p = previous_value(df, list(series), list(order), value, bucket, "_prev")
    inc = F.when(F.col("_prev").isNull(), F.col(value)).when(
        F.col(value) < F.col("_prev"), F.col(value)).otherwise(F.col(value) - F.col("_prev"))
    return p.withColumn("increment", inc).drop("_prev")


def rate(inc: DataFrame, by: list[str], value: str = "increment", width: str = "5 minutes",
         slide: str = "1 minute", seconds: float = 300.0) -> DataFrame:
    """M4: per-second increase over sliding windows (sum of increments / width)."""
    w = F.window("ts", width, slide)
    return inc.groupBy(*by, w.alias("w")).agg((F.sum(value) / F.lit(seconds)).alias("rate")) \
        .select(*by, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                "rate")


def avg_duration(ev: DataFrame, by=("round_type",), width="5 minutes", slide="1 minute") -> DataFrame:
    """M5: rate(sum)/rate(count) = sum(value)/count per window."""
    w = F.window("ts", width, slide)
    return ev.groupBy(*by, w.alias("w")).agg(
        (F.sum("value") / F.count(F.lit(1))).alias("avg_duration")) \
        .select(*by, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                "avg_duration")


def success_rate(ev: DataFrame, by=("client_id",), width="1 hour") -> DataFrame:
    """M6: successful / all rounds per tumbling window."""
    w = F.window("ts", width)
    return ev.groupBy(*by, w.alias("w")).agg(
        (F.count_if(F.col("status") == "success") / F.count(F.lit(1))).alias("success_rate"),
        F.count(F.lit(1)).alias("rounds")) \
        .select(*by, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                "success_rate", "rounds")


# --- M8-M14: alerts and summaries ---------------------------------------------------------------

def compare(value: Column, op: Column, threshold: Column) -> Column:
    return (F.when(op == "gt", value > threshold).when(op == "lt", value < threshold)
            .when(op == "eq", value == threshold).otherwise(F.lit(False)))


def threshold_alerts(values: DataFrame, rules: DataFrame) -> DataFrame:
    """M8: rules (metric, threshold, op, severity, message) against values
    (client_id, metric, value); the rule table is configuration, broadcast."""
    j = values.join(F.broadcast(rules), "metric")
    return j.where(compare(F.col("value"), F.col("op"), F.col("threshold"))).select(
        "client_id", "metric", "value", "threshold", "op", "severity", "message")


def alert_for(ev: DataFrame, cond: Column, for_seconds: float, series=("client_id",),
              bucket: Column | None = None) -> DataFrame:
    """M9 (batch): samples where ``cond`` has held continuously for at least
    ``for_seconds``; any false sample resets.

    The last false sample before each row is a running max (two-level); all
    true rows after the same last-false form one run, whose start is a plain
    aggregate, so there is no per-series sort of all samples.
    """
    series = list(series)
    bucket = F.date_trunc("minute", F.col("ts")) if bucket is None else bucket
    d = ev.withColumn("_cond", F.coalesce(cond, F.lit(False)))
    lf = running_max(d, series, ["ts", "seq"],
                     F.when(~F.col("_cond"), F.struct("ts", "seq")), bucket, "_last_false")
    true_rows = lf.where("_cond")
    key_cols = [*series, "_last_false"]
    starts = true_rows.groupBy(*key_cols).agg(F.min("ts").alias("pending_since")) \
        .select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(key_cols)], "pending_since")
    keys = [F.col(c).eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate(key_cols)]
    j = true_rows.join(starts, reduce(lambda a, b: a & b, keys)) \
        .drop(*[f"_s{i}" for i in range(len(key_cols))])
    held = (micros(F.col("ts")) - micros(F.col("pending_since"))) >= F.lit(int(for_seconds * 1e6))
    return j.where(held).drop("_cond", "_last_false")


def compound_alert(conv: DataFrame, min_rounds: int = 20) -> DataFrame:
    """More than ``min_rounds`` rounds and still not converged."""
    return conv.where((F.col("round") > min_rounds) & ~F.col("converged"))


def last_at(left: DataFrame, samples: DataFrame, series=("client_id",), lookback_seconds: float = 300.0,
            out: str = "value", bucket_unit: str = "hour") -> DataFrame:
    """As-of join: ``left`` (series columns, ts, any others) with the last sample (series,
    ts, seq, value) of the same series at or before its ts and less than
    ``lookback_seconds`` older; null where there is none.

    Both sides are put on one time line and the last sample is a running maximum in two
    levels, so a busy series is spread over its time buckets. Samples without ts or value
    do not count; of samples at one ts the largest seq does; a left row without ts gets null.
    """
    series = list(series)
    at = dict(left.dtypes)["ts"]
    points = samples.where("ts is not null and value is not null").select(
        *series, F.col("ts").cast(at).alias("ts"), F.lit(0).alias("_side"), "seq",
        F.struct(F.col("ts").cast(at).alias("ts"), F.col("seq"), F.col("value")).alias("_sample"))
    asked = left.select(*series, "ts", F.lit(1).alias("_side"),
                        F.struct(*[c for c in left.columns if c not in (*series, "ts")] or [F.lit(0).alias("_")])
                        .alias("_row"))
    line = points.unionByName(asked, allowMissingColumns=True)
    found = running_max(line, series, ["ts", "_side", "seq"], F.col("_sample"),
                        F.date_trunc(bucket_unit, F.col("ts")), "_last").where("_side = 1")
    fresh = micros(F.col("ts")) - micros(F.col("_last.ts")) < F.lit(int(lookback_seconds * 1e6))
    return found.select(*series, "ts", *[F.col(f"_row.{c}").alias(c) for c in left.columns if c not in (*series, "ts")],
                        F.when(fresh, F.col("_last.value")).alias(out))


def evaluation_steps(samples: DataFrame, series=("client_id",), step_seconds: int = 60) -> DataFrame:
    """The multiples of ``step_seconds`` between the first and the last sample of a series."""
    step, us = step_seconds * 1_000_000, micros(F.col("ts"))
    ends = samples.groupBy(*series).agg(F.min(us).alias("lo"), F.max(us).alias("hi")) \
        .select(*series, ((F.floor(F.col("lo") / step) + 1) * step).alias("lo"), "hi").where("lo <= hi")
    t = F.explode(F.sequence(F.col("lo"), F.col("hi"), F.lit(step))).alias("us")
    return ends.select(*series, t).select(
        *series, F.timestamp_micros("us").cast(dict(samples.dtypes)["ts"]).alias("ts"), F.col("us").alias("seq"))


def ratio_alert(used: DataFrame, available: DataFrame, threshold: float = 0.9, for_seconds: float = 300.0,
                step_seconds: int = 60, lookback_seconds: float = 300.0, series=("client_id",)) -> DataFrame:
    """Two gauges (series, ts, seq, value), evaluated together at steps: their last values
    there, the ratio, and since when used > threshold * available has held. Rows of the
    steps at which it has held for ``for_seconds``; a step where either gauge has no recent
    sample resets. The samples of the two need not coincide."""
    series = list(series)
    both = used.select(*series, "ts").unionByName(available.select(*series, "ts"))
    at = evaluation_steps(both, series, step_seconds)
    at = last_at(at, used, series, lookback_seconds, "used")
    at = last_at(at, available, series, lookback_seconds, "available")
    over = F.col("used") > threshold * F.col("available")
    return alert_for(at, over, for_seconds, series, F.date_trunc("hour", F.col("ts"))).select(
        *series, "ts", "used", "available", F.try_divide("used", "available").alias("ratio"), "pending_since")


def failures_by_type(ev: DataFrame) -> DataFrame:
    """Failures per client and type."""
    return ev.where(F.col("status") == "failed").groupBy("client_id", "failure_type").agg(
        F.count(F.lit(1)).alias("failures"))


def health_summary(ev: DataFrame, round_types: list[str], min_success: float = 0.75) -> DataFrame:
    """Latest gauge per round type as columns (pivot with explicit values),
    rounds seen, success rate and a health flag per client."""
    last = ev.groupBy("client_id").pivot("round_type", round_types).agg(
        F.max_by("value", F.struct("ts", "seq")))
    tot = ev.groupBy("client_id").agg(
        F.count(F.lit(1)).alias("rounds"),
        (F.count_if(F.col("status") == "success") / F.count(F.lit(1))).alias("success_rate"))
    j = last.join(tot, "client_id")
    return j.withColumn("health", F.when(F.col("success_rate") >= min_success, F.lit("healthy"))
                        .otherwise(F.lit("degraded")))


def metric_log(long: DataFrame, prefix: Column, step: str = "round") -> DataFrame:
    """(key, step, value) with prefixed keys."""
    return long.select(F.concat(prefix, F.lit("_"), F.col("key")).alias("key"),
                       F.col(step).cast("long").alias("step"), F.col("value"))


def metric_pivot(log: DataFrame, keys: list[str]) -> DataFrame:
    """M15 inverse: one row per step, one column per key (explicit key list)."""
    return log.groupBy("step").pivot("key", keys).agg(F.first("value"))


def flatten_params(df: DataFrame, id_cols: list[str]) -> DataFrame:
    """Nested structs -> dotted keys in long form; numbers stay numeric,
    other leaves become text. Walks the schema on the driver (no data)."""
    from pyspark.sql import types as T

    leaves = []

    def walk(prefix, dtype, expr):
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                walk(f"{prefix}.{f.name}" if prefix else f.name, f.dataType, expr[f.name])
        else:
            leaves.append((prefix, dtype, expr))

    for f in df.schema.fields:
        if f.name not in id_cols:
            walk(f.name, f.dataType, F.col(f.name))
    num = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
    rows = F.array(*[F.struct(F.lit(k).alias("key"),
                              (e.cast("double") if isinstance(t, num) else F.lit(None).cast("double"))
                              .alias("value_num"),
                              (F.lit(None).cast("string") if isinstance(t, num) else e.cast("string"))
                              .alias("value_str")) for k, t, e in leaves])
    return df.select(*id_cols, F.explode(rows).alias("_p")).select(*id_cols, "_p.*")
