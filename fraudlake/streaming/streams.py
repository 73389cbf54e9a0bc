"""Structured Streaming jobs over the event and record files.

Sources are file streams (new Parquet files in a folder); sinks are Parquet
folders with a checkpoint location, so a restarted query resumes where it
stopped. Tests run them with ``trigger(availableNow=True)``.
"""

from __future__ import annotations

import contextlib
import datetime
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupStateTimeout

from fraudlake.operators import quality as Q
from fraudlake.operators.monitor import LE_BOUNDS
from fraudlake.session import is_dir, path_exists
from fraudlake.sources.fixtures import _DIRTY_COLUMNS, _METRIC_EVENT_COLUMNS, _cols


def _watch_path(spark: SparkSession, path: str) -> str:
    """A file stream watches a folder or a glob; a single file is watched
    through a one-file glob (its last character as a character class)."""
    if is_dir(spark, path):
        return path
    head, name = os.path.split(path)
    return os.path.join(head, f"{name[:-1]}[{name[-1]}]")


def event_stream(spark: SparkSession, events_path: str, max_files: int | None = None) -> DataFrame:
    """Metric events as a stream; ``ts`` becomes TIMESTAMP (watermarks reject NTZ)."""
    schema = spark.read.parquet(events_path).schema
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    raw = reader.parquet(_watch_path(spark, events_path))
    return raw.selectExpr(*_cols(_METRIC_EVENT_COLUMNS, "spark")) \
        .withColumn("ts", F.col("ts").cast("timestamp"))


def window_metrics(ev: DataFrame, watermark: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Per round type and tumbling window: rounds, failures, value sum
    (the M1/M3/M5/M6 inputs), with a watermark for late data."""
    return (ev.withWatermark("ts", watermark)
            .groupBy(F.window("ts", width).alias("w"), "round_type")
            .agg(F.count(F.lit(1)).alias("rounds"),
                 F.count_if(F.col("status") == "failed").alias("failures"),
                 F.sum("value").alias("value_sum"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "round_type", "rounds", "failures", "value_sum"))


def run_to_sink(df: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Start the stream into a Parquet sink, process what is available, stop."""
    q = (df.writeStream.format("parquet").outputMode(mode)
         .option("path", sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def stream_window_metrics(spark: SparkSession, events_path: str, base: str) -> DataFrame:
    """M17 end to end: file stream -> windowed metrics -> Parquet sink -> read back."""
    sink, ckpt = os.path.join(base, "sink"), os.path.join(base, "checkpoint")
    run_to_sink(window_metrics(event_stream(spark, events_path)), sink, ckpt)
    return spark.read.parquet(sink)


def window_rates(ev: DataFrame, watermark: str = "10 minutes", width: str = "5 minutes",
                 slide: str = "1 minute", seconds: float = 300.0) -> DataFrame:
    """M4 continuously: per client and sliding window, value increase per second."""
    return (ev.withWatermark("ts", watermark)
            .groupBy(F.window("ts", width, slide).alias("w"), "client_id")
            .agg((F.sum("value") / F.lit(seconds)).alias("rate"))
            .select("client_id", F.col("w.start").alias("window_start"),
                    F.col("w.end").alias("window_end"), "rate"))


def stream_rates(spark: SparkSession, events_path: str, base: str) -> DataFrame:
    """File stream -> sliding 5-minute rates -> Parquet sink -> read back."""
    sink, ckpt = os.path.join(base, "sink"), os.path.join(base, "checkpoint")
    run_to_sink(window_rates(event_stream(spark, events_path)), sink, ckpt)
    return spark.read.parquet(sink)


def batch_twin(ev: DataFrame, watermark_seconds: int = 600, width: str = "1 minute") -> DataFrame:
    """The batch result restricted to windows the final watermark has closed."""
    agg = window_metrics(ev.withColumn("ts", F.col("ts").cast("timestamp")))
    wm = ev.agg(F.max(F.col("ts").cast("timestamp")).alias("m")).select(
        (F.col("m") - F.make_dt_interval(secs=F.lit(watermark_seconds))).alias("wm"))
    return agg.join(F.broadcast(wm), F.col("window_end") <= F.col("wm")).drop("wm")


# --- M1, M3, M17: counters and histograms in windows, with late rows and a flush ---------------

@dataclass
class Windows:
    """What a windowed stream has given: windows closed by the watermark, the watermark, and
    the rows that came too late for their window."""

    closed: DataFrame
    watermark: datetime.datetime | None
    late_rows: int


def windowed(ev: DataFrame, keys: list[str], aggs: list[Column], width: str = "1 minute") -> DataFrame:
    """Tumbling windows of events with the given aggregates; a batch as well as a stream."""
    w = ev.groupBy(F.window("ts", width).alias("w"), *keys).agg(*aggs)
    return w.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *w.columns[1:])


def counters(ev: DataFrame, width: str = "1 minute") -> DataFrame:
    """M1 in windows: events and value sum per label set."""
    return windowed(ev, ["client_id", "round_type", "status"],
                    [F.count(F.lit(1)).alias("total"), F.sum("value").alias("value_total")], width)


def bucket_counts(ev: DataFrame, width: str = "1 hour") -> DataFrame:
    """M3 in windows: cumulative ``le`` bucket counts, sum and count per round type, a column
    per bucket (``le_rows`` turns them into rows)."""
    return windowed(ev, ["round_type"], [
        *[F.count_if(F.col("value") <= F.lit(b)).alias(f"le_{i}") for i, b in enumerate(LE_BOUNDS)],
        F.sum("value").alias("sum"), F.count(F.lit(1)).alias("count")], width)


def le_rows(windows: DataFrame) -> DataFrame:
    stack = ", ".join(f"cast('{'Infinity' if b == float('inf') else b}' as double), le_{i}"
                      for i, b in enumerate(LE_BOUNDS))
    return windows.selectExpr("window_start", "window_end", "round_type",
                              f"stack({len(LE_BOUNDS)}, {stack}) as (le, bucket_count)", "sum", "count")


def run_windows(spark: SparkSession, events_path: str, base: str, plan, watermark: str = "10 minutes",
                max_files: int | None = None) -> Windows:
    """Stream the events through ``plan`` (one of the above) into a Parquet sink until all
    files are read. Late rows are those the state operators report as dropped behind
    the watermark, over all batches of this run."""
    sink, ckpt = os.path.join(base, "sink"), os.path.join(base, "checkpoint")
    ev = event_stream(spark, events_path, max_files).withWatermark("ts", watermark)
    late: dict[int, int] = {}
    last = None
    q = (plan(ev).writeStream.format("parquet").outputMode("append").option("path", sink)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    while True:                     # progress of long runs is kept for the last batches only
        ended = q.awaitTermination(5)
        for p in q.recentProgress:
            late[p["batchId"]] = sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"])
            last = p["eventTime"].get("watermark", last)
        if ended:
            break
    mark = None if last is None else datetime.datetime.fromisoformat(last.replace("Z", "+00:00"))
    return Windows(spark.read.parquet(sink), mark, sum(late.values()))


def with_open_windows(spark: SparkSession, got: Windows, events_path: str, plan) -> DataFrame:
    """The closed windows and, on demand, those still open at the end of the stream: the same
    aggregates over the rows at or behind the last watermark, which no late row has left."""
    ev = spark.read.parquet(events_path).selectExpr(*_cols(_METRIC_EVENT_COLUMNS, "spark")) \
        .withColumn("ts", F.col("ts").cast("timestamp"))
    # a window is open if it ends after the watermark; it can begin before it
    open_ = plan(ev) if got.watermark is None else plan(ev).where(F.col("window_end") > F.lit(got.watermark))
    return got.closed.unionByName(open_)


# --- M18: quarantine on arriving files -----------------------------------------------------------

def record_stream(spark: SparkSession, orders_path: str,
                  max_files: int | None = None) -> DataFrame:
    schema = spark.read.parquet(orders_path).schema
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(_watch_path(spark, orders_path)).selectExpr(
        *_cols(_DIRTY_COLUMNS, "spark"))


def quarantine_batch(good_path: str, bad_path: str):
    """foreachBatch body: type, filter, first-per-key across batches, write.

    Output folders are named by batch id and overwritten, so a batch that is
    re-run after a failure replaces its own output instead of duplicating it.
    Keys seen before are looked up in the folders of earlier batches only, never
    in the batch's own; the lookup reads the key column alone.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        reasons = Q.reject_reasons(batch, carry=("received_at",))
        accepted = reasons.where(F.col("reject_reason").isNull())
        earlier = [p for b in range(batch_id)
                   if path_exists(spark, p := os.path.join(good_path, f"batch={b}"))]
        if earlier:
            seen = spark.read.parquet(*earlier).select("TransactionID").distinct()
            repeat = accepted.join(seen, "TransactionID", "left_semi") \
                .withColumn("reject_reason", F.lit("duplicate_key"))
            accepted = accepted.join(seen, "TransactionID", "left_anti")
            rejected = reasons.where(F.col("reject_reason").isNotNull()).unionByName(repeat)
        else:
            rejected = reasons.where(F.col("reject_reason").isNotNull())
        accepted.select("line_no", "TransactionID", "isFraud", "TransactionAmt", "received_at") \
            .write.mode("overwrite").parquet(os.path.join(good_path, f"batch={batch_id}"))
        rejected.select("line_no", F.col("reject_reason").alias("reason"), "received_at") \
            .write.mode("overwrite").parquet(os.path.join(bad_path, f"batch={batch_id}"))

    return run


_DECIDED = "line_no long, TransactionID long, isFraud int, TransactionAmt double, received_at timestamp, reason string"


class FirstPerKey(StatefulProcessor):
    """Accepts the first record of every key and marks later ones, over all micro-batches.

    A group is a bucket of keys, its state a map from key to the line that was accepted:
    a batch looks up and adds its own keys only, however many there were before. Within
    a batch the smallest line is first; per bucket one candidate a key is held.
    """

    def init(self, handle) -> None:
        self.seen = handle.getMapState("seen", "key long", "line long")

    def handleInputRows(self, key, rows, timers):
        import pandas as pd

        names = [c.split(" ")[0] for c in _DECIDED.split(", ")]
        first: dict[int, tuple] = {}
        for part in rows:
            decided = []
            for row in part[names].itertuples(index=False, name=None):
                if row[5] is not None:                       # rejected for its own sake
                    decided.append(row)
                    continue
                k = int(row[1])                              # a column with nulls comes as floats
                held = first.get(k)
                if held is None or row[0] < held[0]:
                    first[k], row = row, held
                if row is not None:                          # the later one of two
                    decided.append((*row[:5], "duplicate_key"))
            yield pd.DataFrame(decided, columns=names)
        out = []
        for k, row in first.items():
            if self.seen.containsKey((k,)):
                row = (*row[:5], "duplicate_key")
            else:
                self.seen.updateValue((k,), (int(row[0]),))
            out.append(row)
        yield pd.DataFrame(out, columns=names)

    def close(self) -> None:
        pass


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def keyed_state(spark: SparkSession):
    """State on disk (RocksDB) for the queries started inside, as keyed processors need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def split_batch(good_path: str, bad_path: str):
    """foreachBatch body: accepted and rejected records into folders of the batch, so a batch
    that runs again replaces its own output."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch.where("reason is null").drop("reason").write.mode("overwrite") \
            .parquet(os.path.join(good_path, f"batch={batch_id}"))
        batch.where("reason is not null").select("line_no", "reason", "received_at").write.mode("overwrite") \
            .parquet(os.path.join(bad_path, f"batch={batch_id}"))

    return run


def decided_records(records: DataFrame, buckets: int) -> DataFrame:
    """The stream of records with their reason (null: accepted), first per key over the whole stream."""
    t = Q.early_reasons(records, carry=("received_at",)).select(
        F.col("line_no").cast("long").alias("line_no"), F.col("TransactionID").cast("long").alias("TransactionID"),
        F.col("isFraud").cast("int").alias("isFraud"), F.col("TransactionAmt").cast("double").alias("TransactionAmt"),
        F.col("received_at").cast("timestamp").alias("received_at"), F.col("_early").alias("reason"))
    # records without a key are spread by line
    bucket = F.pmod(F.xxhash64(F.coalesce("TransactionID", "line_no")), F.lit(buckets))
    return t.withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(
        FirstPerKey(), _DECIDED, "Append", "None")


def stream_quarantine(spark: SparkSession, orders_path: str, base: str,
                      max_files: int | None = None, buckets: int | None = None) -> DataFrame:
    """M18 end to end; returns record counts per (table, reason).

    Keys of earlier batches live in keyed state, so a batch costs what its own records
    cost; the state and the output folders are both tied to the batch id, so a restarted
    query replays a batch to the same result.
    """
    good, bad = os.path.join(base, "good"), os.path.join(base, "bad")
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    with keyed_state(spark):
        q = (decided_records(record_stream(spark, orders_path, max_files), buckets).writeStream
             .foreachBatch(split_batch(good, bad))
             .option("checkpointLocation", os.path.join(base, "checkpoint"))
             .trigger(availableNow=True).start())
        q.awaitTermination()
    g = spark.read.parquet(good).groupBy(F.lit("good").alias("table"),
                                         F.lit(None).cast("string").alias("reason")).count()
    b = spark.read.parquet(bad).groupBy(F.lit("quarantine").alias("table"), "reason").count()
    return g.unionByName(b).withColumnRenamed("count", "records")


# --- M9 streaming: sustained-condition alerts with state -------------------------------------------

def _alert_state_fn(threshold: float, for_us: int, idle_us: int):
    import numpy as np
    import pandas as pd

    def fn(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        pending = state.get[0] if state.exists else None
        frames = [p for p in pdfs if len(p)]
        if not frames:
            return
        pdf = pd.concat(frames).sort_values(["ts", "seq"])
        ts = (pdf["ts"].astype("int64") // 1000).to_numpy()
        cond = (pdf["value"] > threshold).to_numpy()
        # vectorised state machine: a false sample opens a new segment; a true
        # sample's run started at the first true sample of its segment (or at
        # the carried pending time for the segment before any false sample)
        seg = np.cumsum(~cond)
        first_true = pd.Series(np.where(cond, ts, np.iinfo("int64").max)).groupby(seg).transform("min")
        start = first_true.to_numpy()
        if pending is not None:
            start = np.where(seg == 0, min(pending, int(start[0]) if cond[0] else pending), start)
        fire = cond & (ts - start >= for_us)
        if cond[-1]:
            state.update((int(start[-1]),))
        elif state.exists:
            state.remove()
        state.setTimeoutTimestamp(int(ts[-1]) // 1000 + idle_us // 1000)
        if fire.any():
            res = pd.DataFrame({"client_id": key[0], "ts": pd.to_datetime(ts[fire], unit="us"),
                                "seq": pdf["seq"].to_numpy()[fire],
                                "pending_since": pd.to_datetime(start[fire], unit="us")})
            yield res

    return fn


def alert_for_stream(ev: DataFrame, threshold: float, for_seconds: int,
                     watermark: str = "10 minutes", idle_seconds: int = 3600) -> DataFrame:
    """M9 (stream): per client keep ``pending_since`` in state; a sample at or
    below the threshold clears it; a silent series is cleared by an
    event-time timeout."""
    fn = _alert_state_fn(threshold, for_seconds * 1_000_000, idle_seconds * 1_000_000)
    return (ev.withWatermark("ts", watermark)
            .groupBy("client_id")
            .applyInPandasWithState(
                fn, "client_id string, ts timestamp, seq long, pending_since timestamp",
                "pending long", "append", GroupStateTimeout.EventTimeTimeout))


def stream_alert_for(spark: SparkSession, events_path: str, base: str, threshold: float,
                     for_seconds: int, max_files: int | None = None) -> DataFrame:
    sink, ckpt = os.path.join(base, "sink"), os.path.join(base, "checkpoint")
    run_to_sink(alert_for_stream(event_stream(spark, events_path, max_files), threshold,
                                 for_seconds), sink, ckpt)
    return spark.read.parquet(sink)
