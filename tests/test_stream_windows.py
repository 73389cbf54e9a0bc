"""Windowed counters and histograms over file streams: late rows, open windows, restarts."""

import datetime as dt
import random

from pyspark.sql import functions as F

from fraudlake.operators import quality as Q
from fraudlake.streaming import streams as S

from conftest import SF_SMALL

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
T0 = dt.datetime(2024, 5, 1, 10)


def write_files(spark, path, files):
    for k, rows in enumerate(files):
        df = spark.createDataFrame([(100 * k + n, T0 + dt.timedelta(seconds=s), n % 5, "view", v, "{}")
                                    for n, (s, v) in enumerate(rows)], SCHEMA)
        df.coalesce(1).write.mode("append").parquet(path)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_closed_and_flushed_windows_are_the_batch_result(spark, tmp_path):
    rng = random.Random(3)
    path = str(tmp_path / "in")
    write_files(spark, path, [[(3000 * k + rng.randint(0, 900), rng.uniform(0, 400)) for _ in range(40)] for k in range(4)])
    for name, plan in (("c", S.counters), ("b", S.bucket_counts)):
        got = S.run_windows(spark, path, str(tmp_path / name), plan, max_files=4)
        assert got.late_rows == 0 and got.watermark is not None
        everything = plan(spark.read.parquet(path).selectExpr(*S._cols(S._METRIC_EVENT_COLUMNS, "spark"))
                          .withColumn("ts", F.col("ts").cast("timestamp")))
        closed = rows_of(got.closed)
        assert 0 < len(closed) < len(rows_of(everything))
        assert rows_of(S.with_open_windows(spark, got, path, plan).select(*everything.columns)) == rows_of(everything)


def test_late_rows_are_counted_and_leave_no_trace(spark, tmp_path):
    path = str(tmp_path / "in")
    write_files(spark, path, [[(0, 1.0), (30, 2.0)]])
    base = str(tmp_path / "run")
    first = S.run_windows(spark, path, base, S.counters, max_files=1)
    assert first.late_rows == 0
    write_files(spark, path, [[(7200, 5.0)]])                      # moves the watermark two hours on
    S.run_windows(spark, path, base, S.counters, max_files=1)
    write_files(spark, path, [[(10, 9.0), (7190, 1.0), (7210, 1.0)]])  # ten seconds: hours late; the others in time
    got = S.run_windows(spark, path, base, S.counters, max_files=1)
    assert got.late_rows == 1
    windows = S.with_open_windows(spark, got, path, S.counters)
    assert windows.agg(F.sum("total")).first()[0] == 5             # all rows but the late one
    assert windows.where("window_start < timestamp'2024-05-01 10:01:00'").agg(F.sum("value_total")).first()[0] == 3.0


def test_buckets_are_cumulative(spark, tmp_path):
    path = str(tmp_path / "in")
    write_files(spark, path, [[(k, v) for k, v in enumerate([0.5, 1.0, 7.0, 59.0, 601.0, 1e9])]])
    got = S.run_windows(spark, path, str(tmp_path / "run"), S.bucket_counts)
    rows = S.le_rows(S.with_open_windows(spark, got, path, S.bucket_counts))
    by_le = rows.groupBy("le").agg(F.sum("bucket_count").alias("n")).orderBy("le").collect()
    assert [r.n for r in by_le] == [2, 2, 3, 3, 4, 4, 4, 4, 6]
    assert by_le[-1].le == float("inf")


def orders(spark, path, rows):
    """Order files whose keys and flags are given: (orderkey, custkey)."""
    schema = spark.read.parquet(f"{SF_SMALL}/orders.parquet").schema
    base = spark.read.parquet(f"{SF_SMALL}/orders.parquet").limit(1).collect()[0].asDict()
    spark.createDataFrame([{**base, "o_orderkey": k} for k in rows], schema).coalesce(1).write.mode("append").parquet(path)


def test_quarantine_state_is_independent_of_history(spark, tmp_path):
    """Batches far apart: a key of the first is known in the last, and a batch adds to the state only its
    own keys; nothing of the earlier output is read (it is gone)."""
    import shutil

    path, base = str(tmp_path / "in"), str(tmp_path / "run")
    plain = spark.read.parquet(f"{SF_SMALL}/orders.parquet").selectExpr(*S._cols(S._DIRTY_COLUMNS, "spark"))
    reasons = Q.reject_reasons(plain, carry=("received_at",))
    good = [r.line_no for r in reasons.where("reject_reason is null").orderBy("line_no").limit(12).collect()]
    counts = {}
    for n, keys in enumerate([good[:4], good[4:8], good[:2] + good[8:10], good[:12]]):
        orders(spark, path, keys)
        out = S.stream_quarantine(spark, path, base, max_files=1, buckets=3)
        rows = {(r.table, r.reason): r.records for r in out.collect()}
        counts[n] = rows
        if n == 2:                      # output of earlier batches moved away: only the state knows the keys
            for k in range(3):
                for t in ("good", "bad"):
                    shutil.move(f"{base}/{t}/batch={k}", tmp_path / f"{t}-{k}")
    assert counts[1] == {("good", None): 8}
    assert counts[2] == {("good", None): 10, ("quarantine", "duplicate_key"): 2}
    assert counts[3] == {("good", None): 2, ("quarantine", "duplicate_key"): 10}


def test_a_hot_key_and_keyless_records(spark, tmp_path):
    path, base = str(tmp_path / "in"), str(tmp_path / "run")
    records = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    records.unionByName(records.where("o_orderkey % 7 = 0")).unionByName(records.limit(5)).coalesce(1).write.parquet(path)
    want = Q.reject_reasons(spark.read.parquet(path).selectExpr(*S._cols(S._DIRTY_COLUMNS, "spark")),
                            carry=("received_at",))
    out = S.stream_quarantine(spark, path, base, buckets=2)
    rejected = want.where("reject_reason <> 'duplicate_key'").groupBy("reject_reason").count().collect()
    got = {r.reason: r.records for r in out.where("table = 'quarantine'").collect()}
    assert {r[0]: r[1] for r in rejected}.items() <= got.items()
    keys = want.where("reject_reason is null or reject_reason = 'duplicate_key'").select("TransactionID").distinct().count()
    assert out.where("table = 'good'").first().records == keys
    assert sum(r.records for r in out.collect()) == spark.read.parquet(path).count()
