"""Property-based checks of the monitoring operators against plain Python
(Hypothesis, few examples each: every example runs Spark jobs)."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fraudlake.operators import monitor as M

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "seq long, ts timestamp_ntz, client_id string, round_type string, status string, value double"
SETTINGS = settings(max_examples=8, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])

events = st.lists(
    st.tuples(st.sampled_from(["bank_1", "bank_2"]),
              st.integers(min_value=0, max_value=3 * 3600),
              st.floats(min_value=0.0, max_value=700.0, allow_nan=False),
              st.sampled_from(["training", "evaluation"]),
              st.sampled_from(["success", "failed"])),
    min_size=1, max_size=60)


def frame(spark, evs):
    rows = [(i, T0 + dt.timedelta(seconds=s), c, rt, stt, v)
            for i, (c, s, v, rt, stt) in enumerate(evs)]
    return spark.createDataFrame(rows, SCHEMA), rows


@SETTINGS
@given(evs=events, threshold=st.floats(min_value=0, max_value=700), hold=st.integers(0, 1800))
def test_alert_for_matches_state_machine(spark, evs, threshold, hold):
    df, rows = frame(spark, evs)
    got = {(r["client_id"], r["seq"], r["pending_since"]) for r in
           M.alert_for(df, F.col("value") > threshold, hold,
                       bucket=F.date_trunc("hour", "ts")).collect()}
    exp = set()
    for c in {r[2] for r in rows}:
        pending = None
        for seq, ts, _, _, _, v in sorted((r for r in rows if r[2] == c), key=lambda r: (r[1], r[0])):
            if v > threshold:
                pending = pending or ts
                if (ts - pending).total_seconds() >= hold:
                    exp.add((c, seq, pending))
            else:
                pending = None
    assert got == exp


@SETTINGS
@given(evs=events)
def test_histogram_and_counters(spark, evs):
    df, rows = frame(spark, evs)
    h = M.histogram(df).collect()
    for rt in {r[3] for r in rows}:
        vals = [r[5] for r in rows if r[3] == rt]
        mine = sorted((r["le"], r["bucket_count"]) for r in h if r["round_type"] == rt)
        assert [c for _, c in mine] == [sum(v <= le for v in vals) for le, _ in mine]
        assert mine[-1][1] == len(vals)
    tot = M.counter_total(df).agg(F.sum("total")).first()[0]
    assert tot == len(rows)


@SETTINGS
@given(evs=events)
def test_gauge_last_is_latest(spark, evs):
    df, rows = frame(spark, evs)
    got = {(r["client_id"], r["round_type"]): r["value"] for r in M.gauge_last(df).collect()}
    for key in got:
        last = max((r for r in rows if (r[2], r[3]) == key), key=lambda r: (r[1], r[0]))
        assert got[key] == last[5]


@SETTINGS
@given(evs=events)
def test_counter_reset_rule(spark, evs):
    """Cumulative samples with resets give back the original increments."""
    df, rows = frame(spark, evs)
    out = M.increments_from_cumulative(
        df.withColumn("value", F.sum("value").over(
            __import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy(
                "client_id", F.to_date("ts")).orderBy("ts", "seq"))), ["client_id"],
        bucket=F.date_trunc("hour", "ts"))
    got = {r["seq"]: r["increment"] for r in out.collect()}
    for seq, _, _, _, _, v in rows:
        assert abs(got[seq] - v) < 1e-6


@SETTINGS
@given(vals=st.lists(st.tuples(st.sampled_from(["auprc", "failures", "duration"]),
                               st.floats(min_value=0, max_value=1000, allow_nan=False)),
                     min_size=1, max_size=20),
       rules=st.lists(st.tuples(st.sampled_from(["auprc", "failures", "duration"]),
                                st.floats(min_value=0, max_value=1000, allow_nan=False),
                                st.sampled_from(["gt", "lt", "eq"])), min_size=1, max_size=5))
def test_threshold_alerts_match_python(spark, vals, rules):
    values = spark.createDataFrame([(f"c{i}", m, v) for i, (m, v) in enumerate(vals)],
                                   "client_id string, metric string, value double")
    rt = spark.createDataFrame([(m, t, o, "warning", "msg") for m, t, o in rules],
                               "metric string, threshold double, op string, severity string, message string")
    got = sorted((r["client_id"], r["metric"], r["threshold"], r["op"])
                 for r in M.threshold_alerts(values, rt).collect())
    ops = {"gt": lambda a, b: a > b, "lt": lambda a, b: a < b, "eq": lambda a, b: a == b}
    exp = sorted((f"c{i}", m, t, o) for i, (m, v) in enumerate(vals) for (rm, t, o) in rules
                 if rm == m and ops[o](v, t))
    assert got == exp


@SETTINGS
@given(spent=st.lists(st.floats(min_value=0, max_value=20, allow_nan=False), min_size=1, max_size=20),
       budget=st.floats(min_value=0.5, max_value=10))
def test_budget_status_properties(spark, spent, budget):
    from fraudlake.operators import privacy as PV
    df = spark.createDataFrame([(f"c{i}", s, budget) for i, s in enumerate(spent)],
                               "client_id string, epsilon_spent double, budget double")
    for r in PV.budget_status(df).collect():
        assert r["remaining"] >= 0
        assert r["exhausted"] == (r["epsilon_spent"] >= r["budget"])
        assert abs(r["remaining"] - max(0.0, r["budget"] - r["epsilon_spent"])) < 1e-12


@SETTINGS
@given(series=st.lists(st.floats(min_value=0, max_value=1, allow_nan=False), min_size=1, max_size=12))
def test_convergence_rule(spark, series):
    import numpy as np
    from fraudlake.operators import trends as W
    df = spark.createDataFrame([("c", i + 1, v) for i, v in enumerate(series)],
                               "client_id string, round int, auprc double")
    out = {r["round"]: (r["converged"], r["convergence_score"]) for r in W.convergence(df).collect()}
    for i in range(len(series)):
        if i + 1 < 3:
            assert out[i + 1] == (False, 1.0)
        else:
            sd = float(np.std(series[i - 2:i + 1]))
            assert abs(out[i + 1][1] - sd) < 1e-9 and out[i + 1][0] == (sd < 0.01)
