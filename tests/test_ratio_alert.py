"""As-of join and the alert on two gauges against plain Python."""

import datetime as dt
import random

import pytest

from fraudlake.operators import monitor as M

T0 = dt.datetime(2024, 3, 1)
SCHEMA = "client_id string, ts timestamp_ntz, seq long, value double"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def samples(rng, n, span, gap=None):
    out = []
    for k in range(n):
        t = rng.choice([rng.randint(0, span), 60 * rng.randint(0, span // 60)])
        if gap and gap[0] <= t < gap[1]:
            continue
        out.append((rng.choice(["a", "b"]), at(t), k, rng.choice([None, rng.uniform(0, 10), 0.0])))
    return out


def brute_last(samples, client, t, lookback):
    seen = [(s[1], s[2], s[3]) for s in samples if s[0] == client and s[1] is not None and s[3] is not None and s[1] <= t]
    if not seen or (t - max(seen)[0]).total_seconds() >= lookback:
        return None
    return max(seen)[2]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_last_at(spark, seed):
    rng = random.Random(seed)
    right = samples(rng, 120, 9000) + [("a", None, 999, 5.0), ("c", at(5), 1, 2.0)]
    left = [(rng.choice(["a", "b", "c", "nobody"]), at(rng.randint(0, 9500)), f"row {k}") for k in range(80)]
    left += left[:5] + [("a", None, "no time")]
    got = M.last_at(spark.createDataFrame(left, "client_id string, ts timestamp_ntz, tag string"),
                    spark.createDataFrame(right, SCHEMA), lookback_seconds=400)
    want = [(c, t, tag, None if t is None else brute_last(right, c, t, 400)) for c, t, tag in left]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert got.columns == ["client_id", "ts", "tag", "value"]


def brute_alert(used, available, threshold, for_seconds, step, lookback):
    out = []
    for c in sorted({s[0] for s in used + available}):
        times = [(s[1] - T0).total_seconds() for s in used + available if s[0] == c and s[1] is not None]
        since = None
        t = (min(times) // step + 1) * step
        while t <= max(times):
            u, a = (brute_last(s, c, at(t), lookback) for s in (used, available))
            if u is None or a is None or not u > threshold * a:
                since = None
            else:
                since = t if since is None else since
                if t - since >= for_seconds:
                    out.append((c, at(t), u, a, u / a if a else None, at(since)))
            t += step
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_ratio_alert(spark, seed):
    rng = random.Random(seed)
    used, available = samples(rng, 300, 7200, (2000, 3500)), samples(rng, 70, 7200)
    dfs = [spark.createDataFrame(x, SCHEMA) for x in (used, available)]
    got = M.ratio_alert(*dfs, threshold=0.9, for_seconds=180, step_seconds=60, lookback_seconds=300)
    want = brute_alert(used, available, 0.9, 180, 60, 300)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert seed or len(want) > 3


def test_ratio_alert_on_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([("a", at(1), 1, 9.0), ("a", at(900), 2, 9.0)], SCHEMA)
    for used, available in ((none, none), (some, none), (none, some)):
        assert M.ratio_alert(used, available).collect() == []


def test_one_busy_series_is_spread(spark):
    """A series with all samples is cut at hours: no window over the whole series but over hourly totals."""
    df = spark.createDataFrame([("a", at(k), k, 1.0) for k in range(3)], SCHEMA)
    plan = M.last_at(df.select("client_id", "ts"), df)._jdf.queryExecution().optimizedPlan().toString()
    plan = plan.replace(" ", "")
    assert "date_trunc(hour,cast(ts" in plan and "windowspecdefinition(client_id" in plan and ",_bkt#" in plan
