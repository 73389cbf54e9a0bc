"""Invariants of the ordered and ranking operators, including brute-force
checks of the distributed rank helpers with forced narrowing levels."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fraudlake.operators import metrics as M
from fraudlake.operators import prepare as P
from fraudlake.operators import rank
from fraudlake.sources import fixtures as fx

from conftest import SF_SMALL


def _brute_rank(rows, ranks):
    srt = sorted(rows, key=lambda r: (r[1] is None, r[1] if r[1] is not None else 0, r[2]))
    return {k: (srt[k][1], srt[k][2]) for k in ranks if k < len(srt)}


@pytest.mark.parametrize("final_rows,n_bins", [(100_000, 4096), (40, 4), (5, 2)])
def test_cut_tuples_brute_force(spark, monkeypatch, final_rows, n_bins):
    monkeypatch.setattr(rank, "FINAL_ROWS", final_rows)
    monkeypatch.setattr(rank, "N_BINS", n_bins)
    rnd = random.Random(5)
    rows = []
    for i in range(600):
        g = "a" if i % 3 else "b"
        key = None if i % 17 == 0 else (7 if i % 4 == 0 else rnd.randint(0, 50))  # heavy value 7
        rows.append((g, key, i))
    df = spark.createDataFrame(rows, "g string, k long, t long")
    wanted = {"a": [0, 1, 100, 250, 399, 400, 500], "b": [0, 57, 150, 199, 200]}
    got = rank.cut_tuples(df, "g", "k", "t", wanted)
    for g, rs in wanted.items():
        exp = _brute_rank([r for r in rows if r[0] == g], rs)
        for k, v in exp.items():
            assert got[(g, k)] == v
        assert all((g, k) not in got for k in rs if k not in exp)


def test_prefix_sums_brute_force(spark):
    rnd = random.Random(3)
    rows = [("a" if i % 2 else "b", float(rnd.randint(0, 300)) / 7, rnd.randint(0, 5)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, s double, v long").groupBy("g", "s").agg(F.sum("v").alias("v"))
    out = rank.prefix_sums(df, ["g"], "s", ["v"], descending=True, n_buckets=16).collect()
    for r in out:
        exp = sum(v for g, s, v in rows if g == r["g"] and s >= r["s"])
        assert r["cum_v"] == exp


def test_split_is_total_disjoint_and_ordered(spark):
    tx = fx.transactions(spark, SF_SMALL)
    s = P.temporal_split(P.bank_partition(tx))
    assert s.count() == tx.count()
    assert s.select("TransactionID").distinct().count() == tx.count()
    per = {(r["bank_id"], r["split"]): r for r in s.groupBy("bank_id", "split").agg(
        F.min("TransactionDT").alias("lo"), F.max("TransactionDT").alias("hi")).collect()}
    for b in {k[0] for k in per}:
        assert per[(b, "train")]["hi"] <= per[(b, "val")]["lo"]
        assert per[(b, "val")]["hi"] <= per[(b, "test")]["lo"]


def test_same_split_for_any_partition_count(spark):
    tx = fx.transactions(spark, SF_SMALL)
    results = []
    for n in (1, 4, 64):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        s = P.temporal_split(P.bank_partition(tx.repartition(n)))
        results.append(sorted((r[0], r[1], r[2]) for r in s.select("TransactionID", "bank_id", "split").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1] == results[2]


def test_codes_are_dense(spark):
    s = P.temporal_split(P.bank_partition(fx.transactions(spark, SF_SMALL)))
    d = P.fit_dictionary(s.where("split = 'train'"), ["ProductCD", "card4"])
    for r in d.groupBy("bank_id", "column_name").agg(F.min("code").alias("lo"), F.max("code").alias("hi"),
                                                     F.count(F.lit(1)).alias("n")).collect():
        assert r["lo"] == 0 and r["hi"] == r["n"] - 1


def test_ranking_metric_properties(spark):
    sc = fx.lineitem_scores(spark, SF_SMALL)
    a = M.ranking_metrics(sc).first()
    b = M.ranking_metrics(sc.withColumn("score", 1 - F.col("score"))).first()
    assert 0 <= a["average_precision"] <= 1
    assert abs(b["auroc"] - (1 - a["auroc"])) < 1e-12
    pdf = sc.toPandas()
    pos = pdf[pdf.label == 1].score.to_numpy()
    neg = pdf[pdf.label == 0].score.to_numpy()
    mw = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert abs(a["auroc"] - mw) < 1e-12
    order = np.argsort(-pdf.score.to_numpy(), kind="stable")
    s, y = pdf.score.to_numpy()[order], pdf.label.to_numpy()[order]
    ap, tp, fp, prev_r = 0.0, 0, 0, 0.0
    i = 0
    while i < len(s):
        j = i
        while j < len(s) and s[j] == s[i]:
            tp += y[j]
            fp += 1 - y[j]
            j += 1
        r = tp / y.sum()
        ap += (r - prev_r) * tp / (tp + fp)
        prev_r, i = r, j
    assert abs(a["average_precision"] - ap) < 1e-12


def test_bootstrap_matches_numpy_and_partitioning(spark):
    from fraudlake.functions.hashrand import _poisson_quantile

    sc = fx.lineitem_scores(spark, SF_SMALL)
    res = []
    for n in (1, 8):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        res.append(M.bootstrap_ci(sc.repartition(n), n_boot=50, seed=3).first().asDict())
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert res[0] == res[1]
    assert res[0]["ap_lower"] <= res[0]["ap_upper"] and res[0]["auroc_lower"] <= res[0]["auroc_upper"]
    lam = np.array([0.5, 3.0, 20.0, 49.0])
    u = np.array([0.2, 0.9, 0.5, 0.999])
    k = _poisson_quantile(lam, u)
    from math import exp, factorial
    for lm, uu, kk in zip(lam, u, k):
        cdf = sum(exp(-lm) * lm ** i / factorial(i) for i in range(kk + 1))
        below = sum(exp(-lm) * lm ** i / factorial(i) for i in range(kk))
        assert below < uu <= cdf + 1e-12


def test_ordinal_codes_bucketed_equals_window(spark):
    rnd = random.Random(9)
    vals = {("a", "c1"): sorted({f"v{rnd.randint(0, 10**6):07d}" for _ in range(3000)}),
            ("b", "c1"): sorted({f"w{rnd.randint(0, 99):02d}" for _ in range(500)})}
    rows = [(g, c, v) for (g, c), vs in vals.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, column_name string, value string")
    out = rank.ordinal_codes(df, ["g", "column_name"], "value", limit=200, bucket_rows=300)
    got = {(r["g"], r["column_name"], r["value"]): r["code"] for r in out.collect()}
    for (g, c), vs in vals.items():
        for i, v in enumerate(vs):
            assert got[(g, c, v)] == i


@pytest.mark.parametrize("final_rows,n_bins", [(100_000, 4096), (7, 3)])
def test_exact_median_by_selection(spark, monkeypatch, final_rows, n_bins):
    monkeypatch.setattr(rank, "FINAL_ROWS", final_rows)
    monkeypatch.setattr(rank, "N_BINS", n_bins)
    rnd = random.Random(11)
    a = [rnd.choice([1.5, 1.5, 1.5, rnd.uniform(-1e6, 1e6)]) for _ in range(301)]
    b = [rnd.uniform(0, 1) * 10 ** rnd.randint(-5, 5) for _ in range(200)]
    rows = [(x, None) for x in a] + [(None, y) for y in b] + [(None, None)] * 5
    df = spark.createDataFrame(rows, "a double, b double")
    fills = dict((c, v) for c, _, v in P.fit_imputation(df))
    assert fills["a"] == float(np.median(a))
    assert abs(fills["b"] - float(np.median(b))) <= 1e-15 * abs(float(np.median(b)))


def test_bucket_numbers_for_any_number_of_bounds(spark):
    from fraudlake.functions.buckets import count_less_array
    rnd = random.Random(2)
    xs = [rnd.randint(0, 300) / 3 for _ in range(400)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for n in (0, 1, 2, 3, 10, 97):
        bounds = sorted(rnd.sample([k / 3 for k in range(300)], n))
        got = df.select("x", count_less_array(F.col("x"), bounds).alias("a"),
                        count_less_array(F.col("x"), bounds, closed=True).alias("b")).collect()
        assert all(r.a == sum(b < r.x for b in bounds) and r.b == sum(b <= r.x for b in bounds) for r in got)


def test_bootstrap_in_score_ranges_is_the_same(spark):
    sc = fx.lineitem_scores(spark, SF_SMALL)
    whole = M.bootstrap_ci(sc, n_boot=20, seed=1).first()
    cut = M.bootstrap_ci(sc, n_boot=20, seed=1, scores_per_task=50).first()
    assert whole["n_valid"] == cut["n_valid"] == 20
    assert all(abs(a - b) < 1e-12 for a, b in zip(whole, cut))


def test_poisson_draws_follow_the_distribution():
    from fraudlake.functions.hashrand import _poisson_quantile
    for lam in (0.5, 49.0, 51.0, 599.0, 601.0, 1e5):
        u = (np.arange(4001) + 0.5) / 4001
        k = _poisson_quantile(np.full(len(u), lam), u)
        assert (np.diff(k) >= 0).all()
        assert abs(k.mean() - lam) < 0.02 * lam ** 0.5 + 0.01 and abs(k.var() / lam - 1) < 0.02


def brute_bootstrap(rows, n_boot, seed):
    """Every replicate on its own: md5 uniforms, Poisson CDF from factorials, scores in turn."""
    import hashlib
    from math import exp, factorial

    out = []
    for rep in range(n_boot):
        drawn = collections.defaultdict(lambda: [0, 0])
        for (score, label), n in sorted(collections.Counter(rows).items()):
            bits = int(hashlib.md5(f"{round(score * 1e12)}:{label}:{rep}:{seed}".encode()).hexdigest()[:8], 16)
            u, k, cdf = (bits + 0.5) / 2 ** 32, 0, exp(-n)
            while cdf < u:
                k += 1
                cdf += exp(-n) * n ** k / factorial(k)
            drawn[score][1 - label] += k
        cp = cn = ap = pairs = 0
        for score in sorted(drawn, reverse=True):
            pos, neg = drawn[score]
            cp, cn = cp + pos, cn + neg
            ap += pos * cp / (cp + cn) if pos else 0
            pairs += neg * (cp - 0.5 * pos)
        if cp and cn:
            out.append((ap / cp, pairs / cp / cn))
    return out


@pytest.mark.parametrize("scores_per_task", [10_000, 7])
def test_bootstrap_against_single_replicates(spark, scores_per_task):
    rng = np.random.default_rng(4)
    rows = [(float(round(s, 2)), int(rng.random() < s)) for s in rng.random(300)]
    rows += [(0.5, 1)] * 40 + [(0.5, 0)] * 7                      # a hot score
    df = spark.createDataFrame([*rows, (None, 1), (0.3, None)], "score double, label int")
    got = M.bootstrap_ci(df, n_boot=70, seed=5, scores_per_task=scores_per_task).first()
    want = brute_bootstrap(rows, 70, 5)
    ap, auc = np.array(want).T
    assert got.n_valid == len(want) == 70
    assert np.allclose(list(got)[1:], [*np.quantile(ap, [0.025, 0.975]), *np.quantile(auc, [0.025, 0.975])])


def test_bootstrap_of_one_class_or_nothing(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 1)], "score double, label int")
    for d in (df, df.limit(0)):
        assert tuple(M.bootstrap_ci(d, n_boot=10).first()) == (0, None, None, None, None)


def test_bootstrap_rows_are_not_replicated(spark):
    """Groups are copied once per block of replicates, not once per replicate."""
    sc = fx.lineitem_scores(spark, SF_SMALL)
    plan = M.bootstrap_ci(sc, n_boot=1000, scores_per_task=50)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan and ",31]" not in plan and ",999]" not in plan
