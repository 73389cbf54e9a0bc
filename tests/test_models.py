"""Federated rounds, explanations and streaming against their batch twins."""

import os

import numpy as np
from pyspark.sql import functions as F

from fraudlake.functions.vectorized import sampled_shapley_batch
from fraudlake.operators import monitor as MO
from fraudlake.plans import q_explain, q_rounds
from fraudlake.session import scratch_path
from fraudlake.sources import fixtures as fx
from fraudlake.streaming import streams as S

from conftest import SF_SMALL


def test_federated_loss_falls(spark):
    from fraudlake.operators import rounds as R
    feats = q_rounds.features(spark, SF_SMALL)
    out = R.federated_linear(spark, feats, q_rounds.DIM, rounds=5, local_steps=2, lr=2.0, mu=0.01)
    g = [r["train_loss"] for r in out.where("client_id = 'global'").orderBy("round").collect()]
    assert all(a > b for a, b in zip(g, g[1:]))


def test_linear_attributions_add_up(spark):
    a = q_explain.attributed(spark, SF_SMALL)
    bad = a.where(F.abs(F.aggregate("contributions", F.lit(0.0), lambda s, v: s + v)
                        + F.col("base_value") - F.col("logit")) > 1e-9).count()
    assert bad == 0


def test_sampled_shapley_efficiency():
    rng = np.random.default_rng(0)
    x, bg = rng.normal(size=(20, 4)), rng.normal(size=(10, 4))
    w, b = [0.5, -1.0, 2.0, 0.1], 0.3
    phi, base, pred = sampled_shapley_batch(np.arange(20), x, bg, w, b, 16, 1)
    assert np.allclose(phi.sum(axis=1) + base, pred, atol=1e-12)
    phi2, _, _ = sampled_shapley_batch(np.arange(20)[5:], x[5:], bg, w, b, 16, 1)
    assert np.allclose(phi[5:], phi2)   # independent of batching


def test_stream_equals_batch_twin(spark):
    out = S.stream_window_metrics(spark, os.path.join(SF_SMALL, "events.parquet"),
                                  scratch_path(spark, "t-m17"))
    twin = S.batch_twin(fx.metric_events(spark, SF_SMALL))
    assert out.count() == twin.count() > 0
    assert out.exceptAll(twin).count() == 0


def test_stream_alert_equals_batch(spark):
    a = S.stream_alert_for(spark, os.path.join(SF_SMALL, "events.parquet"),
                           scratch_path(spark, "t-m9"), 20.0, 600)
    b = MO.alert_for(fx.metric_events(spark, SF_SMALL), F.col("value") > 20.0, 600).select(
        "client_id", F.col("ts").cast("timestamp").alias("ts"), "seq",
        F.col("pending_since").cast("timestamp").alias("pending_since"))
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0


def test_counter_reset_recovers_increments(spark):
    from fraudlake.plans.q_monitor import cumulative_series
    inc = MO.increments_from_cumulative(cumulative_series(spark, SF_SMALL), ["client_id"])
    ev = fx.metric_events(spark, SF_SMALL).select("seq", F.col("value").alias("orig"))
    bad = inc.join(ev, "seq").where(F.abs(F.col("increment") - F.col("orig")) > 1e-6).count()
    assert bad == 0


def test_stream_quarantine_across_batches(spark):
    """Two arriving files (second holds later lines): keys first seen in the
    first batch are duplicates in the second; totals equal the batch rule."""
    from fraudlake.plans.q_ingest import reasons
    import tempfile
    base = tempfile.mkdtemp(prefix="fraudlake-m18-")
    src = os.path.join(base, "in")
    orders = fx.read(spark, SF_SMALL, "orders")
    cut = orders.approxQuantile("o_orderkey", [0.5], 0.0)[0]
    orders.where(F.col("o_orderkey") <= cut).coalesce(1).write.parquet(os.path.join(src, "a"))
    orders.where(F.col("o_orderkey") > cut).coalesce(1).write.parquet(os.path.join(src, "b"))
    files = sorted(os.path.join(src, d, f) for d in ("a", "b")
                   for f in os.listdir(os.path.join(src, d)) if f.endswith(".parquet"))
    stage = os.path.join(base, "stage")
    os.makedirs(stage)
    for i, f in enumerate(files):
        os.link(f, os.path.join(stage, f"part-{i}.parquet"))
    out = S.stream_quarantine(spark, stage, os.path.join(base, "run"), max_files=1)
    got = {(r["table"], r["reason"]): r["records"] for r in out.collect()}
    exp = {("good" if r[0] is None else "quarantine", r[0]): r[1] for r in
           reasons(spark, SF_SMALL).groupBy("reject_reason").count().collect()}
    assert got == exp


def test_federated_rounds_match_numpy(spark):
    """The distributed FedProx rounds equal a direct numpy run on the same rows."""
    from fraudlake.operators import rounds as R
    feats = q_rounds.features(spark, SF_SMALL)
    got = R.federated_linear(spark, feats, q_rounds.DIM, rounds=3, local_steps=2, lr=2.0, mu=0.01)
    pdf = feats.toPandas()
    clients = sorted(pdf.bank_id.unique())
    gw, gb = np.zeros(q_rounds.DIM), 0.0
    for rnd in range(1, 4):
        local, sizes = {}, {}
        for c in clients:
            part = pdf[pdf.bank_id == c]
            x = np.stack(part.x.to_numpy())
            y = part.label.to_numpy().astype(float)
            w, b = gw.copy(), gb
            for _ in range(2):
                p = 1 / (1 + np.exp(-(x @ w + b)))
                w, b = (w - 2.0 * ((p - y) @ x / len(y) + 0.01 * (w - gw)),
                        b - 2.0 * ((p - y).sum() / len(y) + 0.01 * (b - gb)))
            local[c], sizes[c] = (w, b), len(y)
        n = sum(sizes.values())
        gw = sum(sizes[c] * local[c][0] for c in clients) / n
        gb = sum(sizes[c] * local[c][1] for c in clients) / n
        row = got.where((F.col("round") == rnd) & (F.col("client_id") == "global")).first()
        assert np.allclose(row["w"], gw, atol=1e-9) and abs(row["b"] - gb) < 1e-9


def test_sampled_attributions_brute_force(spark):
    """mapInPandas output equals the numpy routine applied to all rows at once."""
    f = q_explain.feats(spark, SF_SMALL)
    bg = [list(r["x"]) for r in q_explain.P.background_sample(
        f.where(F.col("split") == "train"), 100).select("x").collect()]
    test = f.where(F.col("split") == "test")
    from fraudlake.functions.vectorized import attribute_sampled
    got = {r["TransactionID"]: r for r in attribute_sampled(test, bg, q_rounds.SCORE_W,
                                                               q_rounds.SCORE_B).collect()}
    pdf = test.select("TransactionID", "x").toPandas()
    phi, base, pred = sampled_shapley_batch(pdf.TransactionID.to_numpy(), np.stack(pdf.x.to_numpy()),
                                            np.asarray(bg), q_rounds.SCORE_W, q_rounds.SCORE_B, 32, 11)
    for i, tid in enumerate(pdf.TransactionID):
        r = got[tid]
        assert np.allclose(r["contributions"], phi[i], atol=1e-12)
        assert abs(r["base_value"] - base[i]) < 1e-12 and abs(r["prediction"] - pred[i]) < 1e-12


def test_federated_run_resumes_from_saved_rounds(spark):
    """A run stopped after round 2 and restarted continues to the same model."""
    import tempfile
    from fraudlake.operators import rounds as R
    feats = q_rounds.features(spark, SF_SMALL)
    path = os.path.join(tempfile.mkdtemp(prefix="fraudlake-fed-"), "state")
    R.federated_linear(spark, feats, q_rounds.DIM, rounds=2, local_steps=1, lr=2.0,
                       state_path=path, checkpoint_every=1)
    resumed = R.federated_linear(spark, feats, q_rounds.DIM, rounds=4, local_steps=1, lr=2.0,
                                 state_path=path, checkpoint_every=1)
    fresh = R.federated_linear(spark, feats, q_rounds.DIM, rounds=4, local_steps=1, lr=2.0)
    a = resumed.where("client_id = 'global' and round = 4").first()
    b = fresh.where("client_id = 'global' and round = 4").first()
    assert np.allclose(a["w"], b["w"], atol=1e-12) and abs(a["b"] - b["b"]) < 1e-12
    assert resumed.count() == fresh.count()


def test_stream_alert_state_carries_across_batches(spark):
    """Events arriving in two time-ordered files give the batch rule's alerts:
    pending runs carry over the batch boundary in the state store."""
    import tempfile
    d = tempfile.mkdtemp(prefix="fraudlake-m9-")
    ev = fx.read(spark, SF_SMALL, "events")
    cut = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    ev.where(F.col("ts") < cut).coalesce(1).write.parquet(os.path.join(d, "a"))
    ev.where(F.col("ts") >= cut).coalesce(1).write.parquet(os.path.join(d, "b"))
    stage = os.path.join(d, "stage")
    os.makedirs(stage)
    for i, sub in enumerate(("a", "b")):
        f = [x for x in os.listdir(os.path.join(d, sub)) if x.endswith(".parquet")][0]
        os.link(os.path.join(d, sub, f), os.path.join(stage, f"part-{i}.parquet"))
    a = S.stream_alert_for(spark, stage, os.path.join(d, "run"), 20.0, 600, max_files=1)
    b = MO.alert_for(fx.metric_events(spark, SF_SMALL), F.col("value") > 20.0, 600).select(
        "client_id", F.col("ts").cast("timestamp").alias("ts"), "seq",
        F.col("pending_since").cast("timestamp").alias("pending_since"))
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0
