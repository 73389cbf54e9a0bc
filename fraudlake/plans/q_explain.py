"""Registered queries: explanations, top-k, audit rows, subsets."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fraudlake.functions.vectorized import attribute_exact, attribute_sampled
from fraudlake.operators import explain as X
from fraudlake.operators import prepare as P
from fraudlake.plans.q_rounds import FEATURE_NAMES, FEATURES, SCORE_B, SCORE_W, logit_sql, x_sql
from fraudlake.plans.q_split import BANKS_SQL, SPLIT_SQL, TX, banked, splitted
from fraudlake.plans.registry import register
from fraudlake.session import scratch_path
from fraudlake.sources import fixtures as fx

AUDIT_TS = "2026-01-01 00:00:00"
AUDIT_USER = "auditor"
MODEL_TYPE = "logistic_regression"
D = len(FEATURES)
BACKGROUND = 50


def feats(spark, sf_dir):
    s = splitted(spark, sf_dir)
    return s.select("TransactionID", "bank_id", "split", F.col("isFraud").alias("label"),
                    F.array(*[F.expr(e).cast("double") for _, e in FEATURES]).alias("x"))


def attributed(spark, sf_dir):
    f = feats(spark, sf_dir)
    # the mean over all train rows is one aggregate
    mu = X.background_mean(f.where(F.col("split") == "train"), D)
    return X.attribute_linear(f, SCORE_W, SCORE_B, mu)


def explained(spark, sf_dir):
    return X.explain_rows(attributed(spark, sf_dir), FEATURE_NAMES, 10)


def _h(key: str) -> str:
    return f"('0x' || substr(md5(cast({key} as varchar) || ':' || '42'), 1, 15))::bigint"


_CONTRIB = "[" + ", ".join(f"(x[{i + 1}] - m{i}) * {w!r}" for i, w in enumerate(SCORE_W)) + "]"
_BASE = f"({SCORE_B!r} + (" + "0.0" + "".join(
    f" + {w!r} * m{i}" for i, w in enumerate(SCORE_W)) + "))"
_NAMES = "(values " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(FEATURE_NAMES)) + \
    ") nm(pos, feature)"

ATTR_SQL = SPLIT_SQL + f""",
feats as (select TransactionID, bank_id, split, isFraud as label, {x_sql()} as x,
   {logit_sql(SCORE_W, SCORE_B)} as logit, {_h('TransactionID')} as h from splitted),
bg as (select x from feats where split = 'train'),
mu as (select {', '.join(f'avg(x[{i + 1}]) as m{i}' for i in range(D))} from bg),
attr as (select f.TransactionID, f.split, f.x, f.logit, {_CONTRIB} as contributions,
   {_BASE} as base_value from feats f, mu),
ex as (select TransactionID, split, unnest(contributions) as c,
   unnest(range(0, {D})) as pos from attr),
ranked as (select ex.*, nm.feature from ex join {_NAMES} on ex.pos = nm.pos),
tops as (select TransactionID, string_agg(feature, ',' order by abs(c) desc, pos) as top10
   from ranked group by TransactionID),
expl as (select a.TransactionID, a.split, a.base_value, 1.0 / (1.0 + exp(-a.logit)) as prediction,
   cast(1.0 / (1.0 + exp(-a.logit)) > 0.5 as int) as predicted_class,
   greatest(1.0 / (1.0 + exp(-a.logit)), 1.0 - 1.0 / (1.0 + exp(-a.logit))) as confidence,
   t.top10 as top_features from attr a join tops t on a.TransactionID = t.TransactionID)"""


def _top5_sql() -> str:
    return "array_to_string(list_slice(string_split(top_features, ','), 1, 5), ',')"


@register("attribute_linear", "X1", views=TX, rounded={"base_value": 9, "logit": 9}, sql=ATTR_SQL + """
select TransactionID, base_value, logit,
  list_transform(contributions, lambda v: round(v, 9)) as contributions from attr""")
def q_attribute_linear(spark, sf_dir):
    """Exact linear attributions against the background mean; sum + base = logit."""
    a = attributed(spark, sf_dir)
    return a.select("TransactionID", "base_value", "logit",
                    F.transform("contributions", lambda v: F.round(v, 9)).alias("contributions"))


@register("attribute_sampled", "X2")
def q_attribute_sampled(spark, sf_dir):
    """Sampled Shapley values of the probability (32 permutations, Arrow batches)."""
    f = feats(spark, sf_dir)
    bg_rows = P.background_sample(f.where(F.col("split") == "train"), 100).select("x").collect()
    bg = [list(r["x"]) for r in bg_rows]
    return attribute_sampled(f, bg, SCORE_W, SCORE_B)


def _exact_sql() -> str:
    """Values of all 64 subsets over 50 background rows, then the weighted differences."""
    own = " + ".join(f"((m >> {i}) & 1) * {w!r} * x[{i + 1}]" for i, w in enumerate(SCORE_W))
    rest = " + ".join(f"(1 - ((m >> {i}) & 1)) * {w!r} * x[{i + 1}]" for i, w in enumerate(SCORE_W))
    phi = ", ".join(
        f"round(sum(case when (m >> {j}) & 1 = 0 then -v else v end * case bit_count(m & {(1 << D) - 1 - (1 << j)}) "
        + " ".join(f"when {k} then {math.factorial(k) * math.factorial(D - 1 - k) / math.factorial(D)!r}"
                   for k in range(D)) + " end), 9)" for j in range(D))
    return SPLIT_SQL + f""",
f as (select TransactionID, split, {x_sql()} as x from splitted),
bg as (select x from f where split = 'train' order by {_h('TransactionID')}, TransactionID limit {BACKGROUND}),
masks as (select unnest(range(0, {1 << D})) as m),
own as (select TransactionID, m, {own} as z from f, masks),
rest as (select m, {rest} + {SCORE_B!r} as z from bg, masks),
vals as (select TransactionID, o.m, avg(1.0 / (1.0 + exp(-(o.z + r.z)))) as v
   from own o join rest r on o.m = r.m group by TransactionID, o.m)
select TransactionID, max(v) filter (where m = {(1 << D) - 1}) as prediction,
  max(v) filter (where m = 0) as base_value, [{phi}] as contributions from vals group by TransactionID"""


@register("attribute_exact", "X2", views=TX, rounded={"prediction": 9, "base_value": 9}, sql=_exact_sql())
def q_attribute_exact(spark, sf_dir):
    """Enumerated Shapley values of the probability against 50 background rows."""
    f = feats(spark, sf_dir)
    bg = [list(r["x"]) for r in P.background_sample(f.where(F.col("split") == "train"), BACKGROUND).select("x").collect()]
    a = attribute_exact(f, bg, SCORE_W, SCORE_B)
    return a.withColumn("contributions", F.transform("contributions", lambda v: F.round(v, 9)))


@register("topk_features", "T2", views=TX, sql=ATTR_SQL + """
select TransactionID, top_features from expl""")
def q_topk_features(spark, sf_dir):
    """Top 10 features by |contribution| per row (ties keep feature order)."""
    e = explained(spark, sf_dir)
    return e.select("TransactionID", X.feature_names(F.col("top_features")).alias("top_features"))


@register("audit_top5", "T3", views=TX, sql=ATTR_SQL + f"""
select TransactionID, {_top5_sql()} as top5 from expl""")
def q_audit_top5(spark, sf_dir):
    """First 5 of the top list."""
    e = explained(spark, sf_dir)
    return e.select("TransactionID",
                    X.feature_names(F.slice("top_features", 1, 5)).alias("top5"))


@register("explain_rows", "X3", views=TX,
          rounded={"prediction": 9, "confidence": 9, "base_value": 9}, sql=ATTR_SQL + """
select TransactionID, prediction, predicted_class, confidence, top_features, base_value
from expl""")
def q_explain_rows(spark, sf_dir):
    """Prediction, class, confidence, top features, base value per test row."""
    e = explained(spark, sf_dir)
    return e.select("TransactionID", "prediction", "predicted_class", "confidence",
                    X.feature_names(F.col("top_features")).alias("top_features"), "base_value")


IMPORTANCE_SQL = ATTR_SQL + """,
imp as (select feature, avg(abs(c)) as importance from ranked group by feature)"""


@register("global_importance", "X4", views=TX, rounded={"importance": 9},
          sql=IMPORTANCE_SQL + "\nselect feature, importance from imp")
def q_global_importance(spark, sf_dir):
    """Mean |contribution| per feature over all rows."""
    return X.global_importance(attributed(spark, sf_dir), FEATURE_NAMES)


@register("global_top10", "T4", views=TX, rounded={"importance": 9}, sql=IMPORTANCE_SQL + """
select feature, importance from imp order by importance desc, feature limit 10""")
def q_global_top10(spark, sf_dir):
    """T4: the 10 most important features overall."""
    return X.global_top(X.global_importance(attributed(spark, sf_dir), FEATURE_NAMES), 10)


@register("explain_summary", "X5", views=TX,
          rounded={"fraud_rate": 9, "mean_prediction": 9, "avg_importance": 9},
          sql=ATTR_SQL + """,
tot as (select count(*) as n_explanations, avg(cast(predicted_class as double)) as fraud_rate,
   avg(prediction) as mean_prediction from expl)
select r.feature, t.n_explanations, t.fraud_rate, t.mean_prediction,
  sum(abs(r.c)) / t.n_explanations as avg_importance
from ranked r, tot t where true
group by r.feature, t.n_explanations, t.fraud_rate, t.mean_prediction""")
def q_explain_summary(spark, sf_dir):
    """Explanation counts, fraud rate, mean prediction, per-feature average."""
    return X.explain_summary(explained(spark, sf_dir))


@register("audit_trail", "X6", views=TX, rounded={"prediction": 9, "confidence": 9},
          sql=ATTR_SQL + f"""
select TransactionID as transaction_id, timestamp '{AUDIT_TS}' as ts, '{AUDIT_USER}' as user,
  prediction, predicted_class, confidence, {_top5_sql()} as top_features,
  '{MODEL_TYPE}' as model_type from expl""")
def q_audit_trail(spark, sf_dir):
    """Audit rows appended to a date-partitioned table and read back."""
    rows = X.audit_trail(explained(spark, sf_dir), "TransactionID", AUDIT_TS, AUDIT_USER,
                         MODEL_TYPE)
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    path = scratch_path(spark, "audit")
    rows.withColumn("date", F.to_date("ts")).write.mode("append").partitionBy("date").parquet(path)
    return spark.read.parquet(path).drop("date")


@register("explanation_complete", "B12", views=TX, sql=ATTR_SQL + """,
damaged as (select TransactionID as transaction_id,
  case when TransactionID % 7 = 0 then null else prediction end as prediction,
  predicted_class as prediction_class,
  case when TransactionID % 11 = 0 then null else confidence end as confidence,
  top_features, case when TransactionID % 7 = 0 then null else base_value end as all_shap_values
  from expl),
missing as (select transaction_id, concat_ws(',',
  case when prediction is null then 'prediction' end,
  case when prediction_class is null then 'prediction_class' end,
  case when confidence is null then 'confidence' end,
  case when top_features is null then 'top_features' end,
  case when all_shap_values is null then 'all_shap_values' end) as missing_fields from damaged)
select transaction_id, missing_fields, missing_fields = '' as complete from missing""")
def q_explanation_complete(spark, sf_dir):
    """Which required fields explanations lack (some fields are blanked by id)."""
    i = F.col("TransactionID")
    e = explained(spark, sf_dir)
    e = e.select(i.alias("transaction_id"), F.when(i % 7 != 0, F.col("prediction")).alias("prediction"),
                 F.col("predicted_class").alias("prediction_class"),
                 F.when(i % 11 != 0, F.col("confidence")).alias("confidence"), "top_features",
                 F.when(i % 7 != 0, F.col("base_value")).alias("all_shap_values"))
    return X.explanation_complete(e).select("transaction_id", "missing_fields", "complete")


@register("subset", "T5", views=TX, sql="""
select TransactionID, isFraud from transactions order by TransactionID limit 1000""")
def q_subset(spark, sf_dir):
    """T5: the first 1000 transactions by key (a top-n)."""
    return fx.transactions(spark, sf_dir).select("TransactionID", "isFraud") \
        .orderBy("TransactionID").limit(1000)


@register("union_missing", "U1", views=TX, sql=BANKS_SQL + """
select TransactionID, bank_id from banked""")
def q_union_missing(spark, sf_dir):
    """Per-bank tables (coded rows and the null-code share) combined by name."""
    b = banked(spark, sf_dir).select("TransactionID", "bank_id", "ProductCD")
    coded = b.where(F.col("ProductCD").isNotNull())
    missing = b.where(F.col("ProductCD").isNull())
    return X.union_banks([coded, missing]).select("TransactionID", "bank_id")
