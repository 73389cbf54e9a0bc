"""Registered queries: feature arrays, class weights, resampling, batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraudlake.operators import prepare as P
from fraudlake.plans.q_prepare import PREP_SQL, TXI, prepared
from fraudlake.plans.q_split import SPLIT_SQL, TX, splitted
from fraudlake.plans.registry import register

CAT = ["ProductCD", "card4", "card1"]
NUM = ["TransactionDT", "TransactionAmt", "card2", "addr2"]

WEIGHTS_SQL = SPLIT_SQL + """,
cw as (select bank_id, count(*) as n, count(*) filter (where isFraud = 0) as n_0,
   count(*) filter (where isFraud = 1) as n_1 from splitted group by bank_id),
w as (select *, case when n_0 > 0 then n / (2.0 * n_0) else 1.0 end as weight_0,
   case when n_1 > 0 then n / (2.0 * n_1) else 1.0 end as weight_1 from cw)"""


def _md5_bits(key: str, chars: int, seed: int = 42) -> str:
    return f"('0x' || substr(md5(cast({key} as varchar) || ':' || '{seed}'), 1, {chars}))::bigint"


@register("assemble", "D3", views=TXI, sql=PREP_SQL + """
select TransactionID, bank_id, split,
  [cast(ProductCD as bigint), cast(card4 as bigint), cast(card1 as bigint)] as categorical,
  list_transform([cast(TransactionDT as double), TransactionAmt, card2, addr2],
                 lambda x: round(x, 6)) as numerical,
  coalesce(cast(isFraud as double), 0.0) as target from enc""")
def q_assemble(spark, sf_dir):
    """D3: categorical code array, numeric array (rounded for comparison), target."""
    a = P.assemble(prepared(spark, sf_dir), CAT, NUM)
    return a.withColumn("numerical", F.transform("numerical", lambda x: F.round(x, 6)))


@register("class_weights", "D8", views=TX, rounded={"weight_0": 9, "weight_1": 9, "pos_weight": 9},
          sql=WEIGHTS_SQL + """
select bank_id, n, n_0, n_1, weight_0, weight_1, weight_1 / weight_0 as pos_weight from w""")
def q_class_weights(spark, sf_dir):
    """N / (2 n_c) per bank and class."""
    return P.class_weights(splitted(spark, sf_dir))


@register("pos_weight", "D9", views=TX, rounded={"pos_weight": 9}, sql=WEIGHTS_SQL + """
select bank_id, weight_1 / weight_0 as pos_weight from w""")
def q_pos_weight(spark, sf_dir):
    """w1 / w0 (= n0 / n1) per bank."""
    return P.class_weights(splitted(spark, sf_dir)).select("bank_id", "pos_weight")


@register("row_weights", "D10", views=TX, rounded={"sample_weight": 9}, sql=WEIGHTS_SQL + """
select s.TransactionID, case when s.isFraud = 1 then w.weight_1 else w.weight_0 end
  as sample_weight from splitted s join w on s.bank_id = w.bank_id""")
def q_row_weights(spark, sf_dir):
    """Class weight on every row (broadcast of the per-bank table)."""
    s = splitted(spark, sf_dir)
    return P.row_weights(s, P.class_weights(s)).select("TransactionID", "sample_weight")


@register("balanced_resample", "D11", views=TX, sql=WEIGHTS_SQL + f""",
lam as (select bank_id, 0 as cls, weight_0 * n / (n_0 * weight_0 + n_1 * weight_1) as lam from w
   union all select bank_id, 1, weight_1 * n / (n_0 * weight_0 + n_1 * weight_1) from w),
ks as (select bank_id, cls, lam,
     unnest(range(0, cast(ceil(lam + 12.0 * sqrt(lam) + 12.0) as bigint) + 1)) as k from lam),
cdf as (select bank_id, cls, k, sum(exp(k * ln(lam) - lam - lgamma(k + 1))) over (
     partition by bank_id, cls order by k rows between unbounded preceding and current row) as c
   from ks),
u as (select TransactionID, bank_id, isFraud,
     ({_md5_bits('TransactionID', 8)} + 0.5) / 4294967296.0 as u from splitted),
d as (select u.TransactionID, u.bank_id, count(*) as draws from u join cdf
     on cdf.bank_id = u.bank_id and cdf.cls = u.isFraud and cdf.c < u.u
   group by u.TransactionID, u.bank_id)
select TransactionID, bank_id, unnest(range(1, draws + 1)) as copy from d""")
def q_balanced_resample(spark, sf_dir):
    """Poisson class-balanced resampling with md5 uniforms."""
    return P.balanced_resample(splitted(spark, sf_dir)).select(
        "TransactionID", "bank_id", F.col("copy").cast("long").alias("copy"))


@register("minibatch_ids", "D12", views=TX, sql=SPLIT_SQL + f""",
h as (select TransactionID, bank_id, {_md5_bits('TransactionID', 15)} as h from splitted),
r as (select *, row_number() over (partition by bank_id order by h, TransactionID) - 1 as rk,
   count(*) over (partition by bank_id) as n from h)
select TransactionID, bank_id, cast(floor(rk / 256) as bigint) as batch_id from r
where floor(rk / 256) < floor(n / 256)""")
def q_minibatch_ids(spark, sf_dir):
    """Hash-shuffled batches of 256 per bank, incomplete last batch dropped."""
    return P.minibatch_ids(splitted(spark, sf_dir), 256).select(
        "TransactionID", "bank_id", "batch_id")


@register("background_sample", "D13", views=TX, sql=SPLIT_SQL + f"""
select TransactionID, bank_id from splitted
order by {_md5_bits('TransactionID', 15)}, TransactionID limit 100""")
def q_background_sample(spark, sf_dir):
    """100 background rows in hash order (top-n, no full sort)."""
    return P.background_sample(splitted(spark, sf_dir), 100).select("TransactionID", "bank_id")


@register("embedding_dims", "D14", views=TXI, sql=PREP_SQL + "\n" + "\nunion all\n".join(
    f"select '{c}' as column_name, max(cast({c} as bigint)) + 1 as vocab, "
    f"cast(least(50, greatest(1, floor((max(cast({c} as bigint)) + 1) / 2))) as bigint) as dim "
    f"from enc" for c in CAT))
def q_embedding_dims(spark, sf_dir):
    """Vocabulary size and embedding width per categorical column."""
    return P.embedding_dims(prepared(spark, sf_dir), CAT)


@register("dataset_info", "D15", views=TXI, rounded={"fraud_rate": 9}, sql=PREP_SQL + f"""
select bank_id, {len(CAT)} as n_categorical, {len(NUM)} as n_numerical, count(*) as samples,
  avg(cast(isFraud as double)) as fraud_rate, count(*) filter (where isFraud = 0) as class_0,
  count(*) filter (where isFraud = 1) as class_1 from enc group by bank_id""")
def q_dataset_info(spark, sf_dir):
    """Feature counts, samples, fraud rate and class counts per bank."""
    return P.dataset_info(prepared(spark, sf_dir), CAT, NUM)
