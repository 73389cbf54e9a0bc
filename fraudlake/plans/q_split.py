"""Registered queries: bank partition, temporal split, per-bank evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraudlake.operators import metrics as M
from fraudlake.operators import prepare as P
from fraudlake.plans.registry import dbl, register
from fraudlake.sources import fixtures as fx

# --- shared oracle fragments --------------------------------------------------------

TX = ("transactions",)

def banks_sql(src: str = "transactions") -> str:
    """D4 in SQL over view ``src`` -> CTE ``banked``."""
    return f"""
codes as (select ProductCD, min(TransactionID) as first_seen from {src}
          where ProductCD is not null group by ProductCD),
code_bank as (select ProductCD,
   'bank_' || cast((row_number() over (order by first_seen, ProductCD) - 1) % 3 + 1 as varchar)
   as bank_id from codes),
null_bank as (select TransactionID, 'bank_' || cast(ntile(3) over (order by TransactionID) as varchar)
   as bank_id from {src} where ProductCD is null),
banked as (select t.*, coalesce(cb.bank_id, nb.bank_id) as bank_id
   from {src} t left join code_bank cb on t.ProductCD = cb.ProductCD
   left join null_bank nb on t.TransactionID = nb.TransactionID)"""


def split_sql(src: str = "transactions") -> str:
    """D4 + D6 in SQL over view ``src`` -> CTE ``splitted``."""
    return banks_sql(src) + f""",
ordered as (select *, row_number() over (partition by bank_id
     order by TransactionDT asc nulls last, TransactionID) - 1 as pos,
   count(*) over (partition by bank_id) as n from banked),
splitted as (select * exclude (pos, n), case
     when pos < floor(n * {dbl(0.8)}) then 'train'
     when pos < floor(n * {dbl(0.8 + 0.1)}) then 'val' else 'test' end as split from ordered)"""


BANKS_SQL = banks_sql()
SPLIT_SQL = split_sql()


def banked(spark, sf_dir):
    return P.bank_partition(fx.transactions(spark, sf_dir))


def splitted(spark, sf_dir):
    return P.temporal_split(banked(spark, sf_dir))


@register("bank_partition", "D4", views=TX, sql=BANKS_SQL + """
select TransactionID, ProductCD, bank_id from banked""")
def q_bank_partition(spark, sf_dir):
    """Bank per transaction (codes in first-seen order, null codes array-split)."""
    return banked(spark, sf_dir).select("TransactionID", "ProductCD", "bank_id")


@register("partition_stats", "D5", views=TX, rounded={"fraud_rate": 9}, sql=BANKS_SQL + """
select b.bank_id, coalesce(s.total_records, 0) as total_records,
  coalesce(s.fraud_records, 0) as fraud_records,
  coalesce(s.fraud_records * 100.0 / s.total_records, 0.0) as fraud_rate,
  coalesce(s.assigned_products, '') as assigned_products
from (select 'bank_' || cast(i as varchar) as bank_id from range(1, 4) r(i)) b
left join (select bank_id, cast(sum(n) as bigint) as total_records, cast(sum(f) as bigint) as fraud_records,
     coalesce(string_agg(ProductCD, ',' order by first_id), '') as assigned_products
   from (select bank_id, ProductCD, count(*) as n, sum(isFraud) as f,
           min(TransactionID) as first_id from banked group by bank_id, ProductCD)
   group by bank_id) s on b.bank_id = s.bank_id""")
def q_partition_stats(spark, sf_dir):
    """Per-bank sizes, fraud counts and assigned codes (empty banks reported)."""
    return P.partition_stats(banked(spark, sf_dir))


@register("temporal_split", "D6", views=TX, sql=SPLIT_SQL + """
select TransactionID, bank_id, split from splitted""")
def q_temporal_split(spark, sf_dir):
    """Exact 80/10/10 time-ordered split per bank without a global sort."""
    return splitted(spark, sf_dir).select("TransactionID", "bank_id", "split")


_ODD_TIME = ("case when TransactionID % 13 = 0 then null "
             "else floor(TransactionDT / 86400) + (TransactionID % 4) / cast(8 as double) end")


@register("sort_time", "T1", views=TX, sql=f"""
odd as (select TransactionID, {_ODD_TIME} as t from transactions)
select TransactionID, t, row_number() over (order by t asc nulls last, TransactionID) - 1 as position from odd""")
def q_sort_time(spark, sf_dir):
    """Transactions in time order with their position; times have fractions, ties and nulls."""
    odd = fx.transactions(spark, sf_dir).select("TransactionID", F.expr(_ODD_TIME).alias("t"))
    return P.sort_time(odd, "t", "TransactionID")


@register("temporal_split_odd_times", "D6", views=TX, sql=f"""
odd as (select TransactionID, {_ODD_TIME} as t, TransactionID % 3 as g from transactions),
r as (select *, row_number() over (partition by g order by t asc nulls last, TransactionID) - 1 as rk,
   count(*) over (partition by g) as n from odd)
select TransactionID, case when rk < floor(n * {dbl(0.8)}) then 'train'
   when rk < floor(n * {dbl(0.8 + 0.1)}) then 'val' else 'test' end as split from r""")
def q_temporal_split_odd_times(spark, sf_dir):
    """D6 on times with fractions, ties and nulls."""
    odd = fx.transactions(spark, sf_dir).select(
        "TransactionID", F.expr(_ODD_TIME).alias("t"), (F.col("TransactionID") % 3).alias("g"))
    return P.temporal_split(odd, time_col="t", group_col="g").select("TransactionID", "split")


@register("split_stats", "D7", views=TX, rounded={"ratio_actual": 9, "fraud_rate": 9}, sql=SPLIT_SQL + """
, per as (select bank_id, split, count(*) as records, sum(isFraud) as fraud
   from splitted group by bank_id, split)
select bank_id, split, records,
  cast(records as double) / sum(records) over (partition by bank_id) as ratio_actual,
  fraud * 100.0 / records as fraud_rate from per""")
def q_split_stats(spark, sf_dir):
    """Split sizes, actual ratios, fraud % per split."""
    return P.split_stats(splitted(spark, sf_dir))


PER_BANK_CTE = SPLIT_SQL + """,
test as (select bank_id, score, isFraud as label,
   ln(least(greatest(score, 1e-7), 1 - 1e-7) / (1 - least(greatest(score, 1e-7), 1 - 1e-7))) as x
   from splitted where split = 'test'),
sg as (select bank_id, score, sum(label) as pos, count(*) - sum(label) as neg from test
   group by bank_id, score),
cum as (select *, sum(pos) over w as cp, sum(neg) over w as cn from sg
   window w as (partition by bank_id order by score desc
                rows between unbounded preceding and current row)),
rk as (select bank_id, cast(sum(pos) as bigint) as n_pos, cast(sum(neg) as bigint) as n_neg,
   case when sum(pos) > 0 then sum(case when pos > 0 then pos * cp / (cp + cn) else 0 end)
        / sum(pos) end as average_precision,
   case when sum(pos) > 0 and sum(neg) > 0 then sum(neg * (cp - 0.5 * pos))
        / (cast(sum(pos) as double) * sum(neg)) end as auroc
   from cum group by bank_id),
cf as (select bank_id, count(*) filter (where score > 0.5 and label = 1) as tp,
   count(*) filter (where score > 0.5 and label <> 1) as fp,
   count(*) filter (where score <= 0.5 and label = 1) as fn,
   avg(greatest(x, 0) - x * label + ln(1 + exp(-abs(x)))) as bce_loss from test group by bank_id),
cf2 as (select bank_id, bce_loss,
   coalesce(tp / nullif(cast(tp + fp as double), 0), 0) as precision,
   coalesce(tp / nullif(cast(tp + fn as double), 0), 0) as recall from cf),
per as (select rk.*, cf2.precision, cf2.recall,
   coalesce(2 * cf2.precision * cf2.recall / nullif(cf2.precision + cf2.recall, 0), 0) as f1,
   cf2.bce_loss from rk join cf2 on rk.bank_id = cf2.bank_id)"""

PER_BANK_SQL = PER_BANK_CTE + """
select bank_id, n_pos, n_neg, average_precision, auroc, precision, recall, f1, bce_loss from per
union all
select 'mean', cast(sum(n_pos) as bigint), cast(sum(n_neg) as bigint), avg(average_precision),
  avg(auroc), avg(precision), avg(recall), avg(f1), avg(bce_loss) from per"""

_METRIC_DIGITS = {c: 9 for c in ("average_precision", "auroc", "precision", "recall", "f1",
                                 "bce_loss")}


@register("per_bank_eval", "G6", views=TX, sql=PER_BANK_SQL, rounded=_METRIC_DIGITS)
def q_per_bank_eval(spark, sf_dir):
    """G6 (flagship): partition -> split -> AP/AUROC/confusion/loss on each bank's test split."""
    test = splitted(spark, sf_dir).where(F.col("split") == "test").withColumnRenamed(
        "isFraud", "label")
    return M.per_bank_eval(test, "score", "label", "bank_id")
