"""Registered queries: ingestion, quality, quarantine, retention, sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fraudlake.functions.frames import combine_one_row
from fraudlake.operators import prepare as P
from fraudlake.operators import quality as Q
from fraudlake.plans.q_split import SPLIT_SQL, TX, splitted
from fraudlake.plans.registry import register
from fraudlake.session import scratch_path
from fraudlake.sources import fixtures as fx
from fraudlake.sources import ingest as I

D = ("dirty",)
PAT = Q.NUMBER_PATTERN


def _guard(x: str) -> str:
    return f"case when regexp_full_match(trim({x}), '{PAT}') then try_cast(trim({x}) as double) end"


def _long(d: str) -> str:
    return f"case when abs({d}) < 9.2e18 then cast(trunc({d}) as bigint) end"


TYPED_SQL = f"""
parsed as (select line_no, received_at, TransactionID as raw_TransactionID,
   isFraud as raw_isFraud, TransactionAmt as raw_TransactionAmt,
   {_guard('TransactionID')} as tid_d, {_guard('isFraud')} as lab_d,
   {_guard('TransactionAmt')} as TransactionAmt from dirty),
typed as (select line_no, {_long('tid_d')} as TransactionID,
   cast({_long('lab_d')} as int) as isFraud, TransactionAmt, received_at,
   raw_TransactionID, raw_isFraud, raw_TransactionAmt from parsed)"""

REASON_SQL = TYPED_SQL + """,
early as (select *, case
     when raw_TransactionID is null and raw_isFraud is null and raw_TransactionAmt is null
       then 'empty_row'
     when TransactionID is null then 'missing_key'
     when not coalesce(isFraud in (0, 1), false) then 'bad_label' end as early from typed),
firsts as (select TransactionID, min(line_no) as first_line from early where early is null
   group by TransactionID),
reasons as (select e.*, coalesce(e.early, case when e.line_no <> f.first_line
     then 'duplicate_key' end) as reject_reason
   from early e left join firsts f on e.TransactionID = f.TransactionID)"""


def typed(spark, sf_dir):
    return Q.coerce_types(fx.dirty(spark, sf_dir))


def raw(spark, sf_dir):
    return fx.dirty(spark, sf_dir).drop("received_at")


def reasons(spark, sf_dir):
    return Q.reject_reasons(fx.dirty(spark, sf_dir), carry=("received_at",))


def _write_damaged(spark, sf_dir, path):
    """The dirty rows as CSV, every 53rd line with an unquoted extra field."""
    d = fx.dirty(spark, sf_dir).drop("received_at")
    amt = F.when(F.col("line_no") % 53 == 0,
                 F.concat(F.coalesce(F.col("TransactionAmt"), F.lit("")), F.lit(",extra"))) \
        .otherwise(F.col("TransactionAmt"))
    d.withColumn("TransactionAmt", amt).write.mode("overwrite").option("header", "true") \
        .option("quote", "").csv(path)


@register("read_typed", "A1", views=D, sql=TYPED_SQL + """
select line_no, TransactionID, isFraud, TransactionAmt from typed where line_no % 53 <> 0""")
def q_read_typed(spark, sf_dir):
    """A1: text rows written as CSV, read back with an all-string schema, typed; every
    53rd line has a field too many and is left out."""
    path = scratch_path(spark, "dirty-csv")
    _write_damaged(spark, sf_dir, path)
    df = I.read_table(spark, path, kind="transaction")
    return df.select(F.col("line_no").cast("long").alias("line_no"), "TransactionID", "isFraud",
                     "TransactionAmt")


@register("bad_rows", "A3", views=D, sql="""
select line_no, 5 as n_fields, 'too_many_fields' as reason from dirty where line_no % 53 = 0""")
def q_bad_rows(spark, sf_dir):
    """A3: raw CSV lines with more fields than the header are found and reported
    (every 53rd line gets an unquoted extra field when the file is written)."""
    path = scratch_path(spark, "raw-csv")
    _write_damaged(spark, sf_dir, path)
    bad = I.bad_rows(spark, path)
    first = F.split(F.col("line"), ",").getItem(0).cast("long")
    return bad.select(first.alias("line_no"), F.col("n_fields").cast("int").alias("n_fields"),
                      "reason")


@register("coerce_types", "B1", views=D, sql=TYPED_SQL + """
select line_no, TransactionID, isFraud, TransactionAmt, received_at from typed""")
def q_coerce_types(spark, sf_dir):
    """B1: guarded number parse; integers truncate through double; junk -> null."""
    return typed(spark, sf_dir)


_GAPS = [f"case when line_no % 59 = 0 then null else {c} end as {c}"
         for c in ("TransactionID", "isFraud", "TransactionAmt", "received_at")]


@register("drop_empty_rows", "B2", views=D, sql=f"""
gaps as (select line_no, {', '.join(_GAPS)} from dirty)
select count(*) as rows_in, count(*) filter (where TransactionID is not null
   or isFraud is not null or TransactionAmt is not null or received_at is not null) as rows_out
from gaps""")
def q_drop_empty_rows(spark, sf_dir):
    """B2: rows where every data column is null (every 59th line) are dropped before typing."""
    d = fx.dirty(spark, sf_dir).selectExpr("line_no", *_GAPS)
    kept = Q.drop_empty_rows(d, ignore=("line_no",))
    return combine_one_row(d.agg(F.count(F.lit(1)).alias("rows_in")),
                           kept.agg(F.count(F.lit(1)).alias("rows_out")))


@register("require_key", "B3", views=D, sql=TYPED_SQL + """
select line_no, TransactionID from typed where TransactionID is not null""")
def q_require_key(spark, sf_dir):
    """Rows with a key."""
    return Q.require_key(typed(spark, sf_dir)).select("line_no", "TransactionID")


@register("label_domain", "B4", views=D, sql=TYPED_SQL + """
select line_no, isFraud from typed where isFraud in (0, 1)""")
def q_label_domain(spark, sf_dir):
    """Labels outside {0, 1} removed (domain checked before narrowing)."""
    return Q.label_domain(typed(spark, sf_dir)).select("line_no", "isFraud")


@register("dedup_first", "B5", views=D, sql=TYPED_SQL + """
, ok as (select * from typed where TransactionID is not null and isFraud in (0, 1))
select TransactionID, min(line_no) as line_no,
  arg_min_null(isFraud, line_no) as isFraud, arg_min_null(TransactionAmt, line_no) as TransactionAmt
from ok group by TransactionID""")
def q_dedup_first(spark, sf_dir):
    """B5 (with B2-B4): first row per key by line number."""
    t = typed(spark, sf_dir).drop("received_at")
    return Q.clean_records(t).select("TransactionID", "line_no", "isFraud", "TransactionAmt")


@register("cleaning_stats", "B6", views=D, rounded={"removed_percent": 9}, sql=TYPED_SQL + """
, ok as (select distinct TransactionID from typed
   where TransactionID is not null and isFraud in (0, 1))
select (select count(*) from typed) as initial_rows, (select count(*) from ok) as final_rows,
  (select count(*) from typed) - (select count(*) from ok) as rows_removed,
  ((select count(*) from typed) - (select count(*) from ok)) * 100.0
    / (select count(*) from typed) as removed_percent""")
def q_cleaning_stats(spark, sf_dir):
    """Removed records and percent."""
    t = typed(spark, sf_dir).drop("received_at")
    return Q.cleaning_stats(t, Q.clean_records(t))


_MERGED_COLS = ["TransactionID", "isFraud", "TransactionDT", "TransactionAmt", "ProductCD",
                "card1", "card2", "card4", "dist1", "addr2", "score", "id_01", "id_02",
                "DeviceType", "DeviceInfo"]


@register("null_profile", "B7", views=("transactions", "identity"), sql="""
merged as (select * from transactions t left join identity i using (TransactionID))
""" + "\nunion all\n".join(
    f"select '{c}' as column_name, count(*) - count({c}) as null_count, count(*) as rows "
    f"from merged" for c in _MERGED_COLS))
def q_null_profile(spark, sf_dir):
    """Null count per column of the merged table in one scan (long form)."""
    merged = P.merge_identity(fx.transactions(spark, sf_dir), fx.identity(spark, sf_dir))
    return Q.null_profile(merged)


@register("integrity_report", "B8", views=D, rounded={"fraud_rate_percent": 9}, sql=TYPED_SQL + """
select count(*) as total_records, 5 as n_columns, '' as missing_required,
  count(*) - count(distinct TransactionID)
    - case when count(*) filter (where TransactionID is null) > 0 then 1 else 0 end
    as duplicate_ids,
  count(*) filter (where isFraud = 0) as label_0, count(*) filter (where isFraud = 1) as label_1,
  count(*) filter (where isFraud = 1) * 100.0 / count(*) as fraud_rate_percent from typed""")
def q_integrity_report(spark, sf_dir):
    """Totals, duplicate keys, label distribution, fraud % over all rows."""
    return Q.integrity_report(typed(spark, sf_dir))


@register("error_log", "B9", views=D, sql=REASON_SQL + """
select reject_reason as reason, count(*) as records from reasons
where reject_reason is not null group by reject_reason
union all select 'unparseable_TransactionID', count(*) filter (where raw_TransactionID is not null
  and tid_d is null) from parsed
union all select 'unparseable_isFraud', count(*) filter (where raw_isFraud is not null
  and lab_d is null) from parsed
union all select 'unparseable_TransactionAmt', count(*) filter (where raw_TransactionAmt
  is not null and TransactionAmt is null) from parsed""")
def q_error_log(spark, sf_dir):
    """Per-reason counts of rejected records and unparseable numbers."""
    return Q.error_log(raw(spark, sf_dir), reasons(spark, sf_dir),
                       ["TransactionID", "isFraud", "TransactionAmt"])


@register("nonfinite_to_num", "B10", views=D, sql=TYPED_SQL + """
, amt as (select line_no, case when raw_TransactionAmt = 'inf' then 'inf'::double
     when line_no % 53 = 0 then '-inf'::double when line_no % 59 = 0 then 'nan'::double
     else TransactionAmt end as TransactionAmt from typed)
select line_no, case when TransactionAmt is null or isnan(TransactionAmt) then 0.0
  when TransactionAmt = 'inf'::double then 1e6 when TransactionAmt = '-inf'::double then -1e6
  else TransactionAmt end as TransactionAmt from amt""")
def q_nonfinite_to_num(spark, sf_dir):
    """NaN/null -> 0, +inf -> 1e6, -inf -> -1e6."""
    t = Q.coerce_types(fx.dirty(spark, sf_dir).withColumnRenamed("TransactionAmt", "raw_amt")
                       .withColumn("TransactionAmt", F.col("raw_amt")))
    amt = (F.when(F.col("raw_amt") == "inf", F.lit(float("inf")))
           .when(F.col("line_no") % 53 == 0, F.lit(float("-inf")))
           .when(F.col("line_no") % 59 == 0, F.lit(float("nan")))
           .otherwise(F.col("TransactionAmt")))
    return Q.nonfinite_to_num(t.select("line_no", amt.alias("TransactionAmt")), ["TransactionAmt"])


_FEATURES = ["TransactionAmt", "card2", "addr2", "dist1"]


@register("dataset_checks", "B11", views=TX, rounded={"fraud_rate": 9}, sql=SPLIT_SQL + """,
damaged as (select * replace (
   case when TransactionID % 400 = 1 then 'bank_tiny' else bank_id end as bank_id,
   case when TransactionID % 997 = 3 then 'nan'::double else TransactionAmt end as TransactionAmt)
   from splitted)
select bank_id, count(*) as n_rows, count(*) filter (where """ + " or ".join(
    f"isnan({c}) or {c} in ('inf'::double, '-inf'::double)" for c in _FEATURES) + """)
  as nonfinite_rows, avg(cast(isFraud as double)) as fraud_rate, 4 as n_features,
  array_to_string(list_filter([
    case when count(*) filter (where """ + " or ".join(
    f"isnan({c}) or {c} in ('inf'::double, '-inf'::double)" for c in _FEATURES) + """) > 0
      then 'nan_or_inf' end,
    case when count(*) < 100 then 'too_few_rows' end,
    case when avg(cast(isFraud as double)) < 0.001 or avg(cast(isFraud as double)) > 0.999
      then 'fraud_rate_out_of_range' end], lambda x: x is not null), ',') as issues,
  (issues = '') as valid
from damaged group by bank_id""")
def q_dataset_checks(spark, sf_dir):
    """Per-bank dataset checks with issue list, on rows with NaN amounts and a tiny bank."""
    i = F.col("TransactionID")
    damaged = splitted(spark, sf_dir).withColumns({
        "bank_id": F.when(i % 400 == 1, F.lit("bank_tiny")).otherwise(F.col("bank_id")),
        "TransactionAmt": F.when(i % 997 == 3, F.lit(float("nan"))).otherwise(F.col("TransactionAmt"))})
    return Q.dataset_checks(damaged, _FEATURES, group_cols=["bank_id"])


QUARANTINE_SQL = REASON_SQL + """,
quarantine as (select concat_ws('|', coalesce(raw_TransactionID, ''), coalesce(raw_isFraud, ''),
     coalesce(raw_TransactionAmt, '')) as payload, reject_reason as reason,
   cast(line_no as bigint) as identifier, received_at as ts, cast(received_at as date) as date
   from reasons where reject_reason is not null)"""


def quarantined(spark, sf_dir):
    """Rejected rows written to the quarantine table and read back."""
    rows = I.quarantine_rows(reasons(spark, sf_dir), ["TransactionID", "isFraud", "TransactionAmt"])
    path = scratch_path(spark, "quarantine")
    I.write_quarantine(rows, path)
    return spark.read.parquet(path).drop("month")


@register("quarantine", "A4", views=D, sql=QUARANTINE_SQL + """
select payload, reason, identifier, ts, date from quarantine""")
def q_quarantine(spark, sf_dir):
    """A4: one pass assigns reasons; rejected rows go to a date-partitioned table."""
    return quarantined(spark, sf_dir).select("payload", "reason", "identifier", "ts", "date")


CAP_BYTES = 20_000


@register("quarantine_retention", "A5", views=D, sql=QUARANTINE_SQL + f"""
, sizes as (select date, cast(sum(length(payload)) as bigint) as bytes, count(*) as records
   from quarantine group by date)
select date, bytes, records, cast(sum(bytes) over (order by date desc
   rows between unbounded preceding and current row) as bigint) as running_bytes,
  sum(bytes) over (order by date desc rows between unbounded preceding and current row)
   <= {CAP_BYTES} as keep from sizes""")
def q_quarantine_retention(spark, sf_dir):
    """A5: newest date partitions kept while the running size stays under the cap."""
    return I.quarantine_retention(quarantined(spark, sf_dir), CAP_BYTES)


@register("retention_applied", "A5", views=D, sql=QUARANTINE_SQL + f"""
, sizes as (select strftime(date, '%Y-%m') as month, sum(length(payload)) as bytes
   from quarantine group by strftime(date, '%Y-%m')),
kept as (select month from (select month, sum(bytes) over (order by month desc
   rows between unbounded preceding and current row) as upto from sizes) where upto <= {CAP_BYTES})
select payload, reason, identifier, ts, date from quarantine
where strftime(date, '%Y-%m') in (select month from kept)""")
def q_retention_applied(spark, sf_dir):
    """A5: month folders beyond the size cap deleted from a written quarantine, which is read back."""
    rows = I.quarantine_rows(reasons(spark, sf_dir), ["TransactionID", "isFraud", "TransactionAmt"])
    path = scratch_path(spark, "quarantine")
    I.write_quarantine(rows, path)
    q = spark.read.parquet(path)
    sizes = q.withColumn("date", F.col("month").cast("string"))
    keep = I.quarantine_retention(sizes, CAP_BYTES).where("keep").select(F.col("date").alias("month"))
    I.apply_retention(spark, path, keep)
    return spark.read.schema(q.schema).parquet(path).select("payload", "reason", "identifier", "ts", "date")


@register("detect_kind", "A2", views=TX + ("identity",), sql="""
select 'transaction' as kind, count(*) as rows from transactions
union all select 'identity', count(*) from identity""")
def q_detect_kind(spark, sf_dir):
    """A2: the fixture tables written to folders whose names say nothing, told apart by their columns."""
    found = []
    for df in (fx.transactions(spark, sf_dir), fx.identity(spark, sf_dir)):
        path = scratch_path(spark, "incoming")
        df.write.parquet(path)
        back = spark.read.parquet(path)
        found.append(back.agg(F.lit(I.detect_kind(path, back.columns)).alias("kind"), F.count(F.lit(1)).alias("rows")))
    return found[0].unionByName(found[1])


NOW = "2001-08-01 00:00:00"


@register("age_retention", "A6", sql=f"""
with catalog as (select o_orderkey as item_id, case o_orderkey % 3 when 0 then 'checkpoint'
     when 1 then 'model' else 'log' end as kind, o_orderdate as mtime from orders)
select item_id, kind, mtime from catalog
where mtime >= timestamp '{NOW}' - to_days(case when kind in ('checkpoint', 'model')
  then 7 else 30 end)""")
def q_age_retention(spark, sf_dir):
    """7-day limit for checkpoints/models, 30 days otherwise; ``now`` fixed."""
    cat = fx.read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("item_id"),
        F.expr("case o_orderkey % 3 when 0 then 'checkpoint' when 1 then 'model' else 'log' end")
        .alias("kind"), F.col("o_orderdate").alias("mtime"))
    return I.retained(cat, NOW).select("item_id", "kind", "mtime")


@register("write_splits", "A7", views=TX, sql=SPLIT_SQL + """
select bank_id, split, count(*) as records, cast(sum(isFraud) as bigint) as fraud
from splitted group by bank_id, split""")
def q_write_splits(spark, sf_dir):
    """Split table written per (bank_id, split) folder, then read back."""
    path = scratch_path(spark, "splits")
    I.write_splits(splitted(spark, sf_dir), path)
    back = spark.read.parquet(path)
    return back.groupBy("bank_id", "split").agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.col("isFraud").cast("long")).alias("fraud"))


def _json_sql() -> str:
    from fraudlake.plans.q_split import PER_BANK_CTE, _METRIC_DIGITS
    cols = ["n_pos", "n_neg", "average_precision", "auroc", "precision", "recall", "f1",
            "bce_loss"]
    fields = ", ".join(f"{c} := round({c}, {_METRIC_DIGITS[c]})" if c in _METRIC_DIGITS
                       else f"{c} := {c}" for c in cols)
    return PER_BANK_CTE + f""",
report as (select bank_id, n_pos, n_neg, average_precision, auroc, precision, recall, f1,
   bce_loss from per
   union all select 'mean', cast(sum(n_pos) as bigint), cast(sum(n_neg) as bigint),
   avg(average_precision), avg(auroc), avg(precision), avg(recall), avg(f1), avg(bce_loss)
   from per)
select bank_id, cast(to_json(struct_pack({fields})) as varchar) as report from report"""


@register("json_report", "A9", views=TX, sql=_json_sql())
def q_json_report(spark, sf_dir):
    """The per-bank evaluation as one JSON document per bank."""
    from fraudlake.plans.q_split import q_per_bank_eval
    return I.json_report(q_per_bank_eval(spark, sf_dir), ["bank_id"])


@register("round_state", "A10", views=("round_metrics",), rounded={"auprc": 9}, sql="""
st as (select client_id, round as checkpoint_round,
   count(*) over w as rounds_completed, auprc, round,
   list(round(auprc, 9)) over w as history
   from round_metrics
   window w as (partition by client_id order by round
     rows between unbounded preceding and current row))
select client_id, arg_max(checkpoint_round, round) as checkpoint_round,
  arg_max(rounds_completed, round) as rounds_completed, arg_max(auprc, round) as auprc,
  arg_max(history, round) as history
from st where round % 5 = 0 group by client_id""")
def q_round_state(spark, sf_dir):
    """A10: checkpoint rows (round, completed, AUPRC history) every 5 rounds,
    appended to a table; resume from the latest."""
    rm = fx.round_metrics(spark, sf_dir)
    w = Window.partitionBy("client_id").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    st = (rm.withColumn("rounds_completed", F.count(F.lit(1)).over(w))
          .withColumn("history", F.collect_list(F.round("auprc", 9)).over(w))
          .where(F.col("round") % 5 == 0)
          .select("client_id", F.col("round").alias("checkpoint_round"), "rounds_completed",
                  "auprc", "history"))
    path = scratch_path(spark, "round-state")
    I.save_round_state(st, path)
    return I.resume_point(spark, path).select("client_id", "checkpoint_round",
                                              "rounds_completed", "auprc", "history")
