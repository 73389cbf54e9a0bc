"""Fixture views over the driver's read-only tables.

Each view exists twice: as a Spark DataFrame built from ``spark.read.parquet``
and as DuckDB SQL text used by the oracle. Both use the same expressions, so a
query and its oracle read identical inputs. Every view grows with the tables.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# --- expressions shared by both engines -------------------------------------------

_FRAUD = "(o_orderkey*7919)%1000 < 35"

_TX_COLUMNS = [
    "o_orderkey as TransactionID",
    f"cast(case when {_FRAUD} then 1 else 0 end as int) as isFraud",
    "cast({sec} as bigint) as TransactionDT",
    "o_totalprice as TransactionAmt",
    "case when o_orderkey%97=0 then null "
    "when substr(o_orderpriority,1,1)='1' then 'W' "
    "when substr(o_orderpriority,1,1)='2' then 'H' "
    "when substr(o_orderpriority,1,1)='3' then 'R' "
    "when substr(o_orderpriority,1,1)='4' then 'S' else 'C' end as ProductCD",
    "o_custkey as card1",
    "case when o_orderkey%11=0 then null else cast(o_orderkey%500+100 as double) end as card2",
    "case when o_orderkey%13=0 then null else c_mktsegment end as card4",
    "case when o_orderkey%5<3 then null else c_acctbal end as dist1",
    "case when o_orderkey%2=0 then null else cast(o_orderkey%7 as double) end as addr2",
    f"cast((o_orderkey*104729)%1000 + case when {_FRAUD} then 250 else 0 end as double)"
    " / cast(1250 as double) as score",
]

_ID_COLUMNS = [
    "o_orderkey as TransactionID",
    "c_acctbal as id_01",
    "cast(case when o_orderkey%3=0 then null else o_orderkey%50 end as double) as id_02",
    "case when o_orderkey%7<4 then 'desktop' else 'mobile' end as DeviceType",
    "case when o_orderkey%5=0 then null else c_mktsegment end as DeviceInfo",
]

_LI_FRAUD = "(l_orderkey*7919 + l_linenumber*31)%1000 < 35"
_LI_SCORE_COLUMNS = [
    "l_orderkey as order_id",
    "l_linenumber as line_no",
    f"cast(case when {_LI_FRAUD} then 1 else 0 end as int) as label",
    f"cast((l_partkey*104729 + l_suppkey)%1000 + case when {_LI_FRAUD} then 250 else 0 end"
    " as double) / cast(1250 as double) as score",
]

_UPDATE_COLUMNS = [
    "cast(floor(cast(vec_id as double)/3) as bigint) as round",
    "concat('bank_', cast(vec_id%3+1 as string)) as client_id",
    "'w' as tensor",
    "cast(embedding as {dbl_array}) as w",
    "cast(100+label*50 as bigint) as num_examples",
]

_METRIC_EVENT_COLUMNS = [
    "event_id as seq",
    "ts",
    "concat('bank_', cast(user_id%3+1 as string)) as client_id",
    "case event_type when 'click' then 'training' when 'view' then 'evaluation' "
    "when 'purchase' then 'aggregation' else 'full_round' end as round_type",
    "case when event_type='error' then 'failed' else 'success' end as status",
    "case when event_type<>'error' then null when user_id%3=0 then 'disconnect' "
    "when user_id%3=1 then 'timeout' else 'error' end as failure_type",
    "value",
]

_DIRTY_COLUMNS = [
    "o_orderkey as line_no",
    "case when o_orderkey%23=0 then null when o_orderkey%29=0 then 'bad' "
    "else cast(o_orderkey - o_orderkey%2 as string) end as TransactionID",
    "case when o_orderkey%31=0 then '7' when o_orderkey%37=0 then null "
    f"when {_FRAUD} then '1' else '0' end as isFraud",
    "case when o_orderkey%17=0 then 'x1' when o_orderkey%19=0 then ' 5 ' "
    "when o_orderkey%41=0 then '1e3' when o_orderkey%43=0 then '5d' "
    "when o_orderkey%47=0 then 'inf' else cast(o_orderkey%1000 as string) end as TransactionAmt",
    "o_orderdate as received_at",
]

_SPARK_SEC = "timestampdiff(SECOND, timestamp_ntz'1995-01-01 00:00:00', o_orderdate)"
_DUCK_SEC = "date_diff('second', timestamp '1995-01-01 00:00:00', o_orderdate)"


def _cols(cols, engine):
    sec = _SPARK_SEC if engine == "spark" else _DUCK_SEC
    arr = "array<double>" if engine == "spark" else "double[]"
    return [c.replace("{sec}", sec).replace("{dbl_array}", arr) for c in cols]


# --- Spark views ---------------------------------------------------------------------

def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey, "left").selectExpr(*_cols(_TX_COLUMNS, "spark"))


def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").where("o_orderkey%4=1")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey, "inner").selectExpr(*_cols(_ID_COLUMNS, "spark"))


def lineitem_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr(*_cols(_LI_SCORE_COLUMNS, "spark"))


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").selectExpr(*_cols(_UPDATE_COLUMNS, "spark"))


def round_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read(spark, sf_dir, "events")
    return (ev.groupBy(F.expr("concat('bank_', cast(user_id%3+1 as string))").alias("client_id"),
                       F.expr("cast(day(ts) as int)").alias("round"))
            .agg(F.expr("1-avg(value)/500").alias("auprc"),
                 F.expr("1-stddev_pop(value)/500").alias("auroc"),
                 F.expr("avg(value)/100").alias("loss"),
                 F.count(F.lit(1)).alias("num_examples"),
                 F.expr("sum(value)/1000").alias("epsilon")))


def metric_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(*_cols(_METRIC_EVENT_COLUMNS, "spark"))


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr(*_cols(_DIRTY_COLUMNS, "spark"))


# --- DuckDB views (for the oracle) ----------------------------------------------------

def _sel(cols, frm):
    return "select " + ",\n  ".join(_cols(cols, "duck")) + "\nfrom " + frm


DUCK_VIEWS = {
    "transactions": _sel(_TX_COLUMNS, "orders left join customer on o_custkey = c_custkey"),
    "identity": _sel(_ID_COLUMNS, "orders join customer on o_custkey = c_custkey "
                                  "where o_orderkey%4=1"),
    "lineitem_scores": _sel(_LI_SCORE_COLUMNS, "lineitem"),
    "updates": _sel(_UPDATE_COLUMNS, "embeddings"),
    "round_metrics": (
        "select concat('bank_', cast(user_id%3+1 as varchar)) as client_id,\n"
        "  cast(day(ts) as int) as round, 1-avg(value)/500 as auprc,\n"
        "  1-stddev_pop(value)/500 as auroc, avg(value)/100 as loss,\n"
        "  count(*) as num_examples, sum(value)/1000 as epsilon\n"
        "from events group by 1, 2"),
    "metric_events": _sel(_METRIC_EVENT_COLUMNS, "events"),
    "dirty": _sel(_DIRTY_COLUMNS, "orders"),
}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the named fixture views as CTEs (DuckDB dialect).

    ``sql`` is either a select or further CTEs (``x as (...) select ...``).
    """
    ctes = ",\n".join(f"{n} as (\n{DUCK_VIEWS[n]}\n)" for n in names)
    body = sql.strip()
    if not names and body.lower().startswith("with"):
        return body
    if body.lower().startswith("select"):
        return f"with {ctes}\n{body}" if names else body
    return f"with {ctes},\n{body}" if names else f"with {body}"
