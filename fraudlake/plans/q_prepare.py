"""Registered queries: joins, imputation, encoding, scaling, full preparation
(SURVEY 2.3-2.5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraudlake.operators import prepare as P
from fraudlake.plans.q_split import SPLIT_SQL, TX, split_sql, splitted
from fraudlake.plans.registry import register
from fraudlake.session import scratch_path
from fraudlake.sources import fixtures as fx
from fraudlake.sources import ingest as I

TXI = ("transactions", "identity")
MERGED_SQL = """
merged as (select t.*, i.id_01, i.id_02, i.DeviceType, i.DeviceInfo
   from transactions t left join identity i on t.TransactionID = i.TransactionID)"""
MERGED_COLS = ["TransactionID", "isFraud", "TransactionDT", "TransactionAmt", "ProductCD",
               "card1", "card2", "card4", "dist1", "addr2", "score", "id_01", "id_02",
               "DeviceType", "DeviceInfo"]
ESSENTIAL_SQL = ", ".join(f"'{c}'" for c in P.ESSENTIAL_COLUMNS)

PROFILE_SQL = MERGED_SQL + ",\nprofile as (\n" + "\nunion all\n".join(
    f"select '{c}' as column_name, count(*) - count({c}) as nulls, count(*) as rows from merged"
    for c in MERGED_COLS) + ")"


def _mode_sql(col: str, src: str) -> str:
    return (f"coalesce((select v from (select {col} as v, count(*) as c from {src} "
            f"where {col} is not null group by {col}) order by c desc, v limit 1), 'Unknown')")


FILLED_SQL = MERGED_SQL + f""",
fills as (select quantile_cont(card2, 0.5) as m_card2, quantile_cont(addr2, 0.5) as m_addr2,
   {_mode_sql('ProductCD', 'merged')} as m_pcd, {_mode_sql('card4', 'merged')} as m_card4
   from merged),
filled as (select TransactionID, isFraud, TransactionDT, TransactionAmt,
   coalesce(ProductCD, m_pcd) as ProductCD, card1, coalesce(card2, m_card2) as card2,
   coalesce(card4, m_card4) as card4, coalesce(addr2, m_addr2) as addr2, score
   from merged, fills)"""


def merged(spark, sf_dir):
    return P.merge_identity(fx.transactions(spark, sf_dir), fx.identity(spark, sf_dir))


@register("merge_identity", "C1", views=TXI, sql=MERGED_SQL + """
select TransactionID, isFraud, ProductCD, id_01, id_02, DeviceType, DeviceInfo from merged""")
def q_merge_identity(spark, sf_dir):
    """Left join on the key; every transaction kept."""
    return merged(spark, sf_dir).select("TransactionID", "isFraud", "ProductCD", "id_01", "id_02",
                                        "DeviceType", "DeviceInfo")


@register("match_rate", "C2", views=TXI,
          rounded={"identity_match_rate": 9, "join_hit_rate": 9}, sql=MERGED_SQL + """
select (select count(*) from transactions) as initial_transactions,
  (select count(*) from identity) as initial_identities, count(*) as merged_records,
  count(*) filter (where id_01 is not null and id_02 is not null and DeviceType is not null
    and DeviceInfo is not null) * 100.0 / (select count(*) from transactions)
    as identity_match_rate,
  (select count(*) from transactions t join identity i on t.TransactionID = i.TransactionID)
    * 100.0 / (select count(*) from transactions) as join_hit_rate
from merged""")
def q_match_rate(spark, sf_dir):
    """Identity match rate (all identity columns present) and join hit rate."""
    return P.match_rate(fx.transactions(spark, sf_dir), fx.identity(spark, sf_dir))


@register("drop_sparse", "E1", views=TXI, rounded={"null_fraction": 9}, sql=PROFILE_SQL + f"""
select column_name, cast(nulls as double) / rows as null_fraction from profile
where cast(nulls as double) / rows > 0.5 and column_name not in ({ESSENTIAL_SQL})""")
def q_drop_sparse(spark, sf_dir):
    """Columns whose null fraction is strictly above 0.5 (essentials kept)."""
    m = merged(spark, sf_dir)
    prof = P.null_fractions(m)
    dropped = P.sparse_columns(m, 0.5, prof)
    rows = [(c, prof[c][0] / prof[c][1]) for c in dropped]
    # the profile is one aggregate; the result has one row per dropped column
    return spark.createDataFrame(rows, "column_name string, null_fraction double")


def filled(spark, sf_dir):
    out, dropped, fills = P.handle_missing(merged(spark, sf_dir), 0.5)
    return out, dropped, fills


@register("impute_median", "E2", views=TXI, sql=FILLED_SQL + """
select TransactionID, card2, addr2 from filled""")
def q_impute_median(spark, sf_dir):
    """Numeric nulls -> exact median (mean of the middle two)."""
    return filled(spark, sf_dir)[0].select("TransactionID", "card2", "addr2")


@register("impute_mode", "E3", views=TXI, sql=FILLED_SQL + """
select TransactionID, ProductCD, card4 from filled""")
def q_impute_mode(spark, sf_dir):
    """Text nulls -> mode (smallest on ties), 'Unknown' if no values."""
    return filled(spark, sf_dir)[0].select("TransactionID", "ProductCD", "card4")


@register("imputation_stats", "E4", views=TXI, rounded={"value_num": 9}, sql=PROFILE_SQL + """,
""" + FILLED_SQL.replace(MERGED_SQL + ",", "").strip() + f"""
select column_name, 'dropped' as method, cast(null as double) as value_num,
  cast(null as varchar) as value_str from profile
  where cast(nulls as double) / rows > 0.5 and column_name not in ({ESSENTIAL_SQL})
union all select 'card2', 'median', m_card2, null from fills
union all select 'addr2', 'median', m_addr2, null from fills
union all select 'ProductCD', 'mode', null, m_pcd from fills
union all select 'card4', 'mode', null, m_card4 from fills""")
def q_imputation_stats(spark, sf_dir):
    """Dropped and imputed columns with method and value."""
    _, dropped, fills = filled(spark, sf_dir)
    return P.imputation_stats(spark, dropped, fills)


CAT = ["ProductCD", "card4"]
DICT_SQL = SPLIT_SQL + """,
tr as (select * from splitted where split = 'train'),
dvals as (select distinct bank_id, 'ProductCD' as column_name,
     coalesce(ProductCD, 'Unknown') as value from tr
   union select distinct bank_id, 'card4', coalesce(card4, 'Unknown') from tr),
dict as (select bank_id, column_name, value, row_number() over (partition by bank_id,
     column_name order by value) - 1 as code from dvals)"""


def dictionary(spark, sf_dir):
    s = splitted(spark, sf_dir)
    return s, P.fit_dictionary(s.where(F.col("split") == "train"), CAT, "bank_id")


@register("fit_dictionary", "E5", views=TX, sql=DICT_SQL + """
select bank_id, column_name, value, code from dict""")
def q_fit_dictionary(spark, sf_dir):
    """E5: sorted distinct train values per (bank, column) -> 0-based codes."""
    return dictionary(spark, sf_dir)[1]


# what each column of the transactions is to become (D1, D2); its values are counted
ROLES = [("ProductCD", "categorical", False), ("card1", "categorical", False), ("card4", "categorical", False),
         ("TransactionDT", "numeric", True), ("TransactionAmt", "numeric", True), ("card2", "numeric", False),
         ("dist1", "numeric", True), ("addr2", "numeric", True), ("score", "numeric", True)]


@register("column_roles", "D1", views=TX, sql="\nunion all\n".join(
    f"select '{c}' as column_name, '{role}' as role, {str(scaled).lower()} as scaled, count({c}) as filled, "
    f"count(distinct {c}) as distinct_values from transactions" for c, role, scaled in ROLES))
def q_column_roles(spark, sf_dir):
    """Role of every transaction column, whether it is scaled, its values in all and distinct."""
    tx = fx.transactions(spark, sf_dir)
    categorical, numeric = P.feature_roles(tx)
    scaled = P.scale_columns(tx)
    long = tx.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.lit("categorical" if c in categorical else "numeric").alias("role"),
        F.lit(c in scaled).alias("scaled"), F.col(c).cast("string").alias("value"))
        for c in [*categorical, *numeric]])).alias("v")).select("v.*")
    # counted per value first: distinct values, not rows, meet in one task per column
    each = long.groupBy("column_name", "role", "scaled", "value").agg(F.count("value").alias("n"))
    return each.groupBy("column_name", "role", "scaled").agg(
        F.sum("n").alias("filled"), F.count("value").alias("distinct_values"))


@register("extend_dictionary", "E5", views=TX, sql=DICT_SQL + """,
more as (select distinct bank_id, 'ProductCD' as column_name, coalesce(ProductCD, 'Unknown') as value
   from splitted where split <> 'train'
   union select distinct bank_id, 'card4', coalesce(card4, 'Unknown') from splitted where split <> 'train'
   union select distinct bank_id, 'card1', coalesce(cast(card1 as varchar), 'Unknown') from splitted
   where split <> 'train'),
new as (select m.* from more m left join dict d on m.bank_id = d.bank_id and m.column_name = d.column_name
   and m.value = d.value where d.code is null),
used as (select bank_id, column_name, max(code) + 1 as next from dict group by bank_id, column_name)
select bank_id, column_name, value, code, 1 as version from dict
union all select n.bank_id, n.column_name, n.value, coalesce(u.next, 0) + row_number() over (
  partition by n.bank_id, n.column_name order by n.value) - 1, 2
from new n left join used u on n.bank_id = u.bank_id and n.column_name = u.column_name""")
def q_extend_dictionary(spark, sf_dir):
    """The train dictionary, extended by the values of the later rows (and a new column)."""
    s, d = dictionary(spark, sf_dir)
    return P.extend_dictionary(d, s.where(F.col("split") != "train"), [*CAT, "card1"])


@register("save_load_encoders", "A8", views=TX, sql=DICT_SQL + """
select bank_id, column_name, value, code from dict""")
def q_save_load_encoders(spark, sf_dir):
    """Dictionary written as a Parquet table and read back unchanged."""
    path = scratch_path(spark, "dictionary")
    I.save_dictionary(dictionary(spark, sf_dir)[1], path)
    return I.load_dictionary(spark, path).select("bank_id", "column_name", "value", "code")


def _encode_sql(src: str) -> str:
    joins, cols = [], []
    for c in CAT:
        joins.append(f"left join dict d_{c} on d_{c}.bank_id = s.bank_id and "
                     f"d_{c}.column_name = '{c}' and d_{c}.value = coalesce(s.{c}, 'Unknown') "
                     f"left join dict u_{c} on u_{c}.bank_id = s.bank_id and "
                     f"u_{c}.column_name = '{c}' and u_{c}.value = 'Unknown'")
        cols.append(f"coalesce(d_{c}.code, u_{c}.code, 0) as {c}")
    return f"select s.* replace ({', '.join(cols)}) from {src} s " + " ".join(joins)


@register("transform_unseen", "E6", views=TX, sql=DICT_SQL + f""",
enc as ({_encode_sql('splitted')})
select TransactionID, bank_id, split, ProductCD, card4 from enc""")
def q_transform_unseen(spark, sf_dir):
    """Codes for every split; unseen -> code of 'Unknown' if fitted, else 0."""
    s, d = dictionary(spark, sf_dir)
    return P.transform_codes(s, d, CAT, "bank_id").select(
        "TransactionID", "bank_id", "split", "ProductCD", "card4")


@register("dictionary_join", "C3", views=TX, sql=DICT_SQL + f""",
enc as ({_encode_sql('splitted')})
select TransactionID, ProductCD, card4 from enc where split = 'train'""")
def q_dictionary_join(spark, sf_dir):
    """Value -> code lookup through the dictionary on the fitted rows."""
    s, d = dictionary(spark, sf_dir)
    tr = s.where(F.col("split") == "train")
    return P.transform_codes(tr, d, CAT, "bank_id").select("TransactionID", "ProductCD", "card4")


@register("encoding_stats", "E7", views=TX, sql=DICT_SQL + """
select bank_id, column_name, count(*) as unique_values,
  array_to_string(list_slice(list_sort(list(value)), 1, 10), ',') as classes
from dict group by bank_id, column_name""")
def q_encoding_stats(spark, sf_dir):
    """Number of classes and the first 10 per (bank, column)."""
    return P.encoding_stats(dictionary(spark, sf_dir)[1])


SCALE = ["TransactionDT", "TransactionAmt", "dist1", "addr2", "score"]
SCALER_SQL = SPLIT_SQL + """,
sc as (select bank_id, """ + ", ".join(
    f"avg({c}) as m_{c}, case when stddev_pop({c}) = 0 or stddev_pop({c}) is null then 1.0 "
    f"else stddev_pop({c}) end as s_{c}" for c in SCALE) + """
   from splitted where split = 'train' group by bank_id),
scaled as (select s.TransactionID, s.bank_id, s.split, """ + ", ".join(
    f"(s.{c} - sc.m_{c}) / sc.s_{c} as {c}" for c in SCALE) + """
   from splitted s join sc on s.bank_id = sc.bank_id)"""


def scaled(spark, sf_dir):
    s = splitted(spark, sf_dir)
    cols = [c for c in P.scale_columns(s) if c in SCALE]
    sc = P.fit_scaler(s.where(F.col("split") == "train"), cols, "bank_id")
    return s, P.standardize(s, sc, cols, "bank_id")


@register("standardize", "E8", views=TX, rounded={c: 6 for c in SCALE}, sql=SCALER_SQL + """
select TransactionID, bank_id, split, """ + ", ".join(SCALE) + " from scaled")
def q_standardize(spark, sf_dir):
    """Per-bank train mean / population sd, applied to every split."""
    return scaled(spark, sf_dir)[1].select("TransactionID", "bank_id", "split", *SCALE)


@register("range_report", "E9", views=TX,
          rounded={"min_before": 6, "max_before": 6, "mean_after": 6, "sd_after": 6},
          sql=SCALER_SQL + "\n" + "\nunion all\n".join(
              f"select '{c}' as column_name, (select cast(min({c}) as double) from splitted) as "
              f"min_before, (select cast(max({c}) as double) from splitted) as max_before, "
              f"avg({c}) as mean_after, stddev_pop({c}) as sd_after from scaled" for c in SCALE))
def q_range_report(spark, sf_dir):
    """min/max before scaling, mean/sd after."""
    before, after = scaled(spark, sf_dir)
    return P.range_report(before, after, SCALE)


PREP_SQL = FILLED_SQL + ",\n" + split_sql("filled") + """,
tr as (select * from splitted where split = 'train'),
dvals as (select distinct bank_id, 'ProductCD' as column_name, ProductCD as value from tr
   union select distinct bank_id, 'card4', card4 from tr),
dict as (select bank_id, column_name, value, row_number() over (partition by bank_id,
     column_name order by value) - 1 as code from dvals),
enc as (""" + _encode_sql("splitted") + ")"


def prepared(spark, sf_dir):
    return P.preprocess_full(fx.transactions(spark, sf_dir), fx.identity(spark, sf_dir))[0]


@register("preprocess_full", "E10", views=TXI, rounded={"card2": 6, "addr2": 6},
          sql=PREP_SQL + """
select TransactionID, bank_id, split, isFraud, TransactionDT, TransactionAmt, ProductCD,
  card1, card2, card4, addr2 from enc""")
def q_preprocess_full(spark, sf_dir):
    """Merge -> drop sparse -> impute -> bank partition -> split -> encode per bank."""
    return prepared(spark, sf_dir).select("TransactionID", "bank_id", "split", "isFraud", "TransactionDT",
                      "TransactionAmt", "ProductCD", "card1", "card2", "card4", "addr2")
