"""Preparation operators: joins, bank partitioning, temporal splits, weights,
sampling, imputation, dictionary encoding and scaling (SURVEY 2.3-2.5).

Every function maps DataFrames to a DataFrame. Driver-side work is limited to
schema inspection and small bounded results (counts, cut tuples, profiles).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudlake.functions.frames import combine_one_row
from fraudlake.operators.rank import before_cut, cut_tuples, ordinal_codes, values_at_ranks
from fraudlake.session import scratch_path

KEY = "TransactionID"
LABEL = "isFraud"
TIME = "TransactionDT"
# fixed values: columns never dropped by the sparse-column rule
ESSENTIAL_COLUMNS = ["TransactionID", "isFraud", "TransactionDT", "TransactionAmt", "ProductCD"]
# fixed values: columns always treated as categorical by the encoder
KNOWN_CATEGORICAL = ["ProductCD", "card4", "card6", "P_emaildomain", "R_emaildomain",
                     "DeviceType", "DeviceInfo", "id_11", "id_12", "id_15", "id_16", "id_20"]
# fixed values: name prefixes that mark integer columns as categorical
CATEGORICAL_PREFIXES = ["ProductCD", "card", "email", "Device", "id_"]

# dictionary or mapping entries below which a lookup table is broadcast
BROADCAST_DICT_ROWS = 2_000_000

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def bank_name(i: Column) -> Column:
    return F.concat(F.lit("bank_"), i.cast("string"))


# --- C: joins --------------------------------------------------------------------

def merge_identity(tx: DataFrame, ident: DataFrame, key: str = KEY,
                   null_safe: bool = False) -> DataFrame:
    """Left join, every transaction kept, duplicate identities fan out."""
    for name, d in (("Transaction", tx), ("Identity", ident)):
        if key not in d.columns:
            raise ValueError(f"{name}: the key column {key} is not there")
    if not null_safe:
        return tx.join(ident, key, "left")
    right = ident.withColumnRenamed(key, "_rkey")
    return tx.join(right, tx[key].eqNullSafe(right["_rkey"]), "left").drop("_rkey")


def match_rate(tx: DataFrame, ident: DataFrame, key: str = KEY) -> DataFrame:
    """Share of merged rows whose identity columns are all non-null, per
    input transaction (reference meaning), and the true join hit rate."""
    id_cols = [c for c in ident.columns if c != key]
    marked = ident.withColumn("_hit", F.lit(1))
    merged = tx.join(marked, key, "left")
    all_present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in id_cols],
                         F.lit(True))
    n_tx = tx.agg(F.count(F.lit(1)).alias("initial_transactions"))
    m = merged.agg(F.count(F.lit(1)).alias("merged_records"),
                   F.count_if(all_present).alias("_complete"),
                   F.count_if(F.col("_hit").isNotNull()).alias("_hits"))
    n_id = ident.agg(F.count(F.lit(1)).alias("initial_identities"))
    out = combine_one_row(n_tx, n_id, m)   # three one-row aggregates
    n = F.col("initial_transactions").cast("double")
    return out.select(
        "initial_transactions", "initial_identities", "merged_records",
        F.when(F.col("initial_transactions") == 0, F.lit(0.0))
        .otherwise(F.col("_complete") / n * 100).alias("identity_match_rate"),
        F.when(F.col("initial_transactions") == 0, F.lit(0.0))
        .otherwise(F.col("_hits") / n * 100).alias("join_hit_rate"))


# --- D: partitioning and splitting ---------------------------------------------------

def code_banks(df: DataFrame, code_col: str = "ProductCD", num_banks: int = 3,
               order_col: str = KEY, n_codes: int | None = None) -> DataFrame:
    """Distinct codes in first-seen order (min order key, tie by code) and their bank.

    Ranking runs over the distinct-code table only; a very large code domain
    is split into buckets (:func:`ordinal_codes`).
    """
    codes = (df.where(F.col(code_col).isNotNull())
             .groupBy(code_col).agg(F.min(order_col).alias("first_seen")))
    # typed order: first position, then the code
    ranked = ordinal_codes(codes.select(code_col, "first_seen", F.lit(0).alias("_all"),
                                        F.struct("first_seen", code_col).alias("_key")),
                           ["_all"], "_key", max_part_size=n_codes)
    return ranked.select(code_col, "first_seen",
                         bank_name(F.col("code") % num_banks + 1).alias("bank_id"))


def bank_partition(df: DataFrame, code_col: str = "ProductCD", num_banks: int = 3,
                   order_col: str = KEY, tie_col: str = KEY) -> DataFrame:
    """Add ``bank_id``.

    i-th code in first-seen order -> ``bank_{(i mod k)+1}``. Rows without a code
    are split into k consecutive runs of the order (sizes as numpy array_split)
    using exact cut rows, so no row-level window and no single task.
    """
    if code_col not in df.columns:
        raise ValueError(f"no column {code_col} to deal the rows to banks by")
    # one small pass: number of distinct codes and rows without a code
    per_code = df.groupBy(code_col).agg(F.count(F.lit(1)).alias("_n"))
    summary = per_code.agg(F.count(F.col(code_col)).alias("codes"),
                           F.sum(F.when(F.col(code_col).isNull(), F.col("_n"))).alias("nulls")).first()
    n_null = summary["nulls"] or 0
    mapping = code_banks(df, code_col, num_banks, order_col, summary["codes"]) \
        .select(code_col, "bank_id")
    # the code count is known: broadcast the mapping only when it is small
    if summary["codes"] <= BROADCAST_DICT_ROWS:
        mapping = F.broadcast(mapping)
    coded = df.join(mapping, code_col, "left")
    if n_null == 0:
        return coded
    nulls = df.where(F.col(code_col).isNull())

    wanted: list[int] = []

    def split_ranks(_g, n):
        q, m = divmod(n, num_banks)
        wanted[:] = [j * q + min(j, m) for j in range(1, num_banks)]
        return wanted

    known = {None: (n_null, n_null, None, None)} if order_col == tie_col else None
    cuts = cut_tuples(nulls, None, order_col, tie_col, split_ranks, known)
    idx = reduce(lambda a, b: a + b,
                 [F.when(before_cut(order_col, tie_col, cuts.get((None, r))), 0).otherwise(1)
                  for r in wanted], F.lit(0))
    null_bank = bank_name(idx + 1)
    return coded.withColumn(
        "bank_id", F.when(F.col(code_col).isNull(), null_bank).otherwise(F.col("bank_id")))


def partition_stats(df: DataFrame, num_banks: int = 3, code_col: str = "ProductCD",
                    label_col: str = LABEL, order_col: str = KEY) -> DataFrame:
    """Rows, fraud rows, fraud % and assigned codes (first-seen order) per
    bank; empty banks kept. Aggregates per (bank, code) first, so the codes
    list is built from a small table."""
    spark = df.sparkSession
    banks = spark.range(1, num_banks + 1).select(bank_name(F.col("id")).alias("bank_id"))
    per_code = df.groupBy("bank_id", code_col).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col(label_col).cast("long")).alias("_f"),
        F.min(order_col).alias("_first"))
    # codes listed in first-seen order (the order they were assigned in)
    st = per_code.groupBy("bank_id").agg(
        F.sum("_n").alias("total_records"), F.sum("_f").alias("fraud_records"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(
            F.col(code_col).isNotNull(), F.struct(F.col("_first"), F.col(code_col))))),
            lambda x: x[code_col]), ",").alias("assigned_products"))
    out = banks.join(st, "bank_id", "left")
    return out.select(
        "bank_id",
        F.coalesce("total_records", F.lit(0)).alias("total_records"),
        F.coalesce("fraud_records", F.lit(0)).cast("long").alias("fraud_records"),
        F.coalesce(F.try_divide(F.col("fraud_records") * 100.0, F.col("total_records")),
                   F.lit(0.0)).alias("fraud_rate"),
        F.coalesce("assigned_products", F.lit("")).alias("assigned_products"))


def check_ratios(train: float, val: float, test: float) -> None:
    if abs(train + val + test - 1.0) > 1e-6:
        raise ValueError(f"the shares {train}, {val} and {test} do not sum to 1.0")


def temporal_split(df: DataFrame, train: float = 0.8, val: float = 0.1, test: float = 0.1,
                   time_col: str = TIME, key_col: str = KEY,
                   group_col: str | None = "bank_id") -> DataFrame:
    """Add ``split`` in {train, val, test} per group.

    Order is ``(time asc nulls last, key)``; cuts at ``int(n*train)`` and
    ``int(n*(train+val))`` (Python floats, as the reference). The two cut rows
    per group are found by :func:`cut_tuples`; rows are labelled by comparing
    with them, so the split needs no sort of the data.
    """
    check_ratios(train, val, test)
    if time_col not in df.columns:
        raise ValueError(f"no column {time_col} to order the rows by")
    tv = train + val
    wanted: dict = {}

    def ranks(g, n):
        wanted[g] = [int(n * train), int(n * tv)]
        return wanted[g]

    cuts = cut_tuples(df, group_col, time_col, key_col, ranks)
    groups = sorted(wanted, key=lambda g: (g is None, "" if g is None else str(g)))
    # a missing cut means the rank lies beyond the group: every row is before it
    label = F.lit("train")
    for g in groups:
        c1 = cuts.get((g, wanted[g][0]))
        c2 = cuts.get((g, wanted[g][1]))
        inner = (F.when(before_cut(time_col, key_col, c1), F.lit("train"))
                 .when(before_cut(time_col, key_col, c2), F.lit("val"))
                 .otherwise(F.lit("test")))
        cond = F.lit(True) if group_col is None else (
            F.col(group_col).isNull() if g is None else F.col(group_col) == F.lit(g))
        label = F.when(cond, inner).otherwise(label)
    return df.withColumn("split", label)


def sort_time(df: DataFrame, time_col: str = TIME, key_col: str = KEY) -> DataFrame:
    """The rows in time order (nulls last, ties by key) with ``position`` from 0.

    A range-partitioned sort; the position of a row is its place in its
    partition plus the sizes of the partitions before it (one number per
    partition). The sorted rows are written once, so places cannot change.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "time-order")
    df.orderBy(F.col(time_col).asc_nulls_last(), F.col(key_col)) \
        .withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    done = spark.read.parquet(path).withColumn("_part", F.shiftright("_id", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = done.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")) \
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    place = F.col("_id").bitwiseAND(F.lit(2 ** 33 - 1)) + F.col("_off")
    return done.join(F.broadcast(offsets), "_part").select(*df.columns, place.alias("position"))


def split_stats(df: DataFrame, group_col: str = "bank_id", label_col: str = LABEL) -> DataFrame:
    """Sizes, actual ratio and fraud % per (group, split); empty splits -> null rates."""
    w = Window.partitionBy(group_col)
    per = df.groupBy(group_col, "split").agg(
        F.count(F.lit(1)).alias("records"),
        F.sum(F.col(label_col).cast("long")).alias("fraud"))
    return per.select(
        group_col, "split", "records",
        F.try_divide(F.col("records").cast("double"), F.sum("records").over(w)).alias("ratio_actual"),
        F.try_divide(F.col("fraud") * 100.0, F.col("records")).alias("fraud_rate"))


# --- D1/D2: feature roles (driver-side, schema only) -----------------------------------

def feature_roles(df: DataFrame, key: str = KEY, label: str = LABEL,
                  extra_categorical: tuple[str, ...] = ()) -> tuple[list[str], list[str]]:
    """(categorical, numeric) columns. Categorical = known names, string
    columns, or integer columns named with a categorical prefix."""
    cat, num = [], []
    for f in df.schema.fields:
        if f.name in (key, label, "bank_id", "split"):
            continue
        is_int = isinstance(f.dataType, INTEGRAL_TYPES)
        if (f.name in KNOWN_CATEGORICAL or f.name in extra_categorical
                or isinstance(f.dataType, T.StringType)
                or (is_int and any(f.name.startswith(p) for p in CATEGORICAL_PREFIXES))):
            cat.append(f.name)
        elif isinstance(f.dataType, NUMERIC_TYPES):
            num.append(f.name)
    return cat, num


def scale_columns(df: DataFrame, key: str = KEY, label: str = LABEL) -> list[str]:
    """Numeric columns to standardise (not key/label, no categorical prefix)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in (key, label)
            and not any(f.name.startswith(p) for p in CATEGORICAL_PREFIXES)]


# --- E: imputation ----------------------------------------------------------------------

def normalise_nan(df: DataFrame) -> DataFrame:
    """NaN -> null on every floating column (one rule for the whole engine)."""
    return df.select(*[F.when(~F.isnan(F.col(f.name)), F.col(f.name)).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


PROFILE_CHUNK = 25   # columns per profile aggregate (about 100 aggregate expressions)


def null_fractions(df: DataFrame, chunk: int = PROFILE_CHUNK) -> dict[str, tuple]:
    """Column profile: ``(null count, rows, valid numbers, min, max)`` per
    column; the last three only for numeric columns (NaN counts as missing).

    One aggregate per chunk of columns keeps each generated method small on
    wide tables; each chunk reads only its own Parquet columns, so the chunks
    together read the table once.
    """
    out = {}
    fields = df.schema.fields
    for start in range(0, max(1, len(fields)), chunk):
        part = fields[start:start + chunk]
        aggs = [F.count(F.lit(1)).alias("_rows")]
        numeric = set()
        for i, f in enumerate(part):
            c = F.col(f.name)
            aggs.append(F.count_if(c.isNull()).alias(f"_n{i}"))
            if isinstance(f.dataType, NUMERIC_TYPES):
                numeric.add(f.name)
                ok = F.when(~F.isnan(c.cast("double")), c.cast("double"))
                aggs += [F.count(ok).alias(f"_v{i}"), F.min(ok).alias(f"_lo{i}"),
                         F.max(ok).alias(f"_hi{i}")]
        row = df.agg(*aggs).first()
        for i, f in enumerate(part):
            if f.name in numeric:
                out[f.name] = (row[f"_n{i}"], row["_rows"], row[f"_v{i}"], row[f"_lo{i}"],
                               row[f"_hi{i}"])
            else:
                out[f.name] = (row[f"_n{i}"], row["_rows"], None, None, None)
    return out


def sparse_columns(df: DataFrame, threshold: float = 0.5,
                   profile: dict | None = None) -> list[str]:
    """Columns with null fraction strictly above ``threshold`` (never essentials)."""
    prof = profile or null_fractions(df)
    out = []
    for c, p in prof.items():
        nulls, rows = p[0], p[1]
        if rows > 0 and nulls / rows > threshold and c not in ESSENTIAL_COLUMNS:
            out.append(c)
    return out


def drop_sparse(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Drop sparse columns."""
    return df.drop(*sparse_columns(df, threshold))


def fit_imputation(df: DataFrame, key: str = KEY, label: str = LABEL,
                   impute_essential: bool = False, exact: bool = True,
                   profile: dict | None = None) -> list[tuple[str, str, object]]:
    """(column, method, value) for every column with nulls.

    Numbers: exact median (mean of the two middle values) found by rank
    selection over a stacked (column, value) projection, so no task holds a
    column's distinct values; ``exact=False`` uses ``percentile_approx``.
    Text: mode from a distributed (column, value) count, smallest value on
    ties, ``Unknown`` when the column has no values. NaN counts as missing.
    """
    prof = profile or null_fractions(df)
    skip = set() if impute_essential else {key, label}
    todo = [f for f in df.schema.fields if prof[f.name][0] > 0 and f.name not in skip]
    num = [f.name for f in todo if isinstance(f.dataType, NUMERIC_TYPES)]
    txt = [f.name for f in todo if not isinstance(f.dataType, NUMERIC_TYPES)]
    medians: dict = {}
    if num and not exact:
        row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, 100000).alias(c)
                       for c in num]).first()
        medians = {c: row[c] for c in num}
    elif num:
        stacked = _stack(df, num, "double")
        stacked = stacked.where(~F.isnan("v"))
        # valid counts and ranges come from the column profile (no extra pass)
        counts = {c: prof[c][2] for c in num}
        ranges = {c: (prof[c][3], prof[c][4]) for c in num}
        ranks = {c: sorted({(n - 1) // 2, n // 2}) for c, n in counts.items() if n > 0}
        found = values_at_ranks(stacked, "c", "v", ranks,
                                stats={c: (counts[c], *ranges[c]) for c in ranks})
        for c, n in counts.items():
            if n == 0:
                continue
            a, b = found[(c, (n - 1) // 2)], found[(c, n // 2)]
            medians[c] = a if a == b else a + (b - a) * 0.5
    modes: dict = {}
    if txt:
        stacked = _stack(df, txt, "string")
        best = (stacked.groupBy("c", "v").agg(F.count(F.lit(1)).alias("k"))
                .groupBy("c").agg(F.min(F.struct((-F.col("k")).alias("nk"), F.col("v"))).alias("b"))
                .collect())
        modes = {r["c"]: r["b"]["v"] for r in best}
    out = []
    for f in todo:
        if f.name in num:
            out.append((f.name, "median", medians.get(f.name)))
        else:
            out.append((f.name, "mode", modes.get(f.name, "Unknown")))
    return out


def _stack(df: DataFrame, cols: list[str], kind: str) -> DataFrame:
    """(c, v) rows for the non-null values of ``cols``."""
    kv = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast(kind).alias("v"))
                             for c in cols])).alias("_kv")
    return df.select(kv).select("_kv.c", "_kv.v").where(F.col("v").isNotNull())


def apply_imputation(df: DataFrame, fills: list[tuple[str, str, object]]) -> DataFrame:
    by = {c: v for c, _, v in fills}
    return df.select(*[
        F.coalesce(F.col(f.name), F.lit(by[f.name]).cast(f.dataType)).alias(f.name)
        if f.name in by and by[f.name] is not None else F.col(f.name)
        for f in df.schema.fields])


def handle_missing(df: DataFrame, threshold: float = 0.5, fit_on: DataFrame | None = None,
                   impute_essential: bool = False) -> tuple[DataFrame, list[str], list]:
    """Drop sparse columns, impute the rest. Returns (df, dropped, fills)."""
    df = normalise_nan(df)
    prof = null_fractions(df)
    dropped = sparse_columns(df, threshold, prof)
    kept = df.drop(*dropped)
    src = kept if fit_on is None else normalise_nan(fit_on).drop(*dropped)
    fills = fit_imputation(src, impute_essential=impute_essential,
                           profile=None if fit_on is not None else {c: prof[c] for c in kept.columns})
    return apply_imputation(kept, fills), dropped, fills


def imputation_stats(spark, dropped: list[str], fills: list) -> DataFrame:
    """One row per dropped or imputed column."""
    rows = [(c, "dropped", None, None) for c in dropped]
    rows += [(c, m, float(v) if m == "median" and v is not None else None,
              v if m == "mode" else None) for c, m, v in fills]
    schema = "column_name string, method string, value_num double, value_str string"
    return spark.createDataFrame(rows, schema)


# --- E5-E7: dictionary encoding ------------------------------------------------------------

def _long_values(df: DataFrame, cat_cols: list[str], group_col: str | None) -> DataFrame:
    g = [group_col] if group_col else []
    stacked = df.select(*g, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"),
                 F.coalesce(F.col(c).cast("string"), F.lit("Unknown")).alias("value"))
        for c in cat_cols])).alias("_kv"))
    return stacked.select(*g, "_kv.column_name", "_kv.value")


def fit_dictionary(train: DataFrame, cat_cols: list[str],
                   group_col: str | None = "bank_id") -> DataFrame:
    """E5: (group, column_name, value, code); null -> 'Unknown' before fitting;
    code = position in the sorted distinct values. Ranking runs over distinct
    values only, per (group, column); a near-unique column is split into
    sampled buckets (:func:`ordinal_codes`)."""
    g = [group_col] if group_col else []
    distinct = _long_values(train, cat_cols, group_col).select(*g, "column_name", "value").distinct()
    # small (distinct values only) and read by the size check and the encoder
    return ordinal_codes(distinct, [*g, "column_name"], "value").checkpoint(eager=True)


def extend_dictionary(known: DataFrame, rows: DataFrame, cat_cols: list[str],
                      group_col: str | None = "bank_id") -> DataFrame:
    """``known`` (group, column_name, value, code, version) and, with the next version,
    the values of ``rows`` that it does not hold. Existing codes stay; the new values of a
    (group, column) take the codes after its largest, in sorted order.

    New values are found by an anti join of distinct values, whatever the number of rows;
    a dictionary without a version column counts as version 1. A value known to an
    earlier version is never added again, so every version is part of the next.
    """
    g = [group_col] if group_col else []
    by = [*g, "column_name"]
    if "version" not in known.columns:
        known = known.withColumn("version", F.lit(1))
    distinct = _long_values(rows, cat_cols, group_col).select(*by, "value").distinct()
    # null groups are groups like any other on both sides
    held = known.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, "value"])])
    cond = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*by, "value"])]
    new = distinct.join(held, reduce(lambda a, b: a & b, cond), "left_anti").checkpoint(eager=True)
    used = known.groupBy(*[F.col(c).alias(f"_u{i}") for i, c in enumerate(by)]).agg((F.max("code") + 1).alias("_next"))
    version = known.agg(F.coalesce(F.max("version"), F.lit(0)) + 1).first()[0]
    same = [F.col(c).eqNullSafe(F.col(f"_u{i}")) for i, c in enumerate(by)]
    added = ordinal_codes(new, by, "value").join(
        F.broadcast(used), reduce(lambda a, b: a & b, same), "left").select(     # a row per (group, column)
        *by, "value", (F.col("code") + F.coalesce("_next", F.lit(0))).cast("long").alias("code"),
        F.lit(int(version)).alias("version"))
    return known.select(*by, "value", F.col("code").cast("long").alias("code"),
                        F.col("version").cast("int").alias("version")).unionByName(added)


def transform_codes(df: DataFrame, dictionary: DataFrame, cat_cols: list[str],
                    group_col: str | None = "bank_id",
                    broadcast_limit: int = BROADCAST_DICT_ROWS) -> DataFrame:
    """Replace categories by codes; unseen -> code of 'Unknown' if known,
    else 0.

    Every column is a hash join on (group, value): with at most
    ``broadcast_limit`` dictionary entries the dictionary is broadcast (no
    shuffle of the data), above it the join shuffles. Null counts as 'Unknown'.
    """
    g = [group_col] if group_col else []
    small = dictionary.count() <= broadcast_limit
    out = df
    for c in cat_cols:
        d = dictionary.where(F.col("column_name") == c)
        dc = d.select(*[F.col(x).alias(f"_g_{x}") for x in g], F.col("value").alias("_v"),
                      F.col("code").alias("_c"))
        unk = d.where(F.col("value") == "Unknown").select(
            *[F.col(x).alias(f"_h_{x}") for x in g], F.col("code").alias("_u"))
        if small:
            dc, unk = F.broadcast(dc), F.broadcast(unk)
        out = out.withColumn("_k", F.coalesce(F.col(c).cast("string"), F.lit("Unknown")))
        on = reduce(lambda a, b: a & b, [F.col(x) == F.col(f"_g_{x}") for x in g],
                    F.col("_k") == F.col("_v"))
        out = out.join(dc, on, "left")
        if g:
            out = out.join(unk, reduce(lambda a, b: a & b,
                                       [F.col(x) == F.col(f"_h_{x}") for x in g]), "left")
            unknown = F.col("_u")
        else:
            # without groups there is at most one 'Unknown' code per column
            row = d.where(F.col("value") == "Unknown").select("code").first()
            unknown = F.lit(row[0] if row else None).cast("long")
        out = out.withColumn(c, F.coalesce("_c", unknown, F.lit(0).cast("long")))
        out = out.drop("_k", "_v", "_c", "_u", *[f"_g_{x}" for x in g], *[f"_h_{x}" for x in g])
    return out


def encoding_stats(dictionary: DataFrame, group_col: str | None = "bank_id",
                   first: int = 10) -> DataFrame:
    """Number of classes and the first ``first`` classes per (group, column)."""
    g = [group_col] if group_col else []
    return dictionary.groupBy(*g, "column_name").agg(
        F.count(F.lit(1)).alias("unique_values"),
        F.array_join(F.slice(F.array_sort(F.collect_list("value")), 1, first), ",")
        .alias("classes"))


# --- E8/E9: scaling -------------------------------------------------------------------------

def fit_scaler(train: DataFrame, cols: list[str], group_col: str | None = None) -> DataFrame:
    """Mean and population sd per column (sd 0 or null -> 1), one aggregate."""
    g = [group_col] if group_col else []
    agg = train.groupBy(*g).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols],
                                *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    return agg.select(*g, *[F.col(f"_m_{c}") for c in cols], *[
        F.when((F.col(f"_s_{c}") == 0) | F.col(f"_s_{c}").isNull(), F.lit(1.0))
        .otherwise(F.col(f"_s_{c}")).alias(f"_s_{c}") for c in cols])


def standardize(df: DataFrame, scaler: DataFrame, cols: list[str],
                group_col: str | None = None) -> DataFrame:
    """(x - mean) / sd with the fitted values (one row per group, broadcast)."""
    g = [group_col] if group_col else []
    if g:
        j = df.join(F.broadcast(scaler), g, "left")
    else:   # one fitted row: use its values as literals
        row = scaler.first()
        j = df.select("*", *[F.lit(row[f"_{k}_{c}"]).alias(f"_{k}_{c}") for c in cols for k in "ms"])
    return j.select(*[((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).alias(c) if c in cols
                      else F.col(c) for c in df.columns])


def range_report(before: DataFrame, after: DataFrame, cols: list[str]) -> DataFrame:
    """min/max before scaling and mean/sd after, per column (long form)."""
    b = before.agg(*[F.min(c).alias(f"_lo{i}") for i, c in enumerate(cols)],
                   *[F.max(c).alias(f"_hi{i}") for i, c in enumerate(cols)])
    a = after.agg(*[F.avg(c).alias(f"_mu{i}") for i, c in enumerate(cols)],
                  *[F.stddev_pop(c).alias(f"_sd{i}") for i, c in enumerate(cols)])
    parts = ", ".join(f"'{c}', cast(_lo{i} as double), cast(_hi{i} as double), _mu{i}, _sd{i}"
                      for i, c in enumerate(cols))
    return combine_one_row(b, a).selectExpr(
        f"stack({len(cols)}, {parts}) as (column_name, min_before, max_before, mean_after, sd_after)")


# --- E10: full preparation --------------------------------------------------------------------

def preprocess_full(tx: DataFrame, ident: DataFrame, num_banks: int = 3,
                    ratios: tuple[float, float, float] = (0.8, 0.1, 0.1),
                    threshold: float = 0.5,
                    cut_lineage: bool = True) -> tuple[DataFrame, DataFrame, dict]:
    """C1 -> E1..E3 -> D4 -> D6 -> E5/E6 per bank (fit on each bank's train).

    Returns (prepared rows with bank_id and split, dictionary, stats). The only
    actions are the null/median/mode profile, the split cuts and the
    dictionary size check; everything else stays one lazy plan.
    """
    merged = merge_identity(tx, ident)
    if cut_lineage:
        # the join feeds the profile, median, mode, cut and dictionary passes:
        # write it once as Parquet in the shared checkpoint folder, so every
        # later pass reads only the columns it needs
        from fraudlake.session import scratch_path
        spark = merged.sparkSession
        path = scratch_path(spark, "merged")
        merged.write.mode("overwrite").parquet(path)
        merged = spark.read.parquet(path)
    filled, dropped, fills = handle_missing(merged, threshold)
    banked = bank_partition(filled, num_banks=num_banks)
    split = temporal_split(banked, *ratios)
    cat, _ = feature_roles(split)
    cat = [c for c in cat if c in KNOWN_CATEGORICAL or
           isinstance(split.schema[c].dataType, T.StringType)]
    dictionary = fit_dictionary(split.where(F.col("split") == "train"), cat, "bank_id")
    encoded = transform_codes(split, dictionary, cat, "bank_id")
    return encoded, dictionary, {"dropped": dropped, "fills": fills, "categorical": cat}


# --- D3, D8-D15: features, class weights, sampling ----------------------------------------

def assemble(df: DataFrame, cat_cols: list[str], num_cols: list[str], key: str = KEY,
             label: str = LABEL) -> DataFrame:
    """D3: categorical codes and numeric features as two arrays, target (missing -> 0)."""
    target = (F.coalesce(F.col(label).cast("double"), F.lit(0.0)) if label in df.columns
              else F.lit(0.0))
    return df.select(
        key, *([c for c in ("bank_id", "split") if c in df.columns]),
        F.array(*[F.col(c).cast("long") for c in cat_cols]).alias("categorical"),
        F.array(*[F.col(c).cast("double") for c in num_cols]).alias("numerical"),
        target.alias("target"))


def class_weights(df: DataFrame, label: str = LABEL, group_col: str | None = "bank_id") -> DataFrame:
    """w_c = N / (2 n_c) (1.0 when a class is absent) and pos_weight = w1/w0."""
    g = [group_col] if group_col else []
    agg = df.groupBy(*g).agg(F.count(F.lit(1)).alias("n"),
                             F.count_if(F.col(label) == 0).alias("n_0"),
                             F.count_if(F.col(label) == 1).alias("n_1"))
    n = F.col("n").cast("double")
    w0 = F.when(F.col("n_0") > 0, n / (F.lit(2.0) * F.col("n_0"))).otherwise(F.lit(1.0))
    w1 = F.when(F.col("n_1") > 0, n / (F.lit(2.0) * F.col("n_1"))).otherwise(F.lit(1.0))
    return agg.select(*g, "n", "n_0", "n_1", w0.alias("weight_0"), w1.alias("weight_1"),
                      (w1 / w0).alias("pos_weight"))


def row_weights(df: DataFrame, weights: DataFrame | None, label: str = LABEL,
                group_col: str | None = "bank_id") -> DataFrame:
    """Each row gets its class weight (all 1.0 without a label column).

    ``weights`` has one row per group (bounded by the number of banks), so it
    is broadcast.
    """
    if label not in df.columns or weights is None:
        return df.withColumn("sample_weight", F.lit(1.0))
    g = [group_col] if group_col else []
    w = weights.select(*g, "weight_0", "weight_1")
    if g:
        j = df.join(F.broadcast(w), g, "left")
    else:   # one row of weights: literals
        row = w.first()
        j = df.select("*", F.lit(row["weight_0"]).alias("weight_0"),
                      F.lit(row["weight_1"]).alias("weight_1"))
    return j.withColumn("sample_weight", F.when(F.col(label) == 1, F.col("weight_1"))
                        .otherwise(F.col("weight_0"))).drop("weight_0", "weight_1")


HASH_RANGE = 16 ** 15


def hash_key(key: str, seed) -> Column:
    """60-bit portable hash order key from md5 (same in DuckDB)."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))),
                              1, 15), 16, 10)
    return bits.cast("long")


# largest uniform the md5 draw can produce: (2^32 - 0.5) / 2^32
U_MAX = (4294967296.0 - 0.5) / 4294967296.0


def poisson_cdf(lam: float) -> list[float]:
    """Cumulative Poisson probabilities that a uniform draw can still fall
    above (values >= the largest possible uniform never count)."""
    import math
    kmax = int(math.ceil(lam + 12.0 * math.sqrt(lam) + 12.0))
    out, acc = [], 0.0
    for k in range(kmax + 1):
        acc += math.exp(k * math.log(lam) - lam - math.lgamma(k + 1)) if lam > 0 else (
            1.0 if k == 0 else 0.0)
        if acc >= U_MAX:
            break
        out.append(acc)
    return out


def balanced_resample(df: DataFrame, label: str = LABEL, group_col: str | None = "bank_id",
                      key: str = KEY, seed: int = 42) -> DataFrame:
    """Class-balanced draw with replacement, expected N rows per group.

    Row i is repeated Poisson(w_i * N / sum(w)) times. The rate depends only on
    (group, class), so the inverse CDF per rate is a short literal list; the
    draw is the number of CDF values below u (u from md5(key, seed)); values no
    uniform can exceed are dropped, so the list is short.
    Deterministic under any partitioning; the groups' counts are collected
    (one row per group).
    """
    cw = class_weights(df, label, group_col).collect()
    g = [group_col] if group_col else []
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))),
                            1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    # draw = number of reachable CDF values below u (a short literal list per
    # (group, class); the lists stay data, so the generated code stays small)
    cdf_expr = F.array().cast("array<double>")
    for r in cw:
        sw = r["n_0"] * r["weight_0"] + r["n_1"] * r["weight_1"]
        for cls in (0, 1):
            lam = r[f"weight_{cls}"] * r["n"] / sw if sw > 0 else 0.0
            cond = F.col(label) == cls
            if g:
                cond = cond & (F.col(group_col) == F.lit(r[group_col]))
            arr = F.array(*[F.lit(float(c)) for c in poisson_cdf(lam)]).cast("array<double>")
            cdf_expr = F.when(cond, arr).otherwise(cdf_expr)
    draws = F.size(F.filter(cdf_expr, lambda c: c < F.col("_u")))
    with_d = df.withColumn("_u", u).withColumn("_draws", draws).drop("_u")
    return (with_d.where(F.col("_draws") > 0)
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_draws"))))
            .drop("_draws"))


def minibatch_ids(df: DataFrame, batch_size: int, group_col: str = "bank_id", key: str = KEY,
                  seed: int = 42) -> DataFrame:
    """Shuffled batches of ``batch_size`` per group; the incomplete last
    batch is dropped. The shuffle order is a hash of the key. The hash is
    uniform, so its range is cut into equal buckets: bucket counts give offsets
    and one window per (group, bucket) ranks the rows - a single shuffle of them."""
    buckets = 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    h = df.withColumn("_h", hash_key(key, seed))
    h = h.withColumn("_b", F.floor(F.col("_h") / F.lit(HASH_RANGE // buckets + 1)).cast("int"))
    per = h.groupBy(group_col, "_b").agg(F.count(F.lit(1)).alias("_c"))
    # groups x buckets rows
    w_off = Window.partitionBy(group_col).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(
        F.col(group_col).alias("_g"), F.col("_b").alias("_ob"),
        F.coalesce(F.sum("_c").over(w_off), F.lit(0)).alias("_before"),
        F.sum("_c").over(Window.partitionBy(group_col)).alias("_n"))
    w_in = Window.partitionBy(group_col, "_b").orderBy("_h", key)
    ranked = (h.withColumn("_r", F.row_number().over(w_in) - 1)
              .join(offsets, F.col(group_col).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_ob"))))
    batch = F.floor((F.col("_before") + F.col("_r")) / F.lit(batch_size)).cast("long")
    full = F.floor(F.col("_n") / F.lit(batch_size))
    return (ranked.withColumn("batch_id", batch).where(F.col("batch_id") < full)
            .select(*df.columns, "batch_id"))


def background_sample(df: DataFrame, n: int = 100, key: str = KEY, seed: int = 42) -> DataFrame:
    """``n`` rows in hash order (a top-n: TakeOrderedAndProject, no full sort)."""
    return df.withColumn("_h", hash_key(key, seed)).orderBy("_h", key).limit(n).drop("_h")


def embedding_dims(df: DataFrame, cat_cols: list[str], max_dim: int = 50) -> DataFrame:
    """vocab = max(code) + 1; dim = min(max_dim, max(1, vocab div 2)); one aggregate."""
    row = df.agg(*[F.max(F.col(c).cast("long")).alias(c) for c in cat_cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cat_cols)
    long = row.selectExpr(f"stack({len(cat_cols)}, {stack}) as (column_name, max_code)")
    vocab = F.col("max_code") + 1
    return long.select("column_name", vocab.alias("vocab"),
                       F.least(F.lit(max_dim), F.greatest(F.lit(1), F.floor(vocab / 2)))
                       .cast("long").alias("dim"))


def dataset_info(df: DataFrame, cat_cols: list[str], num_cols: list[str], label: str = LABEL,
                 group_col: str = "bank_id") -> DataFrame:
    """Feature counts, samples, fraud rate, class distribution per group."""
    return df.groupBy(group_col).agg(
        F.lit(len(cat_cols)).alias("n_categorical"), F.lit(len(num_cols)).alias("n_numerical"),
        F.count(F.lit(1)).alias("samples"),
        F.avg(F.col(label).cast("double")).alias("fraud_rate"),
        F.count_if(F.col(label) == 0).alias("class_0"),
        F.count_if(F.col(label) == 1).alias("class_1"))
