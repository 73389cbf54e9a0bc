"""Type correction, record filters and data-quality reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudlake.functions.frames import combine_one_row

# fixed value: accepted number text (after trimming); no backslashes so the
# same literal works in Spark and DuckDB
NUMBER_PATTERN = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
LONG_LIMIT = 9.2e18

# fixed values: declared types of the transaction table (others keep their type)
TRANSACTION_TYPES = {
    "TransactionID": "int64", "isFraud": "int8", "TransactionDT": "int64",
    "TransactionAmt": "float64", "ProductCD": "category", "card1": "int64",
    "card2": "float64", "card3": "float64", "card4": "category", "card5": "float64",
    "card6": "category", "addr1": "float64", "addr2": "float64", "dist1": "float64",
    "dist2": "float64", "P_emaildomain": "category", "R_emaildomain": "category",
}
# fixed values: declared types of the identity table
IDENTITY_TYPES = {
    "TransactionID": "int64",
    "id_01": "float64", "id_02": "float64", "id_03": "float64", "id_04": "float64",
    "id_05": "float64", "id_06": "float64", "id_07": "float64", "id_08": "float64",
    "id_09": "float64", "id_10": "float64", "id_11": "category", "id_12": "category",
    "id_13": "float64", "id_14": "float64", "id_15": "category", "id_16": "category",
    "id_17": "float64", "id_18": "float64", "id_19": "float64", "id_20": "category",
    "DeviceType": "category", "DeviceInfo": "category",
}


def parse_number(c: Column) -> Column:
    """Text -> double; anything that is not a plain decimal number -> null."""
    t = F.trim(c.cast("string"))
    return F.when(t.rlike(NUMBER_PATTERN), t.try_cast("double"))


def to_long(d: Column) -> Column:
    """Double -> bigint truncating toward zero; out of range -> null."""
    return F.when(F.abs(d) < F.lit(LONG_LIMIT), d.cast("long"))


def coerce_expr(name: str, kind: str | None, int_null: str = "null") -> Column:
    """Typed value of column ``name`` for a declared kind (None: unchanged)."""
    c = F.col(name)
    if kind is None:
        return c
    if kind == "category":
        return c.cast("string").alias(name)
    d = parse_number(c)
    if kind == "float64":
        return d.alias(name)
    v = to_long(d)
    if int_null == "zero":
        v = F.coalesce(v, F.lit(0).cast("long"))
    return (v.cast("int") if kind == "int8" else v).alias(name)


def coerce_types(df: DataFrame, spec: dict[str, str] | None = None,
                 int_null: str = "null") -> DataFrame:
    """B1: apply declared types to the columns present; keep the others.

    Numbers go through the guarded double parse; integers truncate. With
    ``int_null="zero"`` missing integers become 0 (reference behaviour).
    """
    spec = TRANSACTION_TYPES if spec is None else spec
    return df.select(*[coerce_expr(n, spec.get(n), int_null) for n in df.columns])


def drop_empty_rows(df: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """B2: drop rows whose columns (except ``ignore``) are all null."""
    return df.dropna(how="all", subset=[c for c in df.columns if c not in ignore])


def require_key(df: DataFrame, key: str = "TransactionID") -> DataFrame:
    """Key not null."""
    if key not in df.columns:
        raise ValueError(f"Missing required column: {key}")
    return df.where(F.col(key).isNotNull())


def label_domain(df: DataFrame, label: str = "isFraud") -> DataFrame:
    """Keep labels 0 and 1 (checked before any narrowing)."""
    return df.where(F.col(label).isin(0, 1)) if label in df.columns else df


def dedup_first(df: DataFrame, key: str = "TransactionID", order_by: str = "line_no") -> DataFrame:
    """First row per key by an explicit order column.

    ``min_by`` over a struct aggregates partially on the map side, so a key
    holding a large share of rows is reduced before the shuffle.
    """
    others = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min_by(F.struct(*others), F.col(order_by)).alias("_r"))
    return first.select(key, *[F.col(f"_r.{c}").alias(c) for c in others])


def clean_records(df: DataFrame, key: str = "TransactionID", label: str = "isFraud",
                  order_by: str = "line_no") -> DataFrame:
    """B2-B5 in reference order."""
    d = drop_empty_rows(df, ignore=(order_by,))
    d = label_domain(require_key(d, key), label)
    return dedup_first(d, key, order_by)


def cleaning_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before/after, removed rows and percent (null when empty)."""
    b = before.agg(F.count(F.lit(1)).alias("initial_rows"))
    a = after.agg(F.count(F.lit(1)).alias("final_rows"))
    return combine_one_row(b, a).select(
        "initial_rows", "final_rows",
        (F.col("initial_rows") - F.col("final_rows")).alias("rows_removed"),
        F.try_divide((F.col("initial_rows") - F.col("final_rows")) * 100.0,
                     F.col("initial_rows")).alias("removed_percent"))


def null_profile(df: DataFrame, chunk: int = 80) -> DataFrame:
    """(column, null_count, rows) in long form.

    One aggregate per chunk of columns (codegen stops near 100 fields); every
    chunk is one scan with map-side partial counts.
    """
    cols = df.columns
    parts = []
    for i in range(0, len(cols), chunk):
        group = cols[i:i + chunk]
        wide = df.agg(F.count(F.lit(1)).alias("_rows"),
                      *[F.count_if(F.col(c).isNull()).alias(f"_n{j}") for j, c in enumerate(group)])
        stack = ", ".join(f"'{c}', _n{j}" for j, c in enumerate(group))
        parts.append(wide.selectExpr(f"stack({len(group)}, {stack}) as (column_name, null_count)",
                                     "_rows as rows"))
    return reduce(DataFrame.unionByName, parts)


def nonfinite_to_num(df: DataFrame, cols: list[str]) -> DataFrame:
    """NaN or null -> 0, +inf -> 1e6, -inf -> -1e6."""
    def fix(c):
        x = F.col(c).cast("double")
        return (F.when(x.isNull() | F.isnan(x), F.lit(0.0))
                .when(x == F.lit(float("inf")), F.lit(1e6))
                .when(x == F.lit(float("-inf")), F.lit(-1e6)).otherwise(x)).alias(c)
    return df.select(*[fix(c) if c in cols else F.col(c) for c in df.columns])


def integrity_report(df: DataFrame, key: str = "TransactionID", label: str = "isFraud",
                     required: tuple[str, ...] = ("TransactionID", "isFraud")) -> DataFrame:
    """Totals, column count, required-column errors, duplicate keys
    (``n - distinct``, null counted as one value), label distribution and
    fraud % over all rows (null when there are no rows)."""
    missing = [c for c in required if c not in df.columns]
    n_cols = len(df.columns)
    agg = df.agg(
        F.count(F.lit(1)).alias("total_records"),
        (F.count(F.lit(1)) - F.count_distinct(F.col(key))
         - F.when(F.count_if(F.col(key).isNull()) > 0, 1).otherwise(0)).alias("duplicate_ids"),
        F.count_if(F.col(label) == 0).alias("label_0"),
        F.count_if(F.col(label) == 1).alias("label_1"))
    return agg.select(
        "total_records", F.lit(n_cols).alias("n_columns"),
        F.lit(",".join(missing)).alias("missing_required"),
        "duplicate_ids", "label_0", "label_1",
        F.try_divide(F.col("label_1") * 100.0, F.col("total_records")).alias("fraud_rate_percent"))


def early_reasons(records: DataFrame, spec: dict[str, str] | None = None, key: str = "TransactionID",
                  label: str = "isFraud", order_by: str = "line_no", carry: tuple[str, ...] = ()) -> DataFrame:
    """Raw and typed values and ``_early``, the reason that a record has by itself (all of
    :func:`reject_reasons` but duplicate_key); one projection, so a stream can take it too."""
    spec = TRANSACTION_TYPES if spec is None else spec
    data_cols = [c for c in records.columns if c != order_by and c not in carry]
    t = records.select(order_by, *carry, *[F.col(c).alias(f"raw_{c}") for c in data_cols],
                       *[coerce_expr(c, spec.get(c)) for c in data_cols])
    empty = reduce(lambda a, b: a & b, [F.col(f"raw_{c}").isNull() for c in data_cols])
    return t.withColumn("_early", F.when(empty, F.lit("empty_row"))
                        .when(F.col(key).isNull(), F.lit("missing_key"))
                        .when(~F.coalesce(F.col(label).isin(0, 1), F.lit(False)), F.lit("bad_label")))


def reject_reasons(records: DataFrame, spec: dict[str, str] | None = None,
                   key: str = "TransactionID", label: str = "isFraud",
                   order_by: str = "line_no", carry: tuple[str, ...] = ()) -> DataFrame:
    """Reason per record, in the order the reference filters act:
    empty_row, missing_key, bad_label, duplicate_key; null = accepted.

    ``records`` holds the raw text columns (plus ``order_by`` and ``carry``
    columns passed through). Raw and typed values come from one projection
    (no self-join). The first line per key is found with an aggregate
    (partial on the map side, so a hot key is pre-reduced) and joined back.
    """
    t = early_reasons(records, spec, key, label, order_by, carry)
    firsts = (t.where(F.col("_early").isNull()).groupBy(key)
              .agg(F.min(order_by).alias("_first")))
    t = t.join(firsts, key, "left")
    reason = F.coalesce(F.col("_early"), F.when(F.col(order_by) != F.col("_first"),
                                                F.lit("duplicate_key")))
    return t.withColumn("reject_reason", reason).drop("_early", "_first")


def error_log(raw: DataFrame, reasons: DataFrame, number_cols: list[str],
              order_by: str = "line_no") -> DataFrame:
    """Counts per reason: rejected records plus unparseable numbers per column."""
    rej = reasons.where(F.col("reject_reason").isNotNull()).groupBy(
        F.col("reject_reason").alias("reason")).agg(F.count(F.lit(1)).alias("records"))
    parse = []
    for c in number_cols:
        bad = F.col(c).isNotNull() & parse_number(F.col(c)).isNull()
        parse.append(raw.agg(F.count_if(bad).alias("records"))
                     .select(F.lit(f"unparseable_{c}").alias("reason"), "records"))
    return reduce(DataFrame.unionByName, [rej, *parse])


def dataset_checks(df: DataFrame, feature_cols: list[str], label: str = "isFraud",
                   group_cols: list[str] | None = None, min_rows: int = 100,
                   rate_bounds: tuple[float, float] = (0.001, 0.999)) -> DataFrame:
    """NaN/Inf present, enough rows, fraud rate in bounds, features > 0;
    flags plus the list of issues (comma separated)."""
    g = list(group_cols or [])
    bad_val = reduce(lambda a, b: a | b,
                     [F.isnan(F.col(c)) | F.col(c).isin(float("inf"), float("-inf"))
                      for c in feature_cols], F.lit(False))
    agg = df.groupBy(*g).agg(F.count(F.lit(1)).alias("n_rows"),
                             F.count_if(bad_val).alias("nonfinite_rows"),
                             F.avg(F.col(label).cast("double")).alias("fraud_rate"))
    nf = len(feature_cols)
    checks = [
        (F.col("nonfinite_rows") > 0, "nan_or_inf"),
        (F.col("n_rows") < min_rows, "too_few_rows"),
        ((F.col("fraud_rate") < rate_bounds[0]) | (F.col("fraud_rate") > rate_bounds[1]),
         "fraud_rate_out_of_range"),
        (F.lit(nf == 0), "no_features"),
    ]
    issues = F.array_compact(F.array(*[F.when(c, F.lit(msg)) for c, msg in checks]))
    return agg.select(*g, "n_rows", "nonfinite_rows", "fraud_rate",
                      F.lit(nf).alias("n_features"),
                      F.array_join(issues, ",").alias("issues"),
                      (F.size(issues) == 0).alias("valid"))
