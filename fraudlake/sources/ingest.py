"""Sources and sinks: typed reads, raw-record checks, quarantine, retention,
split outputs, dictionary tables, reports and round state (SURVEY 2.1)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudlake.session import path_exists
from fraudlake.operators.quality import IDENTITY_TYPES, TRANSACTION_TYPES, coerce_types


def detect_kind(path: str, columns: list[str]) -> str:
    """A2: ``transaction`` / ``identity`` from the file name, else from the header."""
    name = os.path.basename(path).lower()
    if "transaction" in name:
        return "transaction"
    if "identity" in name:
        return "identity"
    if "isFraud" in columns:
        return "transaction"
    if "DeviceType" in columns:
        return "identity"
    raise ValueError(f"Cannot determine dataset kind for {path}")


def read_table(spark: SparkSession, path: str, kind: str | None = None,
               int_null: str = "null", fmt: str | None = None) -> DataFrame:
    """A1: read CSV (header, all text) or Parquet and apply the declared types.

    CSV is read with an all-string schema taken from the header line, so no
    inference pass runs over the data. Lines with more fields than the header
    are left out (:func:`bad_rows` reports them); shorter ones are padded with
    nulls. Input that is not valid UTF-8 throughout is read as Latin-1.
    ``fmt`` defaults to the file suffix, or for a folder to whether it holds
    ``.csv`` files.
    """
    fmt = fmt or ("parquet" if path.endswith(".parquet") else
                  "csv" if path.endswith(".csv") or _has_csv(spark, path) else "parquet")
    if fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        df = _read_csv(spark, path)
    kind = kind or detect_kind(path, df.columns)
    spec = TRANSACTION_TYPES if kind == "transaction" else IDENTITY_TYPES
    return coerce_types(df, spec, int_null=int_null)


def csv_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8, or ISO-8859-1 as soon as one line is not valid UTF-8."""
    lines = spark.read.text(path)
    odd = lines.where(~F.is_valid_utf8("value")).limit(1).count()
    return "ISO-8859-1" if odd else "UTF-8"


def _read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All fields as text, from the lines that have no more fields than the header."""
    encoding = csv_encoding(spark, path)
    header = spark.read.option("header", "true").option("encoding", encoding).csv(path).columns
    line = F.col("value") if encoding == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    lines = spark.read.text(path).select(line.alias("line")).where(F.length(F.trim("line")) > 0) \
        .where(F.col("line") != F.lit(sep.join(header)))
    lines = lines.where(F.size(F.split("line", _field_split(sep), -1)) <= len(header))
    schema = ", ".join(f"`{c}` string" for c in header)
    return lines.select(F.from_csv("line", schema, {"sep": sep}).alias("r")).select("r.*")


def _field_split(sep: str) -> str:
    """Separators outside double quotes."""
    return sep + '(?=(?:[^"]*"[^"]*")*[^"]*$)'


def read_folder(spark: SparkSession, folder: str, int_null: str = "null") -> dict:
    """A1/A2 over a folder: every CSV or Parquet file is typed by its detected
    kind; files of one kind are unioned by column name. Returns
    ``{kind: DataFrame}``. Listing uses the cluster file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out: dict = {}
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith((".", "_")) or not name.endswith((".csv", ".parquet")):
            continue
        path = st.getPath().toString()
        df = read_table(spark, path, int_null=int_null,
                        fmt="parquet" if name.endswith(".parquet") else "csv")
        kind = detect_kind(path, df.columns)
        out[kind] = df if kind not in out else out[kind].unionByName(df, allowMissingColumns=True)
    return out


def _has_csv(spark: SparkSession, path: str) -> bool:
    """Does the folder hold CSV part files (checked on the cluster file system)?"""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p) or not fs.getFileStatus(p).isDirectory():
        return False
    return any(st.getPath().getName().endswith(".csv") for st in fs.listStatus(p))


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", "true").csv(path)
    return path


def field_counts(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A3 helper: raw lines with their field count (quote-aware split)."""
    split_re = _field_split(sep)
    return spark.read.text(path).select(
        F.col("value").alias("line"), F.size(F.split("value", split_re, -1)).alias("n_fields"))


def bad_rows(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A3: lines with more fields than the header (pandas skips them; shorter
    lines are padded with nulls and kept). Header lines of every part file
    are excluded."""
    header = spark.read.option("header", "true").csv(path).columns
    header_line = sep.join(header)
    lines = field_counts(spark, path, sep).where(F.col("line") != F.lit(header_line))
    return lines.where(F.col("n_fields") > len(header)).withColumn(
        "reason", F.lit("too_many_fields"))


def quarantine_rows(reasons: DataFrame, raw_cols: list[str], identifier: str = "line_no",
                    ts_col: str = "received_at") -> DataFrame:
    """A4: rejected records as (payload, reason, identifier, ts, date)."""
    payload = F.concat_ws("|", *[F.coalesce(F.col(f"raw_{c}").cast("string"), F.lit(""))
                                 for c in raw_cols])
    return reasons.where(F.col("reject_reason").isNotNull()).select(
        payload.alias("payload"), F.col("reject_reason").alias("reason"),
        F.col(identifier).cast("long").alias("identifier"),
        F.col(ts_col).alias("ts"), F.to_date(F.col(ts_col)).alias("date"))


def write_quarantine(bad: DataFrame, path: str) -> None:
    """Append to the quarantine table, one folder per month (the row keeps its
    date; retention works on dates, deletion on month folders).

    The REBALANCE hint lets AQE group rows by month (few files per folder)
    while still splitting a month that holds a large share of the rows.
    """
    out = bad.withColumn("month", F.date_format("date", "yyyy-MM"))
    out.hint("rebalance", "month").write.mode("append").partitionBy("month").parquet(path)


def quarantine_retention(q: DataFrame, cap_bytes: int) -> DataFrame:
    """A5: keep the newest date partitions while their running size <= cap.

    Works on partition sizes (one row per date), not on rows.
    """
    sizes = q.groupBy("date").agg(F.sum(F.length("payload")).alias("bytes"),
                                  F.count(F.lit(1)).alias("records"))
    w = Window.orderBy(F.col("date").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = sizes.withColumn("running_bytes", F.sum("bytes").over(w))
    return ranked.withColumn("keep", F.col("running_bytes") <= F.lit(cap_bytes))


def apply_retention(spark: SparkSession, path: str, keep: DataFrame, part_col: str = "month",
                    manifest: str | None = None) -> list[str]:
    """A5/A6 that act: delete the partition folders of the table at ``path`` that hold no
    kept row. ``keep`` has a row per partition to keep (column ``part_col``).

    Two steps, so that a crash leaves whole partitions only: first the doomed partitions
    are written to a manifest beside the table, then each is moved out of the table's view
    (a name with a leading underscore and no ``=``, which readers skip) and deleted. A call that finds a
    manifest of an earlier one finishes that first; each step can be repeated. Returns
    the partitions removed.
    """
    manifest = manifest or path.rstrip("/") + "-retention"
    removed = _finish_retention(spark, path, part_col, manifest) if path_exists(spark, manifest) else []
    there = spark.read.parquet(path).select(F.col(part_col).cast("string").alias("part")).distinct()
    kept = keep.select(F.col(part_col).cast("string").alias("part")).distinct()
    doomed = there.join(kept, "part", "left_anti")
    doomed.coalesce(1).write.mode("overwrite").parquet(manifest)
    return removed + _finish_retention(spark, path, part_col, manifest)


def _finish_retention(spark: SparkSession, path: str, part_col: str, manifest: str) -> list[str]:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")           # noqa: E731
    fs = folder("x").getFileSystem(conf)
    # a manifest without its success mark was never finished: nothing has been removed for it
    if not path_exists(spark, f"{manifest}/_SUCCESS"):
        fs.delete(jvm.org.apache.hadoop.fs.Path(manifest), True)
        return []
    parts = sorted(r.part for r in spark.read.parquet(manifest).collect() if r.part is not None)
    for part in parts:
        live, gone = folder(f"{part_col}={part}"), folder(f"_gone-{part_col}-{part}")
        if fs.exists(live):
            fs.rename(live, gone)
        fs.delete(gone, True)
    fs.delete(jvm.org.apache.hadoop.fs.Path(manifest), True)
    return parts


def age_retention(catalog: DataFrame, now, short_days: int = 7, long_days: int = 30,
                  short_kinds: tuple[str, ...] = ("checkpoint", "model")) -> DataFrame:
    """Items younger than their kind's limit are kept (``now`` is a parameter)."""
    days = F.when(F.col("kind").isin(*short_kinds), F.lit(short_days)).otherwise(F.lit(long_days))
    limit = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(days)
    return catalog.withColumn("keep", F.col("mtime") >= limit)


def retained(catalog: DataFrame, now, short_days: int = 7, long_days: int = 30,
             short_kinds: tuple[str, ...] = ("checkpoint", "model")) -> DataFrame:
    """Only the items kept. The loosest limit is added as a plain range
    condition on ``mtime`` so it reaches the Parquet scan as a pushed filter."""
    floor = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(
        F.lit(max(short_days, long_days)))
    kept = age_retention(catalog.where(F.col("mtime") >= floor), now, short_days, long_days,
                         short_kinds)
    return kept.where("keep").drop("keep")


def write_splits(df: DataFrame, path: str) -> str:
    """One folder per (bank_id, split)."""
    df.hint("rebalance", "bank_id", "split").write.mode("overwrite") \
        .partitionBy("bank_id", "split").parquet(path)
    return path


def save_dictionary(dictionary: DataFrame, path: str) -> str:
    """Persist an encoder table (bank_id, column_name, value, code)."""
    dictionary.write.mode("overwrite").parquet(path)
    return path


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def json_report(df: DataFrame, key_cols: list[str]) -> DataFrame:
    """One JSON document per key with every other column nested (null
    fields kept, so every document has the same keys)."""
    others = [c for c in df.columns if c not in key_cols]
    return df.select(*key_cols, F.to_json(F.struct(*others), {"ignoreNullFields": "false"})
                     .alias("report"))


def save_round_state(state: DataFrame, path: str) -> None:
    """A10: append checkpoint rows (run, round, completed, history)."""
    state.write.mode("append").parquet(path)


def resume_point(spark: SparkSession, path: str, run_col: str = "client_id") -> DataFrame:
    """A10: latest saved round per run."""
    st = spark.read.parquet(path)
    return st.groupBy(run_col).agg(F.max_by(F.struct(*[c for c in st.columns if c != run_col]),
                                            F.col("checkpoint_round")).alias("_s")) \
        .select(run_col, "_s.*")
