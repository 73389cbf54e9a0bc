"""Ingestion helpers: kind detection, typed CSV reads, raw-line checks, retention."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from fraudlake.sources import ingest as I


def test_detect_kind():
    assert I.detect_kind("/d/train_transaction.csv", []) == "transaction"
    assert I.detect_kind("/d/train_identity.csv", []) == "identity"
    assert I.detect_kind("/d/x.csv", ["TransactionID", "isFraud"]) == "transaction"
    assert I.detect_kind("/d/x.csv", ["TransactionID", "DeviceType"]) == "identity"
    with pytest.raises(ValueError):
        I.detect_kind("/d/x.csv", ["a"])


def _csv(lines):
    d = tempfile.mkdtemp(prefix="fraudlake-csv-")
    with open(os.path.join(d, "part-0.csv"), "w") as f:
        f.write("\n".join(lines) + "\n")
    return d


def test_read_typed_csv_and_int_null_option(spark):
    path = _csv(["TransactionID,isFraud,TransactionAmt,extra",
                 "1,0,12.5,a", "x,1,5d,b", ",,,", "4,1, 7 ,c"])
    rows = I.read_table(spark, path, kind="transaction").orderBy("extra").collect()
    assert [(r["TransactionID"], r["isFraud"], r["TransactionAmt"], r["extra"]) for r in rows] == [
        (None, None, None, None), (1, 0, 12.5, "a"), (None, 1, None, "b"), (4, 1, 7.0, "c")]
    zero = I.read_table(spark, path, kind="transaction", int_null="zero")
    assert zero.where(F.col("TransactionID") == 0).count() == 2


def test_bad_rows_only_longer_lines(spark):
    path = _csv(["a,b,c", "1,2,3", "1,2,3,4", "1,2", '1,"x,y",3'])
    bad = [r["line"] for r in I.bad_rows(spark, path).collect()]
    assert bad == ["1,2,3,4"]


def test_age_retention_rule(spark):
    now = "2024-03-31 00:00:00"
    t = dt.datetime(2024, 3, 31)
    cat = spark.createDataFrame(
        [(1, "checkpoint", t - dt.timedelta(days=6)), (2, "checkpoint", t - dt.timedelta(days=8)),
         (3, "log", t - dt.timedelta(days=29)), (4, "log", t - dt.timedelta(days=31)),
         (5, "model", t - dt.timedelta(days=7))], "item_id long, kind string, mtime timestamp_ntz")
    keep = {r["item_id"]: r["keep"] for r in I.age_retention(cat, now).collect()}
    assert keep == {1: True, 2: False, 3: True, 4: False, 5: True}


def test_quarantine_retention_keeps_newest_under_cap(spark):
    q = spark.createDataFrame([("x" * 10, dt.date(2024, 1, d)) for d in (1, 2, 2, 3, 3, 3)],
                              "payload string, date date")
    out = {r["date"].day: r["keep"] for r in I.quarantine_retention(q, 50).collect()}
    assert out == {3: True, 2: True, 1: False}


def test_read_folder_groups_files_by_kind(spark):
    d = tempfile.mkdtemp(prefix="fraudlake-folder-")
    with open(os.path.join(d, "train_transaction.csv"), "w") as f:
        f.write("TransactionID,isFraud,TransactionAmt\n1,0,5.0\n2,1,7.5\n")
    with open(os.path.join(d, "more.csv"), "w") as f:
        f.write("TransactionID,isFraud,TransactionAmt\n3,0,1.0\n")
    with open(os.path.join(d, "train_identity.csv"), "w") as f:
        f.write("TransactionID,DeviceType,id_01\n1,mobile,0.5\n")
    got = I.read_folder(spark, d)
    assert sorted(got) == ["identity", "transaction"]
    assert got["transaction"].count() == 3
    assert dict(got["identity"].dtypes)["id_01"] == "double"
