"""Damaged CSV input, replayed stream batches, exact ranks of any ordered type."""

import datetime
import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fraudlake.operators import prepare as P
from fraudlake.operators import rank
from fraudlake.operators import rounds as R
from fraudlake.sources import fixtures as fx
from fraudlake.sources import ingest as I
from fraudlake.streaming import streams as S

from conftest import SF_SMALL


def test_csv_leaves_over_long_lines_out(spark, tmp_path):
    p = tmp_path / "transaction.csv"
    p.write_text('TransactionID,isFraud,TransactionAmt\n1,0,5.5\n2,1,6.5,extra\n3,1\n4,0,"7,5"\n')
    rows = I.read_table(spark, str(p)).orderBy("TransactionID").collect()
    assert [tuple(r) for r in rows] == [(1, 0, 5.5), (3, 1, None), (4, 0, None)]
    assert [r.line for r in I.bad_rows(spark, str(p)).collect()] == ["2,1,6.5,extra"]


@pytest.mark.parametrize("encoding", ["utf-8", "latin-1"])
def test_csv_encoding_fallback(spark, tmp_path, encoding):
    p = tmp_path / "identity.csv"
    p.write_bytes("TransactionID,DeviceType,DeviceInfo\n1,mobile,Téléphone ü\n2,desktop,plain\n".encode(encoding))
    rows = I.read_table(spark, str(p)).orderBy("TransactionID").collect()
    assert [(r.TransactionID, r.DeviceInfo) for r in rows] == [(1, "Téléphone ü"), (2, "plain")]


def test_replayed_batch_replaces_its_own_output(spark, tmp_path):
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    d = fx.dirty(spark, SF_SMALL)
    first, second = d.where("line_no % 2 = 0"), d.where("line_no % 2 = 1 or line_no % 10 = 0")
    body = S.quarantine_batch(good, bad)

    def state():
        return tuple(sorted((tuple(r) for r in spark.read.parquet(p).collect()), key=repr) for p in (good, bad))

    body(first, 0)
    body(second, 1)
    once = state()
    assert once[0] and once[1] and any("duplicate_key" in r for r in once[1])
    for batch_id, rows in ((1, second), (0, first), (1, second), (1, second)):
        body(rows, batch_id)
        assert state() == once


ODD = {"double": [0.25, -1.5, 1e300, -1e300, math.inf, -math.inf, 5e-324, 0.0, 7.75, 7.5],
       "long": [2 ** 63 - 1, -(2 ** 63), 0, 1, -1, 2 ** 62, -2 ** 62, 17, 18, 19],
       "bigint": [2 ** 62 + i for i in range(40)],
       "decimal(38,3)": [Decimal(10) ** 30 + i for i in range(12)] + [Decimal("0.001"), Decimal("-5.5")],
       "date": [datetime.date(2020, 1, 1) + datetime.timedelta(days=i) for i in range(50)]}


@pytest.mark.parametrize("kind", sorted(ODD))
@pytest.mark.parametrize("final_rows,n_bins", [(10 ** 6, 64), (20, 4), (3, 2)])
def test_cuts_of_odd_values(spark, monkeypatch, kind, final_rows, n_bins):
    monkeypatch.setattr(rank, "FINAL_ROWS", final_rows)
    monkeypatch.setattr(rank, "N_BINS", n_bins)
    rnd = random.Random(7)
    rows = [("ab"[i % 2], None if i % 11 == 0 else rnd.choice(ODD[kind]), i) for i in range(300)]
    df = spark.createDataFrame(rows, f"g string, k {kind}, t long")
    wanted = {g: [0, 1, 20, 75, 120, 140, 149] for g in "ab"}
    got = rank.cut_tuples(df, "g", "k", "t", wanted)
    for g in "ab":
        mine = sorted((r for r in rows if r[0] == g and r[1] is not None), key=lambda r: (r[1], r[2])) + \
            [r for r in rows if r[0] == g and r[1] is None]
        for k in wanted[g]:
            assert got[(g, k)] == (mine[k][1], mine[k][2])


@pytest.mark.parametrize("final_rows,n_bins", [(10 ** 6, 64), (3, 2)])
def test_median_with_infinities(spark, monkeypatch, final_rows, n_bins):
    monkeypatch.setattr(rank, "FINAL_ROWS", final_rows)
    monkeypatch.setattr(rank, "N_BINS", n_bins)
    df = spark.createDataFrame([(x,) for x in [1.0, 2.0, 100.0, math.inf, 200.0, -math.inf, None, 100.0, 3e5]],
                               "a double")
    assert dict((c, v) for c, _, v in P.fit_imputation(df))["a"] == 100.0


def test_split_of_fractional_and_null_times(spark, monkeypatch):
    monkeypatch.setattr(rank, "FINAL_ROWS", 10)
    monkeypatch.setattr(rank, "N_BINS", 3)
    rnd = random.Random(3)
    rows = [(i, "b", None if i % 9 == 0 else rnd.choice([0.5, 0.25, 1.75, 1e9, -2.5])) for i in range(200)]
    df = spark.createDataFrame(rows, "TransactionID long, bank_id string, TransactionDT double")
    got = {r.TransactionID: r.split for r in P.temporal_split(df).collect()}
    order = sorted(rows, key=lambda r: (r[2] is None, r[2] or 0.0, r[0]))
    assert [got[r[0]] for r in order] == ["train"] * 160 + ["val"] * 20 + ["test"] * 20


def test_sort_time_positions(spark):
    rows = [(i, None if i % 5 == 0 else (i * 7 % 13) / 4) for i in range(100)]
    out = P.sort_time(spark.createDataFrame(rows, "k long, t double").repartition(7), "t", "k").collect()
    want = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0.0, r[0]))
    assert {r.k: r.position for r in out} == {k: n for n, (k, _) in enumerate(want)}


def test_codes_of_negative_first_positions(spark):
    df = spark.createDataFrame([(-3, "x"), (-5, "y"), (2, "z"), (7, "y")], "TransactionID long, ProductCD string")
    got = {r.ProductCD: r.bank_id for r in P.code_banks(df).collect()}
    assert got == {"y": "bank_1", "x": "bank_2", "z": "bank_3"}


@pytest.mark.parametrize("limit", [10 ** 6, 0])
def test_codes_on_both_sides_of_the_limit(spark, limit):
    train = spark.createDataFrame([("a", "u"), ("a", "v"), ("b", "v"), ("b", None)], "bank_id string, c string")
    dictionary = P.fit_dictionary(train, ["c"])
    rows = [("a", "v"), ("a", "new"), ("b", "new"), ("b", None), ("z", "u"), (None, "u")] + [("a", "u")] * 200
    got = P.transform_codes(spark.createDataFrame(rows, "bank_id string, c string"), dictionary, ["c"],
                            broadcast_limit=limit)
    assert got.columns == ["bank_id", "c"]
    counts = {(r.bank_id, r.c): r["n"] for r in got.groupBy("bank_id", "c").agg(F.count("*").alias("n")).collect()}
    assert counts == {("a", 1): 1, ("a", 0): 201, ("b", 0): 2, ("z", 0): 1, (None, 0): 1}


def test_weight_change_over_missed_rounds_and_new_positions(spark):
    rows = [(1, "a", "t", [1.0, 2.0]), (4, "a", "t", [1.0, 5.0, 4.0]), (2, "b", "t", [1.0])]
    df = spark.createDataFrame(rows, "round int, client_id string, tensor string, w array<double>")
    assert [tuple(r) for r in R.weight_change(df).collect()] == [(4, "a", 5.0)]
