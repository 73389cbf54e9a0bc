"""Dictionaries that grow, retention that deletes, enumerated Shapley values."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fraudlake.functions.vectorized import attribute_exact, attribute_sampled, exact_shapley_batch
from fraudlake.operators import prepare as P
from fraudlake.session import path_exists
from fraudlake.sources import ingest as I

SCHEMA = "bank_id string, c string, n int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def codes(d):
    return {(r.bank_id, r.column_name, r.value): (r.code, r.version) for r in d.collect()}


def test_versions_of_a_dictionary(spark):
    v1 = P.fit_dictionary(frame(spark, [("a", "x", 1), ("a", "z", 2), ("b", None, 3), (None, "q", 1)]), ["c"])
    v2 = P.extend_dictionary(v1, frame(spark, [("a", "y", 5), ("a", "x", 1), ("c", "n", 1), (None, "p", 1)] * 3), ["c", "n"])
    v3 = P.extend_dictionary(v2, frame(spark, [("a", "a", 1), ("a", None, 1)]), ["c"])
    same = P.extend_dictionary(v3, frame(spark, [("a", "y", 5)]), ["c", "n"])
    one, two, three = codes(v1.withColumn("version", F.lit(1))), codes(v2), codes(v3)
    assert one.items() <= two.items() <= three.items() and codes(same) == three
    assert {k: v for k, v in two.items() if v[1] == 2} == {
        ("a", "c", "y"): (2, 2), ("c", "c", "n"): (0, 2), (None, "c", "p"): (1, 2), ("a", "n", "1"): (0, 2),
        ("a", "n", "5"): (1, 2), ("c", "n", "1"): (0, 2), (None, "n", "1"): (0, 2)}
    assert {k for k, v in three.items() if v[1] == 3} == {("a", "c", "a"), ("a", "c", "Unknown")}
    # rows coded with an earlier version keep their codes under a later one
    rows = frame(spark, [("a", "x", 1), ("a", "z", 1)])
    old, new = (sorted(map(tuple, P.transform_codes(rows, d, ["c"]).collect())) for d in (v1, v3))
    assert old == new
    assert codes(P.extend_dictionary(v1, frame(spark, []), ["c"])) == one
    assert codes(P.extend_dictionary(v1.limit(0), rows, ["c"])) == {("a", "c", "x"): (0, 1), ("a", "c", "z"): (1, 1)}


def table(spark, path):
    spark.range(60).select("id", F.format_string("2024-%02d", F.col("id") % 6 + 1).alias("month")) \
        .write.partitionBy("month").parquet(path)


def months(spark, path):
    return sorted({str(r.month)[:7] for r in spark.read.parquet(path).select("month").distinct().collect()})


def test_retention_deletes_what_is_not_kept(spark, tmp_path):
    path = str(tmp_path / "q")
    table(spark, path)
    keep = spark.createDataFrame([("2024-05",), ("2024-06",), ("1999-01",)], "month string")
    assert I.apply_retention(spark, path, keep) == ["2024-01", "2024-02", "2024-03", "2024-04"]
    assert months(spark, path) == ["2024-05", "2024-06"] and spark.read.parquet(path).count() == 20
    assert I.apply_retention(spark, path, keep) == []
    assert not path_exists(spark, path + "-retention")


@pytest.mark.parametrize("crash", ["after the manifest", "after the rename", "before the manifest is whole"])
def test_retention_after_a_crash(spark, tmp_path, crash):
    path = str(tmp_path / "q")
    table(spark, path)
    keep = spark.createDataFrame([("2024-05",)], "month string")
    left = spark.createDataFrame([("2024-01",), ("2024-02",)], "part string")
    left.coalesce(1).write.parquet(path + "-retention")
    if crash == "after the rename":
        (tmp_path / "q" / "month=2024-01").rename(tmp_path / "q" / "_gone-month-2024-01")
        assert months(spark, path) == ["2024-02", "2024-03", "2024-04", "2024-05", "2024-06"]   # whole partitions only
    if crash == "before the manifest is whole":
        (tmp_path / "q-retention" / "_SUCCESS").unlink()
    removed = I.apply_retention(spark, path, keep)
    want = ["2024-01", "2024-02", "2024-03", "2024-04", "2024-06"]
    assert sorted(removed) == want and months(spark, path) == ["2024-05"]
    assert not [p for p in (tmp_path / "q").iterdir() if p.name.startswith("_gone")]


def test_shapley_by_subsets():
    rng = np.random.default_rng(1)
    x, bg, w, b = rng.normal(size=(5, 4)), rng.normal(size=(7, 4)), [1.0, -2.0, 0.5, 0.0], 0.3
    f = lambda v: 1 / (1 + np.exp(-(v @ np.array(w) + b)))                       # noqa: E731

    def value(row, inside):
        mixed = bg.copy()
        mixed[:, list(inside)] = row[list(inside)]
        return f(mixed).mean()

    phi, base, pred = exact_shapley_batch(x, bg, w, b)
    for i, row in enumerate(x):
        for j in range(4):
            others = [k for k in range(4) if k != j]
            want = sum(math.factorial(n) * math.factorial(3 - n) / 24 * (value(row, (*s, j)) - value(row, s))
                       for n in range(4) for s in combinations(others, n))
            assert phi[i, j] == pytest.approx(want)
    assert np.allclose(phi.sum(axis=1), pred - base) and np.allclose(pred, f(x)) and np.allclose(phi[:, 3], 0)


def test_sampled_values_approach_the_enumerated_ones(spark):
    rng = np.random.default_rng(2)
    x, bg, w, b = rng.normal(size=(6, 5)), rng.normal(size=(9, 5)).tolist(), [1.0, -2.0, 0.5, 1.5, 0.2], 0.1
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "TransactionID long, x array<double>")
    exact = {r.TransactionID: np.array(r.contributions) for r in attribute_exact(df, bg, w, b).collect()}
    errors = []
    for n in (64, 4096):
        got = attribute_sampled(df, bg, w, b, n_perm=n).collect()
        errors.append(max(np.abs(np.array(r.contributions) - exact[r.TransactionID]).max() for r in got))
        # a marginal gain lies in [-1, 1]: the mean of n is within sqrt(2 ln(2 k / p) / n) of its expectation
        assert errors[-1] < math.sqrt(2 * math.log(2 * 30 / 1e-6) / n)
    assert errors[1] < errors[0]
    with pytest.raises(ValueError):
        attribute_exact(df, bg, [0.0] * 13, b)
