"""Whitening against NumPy on whole numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import registry, whitening

SF = "/root/testdata/sf0.001"


def brute(rows, width):
    """vec_id, x of usable rows; n, S, eigenvalues, unit vectors, trace."""
    usable = [
        (i, [math.floor(64 * float(c)) + 1_000_000 for c in v])
        for i, v in rows
        if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)
    ]
    fit = sorted({tuple(x) for _, x in usable})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    d = np.array([[(n * c - s) / n for c, s in zip(x, sums, strict=True)] for x in fit])
    values, axes = np.linalg.eigh(d.T @ d / n)
    return usable, n, sums, values[::-1], axes[:, ::-1]


def check(out, usable, n, sums, values, axes, count):
    real = [k for k in range(count) if values[k] > 1e-9 * values[0]]
    assert len(out) == len(usable) * count
    got = {}
    for r in out:
        got.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    for i, x in usable:
        d = [n * c - s for c, s in zip(x, sums, strict=True)]
        for k in range(count):
            row = got[i][k + 1][0]
            assert row["n"] == n and row["deviation"] == sum(c * c for c in d)
            assert abs(row["explained"] - values[k] / values.sum()) <= 1e-4 * abs(values[k] / values.sum()) + 1e-12
            assert row["identity_error"] <= 1e-4
            if k in real:
                expected = np.array(d) / n @ axes[:, k] / math.sqrt(values[k])
                assert abs(abs(row["whitened"]) - abs(expected)) < 1e-6
            else:
                assert row["whitened"] is None


def test_query_equals_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    out = registry.op12_whitening(spark, SF)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(out.collect(), *brute(rows, 64), 16)
    # The whitened fit has unit covariance, and the same signs for all rows.
    x = whitening.whole_vectors(spark.read.parquet(f"{SF}/embeddings.parquet"))
    fit = x.dropDuplicates(["x"]).join(out, "vec_id").groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("component", "whitened"))).alias("w")).collect()
    w = np.array([[c["whitened"] for c in r["w"]] for r in fit])
    assert np.abs(w.T @ w / len(w) - np.eye(16)).max() < 1e-4


def test_awkward_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, [1.0, 2.0, 0.5]),
        (2, [0.25, -1.0, 3.0]),
        (2, [0.25, -1.0, 3.0]),
        (3, [1.0, 2.0, 0.5]),
        (None, [5.0, 0.0, 1.0]),
        (2**60 + 1, [-5.0, 2.0, 1.0]),
        (4, None), (5, []), (6, [1.0, None, 2.0]), (7, [1.0, nan, 2.0]), (8, [inf, 1.0, 2.0]), (9, [1e300, 1.0, 2.0]), (10, [1.0, 2.0]),
    ]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "vec_id long, embedding array<double>, x string, component int")
    out = whitening.whiten(df).collect()
    check(out, *brute([r for r in rows if r[0] != 9], 3), 3)
    assert len([r for r in out if r["vec_id"] == 2]) == 6 and {r["vec_id"] for r in out} == {1, 2, 3, None, 2**60 + 1}


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_no_usable_vector(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect() == []


def test_one_vector_has_no_variance(spark):
    out = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")).collect()
    assert len(out) == 4 and all(r["whitened"] is None and r["n"] == 1 and r["deviation"] == 0 and r["explained"] == 0 for r in out)


def test_large_numbers_stay_exact(spark):
    rows = [(i, [2.0**42 * (i + 1), float(i * i)]) for i in range(5)]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("component = 1").collect()
    usable, n, sums, *_ = brute(rows, 2)
    for r in out:
        exact = sum((n * c - s) ** 2 for c, s in zip(dict(usable)[r["vec_id"]], sums, strict=True))
        assert r["deviation"] == (exact if exact < 1 << 63 else None)
