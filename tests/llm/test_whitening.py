"""Whitening against exact rational arithmetic, and its edge cases."""

from __future__ import annotations

import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratefield.llm import whitening
from tests.conftest import DATA

SCHEMA = "vec_id long, embedding array<float>"


def exact(vectors):
    """n, sums and covariance by rational numbers."""
    x = [[math.floor(float(np.float32(c)) * 64) + 1_000_000 for c in v] for v in vectors]
    n, dims = len(x), len(x[0])
    s = [sum(v[i] for v in x) for i in range(dims)]
    cov = np.array([[float(sum((Fraction(v[i]) - Fraction(s[i], n)) * (Fraction(v[j]) - Fraction(s[j], n)) for v in x) / n) for j in range(dims)] for i in range(dims)])
    return x, n, s, cov


def held(rows):
    out = defaultdict(dict)
    for r in rows:
        out[r["vec_id"]][r["component"]] = r
    return out


def test_equals_rational_arithmetic(spark):
    rng = np.random.default_rng(13)
    vectors = (rng.normal(size=(60, 6)) @ rng.normal(size=(6, 6)) * [1, 1, 50, 1, 1e-2, 300]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    odd = [(100, None), (101, []), (102, [1.0] * 5 + [None]), (103, [math.nan] * 6), (104, [math.inf] + [0.0] * 5), (105, [1.0, 2.0])]
    got = held(whitening.whiten(spark.createDataFrame(rows + odd, SCHEMA).repartition(5)).collect())
    x, n, s, cov = exact(vectors)
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    assert sorted(got) == list(range(60))
    white = np.array([[got[i][k]["whitened"] for k in range(1, 7)] for i in range(60)])
    assert np.allclose(white.T @ white / n, np.eye(6), atol=1e-9) and np.allclose(white.mean(0), 0, atol=1e-9)
    for i in range(60):
        assert got[i][1]["deviation"] == sum((n * a - b) ** 2 for a, b in zip(x[i], s, strict=True)) and got[i][1]["n"] == n
        assert [got[i][k]["explained"] for k in range(1, 7)] == pytest.approx((values / values.sum()).tolist(), rel=1e-9)
        assert got[i][1]["identity_error"] < 1e-9
    # projections on unit eigenvectors of the covariance: their products with it give the variance
    centred = np.array([[float(Fraction(a) - Fraction(b, n)) for a, b in zip(v, s, strict=True)] for v in x])
    axes = centred.T @ white / n / np.sqrt(values)
    assert np.allclose(axes.T @ axes, np.eye(6), atol=1e-8) and np.allclose(cov @ axes, axes * values, atol=1e-6 * values[0])


def test_chinese_remainders():
    rng = np.random.default_rng(1)
    moduli = whitening.primes(6)
    assert len(set(moduli)) == 6 and all(2**20 < p < 2**21 for p in moduli)
    numbers = np.array([int(rng.integers(-(2**62), 2**62)) * int(rng.integers(0, 2**50)) for _ in range(50)], object)
    residues = np.array([[int(v) % p for v in numbers] for p in moduli], np.int64)
    assert whitening.reconstruct(residues, moduli).tolist() == numbers.tolist()


def test_far_from_zero_is_exact(spark):
    """A large constant would drown the variance in doubles."""
    rng = np.random.default_rng(2)
    vectors = (rng.integers(-3, 4, (40, 3)) + 2.0**22).astype(np.float32)
    got = whitening.whiten(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], SCHEMA)).collect()
    _, _, _, cov = exact(vectors)
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    assert [r["explained"] for r in got if r["vec_id"] == 7] == pytest.approx((values / values.sum()).tolist(), rel=1e-9)
    huge = [(0, [3e38, 1.0]), (1, [-3e38, 2.0]), (2, [0.0, 4.0])]
    out = whitening.whiten(spark.createDataFrame(huge, SCHEMA)).collect()
    assert len(out) == 6 and {r["deviation"] for r in out if r["vec_id"] < 2} == {None} and {r["deviation"] for r in out if r["vec_id"] == 2} == {102_400} and all(math.isfinite(r["whitened"]) for r in out if r["component"] == 1)


def test_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(none).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [None])], SCHEMA)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0])], SCHEMA)).collect()
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(None, k, 1, 0, None, 0.0, 0.0) for k in (1, 2)]
    flat = [(7, [float(i % 3), 5.0, float(i % 3)]) for i in range(9)] + [(None, [0.0, 5.0, 1.0])] * 2
    clash = spark.createDataFrame(flat, SCHEMA).withColumns({"vector": F.lit("x"), "n": F.lit(1), "component": F.lit("y")})
    got = whitening.whiten(clash).collect()
    assert len(got) == 33 and {r["component"] for r in got if r["whitened"] is None} == {3} and max(r["identity_error"] for r in got) < 1e-9
    doubles = spark.createDataFrame([(f"a{i}", [i * 0.5, i * i * 0.25]) for i in range(5)], "vec_id string, embedding array<double>")
    assert whitening.whiten(doubles).count() == 10


def test_query(spark):
    got = held(whitening.query(spark, DATA).collect())
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    x = np.array([[math.floor(float(np.float32(c)) * 64) + 1_000_000 for c in r["embedding"]] for r in rows])
    centred = x - x.mean(0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(x))
    want = centred @ axes[:, ::-1][:, :32] / np.sqrt(values[::-1][:32])
    white = np.array([[got[r["vec_id"]][k]["whitened"] for k in range(1, 33)] for r in rows])
    assert np.allclose(np.abs(white), np.abs(want), atol=1e-6)
    assert all(len(v) == 32 for v in got.values()) and len(got) == len(rows)
