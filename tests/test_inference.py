"""The hypothesis table and draws of posteriors against other formulas."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratefield.functions import special
from ratefield.operators import draws, hypotheses


def t_tail(t, df):
    """Two-sided p of Student's t by the trapezium rule."""
    x = np.linspace(-abs(t), abs(t), 200_001)
    density = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * np.log(df * np.pi) - (df + 1) / 2 * np.log1p(x * x / df))
    return 1 - np.trapezoid(density, x)


def test_contrasts(spark):
    rng = np.random.default_rng(9)
    v = np.round(rng.normal(size=400), 1)
    g = rng.random((400, 3)) < [0.3, 0.5, 0.02]
    v[g[:, 0]] += 0.4
    rows = [(float(a), *[bool(x) if i % 17 else None for x in b]) for i, (a, b) in enumerate(zip(v, g, strict=True))] + [(None, True, True, False), (float("nan"), True, False, True)]
    df = spark.createDataFrame(rows, "v double, a boolean, b boolean, c boolean").repartition(4)
    drivers = {k: F.col(k) for k in "abc"} | {"all": F.lit(True), "one": F.col("v") == float(v.max())}
    got = {r["driver"]: r for r in hypotheses.contrasts(df, "v", drivers, ranges=5).collect()}
    assert sorted(got) == ["a", "all", "b", "c", "one"]
    use = np.arange(400) % 17 > 0
    ps = {}
    for k, name in enumerate("abc"):
        x, y = v[use & g[:, k]], v[use & ~g[:, k]]
        r, (n1, n2) = got[name], (len(x), len(y))
        a, b = x.var(ddof=1) / n1, y.var(ddof=1) / n2
        t, free = (x.mean() - y.mean()) / math.sqrt(a + b), (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1))
        u = (x[:, None] > y).sum() + 0.5 * (x[:, None] == y).sum()
        ties = np.unique(np.concatenate([x, y]), return_counts=True)[1].astype(float)
        sd = math.sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - (ties**3 - ties).sum() / ((n1 + n2) * (n1 + n2 - 1))))
        z = (u - n1 * n2 / 2) / sd
        assert (r["n1"], r["n2"], r["u"]) == (n1, n2, u)
        assert [r[c] for c in ("t", "df", "z", "p_t", "p_u")] == pytest.approx([t, free, z, t_tail(t, free), math.erfc(abs(z) / math.sqrt(2))], rel=1e-6)
        pooled = math.sqrt(((n1 - 1) * x.var(ddof=1) + (n2 - 1) * y.var(ddof=1)) / (n1 + n2 - 2))
        assert r["hedges_g"] == pytest.approx((x.mean() - y.mean()) / pooled * (1 - 3 / (4 * (n1 + n2) - 9)))
        ps[name] = r["p_u"]
    assert got["all"]["n2"] == 0 and got["all"]["t"] is None and got["all"]["u"] is None and got["all"]["q_t"] is None
    known = sorted(r["p_u"] for r in got.values() if r["p_u"] is not None)
    for r in got.values():
        if r["p_u"] is not None:
            assert r["q_u"] == pytest.approx(min(1, *(p * len(known) / (i + 1) for i, p in enumerate(known) if p >= r["p_u"])))


def test_draws(spark, tmp_path):
    posterior = spark.createDataFrame([("x", 3.5, 2.0), ("y", 120.0, 10.0), ("z", 0.4, 1.0)], "k string, a double, b double")
    table = draws.gamma_draws(posterior, "k", "a", "b", 1500)
    draws.write_draws(table, str(tmp_path / "d"))
    back = draws.read_draws(spark, str(tmp_path / "d"))
    assert back.count() == 4500 and sorted(map(tuple, back.select("draw", "unit", "value").collect())) == sorted(map(tuple, table.collect()))
    some = draws.read_draws(spark, str(tmp_path / "d"), (2, 4))
    assert some.count() == 600 and "PartitionFilters: [isnotnull(block" in some._jdf.queryExecution().executedPlan().toString()
    for r in draws.described(back, [0.1, 0.5, 0.9]).collect():
        a, b = {"x": (3.5, 2.0), "y": (120.0, 10.0), "z": (0.4, 1.0)}[r["unit"]]
        assert float(special.gamma_cdf(a, r["value"] * b)) == pytest.approx(r["q"], abs=0.035)
    by = {r["unit"]: r["m"] for r in back.groupBy("unit").agg(F.avg("value").alias("m")).collect()}
    assert [by[k] for k in "xyz"] == pytest.approx([1.75, 12.0, 0.4], rel=0.15)


def test_log_mean_exp(spark):
    rng = np.random.default_rng(3)
    units = {"low": -2000 + rng.normal(size=730), "high": 900 + rng.normal(size=450), "one": np.array([5.0]), "none": np.array([-np.inf] * 3), "some": np.array([-np.inf, 1.0, 2.0])}
    rows = [(k, i, float(x)) for k, v in units.items() for i, x in enumerate(v)] + [("low", 5000, None)]
    got = {r["u"]: r for r in draws.log_mean_exp(spark.createDataFrame(rows, "u string, d int, v double"), "u", "d", "v").collect()}
    for k, v in units.items():
        top = max(v.max(), -1e308)
        want = top + math.log(np.exp(v - top).mean()) if np.isfinite(v).any() else -np.inf
        assert got[k]["n"] == len(v) and got[k]["log_mean"] == pytest.approx(want, rel=1e-12)


def test_poisson_log(spark):
    f = lambda y, m: spark.range(1).select(draws.poisson_log(F.lit(y), F.lit(m)).alias("x")).first()["x"]
    assert f(3.0, 2.0) == pytest.approx(3 * math.log(2) - 2) and f(0.0, 0.0) == 0 and f(1.0, 0.0) == -math.inf
