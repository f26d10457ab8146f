"""Exact ranks, quantiles and q-values against pandas: ties across bounds, hot values, nulls, groups that are narrowed."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ratefield.operators import order, ranking, skew, tables


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    x = np.where(rng.random(4000) < 0.35, 7.0, np.round(rng.lognormal(0, 5, 4000), 2))
    x[rng.random(4000) < 0.05] = np.nan
    g = rng.choice(["a", "b", ""], 4000, p=[0.6, 0.3, 0.1])
    frame = pd.DataFrame({"id": range(4000), "g": [k or None for k in g], "x": x})
    data = [(int(i), k, None if v != v else float(v)) for i, k, v in frame.itertuples(index=False)]
    return spark.createDataFrame(data, "id long, g string, x double").repartition(5), frame


@pytest.mark.parametrize("method", ["min", "average", "dense"])
@pytest.mark.parametrize("descending", [False, True])
def test_ranks(rows, method, descending):
    df, frame = rows
    got = order.exact_rank(df, "x", "r", method, descending, ranges=9).toPandas().set_index("id")["r"].sort_index()
    assert np.allclose(got.astype(float), frame["x"].rank(method=method, ascending=not descending, na_option="bottom"))


def test_no_window_over_all_rows(rows):
    df, _ = rows
    for plan in (order.exact_rank(df, "x", "r"), order.step_up(df.select("id", (F.lit(1.0) / (F.col("id") + 1)).alias("p")), "p", "q"), ranking.spearman(df, "id", "x"), ranking.mann_whitney(df, "g", "x", "a", "b")):
        windows = [line for line in plan._jdf.queryExecution().executedPlan().toString().splitlines() if "Window [" in line]
        assert all("], [piece#" in line for line in windows)


@pytest.mark.parametrize("by", [None, ["g"]])
@pytest.mark.parametrize("settings", [{}, {"sorted_most": 40, "bins": 8}])
def test_quantiles(rows, by, settings):
    df, frame = rows
    found = order.exact_quantiles(df, "x", [0.0, 0.1, 0.5, 0.99, 1.0], by, **settings)
    assert "percentile" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.collect()
    assert len(got) == 5 * (3 if by else 1)
    for r in got:
        own = frame if not by else frame[frame["g"].isna() if r["g"] is None else frame["g"] == r["g"]]
        assert r["value"] == pytest.approx(own["x"].dropna().quantile(r["q"]), rel=1e-9)


def test_quantiles_of_odd_values(spark):
    odd = [1e308, -1e308, float("inf"), float("-inf"), 0.0, None, float("nan"), 5e-324, -0.0] * 30
    df = spark.createDataFrame([(v,) for v in odd], "v double")
    want = np.sort([v for v in odd if v is not None and v == v])
    got = {r["q"]: r["value"] for r in order.exact_quantiles(df, "v", [0.0, 0.5, 1.0], sorted_most=5, bins=4).collect()}
    assert got == {0.0: want[0], 0.5: np.median(want), 1.0: want[-1]}
    assert order.exact_quantiles(df.limit(0), "v", [0.5]).count() == 0
    assert order.exact_quantiles(df.filter("v is null"), "v", [0.5]).count() == 0


def test_medians_by_group(rows):
    df, frame = rows
    got = tables.impute_median(df, "x", "filled", "missing", ["g"]).toPandas().set_index("id").sort_index()
    want = frame["x"].fillna(frame.groupby(frame["g"].fillna("none"))["x"].transform("median"))
    assert np.allclose(got["filled"], want) and (got["missing"] == frame["x"].isna()).all()
    whole = tables.impute_median(df, "x", "filled", "missing").toPandas().set_index("id").sort_index()
    assert np.allclose(whole["filled"], frame["x"].fillna(frame["x"].median()))


def test_q_values(spark):
    rng = np.random.default_rng(3)
    p = np.round(rng.random(300) ** 3, 2)
    df = spark.createDataFrame([(int(i), float(v)) for i, v in enumerate(p)] + [(300, None)], "id long, p double")
    got = {r["id"]: r["q"] for r in order.step_up(df, "p", "q", ranges=6).collect()}
    by = np.argsort(p, kind="stable")
    q = np.minimum.accumulate((p[by] * 300 / np.arange(1, 301))[::-1])[::-1].clip(max=1)
    assert got.pop(300) is None and np.allclose([got[int(i)] for i in by], q)


def test_two_samples(rows):
    df, frame = rows
    a, b = (frame[frame["g"] == k]["x"].dropna().to_numpy() for k in "ab")
    got = ranking.mann_whitney(df, "g", "x", "a", "b").first()
    u = (a[:, None] > b).sum() + 0.5 * (a[:, None] == b).sum()
    both = np.concatenate([a, b])
    ties = (np.unique(both, return_counts=True)[1].astype(float) ** 3 - np.unique(both, return_counts=True)[1]).sum()
    n1, n2, n = len(a), len(b), len(both)
    sd = np.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
    assert (got["n1"], got["n2"], got["u"]) == (n1, n2, u) and got["z"] == pytest.approx((u - n1 * n2 / 2) / sd)


def test_join_of_frequent_keys(spark):
    df = spark.range(6000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 50).alias("k"), F.when(F.col("id") % 7 > 0, "x").alias("s"), "id")
    facts = df.groupBy("k", "s").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = skew.join_facts(df, facts.filter("k <> 3"), ["k", "s"], "n", 6000, hot_rows=3)
    want = {(r["k"], r["s"]): r["top"] for r in facts.collect() if r["k"] != 3}
    assert got.count() == 6000 and all(r["top"] == want.get((r["k"], r["s"])) for r in got.collect())
