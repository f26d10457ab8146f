"""The rate engine against its SQL, and what SQL can't express against identities and brute force."""

from __future__ import annotations

import glob
import itertools
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ratefield.functions import special
from ratefield.functions import text as tx
from ratefield.operators import bayes, graphs, linkage, ranking, rates, regress, spatial, tables
from ratefield.plans import catalog, statistical
from ratefield.plans.tables import Tables
from ratefield.sources import readers
from ratefield.streaming.counts import windowed_counts
from tests import dense_fits
from tests.conftest import DATA


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows_of(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)].astype(object)
    return sorted(repr(tuple(float(f"{v:.9g}") + 0.0 if isinstance(v, float) else v for v in r)) for r in df.where(df.notna(), None).values.tolist())


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_intervals_of_a_query(spark):
    rows = catalog.QUERIES["eb_intervals"](spark, DATA).toPandas()
    y, n = rows["y"].to_numpy(float), rows["n"].to_numpy(float)
    shape, rate = prior(y, n)
    for column, p in (("shrunken_low", 0.025), ("shrunken_high", 0.975)):
        assert np.allclose(special.gamma_cdf(shape + y, rows[column].to_numpy() / 1e5 * (rate + n)), p, atol=1e-6)


def test_random_intercepts_of_a_query(spark):
    """REML by its definition: the density of the residuals' contrasts under the full covariance."""
    got = catalog.QUERIES["mixed_reml"](spark, DATA).first()
    table = statistical.area_table(Tables(spark, DATA)).toPandas()
    y, x = (table["y"] / table["n"]).to_numpy(), np.column_stack([np.ones(len(table)), table["x"]])
    same = (table["g"].to_numpy()[:, None] == table["g"].to_numpy()).astype(float)

    def deviance(residual, group):
        v = residual * np.eye(len(y)) + group * same
        inverse = np.linalg.inv(v)
        a = x.T @ inverse @ x
        beta = np.linalg.solve(a, x.T @ inverse @ y)
        r = y - x @ beta
        return np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1] + r @ inverse @ r, beta

    at, beta = deviance(got["residual_variance"], got["group_variance"])
    assert beta.tolist() == pytest.approx([got["intercept"], got["slope"]], rel=1e-6)
    for f, g in ((1.05, 1), (0.95, 1), (1, 1.3), (1, 0.7)):
        assert deviance(got["residual_variance"] * f, max(got["group_variance"] * g, 1e-12))[0] >= at - 1e-4


def test_negative_binomial_of_a_query(spark):
    got = dict(map(tuple, catalog.QUERIES["nb_glm"](spark, DATA).collect()))
    table = statistical.area_table(Tables(spark, DATA)).toPandas()
    groups = sorted(table["g"].unique())
    beta, alpha, ll = dense_fits.fit_nb(table["y"], dense_fits.design(table, ["x"], groups, "g"), np.log(table["n"].to_numpy()))
    assert [got[k] for k in ["x", *map(str, groups)]] == pytest.approx(beta.tolist(), abs=1e-5) and got["log_likelihood"] == pytest.approx(ll, abs=1e-4)
    fold = catalog.QUERIES["nb_loso"](spark, DATA).toPandas()
    assert len(fold) == len(table) and np.isfinite(fold["log_density"]).all()


def test_hot_spots_of_a_query(spark):
    rows = catalog.QUERIES["hotspot_classes"](spark, DATA).toPandas().sort_values("p")
    z = {r["node"]: r["z"] for r in catalog.QUERIES["gi_star"](spark, DATA).collect()}
    p = np.array([math.erfc(abs(z[k]) / math.sqrt(2)) for k in rows["node"]])
    assert np.allclose(rows["p"], p, atol=1e-5)
    q = np.minimum.accumulate((p * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    assert np.allclose(rows["q"], q, atol=1e-4)
    assert [("hot" if z[k] > 0 else "cold") if v < 0.25 else "neither" for k, v in zip(rows["node"], rows["q"], strict=True)] == rows["class"].tolist()


def test_scale_and_lists_of_queries(spark):
    edges = graphs.undirected(statistical.nation_edges(Tables(spark, DATA))).collect()
    n = spark.read.parquet(f"{DATA}/nation.parquet").count()
    q = np.zeros((n, n))
    for i, j in edges:
        q[i, j], q[i, i] = -1, q[i, i] + 1
    assert catalog.QUERIES["bym2_scale"](spark, DATA).first()["scale"] == pytest.approx(np.exp(np.log(np.diag(np.linalg.pinv(q))).mean()))
    r = catalog.QUERIES["loglinear3"](spark, DATA).first()
    cells = [r[f"n_{k}"] for k in ("111", "110", "101", "011", "100", "010", "001")]
    assert r["seen"] == sum(cells) and (r["unseen"] is None or not all(cells) or r["unseen"] == pytest.approx(cells[0] * cells[4] * cells[5] * cells[6] / (cells[1] * cells[2] * cells[3])))


def test_moran_variance_by_shuffling(spark):
    """The variance under randomisation is that over all orders of the values."""
    values = [1.0, 4.0, 2.0, 9.0, 7.0, 3.0]
    edges = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (0, 5), (1, 4)]
    got = spatial.moran(spark.createDataFrame(list(enumerate(values)), "node int, v double"), spark.createDataFrame(edges, "src int, dst int"), "v").first()
    w = np.zeros((6, 6))
    for i, j in edges:
        w[i, j] = w[j, i] = 1
    w /= w.sum(1, keepdims=True)
    z = np.array(values) - np.mean(values)
    found = [float(6 / w.sum() * (p := np.array(order)) @ w @ p / (p @ p)) for order in itertools.permutations(z)]
    assert got["expected"] == pytest.approx(np.mean(found)) and got["variance_random"] == pytest.approx(np.var(found)) and got["statistic"] == pytest.approx(found[0])


def units(spark, y, n):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, n, strict=True))], "unit int, y double, n double")


def prior(y, n):
    y, n = np.array(y, float), np.array(n, float)
    m = y.sum() / n.sum()
    v = (n * (y / n - m) ** 2).sum() / n.sum() - m / n.mean()
    v = v if v > 0 else m * m / 1e6
    return m * m / v, m / v


@pytest.mark.parametrize("y,n", [([4, 9, 2, 11], [130, 210, 90, 260]), ([0, 2, 0, 7, 1, 0, 13, 2], [350, 620, 410, 990, 730, 280, 1500, 640]), ([0, 0, 0, 31], [800] * 4), ([6, 12, 18], [150, 300, 450])])
def test_shrinkage(spark, y, n):
    df = units(spark, y, n)
    got = rates.poisson_gamma_prior(df, "y", "n").first()
    shape, rate = prior(y, n)
    assert (got["shape"], got["rate"]) == (pytest.approx(shape, rel=1e-9), pytest.approx(rate, rel=1e-9))
    for r in rates.shrink(df, "y", "n").collect():
        a, b = shape + r["y"], rate + r["n"]
        assert r["shrunken_rate"] == pytest.approx(a / b * 1e5, rel=1e-9)
        for c, p in (("shrunken_low", 0.025), ("shrunken_high", 0.975)):
            assert float(special.gamma_cdf(a, r[c] / 1e5 * b)) == pytest.approx(p, abs=1e-9)


def test_exposures(spark):
    with pytest.raises(ValueError, match="strictly positive"):
        rates.check_exposures(units(spark, [1, 2], [0, 5]), "n")
    with pytest.raises(ValueError, match="at least 2 units"):
        rates.check_exposures(units(spark, [1], [5]), "n")


def test_special_functions():
    p = np.array([0.001, 0.025, 0.5, 0.975, 0.999])
    assert np.allclose(special.gamma_quantile(p, 1.0), -np.log1p(-p), rtol=1e-10)
    for a in (0.2, 0.7, 3.0, 150.0, 1e4):
        assert np.allclose(special.gamma_cdf(a, special.gamma_quantile(p, a)), p, atol=1e-10)
    assert special.normal_quantile(0.975) == pytest.approx(1.959963984540054)
    assert float(special.chi2_tail(3.841458820694124, 1)) == pytest.approx(0.05)
    assert special.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05)


def test_coverage(spark):
    known = spark.createDataFrame([("A", 0.5), ("B", 1.3)], "state string, capture_rate double")
    df = spark.createDataFrame([("A", 10.0, 9.0), ("B", 10.0, None), ("C", 10.0, None), ("D", 10.0, 5.876)], "state string, y double, ld double")
    out = {r["state"]: r for r in rates.correct_coverage(df, "state", "y", known, "ld").collect()}
    assert out["A"]["coverage"] == 0.5 and out["A"]["corrected"] == 20 and out["A"]["corrected_low"] is None
    assert out["B"]["coverage"] == 1.0 and out["B"]["coverage_source"] == "calibrated"
    assert out["C"]["coverage"] == pytest.approx(0.61) and out["D"]["coverage"] == pytest.approx(0.61 * math.exp(0.062))
    assert out["C"]["corrected_high"] == pytest.approx(10 / (0.61 * math.exp(-1.96 * math.sqrt(0.1062))))


def test_chapman_values(spark):
    population, se = rates.chapman(F.lit(90), F.lit(60), F.lit(25))
    got = spark.range(1).select(population.alias("n"), se.alias("s")).first()
    assert got["n"] == pytest.approx(91 * 61 / 26 - 1) and got["s"] == pytest.approx((91 * 61 * 65 * 35 / (26 * 26 * 27)) ** 0.5)


@pytest.mark.parametrize("name", ["match_optimal", "match_greedy"])
def test_matches_are_one_to_one(spark, name):
    got = catalog.QUERIES[name](spark, DATA).filter("b_id is not null").collect()
    assert got and len({r["a_id"] for r in got}) == len({r["b_id"] for r in got}) == len(got)
    assert all(r["score"] >= 65 and r["a_id"] % 2 == 0 and r["b_id"] % 2 == 1 for r in got)


def test_shrinkage_refuses_bad_exposures(spark):
    for y, n, text in (([1, 2], [0, 5], "strictly positive"), ([1], [5], "at least 2 units")):
        with pytest.raises(Exception, match=text):
            rates.shrink(units(spark, y, n), "y", "n", interval=False).collect()


def test_scores():
    def longest(a, b):
        held = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                held[i + 1][j + 1] = held[i][j] + 1 if x == y else max(held[i][j + 1], held[i + 1][j])
        return held[-1][-1]

    ratio = lambda a, b: 200 * longest(a, b) / (len(a) + len(b))
    assert tx.sorted_ratio("stone harbour cellars", "harbour stone cellar") == pytest.approx(ratio("cellars harbour stone", "cellar harbour stone"), abs=0.01)
    # of sets: the shared words, with what one has besides
    shared, left, right = "harbour stone", "harbour stone cellars", "harbour stone yard"
    assert tx.set_ratio("stone harbour cellars", "harbour stone yard") == pytest.approx(max(ratio(shared, left), ratio(shared, right), ratio(left, right)), abs=0.01)
    assert tx.set_ratio("a b", "a") == 100 and tx.set_ratio("a", "") == 0
    assert tx.common_subsequence("abcbdab", "bdcaba") == 4


def test_names(spark):
    df = spark.createDataFrame([("Foo Brewing Company, LLC",), ("Big  Bob's Ales",), (None,), ("A / B Taproom",)], "n string")
    got = [(r["x"], r["v"]) for r in df.select(tx.normal_name(F.col("n")).alias("x"), tx.name_variants(F.col("n")).alias("v")).collect()]
    assert [g[0] for g in got] == ["foo", "big bob s", "", "a b"] and got[3][1] == ["a b", "a", "b"] and got[2][1] == [""]


def brute_matching(n, m, score):
    """Most pairs, then the highest sum, over all ways to match."""
    best = (0, 0.0)
    for way in itertools.product(*[[-1, *[j for j in range(m) if (i, j) in score]] for i in range(n)]):
        used = [j for j in way if j >= 0]
        if len(used) == len(set(used)):
            best = max(best, (len(used), sum(score[i, j] for i, j in enumerate(way) if j >= 0)))
    return best


def test_matching_is_optimal():
    rng = np.random.default_rng(0)
    for trial in range(300):
        n, m = int(rng.integers(1, 6)), int(rng.integers(1, 6))
        score = {(i, j): float(rng.integers(65, [101, 68][trial % 2])) for i in range(n) for j in range(m) if rng.random() < [0.3, 0.6, 1.0][trial % 3]}
        if not score:
            continue
        row, col = np.array(list(score)).T
        of = linkage.best_matching(row, col, np.array(list(score.values())), n, m)
        used = [j for j in of if j >= 0]
        assert len(used) == len(set(used)) and all((i, j) in score for i, j in enumerate(of) if j >= 0)
        assert (len(used), sum(score[i, j] for i, j in enumerate(of) if j >= 0)) == brute_matching(n, m, score)


def test_large_component_in_little_memory():
    """5,000 by 5,000 with 50,000 pairs: memory of the pairs, not of a matrix (400 MB)."""
    import tracemalloc

    rng = np.random.default_rng(0)
    at = np.unique(rng.integers(0, 25_000_000, 50_000))
    tracemalloc.start()
    of = linkage.best_matching(at // 5000, at % 5000, rng.choice([100.0, 80.0, 66.5], len(at)), 5000, 5000)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    used = [j for j in of if j >= 0]
    assert most < 60e6 and len(used) == len(set(used)) > 4900


def test_thinned_edges_keep_components(spark):
    edges = spark.range(2000).select((F.col("id") % 50).alias("src"), (F.col("id") * 7 % 40 + 50 * (F.col("id") % 2)).alias("dst")).repartition(6)
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    thin = graphs.thinned(edges).cache()
    assert thin.count() <= 6 * 100
    assert sorted(map(tuple, graphs.components(nodes, thin).collect())) == sorted(map(tuple, graphs.components(nodes, edges).collect()))


def far(a, b):
    (p, x), (q, y) = a, b
    h = math.sin(math.radians(q - p) / 2) ** 2 + math.cos(math.radians(p)) * math.cos(math.radians(q)) * math.sin(math.radians(y - x) / 2) ** 2
    return 2 * 6_371_000 * math.asin(min(1.0, math.sqrt(h)))


@pytest.mark.parametrize("cell_points", [20_000, 5])
def test_distance_join_everywhere(spark, cell_points):
    """Clusters in one cell, the date line, the poles and a radius of half the world, against all pairs."""
    rng = np.random.default_rng(2)
    spots = [(0.0, 179.9995), (0.001, -179.9995), (60.0, 180.0), (60.0, -180.0), (89.9999, 10.0), (89.9999, -170.0), (-89.9995, 33.0), (None, 3.0), (5.0, None)]
    spots += [(40 + float(y), 20 + float(x)) for y, x in rng.normal(0, 0.002, (120, 2))] + [(float(y), float(x)) for y, x in zip(rng.uniform(-90, 90, 60), rng.uniform(-180, 180, 60), strict=True)]
    a, b = (spark.createDataFrame([(i, *p) for i, p in enumerate(s)], f"{n}_id long, {n}_lat double, {n}_lon double") for n, s in (("a", spots), ("b", spots[::2])))
    for radius in (150.0, 900.0, 4_000_000.0):
        got = sorted((r["a_id"], r["b_id"]) for r in spatial.distance_join(a, b, radius, cell_points=cell_points).collect())
        want = sorted((i, j) for i, p in enumerate(spots) for j, q in enumerate(spots[::2]) if None not in (*p, *q) and far(p, q) <= radius)
        assert got == want


def test_distance_join_of_a_dense_cell(spark):
    """100,000 points in one cell go to many tasks."""
    a = spark.range(100_000).select(F.col("id").alias("a_id"), (40 + (F.col("id") % 1000) * 1e-6).alias("a_lat"), (20 + F.floor(F.col("id") / 1000) * 1e-5).alias("a_lon"))
    b = spark.createDataFrame([(0, 40.0, 20.0), (1, 40.0005, 20.0005), (2, 41.0, 20.0)], "b_id long, b_lat double, b_lon double")
    out = spatial.distance_join(a, b, 50.0, cell_points=2000)
    rows = out.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    points = [(40 + i % 1000 * 1e-6, 20 + i // 1000 * 1e-5) for i in range(100_000)]
    y, x = np.radians(np.array(points).T)
    want = 0
    for q in ((40.0, 20.0), (40.0005, 20.0005)):
        p, z = np.radians(q)
        want += int((2 * 6_371_000 * np.arcsin(np.sqrt(np.sin((y - p) / 2) ** 2 + np.cos(y) * np.cos(p) * np.sin((x - z) / 2) ** 2)) <= 50).sum())
    assert sum(r["count"] for r in rows) == want


def test_matching(spark):
    a = spark.createDataFrame([(0, "Fern Brewing", 35.78, -78.64), (1, "Oak Ales", 35.79, -78.64), (2, "Lone", 10.0, 10.0), (3, "Nowhere", None, None)], "a_id long, a_name string, a_lat double, a_lon double")
    b = spark.createDataFrame([(0, "Fern Brewery", 35.7801, -78.6401), (1, "Oakley", 35.7921, -78.64), (2, "Oak Ales", 35.7901, -78.64)], "b_id long, b_name string, b_lat double, b_lon double")
    got = {r["a_id"]: r["b_id"] for r in linkage.match_optimal(linkage.candidates(a, b)).collect()}
    assert got == {0: 0, 1: 2}
    staged = {r["a_id"]: (r["b_id"], r["stage"]) for r in linkage.match_staged(a, b).collect()}
    assert staged[0] == (0, 0) and staged[3] == (None, None) and len(staged) == 4
    assert linkage.match_optimal(linkage.candidates(a.limit(0), b)).count() == 0


def test_polygons(spark):
    shapes = spark.createDataFrame([("tri", [0.0, 4.0, 0.0], [0.0, 0.0, 4.0])], "area_id string, xs array<double>, ys array<double>")
    points = spark.createDataFrame([(0, 1.0, 1.0), (1, 3.0, 3.0), (2, 0.0, 2.0), (3, None, 1.0), (4, 2.0, 2.0)], "point_id long, x double, y double")
    assert {r["point_id"]: r["area_id"] for r in spatial.points_in_polygons(points, shapes, 1.0).collect()} == {0: "tri", 1: None, 2: None, 3: None, 4: None}


def test_polygons_of_several_rings(spark):
    rings = [[0.0, 6.0, 6.0, 0.0], [2.0, 4.0, 4.0, 2.0], [8.0, 9.0, 8.0]], [[0.0, 0.0, 6.0, 6.0], [2.0, 2.0, 4.0, 4.0], [0.0, 0.0, 1.0]]
    shapes = spark.createDataFrame([("a", *rings)], "area_id string, xs array<array<double>>, ys array<array<double>>")
    points = spark.createDataFrame([(0, 1.0, 1.0), (1, 3.0, 3.0), (2, 2.0, 3.0), (3, 8.25, 0.25), (4, 7.0, 0.5), (5, 5.0, 3.0)], "point_id long, x double, y double")
    got = {r["point_id"]: r["area_id"] for r in spatial.points_in_polygons(points, shapes, 1.0).collect()}
    assert got == {0: "a", 1: None, 2: None, 3: "a", 4: None, 5: "a"}
    assert spatial.points_in_polygons(points, shapes.limit(0), 1.0).filter("area_id is not null").count() == 0


def test_polygons_match_edge_by_edge(spark):
    rng = np.random.default_rng(5)
    xy = rng.uniform(0, 10, (300, 2))
    angle = np.sort(rng.uniform(0, 2 * math.pi, 40))
    star = np.c_[5 + rng.uniform(1, 5, 40) * np.cos(angle), 5 + rng.uniform(1, 5, 40) * np.sin(angle)]
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "point_id long, x double, y double")
    shapes = spark.createDataFrame([("s", star[:, 0].tolist(), star[:, 1].tolist())], "area_id string, xs array<double>, ys array<double>")

    def inside(x, y):
        odd = False
        for (x1, y1), (x2, y2) in zip(star, np.roll(star, -1, axis=0), strict=True):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
        return odd

    got = {r["point_id"] for r in spatial.points_in_polygons(points, shapes, 1.0).filter("area_id is not null").collect()}
    assert got == {i for i, (x, y) in enumerate(xy) if inside(x, y)}


def test_held_out_density(spark):
    train = units(spark, [4, 90, 20, 61, 33], [130, 410, 390, 260, 300])
    test = units(spark, [0, 12, 45, 300], [50, 90, 200, 1500])
    p = rates.poisson_gamma_prior(train, "y", "n").first()
    for r in rates.held_out_log_density(train, test, "y", "n").collect():
        y, n, a, b = r["y"], r["n"], p["shape"], p["rate"]
        exact = math.lgamma(y + a) - math.lgamma(a) - math.lgamma(y + 1) + a * math.log(b / (b + n)) + y * math.log(n / (b + n))
        assert r["lpd"] == pytest.approx(exact, abs=1e-9)
        assert r["lpd_grid"] == pytest.approx(exact, abs=2e-3)
    assert rates.held_out_log_density(train, test.limit(0), "y", "n").count() == 0
    assert all(r["lpd"] is None for r in rates.held_out_log_density(units(spark, [0, 0], [5, 9]), test, "y", "n").collect())


@pytest.mark.parametrize("x", [1e-3, 0.5, 1.0, 3.7, 20.0, 1e6])
def test_log_gamma_column(spark, x):
    assert spark.range(1).select(rates.log_gamma(F.lit(x)).alias("g")).first()["g"] == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-11)


def test_holdout_share(spark):
    df = regress.holdout(spark.range(20_000), "id", 0.3, 7)
    assert df.filter("held_out").count() / 20_000 == pytest.approx(0.3, abs=0.015)
    assert df.filter("held_out").exceptAll(regress.holdout(spark.range(10_000, 20_000).union(spark.range(10_000)), "id", 0.3, 7)).isEmpty()


def test_moran_permutations(spark):
    rng = np.random.default_rng(3)
    v = np.sort(rng.normal(size=12))
    values = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "node int, v double")
    path = spark.createDataFrame([(i, i + 1) for i in range(11)], "src int, dst int")
    got = spatial.moran_permutations(values, path, "v", 499).first()
    z = v - v.mean()
    near = [(i, j) for i in range(12) for j in (i - 1, i + 1) if 0 <= j < 12]
    w = np.array([1 / (1 if i in (0, 11) else 2) for i, _ in near])
    statistic = lambda z: 12 / w.sum() / (z @ z) * sum(k * z[i] * z[j] for k, (i, j) in zip(w, near, strict=True))
    assert got["statistic"] == pytest.approx(statistic(z))
    larger = sum(statistic(np.random.default_rng([42, k]).permutation(z)) >= statistic(z) - 1e-12 for k in range(499))
    assert got["as_large"] == larger


def test_nb_leave_group_out(spark):
    rng = np.random.default_rng(11)
    table = [(f"u{i}", float(rng.poisson(20 + 10 * (i % 3))), float(rng.normal()), 100.0, i % 3) for i in range(45)]
    df = spark.createDataFrame(table, "area string, y double, x double, n double, g int")
    got = {r["area"]: r for r in regress.nb_leave_group_out(df, "area", "y", ["x"], "n", "g").collect()}
    assert len(got) == 45
    frame = df.toPandas()
    for fold in range(3):
        rest = [g for g in range(3) if g != fold]
        train = frame[frame["g"] != fold]
        beta, alpha, _ = dense_fits.fit_nb(train["y"], dense_fits.design(train, ["x"], rest, "g"), np.log(train["n"].to_numpy()))
        for area, y, x, n, g in table:
            if g == fold:
                mu = n * math.exp(x * beta[0] + (beta[1] + beta[2]) / 2)
                k = 1 / alpha
                density = math.lgamma(y + k) - math.lgamma(k) - math.lgamma(y + 1) + k * math.log(k / (k + mu)) + y * math.log(mu / (k + mu))
                assert got[area]["fold"] == str(fold)
                assert (got[area]["expected"], got[area]["log_density"]) == (pytest.approx(mu, rel=1e-6), pytest.approx(density, rel=1e-6))


def test_near_twins_by_brute_force(spark):
    rng = np.random.default_rng(17)
    names = ["Fern Ales", "fern ales", "Oak", "", None]
    table = [(i, names[int(rng.integers(5))], float(40 + rng.uniform(0, 0.004)), float(rng.uniform(0, 0.004))) for i in range(150)] + [(150, "Oak", None, None), (151, "Oak", None, 0.0)]
    df = spark.createDataFrame(table, "id long, name string, lat double, lon double")
    key = dict(df.select("id", linkage.normal_name(F.col("name")).alias("k")).collect())

    def metres(a, b):
        p, q = math.radians(a[2]), math.radians(b[2])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
        return 2 * spatial.EARTH_M * math.asin(math.sqrt(h))

    kept = []
    for row in table:
        place = row[2] is not None and row[3] is not None
        twins = [k for k in kept if place and k[2] is not None and k[3] is not None and key[k[0]] and key[k[0]] == key[row[0]] and metres(k, row) <= 100]
        if not twins:
            kept.append(row)
    assert {r["id"] for r in linkage.drop_near_twins(df).collect()} == {r[0] for r in kept}
    assert 20 < len(kept) < 152
    assert linkage.drop_near_twins(df.limit(0)).isEmpty()


def test_nb_regression(spark):
    """The fit from partitions' sums against a search over whole arrays, and the truth."""
    rng = np.random.default_rng(4)
    g, x, n = rng.integers(0, 3, 4000), rng.normal(size=(4000, 2)), rng.uniform(0.5, 2, 4000)
    mu = n * np.exp(x @ [0.5, -0.2] + np.array([1.0, 0.0, 2.0])[g])
    y = rng.poisson(mu * rng.gamma(4.0, 0.25, 4000)).astype(float)
    frame = pd.DataFrame({"y": y, "x": x[:, 0], "z": x[:, 1], "n": n, "g": g})
    df = spark.createDataFrame(frame).repartition(6)
    got = dict(map(tuple, regress.nb_regression(df, "y", ["x", "z"], "n", "g").collect()))
    beta, alpha, ll = dense_fits.fit_nb(y, dense_fits.design(frame, ["x", "z"], [0, 1, 2], "g"), np.log(n))
    assert [got[k] for k in ("x", "z", "0", "1", "2")] == pytest.approx(beta.tolist(), abs=1e-6) and got["alpha"] == pytest.approx(alpha, rel=1e-5)
    assert got["log_likelihood"] == pytest.approx(ll, rel=1e-9) and got["log_likelihood"] >= ll - 1e-6
    assert [got["x"], got["z"]] == pytest.approx([0.5, -0.2], abs=0.05) and got["alpha"] == pytest.approx(0.25, abs=0.05)
    # counts of less spread than Poisson's: the dispersion ends at its bound
    even = spark.createDataFrame([(5.0, float(i), 1.0, 0) for i in range(30)], "y double, x double, n double, g int")
    flat = dict(map(tuple, regress.nb_regression(even, "y", ["x"], "n", "g").collect()))
    assert flat["alpha"] == pytest.approx(math.exp(-9)) and flat["0"] == pytest.approx(math.log(5)) and flat["x"] == pytest.approx(0, abs=1e-8)


def test_polygammas():
    x = np.array([0.01, 0.3, 1.0, 2.5, 9.9, 10.0, 57.0, 1e5])
    h = 1e-5 * x
    assert np.allclose(special.digamma(x), (special.log_gamma(x + h) - special.log_gamma(x - h)) / (2 * h), rtol=1e-6)
    assert np.allclose(special.trigamma(x), (special.digamma(x + h) - special.digamma(x - h)) / (2 * h), rtol=1e-6)
    assert special.digamma(1.0) == pytest.approx(-0.5772156649015329) and special.trigamma(1.0) == pytest.approx(math.pi**2 / 6)


def test_laplace_without_field_is_near_the_fit():
    rng = np.random.default_rng(4)
    y = rng.poisson(5.0, 40).astype(float)
    eta, spread, _ = bayes.laplace(y, np.ones((40, 1)), np.zeros(40), np.eye(40) * 1e6, 1e-3)
    assert np.exp(eta).mean() == pytest.approx(y.mean(), rel=0.02) and (spread > 0).all()


def test_components_chain(spark):
    nodes = spark.range(40).select(F.col("id").alias("node"))
    edges = spark.range(29).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = {r["node"]: r["component"] for r in graphs.components(nodes, edges).collect()}
    assert all(got[i] == 0 for i in range(30)) and all(got[i] == i for i in range(30, 40))


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", None, None), (2, None, 3.0, 4.0)], "k long, name string, lat double, lon double")
    filled, audit = tables.fill_coordinates(df, spark.createDataFrame([(1, 5.0, 6.0)], "k long, lat double, lon double"), "k")
    assert audit.first().asDict() == {"attempted": 1, "recovered": 1, "still_missing": 0} and filled.filter("lat is null").count() == 0
    assert tables.unmatched_keys(df, df.limit(1), ["k"]).count() == 1
    with pytest.raises(Exception, match="closed list"):
        tables.expect(df, F.col("name").isNotNull(), "closed list").collect()
    metrics = ranking.error_metrics(spark.createDataFrame([(1.0, 2.0), (4.0, 2.0)], "t double, g double"), "t", "g").first()
    assert metrics["mae"] == 1.5


def test_readers(spark, tmp_path):
    (tmp_path / "map.json").write_text('{"elements": [{"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"name": "a"}}, {"type": "way", "id": 2, "center": {"lat": 3.0, "lon": 4.0}, "tags": {"name": "b"}}, {"type": "node", "id": 3, "lat": 1.0, "lon": 2.0, "tags": {}}]}')
    assert sorted((r["id"], r["lat"]) for r in readers.map_elements(spark, str(tmp_path / "map.json")).collect()) == [("node/1", 1.0), ("way/2", 3.0)]
    (tmp_path / "grid.json").write_text('[["NAME", "n"], ["x", "5"], ["y", "bad"]]')
    assert [tuple(r) for r in readers.array_table(spark, str(tmp_path / "grid.json"), "n int, NAME string").collect()] == [(5, "x"), (None, "y")]
    page = spark.createDataFrame([(1, "<td>h1</td><td>h2</td><td>a&nbsp;b</td><td><b>c</b></td>")], "page_id long, html string")
    assert readers.table_cells(page, "html", "page_id", 2, 2).first()["cells"] == ["a b", "c"]
    text = spark.createDataFrame([(1, "name\nstreet\nANCHOR 7\nother")], "id long, body string")
    assert readers.anchored_lines(text, "id", "body", lambda c: c.startswith("ANCHOR"), {"name": -2, "street": -1}).first()["name"] == "name"
    (tmp_path / "s-2.csv").write_text("type,id,n\nbar,1,5\npub,2,6\nbar,1,7\n")
    assert readers.latest_snapshot(spark, str(tmp_path / "s-*.csv")).endswith("s-2.csv")


def test_stream(spark, tmp_path):
    spark.read.parquet(f"{DATA}/events.parquet").select("ts", "event_type").limit(500).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "in"))
    query = windowed_counts(stream, "ts", "event_type").writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("windowed").agg(F.sum("events")).first()[0] == 500


def test_search_returns_every_match(spark):
    part = pd.read_parquet("/root/testdata/sf0.01/part.parquet")
    want = part[part["p_name"].str.lower().str.contains("re", regex=False) | part["p_brand"].str.lower().str.contains("#1", regex=False)]
    got = catalog.QUERIES["search_all"](spark, "/root/testdata/sf0.01").toPandas()
    assert len(want) > 200 and sorted(got["p_partkey"]) == sorted(want["p_partkey"])


def test_linkage_takes_every_part(spark):
    part = pd.read_parquet(f"{DATA}/part.parquet")
    score = lambda x, y: tx.variants_score([x], [y])
    halves = [[(r.p_partkey, r.p_name, r.p_brand) for r in part.sort_values("p_partkey").itertuples() if r.p_partkey % 2 == k] for k in (0, 1)]
    want = {(a[0], b[0]): score(a[1], b[1]) for a in halves[0] for b in halves[1] if a[2] == b[2]}
    got = {(r["a_id"], r["b_id"]): r["score"] for r in catalog.QUERIES["name_similarity"](spark, DATA).collect()}
    assert len(want) > 64 and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    greedy, free = {}, list(halves[1])
    for a in halves[0]:
        best = max((b for b in free if b[2] == a[2]), key=lambda b: (score(a[1], b[1]), -b[0]), default=None)
        if best and score(a[1], best[1]) >= 65:
            free.remove(best)
            greedy[a[0]] = best[0]
    assert {r["a_id"]: r["b_id"] for r in catalog.QUERIES["match_greedy"](spark, DATA).collect()} == greedy
    place = lambda k: (40 + k % 7 * 0.001, k % 5 * 0.001)

    def metres(a, b):
        (p, x), (q, y) = map(place, (a, b))
        h = math.sin(math.radians(q - p) / 2) ** 2 + math.cos(math.radians(p)) * math.cos(math.radians(q)) * math.sin(math.radians(y - x) / 2) ** 2
        return 2 * 6_371_000 * math.asin(math.sqrt(h))

    # most pairs first, then the sum of scores: an assignment of each brand
    near = {k: s for k, s in want.items() if s >= 65 and metres(*k) <= 300}
    most = total = 0
    for brand in {a[2] for a in halves[0]}:
        ids = [[r[0] for r in h if r[2] == brand] for h in halves]
        own = [(x, y) for x, i in enumerate(ids[0]) for y, j in enumerate(ids[1]) if (i, j) in near]
        if not own:
            continue
        row, col = np.array(own).T
        of = linkage.best_matching(row, col, np.array([near[ids[0][x], ids[1][y]] for x, y in own]), len(ids[0]), len(ids[1]))
        pairs = [(ids[0][i], ids[1][j]) for i, j in enumerate(of) if j >= 0]
        most, total = most + len(pairs), total + sum(near[p] for p in pairs)
    rows = catalog.QUERIES["match_optimal"](spark, DATA).collect()
    assert len({r["a_id"] for r in rows}) == len({r["b_id"] for r in rows}) == len(rows) == most
    assert all(near[(r["a_id"], r["b_id"])] == pytest.approx(r["score"]) for r in rows) and sum(r["score"] for r in rows) == pytest.approx(total)
    staged = catalog.QUERIES["match_staged"](spark, DATA).toPandas()
    assert sorted(staged["a_id"]) == [a[0] for a in halves[0]] and staged["b_id"].dropna().is_unique and len(staged["b_id"].dropna()) >= most
