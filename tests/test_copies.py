"""Queries on tables of repeated rows, where ties and groups of copies decide."""

from __future__ import annotations

import math
import random

import duckdb

from ratefield.operators import graphs, linkage, spatial
from ratefield.plans import catalog


def test_richest_and_poorest_at_ties(spark, tmp_path):
    rows = "(0, 'A', 5.0), (1, 'A', 9.0), (2, 'A', 5.0), (3, 'A', 9.0), (4, 'B', NULL), (5, 'B', 1.0), (NULL, 'B', 0.0), (NULL, 'B', 2.0), (6, 'C', NULL), (7, NULL, -1.0), (8, NULL, -1.0)"
    con = duckdb.connect(config={"threads": 1})
    con.sql(f"CREATE TABLE customer AS SELECT k::BIGINT AS c_custkey, s AS c_mktsegment, b::DOUBLE AS c_acctbal FROM (VALUES {rows}) AS v(k, s, b)")
    con.sql(f"COPY customer TO '{tmp_path}/customer.parquet'")
    want = {tuple(r) for r in con.sql(catalog.ORACLES["argmax_rows"]).fetchall()}
    got = catalog.QUERIES["argmax_rows"](spark, str(tmp_path)).collect()
    assert len(got) == 4 and {tuple(r) for r in got} == want


def test_components_of_long_paths_keep_a_small_plan(spark):
    order = list(range(300))
    random.Random(3).shuffle(order)
    paths = [order[:200], order[200:290]]
    edges = spark.createDataFrame([(x, y) for p in paths for x, y in zip(p, p[1:], strict=False)] + [(order[290], order[290]), (order[0], 999), (999, order[250])], "src long, dst long")
    nodes = spark.createDataFrame([(x,) for x in order], "node long")
    found = graphs.components(nodes, edges)
    want = {x: x for x in order} | {x: min(p) for p in paths for x in p}
    assert {r["node"]: r["component"] for r in found.collect()} == want and found.count() == 300
    # the estimate of the plan's size is the driver's to hold
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 1000


def chain(spark, names=("a", "b")):
    """Records of one name every 200 m along a meridian, of two lists in turn."""
    rows = [(i, "old barn", 40 + i * 0.0018, -75.0) for i in range(90)]
    return [spark.createDataFrame(rows[k::2], f"{x}_id long, {x}_name string, {x}_lat double, {x}_lon double") for k, x in enumerate(names)]


def small_plan(df):
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 10_000


def test_matching_a_long_chain_keeps_a_small_plan(spark):
    found = linkage.match_optimal(linkage.candidates(*chain(spark)))
    rows = found.collect()
    assert small_plan(found) and len(rows) == len({r["a_id"] for r in rows}) == len({r["b_id"] for r in rows}) == 45
    assert all(abs(r["a_id"] - r["b_id"]) == 1 for r in rows)


def test_staged_matching_of_a_long_chain_keeps_a_small_plan(spark):
    found = linkage.match_staged(*chain(spark), stages=((300.0, 65.0), (150.0, 55.0)))
    rows = found.collect()
    assert small_plan(found) and len(rows) == 45 and {r["stage"] for r in rows} == {0}


def test_twins_along_a_long_chain_keep_a_small_plan(spark):
    rows = [(i, "old barn", 40 + i * 0.0018, -75.0) for i in range(90)]
    found = linkage.drop_near_twins(spark.createDataFrame(rows, "id long, name string, lat double, lon double"), 300.0)
    assert sorted(r["id"] for r in found.collect()) == list(range(0, 90, 2)) and small_plan(found)


def test_copies_match_by_class_as_well_as_by_pairs(spark):
    """Records of one name, place and block are matched by their number, and no row is made for each pair of them."""
    rng = random.Random(4)
    names = ["old barn", "old barns", "red mill", "red mills inn", None]
    sides = []
    for x in "ab":
        rows = [(k, rng.choice(names), 40 + rng.randrange(3) * 0.002, -75.0, rng.choice("XY")) for k in range(60)]
        sides.append(spark.createDataFrame(rows, f"{x}_id long, {x}_name string, {x}_lat double, {x}_lon double, block string"))
    a, b = sides
    pairs = {(r["a_id"], r["b_id"]): r["score"] for r in linkage.candidates(a, b, by=("block",)).collect()}
    want = linkage.match_optimal(linkage.candidates(a, b, by=("block",))).collect()
    rows = linkage.match_records(a, b, by=("block",)).collect()
    assert len({r["a_id"] for r in rows}) == len({r["b_id"] for r in rows}) == len(rows) == len(want) > 20
    assert all(abs(pairs[r["a_id"], r["b_id"]] - r["score"]) < 1e-9 for r in rows)
    assert abs(sum(r["score"] for r in rows) - sum(r["score"] for r in want)) < 1e-6
    _, classes = linkage._classes(a, "a", ("block",))
    assert classes.count() <= 30 and classes.agg({"a_size": "sum"}).first()[0] == 60


def rows_made(spark, since=0, kind=""):
    """The most rows that a step of such a name has put out in the executions since, and the number of executions."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark._jsparkSession.sharedState().statusStore()
    most, n = 0, store.executionsList().size()
    for e in (store.executionsList().apply(k) for k in range(since, n)):
        values, nodes = store.executionMetrics(e.executionId()), store.planGraph(e.executionId()).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                if kind in node.name() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most, n


def first_of_twins(rows, radius):
    """Ids that stay, by the definition: one after the other, against all rows of those that stay."""

    def metres(a, b):
        p, q = math.radians(a[2]), math.radians(b[2])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
        return 2 * spatial.EARTH_M * math.asin(math.sqrt(min(1.0, h)))

    stay = []
    for k in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == k]
        if not any(a[1] == b[1] and metres(a, b) <= radius for a in stay for b in own):
            stay += own
    return {r[0] for r in stay}


def test_twins_in_a_dense_place_make_no_row_for_each_pair(spark):
    rng = random.Random(8)
    rows = [(k, "old barn", 40.0, -75.0) for k in range(0, 1_200, 2)]
    rows += [(k, rng.choice(["old barn", "red mill"]), 40 + rng.uniform(0, 0.004), -75 + rng.uniform(0, 0.004)) for k in range(1, 1_200, 2)]
    points = spark.createDataFrame(rows, "id long, name string, lat double, lon double")
    _, since = rows_made(spark)
    got = sorted(r["id"] for r in linkage.drop_near_twins(points).collect())
    assert got == sorted(first_of_twins(rows, 100.0)) and 10 < len(got) < 200
    assert 1_000 < rows_made(spark, since)[0] < 20_000


def test_twins_around_the_globe_and_of_many_places(spark):
    """Twins across the date line and the pole, and ids with rows in several places or of several names."""
    rng = random.Random(9)
    spots = [(10.0, 180.0), (-89.999, 0.0), (0.0, 0.0), (90.0, 0.0), (60.0, -180.0)]
    rows = []
    for _ in range(400):
        lat, lon = rng.choice(spots)
        lat, lon = max(-90.0, min(90.0, lat + rng.uniform(-0.01, 0.01))), lon + rng.uniform(-0.01, 0.01) * (20 if abs(lat) > 80 else 1)
        rows.append((rng.randrange(330), rng.choice(["old barn", "red mill"]), lat, (lon + 180) % 360 - 180))
    points = spark.createDataFrame([*rows, (500, "old barn", math.nan, 0.0), (501, "old barn", math.nan, 0.0), (502, "old barn", None, 0.0)], "id long, name string, lat double, lon double")
    for radius in (100.0, 400.0):
        want = first_of_twins(rows, radius)
        assert {r["id"] for r in linkage.drop_near_twins(points, radius).collect()} == want | {500, 501, 502} and len(want) < len({r[0] for r in rows})


def test_pairs_of_copies_are_unfolded_after_all_joins(spark, tmp_path):
    """Each pair of a block comes once, also where a name has more ids than stand in one array or is null, and no join makes a row for each."""
    con = duckdb.connect(config={"threads": 1})
    con.sql("CREATE TABLE part AS SELECT k::BIGINT AS p_partkey, CASE WHEN k < 2600 THEN 'red mill' WHEN k < 2660 THEN 'old barn' WHEN k < 2680 THEN NULL ELSE 'oak' END AS p_name, CASE WHEN k < 2700 THEN 'A' END AS p_brand FROM range(2720) AS r(k)")
    con.sql(f"COPY part TO '{tmp_path}/part.parquet'")
    _, since = rows_made(spark)
    found = catalog.QUERIES["name_similarity"](spark, str(tmp_path))
    rows = found.groupBy("a_id").agg({"*": "count", "b_id": "sum", "score": "max"}).collect()
    blocks = [range(2700), range(2700, 2720)]
    assert {(r["a_id"], r["count(1)"], r["sum(b_id)"]) for r in rows} == {(k, len(b) // 2, sum(b[1::2])) for b in blocks for k in b[::2]}
    assert all(r["max(score)"] == 100 for r in rows if not 2660 <= r["a_id"] < 2680)
    assert 0 < rows_made(spark, since, "Join")[0] < 5_000 and rows_made(spark, since, "Generate")[0] == 1350**2 + 100
