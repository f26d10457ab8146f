"""Polygons: nesting, well-known binary, polygon files, centroids, and distances in a plane."""

from __future__ import annotations

import math
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratefield.functions import shapes
from ratefield.operators import spatial
from ratefield.sources import polygons

SQUARE, HOLE, ISLAND, OTHER = ([0.0, 4.0, 4.0, 0.0], [0.0, 0.0, 4.0, 4.0]), ([1.0, 1.0, 3.0, 3.0], [1.0, 3.0, 3.0, 1.0]), ([1.5, 2.5, 2.0], [1.5, 1.5, 2.5]), ([9.0, 9.0, 8.0], [0.0, 1.0, 0.0])
SCHEMA = "name string, key long, share double, xs array<array<double>>, ys array<array<double>>"


def row(name, key, share, *rings):
    return (name, key, share, [list(r[0]) for r in rings], [list(r[1]) for r in rings])


def areas(*rings):
    return sorted(round(shapes.signed_area(*r), 9) for part in shapes.oriented(shapes.rings_of(*zip(*rings, strict=True))) for r in part)


@pytest.fixture(scope="module")
def rows(spark):
    data = [row("Å ring", 1, 0.1 + 0.2, SQUARE, HOLE), row("nested", 2, -1e-17, HOLE, SQUARE, ISLAND, OTHER), row(None, None, None, OTHER), ("no shape", 4, 1e300, None, None), ("empty", 5, 0.0, [], [])]
    return spark.createDataFrame(data + [row(f"n{i}", i, float(i), ([float(i), i + 1.0, float(i)], [0.0, 0.0, 1.0])) for i in range(100, 150)], SCHEMA)


def test_nesting():
    assert areas(SQUARE, HOLE) == areas(HOLE, SQUARE) == [-4.0, 16.0]
    assert areas(HOLE, SQUARE, ISLAND, OTHER) == [-4.0, 0.5, 0.5, 16.0]
    assert [sorted(p) for p in shapes.nested(shapes.rings_of(*zip(HOLE, SQUARE, ISLAND, OTHER, strict=True)))] == [[0, 1], [2], [3]]
    assert areas(([0.0, 1.0], [0.0, 1.0])) == []


def test_binary_round_trip(spark, rows):
    back = {r["name"]: r for r in shapes.with_rings(shapes.with_wkb(rows)).collect()}
    assert len(back["nested"]["xs"]) == 4 and back["no shape"]["xs"] is None and back["empty"]["xs"] == []
    got = sorted(shapes.signed_area(np.array(x), np.array(y)) for x, y in zip(back["nested"]["xs"], back["nested"]["ys"], strict=True))
    assert got == [-4.0, 0.5, 0.5, 16.0]


def test_binary_of_others():
    ring = [(0.0, 0.0, 7.0), (2.0, 0.0, 7.0), (0.0, 2.0, 7.0), (0.0, 0.0, 7.0)]
    for kind, flag in ((1003, 0), (3, 0x80000000)):
        data = struct.pack(">BIII", 0, kind | flag, 1, 4) + b"".join(struct.pack(">3d", *p) for p in ring)
        (x, y) = shapes.from_wkb(data)[0][0]
        assert (x.tolist(), y.tolist()) == ([0.0, 2.0, 0.0], [0.0, 0.0, 2.0])
    with_system = struct.pack("<BIII", 1, 3 | 0x20000000, 4326, 1) + struct.pack("<I", 4) + b"".join(struct.pack("<2d", *p[:2]) for p in ring)
    assert shapes.from_wkb(with_system)[0][0][0].tolist() == [0.0, 2.0, 0.0]
    with pytest.raises(ValueError, match="not a polygon"):
        shapes.from_wkb(struct.pack("<BIdd", 1, 1, 0.0, 0.0))


def test_files_round_trip(spark, rows, tmp_path):
    polygons.register(spark)
    place = str(tmp_path / "p")
    rows.repartition(3).write.format("polygons").mode("overwrite").save(place)
    df = spark.read.format("polygons").option("records", "7").load(place)
    assert df.drop("xs", "ys").schema == rows.drop("xs", "ys").schema and df.rdd.getNumPartitions() > 5
    back = {r["key"]: r for r in df.collect()}
    assert len(back) == 55 and back[1]["name"] == "Å ring" and back[1]["share"] == 0.1 + 0.2 and back[2]["share"] == -1e-17 and back[4]["share"] == 1e300
    assert back[4]["xs"] is None and back[5]["xs"] is None and back[None]["name"] is None
    assert sorted(shapes.signed_area(np.array(x), np.array(y)) for x, y in zip(back[2]["xs"], back[2]["ys"], strict=True)) == [-4.0, 0.5, 0.5, 16.0]
    assert df.select("name").filter("key = 120").first()["name"] == "n120"
    rows.limit(2).write.format("polygons").mode("overwrite").save(place)
    assert spark.read.format("polygons").load(place).count() == 2 and not [f for f in os.listdir(place) if f.startswith("_")]
    rows.filter("key = 4").write.format("polygons").mode("append").save(place)
    assert spark.read.format("polygons").load(place).count() == 3


def test_file_layout(spark, rows, tmp_path):
    """The header, the index and a record as the public format has them."""
    polygons.register(spark)
    rows.filter("key = 1").coalesce(1).write.format("polygons").mode("overwrite").save(str(tmp_path / "p"))
    name = next(f for f in os.listdir(tmp_path / "p") if f.endswith(".shp"))
    data = (tmp_path / "p" / name).read_bytes()
    assert struct.unpack(">i", data[:4])[0] == 9994 and struct.unpack(">i", data[24:28])[0] * 2 == len(data) and struct.unpack("<ii", data[28:36]) == (1000, 5)
    assert struct.unpack("<4d", data[36:68]) == (0.0, 0.0, 4.0, 4.0) and struct.unpack(">ii", data[100:108]) == (1, (len(data) - 108) // 2)
    assert struct.unpack("<ii", data[144:152]) == (2, 10)
    points = np.frombuffer(data[160:], "<f8").reshape(-1, 2)
    assert points[0].tolist() == points[4].tolist() and shapes.signed_area(*points[:4].T) == -16.0 and shapes.signed_area(*points[5:9].T) == 4.0


def test_files_refuse(spark, tmp_path):
    polygons.register(spark)
    rings = "array(array(0D, 1D, 0D)) as xs, array(array(0D, 0D, 1D)) as ys"
    for column, text in (("repeat('x', 300) as t", "a text of 300 bytes"), ("1 as much_too_long", "ten bytes"), ("array(1) as t", "has no array")):
        with pytest.raises(Exception, match=text):
            spark.sql(f"select {column}, {rings}").write.format("polygons").mode("append").save(str(tmp_path / "p"))
    with pytest.raises(Exception, match="no shapefile"):
        os.makedirs(tmp_path / "none")
        spark.read.format("polygons").load(str(tmp_path / "none"))


def test_moments(spark, rows):
    got = {r["key"]: r for r in shapes.moments(shapes.with_orientation(rows), "key").collect()}
    assert (got[1]["area"], got[1]["x"], got[1]["y"]) == (12.0, 2.0, 2.0)
    want = [(16, 2, 2), (-4, 2, 2), (0.5, 2, 11 / 6), (0.5, 26 / 3, 1 / 3)]
    assert got[2]["area"] == 13.0 and got[2]["x"] == pytest.approx(sum(a * x for a, x, _ in want) / 13) and got[2]["y"] == pytest.approx(sum(a * y for a, _, y in want) / 13)
    assert got[130]["x"] == pytest.approx(130 + 1 / 3) and 4 not in got


def test_projection():
    """Snyder's worked example has the Clarke ellipsoid; here the sphere's limit: areas are kept."""
    a, e, n, c, rho0 = spatial.albers_terms()
    assert 0.6 < n < 0.61 and rho0 > 9e6
    side = 0.01

    def at(lon, lat):
        s = math.sin(math.radians(lat))
        q = (1 - e * e) * (s / (1 - e * e * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))
        rho, theta = a * math.sqrt(c - n * q) / n, n * math.radians(lon + 96)
        return rho * math.sin(theta), rho0 - rho * math.cos(theta)

    for lat in (25.0, 40.0, 49.0):
        ring = [at(-100 + u * side, lat + v * side) for u, v in ((0, 0), (1, 0), (1, 1), (0, 1))]
        area = shapes.signed_area(*np.array(ring).T)
        curve = a * math.sqrt(1 - e * e) / (1 - (e * math.sin(math.radians(lat + side / 2))) ** 2)
        assert area == pytest.approx((curve * math.radians(side)) ** 2 * math.cos(math.radians(lat + side / 2)), rel=1e-6)


def test_away_from_anchors(spark):
    rng = np.random.default_rng(5)
    spots = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(-97, -96.8, 300), rng.uniform(39, 39.2, 300), strict=True))] + [(300, None, 39.0)]
    points = spark.createDataFrame(spots, "point_id long, lon double, lat double")
    anchors = points.filter("point_id % 60 = 0").select("lon", "lat")
    plane = {r["point_id"]: (r["x"], r["y"]) for r in points.select("point_id", *[c.alias(k) for k, c in zip("xy", spatial.albers(F.col("lon"), F.col("lat")), strict=True)]).collect()}
    held = [plane[i] for i in range(0, 300, 60)]
    want = [i for i in range(301) if plane[i][0] is None or all(math.dist(plane[i], a) >= 2500 for a in held)]
    assert sorted(r["point_id"] for r in spatial.away_from(points, anchors, 2500.0).collect()) == want
