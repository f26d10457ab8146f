"""Rings of polygons: nesting, orientation and well-known binary."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Ring = tuple[np.ndarray, np.ndarray]


def signed_area(x: np.ndarray, y: np.ndarray) -> float:
    """Shoelace area of a ring without its closing vertex: positive if it runs counter-clockwise. Sums are taken about its first vertex."""
    x, y = x - x[0], y - y[0]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def _within(x: float, y: float, ring: Ring) -> bool:
    a, b = ring
    c, d = np.roll(a, -1), np.roll(b, -1)
    over = (b > y) != (d > y)
    return bool((x < (c[over] - a[over]) * (y - b[over]) / (d[over] - b[over]) + a[over]).sum() % 2)


def nested(rings: list[Ring]) -> list[list[int]]:
    """Parts of an area by the even-odd rule: each an outer ring's number and its holes'. Rings of under three vertices are left out."""
    use = [i for i, (x, _) in enumerate(rings) if len(x) >= 3]
    size = {i: abs(signed_area(*rings[i])) for i in use}
    # a vertex and an edge's middle: a ring may touch another in a vertex
    spot = {i: ((rings[i][0][0] + rings[i][0][1]) / 2, (rings[i][1][0] + rings[i][1][1]) / 2) for i in use}
    around = {i: [j for j in use if j != i and size[j] > size[i] and _within(*spot[i], rings[j])] for i in use}
    parts = {i: [i] for i in use if len(around[i]) % 2 == 0}
    for i in use:
        if len(around[i]) % 2:
            parts[min((j for j in around[i] if j in parts), key=size.get)].append(i)
    return list(parts.values())


def oriented(rings: list[Ring]) -> list[list[Ring]]:
    """Parts with outer rings counter-clockwise and holes clockwise."""
    out = []
    for part in nested(rings):
        held = []
        for k, i in enumerate(part):
            x, y = rings[i]
            held.append((x, y) if (signed_area(x, y) > 0) == (k == 0) else (x[::-1], y[::-1]))
        out.append(held)
    return out


def rings_of(xs, ys) -> list[Ring]:
    """Rings without a repeated last vertex."""
    out = []
    for x, y in zip(xs, ys, strict=True):
        x, y = np.asarray(x, float), np.asarray(y, float)
        if len(x) > 1 and x[0] == x[-1] and y[0] == y[-1]:
            x, y = x[:-1], y[:-1]
        out.append((x, y))
    return out


def to_wkb(xs, ys) -> bytes | None:
    """A MultiPolygon as little-endian well-known binary; null for null rings."""
    if xs is None or ys is None:
        return None
    parts = oriented(rings_of(xs, ys))
    out = [struct.pack("<BII", 1, 6, len(parts))]
    for part in parts:
        out.append(struct.pack("<BII", 1, 3, len(part)))
        for x, y in part:
            points = np.column_stack([np.append(x, x[0]), np.append(y, y[0])])
            out += [struct.pack("<I", len(points)), points.astype("<f8").tobytes()]
    return b"".join(out)


def from_wkb(data: bytes | None) -> list[list[Ring]] | None:
    """Parts of a Polygon or MultiPolygon in either byte order, with further dimensions left out."""
    if data is None:
        return None

    def head(at: int) -> tuple[str, int, int]:
        order = "<" if data[at] == 1 else ">"
        kind = struct.unpack_from(order + "I", data, at + 1)[0]
        # ISO numbers of Z, M and ZM shapes are 1000, 2000 and 3000 up; the extended form sets high bits and may add a reference system
        own = kind & 0x1FFFFFFF
        dims = 2 + {0: 0, 1: 1, 2: 1, 3: 2}[own // 1000] + bool(kind & 0x80000000) + bool(kind & 0x40000000)
        return order, own, at + 5 + 4 * bool(kind & 0x20000000), dims

    def polygon(at: int) -> tuple[list[Ring], int]:
        order, kind, at, dims = head(at)
        if kind % 1000 != 3:
            raise ValueError(f"not a polygon: type {kind}")
        count, at, rings = struct.unpack_from(order + "I", data, at)[0], at + 4, []
        for _ in range(count):
            n = struct.unpack_from(order + "I", data, at)[0]
            points = np.frombuffer(data, order + "f8", n * dims, at + 4).reshape(n, dims).astype(float)
            rings.append(rings_of([points[:, 0]], [points[:, 1]])[0])
            at += 4 + 8 * n * dims
        return rings, at

    order, kind, at, _ = head(0)
    if kind % 1000 == 3:
        return [polygon(0)[0]]
    if kind % 1000 != 6:
        raise ValueError(f"not a polygon: type {kind}")
    count, at, parts = struct.unpack_from(order + "I", data, at)[0], at + 4, []
    for _ in range(count):
        part, at = polygon(at)
        parts.append(part)
    return parts


RINGS = "array<array<double>>"


def with_wkb(df: DataFrame, out: str = "geometry") -> DataFrame:
    """Adds the rings (xs, ys) of each row as well-known binary."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{out: [to_wkb(x, y) for x, y in zip(b["xs"], b["ys"], strict=True)]})

    df = df.drop(out)
    return df.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{out}` binary"]))


def with_rings(df: DataFrame, column: str = "geometry") -> DataFrame:
    """Adds xs and ys, the rings of a well-known binary column: outer rings counter-clockwise, holes clockwise."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rings = [None if parts is None else [r for p in parts for r in p] for parts in map(from_wkb, b[column])]
            yield b.assign(**{c: [None if r is None else [ring[k].tolist() for ring in r] for r in rings] for k, c in enumerate(("xs", "ys"))})

    df = df.drop("xs", "ys")
    return df.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"xs {RINGS}, ys {RINGS}"]))


def with_orientation(df: DataFrame) -> DataFrame:
    """Rows with their rings (xs, ys) oriented: outer ones counter-clockwise, holes clockwise, by the even-odd rule."""
    return with_rings(with_wkb(df, "_wkb"), "_wkb").drop("_wkb")


def moments(df: DataFrame, key: str, project=None) -> DataFrame:
    """(key, area, x, y): area and centroid of oriented rings by shoelace sums over exploded rings; holes run the other way and so count less.

    project: takes columns x and y to a plane (x, y). An area of no extent has a null centroid. Sums are taken about each
    ring's first vertex, so that small areas far from the origin keep their digits.
    """
    rings = df.select(F.col(key), F.explode(F.arrays_zip("xs", "ys")).alias("r")).select(key, F.col("r.xs").alias("rx"), F.col("r.ys").alias("ry"))
    spots = F.arrays_zip(F.col("rx").alias("x"), F.col("ry").alias("y"))
    if project:
        spots = F.transform(spots, lambda p: F.struct(project(p["x"], p["y"])[0].alias("x"), project(p["x"], p["y"])[1].alias("y")))
    rings = rings.select(key, spots.alias("p")).filter(F.size("p") >= 3).withColumn("o", F.get("p", F.lit(0)))
    rings = rings.withColumn("p", F.transform("p", lambda p: F.struct((p["x"] - F.col("o.x")).alias("x"), (p["y"] - F.col("o.y")).alias("y"))))
    after = F.concat(F.slice("p", 2, F.size("p")), F.slice("p", 1, 1))
    edges = F.zip_with("p", after, lambda a, b: F.struct((a["x"] * b["y"] - b["x"] * a["y"]).alias("c"), (a["x"] + b["x"]).alias("x"), (a["y"] + b["y"]).alias("y")))
    add = lambda f: F.aggregate("e", F.lit(0.0), lambda s, e: s + f(e))
    sums = rings.select(key, "o", edges.alias("e")).select(key, "o", (add(lambda e: e["c"]) / 2).alias("a"), (add(lambda e: e["c"] * e["x"]) / 6).alias("mx"), (add(lambda e: e["c"] * e["y"]) / 6).alias("my"))
    sums = sums.select(key, "a", (F.col("mx") + F.col("a") * F.col("o.x")).alias("mx"), (F.col("my") + F.col("a") * F.col("o.y")).alias("my"))
    by = sums.groupBy(key).agg(F.sum("a").alias("area"), F.sum("mx").alias("mx"), F.sum("my").alias("my"))
    return by.select(key, "area", F.try_divide("mx", "area").alias("x"), F.try_divide("my", "area").alias("y"))
