"""Distance joins, points in polygons, and statistics of spatial association."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratefield.functions.special import normal_cdf
from ratefield.operators.graphs import undirected
from ratefield.session import ensure_checkpoint_dir

EARTH_M = 6_371_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


#: Points of one cell that a task may hold; denser cells are quartered up to so many times, then dealt out.
CELL_POINTS, QUARTERINGS = 20_000, 3
#: Dense cells at most; they are broadcast.
DENSE_CELLS = 100_000
#: Rows of cells that reach beyond this latitude have one column.
_POLAR = 89.0


def distance_join(a: DataFrame, b: DataFrame, radius_m: float, by: tuple[str, ...] = (), cell_points: int = CELL_POINTS) -> DataFrame:
    """Pairs of a (a_id, a_lat, a_lon, ..) and b (b_id, b_lat, b_lon, ..) within a radius, with distance_m; equal in the columns `by`.

    Points fall in cells as high as the radius; cells are as wide as it is at the row of cells nearest to the pole, so
    that a partner lies in the same cell or one beside it. Each b point is copied to its nine cells and joined by cell;
    one within reach of the date line also to those beyond it. Points without coordinates have no partner.

    a's points are counted by cell. A cell of more than cell_points is cut in four, up to three times, and b is copied to
    the quarters within its reach; what is still denser is dealt out by hash, with b copied to each deal. So a task gets
    about cell_points of a, however they cluster.
    """
    high = math.degrees(radius_m / EARTH_M)

    def row(lat: Column) -> Column:
        return F.floor(lat / high).cast("long")

    def wide(r: Column) -> tuple[Column, Column]:
        """Whether a row has one column only, and the columns of a degree."""
        edge = F.greatest(F.abs((r - 1) * high), F.abs((r + 2) * high))
        return edge >= _POLAR, F.cos(F.radians(F.least(F.lit(_POLAR), edge))) / high

    def column(lon: Column, r: Column) -> Column:
        one, per = wide(r)
        return F.when(one, F.lit(0)).otherwise(F.floor(lon * per)).cast("long")

    def part(lat: Column, lon: Column, r: Column, c: Column, level: Column) -> tuple[Column, Column]:
        """The quarter of a cell, at a level, in which a point lies."""
        n = F.pow(F.lit(2.0), level)
        one, per = wide(r)
        inside = lambda x: F.least(n - 1, F.greatest(F.lit(0.0), F.floor(x * n))).cast("int")
        return inside(lat / high - r), F.when(one, F.lit(0)).otherwise(inside(lon * per - c)).cast("int")

    here = a.filter("a_lat is not null and a_lon is not null").withColumn("_r", row(F.col("a_lat"))).withColumn("_c", column(F.col("a_lon"), F.col("_r")))
    there = b.filter("b_lat is not null and b_lon is not null").withColumn("_r", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: row(F.col("b_lat")) + d)))
    one, per = wide(F.col("_r"))
    reach = F.when(one, F.lit(0.0)).otherwise(2.0 / per)
    turns = F.array_compact(F.array(F.lit(0.0), F.when(F.col("b_lon") < reach - 180, F.lit(360.0)), F.when(F.col("b_lon") > 180 - reach, F.lit(-360.0))))
    there = there.withColumn("_x", F.explode(F.transform(turns, lambda t: F.col("b_lon") + t)))
    beside = F.when(one, F.array(F.lit(0))).otherwise(F.array(*map(F.lit, (-1, 0, 1))))
    there = there.withColumn("_c", F.explode(F.transform(beside, lambda d: column(F.col("_x"), F.col("_r")) + d)))
    keys = [*by, "_r", "_c"]
    ensure_checkpoint_dir(a.sparkSession)
    counts = here.groupBy(*keys).agg(F.count("*").alias("_n"))
    total, most = counts.agg(F.sum("_n"), F.max("_n")).first()
    limit = max(cell_points, (total or 0) // DENSE_CELLS)
    if (most or 0) <= limit:
        both = here.join(there, keys)
    else:
        level = F.least(F.lit(QUARTERINGS), F.ceil(F.log2(F.col("_n") / limit) / 2)).cast("int")
        dense = counts.filter(F.col("_n") > limit).select(*keys, level.alias("_level")).checkpoint()
        level = F.coalesce("_level", F.lit(0))
        place = lambda lat, lon: part(F.col(lat), F.col(lon), F.col("_r"), F.col("_c"), level)
        here = here.join(F.broadcast(dense), keys, "left")
        p, q = place("a_lat", "a_lon")
        here = here.withColumns({"_p": p, "_q": q})
        leaves = [*keys, "_p", "_q"]
        deals = here.filter("_level is not null").groupBy(*leaves).agg(F.ceil(F.count("*") / limit).cast("int").alias("_deals")).filter("_deals > 1").checkpoint()
        here = here.join(F.broadcast(deals), leaves, "left").withColumn("_deal", F.pmod(F.xxhash64("a_id", "a_lat", "a_lon"), F.coalesce("_deals", F.lit(1)))).drop("_level", "_deals")
        there = there.join(F.broadcast(dense), keys, "left")
        n = F.pow(F.lit(2.0), level)
        steps = F.sequence(F.lit(0), n.cast("int") - 1)
        there = there.withColumn("_p", F.explode(steps)).withColumn("_q", F.explode(F.when(wide(F.col("_r"))[0], F.array(F.lit(0))).otherwise(steps)))
        # no point of the quarter is nearer than its nearest parallel, nor than its nearest meridian
        gap = lambda x, low, step: F.greatest(F.lit(0.0), low - x, x - low - step)
        north = F.radians(gap(F.col("b_lat"), (F.col("_r") + F.col("_p") / n) * high, high / n)) * EARTH_M
        one, per = wide(F.col("_r"))
        east = F.when(one, F.lit(0.0)).otherwise(gap(F.col("_x"), (F.col("_c") + F.col("_q") / n) / per, 1 / (n * per)))
        east = F.asin(F.cos(F.radians("b_lat")) * F.sin(F.radians(F.least(F.lit(90.0), east)))) * EARTH_M
        there = there.filter((north <= radius_m * 1.001) & (east <= radius_m * 1.001))
        there = there.join(F.broadcast(deals), leaves, "left").withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_deals", F.lit(1)).cast("long") - 1))).drop("_level", "_deals")
        both = here.join(there, [*leaves, "_deal"]).drop("_p", "_q", "_deal")
    # of the copies of b around the globe one is nearest; rows of one column have no copies
    turned = F.col("a_lon") - F.col("_x")
    both = both.filter(wide(F.col("_r"))[0] | ((turned > -180) & (turned <= 180))).withColumn("distance_m", haversine_m(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")))
    return both.filter(F.col("distance_m") <= radius_m).drop("_r", "_c", "_x")


#: Point-edge comparisons that are held at once.
_CAST = 1 << 22


def _cast(x: np.ndarray, y: np.ndarray, xs: list, ys: list) -> np.ndarray:
    """Whether points lie within a polygon's rings: an odd number of edges over a point, and none through it."""
    x1, y1 = (np.concatenate([np.asarray(r, float) for r in c]) for c in (xs, ys))
    x2, y2 = (np.concatenate([np.roll(np.asarray(r, float), -1) for r in c]) for c in (xs, ys))
    x, y = x[:, None], y[:, None]
    cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
    on_edge = (cross == 0) & (np.minimum(x1, x2) <= x) & (x <= np.maximum(x1, x2)) & (np.minimum(y1, y2) <= y) & (y <= np.maximum(y1, y2))
    over = (y1 > y) != (y2 > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        hit = over & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return (hit.sum(axis=1) % 2 == 1) & ~on_edge.any(axis=1)


def _inside(cells: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in cells:
        keep = np.zeros(len(part), bool)
        x, y = part["x"].to_numpy(float), part["y"].to_numpy(float)
        for rows in part.groupby("_shape", sort=False).indices.values():
            xs, ys = part["xs"].iloc[rows[0]], part["ys"].iloc[rows[0]]
            step = max(1, _CAST // max(1, sum(map(len, xs))))
            for i in range(0, len(rows), step):
                some = rows[i : i + step]
                keep[some] = _cast(x[some], y[some], xs, ys)
        yield part.loc[keep, ["point_id", "area_id"]]


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """(point_id, area_id) of points (point_id, x, y) that lie within polygons (area_id, xs, ys: a ring's vertices, or an array of rings); null area where none holds it.

    Of several rings those within another are holes and the others parts of the area, by the even-odd rule. Polygons are cut into the cells that their boxes cover and joined by cell; ray casting decides. A point on a
    boundary isn't within. A point in several polygons goes to the least area_id.
    """
    if not isinstance(polygons.schema["xs"].dataType.elementType, T.ArrayType):
        polygons = polygons.withColumns({c: F.array(c) for c in ("xs", "ys")})
    spans = [F.sequence(F.floor(F.array_min(F.flatten(c)) / cell), F.floor(F.array_max(F.flatten(c)) / cell)) for c in ("xs", "ys")]
    covers = polygons.withColumn("_shape", F.xxhash64("area_id", "xs", "ys")).withColumn("_cx", F.explode(spans[0])).withColumn("_cy", F.explode(spans[1]))
    placed = points.filter("x is not null and y is not null").withColumn("_cx", F.floor(F.col("x") / cell)).withColumn("_cy", F.floor(F.col("y") / cell))
    ids = points.schema["point_id"].dataType.simpleString(), polygons.schema["area_id"].dataType.simpleString()
    hits = placed.join(covers, ["_cx", "_cy"]).select("point_id", "x", "y", "area_id", "xs", "ys", "_shape").mapInPandas(_inside, f"point_id {ids[0]}, area_id {ids[1]}")
    return points.select("point_id").join(hits.groupBy("point_id").agg(F.min("area_id").alias("area_id")), "point_id", "left")


def moran(values: DataFrame, edges: DataFrame, column: str) -> DataFrame:
    """Global Moran's I with row-standardised weights: n, statistic, expected, and variance and z under normality and under randomisation (Cliff and Ord). values: (node, column)."""
    v = values.select("node", F.col(column).cast("double").alias("v"))
    centred = v.crossJoin(F.broadcast(v.agg(F.avg("v").alias("_m"), F.count("*").alias("n")))).select("node", "n", (F.col("v") - F.col("_m")).alias("z"))
    both = undirected(edges)
    degree = both.groupBy("src").agg(F.count("*").alias("k"))
    w = both.join(degree, "src").select("src", "dst", (1.0 / F.col("k")).alias("w"))
    lag = w.join(centred.select(F.col("node").alias("dst"), F.col("z").alias("zj")), "dst").join(centred.select(F.col("node").alias("src"), F.col("z").alias("zi")), "src")
    top = lag.agg(F.sum(F.col("w") * F.col("zi") * F.col("zj")).alias("top"), F.sum("w").alias("s0"))
    low = centred.agg(F.sum(F.col("z") * F.col("z")).alias("low"), F.sum(F.pow("z", F.lit(4))).alias("fourth"), F.max("n").alias("n"))
    back = w.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("w").alias("wt"))
    s1 = w.join(back, ["src", "dst"]).agg((F.sum(F.pow(F.col("w") + F.col("wt"), 2)) / 2).alias("s1"))
    out_sum, in_sum = w.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("o")), w.groupBy(F.col("dst").alias("node")).agg(F.sum("w").alias("i"))
    s2 = out_sum.join(in_sum, "node").agg(F.sum(F.pow(F.col("o") + F.col("i"), 2)).alias("s2"))
    one = top.crossJoin(low).crossJoin(s1).crossJoin(s2)
    n, s0, first, second = F.col("n").cast("double"), F.col("s0"), F.col("s1"), F.col("s2")
    mean = -1 / (n - 1)
    normal = (n * n * first - n * second + 3 * s0 * s0) / (s0 * s0 * (n * n - 1)) - mean * mean
    peak = n * F.col("fourth") / (F.col("low") * F.col("low"))
    shuffled = n * ((n * n - 3 * n + 3) * first - n * second + 3 * s0 * s0) - peak * ((n * n - n) * first - 2 * n * second + 6 * s0 * s0)
    shuffled = shuffled / ((n - 1) * (n - 2) * (n - 3) * s0 * s0) - mean * mean
    out = one.select("n", (n / s0 * F.col("top") / F.col("low")).alias("statistic"), mean.alias("expected"), normal.alias("variance"), shuffled.alias("variance_random"))
    gap = F.col("statistic") - F.col("expected")
    return out.withColumns({"z": gap / F.sqrt("variance"), "z_random": gap / F.sqrt("variance_random")})


def moran_permutations(values: DataFrame, edges: DataFrame, column: str, permutations: int = 9_999, seed: int = 42) -> DataFrame:
    """One row: statistic, permutations, as_large and the one-sided pseudo p-value. Units fit in memory (one row an area); permutations are dealt out in runs, each with a seed of its own."""
    spark = values.sparkSession
    rows = values.select("node", F.col(column).cast("double").alias("v")).orderBy("node").toPandas()
    place = {k: i for i, k in enumerate(rows["node"])}
    pairs = np.array([(place[r[0]], place[r[1]]) for r in undirected(edges).collect()])
    z = rows["v"].to_numpy() - rows["v"].mean()
    degree = np.bincount(pairs[:, 0], minlength=len(z))
    w = 1.0 / degree[pairs[:, 0]]
    scale = len(z) / w.sum() / (z @ z)
    found = float(scale * (w * z[pairs[:, 0]] * z[pairs[:, 1]]).sum())
    held = spark.sparkContext.broadcast((z, pairs, w, scale))

    def run(parts):
        z, pairs, w, scale = held.value
        for part in parts:
            count = []
            for first, size in zip(part["first"], part["size"], strict=True):
                larger = 0
                for k in range(first, first + size):
                    s = np.random.default_rng([seed, k]).permutation(z)
                    larger += scale * (w * s[pairs[:, 0]] * s[pairs[:, 1]]).sum() >= found - 1e-12
                count.append(int(larger))
            yield pd.DataFrame({"as_large": count})

    step = 500
    runs = spark.createDataFrame([(i, min(step, permutations - i)) for i in range(0, permutations, step)], "first long, size long").repartition(8)
    total = runs.mapInPandas(run, "as_large long").agg(F.sum("as_large").alias("as_large"))
    return total.select(F.lit(found).alias("statistic"), F.lit(permutations).alias("permutations"), "as_large", ((F.col("as_large") + 1) / F.lit(permutations + 1.0)).alias("p_value"))


@F.pandas_udf(T.DoubleType())
def two_sided(z: pd.Series) -> pd.Series:
    return pd.Series(2 * normal_cdf(-np.abs(z.to_numpy(float))))


def gi_star(values: DataFrame, edges: DataFrame, column: str) -> DataFrame:
    """Local Getis-Ord Gi* (binary weights, the unit itself included): node, column, z."""
    v = values.select("node", F.col(column).cast("double").alias("v"))
    stats = v.agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.count("*").cast("double").alias("n"))
    near = undirected(edges).select("src", "dst").union(v.select(F.col("node").alias("src"), F.col("node").alias("dst")))
    sums = near.join(v.select(F.col("node").alias("dst"), "v"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum("v").alias("x"), F.count("*").cast("double").alias("w"))
    both = v.join(sums, "node").crossJoin(F.broadcast(stats))
    spread = F.col("s") * F.sqrt((F.col("n") * F.col("w") - F.col("w") * F.col("w")) / (F.col("n") - 1))
    return both.select("node", F.col("v").alias(column), F.try_divide(F.col("x") - F.col("m") * F.col("w"), spread).alias("z"))


def hot_or_cold(z: Column, q: Column, alpha: float = 0.05) -> Column:
    return F.when((q < alpha) & (z > 0), "hot").when((q < alpha) & (z < 0), "cold").otherwise("neither")


def albers_terms(lat1: float = 29.5, lat2: float = 45.5, lat0: float = 23.0) -> tuple[float, float, float, float, float]:
    """a, e, n, c and rho0 of an Albers equal-area conic on the GRS80 ellipsoid (Snyder, 1987)."""
    a, e = 6378137.0, 0.0818191910428158

    def q_of(p: float) -> float:
        s = math.sin(math.radians(p))
        return (1 - e * e) * (s / (1 - e * e * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    def m_of(p: float) -> float:
        return math.cos(math.radians(p)) / math.sqrt(1 - (e * math.sin(math.radians(p))) ** 2)

    n = (m_of(lat1) ** 2 - m_of(lat2) ** 2) / (q_of(lat2) - q_of(lat1))
    c = m_of(lat1) ** 2 + n * q_of(lat1)
    return a, e, n, c, a * math.sqrt(c - n * q_of(lat0)) / n


#: Parallels, origin and meridian of projections by name: the lower states, Alaska and Hawaii.
ALBERS = {"lower": (29.5, 45.5, 23.0, -96.0), "alaska": (55.0, 65.0, 50.0, -154.0), "hawaii": (8.0, 18.0, 13.0, -157.0)}


def albers(lon: Column, lat: Column, lat1: float = 29.5, lat2: float = 45.5, lat0: float = 23.0, lon0: float = -96.0) -> tuple[Column, Column]:
    """Albers equal-area conic coordinates in metres on the GRS80 ellipsoid (Snyder, 1987)."""
    a, e, n, c, rho0 = albers_terms(lat1, lat2, lat0)
    s = F.sin(F.radians(lat))
    q = (1 - e * e) * (s / (1 - e * e * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    rho, theta = a * F.sqrt(c - n * q) / n, n * F.radians(lon - lon0)
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def albers_sql(lon: str, lat: str, lat1: float = 29.5, lat2: float = 45.5, lat0: float = 23.0, lon0: float = -96.0) -> tuple[str, str]:
    """The same as SQL expressions."""
    a, e, n, c, rho0 = map(repr, albers_terms(lat1, lat2, lat0))
    s = f"sin(radians({lat}))"
    q = f"((1 - {e} * {e}) * ({s} / (1 - {e} * {e} * {s} * {s}) - ln((1 - {e} * {s}) / (1 + {e} * {s})) / (2 * {e})))"
    rho, theta = f"({a} * sqrt({c} - {n} * {q}) / {n})", f"({n} * radians({lon} - ({lon0})))"
    return f"{rho} * sin({theta})", f"{rho0} - {rho} * cos({theta})"


def away_from(points: DataFrame, anchors: DataFrame, metres: float, *of: float) -> DataFrame:
    """Points (point_id, lon, lat) that no anchor (lon, lat) is nearer to than a distance in the Albers plane; `of` are its parallels, origin and meridian.

    Anchors are copied to the nine squares around theirs; a point without coordinates is away from all.
    """

    def placed(df: DataFrame, x: str, y: str) -> DataFrame:
        east, north = albers(F.col("lon"), F.col("lat"), *of)
        return df.withColumns({x: east, y: north}).withColumns({"_cx": F.floor(F.col(x) / metres).cast("long"), "_cy": F.floor(F.col(y) / metres).cast("long")})

    beside = lambda c: F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1))
    near = placed(anchors.filter("lon is not null and lat is not null"), "_ax", "_ay").withColumn("_cx", beside("_cx")).withColumn("_cy", beside("_cy")).select("_cx", "_cy", "_ax", "_ay")
    at = placed(points, "_x", "_y")
    apart = F.pow(F.col("_x") - F.col("_ax"), 2) + F.pow(F.col("_y") - F.col("_ay"), 2) < metres * metres
    return at.join(near, (at["_cx"] == near["_cx"]) & (at["_cy"] == near["_cy"]) & apart, "left_anti").drop("_x", "_y", "_cx", "_cy")
