"""Record linkage by distance and name, one to one."""

from __future__ import annotations

import heapq
import math
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratefield.functions.text import name_score, name_variants, normal_name, sorted_ratio
from ratefield.operators.graphs import components, thinned
from ratefield.operators.spatial import EARTH_M, distance_join
from ratefield.session import scratch_dir


def _written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the session's shared folder: its plan is as small as its files, which a checkpoint's isn't."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Pairs of names up to this number are broadcast; more are joined by a shuffle.
BROADCAST_NAMES = 100_000
#: Names are paired before places are looked at if their pairs are so many a record at most.
NAME_PAIRS = 20


def candidates(a: DataFrame, b: DataFrame, radius_m: float = 300.0, threshold: float = 65.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs within the radius, equal in the columns `by`, whose names score the threshold: a_id, b_id, score, distance_m. a: a_id, a_name, a_lat, a_lon; b likewise.

    Where records share few names, all pairs of names of a block are scored, and distances are taken between records of
    alike names; otherwise the names of near records are scored.
    """
    left = a.withColumn("_va", name_variants(F.col("a_name")))
    right = b.withColumn("_vb", name_variants(F.col("b_name")))
    va, vb = left.select("_va", *by).distinct(), right.select("_vb", *by).distinct()
    number = lambda d, c: d.groupBy(*by).agg(F.count("*").cast("double").alias(c))
    both = number(va, "_m").join(number(vb, "_n"), list(by)) if by else number(va, "_m").crossJoin(number(vb, "_n"))
    if (both.agg(F.sum(F.col("_m") * F.col("_n"))).first()[0] or 0) > NAME_PAIRS * max(1_000, a.count() + b.count()):
        near = distance_join(left, right, radius_m, by).withColumn("score", name_score("_va", "_vb"))
        return near.filter(F.col("score") >= threshold).select("a_id", "b_id", "score", "distance_m", *by)
    named = (va.join(vb, list(by)) if by else va.crossJoin(vb)).select("_va", "_vb").distinct()
    named = _written(named.withColumn("score", name_score("_va", "_vb")).filter(F.col("score") >= threshold), "names")
    alike = left.join(F.broadcast(named) if named.count() <= BROADCAST_NAMES else named, "_va")
    return distance_join(alike, right, radius_m, (*by, "_vb")).select("a_id", "b_id", "score", "distance_m", *by)


def _classes(records: DataFrame, x: str, by: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Records of one side that have the same names, places and blocks, as classes named by their least id.

    Members: {x}_id, {x}_class and {x}_at, the record's number in its class from 1. Classes: {x}_id, {x}_name, {x}_lat,
    {x}_lon, the columns `by` and {x}_size. Rows of one id are one record; a null id is none.
    """
    what = [f"{x}_name", f"{x}_lat", f"{x}_lon", *by]
    own = records.filter(F.col(f"{x}_id").isNotNull()).groupBy(f"{x}_id").agg(F.array_sort(F.collect_set(F.struct(*what))).alias("_rows"))
    own = _written(own, "records")
    sized = own.groupBy("_rows").agg(F.min(f"{x}_id").alias(f"{x}_class"), F.count("*").alias(f"{x}_size"))
    sized = _written(sized, "classes")
    order = Window.partitionBy(f"{x}_class").orderBy(f"{x}_id")
    members = own.join(sized, "_rows").select(f"{x}_id", f"{x}_class", F.row_number().over(order).cast("long").alias(f"{x}_at"))
    classes = sized.select(F.col(f"{x}_class").alias(f"{x}_id"), f"{x}_size", F.explode("_rows").alias("_r")).select(f"{x}_id", f"{x}_size", "_r.*")
    return members, classes


def best_matching(row: np.ndarray, col: np.ndarray, score: np.ndarray, rows: int, cols: int) -> list[int]:
    """The column of each row (-1: none) in the matching of most pairs and, of these, the highest sum of scores.

    A row after the other takes the cheapest augmenting path over the given pairs alone, found by Dijkstra's algorithm on
    costs reduced by potentials; it may end in leaving a row out, at a cost above any set of scores. Memory is that of
    the pairs; at a tie free columns come first, then the lower number.
    """
    order = np.lexsort((col, row))
    first = np.searchsorted(row[order], np.arange(rows + 1)).tolist()
    ends, costs = col[order].tolist(), (-score[order]).tolist()
    none = max(1e6, 200.0 * rows)
    u = [min(costs[first[i] : first[i + 1]], default=none) for i in range(rows)]
    v, mine, whose = [0.0] * cols, [-1] * rows, [-1] * cols
    for start in range(rows):
        far, came, closed, heap = {}, {}, set(), []
        seen = [(start, 0.0)]
        i, d, leave, out = start, 0.0, none - u[start], start
        while True:
            base = d - u[i]
            for e in range(first[i], first[i + 1]):
                j = ends[e]
                x = base + costs[e] - v[j]
                if j not in closed and x < far.get(j, leave):
                    far[j], came[j] = x, i
                    heapq.heappush(heap, (x, whose[j] >= 0, j))
            while heap and (heap[0][2] in closed or heap[0][0] > far[heap[0][2]]):
                heapq.heappop(heap)
            if not heap or heap[0][0] >= leave:
                total, j, left = leave, mine[out], True
                mine[out] = -1
                break
            d, _, j = heapq.heappop(heap)
            closed.add(j)
            if whose[j] < 0:
                total, left = d, False
                break
            i = whose[j]
            seen.append((i, d))
            if d + none - u[i] < leave:
                leave, out = d + none - u[i], i
        for k, at in seen:
            u[k] += total - at
        for k in closed:
            v[k] -= total - far[k]
        if left and out == start:
            continue
        while True:
            i = came[j]
            mine[i], before, whose[j] = j, mine[i], i
            if i == start:
                break
            j = before
    return mine


#: Scores are compared as whole numbers of this part of one.
_GRAIN = 1e9


def best_flow(row: np.ndarray, col: np.ndarray, score: np.ndarray, supply: np.ndarray, demand: np.ndarray) -> np.ndarray:
    """How many records of its row's class each pair matches with its column's: most matches and, of these, the highest sum of scores.

    Classes hold supply and demand records. Shortest alternating paths by scores, all at once (Bellman and Ford), then
    as much as fits along the pairs that lie on them, in turn until no path is left. Memory is that of the pairs.
    """
    cost = -np.round(score * _GRAIN).astype(np.int64)
    order = np.lexsort((col, row))
    ends = np.searchsorted(row[order], np.arange(len(supply) + 1)).tolist()
    flow, left, free = np.zeros(len(row), np.int64), supply.astype(np.int64).copy(), demand.astype(np.int64).copy()
    far = np.int64(1) << 60
    while True:
        du, dv = np.where(left > 0, np.int64(0), far), np.full(len(free), far)
        used = np.flatnonzero(flow)
        while True:
            reached = du[row] < far
            np.minimum.at(dv, col[reached], du[row[reached]] + cost[reached])
            before = du.copy()
            back = used[dv[col[used]] < far]
            np.minimum.at(du, row[back], dv[col[back]] - cost[back])
            if np.array_equal(before, du):
                break
        goal = dv[free > 0].min(initial=far)
        if goal >= far:
            return flow
        tight = (du[row] < far) & (du[row] + cost == dv[col])
        out = order[tight[order]]
        at = np.searchsorted(row[out], np.arange(len(supply) + 1)).tolist()
        _saturate(out.tolist(), at, row, col, flow, left, free, (free > 0) & (dv == goal))


def _saturate(out: list, at: list, row: np.ndarray, col: np.ndarray, flow: np.ndarray, left: np.ndarray, free: np.ndarray, target: np.ndarray) -> None:
    """Send all that fits from rows with something left to target columns along the pairs `out` (those of row i at at[i]:at[i + 1]) and back along those in use among them."""
    rows, cols = row.tolist(), col.tolist()
    into: dict[int, list[int]] = {}
    for e in out:
        into.setdefault(cols[e], []).append(e)
    held, more, room, goals = flow.tolist(), left.tolist(), free.tolist(), target.tolist()
    while True:
        # columns by how far they are from the rows that have something left
        came: dict[int, int] = {}
        reached = {i: -1 for i, x in enumerate(more) if x > 0 and at[i] < at[i + 1]}
        level, sent = list(reached), False
        while level:
            following = []
            for i in level:
                for e in out[at[i] : at[i + 1]]:
                    j = cols[e]
                    if j in came:
                        continue
                    came[j] = e
                    if goals[j] and room[j] > 0:
                        path, k, most = [e], i, room[j]
                        while reached[k] >= 0:
                            b = reached[k]
                            path += [b, came[cols[b]]]
                            most, k = min(most, held[b]), rows[came[cols[b]]]
                        most = min(most, more[k])
                        if most > 0:
                            for n, x in enumerate(path):
                                held[x] += -most if n % 2 else most
                            more[k] -= most
                            room[j] -= most
                            sent = True
                        if room[j] > 0:
                            del came[j]
                        continue
                    for b in into[j]:
                        if held[b] > 0 and rows[b] not in reached:
                            reached[rows[b]] = b
                            following.append(rows[b])
            level = following
        if not sent:
            break
    flow[:], left[:], free[:] = held, more, room


def _best(part: pd.DataFrame) -> pd.DataFrame:
    """Most matches first, then the highest sum of scores, within one component of classes; each pair's records follow from their numbers a_from and b_from on."""
    part = part.sort_values(["a_id", "b_id", "distance_m"]).drop_duplicates(["a_id", "b_id"])
    _, a, row = np.unique(part["a_id"].to_numpy(), return_index=True, return_inverse=True)
    _, b, col = np.unique(part["b_id"].to_numpy(), return_index=True, return_inverse=True)
    n = best_flow(row, col, part["score"].to_numpy(float), part["a_size"].to_numpy()[a], part["b_size"].to_numpy()[b])
    part = part.assign(n=n)[n > 0]
    return part.assign(a_from=part.groupby("a_id")["n"].cumsum() - part["n"] + 1, b_from=part.groupby("b_id")["n"].cumsum() - part["n"] + 1)[["a_id", "b_id", "score", "distance_m", "n", "a_from", "b_from"]]


def matched_classes(pairs: DataFrame) -> DataFrame:
    """Of candidate pairs of classes (a_id, b_id, score, distance_m, a_size, b_size) those that match, with n matches of records each: the a_from-th of a's class and so on with the b_from-th of b's.

    Each component of the candidate graph is a group, as large as a cluster of near, alike classes; nothing else is held
    together. Components are found from a spanning forest of each partition's pairs, so that dense clusters don't weigh.
    """
    nodes = pairs.select(F.concat(F.lit("a"), F.col("a_id").cast("string")).alias("src"), F.concat(F.lit("b"), F.col("b_id").cast("string")).alias("dst"), "a_id", "b_id", "score", "distance_m", "a_size", "b_size")
    # rows are few bytes and much work, so that sizes would put them in too few tasks
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = _written(nodes.repartition(2 * pairs.sparkSession.sparkContext.defaultParallelism), "pairs")
    edges = _written(thinned(nodes.select("src", "dst")), "forest")
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    parts = components(ends, edges).withColumnRenamed("node", "src")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select("a_id", "b_id", "score", "distance_m").schema)
    return nodes.join(parts, "src").drop("src", "dst").repartition(tasks, "component").groupBy("component").applyInPandas(lambda p: _best(p), f"{kinds}, n long, a_from long, b_from long")


def match_optimal(pairs: DataFrame) -> DataFrame:
    """One-to-one matches of candidate pairs (a_id, b_id, score, distance_m): most pairs, then the highest sum of scores."""
    return matched_classes(pairs.withColumns({"a_size": F.lit(1).cast("long"), "b_size": F.lit(1).cast("long")})).select("a_id", "b_id", "score", "distance_m")


def match_records(a: DataFrame, b: DataFrame, radius_m: float = 300.0, threshold: float = 65.0, by: tuple[str, ...] = ()) -> DataFrame:
    """match_optimal of the candidates of a and b, without all pairs: records with one name, place and block are a class, and classes are matched by how many they are."""
    (a_members, a_classes), (b_members, b_classes) = _classes(a, "a", by), _classes(b, "b", by)
    pairs = candidates(a_classes, b_classes, radius_m, threshold, by).select("a_id", "b_id", "score", "distance_m")
    sizes = lambda d, x: d.select(f"{x}_id", f"{x}_size").distinct()
    found = matched_classes(pairs.join(sizes(a_classes, "a"), "a_id").join(sizes(b_classes, "b"), "b_id"))
    each = found.select(F.col("a_id").alias("a_class"), F.col("b_id").alias("b_class"), "score", "distance_m", "a_from", "b_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("_k"))
    each = each.withColumns({"a_at": F.col("a_from") + F.col("_k"), "b_at": F.col("b_from") + F.col("_k")})
    return _written(each.join(a_members, ["a_class", "a_at"]).join(b_members, ["b_class", "b_at"]).select("a_id", "b_id", "score", "distance_m"), "matches")


def match_staged(a: DataFrame, b: DataFrame, stages: list[tuple[float, float]] = ((300.0, 65.0), (150.0, 55.0), (5000.0, 90.0)), by: tuple[str, ...] = ()) -> DataFrame:
    """Match in stages (radius, threshold): each sees the records that earlier ones left. Every row of a, with b_id, score, distance_m and stage, or nulls."""
    done, left, right = None, a, b
    for k, (radius, threshold) in enumerate(stages):
        got = match_records(left, right, radius, threshold, by).withColumn("stage", F.lit(k))
        done = got if done is None else done.unionByName(got)
        left, right = left.join(got.select("a_id"), "a_id", "left_anti"), right.join(got.select("b_id"), "b_id", "left_anti")
    return a.select("a_id").join(done, "a_id", "left")


def match_in_blocks(a: DataFrame, b: DataFrame, block: str, threshold: float = 65.0) -> DataFrame:
    """Greedy matches within blocks, without coordinates: each a, by id, takes the best b left (the first at a tie) if it reaches the threshold."""
    ids = [f"{c} {d.schema[c].dataType.simpleString()}" for c, d in (("a_id", a), ("b_id", b))]

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        # the b left of each name, last first; equal names score alike, so that the least b_id of each name stands for it
        free = {n: ids[::-1] for n, ids in y.sort_values("b_id").groupby("_n")["b_id"].agg(list).items() if n}
        scores: dict[str, list[tuple[float, str]]] = {}
        out = []
        for row in x.sort_values("a_id")[["a_id", "n_"]].itertuples(index=False):
            a_id, name = row
            if name not in scores:
                scores[name] = [(score, n) for n in free if name and (score := sorted_ratio(name, n)) >= threshold]
            left = [(-score, free[n][-1], n) for score, n in scores[name] if free[n]]
            if left:
                score, b_id, n = min(left)
                free[n].pop()
                out.append((a_id, b_id, -score))
        return pd.DataFrame(out, columns=["a_id", "b_id", "score"])

    left = a.select("a_id", block, normal_name(F.col("a_name")).alias("n_")).groupBy(block)
    right = b.select("b_id", block, normal_name(F.col("b_name")).alias("_n")).groupBy(block)
    return left.cogroup(right).applyInPandas(lambda x, y: run(x, y), f"{ids[0]}, {ids[1]}, score double")


def _first_of_twins(part: pd.DataFrame, radius_m: float) -> list:
    """The ids of rows (id, twin, lat, lon, x, y, z) of which none lies within the radius of an earlier one's that stays, with one twin. Only rows of the 27 cells around are looked at, and few that stay fit in one."""
    stay: list = []
    held: dict[tuple, list[tuple[float, float, float]]] = {}
    part = part.sort_values("id")
    p, lon = np.radians(part["lat"].to_numpy(float)), part["lon"].to_numpy(float)
    rows = zip(part["id"].tolist(), part["twin"].tolist(), *(part[c].tolist() for c in "xyz"), p.tolist(), np.cos(p).tolist(), lon.tolist(), strict=True)
    around = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    for one, own in groupby(rows, key=lambda r: r[0]):
        own = list(own)
        near = False
        for _, twin, x, y, z, q, cos_q, east in own:
            for i, j, k in around:
                for p, cos_p, west in held.get((twin, x + i, y + j, z + k), ()):
                    h = math.sin((q - p) / 2) ** 2 + cos_p * cos_q * math.sin(math.radians(east - west) / 2) ** 2
                    near = near or 2 * EARTH_M * math.asin(math.sqrt(min(1.0, h))) <= radius_m
        if not near:
            stay.append(one)
            for _, twin, x, y, z, q, cos_q, east in own:
                held.setdefault((twin, x, y, z), []).append((q, cos_q, east))
    return stay


def drop_near_twins(points: DataFrame, radius_m: float = 100.0) -> DataFrame:
    """Of points (id, name, lat, lon) with one normalised name within a radius of a kept one, by id, only the first stays.

    Of ids with the same names and places only the least can stay. Places fall in cells of space as wide as the radius, so
    that twins lie in one cell or beside it; the sequence matters only within a component of such cells, which is a group.
    Neither pairs of points nor links between them are made.
    """
    rad = lambda c: F.radians(F.col(c).cast("double"))
    # a little wider than the radius, as the numbers are rounded
    cell = lambda x: F.floor(x * EARTH_M / (radius_m * 1.001 + 0.001)).cast("long")
    spots = points.withColumn("_twin", normal_name(F.col("name"))).filter("_twin <> '' and id is not null and abs(lat) < double('inf') and abs(lon) < double('inf')")
    spot = F.struct(F.col("_twin").alias("twin"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    records = _written(spots.groupBy("id").agg(F.array_sort(F.collect_set(spot)).alias("_rows")), "records")
    rows = records.groupBy("_rows").agg(F.min("id").alias("id")).select("id", F.explode("_rows").alias("_r")).select("id", "_r.*")
    rows = rows.withColumns({"x": cell(F.cos(rad("lat")) * F.cos(rad("lon"))), "y": cell(F.cos(rad("lat")) * F.sin(rad("lon"))), "z": cell(F.sin(rad("lat")))})
    # cells of one hash are one node, which at most makes a group of two
    rows = _written(rows.withColumn("node", F.xxhash64("twin", "x", "y", "z")), "twins")
    cells = _written(rows.select("node", "twin", "x", "y", "z").distinct(), "cells")
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) > (0, 0, 0)])
    beside = cells.select("node", "twin", "x", "y", "z", F.explode(steps).alias("_s")).select(F.col("node").alias("src"), F.xxhash64("twin", F.col("x") + F.col("_s.i"), F.col("y") + F.col("_s.j"), F.col("z") + F.col("_s.k")).alias("node"))
    edges = beside.join(cells.select("node"), "node").select("src", F.col("node").alias("dst"))
    own = rows.groupBy("id").agg(F.collect_set("node").alias("_n")).filter(F.size("_n") > 1)
    edges = edges.union(own.select(F.col("_n")[0].alias("src"), F.explode("_n").alias("dst")))
    groups = components(cells.select("node").distinct(), thinned(edges))
    # rows are few bytes and much work, so that sizes would put them in too few tasks
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = points.schema["id"].dataType.simpleString()
    stay = rows.join(groups, "node").drop("node").repartition(tasks, "component").groupBy("component").applyInPandas(lambda p: pd.DataFrame({"id": _first_of_twins(p, radius_m)}), f"id {kind}")
    return points.join(records.select("id").join(stay, "id", "left_anti"), "id", "left_anti")
