"""Exact ranks and quantiles of tables of any size: values are counted, counts are cut into ranges, and no window has all rows."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratefield.operators.skew import join_facts
from ratefield.session import ensure_checkpoint_dir

#: Ranges of values at most; their totals go through the driver.
MOST_RANGES = 10_000
#: Values that are sorted in one task to find a quantile, and bins of one refining pass.
SORTED, BINS = 100_000, 1024
#: Groups whose quantiles are found by refining; smaller ones are sorted each.
LARGE_GROUPS = 10_000
_BIG = 1.7976931348623157e308


def _literal(values: list, kind: str) -> Column:
    """An array of constants as one literal, however many they are."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def range_of(value: Column, bounds: list[float]) -> Column:
    """The number of bounds at or below a value, by binary search."""
    if not bounds:
        return F.lit(0)
    top = 2 ** len(bounds).bit_length()
    held = _literal([float(b) for b in bounds], "double")
    steps = F.array(*[F.lit(top >> i) for i in range(1, top.bit_length())])
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get(held, low + step - 1) <= value, low + step).otherwise(low))


def value_counts(df: DataFrame, value: str, **more: Column) -> DataFrame:
    """Rows (value, n, further aggregates): one for each distinct value that isn't null; written, as several plans read it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in more.items()]).checkpoint()


def ranged(counts: DataFrame, value: str, ranges: int | None = None) -> tuple[DataFrame, int]:
    """counts with `piece`, the number of its range of values, and the number of ranges.

    Bounds are approximate quantiles of the distinct values, so ranges have about as many values each; a value lies in
    one range alone, so ties are never parted.
    """
    ranges = max(1, min(ranges or 4 * int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST_RANGES))
    at = [i / ranges for i in range(1, ranges)]
    bounds = counts.agg(F.percentile_approx(F.col(value).cast("double"), _literal(at, "double"), max(10_000, 20 * ranges))).first()[0] if at else []
    bounds = sorted({float(b) for b in bounds or [] if not math.isnan(b)})
    return counts.withColumn("piece", range_of(F.col(value).cast("double"), bounds)), len(bounds) + 1


def value_ranks(counts: DataFrame, value: str, ranges: int | None = None, descending: bool = False) -> DataFrame:
    """counts (value, n, ..) with `before`, the rows of values that come earlier, and `dense`, the place among distinct values.

    Sums run within a range; what earlier ranges hold is added from their totals, which are MOST_RANGES numbers at most.
    """
    cut, pieces = ranged(counts, value, ranges)
    totals = {r["piece"]: (r["n"], r["d"]) for r in cut.groupBy("piece").agg(F.sum("n").alias("n"), F.count("*").alias("d")).collect()}
    order = range(pieces - 1, -1, -1) if descending else range(pieces)
    offsets, rows, values = {}, 0, 0
    for p in order:
        offsets[p] = (rows, values)
        rows, values = rows + totals.get(p, (0, 0))[0], values + totals.get(p, (0, 0))[1]
    w = Window.partitionBy("piece").orderBy(F.desc(value) if descending else F.asc(value))
    offset = [F.get(_literal([offsets[p][k] for p in range(pieces)], "bigint"), F.col("piece")) for k in (0, 1)]
    return cut.withColumns({"before": offset[0] + F.sum("n").over(w) - F.col("n"), "dense": offset[1] + F.row_number().over(w)}).drop("piece")


def exact_rank(df: DataFrame, value: str, out: str, method: str = "min", descending: bool = False, ranges: int | None = None) -> DataFrame:
    """df with the rank of each row by a numeric column over the whole table.

    method: "min" (ties take the least place), "average" (their mean place, a double) or "dense" (places without gaps).
    Nulls come last, as ties of one another; NaN comes above all numbers. Values are counted and ranked by range, then
    joined back, where a frequent value is broadcast. df is read two or three times: what is costly to make, and a column
    that sums of doubles make (which may differ in their last bits), should be checkpointed before.
    """
    ensure_checkpoint_dir(df.sparkSession)
    every = df.groupBy(value).agg(F.count("*").alias("n")).checkpoint()
    counts = every.filter(F.col(value).isNotNull())
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    total = total or 0
    nulls = every.filter(F.col(value).isNull()).agg(F.sum("n")).first()[0] or 0
    place = {"min": F.col("before") + 1, "average": F.col("before") + (F.col("n") + 1) / 2.0, "dense": F.col("dense")}[method]
    last = {"min": total + 1, "average": total + (nulls + 1) / 2.0, "dense": distinct + 1}[method]
    ranks = value_ranks(counts, value, ranges, descending).select(value, "n", place.alias(out))
    return join_facts(df.drop(out), ranks.withColumnRenamed("n", "rows of the value"), [value], "rows of the value", total).withColumn(out, F.when(F.col(value).isNull(), F.lit(last)).otherwise(F.col(out)))


def step_up(df: DataFrame, p: str, out: str, ranges: int | None = None) -> DataFrame:
    """Benjamini-Hochberg q-values of p (null: null): the least p * m / rank from here to the largest p, at most 1. df is checkpointed."""
    ensure_checkpoint_dir(df.sparkSession)
    df = df.checkpoint()
    counts = value_counts(df, p)
    m = counts.agg(F.sum("n")).first()[0] or 0
    # of equal p the last place counts, which is the least quotient
    cut, pieces = ranged(value_ranks(counts, p, ranges).withColumn("q", F.col(p) * m / (F.col("before") + F.col("n"))), p, ranges)
    least = {r["piece"]: r["q"] for r in cut.groupBy("piece").agg(F.min("q").alias("q")).collect()}
    after, rest = [1.0] * pieces, 1.0
    for i in range(pieces - 1, -1, -1):
        after[i] = rest
        rest = min(rest, least.get(i, 1.0))
    down = Window.partitionBy("piece").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    found = cut.withColumn(out, F.least(F.min("q").over(down), F.get(_literal(after, "double"), F.col("piece")))).select(p, "n", out)
    return join_facts(df.drop(out), found.withColumnRenamed("n", "rows of the value"), [p], "rows of the value", m)


def _picked(counts: DataFrame, keys: list[str]) -> DataFrame:
    """From (keys, v, n, k, share, base): the interpolated value whose rank among all is k + share; ranks below start at base."""
    w = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.col("base") + F.sum("n").over(w))
    low = F.min(F.when(F.col("upto") > F.col("k"), F.col("v")))
    high = F.min(F.when(F.col("upto") > F.col("k") + 1, F.col("v")))
    share = F.max("share")
    return ranked.groupBy(*keys).agg(F.when(share > 0, low + (high - low) * share).otherwise(low).alias("value"))


def exact_quantiles(df: DataFrame, value: str, at: list[float], by: list[str] | None = None, sorted_most: int = SORTED, bins: int = BINS) -> DataFrame:
    """Rows (by .., q, value): exact quantiles at q (0 to 1) of each group, linearly interpolated; nulls and NaN don't count, groups without a number have no row.

    Groups of up to sorted_most rows (or 1/10,000 of all, so that the others are LARGE_GROUPS at most) are sorted each in
    one task, by distinct value. In larger ones the range that holds a quantile is narrowed: a pass counts the rows of
    1,024 bins of it and keeps the bin of the wanted rank, until the rest is small enough to be sorted or one value.
    """
    by = by or []
    spark, v = df.sparkSession, F.col(value).cast("double")
    ensure_checkpoint_dir(spark)
    keys = [f"g{i}" for i in range(len(by))]
    rows = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)], v.alias("v")).filter("v is not null and not isnan(v)")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("size"), F.min("v").alias("low"), F.max("v").alias("high")).filter("size > 0").checkpoint()
    total = sizes.agg(F.sum("size")).first()[0] or 0
    most = max(sorted_most, total // LARGE_GROUPS)
    wanted = F.explode(F.transform(_literal(at, "double"), lambda q: F.struct(q.alias("q"), (q * (F.col("size") - 1)).alias("place"))))
    small = sizes.filter(F.col("size") <= most).select(*keys, "size", wanted.alias("w")).select(*[F.col(k).alias(f"r {k}") for k in keys], F.col("w.q").alias("q"), F.floor("w.place").alias("k"), (F.col("w.place") - F.floor("w.place")).alias("share"), F.lit(0).cast("long").alias("base"))
    counts = rows.groupBy(*keys, "v").agg(F.count("*").alias("n"))
    same = [F.col(k).eqNullSafe(F.col(f"`r {k}`")) for k in keys]
    if small.isEmpty():
        found = []
    elif keys:
        found = [_picked(counts.join(small, same).select(*keys, "q", "v", "n", "k", "share", "base"), [*keys, "q"])]
    else:
        found = [_picked(counts.crossJoin(F.broadcast(small)), ["q"])]
    large = sizes.filter(F.col("size") > most).collect()
    if large:
        found.append(_refined(rows, large, keys, at, most, bins, sizes.select(*keys).schema))
    none = rows.select(*keys, F.lit(0.0).alias("q"), F.col("v").alias("value")).limit(0)
    out = none
    for f in found:
        out = out.unionByName(f.select(none.columns))
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], "q", "value")


def _refined(rows: DataFrame, large: list, keys: list[str], at: list[float], most: int, bins: int, schema) -> DataFrame:
    """Quantiles of large groups: their ranges are rows of the driver, a group and q each."""
    spark = rows.sparkSession
    active, ready, sorts = {}, [], []
    for r, q in itertools.product(large, at):
        place = q * (r["size"] - 1)
        active[len(active)] = {"g": tuple(r[k] for k in keys), "q": q, "k": math.floor(place), "share": place - math.floor(place), "base": 0, "low": r["low"], "high": r["high"], "size": r["size"]}

    def ranges(of: dict):
        named = ", ".join([f"`r {k}` {f.dataType.simpleString()}" for k, f in zip(keys, schema.fields, strict=True)] + ["id long, k long, share double, base long, low double, high double"])
        return spark.createDataFrame([(*t["g"], i, t["k"], t["share"], t["base"], t["low"], t["high"]) for i, t in of.items()], named)

    def within(of: dict):
        held = F.broadcast(ranges(of))
        inside = F.col("v").between(F.col("low"), F.col("high"))
        for k in keys:
            inside = F.col(k).eqNullSafe(F.col(f"`r {k}`")) & inside
        return rows.join(held, inside)

    done = lambda t, low, high: ready.append((*t["g"], t["q"], low + (high - low) * t["share"] if t["share"] > 0 else low))
    while active:
        for i, t in list(active.items()):
            if t["low"] == t["high"]:
                done(t, t["low"], t["low"])
                del active[i]
            elif t["size"] <= most or t.get("stuck"):
                sorts.append(active.pop(i))
        if not active:
            break
        # halves, as a difference may be infinite
        x, low, high = (F.greatest(F.lit(-_BIG), F.least(F.lit(_BIG), F.col(c))) / 2 for c in ("v", "low", "high"))
        number = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.try_divide(x - low, high - low) * bins).cast("int")))
        counted = within(active).groupBy("id", "k", "base", F.coalesce(number, F.lit(0)).alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        w = Window.partitionBy("id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        upto = counted.withColumn("upto", F.col("base") + F.sum("n").over(w))
        hit = upto.filter((F.col("upto") > F.col("k")) & (F.col("upto") - F.col("n") <= F.col("k") + 1)).orderBy("id", "bin").collect()
        for i, parts in itertools.groupby(hit, key=lambda r: r["id"]):
            parts, t = list(parts), active[i]
            if parts[0]["upto"] == t["k"] + 1 and len(parts) > 1:  # the two neighbours lie in two bins
                done(t, parts[0]["high"], parts[1]["low"])
                del active[i]
            else:
                own = parts[0]
                t |= {"base": own["upto"] - own["n"], "low": own["low"], "high": own["high"], "stuck": own["n"] == t["size"] and (own["low"], own["high"]) == (t["low"], t["high"]), "size": own["n"]}
    fields = ", ".join([f"{k} {f.dataType.simpleString()}" for k, f in zip(keys, schema.fields, strict=True)] + ["q double", "value double"])
    out = spark.createDataFrame(ready, fields)
    if sorts:
        of = dict(enumerate(sorts))
        counts = within(of).groupBy("id", "k", "share", "base", "v").agg(F.count("*").alias("n"))
        names = spark.createDataFrame([(i, *t["g"], t["q"]) for i, t in of.items()], "id long, " + fields.removesuffix(", value double"))
        out = out.unionByName(_picked(counts, ["id"]).join(F.broadcast(names), "id").select(*keys, "q", "value"))
    return out
