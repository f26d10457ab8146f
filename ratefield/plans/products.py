"""Composite tables and smaller operators bound to the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratefield.functions import shapes
from ratefield.operators import ranking as rk
from ratefield.operators import rates as rt
from ratefield.operators import draws, hypotheses, regress, spatial
from ratefield.operators import tables as tb
from ratefield.plans.relational import PRIOR_SQL, TWO_RATES, UNITS_SQL, nation_units, rounded, two_ranks
from ratefield.plans.statistical import EDGES_SQL, GI_SQL, LINE_SQL, POINTS_SQL, area_table, line_d, nation_edges, nation_values, points
from ratefield.plans.tables import Tables
from ratefield.session import ensure_checkpoint_dir, scratch_dir
from ratefield.sources import polygons
from ratefield.sources.sinks import write_parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def bound(name: str, sql: str):
    """Register a query that takes Tables, and its SQL."""

    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        ORACLES[name] = sql
        return f

    return keep


@bound("seeded_sample", "SELECT c_custkey FROM customer ORDER BY md5(CAST(c_custkey AS VARCHAR) || ':42'), c_custkey LIMIT 25")
def seeded_sample(t):
    """The 25 rows with the least seeded hash: the same ones in any engine and partitioning."""
    return t.customer.select("c_custkey").orderBy(F.md5(F.concat(F.col("c_custkey").cast("string"), F.lit(":42")).cast("binary")), "c_custkey").limit(25)


@bound(
    "edge_diff",
    "WITH a AS (SELECT a.n_nationkey AS src, b.n_nationkey AS dst FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey), b AS (SELECT a.n_nationkey AS src, b.n_nationkey AS dst FROM nation a JOIN nation b ON b.n_nationkey - a.n_nationkey IN (1, 2)) SELECT 'left' AS side, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'right', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)",
)
def edge_diff(t):
    """The symmetric difference of two edge sets, whatever the direction in which an edge is given."""
    n = t.nation.select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("g"))
    region = n.join(n.withColumnRenamed("src", "dst"), "g").filter("src > dst").select("src", "dst")
    steps = n.select("src", F.explode(F.array(F.col("src") + 1, F.col("src") + 2)).alias("dst")).join(n.select(F.col("src").alias("dst")), "dst", "left_semi")
    one = lambda e: e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    a, b = one(region), one(steps)
    side = lambda x, y, name: x.join(y, ["src", "dst"], "left_anti").select(F.lit(name).alias("side"), "src", "dst")
    return side(a, b, "left").unionByName(side(b, a, "right"))


@bound("corrected_reshrink", f"WITH {UNITS_SQL}, d AS (SELECT n_nationkey AS k, round_even(orders / 0.61, 0) AS y, CAST(customers AS DOUBLE) AS n FROM units WHERE customers > 0), {PRIOR_SQL} SELECT k, CAST(y AS BIGINT) AS corrected, round((shape + y) / (rate + n) * 100000, 4) AS shrunken_rate FROM d, prior")
def corrected_reshrink(t):
    """Counts corrected for coverage, rounded half to even, and shrunken again."""
    u = nation_units(t).filter("customers > 0").select(F.col("n_nationkey").alias("k"), F.bround(F.col("orders") / 0.61, 0).cast("long").alias("corrected"), F.col("customers").cast("double").alias("n"))
    return rounded(rt.shrink(u, "corrected", "n", interval=False).select("k", "corrected", "shrunken_rate"), "shrunken_rate", digits=4)


AREAS_SQL = "a AS (SELECT c_nationkey, c_mktsegment, count(*) AS customers, CAST(coalesce(sum(n), 0) AS BIGINT) AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey GROUP BY ALL)"


@bound("small_area_rates", f"WITH {AREAS_SQL}, d AS (SELECT c_nationkey, c_mktsegment, CAST(orders AS DOUBLE) AS y, CAST(customers AS DOUBLE) AS n FROM a WHERE customers > 0), {PRIOR_SQL} SELECT c_nationkey, c_mktsegment, CAST(n AS BIGINT) AS customers, round(y / n * 100000, 4) AS raw_rate, round((shape + y) / (rate + n) * 100000, 4) AS shrunken_rate FROM d, prior")
def small_area_rates(t):
    """The dataset of the finer areas: counts, exposures above zero, raw and shrunken rates."""
    per = rt.group_counts(t.orders, "o_custkey", "orders").withColumnRenamed("o_custkey", "c_custkey")
    areas = t.customer.join(per, "c_custkey", "left").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("customers"), F.coalesce(F.sum("orders"), F.lit(0)).alias("orders"))
    out = rt.shrink(areas.filter("customers > 0"), "orders", "customers", interval=False).withColumn("raw_rate", tb.rate_per(F.col("orders"), F.col("customers")))
    return rounded(out.select("c_nationkey", "c_mktsegment", "customers", "raw_rate", "shrunken_rate"), "raw_rate", "shrunken_rate", digits=4)


@bound(
    "deserts",
    f"WITH {UNITS_SQL}, l AS (SELECT *, orders / CAST(customers AS DOUBLE) AS rate FROM units WHERE customers > 0 ORDER BY customers DESC, n_nationkey LIMIT 10) SELECT n_nationkey, customers, CAST(rank() OVER (ORDER BY rate) AS INT) AS position, printf('%d orders among %d customers', orders, customers) AS note FROM l ORDER BY rate, n_nationkey LIMIT 5",
)
def deserts(t):
    """Of the ten largest units the five with the lowest rates, with a note."""
    u = nation_units(t).filter("customers > 0").withColumn("rate", F.try_divide("orders", "customers"))
    ranked = rk.with_rank(rk.top(u, 10, F.desc("customers"), "n_nationkey"), "rate", "position", descending=False)
    return rk.top(ranked, 5, "rate", "n_nationkey").select("n_nationkey", "customers", "position", F.format_string("%d orders among %d customers", "orders", "customers").alias("note"))


@bound(
    "profile_comparison",
    f"WITH {UNITS_SQL}, l AS (SELECT n_nationkey FROM units ORDER BY customers DESC, n_nationkey LIMIT 10) SELECT 'all' AS universe, count(*) AS units, round(avg(customers), 6) AS customers, round(avg(suppliers), 6) AS suppliers FROM units UNION ALL SELECT 'largest', count(*), round(avg(customers), 6), round(avg(suppliers), 6) FROM units WHERE n_nationkey IN (SELECT n_nationkey FROM l)",
)
def profile_comparison(t):
    """Column means of a subset beside those of all."""
    u = nation_units(t)
    means = lambda df, name: df.agg(F.count("*").alias("units"), F.avg("customers").alias("customers"), F.avg("suppliers").alias("suppliers")).select(F.lit(name).alias("universe"), "*")
    return rounded(means(u, "all").unionByName(means(rk.top(u, 10, F.desc("customers"), "n_nationkey"), "largest")), "customers", "suppliers")


@bound(
    "mann_whitney",
    "WITH d AS (SELECT c_mktsegment AS g, c_acctbal AS x FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')), r AS (SELECT g, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM d), s AS (SELECT CAST(count(*) FILTER (g = 'BUILDING') AS DOUBLE) AS n1, CAST(count(*) FILTER (g = 'MACHINERY') AS DOUBLE) AS n2, sum(r) FILTER (g = 'BUILDING') AS w FROM r) SELECT n1, n2, round(w - n1 * (n1 + 1) / 2, 4) AS u, round(2 * (w - n1 * (n1 + 1) / 2) / (n1 * n2) - 1, 6) AS rank_biserial FROM s",
)
def mann_whitney(t):
    """U of the first group, and the rank-biserial correlation; ties take mean ranks, found from counts by value."""
    found = rk.mann_whitney(t.customer, "c_mktsegment", "c_acctbal", "BUILDING", "MACHINERY")
    return found.select("n1", "n2", F.round("u", 4).alias("u"), F.round("rank_biserial", 6).alias("rank_biserial"))


@bound(
    "order_ranks",
    "SELECT o_orderkey, rank() OVER (ORDER BY o_totalprice DESC NULLS LAST) AS place, dense_rank() OVER (ORDER BY o_totalprice DESC NULLS LAST) AS dense, rank() OVER (ORDER BY day) + (count(*) OVER (PARTITION BY day) - 1) / 2.0 AS day_rank FROM (SELECT *, epoch(date_trunc('day', o_orderdate)) AS day FROM orders)",
)
def order_ranks(t):
    """Every order's rank by price, and its mean rank by day, without a window over all orders."""
    o = t.orders.select("o_orderkey", "o_totalprice", F.unix_timestamp(F.date_trunc("day", "o_orderdate")).alias("day"))
    ensure_checkpoint_dir(o.sparkSession)
    placed = rk.exact_rank(o, "o_totalprice", "place", descending=True).checkpoint()
    ranked = rk.exact_rank(placed, "o_totalprice", "dense", "dense", descending=True).checkpoint()
    return rk.exact_rank(ranked, "day", "day_rank", "average").select("o_orderkey", "place", "dense", "day_rank")


@bound(
    "grouped_quantiles",
    "SELECT flag, q, round(value, 6) AS value FROM (SELECT l_returnflag AS flag, unnest([0.01, 0.25, 0.5, 0.75, 0.99]) AS q, unnest(quantile_cont(l_extendedprice, [0.01, 0.25, 0.5, 0.75, 0.99])) AS value FROM lineitem GROUP BY l_returnflag)",
)
def grouped_quantiles(t):
    """Exact quantiles of each group of lines, found by narrowing ranges where a group is large."""
    return tb.exact_quantiles(t.lineitem, "l_extendedprice", [0.01, 0.25, 0.5, 0.75, 0.99], ["l_returnflag"]).select(F.col("l_returnflag").alias("flag"), "q", F.round("value", 6).alias("value"))


@bound(
    "value_modes",
    f"WITH {UNITS_SQL}, r AS (SELECT n_nationkey, customers, suppliers, orders / CAST(customers AS DOUBLE) AS rate FROM units) SELECT n_nationkey, m.mode, round(CASE m.mode WHEN 'raw' THEN rate WHEN 'floored' THEN CASE WHEN customers >= 60 THEN rate END ELSE coalesce(CASE WHEN suppliers > 5 THEN rate / 0.61 END, rate) END, 6) AS shown FROM r, (SELECT unnest(['raw', 'floored', 'model']) AS mode) m",
)
def value_modes(t):
    """The value that each mode of the table shows: raw, above a floor alone, or a model's with the raw one to fall back on."""
    u = nation_units(t).withColumn("rate", F.try_divide("orders", "customers")).withColumn("mode", F.explode(F.array(*map(F.lit, ("raw", "floored", "model")))))
    model = F.coalesce(F.when(F.col("suppliers") > 5, F.col("rate") / 0.61), F.col("rate"))
    shown = F.when(F.col("mode") == "raw", F.col("rate")).when(F.col("mode") == "floored", F.when(F.col("customers") >= 60, F.col("rate"))).otherwise(model)
    return rounded(u.select("n_nationkey", "mode", shown.alias("shown")), "shown")


@bound("sorted_table", "SELECT n_nationkey, CAST(row_number() OVER (ORDER BY n_name DESC, n_nationkey) AS INT) AS by_name_down, CAST(row_number() OVER (ORDER BY n_regionkey, n_nationkey) AS INT) AS by_region_up FROM nation")
def sorted_table(t):
    """Positions in the table sorted by a column, in either direction, ids last."""
    place = lambda c, down: F.row_number().over(Window.orderBy(F.desc(c) if down else F.asc(c), "n_nationkey"))
    return t.nation.select("n_nationkey", place("n_name", True).alias("by_name_down"), place("n_regionkey", False).alias("by_region_up"))


@bound(
    "list_union",
    "WITH a AS (SELECT DISTINCT p_brand, p_name, p_size FROM part WHERE p_partkey % 2 = 0), b AS (SELECT DISTINCT p_brand, p_name FROM part WHERE p_partkey % 2 = 1), i AS (SELECT DISTINCT p_brand, p_name FROM a WHERE p_size <= 40), x AS (SELECT DISTINCT p_brand, p_name FROM a WHERE p_size > 40), u AS (SELECT p_brand, p_name, (p_brand, p_name) IN (SELECT (p_brand, p_name) FROM i) AS in_a, (p_brand, p_name) IN (SELECT (p_brand, p_name) FROM b) AS in_b, (p_brand, p_name) IN (SELECT (p_brand, p_name) FROM x) AS in_x FROM (SELECT * FROM i UNION SELECT * FROM b)) SELECT CASE WHEN in_a AND in_b THEN 'both' WHEN in_a THEN 'first' WHEN in_x THEN 'second, excluded type' ELSE 'second' END AS seen, count(*) AS records FROM u GROUP BY 1",
)
def list_union(t):
    """Records seen by either of two lists; what the first lacks is absent, or there under an excluded type."""
    key = ["p_brand", "p_name"]
    a = t.part.filter(F.col("p_partkey") % 2 == 0)
    flag = lambda df, name: df.select(*key).distinct().withColumn(name, F.lit(True))
    included, excluded = flag(a.filter("p_size <= 40"), "a"), flag(a.filter("p_size > 40"), "x")
    both = included.join(flag(t.part.filter(F.col("p_partkey") % 2 == 1), "b"), key, "full_outer").join(excluded, key, "left")
    seen = F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "first").when(F.col("x"), "second, excluded type").otherwise("second")
    return both.groupBy(seen.alias("seen")).agg(F.count("*").alias("records"))


@bound("column_concat", "WITH a AS (SELECT c_nationkey AS k, count(*) AS rich FROM customer WHERE c_acctbal > 9500 GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS poor FROM supplier WHERE s_acctbal < 2000 GROUP BY 1) SELECT k, coalesce(rich, -1) AS rich, coalesce(poor, -1) AS poor FROM a FULL JOIN b USING (k)")
def column_concat(t):
    a = rt.group_counts(t.customer.filter("c_acctbal > 9500"), "c_nationkey", "rich").withColumnRenamed("c_nationkey", "k")
    b = rt.group_counts(t.supplier.filter("s_acctbal < 2000"), "s_nationkey", "poor").withColumnRenamed("s_nationkey", "k")
    return a.join(b, "k", "full_outer").fillna(-1)


@bound(
    "dates_as_of",
    "WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%m/%d/%Y') END AS raw FROM orders), p AS (SELECT try_strptime(raw, '%m/%d/%Y') AS t FROM d) SELECT count(*) AS n, count(*) FILTER (t IS NULL) AS unparsed, count(*) FILTER (t >= TIMESTAMP '1996-01-01') AS running FROM p",
)
def dates_as_of(t):
    """Texts parsed as dates, or missing; and those not past at a given day, which is a parameter and never the clock's."""
    raw = F.when(F.col("o_orderkey") % 7 == 0, "unknown").otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
    at = F.try_to_timestamp(raw, F.lit("MM/dd/yyyy"))
    return t.orders.select(at.alias("at")).agg(F.count("*").alias("n"), F.count_if(F.col("at").isNull()).alias("unparsed"), F.count_if(F.col("at") >= F.lit("1996-01-01").cast("timestamp")).alias("running"))


@bound(
    "mapped_lists",
    "WITH r AS (SELECT r_regionkey, 'X, ' || string_agg(CAST(n_nationkey AS VARCHAR), '-' ORDER BY n_nationkey) AS title FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1), l AS (SELECT r_regionkey, list_transform(string_split(regexp_extract(title, ', (.*)$', 1), '-'), lambda x: CAST(x AS INTEGER)) AS ks FROM r), k AS (SELECT *, list_filter(ks, lambda x: x % 3 <> 0) AS known FROM l) SELECT r_regionkey, CAST(len(ks) AS INT) AS parts, round(list_avg(list_transform(known, lambda x: x * 1.5)), 6) AS mean_value, CASE WHEN len(known) = 0 THEN 'none' WHEN len(known) < len(ks) THEN 'partial' ELSE 'full' END AS status FROM k",
)
def mapped_lists(t):
    """A title's list of keys, the mean of the values that are known for them, and whether all, some or none are."""
    keys = F.array_sort(F.collect_list("n_nationkey"))
    title = t.nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.concat(F.lit("X, "), F.array_join(F.transform(keys, lambda x: x.cast("string")), "-")).alias("title"))
    ks = F.transform(F.split(F.regexp_extract("title", ", (.*)$", 1), "-"), lambda x: x.cast("int"))
    out = title.select("r_regionkey", ks.alias("ks")).withColumn("known", F.filter("ks", lambda x: x % 3 != 0))
    total = F.aggregate("known", F.lit(0.0), lambda s, x: s + x * 1.5)
    status = F.when(F.size("known") == 0, "none").when(F.size("known") < F.size("ks"), "partial").otherwise("full")
    return out.select("r_regionkey", F.size("ks").alias("parts"), F.round(F.try_divide(total, F.size("known")), 6).alias("mean_value"), status.alias("status"))


@bound("tag_coverage", "SELECT event_type, round(avg(CASE WHEN json_exists(props, '$.k') THEN 1.0 ELSE 0.0 END), 6) AS has_k FROM events GROUP BY event_type")
def tag_coverage(t):
    tags = F.from_json("props", "map<string,string>")
    return t.events.groupBy("event_type").agg(F.round(F.avg(F.coalesce(F.map_contains_key(tags, "k"), F.lit(False)).cast("double")), 6).alias("has_k"))


LOSO_SQL = (
    LINE_SQL
    + """, s AS (SELECT h.g AS g, sum(w) AS w, sum(w*x) AS wx, sum(w*y) AS wy, sum(w*x*x) AS wxx, sum(w*x*y) AS wxy FROM (SELECT DISTINCT g FROM d) h JOIN d ON d.g <> h.g GROUP BY h.g),
f AS (SELECT g, (w*wxy-wx*wy)/(w*wxx-wx*wx) AS slope, (wy-(w*wxy-wx*wy)/(w*wxx-wx*wx)*wx)/w AS intercept FROM s),
p AS (SELECT d.g, least(1.0, sum((f.intercept + f.slope * x) * d.w) / sum(d.w)) AS line, sum(y * d.w) / sum(d.w) AS own FROM d JOIN f ON f.g = d.g GROUP BY d.g),
b AS (SELECT p.g, any_value(line) AS line, any_value(p.own) AS own, avg(o.own) AS near, CAST(count(*) AS DOUBLE) AS n FROM p JOIN (SELECT g AS og, own FROM p) o ON og <> p.g AND abs(og - p.g) <= 2 GROUP BY p.g),
k AS (SELECT CAST(unnest([0.5, 1.0, 2.0, 5.0, 13.0]) AS DOUBLE) AS k),
e AS (SELECT g, k, own, line, least(1.0, n / (n + k) * near + (1 - n / (n + k)) * line) AS blend FROM b, k)"""
)


def held_out_predictions(t):
    """For each group left out: its own rate, the line's prediction from the other groups, weighted and at most 1, and its blends with the neighbours' rates."""
    d = line_d(t)
    fit = regress.leave_one_group_out_wls(d, "y", "x", "w", "g").select("g", "slope", "intercept")
    guess = F.sum((F.col("intercept") + F.col("slope") * F.col("x")) * F.col("w")) / F.sum("w")
    p = d.join(fit, "g").groupBy("g").agg(F.least(F.lit(1.0), guess).alias("line"), (F.sum(F.col("y") * F.col("w")) / F.sum("w")).alias("own"))
    other = p.select(F.col("g").alias("og"), F.col("own").alias("oown"))
    near = p.select("g").join(other, (F.col("og") != F.col("g")) & (F.abs(F.col("og") - F.col("g")) <= 2)).groupBy("g").agg(F.avg("oown").alias("near"), F.count("*").cast("double").alias("n"))
    grid = p.join(near, "g").withColumn("k", F.explode(F.lit([0.5, 1.0, 2.0, 5.0, 13.0])))
    w = F.col("n") / (F.col("n") + F.col("k"))
    return grid.select("g", "k", "own", "line", F.least(F.lit(1.0), w * F.col("near") + (1 - w) * F.col("line")).alias("blend"))


@bound("loso_blend", LOSO_SQL + " SELECT k, round(avg(abs(blend - own)), 8) AS mae, round(sqrt(avg((blend - own) * (blend - own))), 8) AS rmse FROM e GROUP BY k")
def loso_blend(t):
    e = F.col("blend") - F.col("own")
    return rounded(held_out_predictions(t).groupBy("k").agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse")), "mae", "rmse", digits=8)


@bound(
    "adoption_rule",
    LOSO_SQL + " SELECT k, count(*) FILTER (abs(blend - own) < abs(line - own)) AS wins, count(*) AS units, round(1 - avg(abs(blend - own)) / avg(abs(line - own)), 6) AS better, 1 - avg(abs(blend - own)) / avg(abs(line - own)) > 0.05 AND 2 * count(*) FILTER (abs(blend - own) < abs(line - own)) >= count(*) AS adopted FROM e GROUP BY k",
)
def adoption_rule(t):
    """Units in which the blend is nearer than the line, and whether it is adopted: over 5 % nearer in the mean, and nearer in half of the units."""
    a, b = F.abs(F.col("blend") - F.col("own")), F.abs(F.col("line") - F.col("own"))
    out = held_out_predictions(t).groupBy("k").agg(F.count_if(a < b).alias("wins"), F.count("*").alias("units"), (1 - F.avg(a) / F.avg(b)).alias("better"))
    return rounded(out.withColumn("adopted", (F.col("better") > 0.05) & (2 * F.col("wins") >= F.col("units"))), "better")


@bound("anchor_exclusion", f"WITH {POINTS_SQL}, a AS (SELECT * FROM pt WHERE vec_id % 97 = 0) SELECT vec_id FROM pt WHERE NOT EXISTS (SELECT 1 FROM a WHERE sqrt(power(a.lat - pt.lat, 2) + power(a.lon - pt.lon, 2)) < 0.05)")
def anchor_exclusion(t):
    """Points that no anchor is nearer to than a distance in the plane: anchors are copied to the cells around theirs."""
    r = 0.05
    cell = lambda c: F.floor(F.col(c) / r).cast("long")
    p = points(t).withColumns({"cx": cell("lon"), "cy": cell("lat")})
    around = lambda c: F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1))
    a = p.filter("vec_id % 97 = 0").select(F.col("lat").alias("alat"), F.col("lon").alias("alon"), "cx", "cy")
    a = a.withColumn("cx", around("cx")).withColumn("cy", around("cy"))
    near = F.sqrt(F.pow(F.col("alat") - F.col("lat"), 2) + F.pow(F.col("alon") - F.col("lon"), 2)) < r
    hit = p.join(a, ["cx", "cy"]).filter(near).select("vec_id").distinct()
    return p.select("vec_id").join(hit, "vec_id", "left_anti")


@bound("dissolved_edges", f"WITH {EDGES_SQL} SELECT DISTINCT least(a.n_regionkey, b.n_regionkey) AS src, greatest(a.n_regionkey, b.n_regionkey) AS dst FROM e JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst WHERE a.n_regionkey <> b.n_regionkey")
def dissolved_edges(t):
    """Contiguity of groups of areas, from that of the areas."""
    of = lambda c: t.nation.select(F.col("n_nationkey").alias(c), F.col("n_regionkey").alias("g" + c))
    e = nation_edges(t).join(of("src"), "src").join(of("dst"), "dst").filter("gsrc <> gdst")
    return e.select(F.least("gsrc", "gdst").alias("src"), F.greatest("gsrc", "gdst").alias("dst")).distinct()


@bound(
    "holdout_lpd",
    f"""WITH {AREAS_SQL}, h AS (SELECT concat_ws('|', c_nationkey, c_mktsegment) AS area, CAST(orders AS DOUBLE) AS y, CAST(customers AS DOUBLE) AS n FROM a), d AS (SELECT y, n FROM h WHERE md5(area || ':42') >= '33333333'), {PRIOR_SQL},
g AS (SELECT mean * exp(-6 / sqrt(shape) - 12 / shape + i / 480.0 * (12 / sqrt(shape) + 12 / shape)) AS r, shape, rate FROM prior, range(481) t(i)), w AS (SELECT r, shape * ln(r) - rate * r AS lw FROM g), z AS (SELECT max(lw) AS top FROM w), tot AS (SELECT max(top) + ln(sum(exp(lw - top))) AS total FROM w, z),
q AS (SELECT area, y, n, lw + y * ln(r * n) - r * n AS lq FROM h, w WHERE md5(area || ':42') < '33333333'), m AS (SELECT area, y, n, max(lq) AS top FROM q GROUP BY ALL), e AS (SELECT m.area, m.y, m.n, m.top + ln(sum(exp(lq - m.top))) AS mass FROM q JOIN m ON q.area = m.area GROUP BY m.area, m.y, m.n, m.top)
SELECT area, y, n, round(lgamma(y + shape) - lgamma(shape) - lgamma(y + 1) + shape * ln(rate / (rate + n)) + y * ln(n / (rate + n)), 5) AS lpd, round(mass - total - lgamma(y + 1), 5) AS lpd_grid FROM e, tot, prior""",
)
def holdout_lpd(t):
    """Log predictive density of the areas held out (a fifth, by a seeded hash) under the prior of the others."""
    a = regress.holdout(area_table(t).select("area", "y", "n"), "area")
    out = rt.held_out_log_density(a.filter("NOT held_out"), a.filter("held_out"), "y", "n")
    return rounded(out.drop("held_out"), "lpd", "lpd_grid", digits=5)


@bound(
    "polygon_layers",
    f"""WITH {POINTS_SQL}, i AS (SELECT *, lon > -0.3 AND lon < 0.3 AND lat > 39.7 AND lat < 40.3 AND NOT (lon >= -0.1 AND lon <= 0.1 AND lat >= 39.9 AND lat <= 40.1) AS ring, (lon > 0.3 AND lon < 0.5 OR lon > -0.5 AND lon < -0.3) AND lat > 39.7 AND lat < 40.3 AS wings, lon > 0 AND lon < 0.2 AND lat > 39.8 AND lat < 40.2 AS place FROM pt)
SELECT vec_id AS point_id, CASE WHEN ring THEN 'ring' WHEN wings THEN 'wings' ELSE 'none' END AS area_id, CASE WHEN place THEN 'place' ELSE 'none' END AS place_id FROM i""",
)
def polygon_layers(t):
    """Points placed in two layers of areas, one after the other: an area with a hole, one of two parts, and a smaller place."""
    return in_layers(t, *layers(t.nation.sparkSession))


def layers(spark) -> tuple[DataFrame, DataFrame]:
    box = lambda x0, x1, y0, y1: ([x0, x1, x1, x0], [y0, y0, y1, y1])
    shape = lambda name, *boxes: (name, [b[0] for b in boxes], [b[1] for b in boxes])
    schema = "area_id string, xs array<array<double>>, ys array<array<double>>"
    areas = spark.createDataFrame([shape("ring", box(-0.3, 0.3, 39.7, 40.3), box(-0.1, 0.1, 39.9, 40.1)), shape("wings", box(0.3, 0.5, 39.7, 40.3), box(-0.5, -0.3, 39.7, 40.3))], schema)
    return areas, spark.createDataFrame([shape("place", box(0.0, 0.2, 39.8, 40.2))], schema)


def in_layers(t, areas: DataFrame, places: DataFrame) -> DataFrame:
    p = points(t).select(F.col("vec_id").alias("point_id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    first = spatial.points_in_polygons(p, areas, 0.1)
    second = spatial.points_in_polygons(p, places, 0.1).withColumnRenamed("area_id", "place_id")
    return first.join(second, "point_id").fillna("none")


@bound("polygon_files", ORACLES["polygon_layers"])
def polygon_files(t):
    """The layers of polygon_layers written as polygon files and read back."""
    spark = t.nation.sparkSession
    polygons.register(spark)
    place = scratch_dir(spark, "polygons")
    read = []
    for name, layer in zip(("areas", "places"), layers(spark), strict=True):
        layer.write.format("polygons").mode("overwrite").save(f"{place}/{name}")
        read.append(spark.read.format("polygons").load(f"{place}/{name}"))
    return in_layers(t, *read)


def parcels(t) -> DataFrame:
    """Around each point an area of two parts, one with a hole: a square of 0.02 with a square of 0.01 cut out, and a strip beside it."""
    lon, lat = F.col("lon"), F.col("lat")
    box = lambda c, *at: F.array(*[c + v for v in at])
    xs = F.array(box(lon, -0.01, 0.01, 0.01, -0.01), box(lon, -0.005, 0.005, 0.005, -0.005), box(lon, 0.02, 0.03, 0.03, 0.02))
    ys = F.array(box(lat, -0.01, -0.01, 0.01, 0.01), box(lat, -0.005, -0.005, 0.005, 0.005), box(lat, -0.01, -0.01, 0.03, 0.03))
    return points(t).select("vec_id", xs.alias("xs"), ys.alias("ys"))


@bound("geometry_column", f"WITH {POINTS_SQL} SELECT vec_id, CAST(9 + 3 * (4 + 5 * 16) + 2 * 9 AS BIGINT) AS bytes, 3 AS rings, 12 AS vertices, round(lon + 0.03, 9) AS east, round(lat + 0.03, 9) AS north FROM pt")
def geometry_column(t):
    """Polygons written with a well-known binary column and nothing else, read back and decoded."""
    spark = t.nation.sparkSession
    place = scratch_dir(spark, "geometry")
    write_parquet(shapes.with_wkb(parcels(t)).select("vec_id", "geometry"), place)
    back = shapes.with_rings(spark.read.parquet(place))
    count = F.aggregate("xs", F.lit(0), lambda n, x: n + F.size(x))
    return back.select("vec_id", F.octet_length("geometry").cast("long").alias("bytes"), F.size("xs").alias("rings"), count.alias("vertices"), F.round(F.array_max(F.flatten("xs")), 9).alias("east"), F.round(F.array_max(F.flatten("ys")), 9).alias("north"))


#: Metres of a degree in a plane that keeps the parallel of 40 degrees.
PLANE = (85_393.0, 111_195.0)


@bound(
    "centroids",
    f"WITH {POINTS_SQL} SELECT vec_id, round((0.0004 - 0.0001 + 0.0004) * {PLANE[0]} * {PLANE[1]}, 1) AS area, round((lon * 0.0003 + (lon + 0.025) * 0.0004) / 0.0007 * {PLANE[0]}, 1) AS x, round((lat * 0.0003 + (lat + 0.01) * 0.0004) / 0.0007 * {PLANE[1]}, 1) AS y FROM pt",
)
def centroids(t):
    """Areas and centroids in metres; a hole takes its share away."""
    found = shapes.moments(shapes.with_orientation(parcels(t)), "vec_id", lambda x, y: (x * PLANE[0], y * PLANE[1]))
    return rounded(found, "area", "x", "y", digits=1)


_EAST, _NORTH = spatial.albers_sql("(lon - 96)", "lat")


@bound("anchors_by_metres", f"WITH {POINTS_SQL}, p AS (SELECT vec_id, {_EAST} AS x, {_NORTH} AS y FROM pt), a AS (SELECT * FROM p WHERE vec_id % 97 = 0) SELECT vec_id FROM p WHERE NOT EXISTS (SELECT 1 FROM a WHERE sqrt(power(a.x - p.x, 2) + power(a.y - p.y, 2)) < 5000)")
def anchors_by_metres(t):
    """Points that no anchor is nearer to than 5 km in an equal-area plane."""
    p = points(t).select("vec_id", (F.col("lon") - 96).alias("lon"), "lat")
    return spatial.away_from(p, p.filter("vec_id % 97 = 0").select("lon", "lat"), 5000.0).select("vec_id")


@bound(
    "class_movers",
    TWO_RATES
    + f", {GI_SQL.replace('s AS (', 'gs AS (').replace('FROM x, s)', 'FROM x, gs)')}, j AS (SELECT CASE WHEN z > 1 THEN 'hot' WHEN z < -1 THEN 'cold' ELSE 'neither' END AS class, CAST(rank_old AS INT) - CAST(rank_new AS INT) AS change FROM k LEFT JOIN g ON node = n_nationkey) SELECT class, count(*) AS units, count(*) FILTER (change > 0) AS up, count(*) FILTER (change < 0) AS down, round(avg(CASE WHEN abs(change) >= 5 THEN 1.0 ELSE 0.0 END), 6) AS share_far, round(avg(change), 6) AS mean_change FROM j GROUP BY class",
)
def class_movers(t):
    """Changes of rank by class of spatial association (beyond one deviation of Gi*): moved up, down, and five places or more."""
    z = spatial.gi_star(nation_values(t), nation_edges(t), "v").select(F.col("node").alias("n_nationkey"), "z")
    j = two_ranks(t).join(z, "n_nationkey", "left")
    named = F.when(F.col("z") > 1, "hot").when(F.col("z") < -1, "cold").otherwise("neither")
    far = F.avg((F.abs("change") >= 5).cast("double")).alias("share_far")
    out = j.groupBy(named.alias("class")).agg(F.count("*").alias("units"), F.count_if(F.col("change") > 0).alias("up"), F.count_if(F.col("change") < 0).alias("down"), far, F.avg("change").alias("mean_change"))
    return rounded(out, "share_far", "mean_change")


@bound(
    "effect_redundancy",
    f"WITH {UNITS_SQL}, d AS (SELECT n_regionkey, n_nationkey, 0.3 + 0.02 * n_nationkey AS coverage, orders / CAST(customers AS DOUBLE) AS rate FROM units WHERE customers > 0 AND orders > 0), g AS (SELECT n_regionkey, avg(ln(rate)) AS raw, avg(ln(rate / coverage)) AS corrected, avg(ln(1 / coverage)) AS lack FROM d GROUP BY n_regionkey), o AS (SELECT n_regionkey, raw - avg(raw) OVER () AS raw_effect, corrected - avg(corrected) OVER () AS corrected_effect, lack FROM g) SELECT n_regionkey, round(raw_effect, 6) AS raw_effect, round(corrected_effect, 6) AS corrected_effect, round(CAST(lack AS DOUBLE), 6) AS log_inverse, round(corr(raw_effect, lack) OVER (), 6) AS raw_corr, round(corr(corrected_effect, lack) OVER (), 6) AS corrected_corr FROM o",
)
def effect_redundancy(t):
    """Group effects on log rates, raw and corrected for coverage, beside log(1 / coverage), and how each goes with it."""
    coverage = F.lit(0.3) + F.lit(0.02) * F.col("n_nationkey")
    d = nation_units(t).filter("customers > 0 AND orders > 0").withColumns({"rate": F.try_divide("orders", "customers"), "coverage": coverage})
    g = d.groupBy("n_regionkey").agg(F.avg(F.log("rate")).alias("raw"), F.avg(F.log(F.col("rate") / F.col("coverage"))).alias("corrected"), F.avg(F.log(1 / F.col("coverage"))).alias("log_inverse"))
    s = g.agg(F.avg("raw").alias("raw_mean"), F.avg("corrected").alias("corrected_mean"), F.corr("raw", "log_inverse").alias("raw_corr"), F.corr("corrected", "log_inverse").alias("corrected_corr"))
    out = g.crossJoin(F.broadcast(s)).withColumns({"raw_effect": F.col("raw") - F.col("raw_mean"), "corrected_effect": F.col("corrected") - F.col("corrected_mean")})
    return rounded(out.select("n_regionkey", "raw_effect", "corrected_effect", "log_inverse", "raw_corr", "corrected_corr"), "raw_effect", "corrected_effect", "log_inverse", "raw_corr", "corrected_corr")


DRIVERS = {"building": "c_mktsegment = 'BUILDING'", "low_nation": "c_nationkey < 10", "round_key": "c_custkey % 10 = 0", "frequent": "orders > 10"}
_CUSTOMERS = "d AS (SELECT c_acctbal AS v, c_mktsegment, c_nationkey, c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders FROM customer)"


@bound(
    "hypothesis_table",
    f"WITH {_CUSTOMERS}, e AS (" + " UNION ALL ".join(f"SELECT '{k}' AS driver, {c} AS f, v FROM d" for k, c in DRIVERS.items()) + """),
r AS (SELECT *, rank() OVER (PARTITION BY driver ORDER BY v) + (count(*) OVER (PARTITION BY driver, v) - 1) / 2.0 AS r FROM e), ties AS (SELECT driver, sum(power(n, 3) - n) AS ties FROM (SELECT driver, v, CAST(count(*) AS DOUBLE) AS n FROM e GROUP BY ALL) GROUP BY driver),
m AS (SELECT driver, count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n2, avg(v) FILTER (f) AS m1, avg(v) FILTER (NOT f) AS m2, var_samp(v) FILTER (f) AS v1, var_samp(v) FILTER (NOT f) AS v2, sum(r) FILTER (f) AS w FROM r GROUP BY driver),
x AS (SELECT *, CAST(n1 AS DOUBLE) AS a, CAST(n2 AS DOUBLE) AS b, v1 / n1 AS s1, v2 / n2 AS s2 FROM m JOIN ties USING (driver))
SELECT driver, n1, n2, round((m1 - m2) / sqrt(s1 + s2), 5) AS t, round(power(s1 + s2, 2) / (s1 * s1 / (n1 - 1) + s2 * s2 / (n2 - 1)), 4) AS df, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) * (1 - 3.0 / (4.0 * (n1 + n2) - 9)), 6) AS hedges_g,
 round(w - a * (a + 1) / 2, 2) AS u, round(2 * (w - a * (a + 1) / 2) / (a * b) - 1, 6) AS rank_biserial, round((w - a * (a + 1) / 2 - a * b / 2) / sqrt(a * b / 12 * (a + b + 1 - ties / ((a + b) * (a + b - 1)))), 5) AS z FROM x""",
)
def hypothesis_table(t):
    """Customers' balances by four conditions; p- and q-values, which SQL lacks, are tested against other formulas."""
    orders = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    d = t.customer.join(orders, "c_custkey", "left").fillna(0, ["orders"])
    found = hypotheses.contrasts(d, "c_acctbal", {k: F.expr(c) for k, c in DRIVERS.items()})
    digits = {"t": 5, "df": 4, "hedges_g": 6, "u": 2, "rank_biserial": 6, "z": 5}
    return found.select("driver", "n1", "n2", *[F.round(c, d).alias(c) for c, d in digits.items()])


#: Draws of an area's rate: its mean spread evenly from half to one and a half times, by a hash of area and draw.
_DRAWS = """, h AS (SELECT concat_ws('|', c_nationkey, c_mktsegment) AS area, CAST(orders AS DOUBLE) AS y, CAST(customers AS DOUBLE) AS n FROM a), i AS (SELECT area, y, n, d, (CAST(('0x' || md5(area || ':' || d || ':42')[1:8]) AS UBIGINT) + 0.5) / 4294967296.0 AS u FROM h, range(250) t(d)), w AS (SELECT *, (y + 1) / n * (0.5 + u) AS rate FROM i)"""


def area_draws(t) -> DataFrame:
    """250 draws of each area's rate, written in blocks and read back."""
    a = area_table(t).select("area", "y", "n")
    each = a.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(249))))
    rate = (F.col("y") + 1) / F.col("n") * (0.5 + draws.uniform(F.col("area"), F.col("draw"), 42))
    place = scratch_dir(a.sparkSession, "draws")
    draws.write_draws(each.select("draw", F.col("area").alias("unit"), rate.alias("value")), place)
    return draws.read_draws(a.sparkSession, place)


@bound("posterior_quantiles", f"WITH {AREAS_SQL}{_DRAWS} SELECT area, q, round(value, 8) AS value FROM (SELECT area, unnest([0.025, 0.5, 0.975]) AS q, unnest(quantile_cont(rate, [0.025, 0.5, 0.975])) AS value FROM w GROUP BY area)")
def posterior_quantiles(t):
    return draws.described(area_draws(t), [0.025, 0.5, 0.975]).select(F.col("unit").alias("area"), "q", F.round("value", 8).alias("value"))


@bound("draws_lpd", f"WITH {AREAS_SQL}{_DRAWS}, l AS (SELECT area, y * ln(rate * n) - rate * n AS ll FROM w), m AS (SELECT area, max(ll) AS top FROM l GROUP BY area) SELECT l.area, count(*) AS draws, round(any_value(top) + ln(sum(exp(ll - top))) - ln(count(*)), 6) AS log_mean FROM l JOIN m ON l.area = m.area GROUP BY l.area")
def draws_lpd(t):
    """Log of the mean likelihood of each area's count over the draws of its rate."""
    a = area_table(t).select(F.col("area").alias("unit"), "y", "n")
    terms = area_draws(t).join(a, "unit").withColumn("ll", draws.poisson_log(F.col("y"), F.col("value") * F.col("n")))
    found = draws.log_mean_exp(terms, "unit", "draw", "ll")
    return found.select(F.col("unit").alias("area"), F.col("n").alias("draws"), F.round("log_mean", 6).alias("log_mean"))
