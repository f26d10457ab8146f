"""Rates, regressions, linkage and spatial statistics bound to the driver's tables, with SQL where SQL can give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratefield.functions import text as tx
from ratefield.operators import bayes, graphs, linkage, regress, spatial
from ratefield.operators import ranking as rk
from ratefield.operators import rates as rt
from ratefield.operators.lists import independence
from ratefield.plans.relational import PRIOR_SQL, UNITS_SQL, nation_units, rounded
from ratefield.plans.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def bound(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return keep


# Shrinkage in its three cases: ordinary (orders per nation), skewed (orders per customer on balances), fallback (returns per brand).

NATION_D = f"{UNITS_SQL}, d AS (SELECT n_nationkey AS k, CAST(orders AS DOUBLE) AS y, CAST(customers AS DOUBLE) AS n FROM units WHERE customers > 0)"
CUSTOMER_D = "d AS (SELECT c_custkey AS k, CAST(count(o_orderkey) AS DOUBLE) AS y, any_value(c_acctbal) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY c_custkey)"
BRAND_D = "d AS (SELECT p_brand AS k, CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) AS y, CAST(count(*) AS DOUBLE) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand)"


def nation_d(t):
    return nation_units(t).filter("customers > 0").select(F.col("n_nationkey").alias("k"), F.col("orders").cast("double").alias("y"), F.col("customers").cast("double").alias("n"))


def customer_d(t):
    per = rt.group_counts(t.orders, "o_custkey", "y").withColumnRenamed("o_custkey", "k")
    return t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("n")).join(per, "k", "left").select("k", F.coalesce("y", F.lit(0)).cast("double").alias("y"), "n")


def brand_d(t):
    lines = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), "l_returnflag").join(t.part.select("p_partkey", "p_brand"), "p_partkey")
    return lines.groupBy(F.col("p_brand").alias("k")).agg(F.count_if(F.col("l_returnflag") == "R").cast("double").alias("y"), F.count("*").cast("double").alias("n"))


for _name, _sql, _d in (("nation", NATION_D, nation_d), ("customer", CUSTOMER_D, customer_d), ("brand", BRAND_D, brand_d)):

    @bound(f"eb_prior_{_name}", f"WITH {_sql}, {PRIOR_SQL} SELECT units, CAST(printf('%.6e', mean) AS DOUBLE) AS mean, CAST(printf('%.6e', shape) AS DOUBLE) AS shape FROM prior")
    def eb_prior(t, d=_d):
        p = rt.poisson_gamma_prior(d(t), "y", "n")
        return p.select("units", *[F.format_string("%.6e", F.col(c)).cast("double").alias(c) for c in ("mean", "shape")])

    @bound(f"eb_rates_{_name}", f"WITH {_sql}, {PRIOR_SQL} SELECT k, y, n, round((shape + y) / (rate + n) * 100000, 4) AS shrunken_rate FROM d, prior")
    def eb_rates(t, d=_d):
        return rounded(rt.shrink(d(t), "y", "n", interval=False), "shrunken_rate", digits=4)


@bound("eb_intervals")
def eb_intervals(t):
    """Posterior means with exact Gamma intervals; tests check the quantiles against their distribution function."""
    return rt.shrink(nation_d(t), "y", "n")


@bound(
    "coverage_correction",
    f"""WITH {UNITS_SQL}, c AS (SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 0.5 WHEN 1 THEN 0.8 WHEN 2 THEN 1.2 END AS known, orders, ln(greatest(customers, 1)) AS ld FROM units),
g AS (SELECT *, ln(0.61) + 0.062 * (ld - 4.876) AS guess FROM c), r AS (SELECT n_nationkey, orders, least(1.0, coalesce(known, exp(guess))) AS coverage, CASE WHEN known IS NULL THEN least(1.0, exp(guess - 1.96 * sqrt(0.1062))) ELSE -1 END AS low, CASE WHEN known IS NULL THEN least(1.0, exp(guess + 1.96 * sqrt(0.1062))) ELSE -1 END AS high FROM g)
SELECT n_nationkey, round(CAST(coverage AS DOUBLE), 6) AS coverage, round(CAST(low AS DOUBLE), 6) AS low, round(CAST(high AS DOUBLE), 6) AS high, round(CAST(orders / coverage AS DOUBLE), 4) AS corrected FROM r""",
)
def coverage_correction(t):
    known = t.nation.sparkSession.createDataFrame([(0, 0.5), (1, 0.8), (2, 1.2)], "n_regionkey int, capture_rate double")
    u = nation_units(t).withColumn("ld", F.log(F.greatest("customers", F.lit(1))))
    out = rt.correct_coverage(u, "n_regionkey", "orders", known, "ld")
    out = out.select("n_nationkey", "coverage", F.coalesce("coverage_low", F.lit(-1.0)).alias("low"), F.coalesce("coverage_high", F.lit(-1.0)).alias("high"), "corrected")
    return rounded(rounded(out, "coverage", "low", "high"), "corrected", digits=4)


LINE_SQL = f"WITH {UNITS_SQL}, d AS (SELECT n_regionkey AS g, ln(customers) AS x, suppliers / CAST(customers AS DOUBLE) AS y, CAST(orders AS DOUBLE) AS w FROM units WHERE customers > 0)"


def line_d(t):
    u = nation_units(t).filter("customers > 0")
    return u.select(F.col("n_regionkey").alias("g"), F.log("customers").alias("x"), F.try_divide("suppliers", "customers").alias("y"), F.col("orders").cast("double").alias("w"))


@bound("wls_fit", LINE_SQL + " SELECT round((sum(w)*sum(w*x*y)-sum(w*x)*sum(w*y))/(sum(w)*sum(w*x*x)-sum(w*x)*sum(w*x)), 6) AS slope, round((sum(w*y)-(sum(w)*sum(w*x*y)-sum(w*x)*sum(w*y))/(sum(w)*sum(w*x*x)-sum(w*x)*sum(w*x))*sum(w*x))/sum(w), 6) AS intercept FROM d")
def wls_fit(t):
    return rounded(regress.wls(line_d(t), "y", "x", "w"), "slope", "intercept")


@bound("ols_fit", LINE_SQL + " SELECT CAST(regr_count(y, x) AS BIGINT) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM d")
def ols_fit(t):
    return rounded(regress.ols(line_d(t), "y", "x"), "slope", "intercept", "r2")


@bound("ols_fe", LINE_SQL + ", c AS (SELECT y - avg(y) OVER (PARTITION BY g) AS cy, x - avg(x) OVER (PARTITION BY g) AS cx FROM d) SELECT count(*) AS n, round(sum(cx * cy) / sum(cx * cx), 6) AS slope FROM c")
def ols_fe(t):
    return rounded(regress.ols_within(line_d(t), "y", "x", "g"), "slope")


@bound("loso_wls", LINE_SQL + ", s AS (SELECT h.g AS g, sum(w) AS w, sum(w*x) AS wx, sum(w*y) AS wy, sum(w*x*x) AS wxx, sum(w*x*y) AS wxy FROM (SELECT DISTINCT g FROM d) h JOIN d ON d.g <> h.g GROUP BY h.g) SELECT g, round((w*wxy-wx*wy)/(w*wxx-wx*wx), 6) AS slope, round((wy-(w*wxy-wx*wy)/(w*wxx-wx*wx)*wx)/w, 6) AS intercept FROM s")
def loso_wls(t):
    return rounded(regress.leave_one_group_out_wls(line_d(t), "y", "x", "w", "g"), "slope", "intercept")


LISTS_SQL = "l AS (SELECT user_id, max(CASE WHEN event_type = 'click' AND event_id % 3 = 0 THEN 1 ELSE 0 END) AS a, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS b, max(CASE WHEN event_type NOT IN ('click', 'purchase') AND event_id % 5 = 0 THEN 1 ELSE 0 END) AS c FROM events GROUP BY user_id)"


def lists(t):
    e, k = F.col("event_type"), F.col("event_id")
    flag = lambda c: F.max(F.when(c, 1).otherwise(0))
    return t.events.groupBy("user_id").agg(flag((e == "click") & (k % 3 == 0)).alias("a"), flag(e == "purchase").alias("b"), flag(~e.isin("click", "purchase") & (k % 5 == 0)).alias("c"))


@bound("chapman", f"WITH {LISTS_SQL}, s AS (SELECT CAST(sum(a) AS DOUBLE) AS n1, CAST(sum(b) AS DOUBLE) AS n2, CAST(sum(a * b) AS DOUBLE) AS m FROM l) SELECT n1, n2, m, round((n1+1)*(n2+1)/(m+1)-1, 6) AS population, round(sqrt((n1+1)*(n2+1)*(n1-m)*(n2-m)/((m+1)*(m+1)*(m+2))), 6) AS se FROM s")
def chapman(t):
    s = lists(t).agg(F.sum("a").cast("double").alias("n1"), F.sum("b").cast("double").alias("n2"), F.sum(F.col("a") * F.col("b")).cast("double").alias("m"))
    population, se = rt.chapman(F.col("n1"), F.col("n2"), F.col("m"))
    return rounded(s.withColumns({"population": population, "se": se}), "population", "se")


CELLS = ("001", "010", "011", "100", "101", "110", "111")
CELLS_SQL = ", ".join(f"count(*) FILTER (a = {x[0]} AND b = {x[1]} AND c = {x[2]}) AS n_{x}" for x in CELLS)


@bound("loglinear3_cells", f"WITH {LISTS_SQL} SELECT {CELLS_SQL} FROM l")
def loglinear3_cells(t):
    return rt.history_counts(lists(t), ["a", "b", "c"])


@bound("loglinear3")
def loglinear3(t):
    """Saturated and independence estimates of the unseen, with the likelihood-ratio test; no SQL, as a fit iterates (tests check it against other fits)."""
    cells = rt.history_counts(lists(t), ["a", "b", "c"])
    n = {k.removeprefix("n_"): v for k, v in cells.first().asDict().items()}
    fit = independence(n)
    return rt.three_list_saturated(cells).withColumns({"unseen_independent": F.lit(fit["unseen"]), "lr": F.lit(fit["lr"]), "p_value": F.lit(fit["lr_p"])})


@bound("residual_ratio", "WITH d AS (SELECT c_custkey, count(o_orderkey) AS y, any_value(c_mktsegment) AS g FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey), e AS (SELECT *, avg(y) OVER (PARTITION BY g) AS mu FROM d) SELECT c_custkey, y, round((1 / 0.5 + y) / (1 / (0.5 * mu) + 1) / mu, 6) AS ratio FROM e")
def residual_ratio(t):
    per = rt.group_counts(t.orders, "o_custkey", "y").withColumnRenamed("o_custkey", "c_custkey")
    d = t.customer.select("c_custkey", "c_mktsegment").join(per, "c_custkey", "left").fillna(0, ["y"])
    mu = d.groupBy("c_mktsegment").agg(F.avg("y").alias("mu"))
    return rounded(d.join(mu, "c_mktsegment").select("c_custkey", "y", rt.residual_ratio(F.col("y"), F.col("mu"), 0.5).alias("ratio")), "ratio")


def area_table(t):
    """Areas (nation by segment) with counts, exposure and a covariate."""
    per = rt.group_counts(t.orders, "o_custkey", "orders").withColumnRenamed("o_custkey", "c_custkey")
    c = t.customer.join(per, "c_custkey", "left").fillna(0, ["orders"])
    areas = c.groupBy("c_nationkey", "c_mktsegment").agg(F.sum("orders").cast("double").alias("y"), F.count("*").cast("double").alias("n"), (F.avg("c_acctbal") / 1000).alias("x"))
    return areas.join(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("g")), "c_nationkey").withColumn("area", F.concat_ws("|", F.col("c_nationkey").cast("string"), "c_mktsegment"))


@bound("nb_glm")
def nb_glm(t):
    return regress.nb_regression(area_table(t), "y", ["x"], "n", "g")


@bound("nb_loso")
def nb_loso(t):
    return regress.nb_leave_group_out(area_table(t), "area", "y", ["x"], "n", "g")


@bound("mixed_reml")
def mixed_reml(t):
    return regress.random_intercept_reml(area_table(t).withColumn("rate", F.col("y") / F.col("n")), "rate", "x", "g")


@bound("holdout_split", "SELECT c_custkey, md5(c_custkey || ':42') < '33333333' AS held_out FROM customer")
def holdout_split(t):
    return regress.holdout(t.customer.select("c_custkey"), "c_custkey")


# Points: the first two coordinates of the vectors, as degrees about 40 north.

POINTS_SQL = "pt AS (SELECT vec_id, 40 + CAST(embedding[1] AS DOUBLE) AS lat, CAST(embedding[2] AS DOUBLE) AS lon FROM embeddings)"


def points(t):
    return t.embeddings.select("vec_id", (40 + F.col("embedding")[0].cast("double")).alias("lat"), F.col("embedding")[1].cast("double").alias("lon"))


def sides(t):
    p = points(t)
    return [p.select(F.col("vec_id").alias(f"{s}_id"), F.col("lat").alias(f"{s}_lat"), F.col("lon").alias(f"{s}_lon")) for s in "ab"]


HAVERSINE = "2 * 6371000 * asin(sqrt(least(1, power(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2))))"


@bound("distance_join", f"WITH {POINTS_SQL} SELECT a.vec_id AS a_id, b.vec_id AS b_id, round({HAVERSINE}, 3) AS distance_m FROM pt a JOIN pt b ON a.vec_id < b.vec_id AND abs(a.lat - b.lat) < 0.02 AND {HAVERSINE} <= 1000")
def distance_join(t):
    a, b = sides(t)
    return rounded(spatial.distance_join(a, b, 1000.0).filter("a_id < b_id").select("a_id", "b_id", "distance_m"), "distance_m", digits=3)





@bound("point_in_polygon", f"WITH {POINTS_SQL} SELECT vec_id AS point_id, CASE WHEN lon > -0.1 AND lon < 0.1 AND lat > 39.9 AND lat < 40.1 THEN 'core' WHEN lon > 0.1 AND lon < 0.5 AND lat > 39.9 AND lat < 40.1 THEN 'east' ELSE 'none' END AS area_id FROM pt")
def point_in_polygon(t):
    boxes = t.nation.sparkSession.createDataFrame([("core", [-0.1, 0.1, 0.1, -0.1], [39.9, 39.9, 40.1, 40.1]), ("east", [0.1, 0.5, 0.5, 0.1], [39.9, 39.9, 40.1, 40.1])], "area_id string, xs array<double>, ys array<double>")
    p = points(t).select(F.col("vec_id").alias("point_id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    return spatial.points_in_polygons(p, boxes, 0.1).select("point_id", F.coalesce("area_id", F.lit("none")).alias("area_id"))


# Nations as areas: neighbours in the ring of keys, or of one region.

EDGES_SQL = "e0 AS (SELECT a.n_nationkey AS src, b.n_nationkey AS dst FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND (b.n_nationkey - a.n_nationkey = 1 OR a.n_regionkey = b.n_regionkey)), e AS (SELECT * FROM e0 UNION SELECT dst, src FROM e0)"


def nation_edges(t):
    a = t.nation.select(F.col("n_nationkey").alias("src"), "n_regionkey")
    region = a.join(t.nation.select(F.col("n_nationkey").alias("dst"), "n_regionkey"), "n_regionkey").filter("src < dst").select("src", "dst")
    ring = t.nation.select(F.col("n_nationkey").alias("src"), (F.col("n_nationkey") + 1).alias("dst")).join(t.nation.select(F.col("n_nationkey").alias("dst")), "dst", "left_semi").select("src", "dst")
    return region.union(ring).distinct()


def nation_values(t):
    return nation_units(t).select(F.col("n_nationkey").alias("node"), F.try_divide("suppliers", "customers").alias("v"))


VALUES_SQL = f"{UNITS_SQL}, v AS (SELECT n_nationkey AS node, suppliers / CAST(customers AS DOUBLE) AS v FROM units)"


@bound("contiguity", f"WITH {EDGES_SQL} SELECT src, count(*) AS neighbours FROM e GROUP BY src")
def contiguity(t):
    return graphs.undirected(nation_edges(t)).groupBy("src").agg(F.count("*").alias("neighbours"))


@bound("queen_contiguity", "WITH c AS (SELECT n_nationkey AS k, n_nationkey % 5 AS x, n_nationkey // 5 AS y FROM nation) SELECT a.k AS src, b.k AS dst FROM c a JOIN c b ON a.k < b.k AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1")
def queen_contiguity(t):
    k = F.col("n_nationkey")
    corner = F.explode(F.array(*[F.struct((k % 5 + dx).cast("double").alias("x"), (F.floor(k / 5) + dy).cast("double").alias("y")) for dx in (0, 1) for dy in (0, 1)]))
    return graphs.shared_vertex_edges(t.nation.select(k.alias("k"), corner.alias("c")).select("k", "c.x", "c.y"), "k")


@bound("islands", f"WITH {EDGES_SQL} SELECT n_nationkey AS node FROM nation WHERE n_nationkey NOT IN (SELECT src FROM e WHERE dst % 7 <> 0 AND src % 7 <> 0)")
def islands(t):
    kept = graphs.undirected(nation_edges(t)).filter("src % 7 <> 0 AND dst % 7 <> 0")
    return graphs.islands(t.nation.select(F.col("n_nationkey").alias("node")), kept)


@bound("neighbor_avg", f"WITH {VALUES_SQL}, {EDGES_SQL}, m AS (SELECT src, avg(v) AS m FROM e JOIN v ON node = dst GROUP BY src) SELECT node, round(v, 6) AS v, round(m, 6) AS near FROM v LEFT JOIN m ON src = node")
def neighbor_avg(t):
    return rounded(graphs.neighbour_mean(nation_values(t), nation_edges(t), "v", "near"), "v", "near")


@bound("moran", f"WITH {VALUES_SQL}, {EDGES_SQL}, z AS (SELECT node, v - (SELECT avg(v) FROM v) AS z FROM v), w AS (SELECT src, dst, 1.0 / count(*) OVER (PARTITION BY src) AS w FROM e) SELECT (SELECT count(*) FROM v) AS n, round((SELECT count(*) FROM v) / sum(w) * sum(w * a.z * b.z) / (SELECT sum(z * z) FROM z), 6) AS statistic FROM w JOIN z a ON a.node = src JOIN z b ON b.node = dst")
def moran(t):
    return rounded(spatial.moran(nation_values(t), nation_edges(t), "v").select("n", "statistic"), "statistic")


MORAN_SQL = f"""{VALUES_SQL}, {EDGES_SQL}, z AS (SELECT node, v - (SELECT avg(v) FROM v) AS z FROM v), w AS (SELECT src, dst, 1.0 / count(*) OVER (PARTITION BY src) AS w FROM e),
m AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(z * z) AS low, sum(z * z * z * z) AS fourth FROM z), s0 AS (SELECT sum(w) AS s0, sum(w * a.z * b.z) AS top FROM w JOIN z a ON a.node = src JOIN z b ON b.node = dst),
s1 AS (SELECT sum(power(a.w + b.w, 2)) / 2 AS s1 FROM w a JOIN w b ON a.src = b.dst AND a.dst = b.src), s2 AS (SELECT sum(power(o + i, 2)) AS s2 FROM (SELECT src, sum(w) AS o FROM w GROUP BY src) JOIN (SELECT dst, sum(w) AS i FROM w GROUP BY dst) ON src = dst),
r AS (SELECT *, n / s0 * top / low AS statistic, -1 / (n - 1) AS expected, n * fourth / (low * low) AS peak FROM m, s0, s1, s2),
q AS (SELECT *, (n * n * s1 - n * s2 + 3 * s0 * s0) / (s0 * s0 * (n * n - 1)) - expected * expected AS variance,
 (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0) - peak * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0)) / ((n - 1) * (n - 2) * (n - 3) * s0 * s0) - expected * expected AS variance_random FROM r)"""


@bound(
    "moran_z",
    f"WITH {MORAN_SQL} SELECT CAST(n AS BIGINT) AS n, round(statistic, 6) AS statistic, round(expected, 6) AS expected, round(variance, 8) AS variance, round(variance_random, 8) AS variance_random, round((statistic - expected) / sqrt(variance), 6) AS z, round((statistic - expected) / sqrt(variance_random), 6) AS z_random FROM q",
)
def moran_z(t):
    found = spatial.moran(nation_values(t), nation_edges(t), "v")
    return rounded(rounded(found, "statistic", "expected", "z", "z_random"), "variance", "variance_random", digits=8)


@bound("moran_perm")
def moran_perm(t):
    return spatial.moran_permutations(nation_values(t), nation_edges(t), "v")


GI_SQL = f"{VALUES_SQL}, {EDGES_SQL}, s AS (SELECT avg(v) AS m, stddev_pop(v) AS s, CAST(count(*) AS DOUBLE) AS n FROM v), x AS (SELECT src AS node, sum(v) AS x, CAST(count(*) AS DOUBLE) AS w FROM (SELECT src, dst FROM e UNION ALL SELECT node, node FROM v) JOIN v ON node = dst GROUP BY src), g AS (SELECT node, (x - m * w) / (s * sqrt((n * w - w * w) / (n - 1))) AS z FROM x, s)"


@bound("gi_star", f"WITH {GI_SQL} SELECT node, round(z, 6) AS z FROM g")
def gi_star(t):
    return rounded(spatial.gi_star(nation_values(t), nation_edges(t), "v").select("node", "z"), "z")


@bound("bh_fdr", f"WITH {GI_SQL}, p AS (SELECT node, exp(-abs(z)) AS p FROM g), r AS (SELECT node, p, row_number() OVER (ORDER BY p, node) AS rn, count(*) OVER () AS m FROM p) SELECT node, round(least(1.0, min(p * m / rn) OVER (ORDER BY rn DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM r")
def bh_fdr(t):
    p = spatial.gi_star(nation_values(t), nation_edges(t), "v").select("node", F.exp(-F.abs("z")).alias("p"))
    return rounded(rk.benjamini_hochberg(p, "p", "q").select("node", "q"), "q")


@bound("hotspot_classes")
def hotspot_classes(t):
    """Gi* with exact normal p-values, q-values and classes; tests check the normal distribution function."""
    g = spatial.gi_star(nation_values(t), nation_edges(t), "v").withColumn("p", spatial.two_sided("z"))
    q = rk.benjamini_hochberg(g, "p", "q")
    return q.withColumn("class", spatial.hot_or_cold(F.col("z"), F.col("q"), 0.25))


@bound("graph_components", f"WITH RECURSIVE {POINTS_SQL}, l AS (SELECT a.vec_id AS src, b.vec_id AS dst FROM pt a JOIN pt b ON a.vec_id <> b.vec_id AND abs(a.lat - b.lat) < 0.02 AND {HAVERSINE} <= 1000), c(node, root) AS (SELECT vec_id, vec_id FROM pt UNION SELECT l.dst, c.root FROM c JOIN l ON l.src = c.node WHERE l.dst > c.root) SELECT node, min(root) AS component FROM c GROUP BY node")
def graph_components(t):
    a, b = sides(t)
    near = spatial.distance_join(a, b, 1000.0).filter("a_id < b_id").select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"))
    return graphs.components(points(t).select(F.col("vec_id").alias("node")), near)


@bound("identity_components", "SELECT doc_id AS node, min(doc_id) OVER (PARTITION BY text) AS component FROM documents")
def identity_components(t):
    """Equal texts are one identity: edges from each copy to the first, then components."""
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("dst"))
    return graphs.components(d.select(F.col("doc_id").alias("node")), d.join(first, "h").select(F.col("doc_id").alias("src"), "dst").filter("src <> dst"))


NORMAL_SQL = rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({{0}}), '{tx.SUFFIXES}', '', 'g'), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@bound("name_normalise", f"SELECT p_partkey, {NORMAL_SQL.format('p_name')} AS clean, {NORMAL_SQL.format('p_brand')} AS brand FROM part")
def name_normalise(t):
    return t.part.select("p_partkey", tx.normal_name(F.col("p_name")).alias("clean"), tx.normal_name(F.col("p_brand")).alias("brand"))


def half(t, side, rest):
    """The parts with an even (0) or odd (1) key, each a record, placed by its number; brands are blocks, parts without one are a block too."""
    k = F.col("p_partkey")
    lat, lon = 40 + (k % 7) * 0.001, (k % 5) * 0.001
    p = t.part.filter(F.pmod(k, F.lit(2)) == rest)
    return p.select(k.alias(f"{side}_id"), F.coalesce("p_name", F.lit("")).alias(f"{side}_name"), lat.alias(f"{side}_lat"), lon.alias(f"{side}_lon"), F.coalesce("p_brand", F.lit("")).alias("block"))


def halves(t):
    return half(t, "a", 0), half(t, "b", 1)


#: Ids of one block and name that stand in one array.
PIECE = 512


def pieces(side, x):
    """The ids {x}_ids of each block and name, in arrays of about PIECE."""
    named = ["block", f"{x}_name"]
    of = side.groupBy(*named).agg(F.ceil(F.count("*") / PIECE).alias("_of"))
    return side.join(of, named).groupBy(*named, F.pmod(F.xxhash64(f"{x}_id"), F.col("_of")).alias("_piece")).agg(F.collect_list(f"{x}_id").alias(f"{x}_ids")).drop("_piece")


@bound("name_similarity")
def name_similarity(t):
    """Scores of all pairs of a block; equal names are scored once, and ids are paired as arrays, which are unfolded last."""
    a, b = halves(t)
    names = a.select("block", "a_name").distinct().join(b.select("block", "b_name").distinct(), "block")
    scored = names.withColumn("score", linkage.name_score(tx.name_variants(F.col("a_name")), tx.name_variants(F.col("b_name"))))
    both = scored.join(pieces(a, "a"), ["block", "a_name"]).join(pieces(b, "b"), ["block", "b_name"])
    # few rows here are many below, so that sizes would put them in too few tasks
    both = both.repartition(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block", "a_name", "b_name", F.col("a_ids")[0], F.col("b_ids")[0])
    return both.select(F.explode("a_ids").alias("a_id"), "b_ids", "score").select("a_id", F.explode("b_ids").alias("b_id"), "score")


@bound("match_optimal")
def match_optimal(t):
    a, b = halves(t)
    return linkage.match_records(a, b, by=("block",))


@bound("match_staged")
def match_staged(t):
    a, b = halves(t)
    return linkage.match_staged(a, b, by=("block",))


@bound("match_greedy")
def match_greedy(t):
    a, b = halves(t)
    return linkage.match_in_blocks(a, b, "block")


@bound("self_dedup")
def self_dedup(t):
    p = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (40 + (F.col("p_partkey") % 97) * 0.0002).alias("lat"), (F.col("p_partkey") % 89 * 0.0002).alias("lon"))
    return linkage.drop_near_twins(p).select("id", "name")


@bound("bym2_scale")
def bym2_scale(t):
    import numpy as np

    rows = graphs.undirected(nation_edges(t)).collect()
    n = t.nation.count()
    scale = bayes.scaling_factor(bayes.laplacian(n, np.array([(r[0], r[1]) for r in rows])))
    return t.nation.agg(F.count("*").alias("units")).withColumn("scale", F.lit(scale))


@bound("icar_grid")
def icar_grid(t):
    u = nation_units(t).filter("customers > 0").select(F.col("n_nationkey").alias("node"), "orders", "customers")
    return bayes.spatial_rates(u, nation_edges(t), "orders", "customers", kind="icar")


@bound("bym2_grid")
def bym2_grid(t):
    u = nation_units(t).filter("customers > 0").select(F.col("n_nationkey").alias("node"), "orders", "customers", "suppliers")
    return bayes.spatial_rates(u, nation_edges(t), "orders", "customers", ["suppliers"])


ALBERS_LOWER = spatial.albers_sql("(lon - 96)", "lat")


@bound("albers_projection", f"WITH {POINTS_SQL} SELECT vec_id, round({ALBERS_LOWER[0]}, 3) AS x, round({ALBERS_LOWER[1]}, 3) AS y FROM pt")
def albers_projection(t):
    x, y = spatial.albers(F.col("lon") - 96, F.col("lat"))
    return points(t).select("vec_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))
