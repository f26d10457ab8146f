"""Reports: deserts in two views with their robustness and profile, clusters of hot and cold areas, and smaller cleaning steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratefield.operators import graphs, spatial
from ratefield.operators import ranking as rk
from ratefield.operators import rates as rt
from ratefield.operators import tables as tb
from ratefield.plans.products import AREAS_SQL
from ratefield.plans.relational import PRIOR_SQL, rounded
from ratefield.plans.statistical import GI_SQL, area_table, nation_edges, nation_values
from ratefield.plans.tables import Tables
from ratefield.session import ensure_checkpoint_dir, scratch_dir
from ratefield.sources.readers import header_row
from ratefield.sources.sinks import write_csv

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def bound(name: str, sql: str):
    """Register a query that takes Tables, and its SQL."""

    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        ORACLES[name] = sql
        return f

    return keep


# Deserts: large areas of the lowest shrunken rates. Areas under the floor of exposure count for shrinkage and the overall rank alone.

SHARE_OF_MEAN, LARGEST, BOTTOM = 0.9, 40, 20
DESERT_SQL = f"""{AREAS_SQL}, h AS (SELECT concat_ws('|', c_nationkey, c_mktsegment) AS area, c_nationkey, CAST(orders AS DOUBLE) AS y, CAST(customers AS DOUBLE) AS n FROM a), d AS (SELECT y, n FROM h), {PRIOR_SQL},
z AS (SELECT h.*, (shape + y) / (rate + n) * 100000 AS shrunken, y / n * 100000 AS raw FROM h, prior), o AS (SELECT *, rank() OVER (ORDER BY round(shrunken, 6)) AS national_rank FROM z),
f AS (SELECT *, rank() OVER (ORDER BY round(shrunken, 6)) AS desert_rank, rank() OVER (ORDER BY round(raw, 6)) AS raw_rank, row_number() OVER (ORDER BY n DESC, area) <= {LARGEST} AS largest FROM o WHERE n >= (SELECT {SHARE_OF_MEAN} * avg(n) FROM h))"""


def desert_universe(t) -> DataFrame:
    """Areas over the floor with their rank among these and among all, by shrunken and by raw rate (lowest first)."""
    a = area_table(t).select("area", "c_nationkey", "x", "y", "n")
    mean = a.agg(F.avg("n")).first()[0] or 0.0
    # rates are rounded, so that sums in another order don't part ties
    s = rt.shrink(a, "y", "n", interval=False).withColumns({"shrunken": F.round("shrunken_rate", 6), "raw": F.round(tb.rate_per(F.col("y"), F.col("n")), 6)})
    ensure_checkpoint_dir(a.sparkSession)
    ranked = rk.exact_rank(s.checkpoint(), "shrunken", "national_rank").filter(F.col("n") >= SHARE_OF_MEAN * mean).checkpoint()
    ranked = rk.exact_rank(rk.exact_rank(ranked, "shrunken", "desert_rank").checkpoint(), "raw", "raw_rank").checkpoint()
    top = rk.top(ranked, LARGEST, F.desc("n"), "area").select("area").withColumn("largest", F.lit(True))
    return ranked.join(F.broadcast(top), "area", "left").withColumn("largest", F.coalesce("largest", F.lit(False)))


@bound("desert_report", f"WITH {DESERT_SQL} SELECT area, CAST(n AS BIGINT) AS customers, round(shrunken, 4) AS shrunken_rate, desert_rank, national_rank, largest, printf('rank %d of %d: %d orders among %d customers', desert_rank, (SELECT count(*) FROM f), CAST(y AS BIGINT), CAST(n AS BIGINT)) AS note FROM f")
def desert_report(t):
    """All areas over the floor, the lowest first, with a note; `largest` marks the view of the most populous ones."""
    u = desert_universe(t)
    both = u.crossJoin(F.broadcast(u.agg(F.count("*").alias("of"))))
    note = F.format_string("rank %d of %d: %d orders among %d customers", "desert_rank", "of", F.col("y").cast("long"), F.col("n").cast("long"))
    return both.select("area", F.col("n").cast("long").alias("customers"), F.round("shrunken_rate", 4).alias("shrunken_rate"), "desert_rank", "national_rank", "largest", note.alias("note"))


@bound(
    "desert_robustness",
    f"""WITH {DESERT_SQL}, r AS (SELECT rank() OVER (ORDER BY desert_rank) + (count(*) OVER (PARTITION BY desert_rank) - 1) / 2.0 AS x, rank() OVER (ORDER BY raw_rank) + (count(*) OVER (PARTITION BY raw_rank) - 1) / 2.0 AS y FROM f)
SELECT (SELECT count(*) FROM f) AS areas, round((SELECT corr(x, y) FROM r), 6) AS rho, (SELECT count(*) FROM f WHERE desert_rank <= {BOTTOM} AND raw_rank <= {BOTTOM}) AS both_lists, (SELECT count(*) FROM f WHERE desert_rank <= {BOTTOM} AND raw_rank > {BOTTOM}) AS shrunken_only""",
)
def desert_robustness(t):
    """How far the lists by shrunken and by raw rate agree."""
    u = desert_universe(t)
    low, raw = F.col("desert_rank") <= BOTTOM, F.col("raw_rank") <= BOTTOM
    counts = u.agg(F.count_if(low & raw).alias("both_lists"), F.count_if(low & ~raw).alias("shrunken_only"))
    return rk.spearman(u.select("desert_rank", "raw_rank"), "desert_rank", "raw_rank").crossJoin(F.broadcast(counts)).select(F.col("n").alias("areas"), F.round("rho", 6).alias("rho"), "both_lists", "shrunken_only")


@bound(
    "desert_profile",
    f"""WITH {DESERT_SQL}, x AS (SELECT concat_ws('|', c_nationkey, c_mktsegment) AS area, avg(c_acctbal) / 1000 AS x FROM customer GROUP BY 1), g AS (SELECT f.*, x, n_regionkey FROM f JOIN x ON f.area = x.area JOIN nation ON n_nationkey = c_nationkey)
SELECT universe, n_regionkey, count(*) AS areas, round(avg(n), 6) AS customers, round(avg(x), 6) AS balance FROM (SELECT 'all' AS universe, * FROM g UNION ALL SELECT 'deserts', * FROM g WHERE desert_rank <= {BOTTOM}) GROUP BY universe, n_regionkey""",
)
def desert_profile(t):
    """Areas and covariate means by region: deserts beside all."""
    g = desert_universe(t).join(F.broadcast(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")), "c_nationkey")
    sides = F.when(F.col("desert_rank") <= BOTTOM, F.array(F.lit("all"), F.lit("deserts"))).otherwise(F.array(F.lit("all")))
    by = g.withColumn("universe", F.explode(sides)).groupBy("universe", "n_regionkey").agg(F.count("*").alias("areas"), F.avg("n").alias("customers"), F.avg("x").alias("balance"))
    return rounded(by, "customers", "balance")


# Hot and cold areas: contiguous clusters of one class, and how far two measures agree on classes.


def flagged(values: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, class): beyond one deviation of Gi*; a stand-in for significance that SQL has too."""
    z = F.col("z")
    return spatial.gi_star(values, edges, "v").select("node", F.when(z > 1, "hot").when(z < -1, "cold").otherwise("neither").alias("class"))


def clusters(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, class, cluster, size): components of contiguity among units of one class; "neither" has none."""
    marked = classes.filter("class <> 'neither'")
    near = graphs.undirected(edges).join(marked.select(F.col("node").alias("src"), F.col("class").alias("a")), "src").join(marked.select(F.col("node").alias("dst"), F.col("class").alias("b")), "dst").filter("a = b")
    found = graphs.components(marked.select("node"), near.select("src", "dst")).join(marked, "node")
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    return found.join(sizes, "component").select("node", "class", F.col("component").alias("cluster"), "size")


_CLASS = "CASE WHEN z > 1 THEN 'hot' WHEN z < -1 THEN 'cold' ELSE 'neither' END"


@bound(
    "hotspot_clusters",
    f"WITH RECURSIVE {GI_SQL}, c AS (SELECT node, {_CLASS} AS class FROM g), l AS (SELECT src, dst FROM e JOIN c a ON a.node = src JOIN c b ON b.node = dst WHERE a.class = b.class AND a.class <> 'neither'), r(node, root) AS (SELECT node, node FROM c WHERE class <> 'neither' UNION SELECT r.node, l.dst FROM r JOIN l ON l.src = r.root), k AS (SELECT node, min(root) AS cluster FROM r GROUP BY node) SELECT k.node, class, cluster, count(*) OVER (PARTITION BY cluster) AS size FROM k JOIN c ON c.node = k.node",
)
def hotspot_clusters(t):
    return clusters(flagged(nation_values(t), nation_edges(t)), nation_edges(t))


_OTHER = GI_SQL.replace("suppliers / CAST(customers AS DOUBLE) AS v", "orders / CAST(customers AS DOUBLE) AS v")


@bound(
    "hotspot_agreement",
    f"WITH one AS (WITH {GI_SQL} SELECT node, {_CLASS} AS a FROM g), two AS (WITH {_OTHER} SELECT node, {_CLASS} AS b FROM g) SELECT a AS by_suppliers, b AS by_orders, count(*) AS units, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM one JOIN two USING (node) GROUP BY a, b",
)
def hotspot_agreement(t):
    """Classes by two measures, crossed."""
    orders = rt.group_counts(t.orders, "o_custkey", "n").withColumnRenamed("o_custkey", "c_custkey")
    by = t.customer.join(orders, "c_custkey", "left").groupBy("c_nationkey").agg(F.sum(F.coalesce("n", F.lit(0))).alias("orders"), F.count("*").alias("customers"))
    second = t.nation.select(F.col("n_nationkey").alias("node")).join(by, F.col("node") == F.col("c_nationkey"), "left").select("node", F.try_divide("orders", "customers").alias("v"))
    both = flagged(nation_values(t), nation_edges(t)).withColumnRenamed("class", "by_suppliers").join(flagged(second, nation_edges(t)).withColumnRenamed("class", "by_orders"), "node")
    cells = both.groupBy("by_suppliers", "by_orders").agg(F.count("*").alias("units"))
    return cells.crossJoin(F.broadcast(cells.agg(F.sum("units").alias("of")))).select("by_suppliers", "by_orders", "units", F.round(F.col("units") / F.col("of"), 6).alias("share"))


# Cleaning steps.


@bound(
    "missing_codes",
    "WITH c AS (SELECT p_partkey, CASE WHEN p_size IN (1, 50) THEN NULL ELSE p_size END AS size, CASE WHEN p_brand = 'Brand#1' THEN NULL ELSE p_brand END AS brand FROM part) SELECT p_partkey, coalesce(size, -1) AS size, size IS NULL OR brand IS NULL AS incomplete, CASE WHEN size IS NOT NULL THEN round(ln(greatest(size, 5)), 6) END AS log_size FROM c WHERE brand IS NULL OR brand = 'Brand#2'",
)
def missing_codes(t):
    """Codes for missing values become missing; confirmed mismatches go, missing ones stay; sizes are clipped from below before the log."""
    c = t.part.select("p_partkey", tb.sentinel_to_null(F.col("p_size"), 1, 50).alias("size"), tb.sentinel_to_null(F.col("p_brand"), "Brand#1").alias("brand"))
    kept = c.filter(tb.keep_unless_known(F.col("brand"), "Brand#2"))
    return kept.select("p_partkey", F.coalesce("size", F.lit(-1)).alias("size"), tb.any_null(F.col("size"), F.col("brand")).alias("incomplete"), F.round(tb.lower_clipped_log(F.col("size"), 5.0), 6).alias("log_size"))


@bound("sheet_rows", "SELECT s_suppkey, s_name FROM supplier")
def sheet_rows(t):
    """A sheet whose header stands below a preface, written as CSV and read back; the header is found by its first cell."""
    spark = t.supplier.sparkSession
    place = scratch_dir(spark, "sheet")
    body = t.supplier.select((F.col("s_suppkey") + 4).alias("n"), F.col("s_suppkey").cast("string").alias("c0"), F.col("s_name").alias("c1"))
    preface = spark.createDataFrame([(0, "Roster", None), (1, "as of today", None), (2, "License", "Name")], "n long, c0 string, c1 string")
    write_csv(preface.unionByName(body).withColumn("nested", F.array("c0")), place)
    sheet = spark.read.option("header", "true").schema("n long, c0 string, c1 string").csv(place)
    return header_row(sheet, "License", ["s_suppkey", "s_name"]).select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name")
