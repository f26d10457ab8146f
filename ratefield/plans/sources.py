"""Declared sources and area datasets over the driver's tables: what a registry would deliver is derived from a table, read back and checked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratefield.operators.areas import AreaDataset, Leg, national
from ratefield.operators.lists import identities, paired, report
from ratefield.plans.statistical import POINTS_SQL, points
from ratefield.plans.tables import Tables
from ratefield.session import scratch_dir
from ratefield.sources.readers import anchored_lines
from ratefield.sources.specs import Source, best_attempt

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def bound(name: str, sql: str):
    """Register a query that takes Tables, and its SQL."""

    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        ORACLES[name] = sql
        return f

    return keep


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

#: Point registry as CSV: typos repaired, inclusion rule, closed vocabulary, repeats.
CUSTOMERS = Source(
    "customers", "csv", "c_custkey long, c_name string, c_nationkey int, c_acctbal double, segment string", rename={"segment": "c_mktsegment"},
    steps=[
        ("replace", "c_mktsegment", {"BULDING": "BUILDING"}),
        ("known", "c_mktsegment", SEGMENTS),
        ("complete", "c_nationkey"),
        ("keep", "solvent", "c_acctbal >= 0"),
        ("keep", "not household", "c_mktsegment <> 'HOUSEHOLD'"),
        ("first", "one record a customer", ["c_custkey"], ["c_acctbal desc"]),
    ],
)


@bound(
    "source_customers",
    """WITH c AS (SELECT * FROM customer), n AS (SELECT count(*) + count(*) FILTER (c_custkey % 10 = 0) AS n0, count(*) FILTER (c_acctbal >= 0) + count(*) FILTER (c_custkey % 10 = 0 AND c_acctbal >= 1) AS n1,
 count(*) FILTER (c_acctbal >= 0 AND c_mktsegment <> 'HOUSEHOLD') + count(*) FILTER (c_custkey % 10 = 0 AND c_acctbal >= 1 AND c_mktsegment <> 'HOUSEHOLD') AS n2, count(*) FILTER (c_acctbal >= 0 AND c_mktsegment <> 'HOUSEHOLD') AS n3 FROM c)
SELECT 'fetch' AS event, 0 AS position, 'rows read' AS step, n0 AS before, n0 AS after, 0 AS dropped FROM n UNION ALL SELECT 'filter', 1, 'solvent', n0, n1, n0 - n1 FROM n UNION ALL SELECT 'filter', 2, 'not household', n1, n2, n1 - n2 FROM n
UNION ALL SELECT 'dedup', 3, 'one record a customer', n2, n3, n2 - n3 FROM n""",
)
def source_customers(t):
    """The audit of a registry that spells a word in two ways and repeats every tenth record with a lower balance."""
    c = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", F.when((F.col("c_mktsegment") == "BUILDING") & (F.col("c_custkey") % 3 == 0), "BULDING").otherwise(F.col("c_mktsegment")).alias("segment"))
    again = c.filter("c_custkey % 10 = 0").withColumn("c_acctbal", F.col("c_acctbal") - 1)
    spark = c.sparkSession
    raw = scratch_dir(spark, "customers")
    c.unionByName(again).write.option("header", "true").csv(f"{raw}/raw")
    _, events = CUSTOMERS.load(spark, f"{raw}/raw").save(f"{raw}/rows")
    return events.select("event", "position", "step", "before", "after", "dropped")


#: Pages of a JSON grid: each states its total; rows without a type go, a repeated id counts once.
GRID = Source(
    "grid", "json", "Total int, Data array<struct<event_id:bigint,event_type:string,value:double>>",
    steps=[("agree", "the stated total is the number of rows", "size(Data) = Total"), ("explode", "rows of pages", "Data"), ("keep", "type is there", "trim(event_type) <> ''"), ("first", "one row an event", ["event_id"], ["value"]), ("select", ["event_id", "event_type", "value"])],
)


@bound("source_grid", "SELECT event_id, event_type, value FROM events WHERE event_type <> 'error'")
def source_grid(t):
    """Events as pages of a grid, a page for each user; errors come without a type."""
    e = t.events.withColumn("kind", F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type")))
    # an id or a page may be of many rows: pages are cut to a thousand at most
    page = e.groupBy("user_id", F.floor(F.col("event_id") / 1000).alias("part")).agg(F.collect_list(F.struct("event_id", F.col("kind").alias("event_type"), "value")).alias("Data"))
    raw = scratch_dir(e.sparkSession, "grid")
    page.select(F.size("Data").alias("Total"), "Data").write.json(f"{raw}/raw")
    return GRID.load(e.sparkSession, f"{raw}/raw").save(f"{raw}/rows")[0]


#: Licences: primary types, and others by name; of companions at one place the one of the first type counts.
LICENCES = Source(
    "licences", "csv", "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    steps=[
        ("derive", {"primary": "p_type in ('SMALL', 'MEDIUM')", "named": "contains(upper(p_name), 'RING')"}),
        ("keep", "primary type, or named so", "primary or (p_type = 'PROMO' and named)"),
        ("derive", {"place": "concat_ws('|', upper(trim(p_name)), p_brand, cast(p_size as string))", "priority": "case p_type when 'SMALL' then 0 when 'MEDIUM' then 1 else 2 end"}),
        ("first", "one licence a place", ["place"], ["priority", "p_partkey"]),
        ("keep", "in the state", "p_brand <> 'Brand#9'"),
        ("complete", "p_brand"),
        ("select", ["p_partkey", "place", "priority"]),
    ],
)


@bound(
    "source_licences",
    """WITH k AS (SELECT *, concat_ws('|', upper(trim(p_name)), p_brand, CAST(p_size AS VARCHAR)) AS place, CASE p_type WHEN 'SMALL' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END AS priority FROM part WHERE p_type IN ('SMALL', 'MEDIUM') OR (p_type = 'PROMO' AND contains(upper(p_name), 'RING')))
SELECT p_partkey, place, CAST(priority AS INT) AS priority FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY priority, p_partkey) AS rn FROM k) WHERE rn = 1 AND p_brand <> 'Brand#9'""",
)
def source_licences(t):
    """Of two downloads the truncated one is passed over; a floor of rows guards the other."""
    spark = t.part.sparkSession
    raw = scratch_dir(spark, "licences")
    t.part.filter("p_partkey % 4 <> 3").write.option("header", "true").csv(f"{raw}/first")
    t.part.write.option("header", "true").csv(f"{raw}/second")
    path, _ = best_attempt(spark, LICENCES, [f"{raw}/first", f"{raw}/second"], least=200)
    return LICENCES.load(spark, path).save(f"{raw}/rows")[0]


@bound("source_roster", "SELECT s_suppkey, s_name, n_nationkey, n_name AS area FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def source_roster(t):
    """Suppliers from lines of text: an area's name in odd spelling is the anchor, name and key stand above it; the crosswalk gives the area's key."""
    s = t.supplier.join(F.broadcast(t.nation.select("n_nationkey", "n_name")), F.col("s_nationkey") == F.col("n_nationkey"))
    block = F.concat_ws("\n", "s_name", F.col("s_suppkey").cast("string"), F.concat(F.lit(" "), F.lower("n_name"), F.lit("  ")))
    page = F.floor(F.col("s_suppkey") / 500)
    texts = s.groupBy(page.alias("page")).agg(F.array_join(F.array_sort(F.collect_list(block)), "\n").alias("body"))
    spark = s.sparkSession
    raw = scratch_dir(spark, "roster")
    texts.write.json(f"{raw}/raw")
    names = t.nation.select("n_name", F.col("n_nationkey").alias("area_key"))
    words = [r[0].lower() for r in t.nation.select("n_name").collect()]
    roster = Source(
        "roster", "json", "page long, body string",
        steps=[
            ("change", "records of the text", lambda df: anchored_lines(df, "page", "body", lambda c: F.trim(c).startswith("nation"), {"s_name": -2, "key": -1})),
            ("derive", {"anchor": "trim(anchor)"}),
            ("known", "anchor", words),
            ("derive", {"n_name": "anchor"}),
            ("match", "areas", "n_name", "area_key"),
        ],
    )
    rows = roster.load(spark, f"{raw}/raw", {"areas": names}).save(f"{raw}/rows")[0]
    return rows.select(F.col("key").cast("long").alias("s_suppkey"), "s_name", F.col("area_key").alias("n_nationkey"), F.upper("n_name").alias("area"))


# Three lists of one population: clicks, views and purchases as records of what a user did in some hours or on a day.

LISTS_SQL = """r AS (SELECT event_id AS id, user_id, event_type AS l, floor(epoch(ts) / 14400) AS part, floor(epoch(ts) / 86400) AS day FROM events WHERE event_type IN ('click', 'view', 'purchase')),
o AS (SELECT *, row_number() OVER (PARTITION BY l, user_id, part ORDER BY id) AS np, row_number() OVER (PARTITION BY l, user_id, day ORDER BY id) AS nd FROM r),
m AS (SELECT a.id AS x, b.id AS y FROM o a JOIN o b ON a.l = 'click' AND b.l = 'view' AND a.user_id = b.user_id AND a.part = b.part AND a.np = b.np
 UNION SELECT a.id, b.id FROM o a JOIN o b ON a.l = 'click' AND b.l = 'purchase' AND a.user_id = b.user_id AND a.day = b.day AND a.nd = b.nd
 UNION SELECT a.id, b.id FROM o a JOIN o b ON a.l = 'view' AND b.l = 'purchase' AND a.user_id = b.user_id AND a.day = b.day AND a.nd = b.nd),
e AS (SELECT x, y FROM m UNION SELECT y, x FROM m), k(id, root) AS (SELECT id, id FROM r UNION SELECT k.id, e.y FROM k JOIN e ON e.x = k.root),
g AS (SELECT id, min(root) AS root FROM k GROUP BY id),
i AS (SELECT max(CASE WHEN l = 'click' THEN 1 ELSE 0 END) AS click, min(CASE WHEN l = 'click' THEN id END) AS click_id, count(*) FILTER (l = 'click') AS n_click,
 max(CASE WHEN l = 'view' THEN 1 ELSE 0 END) AS view, min(CASE WHEN l = 'view' THEN id END) AS view_id, count(*) FILTER (l = 'view') AS n_view,
 max(CASE WHEN l = 'purchase' THEN 1 ELSE 0 END) AS purchase, min(CASE WHEN l = 'purchase' THEN id END) AS purchase_id, count(*) FILTER (l = 'purchase') AS n_purchase FROM g JOIN r USING (id) GROUP BY root)"""
THREE = ["click", "view", "purchase"]


def event_lists(t) -> DataFrame:
    """Identities of the three lists: by hours for clicks and views, by day for the others, so that chains arise."""
    ts = F.col("ts").cast("timestamp").cast("double")
    e = t.events.select(F.col("event_id").alias("id"), "user_id", "event_type", F.floor(ts / 14400).alias("part"), F.floor(ts / 86400).alias("day"))
    click, view, purchase = (e.filter(F.col("event_type") == n) for n in THREE)
    matches = {("click", "view"): paired(click, view, ["user_id", "part"]), ("click", "purchase"): paired(click, purchase, ["user_id", "day"]), ("view", "purchase"): paired(view, purchase, ["user_id", "day"])}
    return identities({"click": click, "view": view, "purchase": purchase}, matches)


@bound("three_list_identities", f"WITH RECURSIVE {LISTS_SQL} SELECT click, coalesce(click_id, -1) AS click_id, n_click, view, coalesce(view_id, -1) AS view_id, n_view, purchase, coalesce(purchase_id, -1) AS purchase_id, n_purchase, n_click > 1 OR n_view > 1 OR n_purchase > 1 AS ambiguous FROM i")
def three_list_identities(t):
    return event_lists(t).fillna(-1, [f"{n}_id" for n in THREE])


@bound(
    "three_list_report",
    f"""WITH RECURSIVE {LISTS_SQL}, s AS (SELECT count(*) AS identities, count(*) FILTER (n_click > 1 OR n_view > 1 OR n_purchase > 1) AS ambiguous, CAST(sum(n_click) AS DOUBLE) AS ra, CAST(sum(n_view) AS DOUBLE) AS rb, CAST(sum(n_purchase) AS DOUBLE) AS rc,
 CAST(count(*) FILTER (click = 1 AND view = 1) AS DOUBLE) AS ab, CAST(count(*) FILTER (click = 1 AND purchase = 1) AS DOUBLE) AS ac, CAST(count(*) FILTER (view = 1 AND purchase = 1) AS DOUBLE) AS bc, CAST(count(*) FILTER (click = 1 AND view = 1 AND purchase = 1) AS DOUBLE) AS n7,
 CAST(count(*) FILTER (click = 1 AND view = 1 AND purchase = 0) AS DOUBLE) AS n6, CAST(count(*) FILTER (click = 1 AND view = 0 AND purchase = 1) AS DOUBLE) AS n5, CAST(count(*) FILTER (click = 0 AND view = 1 AND purchase = 1) AS DOUBLE) AS n3,
 CAST(count(*) FILTER (click = 1 AND view = 0 AND purchase = 0) AS DOUBLE) AS n4, CAST(count(*) FILTER (click = 0 AND view = 1 AND purchase = 0) AS DOUBLE) AS n2, CAST(count(*) FILTER (click = 0 AND view = 0 AND purchase = 1) AS DOUBLE) AS n1 FROM i)
SELECT identities, ambiguous, CAST(ab AS BIGINT) AS both_click_view, round((ra + 1) * (rb + 1) / (ab + 1) - 1, 4) AS chapman_click_view, round((ra + 1) * (rc + 1) / (ac + 1) - 1, 4) AS chapman_click_purchase, round((rb + 1) * (rc + 1) / (bc + 1) - 1, 4) AS chapman_view_purchase,
 round(identities + n7 * n4 * n2 * n1 / (n6 * n5 * n3), 4) AS saturated, round(ln(n6 * (n7 * n4 * n2 * n1 / (n6 * n5 * n3)) / (n4 * n2)), 6) AS term_click_view FROM s""",
)
def three_list_report(t):
    found = report(event_lists(t), THREE, truth=10_000.0)
    digits = {"chapman_click_view": 4, "chapman_click_purchase": 4, "chapman_view_purchase": 4, "saturated": 4, "term_click_view": 6}
    return found.select("identities", "ambiguous", "both_click_view", *[F.round(c, d).alias(c) for c, d in digits.items()])


# Area datasets. The driver's nations stand for areas, customers for the exposed.


def exposures(t) -> DataFrame:
    return t.nation.join(t.customer.groupBy("c_nationkey").agg(F.count("*").alias("customers")), F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_nationkey", "n_name", "n_regionkey", F.coalesce("customers", F.lit(0)).cast("long").alias("customers"))


def area_tables(t) -> dict[str, DataFrame]:
    placed = t.orders.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.count_if(F.col("o_totalprice") > 300_000).alias("large")).join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment"), "o_custkey")
    return {"areas": exposures(t), "orders": placed, "suppliers": t.supplier, "roster": t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).withColumn("label", F.concat(F.lit("  "), F.lower("n_name"), F.lit(" ")))}


ORDERS, LARGE = Leg("orders", "orders", "c_nationkey", value="orders"), Leg("large", "orders", "c_nationkey", value="large", where="large > 1", zero=False)
BY_KEY = AreaDataset("by_key", "areas", "n_nationkey", "customers", [ORDERS, LARGE, Leg("suppliers", "suppliers", "s_nationkey")], "orders", ["n_regionkey"], benchmark=20_000.0, floor=50.0)
BY_NAME = AreaDataset("by_name", "areas", "n_nationkey", "customers", [ORDERS, Leg("suppliers", "roster", "label", via="crosswalk")], "suppliers", benchmark=90.0)
SENSITIVE = AreaDataset("sensitive", "areas", "n_nationkey", "customers", [ORDERS, Leg("primary_orders", "orders", "c_nationkey", value="orders", where="c_mktsegment <> 'BUILDING'"), Leg("satellites", "orders", "c_nationkey", value="orders", where="c_mktsegment = 'BUILDING'")], "primary_orders")

_LEGS = """legs AS (SELECT c_nationkey AS k, count(*) AS orders, sum(CASE WHEN o_totalprice > 300000 THEN 1 ELSE 0 END) AS large, c_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, c_custkey, c_mktsegment),
areas AS (SELECT n_nationkey, n_regionkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers FROM nation)"""
_BY_KEY_SQL = f"""{_LEGS}, built AS (SELECT n_nationkey, customers, n_regionkey, coalesce((SELECT sum(orders) FROM legs WHERE k = n_nationkey), 0) AS orders, (SELECT sum(large) FROM legs WHERE k = n_nationkey AND large > 1) AS large, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM areas)"""


@bound("area_dataset_by_key", f"WITH {_BY_KEY_SQL} SELECT n_nationkey, CAST(customers AS BIGINT) AS customers, n_regionkey, CAST(orders AS BIGINT) AS orders, CAST(coalesce(large, -1) AS BIGINT) AS large, CAST(suppliers AS BIGINT) AS suppliers, round(orders * 100000.0 / nullif(customers, 0), 6) AS orders_rate FROM built")
def area_dataset_by_key(t):
    """Counts by key; cells without a large order stay unknown, shown as -1."""
    built = BY_KEY.build(area_tables(t))
    return built.withColumns({"orders_rate": F.round("orders_rate", 6), "large": F.coalesce("large", F.lit(-1))})


@bound("area_dataset_by_name", f"WITH {_BY_KEY_SQL} SELECT n_nationkey, CAST(customers AS BIGINT) AS customers, CAST(orders AS BIGINT) AS orders, CAST(suppliers AS BIGINT) AS suppliers, round(suppliers * 100000.0 / nullif(customers, 0), 6) AS suppliers_rate FROM built")
def area_dataset_by_name(t):
    """Suppliers carry an area's name in odd spelling; the crosswalk knows them all."""
    built = BY_NAME.build(area_tables(t), crosswalk=t.nation.select(F.col("n_name").alias("name"), "n_nationkey"))
    return built.withColumn("suppliers_rate", F.round("suppliers_rate", 6))


@bound("area_dataset_sensitivity", f"WITH {_LEGS} SELECT n_nationkey, CAST(customers AS BIGINT) AS customers, CAST(coalesce((SELECT sum(orders) FROM legs WHERE k = n_nationkey), 0) AS BIGINT) AS orders, CAST(coalesce((SELECT sum(orders) FROM legs WHERE k = n_nationkey AND c_mktsegment <> 'BUILDING'), 0) AS BIGINT) AS primary_orders, CAST(coalesce((SELECT sum(orders) FROM legs WHERE k = n_nationkey AND c_mktsegment = 'BUILDING'), 0) AS BIGINT) AS satellites, round(coalesce((SELECT sum(orders) FROM legs WHERE k = n_nationkey AND c_mktsegment <> 'BUILDING'), 0) * 100000.0 / nullif(customers, 0), 6) AS primary_orders_rate FROM areas")
def area_dataset_sensitivity(t):
    """Primary places, and the sum with satellites as a check of sensitivity."""
    built = SENSITIVE.build(area_tables(t))
    return built.withColumn("primary_orders_rate", F.round("primary_orders_rate", 6))


BOXES = [("core", [-0.1, 0.1, 0.1, -0.1], [39.9, 39.9, 40.1, 40.1]), ("east", [0.1, 0.5, 0.5, 0.1], [39.9, 39.9, 40.1, 40.1])]
BY_PLACE = AreaDataset("by_place", "boxes", "area_id", "size", [Leg("points", "points", via="points"), Leg("northern", "points", via="points", where="y > 40")], "points", per=1.0)


@bound("area_dataset_by_place", f"WITH {POINTS_SQL}, b(area_id, size, west, east) AS (VALUES ('core', 4.0, -0.1, 0.1), ('east', 8.0, 0.1, 0.5)) SELECT area_id, CAST(size AS DOUBLE) AS size, (SELECT count(*) FROM pt WHERE lon > west AND lon < east AND lat > 39.9 AND lat < 40.1) AS points, (SELECT count(*) FROM pt WHERE lon > west AND lon < east AND lat > 40 AND lat < 40.1) AS northern, round((SELECT count(*) FROM pt WHERE lon > west AND lon < east AND lat > 39.9 AND lat < 40.1) / CAST(size AS DOUBLE), 6) AS points_rate FROM b")
def area_dataset_by_place(t):
    """Points fall in polygons; those outside of all count nowhere."""
    spark = t.nation.sparkSession
    boxes = spark.createDataFrame(BOXES, "area_id string, xs array<double>, ys array<double>")
    tables = {"boxes": boxes.select("area_id", F.when(F.col("area_id") == "core", 4.0).otherwise(8.0).alias("size")), "points": points(t).select(F.col("vec_id").alias("point_id"), F.col("lon").alias("x"), F.col("lat").alias("y"))}
    return BY_PLACE.build(tables, polygons=boxes).withColumn("points_rate", F.round("points_rate", 6))


@bound("area_checkpoints", f"WITH {_BY_KEY_SQL} SELECT 'by_key' AS dataset, leg, CAST(total AS DOUBLE) AS total, round(total * 100.0 / 20000.0, 6) AS benchmark_pct FROM (SELECT 'orders' AS leg, sum(orders) AS total FROM built UNION ALL SELECT 'large', sum(large) FROM built UNION ALL SELECT 'suppliers', sum(suppliers) FROM built)")
def area_checkpoints(t):
    """Each source's total against a benchmark."""
    found = BY_KEY.checkpoints(BY_KEY.build(area_tables(t)))
    return found.withColumn("benchmark_pct", F.round("benchmark_pct", 6))


@bound("national_dataset", f"WITH {_BY_KEY_SQL}, v AS (SELECT c_nationkey AS n_nationkey, avg(c_acctbal) AS mean_balance, count(DISTINCT c_mktsegment) AS segments FROM customer GROUP BY 1) SELECT n_nationkey, CAST(customers AS BIGINT) AS customers, n_regionkey, CAST(orders AS BIGINT) AS orders, CAST(suppliers AS BIGINT) AS suppliers, CASE WHEN n_regionkey < 2 THEN 'by_key' ELSE 'by_name' END AS dataset, round(mean_balance, 6) AS mean_balance, CAST(segments AS BIGINT) AS segments FROM built LEFT JOIN v USING (n_nationkey)")
def national_dataset(t):
    """Areas of two datasets, built in different ways, with covariates by key."""
    tables = area_tables(t)
    some, rest = (tables | {"areas": tables["areas"].filter(c)} for c in ("n_regionkey < 2", "n_regionkey >= 2"))
    named = AreaDataset("by_name", "areas", "n_nationkey", "customers", BY_NAME.legs, "suppliers", ["n_regionkey"])
    cross = t.nation.select(F.col("n_name").alias("name"), "n_nationkey")
    covariates = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.avg("c_acctbal").alias("mean_balance"), F.countDistinct("c_mktsegment").alias("segments"))
    both = national([(BY_KEY, BY_KEY.build(some)), (named, named.build(rest, crosswalk=cross))], covariates, "n_nationkey")
    return both.select("n_nationkey", "customers", "n_regionkey", "orders", "suppliers", "dataset", F.round("mean_balance", 6).alias("mean_balance"), "segments")
