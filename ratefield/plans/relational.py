"""Relational operators bound to the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratefield.functions import text as tx
from ratefield.operators import ranking as rk
from ratefield.operators import rates as rt
from ratefield.operators import tables as tb
from ratefield.operators.audit import audited_filters
from ratefield.plans.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def bound(name: str, sql: str | None = None):
    """Register a query that takes Tables; its SQL too."""

    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def nation_units(t: Tables) -> DataFrame:
    """Nations with customers as exposure, and their orders and suppliers counted."""
    spine = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    customers = rt.group_counts(t.customer, "c_nationkey", "customers").withColumnRenamed("c_nationkey", "n_nationkey")
    suppliers = rt.group_counts(t.supplier, "s_nationkey", "suppliers").withColumnRenamed("s_nationkey", "n_nationkey")
    per_customer = rt.group_counts(t.orders, "o_custkey", "orders")
    orders = per_customer.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.sum("orders").alias("orders"))
    return rt.assemble(spine, "n_nationkey", [customers, suppliers, orders])


UNITS_SQL = """units AS (SELECT n_nationkey, n_name, n_regionkey,
 CAST(coalesce((SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey), 0) AS BIGINT) AS customers,
 CAST(coalesce((SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey), 0) AS BIGINT) AS suppliers,
 CAST(coalesce((SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey), 0) AS BIGINT) AS orders
 FROM nation)"""


@bound(
    "rate_assembly",
    f"WITH {UNITS_SQL} SELECT n_nationkey, n_name, customers, suppliers, orders, round(orders / CAST(customers AS DOUBLE) * 100000, 6) AS order_rate, round(suppliers / CAST(customers AS DOUBLE) * 100000, 6) AS supplier_rate FROM units",
)
def rate_assembly(t):
    u = nation_units(t)
    u = u.withColumns({"order_rate": tb.rate_per(F.col("orders"), F.col("customers")), "supplier_rate": tb.rate_per(F.col("suppliers"), F.col("customers"))})
    return rounded(u.drop("n_regionkey"), "order_rate", "supplier_rate")


PRIOR_SQL = """s AS (SELECT count(*) AS units, sum(y) / sum(n) AS mean, sum(n) AS tot FROM d),
v AS (SELECT units, mean, (SELECT sum(n * power(y / n - mean, 2)) FROM d) / tot - mean / (tot / units) AS raw FROM s),
p AS (SELECT units, mean, CASE WHEN raw > 0 THEN raw ELSE mean * mean / 1e6 END AS variance FROM v),
prior AS (SELECT units, mean, variance, mean * mean / variance AS shape, mean / variance AS rate FROM p)"""
RANKED_SQL = f"""WITH {UNITS_SQL}, d AS (SELECT CAST(orders AS DOUBLE) AS y, CAST(customers AS DOUBLE) AS n, * FROM units WHERE customers > 0), {PRIOR_SQL},
r AS (SELECT n_nationkey, n_name, orders, customers, y / n * 100000 AS raw_rate, (shape + y) / (rate + n) * 100000 AS shrunken_rate FROM d, prior)
SELECT n_nationkey, n_name, orders, customers, round(raw_rate, 6) AS raw_rate, round(shrunken_rate, 6) AS shrunken_rate,
 CAST(rank() OVER (ORDER BY raw_rate DESC) AS INT) AS raw_rank, CAST(rank() OVER (ORDER BY shrunken_rate DESC) AS INT) AS shrunken_rank FROM r"""


@bound("smoothed_rate_ranking", RANKED_SQL)
def smoothed_rate_ranking(t):
    ranked = rt.ranked_rates(nation_units(t), "n_nationkey", "orders", "customers")
    return rounded(ranked.select("n_nationkey", "n_name", "orders", "customers", "raw_rate", "shrunken_rate", "raw_rank", "shrunken_rank"), "raw_rate", "shrunken_rate")


@bound(
    "audit_filters",
    """WITH c AS (SELECT count(*) AS n0, count(*) FILTER (o_orderstatus <> 'F') AS n1, count(*) FILTER (o_orderstatus <> 'F' AND o_totalprice > 50000) AS n2,
 count(*) FILTER (o_orderstatus <> 'F' AND o_totalprice > 50000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')) AS n3 FROM orders)
SELECT 0 AS position, 'open' AS step, n0 AS before, n1 AS after, n0 - n1 AS dropped FROM c UNION ALL SELECT 1, 'large', n1, n2, n1 - n2 FROM c UNION ALL SELECT 2, 'urgent', n2, n3, n2 - n3 FROM c""",
)
def audit_filters(t):
    steps = [("open", F.col("o_orderstatus") != "F"), ("large", F.col("o_totalprice") > 50000), ("urgent", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))]
    events = audited_filters(t.orders, steps, "orders").count().filter("event = 'filter'")
    return events.select((F.col("position") - 1).alias("position"), "step", "before", "after", "dropped")


@bound("inclusion_rule", "SELECT event_type, count(*) AS dropped FROM events WHERE event_type NOT IN ('click', 'purchase') GROUP BY event_type")
def inclusion_rule(t):
    return t.events.filter(~F.col("event_type").isin("click", "purchase")).groupBy("event_type").agg(F.count("*").alias("dropped"))


@bound(
    "value_histogram",
    "SELECT event_type, count(*) AS events, CAST(count(DISTINCT user_id) AS BIGINT) AS users, round(avg(value), 6) AS mean_value, round(stddev_samp(value), 6) AS sd_value, min(value) AS low, max(value) AS high, round(median(value), 6) AS median_value FROM events GROUP BY event_type",
)
def value_histogram(t):
    v = F.col("value")
    by = t.events.groupBy("event_type").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), F.avg(v).alias("mean_value"), F.stddev_samp(v).alias("sd_value"), F.min(v).alias("low"), F.max(v).alias("high"))
    medians = tb.exact_quantiles(t.events, "value", [0.5], ["event_type"]).select(F.col("event_type").alias("kind"), F.col("value").alias("median_value"))
    both = by.join(medians, F.col("event_type").eqNullSafe(F.col("kind")), "left").drop("kind")
    return rounded(both, "mean_value", "sd_value", "median_value")


@bound(
    "sentinel_nulls",
    """SELECT c_nationkey, count(*) AS customers, count(*) FILTER (c_acctbal < 0) AS missing, round(sum(CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END), 2) AS total,
 round(sum(coalesce(CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END, 0) + coalesce(length(c_mktsegment), 0)), 2) AS wide FROM customer GROUP BY c_nationkey""",
)
def sentinel_nulls(t):
    clean = t.customer.withColumn("bal", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))
    clean = clean.withColumn("wide", tb.null_safe_sum(F.col("bal"), F.char_length("c_mktsegment").cast("double")))
    return clean.groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.count_if(F.col("bal").isNull()).alias("missing"), F.round(F.sum("bal"), 2).alias("total"), F.round(F.sum("wide"), 2).alias("wide"))


@bound(
    "winsorize_q99",
    """WITH b AS (SELECT quantile_cont(l_extendedprice / l_quantity, 0.99) AS q FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(avg(least(l_extendedprice / l_quantity, q)), 6) AS clipped_mean, count(*) FILTER (l_extendedprice / l_quantity > q) AS clipped FROM lineitem, b GROUP BY l_returnflag""",
)
def winsorize_q99(t):
    unit = t.lineitem.select("l_returnflag", (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"))
    clipped = tb.clip_at_quantile(unit, "unit", 0.99, "clip")
    return rounded(clipped.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg("clip").alias("clipped_mean"), F.count_if(F.col("unit") > F.col("clip")).alias("clipped")), "clipped_mean")


@bound(
    "impute_median_flag",
    """WITH c AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS bal FROM customer), m AS (SELECT c_mktsegment, median(bal) AS med FROM c GROUP BY 1)
SELECT c_custkey, bal IS NULL AS was_missing, round(coalesce(bal, med), 6) AS filled FROM c JOIN m USING (c_mktsegment)""",
)
def impute_median_flag(t):
    clean = t.customer.select("c_custkey", "c_mktsegment", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("bal"))
    return rounded(tb.impute_median(clean, "bal", "filled", "was_missing", ["c_mktsegment"]).select("c_custkey", "was_missing", "filled"), "filled")


@bound("zscore", "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER w) / stddev_samp(c_acctbal) OVER w, 6) AS z FROM customer WINDOW w AS (PARTITION BY c_mktsegment)")
def zscore(t):
    return rounded(tb.z_score(t.customer, "c_acctbal", "z", ["c_mktsegment"]).select("c_custkey", "z"), "z")


@bound("null_keep_filter", "SELECT n_nationkey, coalesce(s_suppkey, -1) AS s_suppkey FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 WHERE s_suppkey IS NULL OR s_suppkey % 2 = 0")
def null_keep_filter(t):
    rich = t.supplier.filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    return t.nation.select("n_nationkey").join(rich, "n_nationkey", "left").filter(F.col("s_suppkey").isNull() | (F.col("s_suppkey") % 2 == 0)).fillna(-1, ["s_suppkey"])


@bound("coalesce_fallback", "SELECT n_nationkey, coalesce(max(s_acctbal) FILTER (s_acctbal > 9000), min(s_acctbal), -1.0) AS best FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey")
def coalesce_fallback(t):
    best = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.max(F.when(F.col("s_acctbal") > 9000, F.col("s_acctbal"))).alias("a"), F.min("s_acctbal").alias("b"))
    return t.nation.select("n_nationkey").join(best, "n_nationkey", "left").select("n_nationkey", F.coalesce("a", "b", F.lit(-1.0)).alias("best"))


@bound(
    "bin_rates",
    "SELECT CASE WHEN p_retailprice < 950 THEN 0 WHEN p_retailprice < 1100 THEN 1 WHEN p_retailprice < 1300 THEN 2 WHEN p_retailprice < 1600 THEN 3 ELSE 4 END AS bin, count(*) AS parts, round(sum(p_retailprice), 4) AS total FROM part GROUP BY 1",
)
def bin_rates(t):
    return t.part.withColumn("bin", tb.bin_index(F.col("p_retailprice"), [0, 950, 1100, 1300, 1600])).groupBy("bin").agg(F.count("*").alias("parts"), F.round(F.sum("p_retailprice"), 4).alias("total"))


@bound("crosswalk_join", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey")
def crosswalk_join(t):
    names = t.nation.select("n_nationkey", "n_name", F.lower(F.trim("n_name")).alias("name_key"), "n_regionkey")
    rows = t.supplier.join(names.select("n_nationkey", F.upper("name_key").alias("raw")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.lower(F.trim("raw")).alias("name_key"))
    return rows.join(names, "name_key").join(t.region.withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey").select("s_suppkey", "n_name", "r_name")


@bound(
    "dual_key_lookup",
    """WITH k AS (SELECT lower(n_name) AS k, n_nationkey, 0 AS pri FROM nation UNION ALL SELECT lower(r_name), n_nationkey, 1 FROM nation JOIN region ON n_regionkey = r_regionkey),
f AS (SELECT k, n_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pri, n_nationkey) AS rn FROM k) WHERE rn = 1) SELECT k AS lookup, n_nationkey FROM f""",
)
def dual_key_lookup(t):
    bare = t.nation.select(F.lower("n_name").alias("lookup"), "n_nationkey", F.lit(0).alias("pri"))
    wide = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lower("r_name").alias("lookup"), "n_nationkey", F.lit(1).alias("pri"))
    return tb.keep_first(bare.unionByName(wide), ["lookup"], F.col("pri"), F.col("n_nationkey")).drop("pri")


@bound(
    "composite_key_join",
    """WITH a AS (SELECT c_nationkey, c_mktsegment, count(*) AS customers FROM customer GROUP BY ALL), b AS (SELECT c_nationkey, c_mktsegment, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT c_nationkey, c_mktsegment, customers, coalesce(orders, 0) AS orders FROM a LEFT JOIN b USING (c_nationkey, c_mktsegment)""",
)
def composite_key_join(t):
    keys = ["c_nationkey", "c_mktsegment"]
    orders = t.orders.select(F.col("o_custkey").alias("c_custkey")).join(t.customer.select("c_custkey", *keys), "c_custkey").groupBy(*keys).agg(F.count("*").alias("orders"))
    return t.customer.groupBy(*keys).agg(F.count("*").alias("customers")).join(orders, keys, "left").fillna(0, ["orders"])


TWO_RATES = f"WITH {UNITS_SQL}, r AS (SELECT n_nationkey, n_regionkey, customers, orders / CAST(customers AS DOUBLE) AS a, suppliers / CAST(customers AS DOUBLE) AS b FROM units), k AS (SELECT *, rank() OVER (ORDER BY a DESC NULLS LAST) AS rank_old, rank() OVER (ORDER BY b DESC NULLS LAST) AS rank_new FROM r)"


def two_ranks(t):
    u = nation_units(t)
    u = u.select("n_nationkey", "n_regionkey", "customers", F.try_divide("orders", "customers").alias("a"), F.try_divide("suppliers", "customers").alias("b"))
    return rk.rank_changes(u, "a", "b")


@bound("rank_change", TWO_RATES + " SELECT n_nationkey, CAST(rank_old AS INT) AS rank_old, CAST(rank_new AS INT) AS rank_new, CAST(rank_old - rank_new AS INT) AS change FROM k")
def rank_change(t):
    return two_ranks(t).select("n_nationkey", "rank_old", "rank_new", "change")


@bound("anti_new_entrants", TWO_RATES + " SELECT n_nationkey FROM k WHERE rank_new <= 8 EXCEPT SELECT n_nationkey FROM k WHERE rank_old <= 8")
def anti_new_entrants(t):
    return rk.entrants(two_ranks(t), 8, "n_nationkey")


@bound("movers", TWO_RATES + ", c AS (SELECT n_nationkey, CAST(rank_old - rank_new AS INT) AS change FROM k) SELECT * FROM (SELECT *, 'up' AS direction FROM c ORDER BY change DESC, n_nationkey LIMIT 5) UNION ALL SELECT * FROM (SELECT *, 'down' AS direction FROM c ORDER BY change, n_nationkey LIMIT 5)")
def movers(t):
    return rk.movers(two_ranks(t).select("n_nationkey", "change"), 5, "n_nationkey")


@bound("top_overlap", TWO_RATES + " SELECT CAST(count(*) FILTER (rank_old <= 10 AND rank_new <= 10) AS BIGINT) AS both_lists, CAST(count(*) FILTER (rank_old <= 10 AND rank_new > 10) AS BIGINT) AS old_only, CAST(count(*) FILTER (rank_old > 10 AND rank_new <= 10) AS BIGINT) AS new_only FROM k")
def top_overlap(t):
    old, new = F.col("rank_old") <= 10, F.col("rank_new") <= 10
    return two_ranks(t).agg(F.count_if(old & new).alias("both_lists"), F.count_if(old & ~new).alias("old_only"), F.count_if(~old & new).alias("new_only"))


@bound("semi_flag", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) AS large_buyer FROM customer")
def semi_flag(t):
    large = t.orders.filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("f", F.lit(True))
    return t.customer.select("c_custkey").join(large, "c_custkey", "left").select("c_custkey", F.coalesce("f", F.lit(False)).alias("large_buyer"))


@bound("priority_dedup", "SELECT l_orderkey, l_returnflag, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1")
def priority_dedup(t):
    order = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return tb.keep_first(t.lineitem.select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey"], order, F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")).drop("l_partkey", "l_suppkey")


@bound("located_first", "SELECT c_nationkey, c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END ASC NULLS LAST, c_custkey) AS rn FROM customer) WHERE rn = 1")
def located_first(t):
    known = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))
    return tb.keep_first(t.customer, ["c_nationkey", "c_mktsegment"], known.asc_nulls_last(), F.col("c_custkey")).select("c_nationkey", "c_mktsegment", "c_custkey")


@bound("dual_universe_rank", f"WITH {UNITS_SQL}, r AS (SELECT n_nationkey, customers, orders / CAST(customers AS DOUBLE) AS a FROM units), m AS (SELECT avg(customers) AS f FROM units), x AS (SELECT n_nationkey, CAST(rank() OVER (ORDER BY a DESC NULLS LAST) AS INT) AS rank_floored FROM r, m WHERE customers >= f) SELECT r.n_nationkey, CAST(rank() OVER (ORDER BY a DESC NULLS LAST) AS INT) AS rank_full, coalesce(rank_floored, 0) AS rank_floored FROM r LEFT JOIN x USING (n_nationkey)")
def dual_universe_rank(t):
    u = nation_units(t).withColumn("a", F.try_divide("orders", "customers"))
    floor = u.agg(F.avg("customers")).first()[0]
    return rk.floored_and_full_rank(u, "a", "customers", floor, "n_nationkey").select("n_nationkey", "rank_full", F.coalesce("rank_floored", F.lit(0)).alias("rank_floored"))


@bound("floor_topk", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 1000 ORDER BY c_acctbal DESC, c_custkey LIMIT 50")
def floor_topk(t):
    return rk.top(t.customer.filter("c_acctbal >= 1000").select("c_custkey", "c_acctbal"), 50, F.desc("c_acctbal"), "c_custkey")


@bound("nested_topk", "SELECT * FROM (SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100) ORDER BY o_custkey, o_orderkey LIMIT 20")
def nested_topk(t):
    large = rk.top(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), 100, F.desc("o_totalprice"), "o_orderkey")
    return rk.top(large, 20, "o_custkey", "o_orderkey")


@bound(
    "state_rollup",
    f"""WITH {UNITS_SQL}, r AS (SELECT *, orders / CAST(customers AS DOUBLE) AS rate FROM units)
SELECT n_regionkey, count(*) AS units, CAST(sum(customers) AS BIGINT) AS customers, CAST(sum(orders) AS BIGINT) AS orders, round(sum(coalesce(rate * customers, 0)) / nullif(sum(coalesce(customers, 0)), 0), 6) AS weighted_rate, round(avg(rate), 6) AS mean_rate, round(median(rate), 6) AS median_rate,
 CAST(rank() OVER (ORDER BY sum(orders) DESC) AS INT) AS position FROM r GROUP BY n_regionkey""",
)
def state_rollup(t):
    u = nation_units(t).withColumn("rate", F.try_divide("orders", "customers"))
    by = u.groupBy("n_regionkey").agg(F.count("*").alias("units"), F.sum("customers").alias("customers"), F.sum("orders").alias("orders"), rk.weighted_mean(F.col("rate"), F.col("customers")).alias("weighted_rate"), F.avg("rate").alias("mean_rate"), F.percentile("rate", 0.5).alias("median_rate"))
    return rounded(rk.with_rank(by, "orders", "position"), "weighted_rate", "mean_rate", "median_rate")


@bound("spearman", """WITH d AS (SELECT c_custkey, c_acctbal AS x, count(o_orderkey) AS y FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry, x, y FROM d)
SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho, round(corr(x, y), 6) AS pearson FROM r""")
def spearman(t):
    per = rt.group_counts(t.orders, "o_custkey", "y").withColumnRenamed("o_custkey", "c_custkey")
    d = t.customer.select("c_custkey", F.col("c_acctbal").alias("x")).join(per, "c_custkey", "left").fillna(0, ["y"])
    return rounded(rk.spearman(d, "x", "y").crossJoin(d.agg(F.corr("x", "y").alias("pearson"))), "rho", "pearson")


@bound("error_metrics", """WITH d AS (SELECT o_totalprice AS truth, avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS guess FROM orders)
SELECT count(*) AS n, round(avg(abs(guess - truth)), 6) AS mae, round(sqrt(avg((guess - truth) * (guess - truth))), 6) AS rmse, round(avg(abs(ln(guess) - ln(truth))), 6) AS male, round(corr(truth, guess), 6) AS r FROM d""")
def error_metrics(t):
    means = t.orders.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("guess"))
    d = t.orders.select("o_orderpriority", F.col("o_totalprice").alias("truth")).join(means, "o_orderpriority")
    return rounded(rk.error_metrics(d, "truth", "guess"), "mae", "rmse", "male", "r")


@bound("welch_effects", """WITH a AS (SELECT count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer WHERE c_mktsegment = 'BUILDING'), b AS (SELECT count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer WHERE c_mktsegment = 'MACHINERY')
SELECT round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t, round(power(a.v / a.n + b.v / b.n, 2) / (power(a.v / a.n, 2) / (a.n - 1) + power(b.v / b.n, 2) / (b.n - 1)), 6) AS df,
 round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 6) AS d, round((1 - 3.0 / (4.0 * (a.n + b.n) - 9)) * (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 6) AS g FROM a, b""")
def welch_effects(t):
    def side(segment, tag):
        return t.customer.filter(F.col("c_mktsegment") == segment).agg(F.count("*").alias(f"n{tag}"), F.avg("c_acctbal").alias(f"m{tag}"), F.var_samp("c_acctbal").alias(f"v{tag}"))

    both = side("BUILDING", 1).crossJoin(side("MACHINERY", 2))
    n1, n2, m1, m2, v1, v2 = (F.col(c) for c in ("n1", "n2", "m1", "m2", "v1", "v2"))
    s1, s2 = v1 / n1, v2 / n2
    d = (m1 - m2) / F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))
    return rounded(both.select(((m1 - m2) / F.sqrt(s1 + s2)).alias("t"), (F.pow(s1 + s2, 2) / (s1 * s1 / (n1 - 1) + s2 * s2 / (n2 - 1))).alias("df"), d.alias("d"), ((1 - 3.0 / (4.0 * (n1 + n2) - 9)) * d).alias("g")), "t", "df", "d", "g")


@bound("union_missing_cols", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, 'customer' AS kind FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_suppkey, s_name, NULL, 'supplier' FROM supplier WHERE s_acctbal > 9000")
def union_missing_cols(t):
    a = t.customer.filter("c_acctbal > 9000").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.lit("customer").alias("kind"))
    b = t.supplier.filter("s_acctbal > 9000").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("kind"))
    return a.unionByName(b, allowMissingColumns=True)


@bound("set_ops", "SELECT 'both' AS part, k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9500 INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'customer_only', k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9500 EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'supplier_only', k FROM (SELECT s_nationkey AS k FROM supplier EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9500)")
def set_ops(t):
    a, b = t.customer.filter("c_acctbal > 9500").select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"))
    parts = [("both", a.intersect(b)), ("customer_only", a.exceptAll(a.intersect(b)).distinct().join(b, "k", "left_anti")), ("supplier_only", b.distinct().join(a, "k", "left_anti"))]
    out = None
    for name, df in parts:
        df = df.select(F.lit(name).alias("part"), "k")
        out = df if out is None else out.unionByName(df)
    return out


@bound("null_profile", "SELECT 'bal' AS column_name, count(*) FILTER (c_acctbal < 0) AS missing, round(count(*) FILTER (c_acctbal < 0) / CAST(count(*) AS DOUBLE), 6) AS share FROM customer UNION ALL SELECT 'c_name', count(*) FILTER (c_name IS NULL), round(count(*) FILTER (c_name IS NULL) / CAST(count(*) AS DOUBLE), 6) FROM customer")
def null_profile(t):
    return rounded(tb.null_profile(t.customer.withColumn("bal", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))), ["bal", "c_name"]), "share")


@bound("label_agreement", "SELECT count(*) AS n, round(avg(CASE WHEN (c_acctbal > 5000) = (c_mktsegment < 'F') THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM customer")
def label_agreement(t):
    same = (F.col("c_acctbal") > 5000) == (F.col("c_mktsegment") < "F")
    return t.customer.agg(F.count("*").alias("n"), F.round(F.avg(same.cast("double")), 6).alias("agreement"))


@bound("argmax_rows", "SELECT c_mktsegment, arg_max(c_custkey, c_acctbal) AS richest, arg_min(c_custkey, c_acctbal) AS poorest FROM customer GROUP BY c_mktsegment")
def argmax_rows(t):
    """Of equal balances the least key counts, as SQL finds it first in a table by key; a row without key or balance is no candidate."""
    known = lambda tie: F.when(F.col("c_custkey").isNotNull() & F.col("c_acctbal").isNotNull(), F.struct("c_acctbal", tie.alias("tie")))
    richest, poorest = F.max_by("c_custkey", known(F.bitwise_not("c_custkey"))), F.min_by("c_custkey", known(F.col("c_custkey")))
    return t.customer.groupBy("c_mktsegment").agg(richest.alias("richest"), poorest.alias("poorest"))


@bound("count_reconciliation", "SELECT (SELECT count(*) FROM orders) AS n_rows, CAST((SELECT sum(c) FROM (SELECT count(*) AS c FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority)) AS BIGINT) AS grouped, true AS reconciled")
def count_reconciliation(t):
    grouped = rt.group_counts(t.orders, "o_orderpriority", "c").agg(F.sum("c").alias("grouped"))
    return t.orders.agg(F.count("*").alias("n_rows")).crossJoin(grouped).withColumn("reconciled", F.col("n_rows") == F.col("grouped"))


@bound("override_by_key", "SELECT p_partkey, CASE WHEN p_partkey = 1 THEN 'Brand#X' WHEN p_partkey = 2 THEN 'Brand#Y' ELSE p_brand END AS p_brand FROM part")
def override_by_key(t):
    fix = t.part.sparkSession.createDataFrame([(1, "Brand#X"), (2, "Brand#Y")], "p_partkey long, p_brand string")
    return tb.override(t.part.select("p_partkey", "p_brand"), fix, "p_partkey", "p_brand")


@bound("benchmark_difference", "SELECT o_orderstatus, count(*) AS n, round((count(*) - 5000) / 5000.0 * 100, 6) AS percent FROM orders GROUP BY 1")
def benchmark_difference(t):
    return t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n")).withColumn("percent", F.round((F.col("n") - 5000) / 5000.0 * 100, 6))


@bound("text_clean", """SELECT s_suppkey, lower(trim(s_name)) AS clean, replace(s_name, 'Supplier', 'S') AS short, split_part(s_name, '#', 1) AS head, regexp_replace(s_name, '#[^#]*$', '') AS stem, lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS padded,
 regexp_replace(CAST(CAST(s_suppkey AS DOUBLE) AS VARCHAR), '\\.0$', '') AS id_text, s_name || '|' || CAST(s_nationkey AS VARCHAR) AS composite, contains(lower(s_name), 'supp') AS has_supp FROM supplier""")
def text_clean(t):
    n = F.col("s_name")
    return t.supplier.select("s_suppkey", F.lower(F.trim(n)).alias("clean"), F.replace(n, F.lit("Supplier"), F.lit("S")).alias("short"), tx.before(n, "#").alias("head"), tx.without_last_part(n, "#").alias("stem"), tx.zero_padded(F.col("s_suppkey").cast("string"), 8).alias("padded"),
        tx.no_float_tail(F.col("s_suppkey").cast("double").cast("string")).alias("id_text"), F.concat(n, F.lit("|"), F.col("s_nationkey").cast("string")).alias("composite"), tx.has_word(n, "supp").alias("has_supp"))


@bound("regex_extract", "SELECT page_id, nullif(regexp_extract(url, '^(https?)://([^/]+)/?(.*)$', 1), '') AS scheme, nullif(regexp_extract(url, '^(https?)://([^/]+)/?(.*)$', 2), '') AS host, nullif(regexp_extract(url, '([0-9]+)[^0-9]*$', 1), '') AS last_number, try_cast(nullif(regexp_extract(url, '([0-9]+)[^0-9]*$', 1), '') AS BIGINT) AS as_number FROM pages")
def regex_extract(t):
    u = F.col("url")
    pattern = "^(https?)://([^/]+)/?(.*)$"
    last = tx.extract(u, "([0-9]+)[^0-9]*$")
    return t.pages.select("page_id", tx.extract(u, pattern, 1).alias("scheme"), tx.extract(u, pattern, 2).alias("host"), last.alias("last_number"), last.try_cast("bigint").alias("as_number"))


@bound("json_get", "SELECT event_type, count(*) AS n, CAST(sum(coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0)) AS BIGINT) AS k_total, count(*) FILTER (json_extract_string(props, '$.absent') IS NULL) AS absent FROM events GROUP BY event_type")
def json_get(t):
    k = F.get_json_object("props", "$.k")
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.coalesce(k.try_cast("bigint"), F.lit(0))).alias("k_total"), F.count_if(F.get_json_object("props", "$.absent").isNull()).alias("absent"))


@bound("title_case", "SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(lower(p_name), '[a-z]+|[^a-z]+'), lambda x: upper(substr(x, 1, 1)) || lower(substr(x, 2))), '') AS title FROM part")
def title_case(t):
    return t.part.select("p_partkey", tx.title_case(F.lower("p_name")).alias("title"))


@bound("html_extract", "SELECT page_id, CAST(len(regexp_extract_all(html, '<a [^>]*href=')) AS BIGINT) AS links, CAST(len(regexp_extract_all(html, '<p[ >]')) AS BIGINT) AS paragraphs, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title FROM pages")
def html_extract(t):
    h = F.col("html")
    return t.pages.select("page_id", F.regexp_count(h, F.lit("<a [^>]*href=")).cast("long").alias("links"), F.regexp_count(h, F.lit("<p[ >]")).cast("long").alias("paragraphs"), tx.extract(h, "<title>([^<]*)</title>").alias("title"))


@bound("anchor_offset", "SELECT * FROM (SELECT conv_id, turn, role, lag(role, 1) OVER w AS role_before, coalesce(lag(turn, 2) OVER w, -1) AS turn_before_2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'assistant'")
def anchor_offset(t):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    return t.conversations.select("conv_id", "turn", "role", F.lag("role", 1).over(w).alias("role_before"), F.coalesce(F.lag("turn", 2).over(w), F.lit(-1)).alias("turn_before_2")).filter("role = 'assistant'")


def searched(t):
    """Every part whose name or brand has the term."""
    return t.part.filter(tx.has_word(F.col("p_name"), "re") | tx.has_word(F.col("p_brand"), "#1")).select("p_partkey", "p_name")


@bound("search_all", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 're') OR contains(lower(p_brand), '#1')")
def search_all(t):
    return searched(t)


@bound("map_payload", f"WITH {UNITS_SQL} SELECT n_regionkey, to_json({{'r': n_regionkey, 'c': CAST(sum(customers) AS BIGINT), 'o': CAST(sum(orders) AS BIGINT)}}) AS payload FROM units GROUP BY n_regionkey")
def map_payload(t):
    by = nation_units(t).groupBy("n_regionkey").agg(F.sum("customers").alias("c"), F.sum("orders").alias("o"))
    return by.select("n_regionkey", F.to_json(F.struct(F.col("n_regionkey").alias("r"), "c", "o")).cast("string").alias("payload"))
