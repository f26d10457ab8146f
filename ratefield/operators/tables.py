"""Row-level building blocks: audited filters, missing values, clipping, scaling, binning and contracts."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratefield.operators.order import exact_quantiles
from ratefield.operators.skew import join_facts


def keep_unless_known(column: Column, value) -> Column:
    """A filter that drops confirmed mismatches alone: missing values stay."""
    return column.isNull() | (column == value)


def sentinel_to_null(column: Column, *sentinels) -> Column:
    return F.when(~column.isin(*sentinels), column)


def null_safe_sum(*columns: Column) -> Column:
    """Sum across columns where a missing term counts 0; missing if all are."""
    total = functools.reduce(operator.add, [F.coalesce(c, F.lit(0)) for c in columns])
    return F.when(functools.reduce(operator.or_, [c.isNotNull() for c in columns]), total)


def any_null(*columns: Column) -> Column:
    return functools.reduce(operator.or_, [c.isNull() for c in columns])


def clip_at_quantile(df: DataFrame, column: str, q: float, out: str) -> DataFrame:
    """Upper clip at an exact, linearly interpolated quantile; nulls stay null. The quantile is one row, broadcast."""
    bound = exact_quantiles(df, column, [q]).select(F.col("value").alias("_bound"))
    return df.crossJoin(F.broadcast(bound)).withColumn(out, F.when(F.col(column).isNotNull(), F.least(F.col(column), F.col("_bound")))).drop("_bound")


def impute_median(df: DataFrame, column: str, out: str, flag: str, by: list[str] | None = None) -> DataFrame:
    """Fill missing values with the exact median (of the group; a null key is a group), and mark them."""
    keys = by or []
    medians = exact_quantiles(df, column, [0.5], keys).select(*keys, F.col("value").alias("_median"))
    if keys:
        sizes = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
        joined = join_facts(df, join_facts(sizes, medians.withColumn("_one", F.lit(1)), keys, "_one", 0), keys, "_rows", df.count())
    else:
        joined = df.join(F.broadcast(medians), how="left")
    return joined.withColumn(flag, F.col(column).isNull()).withColumn(out, F.coalesce(column, "_median")).drop("_median")


def z_score(df: DataFrame, column: str, out: str, by: list[str]) -> DataFrame:
    """Standardise by the group's mean and sample standard deviation; null where that is 0 or missing."""
    stats = df.groupBy(*by).agg(F.avg(column).alias("_mean"), F.stddev_samp(column).alias("_sd"))
    return df.join(stats, by, "left").withColumn(out, F.try_divide(F.col(column) - F.col("_mean"), F.col("_sd"))).drop("_mean", "_sd")


def bin_index(column: Column, edges: list[float]) -> Column:
    """0 for values below the second edge, and so on: the last edge at or below the value; null below the first."""
    out = F.lit(None).cast("int")
    for i, edge in enumerate(edges):
        out = F.when(column >= edge, F.lit(i)).otherwise(out) if i else F.when(column >= edge, F.lit(0))
    return out


def lower_clipped_log(column: Column, least: float) -> Column:
    return F.when(column.isNotNull(), F.log(F.greatest(column, F.lit(least))))


def rate_per(count: Column, exposure: Column, unit: float = 100_000.0) -> Column:
    return F.try_divide(count, exposure) * unit


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (column_name, missing, share), in one pass."""
    stats = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing")) for c in columns])
    return stats.select("_n", F.inline(rows)).select("column_name", "missing", F.try_divide(F.col("missing"), F.col("_n")).alias("share"))


def unmatched_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of left that right lacks: a contract holds if there are none."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti")


def expect(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """Pass df on; a row that fails the condition fails the job with the message."""
    return df.filter(F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order; the order should end in an id."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def override(df: DataFrame, corrections: DataFrame, key: str, column: str) -> DataFrame:
    """Replace a column's value for the keys that corrections (key, column) name."""
    fix = corrections.select(key, F.col(column).alias("_fix"))
    return df.join(fix, key, "left").withColumn(column, F.coalesce("_fix", column)).drop("_fix")


def fill_coordinates(df: DataFrame, found: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Fill missing (lat, lon) from found (key, lat, lon); also counts attempted, recovered and still_missing."""
    got = found.select(key, F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    both = df.join(got, key, "left")
    gap = F.col("lat").isNull() | F.col("lon").isNull()
    audit = both.agg(F.count_if(gap).alias("attempted"), F.count_if(gap & F.col("_lat").isNotNull()).alias("recovered"), F.count_if(gap & F.col("_lat").isNull()).alias("still_missing"))
    filled = both.withColumns({"lat": F.when(gap, F.col("_lat")).otherwise(F.col("lat")), "lon": F.when(gap, F.col("_lon")).otherwise(F.col("lon"))})
    return filled.drop("_lat", "_lon"), audit
