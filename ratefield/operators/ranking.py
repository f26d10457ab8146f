"""Ranks, top lists, movers and comparisons of rankings.

Windows over all rows (with_rank without `by`, and what is built on it) run over units (areas), which are as many as an
area table has. Tables that grow with events or customers are ranked by exact_rank, which has no such window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratefield.operators.order import exact_rank, step_up, value_counts, value_ranks
from ratefield.session import ensure_checkpoint_dir


def with_rank(df: DataFrame, column: str, out: str, descending: bool = True, by: list[str] | None = None) -> DataFrame:
    """Rank with ties at the least place; missing values come last."""
    order = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    return df.withColumn(out, F.rank().over(Window.partitionBy(*(by or [])).orderBy(order)))


def correlation(x: str, y: str):
    """Pearson's r of rows where both are present; null where either doesn't vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, rho) over rows where both are present."""
    ensure_checkpoint_dir(df.sparkSession)
    kept = df.dropna(subset=[x, y]).select(x, y).checkpoint()
    both = exact_rank(exact_rank(kept, x, "_rx", "average").checkpoint(), y, "_ry", "average")
    return both.agg(F.count("*").alias("n"), correlation("_rx", "_ry").alias("rho"))


def rank_changes(df: DataFrame, old: str, new: str) -> DataFrame:
    """Adds rank_old, rank_new and change (up is positive)."""
    both = with_rank(with_rank(df, old, "rank_old"), new, "rank_new")
    return both.withColumn("change", F.col("rank_old") - F.col("rank_new"))


def top(df: DataFrame, k: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(k)


def movers(df: DataFrame, k: int, key: str) -> DataFrame:
    """The k largest changes up and down, with a direction."""
    up = df.orderBy(F.desc("change"), key).limit(k).withColumn("direction", F.lit("up"))
    down = df.orderBy(F.asc("change"), key).limit(k).withColumn("direction", F.lit("down"))
    return up.unionByName(down)


def entrants(df: DataFrame, k: int, key: str) -> DataFrame:
    """Keys in the new top k that the old one lacks."""
    return df.filter(F.col("rank_new") <= k).select(key).join(df.filter(F.col("rank_old") <= k).select(key), key, "left_anti")


def floored_and_full_rank(df: DataFrame, column: str, exposure: str, floor: float, key: str) -> DataFrame:
    """Rank among units at or over an exposure floor, and among all."""
    full = with_rank(df, column, "rank_full")
    floored = with_rank(df.filter(F.col(exposure) >= floor), column, "rank_floored").select(key, "rank_floored")
    return full.join(floored, key, "left")


def benjamini_hochberg(df: DataFrame, p: str, out: str) -> DataFrame:
    """Step-up q-values: the least p * m / rank from here to the largest p, at most 1; null where p is."""
    return step_up(df, p, out)


def mann_whitney(df: DataFrame, group: str, value: str, first, second) -> DataFrame:
    """One row for two groups: n1, n2, u (of the first), rank_biserial, and z of the normal approximation with the correction for ties (no continuity correction).

    Ties take mean ranks, found from counts by value; null values don't count.
    """
    rows = df.filter(F.col(group).isin(first, second))
    counts = value_counts(rows, value, a=F.count_if(F.col(group) == first))
    r = F.col("before") + (F.col("n") + 1) / 2.0
    n = F.col("n").cast("double")
    s = value_ranks(counts, value).agg(F.sum("a").cast("double").alias("n1"), F.sum(F.col("n") - F.col("a")).cast("double").alias("n2"), F.sum(F.col("a") * r).alias("w"), F.sum(n * n * n - n).alias("ties"))
    n1, n2, total = F.col("n1"), F.col("n2"), F.col("n1") + F.col("n2")
    u = F.col("w") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * (total + 1 - F.try_divide(F.col("ties"), total * (total - 1))))
    return s.select("n1", "n2", u.alias("u"), F.try_divide(2 * u, n1 * n2).alias("_twice"), F.try_divide(u - n1 * n2 / 2, spread).alias("z")).select("n1", "n2", "u", (F.col("_twice") - 1).alias("rank_biserial"), "z")


def weighted_mean(value, weight):
    """A missing weight counts 0; a missing value adds nothing but its weight counts; null where weights sum to 0."""
    total = F.sum(F.coalesce(weight, F.lit(0.0)))
    return F.try_divide(F.sum(F.coalesce(value * weight, F.lit(0.0))), total)


def error_metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row: n, mae, rmse, mean absolute log error (over positive pairs) and r."""
    e = F.col(guess) - F.col(truth)
    both = (F.col(truth) > 0) & (F.col(guess) > 0)
    log_error = F.when(both, F.abs(F.log(F.when(both, F.col(guess))) - F.log(F.when(both, F.col(truth)))))
    return df.dropna(subset=[truth, guess]).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(log_error).alias("male"), correlation(truth, guess).alias("r"))
