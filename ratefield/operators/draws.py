"""Posterior draws as a table: written in blocks, summed up by logarithms, and described by exact quantiles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratefield.functions.special import gamma_quantile
from ratefield.operators.order import exact_quantiles
from ratefield.sources.sinks import write_parquet

#: Draws of a block: so many log densities of a unit are held together.
BLOCK = 100


def uniform(key: Column, draw: Column, seed: int) -> Column:
    """A number in (0, 1) for each key and draw, by MD5: any engine finds the same."""
    word = F.substring(F.md5(F.concat_ws(":", key.cast("string"), draw.cast("string"), F.lit(str(seed))).cast("binary")), 1, 8)
    return (F.conv(word, 16, 10).cast("double") + 0.5) / 4294967296.0


@F.pandas_udf(T.DoubleType())
def _gamma(p: pd.Series, shape: pd.Series, rate: pd.Series) -> pd.Series:
    return pd.Series(gamma_quantile(p.to_numpy(float), shape.to_numpy(float)) / rate.to_numpy(float))


def gamma_draws(posterior: DataFrame, key: str, shape: str, rate: str, draws: int, seed: int = 42) -> DataFrame:
    """(draw, unit, value): `draws` of each unit's Gamma posterior by its quantile function at keyed uniforms; runs agree."""
    each = posterior.select(F.col(key).alias("unit"), F.col(shape).alias("_a"), F.col(rate).alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    return each.select("draw", "unit", _gamma(uniform(F.col("unit"), F.col("draw"), seed), "_a", "_b").alias("value"))


def write_draws(draws: DataFrame, path: str) -> None:
    """Draws (draw, unit, value) as Parquet, a folder for each block of draws, so that a reader can take some."""
    write_parquet(draws.withColumn("block", F.floor(F.col("draw") / BLOCK)).repartition("block", F.pmod(F.xxhash64("unit"), F.lit(16))), path, partition_by=["block"])


def read_draws(spark, path: str, blocks: tuple[int, int] | None = None) -> DataFrame:
    """All draws, or those of blocks from the first to before the last; others aren't read."""
    df = spark.read.parquet(path)
    return df if blocks is None else df.filter((F.col("block") >= blocks[0]) & (F.col("block") < blocks[1]))


def log_mean_exp(terms: DataFrame, unit: str, draw: str, value: str) -> DataFrame:
    """(unit, n, log_mean): the logarithm of the mean over draws of exp(value), without overflow.

    Two steps: each block of a unit's draws gives its largest value and the sum of the others relative to it, and blocks
    are put together likewise. So a group holds 100 values, then a pair for each block. Null values don't count.
    """
    blocks = terms.filter(F.col(value).isNotNull()).groupBy(unit, F.floor(F.col(draw) / BLOCK).alias("_block")).agg(F.collect_list(value).alias("_v"))
    top = lambda c: F.greatest(F.array_max(c), F.lit(-1e308))  # noqa: E731  all may be minus infinity
    parts = blocks.select(unit, F.size("_v").alias("_n"), top("_v").alias("_m"), F.aggregate("_v", F.lit(0.0), lambda s, x: s + F.exp(x - top(F.col("_v")))).alias("_s"))
    by = parts.groupBy(unit).agg(F.sum("_n").alias("n"), F.collect_list(F.struct("_m", "_s")).alias("_p")).withColumn("_m", top(F.col("_p._m")))
    total = F.aggregate("_p", F.lit(0.0), lambda s, p: s + p["_s"] * F.exp(p["_m"] - F.col("_m")))
    return by.select(unit, "n", (F.col("_m") + F.when(total > 0, F.log(total)).otherwise(F.lit(float("-inf"))) - F.log("n")).alias("log_mean"))


def poisson_log(count: Column, mean: Column) -> Column:
    """Log Poisson mass without its term in the count alone, which draws share."""
    return F.when(mean > 0, count * F.log(mean) - mean).otherwise(F.when(count == 0, F.lit(0.0)).otherwise(F.lit(float("-inf"))))


def described(draws: DataFrame, at: list[float]) -> DataFrame:
    """(unit, q, value): exact quantiles of each unit's draws."""
    return exact_quantiles(draws, "value", at, ["unit"])
