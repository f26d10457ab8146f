"""Event rates: assembly, Poisson-Gamma shrinkage, coverage correction, and population estimates from lists."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratefield.functions.special import gamma_quantile
from ratefield.operators.tables import rate_per


def group_counts(df: DataFrame, key: str, out: str) -> DataFrame:
    """Rows per key; rows without a key don't count."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(out))


def assemble(spine: DataFrame, key: str, parts: list[DataFrame]) -> DataFrame:
    """Left-join count tables onto the spine of units; a unit without rows counts 0."""
    filled = []
    for part in parts:
        spine = spine.join(part, key, "left")
        filled += [c for c in part.columns if c != key]
    return spine.fillna(0, subset=filled)


def poisson_gamma_prior(df: DataFrame, count: str, exposure: str) -> DataFrame:
    """One row (units, mean, variance, shape, rate): the prior of rates by moments (Marshall, 1991).

    The variance of the true rates is the exposure-weighted variance of the raw ones less what Poisson counts add;
    where that isn't positive it is mean ** 2 / 1e6, which shrinks all the way. Two passes, as one would cancel badly.
    Where no unit has a count, shape and rate are null.
    """
    y, n = F.col(count).cast("double"), F.col(exposure).cast("double")
    sums = df.agg(F.count("*").alias("units"), F.sum(y).alias("_y"), F.sum(n).alias("_n")).withColumn("mean", F.try_divide("_y", "_n"))
    spread = df.crossJoin(F.broadcast(sums)).groupBy("units", "mean", "_n").agg(F.sum(n * F.pow(F.try_divide(y, n) - F.col("mean"), 2)).alias("_q"))
    out = spread.withColumn("variance", F.col("_q") / F.col("_n") - F.col("mean") / (F.col("_n") / F.col("units")))
    out = out.withColumn("variance", F.when(F.col("variance") > 0, F.col("variance")).otherwise(F.col("mean") * F.col("mean") / 1e6))
    out = out.withColumn("shape", F.try_divide(F.col("mean") * F.col("mean"), "variance")).withColumn("rate", F.try_divide("mean", "variance"))
    return out.select("units", "mean", "variance", "shape", "rate")


def log_gamma(x: Column) -> Column:
    """The logarithm of the Gamma function of a positive number, by Stirling's series eight steps up."""
    z = x + 8
    series = (z - 0.5) * F.log(z) - z + math.log(2 * math.pi) / 2 + 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5)) - 1 / (1680 * F.pow(z, 7))
    for i in range(8):
        series = series - F.log(x + i)
    return series


def log_sum_exp(values: Column) -> Column:
    """log(sum(exp(x))) of an array, scaled by its largest value."""
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda s, v: s + F.exp(v - top)))


#: Steps of the grid of rates, which is even in their logarithm.
GRID_STEPS = 480


def held_out_log_density(train: DataFrame, test: DataFrame, count: str, exposure: str) -> DataFrame:
    """Adds to test the log predictive density of each count under the prior that train gives: lpd and lpd_grid.

    lpd is the negative binomial's closed form; lpd_grid sums the Poisson densities over a grid of rates, weighted by the
    prior, and serves where no closed form exists. The grid reaches six of the prior's deviations from its mean, and as far
    down as a Gamma's lower tail has mass that counts, 12 / shape further. Both are null if no unit of train has a count. A unit far beyond the
    prior, or with counts that tell much more than it, lies between or beyond the grid's points: there lpd alone holds.
    """
    y, n = F.col(count).cast("double"), F.col(exposure).cast("double")
    steps = F.lit([i / GRID_STEPS for i in range(GRID_STEPS + 1)])
    prior = poisson_gamma_prior(train, count, exposure).select(F.col("mean").alias("_m"), F.col("shape").alias("_a"), F.col("rate").alias("_b"))
    high = 6 / F.sqrt("_a")
    low = -high - 12 / F.col("_a")
    prior = prior.withColumn("_rates", F.transform(steps, lambda z: F.col("_m") * F.exp(low + z * (high - low))))
    # a weight is the density times the step, which is in proportion to the rate
    weight = lambda r: F.col("_a") * F.log(r) - F.col("_b") * r
    prior = prior.withColumn("_total", log_sum_exp(F.transform("_rates", weight)))
    a, b = F.col("_a"), F.col("_b")
    closed = log_gamma(y + a) - log_gamma(a) - log_gamma(y + 1) + a * F.log(b / (b + n)) + y * F.log(n / (b + n))
    grid = log_sum_exp(F.transform("_rates", lambda r: weight(r) + y * F.log(r * n) - r * n)) - F.col("_total") - log_gamma(y + 1)
    return test.crossJoin(F.broadcast(prior)).withColumns({"lpd": closed, "lpd_grid": grid}).drop("_m", "_a", "_b", "_rates", "_total")


def check_exposures(df: DataFrame, exposure: str) -> None:
    """Raise unless there are two units or more, all with a positive exposure."""
    n, least = df.agg(F.count("*"), F.min(F.coalesce(F.col(exposure).cast("double"), F.lit(0.0)))).first()
    if n < 2:
        raise ValueError("shrinkage needs at least 2 units")
    if least <= 0:
        raise ValueError("exposures must be strictly positive")


@F.pandas_udf(T.DoubleType())
def _quantile(p: pd.Series, shape: pd.Series, rate: pd.Series) -> pd.Series:
    return pd.Series(gamma_quantile(p.to_numpy(), shape.to_numpy()) / rate.to_numpy())


def shrink(df: DataFrame, count: str, exposure: str, interval: bool = True, unit: float = 100_000.0) -> DataFrame:
    """Adds shrunken_rate (posterior mean, per unit) and, if wanted, the exact 95 % interval (shrunken_low, shrunken_high).

    One unit alone, and an exposure that is missing or not above 0, fail the job (what check_exposures raises beforehand).
    """
    prior = poisson_gamma_prior(df, count, exposure).crossJoin(F.broadcast(df.agg(F.min(F.coalesce(F.col(exposure).cast("double"), F.lit(0.0))).alias("_least"))))
    wrong = lambda text: F.raise_error(F.lit(text)).cast("double")
    shape = F.when(F.col("units") < 2, wrong("shrinkage needs at least 2 units")).when(F.col("_least") <= 0, wrong("exposures must be strictly positive")).otherwise(F.col("shape"))
    prior = prior.select(shape.alias("_shape"), F.col("rate").alias("_rate"))
    both = df.crossJoin(F.broadcast(prior)).withColumn("_a", F.col("_shape") + F.col(count)).withColumn("_b", F.col("_rate") + F.col(exposure))
    out = both.withColumn("shrunken_rate", F.col("_a") / F.col("_b") * unit)
    if interval:
        for name, p in (("shrunken_low", 0.025), ("shrunken_high", 0.975)):
            out = out.withColumn(name, _quantile(F.lit(p), "_a", "_b") * unit)
    return out.drop("_shape", "_rate", "_a", "_b")


#: The pooled coverage, its spread between groups on the log scale, the slope on log density and its centre.
POOLED, BETWEEN_VARIANCE, SLOPE, CENTRE, Z = 0.610, 0.1062, 0.062, 4.876, 1.96


def correct_coverage(df: DataFrame, group: str, count: str, calibrated: DataFrame, log_density: str | None = None) -> DataFrame:
    """Correct counts for coverage. calibrated: (group, capture_rate).

    A calibrated group's rate, at most 1, is certain: it has no interval. Others get the pooled rate, moved by the log
    density where that is known, with an interval of the spread between groups; all of these are at most 1. Adds
    coverage, coverage_low, coverage_high, coverage_source, corrected, corrected_low, corrected_high.
    """
    known = calibrated.select(group, F.col("capture_rate").cast("double").alias("_known"))
    shift = F.coalesce(F.lit(SLOPE) * (F.col(log_density) - CENTRE), F.lit(0.0)) if log_density else F.lit(0.0)
    sd = BETWEEN_VARIANCE**0.5
    guess = F.log(F.lit(POOLED)) + shift
    pooled = F.col("_known").isNull()
    out = df.join(known, group, "left").withColumns(
        {
            "coverage": F.least(F.lit(1.0), F.coalesce(F.col("_known"), F.exp(guess))),
            "coverage_low": F.when(pooled, F.least(F.lit(1.0), F.exp(guess - Z * sd))),
            "coverage_high": F.when(pooled, F.least(F.lit(1.0), F.exp(guess + Z * sd))),
            "coverage_source": F.when(pooled, "pooled").otherwise("calibrated"),
        }
    )
    n = F.col(count)
    return out.withColumns({"corrected": n / F.col("coverage"), "corrected_low": n / F.col("coverage_high"), "corrected_high": n / F.col("coverage_low")}).drop("_known")


def chapman(n1: Column, n2: Column, m: Column) -> tuple[Column, Column]:
    """Chapman's two-list estimate of a population and its standard error."""
    a, b, c = n1.cast("double"), n2.cast("double"), m.cast("double")
    return (a + 1) * (b + 1) / (c + 1) - 1, F.sqrt((a + 1) * (b + 1) * (a - c) * (b - c) / ((c + 1) * (c + 1) * (c + 2)))


def history_counts(df: DataFrame, lists: list[str]) -> DataFrame:
    """One row with the count of each capture history but that of no capture: n_111 and so on."""
    cells = []
    for i in range(1, 2 ** len(lists)):
        bits = [(i >> (len(lists) - 1 - j)) & 1 for j in range(len(lists))]
        match = F.lit(True)
        for name, bit in zip(lists, bits, strict=True):
            match = match & (F.col(name) == bit)
        cells.append(F.count_if(match).alias("n_" + "".join(map(str, bits))))
    return df.agg(*cells)


def three_list_saturated(cells: DataFrame) -> DataFrame:
    """The three-list log-linear model with all pairwise terms: the unseen cell in closed form, the population and its log-scale 95 % interval."""
    c = {k: F.col(f"n_{k}").cast("double") for k in ("111", "110", "101", "011", "100", "010", "001")}
    unseen = F.try_divide(c["111"] * c["100"] * c["010"] * c["001"], c["110"] * c["101"] * c["011"])
    spread = F.sqrt(sum((F.try_divide(F.lit(1.0), x) for x in c.values()), F.lit(0.0)))
    out = cells.withColumn("seen", sum((F.col(x) for x in cells.columns), F.lit(0))).withColumn("unseen", unseen).withColumn("log_se", spread)
    return out.withColumns({"population": F.col("seen") + F.col("unseen"), "low": F.col("seen") + F.col("unseen") * F.exp(-Z * F.col("log_se")), "high": F.col("seen") + F.col("unseen") * F.exp(Z * F.col("log_se"))})


def residual_ratio(y: Column, expected: Column, alpha: float) -> Column:
    """Observed over expected, shrunk by the Gamma mixing of a negative binomial with dispersion alpha."""
    return (1 / F.lit(alpha) + y) / (1 / (F.lit(alpha) * expected) + 1) / expected


def ranked_rates(units: DataFrame, key: str, count: str, exposure: str, floor: float = 0.0) -> DataFrame:
    """The headline table: raw and shrunken rates of units over a floor, ranked."""
    from ratefield.operators.ranking import with_rank

    shrunk = shrink(units.filter(F.col(exposure) > 0), count, exposure, interval=False)
    shrunk = shrunk.withColumn("raw_rate", rate_per(F.col(count), F.col(exposure))).filter(F.col(exposure) >= floor)
    return with_rank(with_rank(shrunk, "raw_rate", "raw_rank"), "shrunken_rate", "shrunken_rank")
