"""Many two-sample contrasts of one outcome in grouped passes, with effects, p-values and q-values."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratefield.functions.special import t_two_sided
from ratefield.operators.order import range_of, step_up
from ratefield.operators.spatial import two_sided


@F.pandas_udf(T.DoubleType())
def t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t."""
    return pd.Series([None if pd.isna(a) or pd.isna(b) or b <= 0 else 0.0 if abs(a) == float("inf") else float(t_two_sided(a, b)) for a, b in zip(t, df, strict=True)])


def contrasts(df: DataFrame, outcome: str, drivers: dict[str, Column], ranges: int = 64) -> DataFrame:
    """A row for each driver, a condition that parts the rows: those where it holds (1) against those where it doesn't (2).

    driver, n1, n2, mean1, mean2; Welch's t, its degrees of freedom and p_t; Hedges' g; U of the first, rank_biserial, z
    by the normal approximation with the correction for ties, and p_u; q_t and q_u adjust each kind of p over all drivers
    (Benjamini-Hochberg). Rows without outcome, and where a condition is null, don't count. What a side of under two rows
    or no spread leaves open is null.

    Rows are exploded once to (driver, side, outcome). Moments are one grouped aggregation; ranks come from counts by
    value, cut into ranges of values, so that neither a driver nor a value has to be sorted by one task.
    """
    value = F.col(outcome).cast("double")
    sides = F.array(*[F.struct(F.lit(name).alias("driver"), condition.alias("first")) for name, condition in drivers.items()])
    rows = df.filter(value.isNotNull() & ~F.isnan(value)).select(value.alias("v"), F.explode(sides).alias("s")).select("s.driver", "s.first", "v").filter("first is not null")
    one, two = (F.when(F.col("first") if k else ~F.col("first"), F.col("v")) for k in (True, False))
    moments = rows.groupBy("driver").agg(F.count(one).alias("n1"), F.count(two).alias("n2"), F.avg(one).alias("mean1"), F.avg(two).alias("mean2"), F.var_samp(one).alias("v1"), F.var_samp(two).alias("v2"))
    n1, n2, v1, v2 = (F.col(c) for c in ("n1", "n2", "v1", "v2"))
    s1, s2, gap = v1 / n1, v2 / n2, F.col("mean1") - F.col("mean2")
    pooled = F.sqrt(F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2))
    tested = moments.withColumns(
        {
            "t": F.try_divide(gap, F.sqrt(s1 + s2)),
            "df": F.try_divide(F.pow(s1 + s2, 2), s1 * s1 / (n1 - 1) + s2 * s2 / (n2 - 1)),
            "hedges_g": F.try_divide(gap, pooled) * (1 - 3.0 / (4.0 * (n1 + n2) - 9)),
        }
    )
    counts = rows.groupBy("driver", "v").agg(F.count_if("first").alias("a"), F.count("*").alias("n"))
    at = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(df.select(F.percentile_approx(value, at, 10_000)).first()[0] or []))
    counts = counts.withColumn("piece", range_of(F.col("v"), bounds))
    # a row for each driver and range
    totals = counts.groupBy("driver", "piece").agg(F.sum("n").alias("m"))
    earlier = Window.partitionBy("driver").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("driver").alias("d"), F.col("piece").alias("p"), F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("driver", "piece").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("n").over(within)).join(F.broadcast(offsets), (F.col("driver") == F.col("d")) & (F.col("piece") == F.col("p")))
    n = F.col("n").cast("double")
    rank = F.col("offset") + F.col("upto") - n + (n + 1) / 2
    sums = ranked.groupBy("driver").agg(F.sum(F.col("a") * rank).alias("w"), F.sum(n * n * n - n).alias("ties"))
    both = tested.join(sums, "driver")
    u, total = F.col("w") - n1 * (n1 + 1) / 2, (n1 + n2).cast("double")
    spread = F.sqrt(n1 * n2 / 12 * (total + 1 - F.try_divide(F.col("ties"), total * (total - 1))))
    both = both.withColumns({"u": F.when(n1 * n2 > 0, u), "rank_biserial": F.try_divide(2 * u, n1 * n2) - 1, "z": F.try_divide(u - n1 * n2 / 2, spread)})
    both = both.withColumns({"p_t": t_tail("t", "df"), "p_u": F.when(F.col("z").isNotNull(), two_sided("z"))}).drop("v1", "v2", "w", "ties")
    return step_up(step_up(both, "p_t", "q_t"), "p_u", "q_u")
