"""Identities over several lists of one population, and what their overlaps say of its size."""

from __future__ import annotations

import functools
import math
import operator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratefield.functions.special import chi2_tail
from ratefield.operators.graphs import components, thinned
from ratefield.operators.rates import Z, chapman, history_counts, three_list_saturated
from ratefield.session import ensure_checkpoint_dir

CELLS = ["111", "110", "101", "011", "100", "010", "001"]


def paired(a: DataFrame, b: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """One-to-one pairs (a_id, b_id) of two lists by block: the n-th record of a block in one with the n-th in the other; null keys match nothing."""
    w = Window.partitionBy(*keys).orderBy(order, "id")
    left, right = (d.select(*keys, F.col("id").alias(f"{s}_id"), F.row_number().over(w).alias("_n")) for d, s in ((a, "a"), (b, "b")))
    return left.join(right, [*keys, "_n"]).select("a_id", "b_id")


def identities(lists: dict[str, DataFrame], matches: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """Records of several lists (id) joined into identities by pairwise matches (a_id, b_id).

    A row an identity: for each list its name (1 or 0), {name}_id (its least member there, or null) and n_{name} (its
    members there); and ambiguous: more than one record of one list came together, by a chain of matches. Matches that
    name records no list has are left out; a null id is no record. Repeated ids of a list are one record.
    """
    names = list(lists)
    node = lambda name, c: F.concat(F.lit(f"{names.index(name)}:"), F.col(c).cast("string"))
    spark = lists[names[0]].sparkSession
    ensure_checkpoint_dir(spark)
    records = functools.reduce(DataFrame.unionByName, [d.filter("id is not null").select(node(n, "id").alias("node"), F.lit(n).alias("list"), F.col("id")).distinct() for n, d in lists.items()]).checkpoint()
    edges = functools.reduce(DataFrame.unionByName, [m.select(node(a, "a_id").alias("src"), node(b, "b_id").alias("dst")) for (a, b), m in matches.items()]).filter("src is not null and dst is not null")
    there = records.select("node")
    edges = edges.join(there.withColumnRenamed("node", "src"), "src", "left_semi").join(there.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")
    parts = components(there, thinned(edges).checkpoint())
    measures = []
    for n in names:
        own = F.col("list") == n
        measures += [F.max(own.cast("int")).alias(n), F.min(F.when(own, F.col("id"))).alias(f"{n}_id"), F.count_if(own).alias(f"n_{n}")]
    out = records.join(parts, "node").groupBy("component").agg(*measures).drop("component")
    return out.withColumn("ambiguous", functools.reduce(operator.or_, [F.col(f"n_{n}") > 1 for n in names]))


def independence(n: dict[str, float], steps: int = 100) -> dict[str, float]:
    """The three-list model without interactions, by Newton's method on its four terms.

    unseen with its 95 % interval (on the log scale, from the information matrix), the likelihood-ratio statistic against
    the saturated model (3 degrees of freedom) and its p-value.
    """
    x = np.array([[1.0, *map(float, c)] for c in CELLS])
    y = np.array([float(n[c]) for c in CELLS])
    beta = np.array([math.log(max(y.mean(), 1e-9)), 0.0, 0.0, 0.0])
    for _ in range(steps):
        mu = np.exp(x @ beta)
        step = np.linalg.lstsq(x.T @ (mu[:, None] * x), x.T @ (y - mu), rcond=None)[0]
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-12:
            break
    mu = np.exp(x @ beta)
    # where cells without records leave a term open, rounding can take the variance below zero: it is endless then
    variance = np.linalg.pinv(x.T @ (mu[:, None] * x), hermitian=True)[0, 0]
    se = math.sqrt(variance) if variance >= 0 else math.inf
    ratio = 2 * float(np.where(y > 0, y * np.log(np.maximum(y, 1e-300) / mu), 0.0).sum() - (y - mu).sum())
    with np.errstate(over="ignore"):  # where cells without records leave a term open, the interval is endless
        low, mid, high = np.exp([beta[0] - Z * se, beta[0], beta[0] + Z * se]).tolist()
    return {"unseen": mid, "unseen_low": low, "unseen_high": high, "lr": ratio, "lr_p": float(chi2_tail(ratio, 3))}


def report(found: DataFrame, lists: list[str], truth: float | None = None) -> DataFrame:
    """One row on three lists: sizes, identities, ambiguous ones, overlaps, Chapman's estimate of each pair, both log-linear models and their errors against a known total.

    A cell without an identity makes what divides by it null. Only the seven cells go through the driver.
    """
    a, b, c = lists
    cells = history_counts(found, lists)
    sizes = found.agg(*[F.sum(f"n_{n}").alias(f"records_{n}") for n in lists], *[F.sum(n).alias(f"size_{n}") for n in lists], F.count("*").alias("identities"), F.count_if("ambiguous").alias("ambiguous"))
    both = cells.crossJoin(F.broadcast(sizes))
    for x, y in ((a, b), (a, c), (b, c)):
        met = functools.reduce(operator.add, [F.col(f"n_{k}") for k in CELLS if all(k[lists.index(n)] == "1" for n in (x, y))])
        estimate, se = chapman(F.col(f"records_{x}"), F.col(f"records_{y}"), met)
        both = both.withColumns({f"both_{x}_{y}": met, f"chapman_{x}_{y}": estimate, f"chapman_{x}_{y}_se": se})
    full = three_list_saturated(cells).select(F.col("population").alias("saturated"), F.col("low").alias("saturated_low"), F.col("high").alias("saturated_high"), "unseen")
    full = full.crossJoin(F.broadcast(cells))
    n = lambda k: F.col(f"n_{k}").cast("double")
    terms = {f"term_{x}_{y}": F.log(F.try_divide(n(pair) * F.col("unseen"), n(one) * n(two))) for x, y, pair, one, two in ((a, b, "110", "100", "010"), (a, c, "101", "100", "001"), (b, c, "011", "010", "001"))}
    both = both.crossJoin(F.broadcast(full.select("saturated", "saturated_low", "saturated_high", *[v.alias(k) for k, v in terms.items()])))
    counts = cells.first()
    fit = independence({k: counts[f"n_{k}"] for k in CELLS}) if any(counts) else {}
    number = lambda v: F.lit(None if v is None else float(v)).cast("double")
    both = both.withColumns({"independent" + k.removeprefix("unseen"): F.col("identities") + number(fit.get(k)) for k in ("unseen", "unseen_low", "unseen_high")})
    both = both.withColumns({k: number(fit.get(k)) for k in ("lr", "lr_p")}).withColumn("lr_df", F.lit(3))
    models = {"chapman": F.col(f"chapman_{a}_{b}"), "independent": F.col("independent"), "saturated": F.col("saturated")}
    both = both.withColumn("truth", number(truth)).withColumns({f"error_{k}": v - number(truth) for k, v in models.items()})
    return both.withColumn("better_than_two_lists", F.abs("error_saturated") < F.abs("error_chapman"))
