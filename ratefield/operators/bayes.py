"""Spatial count models by a grid over hyperparameters: at each point a Laplace approximation (Rue, Martino and Chopin, 2009)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratefield.operators.graphs import undirected
from ratefield.operators.regress import nb_log_likelihood


def laplacian(n: int, pairs: np.ndarray) -> np.ndarray:
    q = np.zeros((n, n))
    for i, j in pairs:
        q[i, j] = -1.0
    return q - np.diag(q.sum(axis=1))


def scaling_factor(q: np.ndarray) -> float:
    """Geometric mean of the marginal variances of the ICAR prior with a sum of zero (Riebler et al., 2016)."""
    n = len(q)
    inverse = np.linalg.inv(q + np.ones((n, n)) / n) - np.ones((n, n)) / n
    return float(np.exp(np.log(np.maximum(np.diag(inverse), 1e-12)).mean()))


def laplace(y, x, offset, precision, alpha, prior_sd=2.0):
    """Mode, marginal standard deviations of the linear predictor, and log evidence, for a field of the given precision and coefficients N(0, prior_sd ** 2)."""
    n, p = len(y), x.shape[1]
    big = np.zeros((n + p, n + p))
    big[:n, :n], big[n:, n:] = precision, np.eye(p) / prior_sd**2
    a = np.column_stack([np.eye(n), x])
    mode = np.zeros(n + p)
    mode[n] = np.log(max(y.sum(), 0.5) / np.exp(offset).sum()) if p else 0.0
    for _ in range(200):
        mu = np.exp(np.clip(a @ mode + offset, -30, 30))
        grad = a.T @ ((y - mu) / (1 + alpha * mu)) - big @ mode
        w = mu * (1 + alpha * y) / (1 + alpha * mu) ** 2
        h = a.T @ (w[:, None] * a) + big
        step = np.linalg.solve(h, grad)
        mode = mode + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    mu = np.exp(np.clip(a @ mode + offset, -30, 30))
    evidence = nb_log_likelihood(y, mu, alpha).sum() - 0.5 * mode @ big @ mode + 0.5 * np.linalg.slogdet(big)[1] - 0.5 * np.linalg.slogdet(h)[1]
    spread = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", a, np.linalg.inv(h), a), 0))
    return a @ mode, spread, float(evidence)


def spatial_rates(units: DataFrame, edges: DataFrame, y: str, exposure: str, columns: list[str] = (), kind: str = "bym2", unit: float = 100_000.0) -> DataFrame:
    """Smoothed rates (node, median, low, high) of units (node, y, exposure, columns). kind: icar, bym2 or none.

    A task per point of the grid (sd, mixing, dispersion); points weigh by evidence and prior, and rates are read off the
    mixture of the points' normal approximations. Units are a table of areas, which each task holds whole.
    """
    spark = units.sparkSession
    table = units.select("node", y, exposure, *columns).orderBy("node").toPandas()
    place = {k: i for i, k in enumerate(table["node"])}
    pairs = np.array([(place[r[0]], place[r[1]]) for r in undirected(edges).collect()], int).reshape(-1, 2)
    n = len(table)
    q = laplacian(n, pairs)
    scale = scaling_factor(q) if kind != "none" and len(pairs) else 1.0
    covariates = table[list(columns)].to_numpy(float)
    if covariates.size:
        covariates = (covariates - covariates.mean(0)) / np.maximum(covariates.std(0, ddof=1), 1e-12)
    x = np.column_stack([np.ones(n), covariates]) if covariates.size else np.ones((n, 1))
    held = spark.sparkContext.broadcast((table[y].to_numpy(float), x, np.log(table[exposure].to_numpy(float) / table[exposure].sum() * n), q, scale))
    mixing = {"bym2": (0.1, 0.5, 0.9), "icar": (1.0,), "none": (0.0,)}[kind]
    grid = [(s, r, a) for s in (0.1, 0.25, 0.5, 1.0, 2.0) for r in mixing for a in (0.02, 0.1, 0.4)]

    def run(parts):
        y_, x_, offset, q_, scale_ = held.value
        n_ = len(y_)
        structured = (np.linalg.inv(q_ + np.ones((n_, n_)) / n_) - np.ones((n_, n_)) / n_) / scale_
        for part in parts:
            for s, r, a in zip(part["sd"], part["mixing"], part["alpha"], strict=True):
                cov = s * s * (r * structured + (1 - r) * np.eye(n_)) + 1e-6 * np.eye(n_)
                eta, spread, evidence = laplace(y_, x_, offset, np.linalg.inv(cov), a)
                # half-normal sd (scale 2), exponential dispersion, uniform mixing
                yield pd.DataFrame({"i": np.arange(n_), "weight": evidence - s * s / 8 - a, "eta": eta, "spread": spread})

    points = spark.createDataFrame(grid, "sd double, mixing double, alpha double").repartition(8)
    got = points.mapInPandas(run, "i long, weight double, eta double, spread double")
    top = got.agg(F.max("weight").alias("top"))
    mixed = got.crossJoin(F.broadcast(top)).withColumn("w", F.exp(F.col("weight") - F.col("top")))
    ids = spark.createDataFrame([(i, k) for k, i in place.items()], f"i long, node {units.schema['node'].dataType.simpleString()}")
    base = float(n / table[exposure].sum() * unit)

    def read(part: pd.DataFrame) -> pd.DataFrame:
        from ratefield.functions.special import normal_cdf

        w, m, s = part["w"].to_numpy() / part["w"].sum(), part["eta"].to_numpy(), np.maximum(part["spread"].to_numpy(), 1e-9)
        out = []
        for p in (0.025, 0.5, 0.975):
            low, high = (m - 12 * s).min(), (m + 12 * s).max()
            for _ in range(100):
                mid = 0.5 * (low + high)
                low, high = (mid, high) if (w * normal_cdf((mid - m) / s)).sum() < p else (low, mid)
            out.append(float(np.exp(0.5 * (low + high))) * base)
        return pd.DataFrame({"i": [part["i"].iloc[0]], "low": [out[0]], "median": [out[1]], "high": [out[2]]})

    return mixed.groupBy("i").applyInPandas(read, "i long, low double, median double, high double").join(F.broadcast(ids), "i").select("node", "median", "low", "high")
