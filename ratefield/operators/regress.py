"""Regression: closed forms and iterated fits from sums that partitions add up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratefield.functions.special import digamma, log_gamma, trigamma
from ratefield.session import ensure_checkpoint_dir


def ols(df: DataFrame, y: str, x: str) -> DataFrame:
    return df.agg(F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def ols_within(df: DataFrame, y: str, x: str, group: str) -> DataFrame:
    """Slope with a fixed effect for each group: both sides less their group means."""
    w = Window.partitionBy(group)
    d = df.dropna(subset=[y, x, group]).select((F.col(y) - F.avg(y).over(w)).alias("_y"), (F.col(x) - F.avg(x).over(w)).alias("_x"))
    return d.agg(F.count("*").alias("n"), F.try_divide(F.sum(F.col("_x") * F.col("_y")), F.sum(F.col("_x") * F.col("_x"))).alias("slope"))


def _sums(w, x, y):
    return [F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * y).alias("wy"), F.sum(w * x * x).alias("wxx"), F.sum(w * x * y).alias("wxy")]


def _line(w, wx, wy, wxx, wxy):
    slope = F.try_divide(w * wxy - wx * wy, w * wxx - wx * wx)
    return slope, F.try_divide(wy - slope * wx, w)


def wls(df: DataFrame, y: str, x: str, weight: str) -> DataFrame:
    slope, intercept = _line(*(F.col(c) for c in ("w", "wx", "wy", "wxx", "wxy")))
    return df.agg(*_sums(F.col(weight).cast("double"), F.col(x), F.col(y))).select(slope.alias("slope"), intercept.alias("intercept"))


def leave_one_group_out_wls(df: DataFrame, y: str, x: str, weight: str, group: str) -> DataFrame:
    """Each group's line from all other groups, in one pass: sums of all less those of the group."""
    by = df.groupBy(group).agg(*_sums(F.col(weight).cast("double"), F.col(x), F.col(y)))
    names = ("w", "wx", "wy", "wxx", "wxy")
    # groups are few: the whole is one row
    whole = by.agg(*[F.sum(c).alias(f"t{c}") for c in names])
    both = by.crossJoin(F.broadcast(whole))
    slope, intercept = _line(*(F.col(f"t{c}") - F.col(c) for c in names))
    return both.select(group, slope.alias("slope"), intercept.alias("intercept"))


def holdout(df: DataFrame, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds held_out by a hash of the key, so that a unit's side doesn't depend on the others; any engine with MD5 finds the same."""
    mark = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))
    return df.withColumn("held_out", mark < f"{round(share * 16**8):08x}")


def nb_log_likelihood(y, mu, alpha):
    """Log density of the negative binomial with mean mu and variance mu + alpha mu ** 2."""
    y, mu = np.asarray(y, float), np.asarray(mu, float)
    r = 1.0 / alpha
    return log_gamma(y + r) - log_gamma(r) - log_gamma(y + 1) + r * np.log(r / (r + mu)) + y * np.log(mu / (r + mu))


#: log dispersion: bounds of the search, and where it begins.
_LOW, _HIGH, _BEGIN = -9.0, 4.0, -1.0


def _nb_sums(part: pd.DataFrame, y: str, columns: list[str], exposure: str, group: str, groups: list, fits: dict) -> Iterator[tuple[int, int, float]]:
    """(fit, place, value): over a batch, the log-likelihood of each fit, its slopes and curvatures."""
    of = {g: i for i, g in enumerate(groups)}
    g = np.array([of[v] for v in part[group]])
    x, count, offset = part[columns].to_numpy(float), part[y].to_numpy(float), np.log(part[exposure].to_numpy(float))
    k, p = len(columns), len(columns) + len(groups)
    for fit, (left, beta, log_alpha) in fits.items():
        use = np.ones(len(g), bool) if left is None else g != left
        gg, xx, yy = g[use], x[use], count[use]
        mu = np.exp(np.clip(xx @ beta[:k] + beta[k:][gg] + offset[use], -30, 30))
        alpha = np.exp(log_alpha)
        r = 1 / alpha
        w, z = mu / (1 + alpha * mu), (yy - mu) / (1 + alpha * mu)
        # only the design's blocks that aren't 0: covariates by covariates, by groups, and the groups' diagonal
        hess = np.zeros((p, p))
        hess[:k, :k] = xx.T @ (w[:, None] * xx)
        for j in range(k):
            hess[j, k:] = hess[k:, j] = np.bincount(gg, weights=w * xx[:, j], minlength=len(groups))
        hess[range(k, p), range(k, p)] = np.bincount(gg, weights=w, minlength=len(groups))
        grad = np.concatenate([xx.T @ z, np.bincount(gg, weights=z, minlength=len(groups))])
        by_r = digamma(yy + r) - digamma(r) + np.log(r / (r + mu)) + 1 - (r + yy) / (r + mu)
        by_r2 = trigamma(yy + r) - trigamma(r) + 1 / r - 2 / (r + mu) + (r + yy) / (r + mu) ** 2
        of_alpha = [-r * by_r.sum(), (r * r * by_r2 + r * by_r).sum()]
        for i, v in enumerate([nb_log_likelihood(yy, mu, alpha).sum(), *of_alpha, *grad, *hess.ravel()]):
            yield fit, i, float(v)


def _nb_fits(df: DataFrame, y: str, columns: list[str], exposure: str, group: str, lefts: list, turns: int = 200) -> tuple[list, list[tuple[np.ndarray, float, float]]]:
    """Groups, and for each group left out (None: none) coefficients, log dispersion and log-likelihood.

    Scoring steps for the coefficients and Newton steps for the log dispersion, halved where the likelihood falls. Each
    turn is one pass: partitions add up slopes and curvatures of all fits, Spark adds those up, and the driver gets a
    number for each pair of terms. Rows stay where they are.
    """
    rows = df.select(y, *columns, exposure, group)
    ensure_checkpoint_dir(df.sparkSession)
    rows = rows.checkpoint()
    totals = {r[0]: (r[1], r[2]) for r in rows.groupBy(group).agg(F.sum(y), F.sum(exposure)).collect()}
    groups = sorted(totals)
    k, p = len(columns), len(columns) + len(groups)
    start = np.concatenate([np.zeros(k), [np.log(max(totals[g][0], 0.5) / totals[g][1]) for g in groups]])
    now = {i: (None if g is None else groups.index(g), start, _BEGIN) for i, g in enumerate(lefts)}
    # fit: its best point with likelihood and step, and the share of the step being tried
    best: dict[int, tuple] = {}
    tried, open_ = dict.fromkeys(now, 1.0), set(now)
    for _ in range(turns):
        asked = {i: now[i] for i in open_}

        def run(parts, asked=asked):
            for part in parts:
                yield pd.DataFrame(_nb_sums(part, y, columns, exposure, group, groups, asked), columns=["fit", "place", "value"])

        sums: dict[int, np.ndarray] = {i: np.zeros(3 + p + p * p) for i in open_}
        for r in rows.mapInPandas(run, "fit int, place int, value double").groupBy("fit", "place").agg(F.sum("value").alias("value")).collect():
            sums[r["fit"]][r["place"]] = r["value"]
        for i in list(open_):
            left, beta, log_alpha = now[i]
            ll, slope, curve = sums[i][:3]
            if i in best and ll < best[i][2] - 1e-9 * (1 + abs(ll)) and tried[i] > 1e-4:
                tried[i] /= 2
            else:
                grad, hess = sums[i][3 : 3 + p], sums[i][3 + p :].reshape(p, p)
                step = np.clip(np.linalg.lstsq(hess + 1e-10 * np.eye(p), grad, rcond=None)[0], -5, 5)
                # towards the top where the curve bends down, else along the slope
                move = float(np.clip(-slope / curve if curve < 0 else np.sign(slope) * 0.5, -1, 1))
                move = min(max(log_alpha + move, _LOW), _HIGH) - log_alpha
                if i in best and tried[i] <= 1e-4 or max(np.abs(step).max(initial=0), abs(move)) < 1e-9:
                    best[i] = (beta, log_alpha, ll, step, move)
                    open_.discard(i)
                    continue
                best[i], tried[i] = (beta, log_alpha, ll, step, move), 1.0
            beta, log_alpha, _, step, move = best[i]
            now[i] = (left, beta + tried[i] * step, log_alpha + tried[i] * move)
        if not open_:
            break
    return groups, [(best[i][0], best[i][1], best[i][2]) for i in range(len(lefts))]


def nb_regression(df: DataFrame, y: str, columns: list[str], exposure: str, group: str) -> DataFrame:
    """Rows (term, value) of a negative binomial regression with group effects: covariates, groups, alpha and log_likelihood."""
    groups, [(beta, log_alpha, ll)] = _nb_fits(df, y, columns, exposure, group, [None])
    rows = [*zip([*columns, *map(str, groups)], map(float, beta), strict=True), ("alpha", float(np.exp(log_alpha))), ("log_likelihood", float(ll))]
    return df.sparkSession.createDataFrame(rows, "term string, value double")


def nb_leave_group_out(df: DataFrame, key: str, y: str, columns: list[str], exposure: str, group: str) -> DataFrame:
    """Predictions of each group's areas from a fit without it; an unseen group's effect is the mean of the others'.

    All fits share their passes over the table; a prediction is made where its row lies.
    """
    names = sorted(r[0] for r in df.select(group).distinct().collect())
    groups, fits = _nb_fits(df, y, columns, exposure, group, names)
    k = len(columns)
    effects = {g: (beta[:k], np.delete(beta[k:], groups.index(g)).mean(), np.exp(log_alpha)) for g, (beta, log_alpha, _) in zip(names, fits, strict=True)}
    kind = df.schema[key].dataType.simpleString()

    def run(parts):
        for part in parts:
            own = [effects[g] for g in part[group]]
            line = np.array([x @ b + level for x, (b, level, _) in zip(part[columns].to_numpy(float), own, strict=True)])
            mu = np.exp(line) * part[exposure].to_numpy(float)
            alpha = np.array([e[2] for e in own])
            yield pd.DataFrame({key: part[key], "fold": part[group].astype(str), "observed": part[y].astype(float), "expected": mu, "log_density": nb_log_likelihood(part[y], mu, alpha)})

    return df.select(key, y, *columns, exposure, group).mapInPandas(run, f"{key} {kind}, fold string, observed double, expected double, log_density double")


def random_intercept_reml(df: DataFrame, y: str, x: str, group: str) -> DataFrame:
    """One row (slope, intercept, residual variance, group variance) of y on x with a random intercept per group, by REML.

    Each group's six sums are all that the likelihood needs; a search over the variance ratio runs on them, a row a group.
    """
    sums = df.dropna(subset=[y, x, group]).groupBy(group).agg(F.count("*").alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(F.col(x) * F.col(x)).alias("xx"), F.sum(F.col(x) * F.col(y)).alias("xy"), F.sum(F.col(y) * F.col(y)).alias("yy"))

    def run(s: pd.DataFrame) -> pd.DataFrame:
        n, sx, sy, sxx, sxy, syy = (s[c].to_numpy(float) for c in ("n", "x", "y", "xx", "xy", "yy"))

        def profile(log_ratio):
            c = np.exp(log_ratio) / (1 + np.exp(log_ratio) * n)
            a = np.array([[(n - c * n * n).sum(), (sx - c * n * sx).sum()], [(sx - c * n * sx).sum(), (sxx - c * sx * sx).sum()]])
            b = np.array([(sy - c * n * sy).sum(), (sxy - c * sx * sy).sum()])
            beta = np.linalg.solve(a, b)
            rss = (syy - c * sy * sy).sum() - b @ beta
            df_ = n.sum() - 2
            return -0.5 * (df_ * np.log(rss / df_) + np.log1p(np.exp(log_ratio) * n).sum() + np.linalg.slogdet(a)[1]), beta, rss / df_

        grid = np.linspace(-12, 6, 181)
        at = grid[int(np.argmax([profile(g)[0] for g in grid]))]
        fine = np.linspace(at - 0.1, at + 0.1, 201)
        at = fine[int(np.argmax([profile(g)[0] for g in fine]))]
        _, beta, sigma2 = profile(at)
        return pd.DataFrame({"intercept": [beta[0]], "slope": [beta[1]], "residual_variance": [sigma2], "group_variance": [sigma2 * np.exp(at)]})

    return sums.groupBy(F.lit(0).alias("_all")).applyInPandas(lambda p: run(p), "intercept double, slope double, residual_variance double, group_variance double")
