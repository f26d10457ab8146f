"""Special functions over numpy arrays: what Spark has no built-in for."""

from __future__ import annotations

import math

import numpy as np

_erf = np.vectorize(math.erf, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])
log_gamma = np.vectorize(math.lgamma, otypes=[float])


def normal_cdf(x):
    return 0.5 * _erfc(-np.asarray(x, float) / math.sqrt(2))


def normal_quantile(p):
    """Newton steps on the distribution function from a logistic start; exact to rounding."""
    p = np.asarray(p, float)
    x = np.log(p / (1 - p)) / 1.702
    for _ in range(30):
        density = np.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)
        step = np.clip((normal_cdf(x) - p) / np.maximum(density, 1e-300), -1, 1)
        x = x - step
    return x


def gamma_cdf(a, x):
    """The regularised lower incomplete gamma function P(a, x): the series for small x, Lentz's continued fraction else."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.zeros(a.shape)
    small = (x > 0) & (x < a + 1)
    large = (x > 0) & ~small
    front = np.where(x > 0, np.exp(a * np.log(np.where(x > 0, x, 1.0)) - x - log_gamma(a)), 0.0)
    if small.any():
        aa, xx = a[small], x[small]
        term = 1 / aa
        total, k = term.copy(), aa.copy()
        for _ in range(200_000):
            k += 1
            term = term * xx / k
            total += term
            if (np.abs(term) < np.abs(total) * 1e-16).all():
                break
        out[small] = total * front[small]
    if large.any():
        aa, xx = a[large], x[large]
        b = xx + 1 - aa
        c, d = np.full(aa.shape, 1e300), 1 / b
        h = d.copy()
        for i in range(1, 200_000):
            an = -i * (i - aa)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = b + an / c
            c = np.where(np.abs(c) < 1e-300, 1e-300, c)
            step = d * c
            h = h * step
            if (np.abs(step - 1) < 1e-15).all():
                break
        out[large] = 1 - front[large] * h
    return out


def gamma_quantile(p, a):
    """The x with P(a, x) = p: Wilson and Hilferty's start, then Newton steps kept within a bracket."""
    p, a = np.broadcast_arrays(np.asarray(p, float), np.asarray(a, float))
    z = normal_quantile(p)
    x = a * np.maximum(1 - 1 / (9 * a) + z / (3 * np.sqrt(a)), 0) ** 3
    tiny = np.exp((np.log(p) + log_gamma(a + 1)) / a)
    x = np.where((a < 1) | (x <= 0), np.maximum(tiny, 1e-300), x)
    low, high = np.zeros(a.shape), np.maximum(np.maximum(x, a) * 4 + 100, 1e-300)
    for _ in range(200):
        f = gamma_cdf(a, x) - p
        low, high = np.where(f < 0, x, low), np.where(f >= 0, x, high)
        density = np.exp((a - 1) * np.log(np.maximum(x, 1e-300)) - x - log_gamma(a))
        new = x - f / np.maximum(density, 1e-300)
        new = np.where((new > low) & (new < high), new, 0.5 * (low + high))
        if (np.abs(new - x) <= 1e-14 * np.maximum(x, 1e-300)).all():
            x = new
            break
        x = new
    return x


def chi2_tail(x, df):
    return 1 - gamma_cdf(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def beta_cdf(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 2000):
        for an in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + an * d)
            c = 1 + an / c
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / 2, 0.5, df / (df + t * t))


def digamma(x):
    """The derivative of log_gamma for positive x: recurrence to 10 and beyond, then the asymptotic series."""
    x = np.array(x, float)
    out = np.zeros(x.shape)
    while (x < 10).any():
        low = x < 10
        out = np.where(low, out - 1 / x, out)
        x = np.where(low, x + 1, x)
    q = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - q * (1 / 12 - q * (1 / 120 - q * (1 / 252 - q * (1 / 240 - q / 132))))


def trigamma(x):
    """The second derivative of log_gamma for positive x."""
    x = np.array(x, float)
    out = np.zeros(x.shape)
    while (x < 10).any():
        low = x < 10
        out = np.where(low, out + 1 / (x * x), out)
        x = np.where(low, x + 1, x)
    q = 1 / (x * x)
    return out + 1 / x + q / 2 + q / x * (1 / 6 - q * (1 / 30 - q * (1 / 42 - q * (1 / 30 - q * 5 / 66))))
