"""The incomplete beta function, hypergeometric and binomial probabilities, without scipy."""

from __future__ import annotations

from math import exp, lgamma, log, log1p, sqrt

import numpy as np


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x)) / a

    def step(i: int) -> float:
        m = i // 2
        if i % 2:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))

    c, d = 1.0, 1.0 / (1.0 + step(1))
    f = d
    for i in range(2, 1000):
        s = step(i)
        d, c = 1.0 / (1.0 + s * d), 1.0 + s / c
        f *= c * d
        if abs(1.0 - c * d) < 1e-16:
            break
    return front * f


def beta_quantile(p: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if incomplete_beta(a, b, mid) < p:
            lo = mid
        else:
            hi = mid
        if hi - lo < 1e-16:
            break
    return (lo + hi) / 2


def log_choose(n: int, k: int) -> float:
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """P of all tables with the margins of [[a, b], [c, d]] that are no more likely than it."""
    row, col, n = a + b, a + c, a + b + c + d
    base = log_choose(n, col)
    p = lambda k: exp(log_choose(row, k) + log_choose(n - row, col - k) - base)
    limit = p(a) * (1 + 1e-7)
    return min(1.0, sum(q for k in range(max(0, col - (n - row)), min(row, col) + 1) if (q := p(k)) <= limit))


def jeffreys(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Interval of a share from Beta(k + 1/2, n - k + 1/2); 0 below for k = 0, 1 above for k = n, NaN for n = 0."""
    if n == 0:
        return float("nan"), float("nan")
    tail = (1 - level) / 2
    low = 0.0 if k == 0 else beta_quantile(tail, k + 0.5, n - k + 0.5)
    high = 1.0 if k == n else beta_quantile(1 - tail, k + 0.5, n - k + 0.5)
    return low, high


def binomial_quantiles(n: int, p: float, u: np.ndarray) -> np.ndarray:
    """For each u the least k whose binomial distribution function reaches it.

    The function is summed within 12 standard deviations of the mean, beyond which nothing is left of it.
    """
    if n == 0 or p <= 0 or p >= 1:
        return np.full(len(u), n if n and p >= 1 else 0)
    reach = 12 * sqrt(n * p * (1 - p)) + 12
    lo, hi = max(0, int(n * p - reach)), min(n, int(n * p + reach) + 1)
    terms = [exp(log_choose(n, k) + k * log(p) + (n - k) * log1p(-p)) for k in range(lo, hi + 1)]
    return lo + np.minimum(np.searchsorted(np.cumsum(terms), u, side="left"), hi - lo)
