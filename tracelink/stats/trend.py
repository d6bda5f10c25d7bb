"""Logistic regression with errors clustered by a key."""

from __future__ import annotations

from collections.abc import Sequence
from math import erfc, exp, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = "term string, estimate double, error double, z double, p double, odds_ratio double, low double, high double, n long, clusters long"


def _linear(weights: Sequence[float], names: Sequence[str]) -> Column:
    return sum((F.col(c) * float(w) for c, w in zip(names, weights[1:])), F.lit(float(weights[0])))


def logistic_trend(rows: DataFrame, y: str, x: Sequence[str] | str, cluster: str, steps: int = 30, tolerance: float = 1e-10) -> DataFrame:
    """A row for the intercept and each predictor of the 0/1 (or boolean) column y: estimate, clustered error, z, p, odds ratio and its 95 %
    interval, with the numbers of rows and clusters.

    Rows with a null in any of the columns are left out. Rows are counted once per combination of predictors; a Newton step
    is one aggregate over these cells, of which the driver gets the few sums X'WX and X'r. The error is a sandwich over the
    scores' sums per cluster, times G / (G - 1) and (n - 1) / (n - k). Predictors are centred and scaled for the steps and turned
    back. Where there is no estimate (a constant predictor or outcome, separated classes, one cluster, no rows), all figures but the counts are null.
    """
    names = [x] if isinstance(x, str) else list(x)
    spark, k = rows.sparkSession, len(names) + 1
    xs = [f"x{i}" for i in range(1, k)]
    used = rows.select(F.col(y).cast("int").alias("y"), *[F.col(c).cast("double").alias(a) for c, a in zip(names, xs)], F.col(cluster).alias("g")).dropna()
    cells = used.groupBy(*xs).agg(F.count("*").alias("n"), F.sum("y").alias("k")).persist()
    try:
        base = cells.agg(F.sum("n").alias("n"), F.sum("k").alias("k"), *[F.min(c).alias(f"least_{c}") for c in xs], *[F.max(c).alias(f"most_{c}") for c in xs], *[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(f"mean_{c}") for c in xs]).first()
        n, ones = base["n"] or 0, base["k"] or 0
        mean = np.array([base[f"mean_{c}"] for c in xs], float) if n else np.zeros(k - 1)
        scale = np.array([base[f"most_{c}"] - base[f"least_{c}"] for c in xs], float) if n else np.zeros(k - 1)
        found = None
        if 0 < ones < n and (scale > 0).all():
            scaled = [((F.col(c) - float(m)) / float(s)).alias(c) for c, m, s in zip(xs, mean, scale)]
            found = _newton(cells.select("n", "k", *scaled), xs, ones / n, steps, tolerance)
    finally:
        cells.unpersist()
    nothing = lambda clusters: spark.createDataFrame([(name, *[None] * 7, n, clusters) for name in ("intercept", *names)], COLUMNS)
    if found is None:
        return nothing(used.select("g").distinct().count() if n else 0)

    beta, information = found
    left = F.col("y") - 1 / (1 + F.exp(-_linear(beta, xs)))
    scores = used.select("g", "y", *scaled).groupBy("g").agg(F.sum(left).alias("s0"), *[F.sum(left * F.col(c)).alias(f"s{i}") for i, c in enumerate(xs, 1)])
    *products, clusters = scores.agg(*[F.sum(F.col(f"s{i}") * F.col(f"s{j}")) for i in range(k) for j in range(i + 1)], F.count("*")).first()
    if clusters < 2 or n <= k:
        return nothing(clusters)
    meat = _symmetric(products, k)
    bread = np.linalg.inv(information)
    variance = bread @ meat @ bread * clusters / (clusters - 1) * (n - 1) / (n - k)
    back = np.eye(k)  # from scaled predictors to those given
    back[1:, 1:] = np.diag(1 / scale)
    back[0, 1:] = -mean / scale
    beta, variance = back @ beta, back @ variance @ back.T
    out = []
    for i, name in enumerate(("intercept", *names)):
        b, error = float(beta[i]), sqrt(max(float(variance[i, i]), 0.0))
        z = b / error if error else float("nan")
        limits = [exp(min(b + s * 1.959963984540054 * error, 700.0)) for s in (0, -1, 1)]
        out.append((name, b, error, z, erfc(abs(z) / sqrt(2)), *limits, n, clusters))
    return spark.createDataFrame(out, COLUMNS)


def _symmetric(values: Sequence[float], k: int) -> np.ndarray:
    """The matrix whose lower triangle, by rows, is given."""
    m = np.zeros((k, k))
    m[np.tril_indices(k)] = values
    return m + np.tril(m, -1).T


def _newton(cells: DataFrame, xs: Sequence[str], share: float, steps: int, tolerance: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Estimate and information matrix, or None where the steps do not settle."""
    k = len(xs) + 1
    beta = np.zeros(k)
    beta[0] = np.log(share / (1 - share))
    of = [F.lit(1.0), *[F.col(c) for c in xs]]
    for _ in range(steps):
        p = 1 / (1 + F.exp(-_linear(beta, xs)))
        one = cells.withColumn("p", p).withColumns({"w": F.expr("n * p * (1 - p)"), "r": F.expr("k - n * p")})
        sums = one.agg(*[F.sum(F.col("r") * a) for a in of], *[F.sum(F.col("w") * of[i] * of[j]) for i in range(k) for j in range(i + 1)]).first()
        information = _symmetric(sums[k:], k)
        if not np.isfinite(information).all() or np.linalg.cond(information) > 1e13:
            return None
        step = np.linalg.solve(information, np.array(sums[:k], float))
        beta = beta + step
        if np.abs(step).max() < tolerance:
            return (beta, information) if np.abs(beta).max() < 30 else None
    return None
