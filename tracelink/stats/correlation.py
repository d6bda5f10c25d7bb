"""Rank correlation."""

from __future__ import annotations

from math import atanh, sqrt, tanh

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelink.operators.ordering import Ordered, plain
from tracelink.stats import special

FISHER_Z = T.StructType([T.StructField(c, T.DoubleType()) for c in ("low", "high", "p")])


def average_ranks(counts: DataFrame, value: str, n: str = "n") -> DataFrame:
    """Adds `twice_rank`, twice the average rank, a whole number, to distinct values with their counts: (value, n).

    Values before come from a running sum over range partitions, so a frequent value is one row and no task orders all.
    """
    order = Ordered(counts.select(value, n), value)
    rows = order.running(order.rows, n, "_upto")
    return plain(rows).withColumn("twice_rank", F.col("_upto") * 2 - F.col(n) + 1).drop("_upto")


@F.pandas_udf(FISHER_Z)
def _interval(rho: pd.Series, n: pd.Series) -> pd.DataFrame:
    out = []
    for r, k in zip(rho, n):
        if pd.isna(r) or k < 4:
            out.append((None, None, None))
            continue
        p = 0.0 if abs(r) >= 1 else special.incomplete_beta((k - 2) / 2, 0.5, 1 - r * r)
        if abs(r) >= 1:
            out.append((r, r, p))
            continue
        width = 1.959963984540054 * sqrt((1 + r * r / 2) / (k - 3))
        out.append((tanh(atanh(r) - width), tanh(atanh(r) + width), p))
    return pd.DataFrame(out, columns=["low", "high", "p"], dtype="float64")


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, rho, a 95 % interval (Fisher's z with the variance (1 + rho^2 / 2) / (n - 3)) and the two-sided p of t.

    Only rows with both values count, ties get average ranks, and NaN is the largest value. Sums of ranks are exact decimals. rho is null if
    a column is constant or there are no rows; interval and p are null below four rows.
    """
    cells = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n"))
    ranks = {c: average_ranks(cells.groupBy(c).agg(F.sum("n").alias("n")), c).select(c, F.col("twice_rank").cast("decimal(20,0)").alias(f"r{c}")) for c in "xy"}
    ranked = cells.join(ranks["x"], "x").join(ranks["y"], "y")
    exact = lambda e: F.sum(F.expr(e).cast("decimal(38,0)"))
    sums = ranked.agg(F.sum("n").alias("n"), *[exact(e).alias(a) for a, e in (("sx", "n * rx"), ("sy", "n * ry"), ("sxy", "n * rx * ry"), ("sxx", "n * rx * rx"), ("syy", "n * ry * ry"))])
    # Centred by the mean twice-rank, n + 1, so that the differences of large sums stay exact.
    centred = [F.expr(f"CAST({a} - {b} * CAST(n + 1 AS DECIMAL(20,0)) AS DOUBLE)").alias(c) for a, b, c in (("sxy", "sy", "cov"), ("sxx", "sx", "vx"), ("syy", "sy", "vy"))]
    out = sums.select(F.coalesce("n", F.lit(0)).alias("n"), *centred)
    rho = F.when((F.col("vx") > 0) & (F.col("vy") > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cov") / (F.sqrt("vx") * F.sqrt("vy")))))
    return out.select("n", rho.alias("rho")).withColumn("i", _interval("rho", "n")).select("n", "rho", "i.low", "i.high", "i.p")
