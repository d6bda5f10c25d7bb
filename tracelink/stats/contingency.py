"""Tables of counts: Fisher's exact test, Benjamini-Hochberg, Mantel-Haenszel, agreement."""

from __future__ import annotations

from collections.abc import Sequence
from math import erfc, sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelink.operators.ordering import LEAST, Ordered, plain
from tracelink.stats import special


@F.pandas_udf(T.DoubleType())
def fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided p of [[a, b], [c, d]]."""
    return pd.Series([special.fisher_two_sided(*map(int, x)) for x in zip(a, b, c, d)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def chi_square_p(x: pd.Series) -> pd.Series:
    """Upper tail of a chi-square variable with one degree of freedom."""
    return x.map(lambda v: erfc(sqrt(v / 2)))


def benjamini_hochberg(rows: DataFrame, p: str, key: str) -> DataFrame:
    """Adds q: the running minimum of p m / rank from the largest p down, at most 1. Ties go by key. Ranks and minima come from
    range partitions, so there may be any number of tests."""
    order = Ordered(rows, F.desc(p), F.desc(key))
    down = order.numbered("_down").withColumn("_raw", F.col(p) * F.lit(order.n) / (F.lit(order.n + 1) - F.col("_down")))
    return plain(order.running(down, "_raw", "q", LEAST)).withColumn("q", F.least("q", F.lit(1.0))).drop("_raw", "_down")


def mantel_haenszel(strata: DataFrame, correction: float = 0.5) -> DataFrame:
    """Pooled odds ratio over strata (k1, n1, k0, n0): odds_ratio, low, high, p and the number of strata.

    Strata without one of the arms are left out; the correction goes to all four cells. The variance is Robins, Breslow
    and Greenland's, the test the score test without continuity correction.
    """
    rows = strata.where("n1 > 0 AND n0 > 0").select(
        (F.col("k1") + correction).alias("a"), (F.col("n1") - F.col("k1") + correction).alias("b"),
        (F.col("k0") + correction).alias("c"), (F.col("n0") - F.col("k0") + correction).alias("d"),
    )
    n = F.expr("a + b + c + d")
    r, s = F.expr("a * d") / n, F.expr("b * c") / n
    p, q = F.expr("a + d") / n, F.expr("b + c") / n
    sums = rows.agg(
        F.sum(r).alias("r"), F.sum(s).alias("s"), F.sum(p * r).alias("pr"), F.sum(p * s + q * r).alias("pq"), F.sum(q * s).alias("qs"),
        F.sum(F.col("a") - F.expr("(a + b) * (a + c)") / n).alias("over"),
        F.sum(F.expr("(a + b) * (c + d) * (a + c) * (b + d)") / (n * n * (n - 1))).alias("variance"), F.count("*").alias("strata"),
    )
    error = F.sqrt(F.expr("pr / (2 * r * r) + pq / (2 * r * s) + qs / (2 * s * s)"))
    ratio = F.col("r") / F.col("s")
    width = F.lit(1.959963984540054) * error
    return sums.select(
        ratio.alias("odds_ratio"), F.exp(F.log(ratio) - width).alias("low"), F.exp(F.log(ratio) + width).alias("high"),
        chi_square_p(F.col("over") * F.col("over") / F.col("variance")).alias("p"), "strata",
    )


def chi_square(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson's statistic of independence of two columns, with its degrees of freedom and the number of rows."""
    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    of_a, of_b = cells.groupBy(a).agg(F.sum("n").alias("na")), cells.groupBy(b).agg(F.sum("n").alias("nb"))
    total = of_a.agg(F.sum("na").alias("total"), F.count("*").alias("ka"))
    margins = of_b.agg(F.count("*").alias("kb"))
    # Sum of n^2 / (na nb) over the cells that occur gives the statistic, as empty cells add nothing to it.
    share = cells.join(of_a, a).join(of_b, b).agg(F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb"))).alias("s"))
    one = [x.withColumn("_k", F.lit(1)) for x in (share, total, margins)]  # single rows
    out = one[0].join(one[1], "_k").join(one[2], "_k")
    return out.select((F.col("total") * (F.col("s") - 1)).alias("statistic"), ((F.col("ka") - 1) * (F.col("kb") - 1)).alias("df"), F.col("total").alias("n"))


def agreement(rows: DataFrame, a: str, b: str, domain: Sequence) -> DataFrame:
    """Raw agreement, Cohen's kappa and Gwet's AC1 of two raters over a fixed domain, from one aggregation."""
    n = F.count("*")
    share = lambda c, v: F.count_if(F.col(c) == F.lit(v)) / n
    out = rows.agg(
        n.alias("n"), (F.count_if(F.col(a) == F.col(b)) / n).alias("raw"),
        *[share(c, v).alias(f"_{x}{i}") for x, c in (("a", a), ("b", b)) for i, v in enumerate(domain)],
    )
    by_chance = sum((F.col(f"_a{i}") * F.col(f"_b{i}") for i in range(len(domain))), F.lit(0.0))
    mean = [(F.col(f"_a{i}") + F.col(f"_b{i}")) / 2 for i in range(len(domain))]
    spread = sum((m * (1 - m) for m in mean), F.lit(0.0)) / (len(domain) - 1)
    corrected = lambda e: F.when(e < 1, (F.col("raw") - e) / (1 - e)).otherwise(1.0)
    return out.select("n", "raw", corrected(by_chance).alias("kappa"), corrected(spread).alias("ac1"))


def per_class(rows: DataFrame, reference: str, predicted: str, domain: Sequence) -> DataFrame:
    """tp, fp, fn, precision, recall and F1 of each class, with the guards max(., 1) and 1e-9."""
    pairs = rows.select(F.col(reference).alias("r"), F.col(predicted).alias("h"))
    sides = pairs.select(F.explode(F.array(*[F.struct(F.lit(v).alias("class"), (F.col("h") == F.lit(v)).alias("h"), (F.col("r") == F.lit(v)).alias("r")) for v in domain])).alias("x")).select("x.*")
    counts = sides.groupBy("class").agg(F.count_if(F.col("h") & F.col("r")).alias("tp"), F.count_if(F.col("h") & ~F.col("r")).alias("fp"), F.count_if(~F.col("h") & F.col("r")).alias("fn"), F.count("*").alias("n"))
    precision, recall = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    return counts.withColumns({"precision": precision, "recall": recall}).withColumn("f1", F.expr("2 * precision * recall / greatest(precision + recall, 1e-9D)"))
