"""Two arms across strata: crude ratios mislead where the strata differ, so tables, standardised and pooled figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelink.stats.contingency import mantel_haenszel


def stratum_table(rows: DataFrame, stratum: str, arm: str, flag: str, strata: Sequence[str], arms: tuple[str, str]) -> DataFrame:
    """k, n and rate of both arms (1: the first) in every stratum, those without rows included."""
    cells = []
    for i, a in ((1, arms[0]), (0, arms[1])):
        mine = F.col(arm) == a
        cells += [F.count_if(mine & F.col(flag)).alias(f"k{i}"), F.count_if(mine).alias(f"n{i}")]
    counts = rows.groupBy(stratum).agg(*cells)
    grid = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in strata])).alias(stratum))
    out = grid.join(counts, stratum, "left").fillna(0, ["k1", "n1", "k0", "n0"])
    return out.withColumns({f"rate{i}": F.when(F.col(f"n{i}") > 0, F.col(f"k{i}") / F.col(f"n{i}")) for i in (1, 0)})


def standardised(table: DataFrame) -> DataFrame:
    """The second arm's rate with the first arm's strata as weights, over strata where the second has rows."""
    w = F.col("n1").cast("double")
    return table.where("n0 > 0").agg((F.sum(w * F.col("rate0")) / F.sum(w)).alias("standardised"), (F.sum("k1") / F.sum("n1")).alias("rate1"), (F.sum("k0") / F.sum("n0")).alias("crude0"))


def pooled(table: DataFrame) -> DataFrame:
    return mantel_haenszel(table)


def weights(population: DataFrame, sample: DataFrame, stratum: str) -> DataFrame:
    """population, sample and weight (their ratio) of each sampled stratum."""
    count = lambda df, name: df.groupBy(stratum).agg(F.count("*").alias(name))
    return count(population, "population").join(count(sample, "sample"), stratum).withColumn("weight", F.col("population") / F.col("sample"))


def reweighted(rows: DataFrame, weight: DataFrame, stratum: str, label: str, consensus: str) -> DataFrame:
    """Share of each label in the population: weighted counts of rows with consensus, over the whole population."""
    total = weight.agg(F.sum("population").alias("total"))
    counts = rows.where(consensus).groupBy(stratum, label).agg(F.count("*").alias("n"))
    sums = counts.join(weight, stratum).groupBy(label).agg(F.sum(F.col("weight") * F.col("n")).alias("weighted"))
    return sums.join(F.broadcast(total)).select(label, (F.col("weighted") / F.greatest("total", F.lit(1))).alias("share"))


def flips(rows: DataFrame, original: str, shown: str, hidden: str) -> DataFrame:
    """Adds consistent and flipped. A null label differs from everything, another null included."""
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    return rows.withColumns({"consistent": same(shown, original), "flipped": ~same(shown, hidden)})


def flip_rates(flipped: DataFrame, masks: dict[str, str]) -> DataFrame:
    """n, flips and rate under each mask (a name and a condition)."""
    parts = F.explode(F.array(*[F.struct(F.lit(m).alias("mask"), F.coalesce(F.expr(c), F.lit(False)).alias("in")) for m, c in masks.items()])).alias("x")
    rows = flipped.select("flipped", parts).where("x.in")
    return rows.groupBy(F.col("x.mask").alias("mask")).agg(F.count("*").alias("n"), F.count_if("flipped").alias("flips"), (F.count_if("flipped") / F.count("*")).alias("rate"))
