"""Audits of samples and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def representativeness(population: DataFrame, sample: DataFrame, key: str, early: Column) -> DataFrame:
    """Rows and share of early ones in the population and in the sample: a prefix of sorted ids shows here."""
    inside = sample.select(key).distinct().withColumn("_in", F.lit(True))
    rows = population.join(inside, key, "left").select(F.coalesce("_in", F.lit(False)).alias("in"), early.alias("e"))
    rows = rows.select(F.explode(F.when(F.col("in"), F.array(F.lit("population"), F.lit("sample"))).otherwise(F.array(F.lit("population")))).alias("set"), "e")
    return rows.groupBy("set").agg(F.count("*").alias("n"), F.count_if("e").alias("early"), (F.count_if("e") / F.count("*")).alias("share"))


def absent(meta: DataFrame) -> DataFrame:
    """Records, and those marked absent."""
    return meta.agg(F.count("*").alias("n"), F.count_if(F.coalesce("_absent", F.lit(False))).alias("absent"))


def labelled_coverage(labels: DataFrame, everything: DataFrame, key: str, label: str) -> DataFrame:
    """Distinct labelled keys over distinct keys."""
    got = labels.where(F.col(label).isNotNull()).select(key).distinct().withColumn("_l", F.lit(True))
    rows = everything.select(key).distinct().join(got, key, "left")
    return rows.agg(F.count("*").alias("n"), F.count("_l").alias("labelled"), (F.count("_l") / F.count("*")).alias("coverage"))


def id_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes of both distinct id sets, of their intersection and differences."""
    side = lambda df, n: df.select(key).where(F.col(key).isNotNull()).distinct().withColumn(n, F.lit(1))
    both = side(a, "_a").join(side(b, "_b"), key, "full")
    here, there = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return both.agg(F.count_if(here).alias("n_a"), F.count_if(there).alias("n_b"), F.count_if(here & there).alias("n_both"), F.count_if(here & ~there).alias("only_a"), F.count_if(~here & there).alias("only_b"))
