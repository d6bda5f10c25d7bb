"""Rates per tag, bucket and year."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelink.operators.ordering import Ordered, plain
from tracelink.stats.intervals import excludes, jeffreys


def year_bucket(year: Column | str, buckets: Sequence[tuple[int, int]]) -> Column:
    """'lo-hi' of the inclusive range that holds the year; null outside of all."""
    c = F.col(year) if isinstance(year, str) else year
    out = F.lit(None).cast("string")
    for lo, hi in reversed(list(buckets)):
        out = F.when(c.between(lo, hi), f"{lo}-{hi}").otherwise(out)
    return out


def coverage(rows: DataFrame, bucket: Column, flag: Column) -> DataFrame:
    """n, hits and share of each bucket that occurs; rows outside of all buckets do not count."""
    return rows.select(bucket.alias("bucket"), flag.alias("f")).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("f").alias("hits"), (F.count_if("f") / F.count("*")).alias("share"))


def tag_rates(tagged: DataFrame, flag: str) -> DataFrame:
    """n, hits and rate per tag. Tags overlap, so the counts do not add up to the corpus."""
    return tagged.groupBy("tag").agg(F.count("*").alias("n"), F.count_if(flag).alias("hits"), (F.count_if(flag) / F.count("*")).alias("rate"))


def with_interval(rates: DataFrame, k: str = "hits", n: str = "n") -> DataFrame:
    return rates.withColumn("interval", jeffreys(k, n))


def flag_extreme(rates: DataFrame, base: float | Column) -> DataFrame:
    """excludes_base: whether the tag's interval leaves the corpus rate out."""
    return rates.withColumn("excludes_base", excludes("interval", F.lit(base) if isinstance(base, (int, float)) else base))


def dense(counts: DataFrame, domains: Mapping[str, Sequence]) -> DataFrame:
    """Left join from the grid of all combinations of the given values: n and hits are 0 where nothing is, the rate null."""
    names = list(domains)
    grid = counts.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v) for v in domains[names[0]]])).alias(names[0]))
    for name in names[1:]:
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in domains[name]])))
    out = grid.join(counts, names, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "hits")})
    return out.select(*names, "n", "hits", F.when(F.col("n") > 0, F.col("hits") / F.col("n")).alias("rate"))


def reach(tagged: DataFrame, links: DataFrame, key: str, target: str) -> DataFrame:
    """Distinct targets that each tag's rows link to."""
    pairs = tagged.select("tag", key).join(links.select(key, target), key).select("tag", target).distinct()
    return pairs.groupBy("tag").agg(F.count("*").alias("reached"))


def missing(rows: DataFrame, key: str, usable: Column, least: int = 0, gap: float = 0.5) -> DataFrame:
    """missing and total per key, the missing share, and whether it is a gap (more than `least` rows, share over `gap`)."""
    out = rows.select(key, usable.alias("u")).groupBy(key).agg(F.count_if(~F.col("u")).alias("missing"), F.count("*").alias("total"))
    share = F.col("missing") / F.col("total")
    return out.withColumns({"share": share, "is_gap": (F.col("total") > least) & (share > gap)})


def worst(groups: DataFrame, key: str, k: int = 12, least: int = 200) -> DataFrame:
    """The k groups of at least `least` rows with the largest missing share; ties go by key."""
    return groups.where(F.col("total") >= least).orderBy(F.desc("share"), key).limit(k)


def ranked(rates: DataFrame, rate: str, key: str) -> DataFrame:
    """Adds place, from 1: the largest rate first, groups without a rate last, ties by key; over range partitions."""
    return plain(Ordered(rates, F.desc_nulls_last(rate), key).numbered("place")).withColumn("place", F.col("place").cast("int"))
