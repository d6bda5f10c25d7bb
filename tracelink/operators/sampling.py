"""Samples that depend on keys and a seed alone: rows are ordered by md5 of both, which any engine can repeat."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelink.operators.ordering import Ordered, plain


def order_key(key: Column | str, seed: str | int, *salt: str) -> Column:
    c = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws(":", *[F.lit(str(x)) for x in (seed, *salt)], c.cast("string")))


def sample_keys(rows: DataFrame, key: str, n: int, seed: str | int) -> DataFrame:
    """n distinct keys without replacement. Spark keeps the n least per partition before it merges them."""
    return rows.select(key).where(F.col(key).isNotNull()).distinct().orderBy(order_key(key, seed), key).limit(n)


def control_sample(rows: DataFrame, treated: DataFrame, key: str, n: int, seed: str | int) -> DataFrame:
    """n of the distinct keys that are not treated; normalise both sides first."""
    return sample_keys(rows.join(treated.select(key), key, "left_anti"), key, n, seed)


def stratified(rows: DataFrame, stratum: str, key: str, take: Mapping[str, int | None], seed: str | int) -> DataFrame:
    """Up to take[s] rows of each stratum s in sample order (None: all). Strata that are not named give nothing.

    The largest quota bounds the places by a literal, so Spark cuts each task's rows of a stratum before it shuffles them.
    """
    whole = [s for s, q in take.items() if q is None]
    quotas = {s: q for s, q in take.items() if q is not None}
    out = rows.where(F.col(stratum).isin(whole)) if whole else rows.limit(0)
    if quotas:
        place = F.row_number().over(Window.partitionBy(stratum).orderBy(order_key(key, seed), key))
        quota = F.create_map(*[F.lit(x) for s, q in quotas.items() for x in (s, q)])[F.col(stratum)]
        some = rows.where(F.col(stratum).isin(list(quotas))).withColumn("_place", place).where(F.col("_place") <= max(quotas.values()))
        out = out.unionByName(some.where(F.col("_place") <= quota).drop("_place"))
    return out


def sheet(rows: DataFrame, key: str, seed: str | int, coder: str) -> DataFrame:
    """A coder's own order of the rows: item numbers from 1 by a permutation per coder, over range partitions."""
    return plain(Ordered(rows, order_key(key, seed, coder), key).numbered("item")).withColumn("item", F.col("item").cast("int"))


def work_queue(rows: DataFrame, key: str, seed: str | int) -> DataFrame:
    """Rows in random order, so that what is done of it at any time is a sample."""
    return rows.orderBy(order_key(key, seed), key)
