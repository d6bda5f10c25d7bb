"""When methods first appear in award abstracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def kth_smallest(rows: DataFrame, keys: Sequence[str], value: str, ranks: Sequence[int]) -> DataFrame:
    """n and the k-th smallest value of each group for every k of ranks (null where the group is smaller).

    Rows are counted per value first; running sums over the values of a group then tell where the k-th one lies, so no
    group of rows is sorted in one task.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    up_to = F.sum("_n").over(Window.partitionBy(*keys).orderBy(value))
    placed = counts.withColumn("_up_to", up_to)
    return placed.groupBy(*keys).agg(F.sum("_n").alias("n"), *[F.min(F.when(F.col("_up_to") >= k, F.col(value))).alias(f"k{k}") for k in ranks])


def first_snippets(hits: DataFrame, key: str, order: str, keep: int = 2) -> DataFrame:
    """The first `keep` rows of each key in order."""
    return hits.withColumn("item", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("item") <= keep)
