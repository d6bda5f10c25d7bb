"""Places and running sums over an order of all rows, without a window that all rows go through.

Rows are sorted over range partitions and written once, as range bounds are drawn from samples and may differ when a plan runs
again. What a partition adds up to is a row for each partition; from these come the offsets that make local places and sums
global. So the largest task holds a range partition, and the driver as many rows as there are partitions.
"""

from __future__ import annotations

import itertools
import operator
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelink.session import shared_folder

_SHIFT = 33  # monotonically_increasing_id: the partition above these bits, the row's place in it below

#: An aggregate, how the driver joins two of its values, and how columns do; no value is null.
Fold = tuple[Callable[[Column], Column], Callable, Callable[[Column, Column], Column]]
SUM: Fold = (F.sum, operator.add, lambda a, b: a + b)
LEAST: Fold = (F.min, min, F.least)
XOR: Fold = (F.bit_xor, operator.xor, lambda a, b: a.bitwiseXOR(b))


class Ordered:
    """Rows in the order of `order`, which should end with a unique column; rows that tie otherwise come as the sort leaves them, nulls as
    Spark sorts them. `n` is their number. keep: the columns that are written (default: all), others only serve the order."""

    def __init__(self, rows: DataFrame, *order: Column | str, keep: Sequence[str] | None = None):
        spark = rows.sparkSession
        placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
        placed = placed.select(*keep, "_at") if keep else placed
        path = f"{shared_folder(spark)}/tracelink/ordered-{uuid.uuid4().hex}"
        placed.write.parquet(path)
        self.rows = spark.read.schema(placed.schema).parquet(path).withColumn("_part", F.shiftright("_at", _SHIFT))
        self._sizes = dict(self.rows.groupBy("_part").count().collect())  # a row for each partition
        self.n = sum(self._sizes.values())

    def _with_offsets(self, rows: DataFrame, totals: dict[int, object], fold: Callable, kind: str, name: str) -> DataFrame:
        """Adds what all partitions before a row's amount to; null in the first."""
        parts = sorted(totals)
        before = [None, *itertools.accumulate((totals[p] for p in parts), lambda a, b: b if a is None else a if b is None else fold(a, b))]
        table = rows.sparkSession.createDataFrame(list(zip(parts, before)), f"_part long, {name} {kind}")
        return rows.join(F.broadcast(table), "_part", "left")

    def numbered(self, name: str = "place") -> DataFrame:
        """Adds each row's place, from 1."""
        rows = self._with_offsets(self.rows, self._sizes, lambda a, b: a + b, "long", "_before")
        place = F.coalesce("_before", F.lit(0)) + F.col("_at").bitwiseAND((1 << _SHIFT) - 1) + 1
        return rows.withColumn(name, place).drop("_before")

    def running(self, rows: DataFrame, value: str, name: str, fold: Fold = SUM) -> DataFrame:
        """Adds the sum (or another fold) of `value` up to each row, itself included; nulls add nothing. rows: from `numbered`,
        or `self.rows`."""
        of, join, both = fold
        kind = rows.select(of(F.col(value)).alias("x")).schema["x"].dataType.simpleString()
        totals = dict(rows.groupBy("_part").agg(of(F.col(value)).alias("x")).collect())
        local = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = self._with_offsets(rows.withColumn("_own", of(F.col(value)).over(local)), totals, join, kind, "_before")
        return rows.withColumn(name, F.coalesce(both(F.col("_before"), F.col("_own")), "_before", "_own")).drop("_own", "_before")


def plain(rows: DataFrame) -> DataFrame:
    """Without the columns of the order."""
    return rows.drop("_at", "_part")
