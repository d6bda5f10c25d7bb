"""An audit of published numbers: every claim against what the data give now."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def measured(rows: DataFrame, metrics: Mapping[str, Column]) -> DataFrame:
    """(metric, value) of aggregates over rows, all of them from one pass; a metric of no rows is null."""
    names = list(metrics)
    one = rows.agg(*[metrics[m].cast("double").alias(f"m{i}") for i, m in enumerate(names)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"m{i}").alias("value")) for i, m in enumerate(names)])))


def measured_by(rows: DataFrame, group: str, metrics: Mapping[str, Column]) -> DataFrame:
    """The same for each group: metrics are named `metric[group]`; a null group counts as none."""
    names = list(metrics)
    each = rows.where(F.col(group).isNotNull()).groupBy(F.col(group).cast("string").alias("g")).agg(*[metrics[m].cast("double").alias(f"m{i}") for i, m in enumerate(names)])
    return each.select(F.inline(F.array(*[F.struct(F.format_string(f"{m}[%s]", "g").alias("metric"), F.col(f"m{i}").alias("value")) for i, m in enumerate(names)])))


def verdicts(claims: DataFrame, metrics: DataFrame) -> DataFrame:
    """A row for each of claims (claim, metric, claimed, decimals): the value and `verdict`.

    A claim holds if the value, rounded half up to its decimals, is the number that was published; negative decimals round
    to tens and so on. `missing`: no metric has the name, or it has no value; `ambiguous`: metrics of that name disagree. Claims of one name are
    judged each; a claim without a number, or without decimals, fails.
    """
    known = metrics.groupBy("metric").agg(F.min("value").alias("value"), F.max("value").alias("most"))
    rows = claims.join(known, "metric", "left")
    scale = F.pow(F.lit(10.0), F.col("decimals"))
    rounded = lambda c: F.floor(c * scale + 0.5 + 1e-9)
    holds = F.coalesce(rounded(F.col("value")) == rounded(F.col("claimed")), F.lit(False))
    verdict = F.when(F.col("value").isNull(), "missing").when(F.col("value") != F.col("most"), "ambiguous").when(holds, "ok").otherwise("failed")
    return rows.select("claim", "metric", "claimed", F.when(F.col("value") == F.col("most"), F.col("value")).alias("value"), verdict.alias("verdict"))
