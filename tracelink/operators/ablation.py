"""How links thin out with their confidence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def threshold_ablation(links: DataFrame, key: str, score: str, settings: Mapping[str, Column], thresholds: Sequence[float]) -> DataFrame:
    """Distinct keys with a link of at least each threshold, under each setting (a condition on links), and their share of the setting's keys
    at any score.

    One grouping: a key's largest score under each setting says which thresholds it passes, and suffix sums over the
    counts of these say how many keys pass each. A frequent key is combined before it is shuffled. Null keys, scores and conditions count for nothing, and
    pairs of setting and threshold that no key passes have 0; the share is then 0, or null where the setting has no key.
    """
    levels, names = sorted(set(thresholds)), list(settings)
    passed = lambda c: sum((F.when(c >= F.lit(t), 1).otherwise(0) for t in levels), F.lit(0))
    best = links.where(F.col(key).isNotNull() & F.col(score).isNotNull()).groupBy(key).agg(*[F.max(F.when(settings[s], F.col(score))).alias(f"m{i}") for i, s in enumerate(names)])
    each = best.select(F.inline(F.array(*[F.struct(F.lit(s).alias("setting"), F.col(f"m{i}").alias("m")) for i, s in enumerate(names)]))).where("m IS NOT NULL")
    counts = each.groupBy("setting", passed(F.col("m")).alias("levels")).agg(F.count("*").alias("n"))
    # A key that passes k levels counts for the first k of them, and for level 0, which has no threshold.
    spread = counts.select("setting", "n", F.explode(F.sequence(F.lit(0), F.col("levels"))).alias("level")).groupBy("setting", "level").agg(F.sum("n").alias("n"))
    whole = spread.where("level = 0").select("setting", F.col("n").alias("total"))
    places = F.array(*[F.struct(F.lit(i).alias("level"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(levels, 1)])
    grid = links.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in names])).alias("setting")).select("setting", F.inline(places))
    out = grid.join(spread, ["setting", "level"], "left").join(whole, "setting", "left")
    return out.select("setting", "threshold", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0)).alias("total"), (F.coalesce("n", F.lit(0)) / F.when(F.col("total") > 0, F.col("total"))).alias("share"))
