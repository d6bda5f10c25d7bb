"""Streaming variants of the link join. The batch operators define the results; these keep them up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cited_by(stream: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Edges of a stream that point to wanted works (a static table): a stream-static semi join, without state."""
    return stream.join(wanted.select(key).distinct(), key, "left_semi")


def watermarked(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """The stream with its one watermark, which bounds the state of what follows."""
    return stream.withWatermark(time, delay)


def once(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Drops edges of a watermarked stream that were seen within the watermark's delay."""
    return stream.dropDuplicatesWithinWatermark(keys)


def counts(stream: DataFrame, time: str, width: str, *keys: str) -> DataFrame:
    """Edges of a watermarked stream per window and key; late ones count until the watermark has passed the window."""
    return stream.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))
