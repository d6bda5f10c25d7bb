"""Sinks: Parquet first; CSV sheets for hand labelling; JSON summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame


def parquet(rows: DataFrame, path: str, *partition_by: str) -> None:
    rows.write.mode("overwrite").partitionBy(*partition_by).parquet(path) if partition_by else rows.write.mode("overwrite").parquet(path)


def sheet(rows: DataFrame, path: str) -> None:
    """One CSV file with a header, for people; rows must be few."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def table_csv(rows: DataFrame, path: str) -> None:
    """CSV as `readers.table_csv` reads it; blanks at the ends of fields stay."""
    options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.mode("overwrite").options(**options).csv(path)


def summary(rows: DataFrame, path: str) -> None:
    """A summary (few rows) as JSON lines, nulls kept."""
    rows.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)
