"""Years from text; what does not parse is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelink.functions.text import blank_to_null, col

FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "yyyyMMdd", "yyyy-MM", "yyyy")


def mixed_year(c: Column | str, formats: tuple[str, ...] = FORMATS) -> Column:
    """The year of a date in any of the formats, tried in order."""
    return F.year(F.coalesce(*[F.try_to_timestamp(col(c), F.lit(f)) for f in formats]))


def digit_year(c: Column | str) -> Column:
    """A year of digits alone, else null."""
    return F.when(F.trim(col(c)).rlike("^[0-9]+$"), F.trim(col(c))).try_cast("int")


def paper_year(year: Column | str, volume_year: Column | str) -> Column:
    """The paper's year, or where it has none the volume's."""
    return F.coalesce(blank_to_null(year), col(volume_year)).try_cast("int")
