"""Identifiers: one normal form for each kind."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelink.functions.text import blank_to_null, col, strip

# Prefixes of identifiers in the order in which they are taken off.
DOI_PREFIXES = ("https://doi.org/", "http://doi.org/", "doi:")
# The grant eras and the first utility patent numbers of their later ones.
ERAS = ("pre-1976", "1976-2014", "2015-May2021", "May2021+", "application", "design/other")
ERA_STARTS = (3_930_271, 8_925_000, 11_000_000)
# Collections that count as core venues.
CORE_VENUES = ("acl", "emnlp", "naacl", "eacl", "coling", "tacl", "cl", "findings", "conll", "lrec", "semeval", "ws", "anlp", "aacl", "ijcnlp")


def doi(c: Column | str) -> Column:
    """Trimmed, in lower case, each prefix taken off once in turn; nothing left is null."""
    out = F.lower(strip(c))
    for prefix in DOI_PREFIXES:
        out = F.regexp_replace(out, "^" + re.escape(prefix), "")
    return blank_to_null(out)


def work_id(c: Column | str) -> Column:
    """The last path segment without its leading Ws."""
    return F.regexp_replace(F.substring_index(col(c), "/", -1), "^[Ww]+", "")


def patent_id(c: Column | str) -> Column:
    return F.upper(F.replace(strip(col(c).cast("string")), F.lit("-"), F.lit("")))


def patent_number(c: Column | str) -> Column:
    """The first run of six digits or more."""
    return F.regexp_extract(col(c), r"(\d{6,})", 1).try_cast("bigint")


def url_number(c: Column | str) -> Column:
    """A patent id as page addresses have it: without the country's prefix, the kind code and punctuation."""
    return F.regexp_replace(F.regexp_replace(col(c), r"^US|[A-Z]\d?$", ""), "[^0-9A-Z]", "")


def grant_era(c: Column | str) -> Column:
    """The era of a patent id: by number for utility patents, else application or design/other; null is design/other."""
    pid = patent_id(F.coalesce(col(c).cast("string"), F.lit("")))
    shape = r"^US([A-Z]*)0*(\d+)"
    kind, digits = F.regexp_extract(pid, shape, 1), F.regexp_extract(pid, shape, 2)
    number = digits.try_cast("bigint")
    first, second, third = ERA_STARTS
    return (
        F.when((digits == "") | (kind != ""), ERAS[5])
        .when(F.length(digits) >= 10, ERAS[4])
        .when(number < first, ERAS[0])
        .when(number < second, ERAS[1])
        .when(number < third, ERAS[2])
        .otherwise(ERAS[3])
    )


def record_type(era: Column | str) -> Column:
    return F.when(col(era).isin(ERAS[4], ERAS[5]), col(era)).otherwise("granted utility")


def venue_key(file: Column | str) -> Column:
    """Of a file name: the part after the year in 2024.acl.xml, the stem of P19.xml."""
    parts = F.split(F.regexp_replace(col(file), r"\.[^.]*$", ""), r"\.")
    return F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))


def paper_id(collection: Column | str, volume: Column | str, paper: Column | str) -> Column:
    part = lambda c: F.coalesce(col(c), F.lit(""))
    return F.concat(part(collection), F.lit("-"), part(volume), F.lit("."), part(paper))


def author_names(authors: Column | str) -> Column:
    """Of an array of (first, last): the non-empty names joined by blanks, one per author."""
    name = lambda a: F.array_join(F.filter(F.array(F.trim(a["first"]), F.trim(a["last"])), lambda x: x.isNotNull() & (x != "")), " ")
    return F.filter(F.transform(col(authors), name), lambda x: x != "")


def is_core_venue(key: Column | str) -> Column:
    return F.coalesce(F.lower(col(key)).isin(*CORE_VENUES), F.lit(False))


def content_key(*parts: Column | str) -> Column:
    """The cache key of a request."""
    return F.md5(F.concat_ws("|", *[col(p) for p in parts]))
