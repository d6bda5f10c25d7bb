"""Text functions. Python's white space is Unicode's, so trimming goes by (?U)\\s and not by trim()."""

from __future__ import annotations

import html
import html.entities
import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def squash(c: Column | str) -> Column:
    """White space collapsed to single blanks and trimmed; null becomes the empty string."""
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)\s+", " "))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def title_abstract(title: Column | str, abstract: Column | str) -> Column:
    """The text that rules run over: both with one blank between, nulls as empty strings."""
    return F.concat(F.coalesce(col(title), F.lit("")), F.lit(" "), F.coalesce(col(abstract), F.lit("")))


def clean_label(c: Column | str) -> Column:
    """A label as text, trimmed and in lower case."""
    return F.lower(strip(col(c).cast("string")))


@F.pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    """Character references to characters; Spark has no function for the full HTML set."""
    return s.map(html.unescape, na_action="ignore")


_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[0-9A-Za-z]+);")


@F.pandas_udf(T.StringType())
def unescape_closed(s: pd.Series) -> pd.Series:
    """The same for references that end in a semicolon; names without one, as browsers forgive them, stay text."""
    one = lambda m: html.unescape(m[0]) if m[0][1] == "#" else html.entities.html5.get(m[0][1:], m[0])
    return s.map(lambda t: _CLOSED.sub(one, t), na_action="ignore")


def clean_html(c: Column | str, closed: bool = False) -> Column:
    """Markup to blanks, references decoded (closed: only those with a semicolon), white space collapsed; nothing left is null."""
    decode = unescape_closed if closed else unescape
    return blank_to_null(squash(decode(F.regexp_replace(col(c), r"<[^>]+>", " "))))


def clean_fields(fields: Mapping[str, Column]) -> Column:
    """A struct of clean_html of each field, with a single call for all of a row's character references."""
    markup = F.array(*[F.coalesce(F.regexp_replace(c, r"<[^>]+>|\x00", " "), F.lit("")) for c in fields.values()])
    parts = F.split(unescape(F.array_join(markup, "\0")), "\0")  # no reference decodes to a null character
    return F.struct(*[blank_to_null(squash(F.get(parts, F.lit(i)))).alias(name) for i, name in enumerate(fields)])


def clean_markup(c: Column | str) -> Column:
    """clean_html with the five predefined references alone, without Python."""
    out = F.regexp_replace(col(c), r"<[^>]+>", " ")
    # The predefined character references; the ampersand comes last so that nothing is decoded twice.
    for reference, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(reference), F.lit(character))
    return blank_to_null(squash(out))


# Fixed value: how pages mark up a labelled field.
LABELLED = r"(?si){name}:?\s*</div>\s*<div[^>]*>(.*?)</div>"


def labelled_field(page: Column | str, name: str) -> Column:
    """The raw content of the div that follows a div ending in `name`, or null."""
    found = F.regexp_extract(col(page), LABELLED.replace("{name}", name), 1)
    return blank_to_null(found)


def page_title(page: Column | str) -> Column:
    """The title element without its last ' - suffix'."""
    title = F.regexp_extract(col(page), r"(?si)<title[^>]*>(.*?)</title>", 1)
    return blank_to_null(F.regexp_replace(title, r" - (?!.* - ).*$", ""))


def or_none(c: Column | str) -> Column:
    """What a prompt shows for a field: the trimmed text, or (none)."""
    return F.coalesce(blank_to_null(strip(c)), F.lit("(none)"))


def render(template: str, **fields: Column | str) -> Column:
    """A template with {name} places filled by or_none of the fields."""
    out = F.lit(template)
    for name, c in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), or_none(c))
    return out
