"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a condition under which a document is rejected. Rules cost different amounts to evaluate and reject different
shares of the documents; as a rule is only evaluated for what the rules before it let pass, the order that minimises the
expected work is by rejections per cost. Both are estimated on a sample: the rejected share by counting, the cost by timing.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
HAS_WORD = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class Rule:
    """reject: true for documents to reject, over the columns text, words, n_words and word_chars."""

    name: str
    reject: Column


def _marks(pattern: str) -> Column:
    """Characters of the class `pattern` in the text."""
    return F.length("text") - F.length(F.regexp_replace("text", pattern, ""))


def default_rules() -> list[Rule]:
    """The rules of the method; thresholds are shares that hold for texts of any length and language."""
    return [
        Rule("symbols", _marks(r"[#*$%&|<>]+") * 10 > F.col("n_words")),
        Rule("shouting", _marks(r"[!?]+") * 4 > F.col("n_words")),
        Rule("repeated_lines", (n_dup_lines() >= 3) & (F.lit(10) * n_dup_lines() > F.lit(3) * F.size(lines()))),
        Rule("word_length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))),
        Rule("few_words_distinct", (F.col("n_words") >= 50) & (F.size(F.array_distinct("words")) * 10 < F.least(F.col("n_words"), F.lit(1000)))),
        Rule("digits", _marks(r"[0-9]+") * 5 > F.col("word_chars")),
    ]


def lines() -> Column:
    """The text's lines that have a word."""
    return F.filter(F.split("text", "\n"), lambda x: x.rlike(HAS_WORD))


def n_dup_lines() -> Column:
    """Lines with a word that equal an earlier line."""
    return F.size(lines()) - F.size(F.array_distinct(lines()))


def with_words(docs: DataFrame) -> DataFrame:
    """Adds words, n_words and word_chars; a null text counts as empty."""
    return (
        docs.withColumn("text", F.coalesce("text", F.lit("")))
        .withColumn("words", F.array_remove(F.split("text", SPACES), ""))
        .withColumns({"n_words": F.size("words").cast("long"), "word_chars": F.length(F.array_join("words", "")).cast("long")})
    )


def with_repeats(rows: DataFrame, n: int = 3) -> DataFrame:
    """Adds n_repeat_words: words inside windows of n words that occur twice or more in the text.

    Windows are compared by 64-bit hashes. Sorting (hash, place) brings equal windows together; the places of repeated
    windows, sorted again, cover min(n, distance to the next) words each. Nothing is exploded, so nothing is shuffled.
    """
    hashes = F.when(F.size("words") >= n, F.transform(F.sequence(F.lit(0), F.size("words") - n), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(n)])))
    pairs = F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    same = lambda e, at: F.coalesce(F.get("pairs", at).getField("h") == e.getField("h"), F.lit(False))
    starts = F.sort_array(F.transform(F.filter("pairs", lambda e, j: same(e, j - 1) | same(e, j + 1)), lambda e: e.getField("i")))
    covered = F.aggregate(F.transform("starts", lambda p, k: F.least(F.lit(n), F.coalesce(F.get("starts", k + 1) - p, F.lit(n)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return (
        rows.withColumn("h", hashes)
        .withColumn("pairs", pairs)
        .withColumn("starts", starts)
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
        .drop("h", "pairs", "starts")
    )


def order_rules(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = 1000, seed: int = 7) -> list[tuple[Rule, float, float]]:
    """Rules with their estimated rejected share and seconds, in the order of the cascade.

    The sample is of about sample_rows rows and serves the order alone, which changes no verdict. Each rule is timed over
    it twice; the lower time counts, less that of a scan without a rule.
    """
    n = docs.count()
    sample = with_words(docs.select("text").sample(min(1.0, sample_rows / max(n, 1)), seed)).cache()
    try:
        rows = sample.agg(F.count("*"), F.max("n_words")).first()[0]

        def timed(reject: Column) -> tuple[float, int]:
            runs = []
            for _ in range(2):
                t = time.perf_counter()
                hits = sample.agg(F.count_if(reject)).first()[0]
                runs.append(time.perf_counter() - t)
            return min(runs), hits

        base = timed(F.col("n_words") < 0)[0]
        found = []
        for rule in rules:
            seconds, hits = timed(rule.reject)
            found.append((rule, hits / max(rows, 1), max(seconds - base, 1e-4)))
    finally:
        sample.unpersist()
    return sorted(found, key=lambda x: (-x[1] / x[2], x[0].name))


def cascade(rules: Sequence[Rule]) -> Column:
    """The name of the first rule that rejects, or null. CASE evaluates a branch only if all before it were false."""
    out = None
    for rule in rules:
        out = F.when(rule.reject, F.lit(rule.name)) if out is None else out.when(rule.reject, F.lit(rule.name))
    return out if out is not None else F.lit(None).cast("string")


def quality(docs: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Measures every text and says whether it is kept.

    The base rejects texts of under 50 words and those with more than half of their words in repeated 3-word windows; the
    cascade decides on the others. A null or empty text has no words and fails the base. Repeated rows get equal verdicts,
    an empty table gives no rows, and columns other than doc_id and text are not read.
    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and rejected_by (the
    first rule in the cascade's order, 'base', or null).
    """
    docs = docs.select("doc_id", "text")
    ordered = [r for r, _, _ in order_rules(docs, default_rules() if rules is None else rules)]
    rows = with_repeats(with_words(docs)).withColumns(
        {
            "n_symbols": _marks(r"[#*$%&|<>]+").cast("long"),
            "n_dup_lines": n_dup_lines().cast("long"),
            "base_failed": (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50),
        }
    )
    by = F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(ordered))
    return rows.withColumn("rejected_by", by).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by"
    )


QUALITY_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM documents),
m AS (SELECT doc_id, text, ws, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines FROM t),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM t WHERE len(ws) >= 3)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS q FROM c WHERE n > 1) GROUP BY doc_id),
b AS (SELECT m.*, coalesce(n_repeat_words, 0) AS n_repeat_words,
    n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed FROM m LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words
    OR 4 * (length(text) - length(regexp_replace(text, '[!?]', '', 'g'))) > n_words
    OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines)
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR (n_words >= 50 AND 10 * len(list_distinct(ws)) < least(n_words, 1000))
    OR 5 * (length(text) - length(regexp_replace(text, '[0-9]', '', 'g'))) > word_chars) AS kept
FROM b
"""
