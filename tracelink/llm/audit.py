"""Filter interaction audit by inclusion-exclusion.

Which filter removes what depends on the order they run in. Instead of running every order, the documents that fail all
filters of a set together are counted for each of the 32 sets, as sums of products of flags. Everything else follows from
these joint-failure counts J(S) by signed sums, whatever the order:

* kept(T), the survivors of the filters T: the sum over S within T of (-1)^|S| J(S), a Moebius inversion;
* failing i alone: the sum over S with i of (-1)^(|S|-1) J(S);
* the coalition value v(T) = total - kept(T) has the Harsanyi dividends (-1)^(|S|-1) J(S), and a Shapley value is the sum of
  the dividends of its sets, each shared equally among the |S| members.

So the texts are read once, and after the counts there are at most 32 numbers a part and weight. A text goes through no shuffle:
a 256-bit hash stands for it. Copies are counted per (hash, part, labels) before they meet, so a text that makes up a third of
all rows is a few rows by then.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"


def _few_words(words: Column, text: Column) -> Column:
    return F.size(words) < 200


def _repetitive(words: Column, text: Column) -> Column:
    return F.size(F.array_distinct(words)) * 100 < F.size(words) * 50


def _capitals(words: Column, text: Column) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))) * 100 > F.length(text) * 2


def _symbols(words: Column, text: Column) -> Column:
    return text.rlike(r"[#$%&*|]")


#: Filters by letter: a failure condition over (words, text). The letter after the last is the filter of copies.
TEXT_FILTERS: Mapping[str, Callable[[Column, Column], Column]] = {"A": _few_words, "B": _repetitive, "C": _capitals, "D": _symbols}
COPIES = "E"


def flag_counts(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Callable[[Column, Column], Column]] = TEXT_FILTERS) -> DataFrame:
    """Documents by what they fail: (part, one 0/1 column a filter, good, toxic, n).

    A null text counts as empty, a null source as ''. The copies filter fails rows whose text a smaller doc_id has too; rows
    without an id have none smaller and are smaller than none, and rows of one id and text fail or pass alike. A document is
    good (toxic) if any of its label rows has quality = 1 (toxic = 1).
    """
    names = sorted(filters)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.coalesce("source", F.lit("")).alias("part"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("h"), *[filters[f](F.col("words"), F.col("text")).cast("int").alias(f) for f in names])
    rows = rows.groupBy("doc_id", "part", "h", *names).agg(F.count("*").alias("n"))

    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("key"))
    marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # Rows without an id match no label; the hash spreads them over the join's tasks.
    rows = rows.withColumns({"key": F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("h")), "named": F.col("doc_id").isNotNull()})
    rows = rows.join(marks.withColumn("named", F.lit(True)), ["key", "named"], "left").fillna(0, ["good", "toxic"])

    nameless = F.coalesce(F.sum(F.when(~F.col("named"), F.col("n"))), F.lit(0))
    first = F.min(F.when(F.col("named"), F.struct(F.col("doc_id").alias("id"), "n")))
    texts = rows.groupBy("h", "part", *names, "good", "toxic").agg(F.sum("n").alias("n"), nameless.alias("nameless"), first.alias("first"))
    least = F.min("first.id").over(Window.partitionBy("h"))
    passing = F.col("nameless") + F.coalesce(F.when(F.col("first.id") == least, F.col("first.n")), F.lit(0))
    texts = texts.withColumn("passing", passing)
    split = F.array(F.struct(F.lit(0).alias(COPIES), F.col("passing").alias("n")), F.struct(F.lit(1).alias(COPIES), (F.col("n") - F.col("passing")).alias("n")))
    both = texts.select("part", *names, "good", "toxic", F.inline(split))
    return both.where("n > 0").groupBy("part", *names, COPIES, "good", "toxic").agg(F.sum("n").alias("n"))


def joint_failures(counts: DataFrame, names: str) -> DataFrame:
    """One row a part: the arrays n, good and toxic, whose entry m counts the documents that fail all filters of the set m
    (bit i: names[i]) together; entry 0 counts all."""
    flags = ["".join(f" * {f}" for i, f in enumerate(names) if m >> i & 1) for m in range(1 << len(names))]
    weights = {"n": "n", "good": "n * good", "toxic": "n * toxic"}
    return counts.groupBy("part").agg(*[F.expr(f"array({', '.join(f'sum({of}{product})' for product in flags)}) AS {w}") for w, of in weights.items()])


def interactions(joint: DataFrame, names: str) -> DataFrame:
    """A row for each part, order of all filters and step, from the joint failures alone; see `audit`."""
    k = len(names)
    sets, sign = f"sequence(0, {(1 << k) - 1})", "if(bit_count(s) % 2 = 0, 1L, -1L)"
    survivors = [f"transform({sets}, t -> aggregate({sets}, 0L, (a, s) -> if(s & t = s, a + {sign} * {w}[s], a))) AS {w}_kept" for w in ("n", "good", "toxic")]
    # The sums over the sets with filter i: failures of it alone, and its share of the dividends over all k! orders.
    having = f"transform(sequence(0, {k - 1}), i -> aggregate({sets}, 0L, (a, s) -> if(s & shiftleft(1, i) > 0, a - {sign} * n[s] * {{}}, a)))"
    unique, shares = having.format("1"), having.format(f"({math.factorial(k)} div bit_count(s))")
    parts = joint.selectExpr("part", *survivors, f"{unique} AS unique", f"{shares} AS shares", "n AS failures")

    orders = ", ".join(f"'{''.join(p)}'" for p in itertools.permutations(names))
    steps = parts.withColumn("filter_order", F.expr(f"explode(array({orders}))")).withColumn("step", F.expr(f"explode(sequence(1, {k}))"))
    place = f"locate(substring(filter_order, {{}}, 1), '{names}') - 1"
    earlier = f"aggregate(sequence(1, step), 0, (a, j) -> if(j < step, a | shiftleft(1, {place.format('j')}), a))"
    steps = steps.withColumns({"i": F.expr(place.format("step")), "before": F.expr(earlier)}).withColumn("after", F.expr("before | shiftleft(1, i)"))
    steps = steps.withColumns({f"{w}_gone": F.expr(f"{w}_kept[before] - {w}_kept[after]") for w in ("n", "good", "toxic")})
    return steps.selectExpr(
        "part",
        "filter_order",
        "step",
        "n_kept[after] AS kept",
        "n_gone AS removed",
        "failures[shiftleft(1, i)] - n_gone AS redundant",
        "unique[i] AS unique_fails",
        "good_gone AS good_lost",
        "toxic_gone AS toxic_lost",
        "shares[i] AS shapley",
    )


def audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Callable[[Column, Column], Column]] = TEXT_FILTERS) -> DataFrame:
    """What each filter removes, at each step of every order of the filters, for each source.

    docs: doc_id, text and source; labels: doc_id, quality and toxic; other columns are not read. Nulls are as in
    `flag_counts`; repeated rows count as often as they occur, an empty table gives no rows, and without labels nothing is
    lost. filters are named by letters before E, which is the filter of copies. Returns part, filter_order, step, kept, removed, redundant
    (failing the step's filter, removed earlier), unique_fails (failing it only), good_lost, toxic_lost and shapley (its
    removals summed over all orders).
    """
    names = "".join([*sorted(filters), COPIES])
    return interactions(joint_failures(flag_counts(docs, labels, filters), names), names)


AUDIT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
    (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
    + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)::INT AS m FROM d LEFT JOIN l USING (doc_id)),
g AS (SELECT part, m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, m),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT p.c || q.c || r.c || s.c || t.c AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bs FROM x p, x q, x r, x s, x t
    WHERE p.b + q.b + r.b + s.b + t.b = 31 AND len(list_distinct([p.b, q.b, r.b, s.b, t.b])) = 5),
k AS (SELECT filter_order, step, bs[step]::INT AS own, list_sum(bs[1:step - 1])::INT AS earlier
    FROM (SELECT filter_order, bs, unnest([1, 2, 3, 4, 5]) AS step FROM o)),
r AS (SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (m & (coalesce(earlier, 0) | own) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (m & coalesce(earlier, 0) = 0 AND m & own > 0), 0) AS removed,
    coalesce(sum(n) FILTER (m & coalesce(earlier, 0) > 0 AND m & own > 0), 0) AS redundant,
    coalesce(sum(n) FILTER (m = own), 0) AS unique_fails,
    coalesce(sum(good) FILTER (m & coalesce(earlier, 0) = 0 AND m & own > 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (m & coalesce(earlier, 0) = 0 AND m & own > 0), 0) AS toxic_lost
    FROM g, k GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""
