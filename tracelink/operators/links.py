"""Linking papers to the citation edge list, and what the links amount to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_by(rows: DataFrame, keys: list[str] | str, *order: str, last: bool = False) -> DataFrame:
    """Keep-first: the row of each key that comes first (or last) in an explicit order; end it with a unique column.

    An aggregate and not a window, so a task passes on one row per key and a frequent key does not meet in one task.
    """
    keys = [keys] if isinstance(keys, str) else keys
    rest = [c for c in rows.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    found = rows.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_r")) if rest else rows.select(*keys).distinct()
    return found.select(*[F.col(f"_r.{c}").alias(c) if c in rest else F.col(c) for c in rows.columns])


def resolve(papers: DataFrame, works: DataFrame, key: str, *order: str) -> DataFrame:
    """papers left join works, of which the first one of each key counts. Null keys match nothing."""
    return papers.join(first_by(works.where(F.col(key).isNotNull()), key, *order), key, "left")


def cited_by(citations: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The edges of wanted works: a semi join, so edges are neither lost nor multiplied. Spark broadcasts a small side."""
    return citations.join(wanted.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")


def with_papers(links: DataFrame, papers: DataFrame, key: str) -> DataFrame:
    """Adds the papers' columns. A work that several papers resolve to multiplies its links; see link_summary."""
    return links.join(papers, key, "left")


def is_applicant(reftype: Column | str) -> Column:
    """Cited by the applicant; anything else, null included, counts as the examiner's or other."""
    c = F.col(reftype) if isinstance(reftype, str) else reftype
    return F.coalesce(F.startswith(F.lower(c), F.lit("app")), F.lit(False))


def link_summary(edges: DataFrame, links: DataFrame, applicant: Column, confident: Column, work: str, patent: str) -> DataFrame:
    """One row: links before and after the join with papers, and exact distinct works and patents, over all and by kind.

    Distinct counts come from one grouping by patent and one by work, not from many distinct aggregates at once.
    """
    flags = {"app": applicant, "other": ~applicant, "confident": confident, "app_confident": applicant & confident}
    rows = links.select(F.col(work).alias("w"), F.col(patent).alias("p"), *[F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()])
    patents = rows.groupBy("p").agg(F.count("*").alias("n"), *[F.max(n).alias(n) for n in flags])
    part = lambda df, **cols: df.agg(*[c.alias(n) for n, c in cols.items()])
    a = part(patents, n_links=F.coalesce(F.sum("n"), F.lit(0)), n_patents=F.count("p"), **{f"n_patents_{n}": F.count_if(F.col(n) & F.col("p").isNotNull()) for n in flags})
    b = part(rows.select("w").where("w IS NOT NULL").distinct(), n_works=F.count("*"))
    c = part(edges, n_edges=F.count("*"))
    one = [x.withColumn("_k", F.lit(1)) for x in (a, b, c)]  # single rows
    return one[0].join(one[1], "_k").join(one[2], "_k").drop("_k")


def frequency(rows: DataFrame, value: str) -> DataFrame:
    """Rows of each value, null included, and their share."""
    counts = rows.groupBy(value).agg(F.count("*").alias("n")).withColumn("_k", F.lit(1))
    total = counts.agg(F.sum("n").alias("_total")).withColumn("_k", F.lit(1))  # a single row
    return counts.join(F.broadcast(total), "_k").select(value, "n", (F.col("n") / F.col("_total")).alias("share"))


def top(rows: DataFrame, value: str, k: int) -> DataFrame:
    """The k most frequent values; ties go by the value."""
    return rows.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(k)


def unlinked(rows: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """Distinct keys that are not taken."""
    return rows.select(key).where(F.col(key).isNotNull()).distinct().join(taken.select(key), key, "left_anti")


def distinct_lists(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The distinct values of each key, in order, as one array; for keys with few values."""
    return rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("values"))
