"""Matching papers to works by title and year, where no identifier does.

Titles are normalised. What does not match as it is is looked up in a deletion neighbourhood: two titles within one edit of each
other have a string in common that is either of them, or either with one character deleted (two edits: up to two characters).
Only hashes of these strings with the year are joined, each with a hash that stands for its title and year; the titles themselves
are joined to what meets, and years and edit distance verified, so the result is that of comparing all pairs.

Titles are counted before they are indexed, so one that thousands of works bear ("introduction") is a single row with a count,
and a bucket of the index holds at most the distinct titles of a year that differ in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accented letters and what they are folded to.
ACCENTS = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿß"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyys"


def normal_title(title: Column | str) -> Column:
    """Lower case without accents; letters and digits in words, parted by single spaces."""
    c = F.col(title) if isinstance(title, str) else title
    return F.trim(F.regexp_replace(F.translate(F.lower(c), ACCENTS, PLAIN), r"[^\p{L}\p{N}]+", " "))


def neighbourhood(title: str, edits: int = 1) -> Column:
    """Distinct hashes of the title with up to `edits` (1 or 2) characters deleted."""
    if edits not in (1, 2):
        raise ValueError("edits must be 1 or 2")
    one = f"transform(sequence(1, length({title})), i -> concat(left({title}, i - 1), substring({title}, i + 1)))"
    near = f"array_append({one}, {title})"
    if edits == 2:
        near = f"array_append(flatten(transform({near}, t -> array_append(if(length(t) > 0, transform(sequence(1, length(t)), j -> concat(left(t, j - 1), substring(t, j + 1))), array()), t))), {title})"
    return F.expr(f"array_distinct(transform({near}, t -> xxhash64(t)))")


def match_titles(papers: DataFrame, works: DataFrame, key: str, title: str, year: str, work: str, edits: int = 1, years: int = 1) -> DataFrame:
    """Adds to papers (key, title, year) the work (work, title, year) of the nearest title: status, work, distance and candidates.

    A work is a candidate if its normalised title is within `edits` edits and its year within `years`. The least distance
    wins, then the least gap of years. status: `matched` if exactly one work is left, `ambiguous` if more are (work is then null), `none` if there
    is none. Null or blank titles and null years match nothing. Every paper comes back once for each of its rows.
    """
    paper = papers.select(F.col(key), normal_title(title).alias("t"), F.col(year).cast("long").alias("y"))
    usable = "t <> '' AND y IS NOT NULL"
    wanted = paper.where(usable).select("t", "y").distinct()
    known = works.where(F.col(work).isNotNull()).select(normal_title(title).alias("t"), F.col(year).cast("long").alias("y"), F.col(work).alias("w")).where(usable)
    known = known.groupBy("t", "y").agg(F.min("w").alias("w"), F.count("*").alias("n"))
    exact = wanted.join(known, ["t", "y"]).selectExpr("t", "y", "0 AS distance", "0L AS gap", "n", "w")

    left = wanted.join(exact, ["t", "y"], "left_anti").withColumn("key", F.xxhash64("t", "y"))
    right = known.select(F.col("t").alias("wt"), F.col("y").alias("at"), "w", "n").withColumn("work_key", F.xxhash64("wt", "at"))
    spots = lambda rows, title, at, key: rows.select(key, at, F.explode(neighbourhood(title, edits)).alias("h")).select(key, F.xxhash64("h", "at").alias("spot"))
    wide = left.withColumn("at", F.explode(F.sequence(F.col("y") - years, F.col("y") + years)))
    # Spark sizes a neighbourhood like its title, hundreds of times too small, and would broadcast it through the driver.
    pairs = spots(wide, "t", "at", "key").join(spots(right, "wt", "at", "work_key").hint("merge"), "spot").select("key", "work_key").distinct()
    pairs = pairs.join(left, "key").join(right, "work_key").where(F.abs(F.col("at") - F.col("y")) <= years)
    near = pairs.withColumn("distance", F.levenshtein("t", "wt", edits)).where("distance >= 0")
    near = near.withColumn("gap", F.abs(F.col("at") - F.col("y")))
    # A title's candidates are few: those within the edits.
    level = near.groupBy("t", "y", "distance", "gap").agg(F.sum("n").alias("n"), F.min("w").alias("w"))
    best = level.groupBy("t", "y").agg(F.min(F.struct("distance", "gap", "n", "w")).alias("b")).select("t", "y", "b.*")
    found = exact.unionByName(best)
    out = paper.join(found, ["t", "y"], "left")
    status = F.when(F.col("n").isNull(), "none").when(F.col("n") == 1, "matched").otherwise("ambiguous")
    return out.select(key, status.alias("status"), F.when(F.col("n") == 1, F.col("w")).alias(work), "distance", F.coalesce("n", F.lit(0)).alias("candidates"))
