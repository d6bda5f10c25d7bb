"""The corpus pipeline: toxicity, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir), with docs the documents that the stage before kept, and works on all of them. All
but the last return the columns of documents. Every row is a document of its own, with or without a doc_id; operators get a
hash of doc_id and text in its place, which only equal rows share, so these are decided alike. Other columns go along
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelink.llm.decontamination import find_leaks
from tracelink.llm.dedup import remove_repeats
from tracelink.llm.jaccard import link_documents
from tracelink.llm.packing import pack
from tracelink.llm.queries import byte_bpe, table
from tracelink.llm.shared import identified, remove, scratch, stored
from tracelink.llm.toxicity import fit, score


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs as (row, doc), the hash and all columns in one, and (doc_id, text) for an operator, with the hash as doc_id."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("doc"), F.col("doc_id").alias("id"), "text")
    rows = identified(rows.withColumnRenamed("id", "doc_id")).select(F.col("u").alias("row"), "doc")
    return rows, identified(docs.select("doc_id", "text")).select(F.col("u").alias("doc_id"), "text")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score is 0.3 or more; null and empty texts stay, repeated rows go or stay alike, and
    without any labels, or on an empty table, nothing goes."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    rows, texts = _keyed(docs)
    toxic = score(texts, model).where("score >= 0.3").select(F.col("doc_id").alias("row")).distinct()
    return rows.join(toxic, "row", "left_anti").select("doc.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: that of the least doc_id, one without an id only where none has
    one. Texts without words are in no group; equal rows stay once; an empty table stays empty."""
    rows, texts = _keyed(docs)
    # Equal rows share their hash and group; they meet once.
    groups = link_documents(texts, n=5, percent=80).select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")).distinct()
    ranked = rows.select("row", F.col("doc.doc_id").alias("id")).distinct().join(groups, "row")
    first = ranked.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first")).select("first.row")
    return rows.join(first, "row", "left_semi").dropDuplicates(["row"]).select("doc.*")


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 240 bytes or more that occur elsewhere too, in equal rows as well; a document of which nothing is
    left goes. Null and empty texts stay as they are, and so does an empty table."""
    rows, texts = _keyed(docs)
    kept = remove_repeats(texts, length=240).where("n_removed > 0").select(F.col("doc_id").alias("row"), "kept").dropDuplicates(["row"])
    out = rows.join(kept, "row", "left").where(F.col("kept").isNull() | (F.trim("kept") != ""))
    text = F.coalesce("kept", "doc.text")
    changed = F.col("doc").withField("text", text)
    if "n_chars" in docs.columns:
        changed = changed.withField("n_chars", F.when(F.col("kept").isNull(), F.col("doc.n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType))
    return out.select(changed.alias("doc")).select("doc.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a copy of a benchmark item; null and empty texts stay, repeated rows go or stay alike, and
    without items, or on an empty table, nothing goes."""
    rows, texts = _keyed(docs)
    leaks = find_leaks(texts, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("row")).distinct()
    return rows.join(leaks, "row", "left_anti").select("doc.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens; a null or empty text is its end alone, rows are packed as often as
    they occur, and an empty table gives no pieces."""
    return pack(docs, byte_bpe(), window=1024)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", repeated_passage_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]
#: No stage can be expressed in SQL; tests/llm checks them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's documents go once the next stage's are written, and only the last one's stay."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs, path = stored(stage(spark, docs, sf_dir), name)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
