"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe() -> tuple[str, str, str]:
    """The files of the public byte-level BPE vocabulary."""
    import public_tokenizers as public

    return public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelink.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), byte_bpe(), window=1024, keep_ids=False).drop("token_ids")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelink.llm.dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), length=400, keep_text=False).drop("spans", "kept")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelink.llm.quality import quality

    return quality(table(spark, sf_dir, "documents")).drop("rejected_by")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelink.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3).select("doc_id", "held_out", "score", "predicted")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelink.llm.language import language

    return language(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelink.llm.sharding import assign_shards

    out = assign_shards(table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelink.llm.scoring import pseudo_likelihood

    return pseudo_likelihood(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelink.llm.jaccard import link_documents

    return link_documents(table(spark, sf_dir, "documents"), n=5, percent=80).drop("copies")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelink.llm.decontamination import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelink.llm.html import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelink.llm.trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    from tracelink.llm.bpe import Vocabulary, decode, encode

    v = Vocabulary.read(public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)
    ids = encode(table(spark, sf_dir, "documents"), v)
    ids = ids.withColumns({"n_tokens": F.size("token_ids").cast("long"), "ids_sha256": F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256)})
    return decode(ids, v).select("doc_id", "n_tokens", "ids_sha256", F.sha2("content", 256).alias("decoded_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelink.llm.audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {"op1_packing": op1_packing, "op2_suffix_dedup": op2_suffix_dedup, "op3_quality": op3_quality, "op4_toxicity": op4_toxicity, "op5_language": op5_language, "op6_sharding": op6_sharding, "op7_scoring": op7_scoring, "op8_ngram_jaccard": op8_ngram_jaccard, "op9_decontamination": op9_decontamination, "op10_html": op10_html, "op11_conversation_trie": op11_conversation_trie, "op12_bpe": op12_bpe, "op13_filter_audit": op13_filter_audit, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    from tracelink.llm.audit import AUDIT_SQL
    from tracelink.llm.quality import QUALITY_SQL

    return {"op3_quality": QUALITY_SQL, "op13_filter_audit": AUDIT_SQL}
