"""Very many rows of one id, or of none, and one text: time and rows in proportion to their number."""

import collections
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracelink.llm import dedup, jaccard, sharding

MANY = 20_000
PROSE = " ".join(f"w{i * i % 1009}" for i in range(320))  # some 1.5 kB
NEAR = PROSE.replace("w9 ", "other ")


@pytest.fixture(scope="module", params=[(7, MANY), (None, MANY // 5)], ids=["one id", "no id"])
def docs(spark, request):
    which, many = request.param
    own = spark.range(100, 160).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 60), i -> md5(concat(id, ':', i)))) AS text")
    hot = spark.range(many).select(F.lit(which).cast("long").alias("doc_id"), F.lit(PROSE).alias("text"))
    near = spark.range(many).select(F.lit(8).cast("long").alias("doc_id"), F.lit(NEAR).alias("text"))
    return own.unionByName(hot).unionByName(near).repartition(8).cache()


def test_dedup(docs):
    got = dedup.remove_repeats(docs, length=400, keep_text=False)
    counts = {tuple(r)[:3]: r[3] for r in got.groupBy("doc_id", "n_removed", "n_spans").count().collect()}
    hot = [k for k in counts if k[0] is None or k[0] in (7, 8)]
    assert len(hot) == 2 and all(counts[k] == docs.count() // 2 - 30 and k[2] == 1 and k[1] in (len(PROSE), len(NEAR)) for k in hot)
    assert all(n == 1 and k[1] == 0 for k, n in counts.items() if k not in hot) and len(counts) == 62
    spans = dedup._spans(dedup.identified(docs).withColumn("v", F.col("v").bitwiseAND(0x7FFFFFFF).cast("int")), dedup.Shape(400))
    assert spans.agg(F.max(F.size("starts"))).first()[0] < 2 * len(PROSE)


def test_time_grows_in_proportion(spark):
    def took(m):
        docs = spark.range(m).select(F.lit(1).cast("long").alias("doc_id"), F.lit(PROSE).alias("text"))
        start = time.perf_counter()
        assert dedup.remove_repeats(docs, keep_text=False).where(F.col("n_removed") == len(PROSE)).count() == m
        return time.perf_counter() - start

    took(10)
    assert took(4_000) < 4 * took(500) + 10


def test_jaccard(docs, monkeypatch):
    staged, sizes = jaccard.staged, collections.Counter()

    def counted(df, name):
        out = staged(df, name)
        sizes[name] += out.count()
        return out

    monkeypatch.setattr(jaccard, "staged", counted)
    got = jaccard.link_documents(docs).groupBy("doc_id", "component_id", "copies").count().collect()
    hot = [r for r in got if r.doc_id is None or r.doc_id < 100]
    least = 7 if any(r.doc_id == 7 for r in hot) else 8
    assert len(hot) == 2 and all(r.component_id == least and r.copies == r["count"] == docs.count() // 2 - 30 for r in hot)
    assert sizes["texts"] == 2 and sizes["links"] == 1


def test_sharding(docs):
    got = sharding.assign_shards(docs, 40).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("top"), F.countDistinct("slot").alias("slots")).collect()
    sizes = [r.b for r in got]
    assert len(got) == 40 and max(sizes) < 1.03 * min(sizes)
    assert all(r.n == r.slots == r.top + 1 for r in got) and sum(r.n for r in got) == docs.count()


def test_pipeline_stage(spark, docs, data):
    docs = docs.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text")})
    got = corpus_pipeline.near_duplicate_stage(spark, docs, data).collect()
    assert len(got) == 61 and sum(r.doc_id is None or r.doc_id < 100 for r in got) == 1
