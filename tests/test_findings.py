"""Cases that a review found."""

import io
import re
import tarfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracelink.labelling import cache
from tracelink.operators.titles import match_titles
from tracelink.plans import landed
from tracelink.plans import queries as plans
from tracelink.sources import archives, quoted


@pytest.fixture
def table(spark, tmp_path):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put


def test_snippets_of_every_hit(spark, table):
    d = table("documents", [(1, "a licence, no more"), (2, "a license with terms"), (3, None), (4, "Licence held by all")], "doc_id long, text string")
    assert [(r.doc_id, r.snippet, r.item) for r in plans.term_snippets(spark, d).orderBy("item").collect()] == [(1, "a licence, no more", 1), (2, "a license with terms", 2)]


def test_references_without_a_semicolon_stay(spark, table):
    d = table("pages", [(1, "<p>a &amp b &amp;copy; &copy; &quot;c&quot; &copyx; &notit;</p> &am")], "page_id long, html string")
    assert plans.html_unescape(spark, d).first().n == len("a &amp b &copy; © \"c\" &copyx; &notit; &am")


def stage_tasks(spark, group):
    tracker = spark.sparkContext.statusTracker()
    return [tracker.getStageInfo(i).numTasks for j in tracker.getJobIdsForGroup(group) for i in tracker.getJobInfo(j).stageIds]


def test_small_archives_share_tasks(spark, tmp_path):
    for k in range(40):
        with tarfile.open(f"{tmp_path}/a{k}.tar", "w") as tar:
            for name in (f"x/data/xml/{k}a.xml", f"x/data/xml/{k}b.xml"):
                info = tarfile.TarInfo(name)
                info.size = 700 + k
                tar.addfile(info, io.BytesIO(bytes([k]) * (700 + k)))
    spark.sparkContext.setJobGroup("archives", "")
    rows = archives.archive_members(spark, f"{tmp_path}/*.tar").collect()
    spark.sparkContext.setJobGroup("", "")
    assert sorted((r.name, bytes(r.raw)) for r in rows) == sorted((f"x/data/xml/{k}{c}.xml", bytes([k]) * (700 + k)) for k in range(40) for c in "ab")
    assert len({r.archive for r in rows}) == 40 and len({(r.archive, r.name[11:-5]) for r in rows}) == 40
    assert max(stage_tasks(spark, "archives")) <= 4 * spark.sparkContext.defaultParallelism


def test_patent_records_land_in_few_files(spark, table, tmp_path, monkeypatch):
    d = table("supplier", [(k, f"n{k}") for k in range(300)], "s_suppkey long, s_name string")
    monkeypatch.setattr(landed, "landing", lambda s: f"{tmp_path}/landed")
    rows = landed.patent_records(spark, d).collect()
    assert sorted(r.title for r in rows) == sorted(f"n{k}" for k in range(300) if k % 5 and k % 7 and k % 11 != 3)
    assert len(list((tmp_path / "landed").glob("part-*"))) <= 16


def test_batches_of_lines_have_a_bound_in_bytes(spark, tmp_path):
    (tmp_path / "long.csv").write_text("\n".join(["x" * 1_000_000] * 40))
    sizes = quoted._lines(spark, str(tmp_path)).mapInPandas(lambda batches: (pd.DataFrame({"n": [b["value"].str.len().sum()]}) for b in batches), "n long")
    got = [r.n for r in sizes.collect()]
    assert sum(got) == 40_000_000 and max(got) <= 6_000_000


def test_prompts_are_made_once_a_fill(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def prompt(k):
        made.add(1)
        return f"p{k}"

    prompts = spark.range(60).select(prompt("id").alias("prompt")).select(F.md5("prompt").alias("key"), "prompt")
    store = cache.ResponseCache(spark, f"file://{tmp_path}/c", digits=1)
    assert store.fill(prompts, lambda ps: [f"r{p}" for p in ps], rows_a_batch=20) == 3
    assert made.value <= 2 * 60  # the filter on keys may make them again
    assert {r.raw for r in store.read().collect()} == {f"rp{k}" for k in range(60)} and not list((tmp_path / "c").glob("asked-*"))


def test_titles_are_joined_by_hashes(spark):
    title = " ".join(f"word{k}" for k in range(30))
    papers = spark.createDataFrame([(1, title[:5] + title[6:], 2000), (2, title, 2001), (3, title + "s", 2003)], "paper long, title string, year int")
    works = spark.createDataFrame([(7, title, 2000), (8, title + "x", 2003)], "work long, title string, year int")
    out = match_titles(papers, works, "paper", "title", "year", "work")
    assert {r.paper: (r.work, r.distance) for r in out.collect()} == {1: (7, 1), 2: (7, 1 - 1), 3: (8, 1)}
    indexed = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Project [" in line and " AS h#" not in line and "spot#" in line]
    assert len(indexed) >= 2 and not any(re.search(r"\bw?t#", line) for line in indexed)


def test_neighbourhoods_of_titles_are_not_broadcast(spark):
    """Their size is estimated as that of the titles, so a row for each of their characters went through the driver."""
    works = spark.createDataFrame([(1, "a title", 2000), (2, "b title", 2000)], "work long, title string, year int")
    out = match_titles(works.withColumnRenamed("work", "paper").withColumn("title", F.concat("title", F.lit("s"))), works, "paper", "title", "year", "work")
    assert sorted((r.paper, r.work) for r in out.collect()) == [(1, 1), (2, 2)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"(\w+Join) \[spot#", plan) and set(re.findall(r"(\w+Join) \[spot#", plan)) == {"SortMergeJoin"}
