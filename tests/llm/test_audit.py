"""The filter audit against running every order, on messy rows too."""

import collections
import itertools
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tracelink.llm import audit

LONG = " ".join(f"w{i % 977}" for i in range(200_000))
SAME = "same " * 250
TEXTS = [None, "", "one", "one", "ONE #", "ONE #", SAME, SAME, SAME, LONG, LONG + " $", "Aa Bb " * 300, " ".join(f"v{i}" for i in range(300)), " ".join(f"v{i}" for i in range(300)) + " x|y", "\x00 tab\t", "ÀÉ"]


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, t, None if i % 3 == 0 else f"s{i % 2}") for i, t in enumerate(TEXTS)]
    rows += [(6, SAME, "s1"), (6, SAME, "s1"), (None, SAME, ""), (None, None, None), (-5, "one", "s1"), (12, TEXTS[12], "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("x") for c in ("part", "h", "n", "words", "good", "toxic", "A", "E", "key", "named", "first", "step")})
    labels = [(0, 1, 0), (3, 1, 1), (3, 0, None), (6, 1, 0), (7, None, 1), (8, 1, 1), (None, 1, 1), (13, 1, 1), (99, 1, 1)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def by_hand(docs, labels):
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    out = {}
    parts = collections.defaultdict(list)
    for d, t, s in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        caps = sum("A" <= c <= "Z" for c in t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * caps > 2 * len(t), "D": re.search(r"[#$%&*|]", t) is not None, "E": d is not None and d > least[t]}
        parts[s or ""].append(({c for c, f in fails.items() if f}, d in good, d in toxic))
    for part, rows in parts.items():
        removed = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = rows
            for i, c in enumerate(order):
                go = [r for r in left if c in r[0]]
                left = [r for r in left if c not in r[0]]
                removed[c] += len(go)
                fail = [r for r in rows if c in r[0]]
                out[part, "".join(order), i + 1] = [len(left), len(go), len(fail) - len(go), sum(r[0] == {c} for r in rows), sum(r[1] for r in go), sum(r[2] for r in go), c]
        for key, v in out.items():
            if key[0] == part:
                v[-1] = removed[v[-1]]
    return out


def collected(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def test_every_order(tables):
    docs, labels = tables
    want = by_hand([tuple(r) for r in docs.select("doc_id", "text", "source").collect()], [tuple(r) for r in labels.collect()])
    assert collected(audit.audit(docs, labels)) == want


def test_none(spark, tables):
    docs, labels = tables
    assert audit.audit(docs.limit(0), labels).count() == 0
    got = audit.audit(docs, labels.limit(0))
    assert got.where("good_lost + toxic_lost > 0").count() == 0 and got.count() == 600 * 3


def test_types(tables):
    kinds = dict(audit.audit(*tables).dtypes)
    assert kinds.pop("part") == kinds.pop("filter_order") == "string" and kinds.pop("step") == "int" and set(kinds.values()) == {"bigint"}


def test_one_copy_of_many_meets_one_task(spark):
    """Copies are counted before their window: 30,000 copies are one row of it."""
    docs = spark.range(30_000).selectExpr("id AS doc_id", "'one text of many' AS text", "'s' AS source")
    counts = audit.flag_counts(docs, spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int"))
    got = {(r.E, r.good): r.n for r in counts.collect()}
    assert got == {(0, 0): 1, (1, 0): 29_998, (1, 1): 1}


def test_own_filters(tables):
    docs, labels = tables
    got = audit.audit(docs, labels, {"A": lambda words, text: F.length(text) == 0, "B": lambda words, text: F.size(words) == 1})
    want = {"ABE", "AEB", "BAE", "BEA", "EAB", "EBA"}
    assert {r.filter_order for r in got.select("filter_order").distinct().collect()} == want
    assert got.groupBy("part").agg(F.sum(F.when(F.col("step") == 3, F.col("kept"))).alias("k"), F.countDistinct(F.when(F.col("step") == 3, F.col("kept"))).alias("d")).where("d <> 1").count() == 0


def test_sql_on_messy_rows(tables):
    docs, labels = tables[0].select("doc_id", "text", "source").toPandas(), tables[1].toPandas()  # noqa: F841
    docs["doc_id"], labels["doc_id"] = docs["doc_id"].astype("Int64"), labels["doc_id"].astype("Int64")
    labels["quality"], labels["toxic"] = labels["quality"].astype("Int64"), labels["toxic"].astype("Int64")
    con = duckdb.connect()
    con.register("documents", docs)
    con.register("labels", labels)
    want = {r[:3]: list(r[3:]) for r in con.sql("SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley FROM (" + audit.AUDIT_SQL + ")").fetchall()}
    assert collected(audit.audit(*tables)) == want
