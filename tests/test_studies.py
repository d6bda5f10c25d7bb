"""Planned analyses, orders of all rows and the stored cache, against plain versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelink.labelling.cache import ResponseCache
from tracelink.operators import claims, rates, sampling
from tracelink.operators.ablation import threshold_ablation
from tracelink.operators.ordering import LEAST, Ordered, plain
from tracelink.operators.titles import match_titles, normal_title
from tracelink.stats.contingency import benjamini_hochberg
from tracelink.stats.correlation import spearman
from tracelink.stats.trend import logistic_trend

# Logistic trend


def reference_fit(x, y, g):
    """Newton steps and sandwich in plain numpy."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        h = x.T @ (x * (p * (1 - p))[:, None])
        b = b + np.linalg.solve(h, x.T @ (y - p))
    score = x * (y - 1 / (1 + np.exp(-x @ b)))[:, None]
    groups = np.unique(g)
    sums = np.stack([score[g == k].sum(0) for k in groups])
    v = np.linalg.inv(h) @ sums.T @ sums @ np.linalg.inv(h)
    n, k, m = len(y), x.shape[1], len(groups)
    return b, np.sqrt(np.diag(v * m / (m - 1) * (n - 1) / (n - k)))


def test_logistic_trend(spark):
    rng = np.random.default_rng(4)
    g = rng.integers(0, 40, 600)
    year, other = rng.integers(1990, 2020, 600), rng.normal(size=600).round(2)
    y = (rng.random(600) < 1 / (1 + np.exp(-(0.08 * (year - 2005) + 0.5 * other + rng.normal(size=40)[g])))).astype(int)
    rows = [(int(a), int(b), float(c), int(d)) for a, b, c, d in zip(y, year, other, g)]
    df = spark.createDataFrame([*rows, (None, 2000, 0.0, 1), (1, None, 0.0, 1), (1, 2000, 0.0, None)], "y int, year int, other double, g int")
    for names, x in ((["year", "other"], np.column_stack([year, other])), ("year", year[:, None])):
        want, errors = reference_fit(x - x.mean(0), y, g)
        got = logistic_trend(df, "y", names, "g").collect()
        assert np.allclose([r.estimate for r in got[1:]], want[1:], atol=1e-9) and np.allclose([r.error for r in got[1:]], errors[1:], atol=1e-9)
        assert got[0].n == 600 and got[0].clusters == 40 and all(r.low < r.odds_ratio < r.high and 0 <= r.p <= 1 for r in got)


@pytest.mark.parametrize(
    "rows", [[], [(1, 1990, 1), (1, 1991, 2)], [(0, 1990, 1), (1, 1990, 2), (1, 1990, 3)], [(0, 1990 + i, i) for i in range(5)] + [(1, 1996 + i, i) for i in range(5)], [(i % 2, 1990 + i % 3, 1) for i in range(9)]],
    ids=["empty", "one outcome", "constant", "separated", "one cluster"],
)
def test_no_trend(spark, rows):
    got = logistic_trend(spark.createDataFrame(rows, "y int, year int, g int"), "y", "year", "g").collect()
    assert [r.term for r in got] == ["intercept", "year"] and all(r.estimate is None and r.error is None and r.n == len(rows) for r in got)


# Titles


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2])
def test_titles_like_all_pairs(spark, edits):
    rng = random.Random(edits)
    word = lambda: "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 9)))
    works = [(i, rng.choice([word(), word(), "Introduction", "", None]), rng.choice([None, 2000, 2001, 2002, 2003])) for i in range(150)]
    papers = [(i, rng.choice([word(), word(), "introductio n", "Über-Straße"]), rng.choice([None, 1999, 2001, 2003])) for i in range(150)]
    papers += papers[:3]
    works += [(900, "uber   strase!", 2001)]
    p, w = spark.createDataFrame(papers, "id int, title string, year int"), spark.createDataFrame(works, "work int, title string, year int")
    norm = {r.title: r.t for r in p.select("title").union(w.select("title")).distinct().select("title", normal_title("title").alias("t")).collect()}
    want = []
    for i, t, y in papers:
        close = []
        for k, wt, wy in works:
            if y is not None and wy is not None and norm[t] and norm[wt] and abs(y - wy) <= 1 and (e := edit_distance(norm[t], norm[wt])) <= edits:
                close.append((e, abs(y - wy), k))
        best = [c for c in close if c[:2] == min(close)[:2]] if close else []
        status = "none" if not best else "matched" if len(best) == 1 else "ambiguous"
        want.append((i, status, best[0][2] if len(best) == 1 else None, best[0][0] if best else None, len(best)))
    got = [tuple(r) for r in match_titles(p, w, "id", "title", "year", "work", edits).collect()]
    key = lambda r: (r[0], str(r))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {s for _, s, *_ in want} == {"none", "matched", "ambiguous"}
    assert match_titles(p.limit(0), w, "id", "title", "year", "work").count() == 0


def test_frequent_title_is_one_row(spark):
    """20,000 works of one title and 20,000 papers within an edit of it: the index joins single rows, and all are ambiguous."""
    works = spark.range(20_000).selectExpr("id AS work", "'Introduction' AS title", "2000 AS year")
    papers = spark.range(20_000).selectExpr("id", "'Introductions' AS title", "2000 AS year")
    got = match_titles(papers, works, "id", "title", "year", "work").groupBy("status", "candidates").count().collect()
    assert [tuple(r) for r in got] == [("ambiguous", 20_000, 20_000)]


# Rank correlation


def test_spearman(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, 1.0, 2.0, 5.0, float(rng.randrange(40))]), rng.choice([None, rng.randrange(9), 3])) for _ in range(500)]
    full = [r for r in rows if None not in r]

    def ranks(values):
        return [sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2 for v in values]

    want = np.corrcoef(ranks([r[0] for r in full]), ranks([r[1] for r in full]))[0, 1]
    df = spark.createDataFrame(rows, "x double, y int")
    got = spearman(df.repartition(5), "x", "y").first()
    assert got.n == len(full) and abs(got.rho - want) < 1e-12 and got.low < got.rho < got.high and 0 <= got.p <= 1
    assert spearman(df, "x", "x").first().rho == 1.0 and spearman(df.withColumn("z", -F.col("x")), "x", "z").first().rho == -1.0
    none = spearman(df.limit(0), "x", "y").first()
    assert none.n == 0 and none.rho is None and none.p is None
    assert spearman(df.withColumn("x", F.lit(1.0)), "x", "y").first().rho is None
    # a published example: 10 pairs with rho = -29/165
    iq, tv = [106, 100, 86, 101, 99, 103, 97, 113, 112, 110], [7, 27, 2, 50, 28, 29, 20, 12, 6, 17]
    known = spearman(spark.createDataFrame(list(zip(iq, tv)), "x int, y int"), "x", "y").first()
    assert abs(known.rho + 29 / 165) < 1e-12 and abs(known.p - 0.627188) < 1e-5


# Ablation


def test_ablation_like_distinct_counts(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, *range(1, 11)]), rng.choice(["body", "front", None])) for _ in range(300)]
    df = spark.createDataFrame(rows, "patent int, score int, place string")
    settings = {"all": F.lit(True), "body": F.col("place") == "body", "no": F.lit(False)}
    got = {(r.setting, r.threshold): (r.n, r.total, r.share) for r in threshold_ablation(df, "patent", "score", settings, [1, 5, 10, 11, 5]).collect()}
    tests = {"all": lambda p: True, "body": lambda p: p == "body", "no": lambda p: False}
    for (name, t), (n, total, share) in got.items():
        keys = lambda least: len({k for k, s, p in rows if k is not None and s is not None and s >= least and tests[name](p)})  # noqa: B023, E731
        assert (n, total) == (keys(t), keys(0)) and share == (n / total if total else None)
    assert len(got) == 12
    plan = threshold_ablation(df, "patent", "score", settings, range(50))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= 2 or "distinct" not in plan.lower()


# Orders


def test_places_and_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(20)]), i, rng.choice([None, 1, 2, -3])) for i in range(2_000)]
    df = spark.createDataFrame(rows, "a int, b int, v int").repartition(7)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    order = Ordered(df, "a", "b")
    got = plain(order.running(order.running(order.numbered("place"), "v", "upto"), "v", "least", LEAST)).collect()
    total, least = 0, None
    assert order.n == len(rows)
    for i, (r, w) in enumerate(zip(sorted(got, key=lambda r: r.place), want), 1):
        total += w[2] or 0
        least = w[2] if least is None else least if w[2] is None else min(least, w[2])
        assert (r.a, r.b, r.place, r.least) == (w[0], w[1], i, least) and (r.upto or 0) == total
    empty = Ordered(df.limit(0), "a")
    assert empty.n == 0 and plain(empty.running(empty.numbered(), "v", "s")).count() == 0


def test_no_task_holds_all(spark):
    """Places come without a global window, and range partitions share the rows."""
    df = spark.range(50_000).selectExpr("id", "hash(id) AS x")
    order = Ordered(df, "x", "id")
    sizes = order._sizes
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) or len(sizes) > 1 or order.n < 100_000
    text = order.running(order.numbered(), "id", "s")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in text
    for out in (rates.ranked(df, "x", "id"), sampling.sheet(df, "id", 1, "a"), benjamini_hochberg(df.withColumn("p", F.rand(1)), "p", "id")):
        assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()


def test_benjamini_hochberg(spark):
    rng = random.Random(6)
    p = [rng.choice([0.01, 0.02, rng.random(), 1.0]) for _ in range(200)]
    got = {r.k: r.q for r in benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "k int, p double").repartition(6), "p", "k").collect()}
    ranked = sorted(range(200), key=lambda i: (p[i], i))
    low = 1.0
    for rank, i in reversed(list(enumerate(ranked, 1))):
        low = min(low, p[i] * 200 / rank)
        assert abs(got[i] - low) < 1e-12


# The stored cache


def prompts(spark, n, start=0):
    return spark.range(start, start + n).selectExpr("md5(CAST(id AS STRING)) AS key", "concat('prompt ', id) AS prompt")


def answered(text):
    return lambda ps: [f"{text} {p}" for p in ps]


def nobody(ps):
    raise AssertionError("asked again")


def test_second_run_asks_nothing(spark, tmp_path):
    cache = ResponseCache(spark, str(tmp_path / "c"))
    assert cache.read().count() == 0 and cache.find(prompts(spark, 5)).count() == 0
    assert cache.fill(prompts(spark, 60), answered("a"), rows_a_batch=25) == 3
    assert cache.fill(prompts(spark, 60), nobody) == 0
    assert cache.fill(prompts(spark, 80), answered("b"), rows_a_batch=1000) == 1
    raw = {r.key: r.raw[0] for r in cache.read().collect()}
    assert len(raw) == 80 and sorted(raw.values()) == ["a"] * 60 + ["b"] * 20
    assert cache.find(prompts(spark, 3)).count() == 3


def test_failures_are_not_stored(spark, tmp_path):
    cache = ResponseCache(spark, str(tmp_path / "c"), digits=1)
    cache.fill(prompts(spark, 40), lambda ps: [None if p.endswith("7") else p for p in ps], tries=2)
    assert cache.read().count() == 36
    assert cache.fill(prompts(spark, 40), answered("later")) == 1 and cache.read().where("raw LIKE 'later%'").count() == 4


def test_killed_run_loses_its_open_batch(spark, tmp_path):
    cache, batches = ResponseCache(spark, str(tmp_path / "c")), itertools.count()

    def append(rows, plain_append=cache.append):
        if next(batches) == 2:
            raise KeyboardInterrupt
        plain_append(rows)

    cache.append = append
    with pytest.raises(KeyboardInterrupt):
        cache.fill(prompts(spark, 90), answered("a"), rows_a_batch=30)
    del cache.append
    kept = cache.read().count()
    assert 0 < kept < 90 and len(cache.batches()) == 2
    # a batch without the committer's mark does not count, and goes when asked to
    first = next((tmp_path / "c").glob("batch=0000000000-*"))
    (first / "_SUCCESS").unlink()
    less = cache.read().count()
    assert less < kept and cache.fill(prompts(spark, 90), answered("b")) == 1
    assert {r.raw[0]: r["count"] for r in cache.read().groupBy(F.substring("raw", 1, 1).alias("raw")).count().collect()} == {"a": less, "b": 90 - less}
    assert cache.clean() == [first.name]


def test_first_write_wins_and_compaction_keeps_it(spark, tmp_path):
    cache = ResponseCache(spark, str(tmp_path / "c"))
    for text in ("first", "second", "third"):
        cache.append(prompts(spark, 30).selectExpr("key", f"'{text}' AS raw"))
    cache.append(spark.createDataFrame([(None, "x"), ("ab", None)], "key string, raw string"))
    before = sorted(map(tuple, cache.read().collect()))
    assert {r for _, r in before} == {"first"}
    old = cache.batches()
    names = [(tmp_path / "c" / n) for n in old]
    marks = [n.rename(n.parent / f"hidden-{n.name}") for n in names[:1]]
    marks[0].rename(names[0])
    cache._write(cache.read(), 0, 3)  # a compaction that stops before it deletes what it replaces
    assert len(cache.batches()) == 1 and sorted(map(tuple, cache.read().collect())) == before
    assert sorted(cache.clean()) == sorted(old)
    cache.append(prompts(spark, 31).selectExpr("key", "'fourth' AS raw"))
    cache.compact()
    assert len(cache.batches()) == 1 and len(list((tmp_path / "c").glob("batch=*"))) == 1
    assert {r.raw: r["count"] for r in cache.read().groupBy("raw").count().collect()} == {"first": 30, "fourth": 1}


# Published claims


def test_claims(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 4.0), (None, 9.0)], "g string, v double")
    metrics = claims.measured(rows, {"mean": F.avg("v"), "none": F.avg(F.when(F.lit(False), F.col("v")))}).unionByName(claims.measured_by(rows, "g", {"sum": F.sum("v")}))
    metrics = metrics.unionByName(spark.createDataFrame([("twice", 1.0), ("twice", 2.0), ("half", 0.125)], metrics.schema))
    published = [
        ("right", "mean", 4.0, 2), ("wrong", "mean", 4.1, 1), ("coarse", "sum[b]", 3.0, -1), ("group", "sum[a]", 3.0, 0), ("no value", "none", 1.0, 0), ("no metric", "sum[c]", 1.0, 0), ("no number", "mean", None, 0),
        ("two values", "twice", 1.0, 0), ("half up", "half", 0.13, 2), ("again", "mean", 4.0, 2),
    ]
    got = {r.claim: (r.verdict, r.value) for r in claims.verdicts(spark.createDataFrame(published, "claim string, metric string, claimed double, decimals int"), metrics).collect()}
    assert {k: v[0] for k, v in got.items()} == {"right": "ok", "wrong": "failed", "coarse": "ok", "group": "ok", "no value": "missing", "no metric": "missing", "no number": "failed", "two values": "ambiguous", "half up": "ok", "again": "ok"}
    assert got["group"][1] == 3.0 and got["two values"][1] is None
