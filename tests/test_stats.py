"""Published figures that follow from published counts."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelink.stats import contingency, intervals, special


@pytest.mark.parametrize(
    "k, n, low, high",
    [(11, 2374, 0.0024642029, 0.0080048804), (6, 2241, 0.0011183, 0.0055104), (0, 15, 0.0, 0.1518166211)],
)
def test_jeffreys(k, n, low, high):
    got = special.jeffreys(k, n)
    assert got == pytest.approx((low, high), rel=1e-4, abs=1e-12)


def test_jeffreys_edges():
    assert special.jeffreys(7, 7)[1] == 1.0
    assert all(math.isnan(x) for x in special.jeffreys(0, 0))


@given(st.integers(0, 30), st.integers(1, 30))
@settings(max_examples=60, deadline=None)
def test_jeffreys_mirrors(k, n):
    k = min(k, n)
    low, high = special.jeffreys(k, n)
    other = special.jeffreys(n - k, n)
    assert (low, high) == pytest.approx((1 - other[1], 1 - other[0]), abs=1e-9)


def test_fisher():
    assert special.fisher_two_sided(11, 2362, 6, 2106) == pytest.approx(0.4664404282, rel=1e-9)
    assert special.fisher_two_sided(3, 0, 0, 3) == pytest.approx(0.1)


def test_mantel_haenszel(spark):
    rows = spark.createDataFrame([(0, 417, 2, 1110), (3, 634, 2, 616), (8, 1322, 2, 386), (1, 5, 0, 0)], "k1 long, n1 long, k0 long, n0 long")
    got = contingency.mantel_haenszel(rows).first()
    assert (got.odds_ratio, got.low, got.high, got.p) == pytest.approx((1.0326483, 0.3834625, 2.7808780, 0.9497102), rel=1e-6)
    assert got.strata == 3


def test_standardised(spark):
    from tracelink.operators import compare

    table = spark.createDataFrame([(0, 417, 2, 1110), (3, 634, 2, 616), (8, 1322, 2, 386), (0, 1, 0, 129), (0, 9, 0, 0)], "k1 long, n1 long, k0 long, n0 long")
    table = table.selectExpr("*", "k1 / n1 AS rate1", "k0 / n0 AS rate0")
    assert compare.standardised(table).first().standardised == pytest.approx(0.00406889, rel=1e-5)


def test_benjamini_hochberg(spark):
    rows = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.03), ("d", 0.5)], "k string, p double")
    got = {r.k: r.q for r in contingency.benjamini_hochberg(rows, "p", "k").collect()}
    assert got == pytest.approx({"a": 0.04, "b": 0.04, "c": 0.04, "d": 0.5})


def test_kappa_of_one_class_is_one(spark):
    rows = spark.createDataFrame([("x", "x")] * 5, "a string, b string")
    got = contingency.agreement(rows, "a", "b", ["x", "y"]).first()
    assert (got.raw, got.kappa, got.ac1) == (1.0, 1.0, 1.0)


def test_f1_guards(spark):
    rows = spark.createDataFrame([("y", "y")], "r string, h string")
    got = {r["class"]: r.f1 for r in contingency.per_class(rows, "r", "h", ["x", "y"]).collect()}
    assert got == {"x": 0.0, "y": 1.0}


def test_bootstrap_covers_the_rate(spark):
    rows = spark.createDataFrame([(30, 100), (0, 10)], "k long, n long")
    got = rows.select("k", intervals.bootstrap_mean(2000)("k", "n").alias("i")).orderBy("k").collect()
    assert got[0].i.low == got[0].i.high == 0.0
    assert 0.19 < got[1].i.low < 0.25 < 0.35 < got[1].i.high < 0.41
