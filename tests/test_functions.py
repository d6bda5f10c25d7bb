import pytest
from pyspark.sql import functions as F

from tracelink.functions import dates, ids, rules, text
from tracelink.labelling import labeller
from tracelink.operators import compare, links, sampling


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema or "x string").select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "pid, era",
    [
        ("us-3930270-a", "pre-1976"), ("us-3930271-a", "1976-2014"), ("us-8924999-b2", "1976-2014"), ("us-8925000-b2", "2015-May2021"), ("us-10999999-b2", "2015-May2021"),
        ("us-11000000-b2", "May2021+"), ("us-20150012345-a1", "application"), ("us-d0123456-s1", "design/other"), ("garbage", "design/other"), (None, "design/other"),
    ],
)
def test_grant_era(spark, pid, era):
    assert one(spark, ids.grant_era("p"), p=pid) == era


@pytest.mark.parametrize(
    "raw, want", [(" HTTPS://doi.org/10.1/X ", "10.1/x"), ("https://doi.org/doi:10.2", "10.2"), ("doi:", None), ("  ", None), (None, None), ("http://doi.org/https://doi.org/1", "https://doi.org/1")]
)
def test_doi(spark, raw, want):
    assert one(spark, ids.doi("d"), d=raw) == want


def test_ids(spark):
    assert one(spark, ids.work_id("w"), w="https://openalex.org/W12") == "12"
    assert one(spark, ids.venue_key("f"), f="2024.acl.xml") == "acl"
    assert one(spark, ids.venue_key("f"), f="P19.xml") == "P19"
    assert one(spark, ids.patent_id("p"), p="\u00a0us-123-b2 ") == "US123B2"
    assert one(spark, ids.patent_number("p"), p="US10494607B2") == 10494607


def test_text(spark):
    assert one(spark, text.squash("s"), s="\u2003a \n b\u00a0") == "a b"
    assert one(spark, text.squash("s"), s=None) == ""
    assert one(spark, text.clean_html("s"), s="<b>Caf&eacute;</b> &amp;lt; <i></i>") == "Café &lt;"
    assert one(spark, text.clean_markup("s"), s="<b>a &amp;lt; b</b>") == "a &lt; b"
    assert one(spark, text.clean_html("s"), s="<b> </b>") is None
    assert one(spark, text.labelled_field("s", "Assignee"), s="<div>ASSIGNEE:</div> <div class='x'>\nAcme</div>") == "\nAcme"
    assert one(spark, text.page_title("s"), s="<title>a - b - US1</title>") == "a - b"
    assert one(spark, text.or_none("s"), s=" ") == "(none)"
    assert one(spark, text.title_abstract("a", "b"), a=None, b="x") == " x"


@pytest.mark.parametrize("raw, want", [("2020-05-01", 2020), ("May 1, 2019", 2019), ("1 Feb 2001", 2001), ("soon", None), (None, None)])
def test_mixed_year(spark, raw, want):
    assert one(spark, dates.mixed_year("d"), d=raw) == want


def test_rules_file():
    got = rules.load_rules("# note\na_b:\n  - 'x (y|z)'  # why\n  - \"\\bq\"\n\nempty:\nc:\n  - plain # note\n")
    assert got == {"a_b": ["x (y|z)", "\\bq"], "c": ["plain"]}


def test_tagging_is_multi_label(spark):
    rows = spark.createDataFrame([(1, "Écoute VOICE print"), (2, "none"), (3, None)], "id int, t string")
    got = rules.tag(rows, {"a": ["écoute"], "b": ["voice[- ]print"]}, F.col("t")).select("id", "tag").collect()
    assert sorted(map(tuple, got)) == [(1, "a"), (1, "b")]


def test_arms_and_homonyms(spark):
    assert one(spark, rules.agency_arm("a"), a="Department of War") == "defence"
    assert one(spark, rules.agency_arm("a"), a="NASA") == "civilian"
    assert one(spark, rules.agency_arm("a"), a=None) is None
    assert one(spark, rules.is_homonym("m", "t"), m="transformer", t="winding") is True
    assert one(spark, rules.is_homonym("m", "t"), m="transformer", t="winding of a neural net") is False
    assert one(spark, rules.snippet("t", "b+"), t="a  bb c") == "a bb c"


@pytest.mark.parametrize(
    "raw, label", [('ok {"label": "neither", "confidence": 2} done', "neither"), ('{"label": "a"} {"label": "b"}', None), ("", None), (None, None), ("[1]", None), ('{"label": 3}', None)]
)
def test_strict_json(spark, raw, label):
    assert one(spark, labeller.parse_response("r").getField("label"), r=raw) == label


def test_flips_with_nulls(spark):
    rows = spark.createDataFrame([("a", "a", "a"), ("a", None, None), ("a", "b", "a"), (None, None, "a")], "o string, s string, h string")
    got = compare.flips(rows, "o", "s", "h").select("consistent", "flipped").collect()
    assert list(map(tuple, got)) == [(True, False), (False, True), (False, True), (False, True)]


def test_null_keys_do_not_match_and_first_wins(spark):
    p = spark.createDataFrame([(1, None), (2, "d")], "id int, k string")
    w = spark.createDataFrame([(None, 1), ("d", 3), ("d", 2)], "k string, w int")
    got = {r.id: r.w for r in links.resolve(p, w, "k", "w").collect()}
    assert got == {1: None, 2: 2}


def test_sample_does_not_depend_on_partitions(spark):
    rows = spark.range(500).selectExpr("cast(id as string) AS k")
    a = sampling.sample_keys(rows.repartition(7), "k", 20, 1).collect()
    b = sampling.sample_keys(rows.coalesce(1), "k", 20, 1).collect()
    assert a == b and len(set(a)) == 20
    assert a != sampling.sample_keys(rows, "k", 20, 2).collect()


def test_label_loop(spark):
    records = spark.createDataFrame([("p1", "t", "Navy", "2020", "voice print"), ("p2", None, "x", "2020", " "), ("p3", "u", "x", "2020", None)], "patent_id string, title string, assignee string, grant_date string, abstract string")
    cache = spark.createDataFrame([], "key string, raw string")
    todo = labeller.misses(records, cache, "m")
    assert {r.patent_id for r in todo.collect()} == {"p1", "p3"}
    answers = labeller.respond(todo, labeller.rule_labeller({"surveillance": "voice"}))
    got = {r.patent_id: (r.label, r.assignee) for r in labeller.labels(records, answers, "m").collect()}
    assert got == {"p1": ("surveillance", "Navy"), "p3": ("neither", "x")}
    assert labeller.misses(records, answers, "m").count() == 0
