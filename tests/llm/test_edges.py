"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from tracelink.llm import decontamination, dedup, html, jaccard, language, packing, quality, queries, scoring, sharding, toxicity

LONG = " ".join(f"w{i % 977}" for i in range(200_000))  # over a megabyte
TEXTS = [None, "", " \n\t ", "one", "a b c d e f g h", "a b c d e f g h", "A b c D e f g h i", "ÉCOLE straße \U0001f600 … “x”", LONG, "!!! ### 123", "same same same same " * 60, "same same same same " * 60, "x" * 3000, "\x00\x0b\x0c tab"]
#: Names that operators use inside.
CLASHING = ["sid", "key", "core", "size", "n", "words", "hash", "shard", "slot", "salt", "block", "unit", "kind", "root", "h", "rows", "spans", "score", "toxic_", "component_id", "left", "kept", "row", "doc", "u", "v", "nameless", "id", "group", "item_id", "toxic", "_k"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "src", None) for i, t in enumerate(TEXTS)]
    out = spark.createDataFrame([*rows, rows[4], rows[0]], "doc_id long, text string, lang string, source string, n_chars long")
    nameless = spark.createDataFrame([(None, "a b c d e f g h", "en", None, 3)], out.schema)
    return out.unionByName(nameless).withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 1), (6, None, 0), (9, 1, None), (7, 0, 0), (None, 1, 1), (10, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "a b c d e f g h"), (2, None), (3, ""), (4, "one"), (5, "a b c d e f g h")], "item_id long, text string").withColumn("doc_id", F.lit("clash"))


def operators(labels, items):
    files = queries.byte_bpe()
    return {
        "packing": lambda d: packing.pack(d, files),
        "dedup": lambda d: dedup.remove_repeats(d),
        "quality": lambda d: quality.quality(d),
        "toxicity": lambda d: toxicity.toxicity(d, labels),
        "language": lambda d: language.language(d),
        "sharding": lambda d: sharding.assign_shards(d, 7),
        "scoring": lambda d: scoring.pseudo_likelihood(d),
        "jaccard": lambda d: jaccard.link_documents(d),
        "decontamination": lambda d: decontamination.find_leaks(d, items),
    }


NAMES = list(operators(None, None))


@pytest.mark.parametrize("name", NAMES)
def test_messy_rows(docs, labels, items, name):
    """Every row is a document of its own, those of a repeated id and the one without an id too."""
    ids = [r.doc_id for r in operators(labels, items)[name](docs).collect()]
    want = [*range(len(TEXTS)), 4, 0, None]
    order = lambda x: (x is None, x or 0)
    if name in ("packing", "decontamination"):
        assert set(ids) <= set(want) and None in ids and (name == "decontamination" or set(ids) == set(want))
    else:
        assert sorted(ids, key=order) == sorted(want, key=order)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(docs, labels, items, name):
    assert operators(labels, items)[name](docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_empty_others(spark, docs, labels, items, name):
    """No labels and no benchmark: defined results as well."""
    got = operators(labels.limit(0), items.limit(0))[name](docs)
    assert name == "decontamination" or got.count() > 0


def test_defined_results(docs, labels, items):
    ops = operators(labels, items)
    packed = {(r.doc_id, r.start): r.length for r in ops["packing"](docs).collect()}
    assert packed[0, 0] == packed[1, 0] == 1
    lang = {r.doc_id: (r.lang_pred, r.score) for r in ops["language"](docs).collect()}
    assert lang[0] == lang[1] == lang[2] == lang[9] == ("und", 0.0)
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in ops["jaccard"](docs).collect()}
    assert near[0] == (0, 0) and near[2] == (0, 2) and near[3] == (1, 3)
    assert near[5] == (4, 4) and near[6] == (5, 4) and near[11][1] == 10 and near[None] == (4, 4)
    cut = {r.doc_id: r for r in ops["dedup"](docs).collect()}
    assert (cut[0].n_bytes, cut[0].n_removed) == (0, 0)
    assert cut[12].n_removed == 3000 and cut[12].n_spans == 1 and cut[12].kept == ""
    leaks = {(r.doc_id, r.item_id) for r in ops["decontamination"](docs).collect()}
    assert {(4, 1), (4, 5), (5, 1), (6, 1), (None, 1)} <= leaks and not any(i in (2, 3) for _, i in leaks)
    assert {d for d, i in leaks if i == 4} == {3}  # an item of one word, whole
    scored = {r.doc_id: r for r in ops["scoring"](docs).collect()}
    assert scored[0].n_tokens == 0 and scored[0].per_token is None and scored[3].log_likelihood < 0
    q = {r.doc_id: r for r in ops["quality"](docs).collect()}
    assert q[0].base_failed and not q[0].kept and q[10].n_repeat_words == 240


def test_pages(spark):
    rows = [(1, None, None), (2, "no url", "<p>a&amp;b <b>c</b>\n d</p><p>e"), (3, "http://h/", ""), (3, "http://h/", ""), (None, "http://k/z", "<p>x"), (5, "http://l/x", "<p>" + "long " * 300_000), (6, "http://l/x", "<p>tie"), (4, "http://h/x", "<script>x</script><nav>menu</nav><article><h1>T</h1><p>body<aside>no</aside></article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "salt": F.lit(2), "slots": F.lit(3)})
    got = html.extract_text(pages).collect()
    long = ("long " * 300_000).strip()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "x", 1), (1, "", 0), (2, "a&b c d e", 9), (3, "", 0), (3, "", 0), (4, "T body", 6), (5, long, len(long)), (6, "tie", 3)]
    assert html.extract_text(pages.limit(0)).count() == 0
