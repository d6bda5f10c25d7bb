"""The pipeline's stages on planted documents, each against what it must do with its own input."""

from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Tables with clean documents and planted toxic ones, near copies, shared passages and leaks."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 8)))
    vocabulary = [word() for _ in range(4000)]
    prose = lambda n: list(rng.choice(vocabulary, n))
    docs, kind, labels = [], [], []
    put = lambda words, k: (docs.append(" ".join(words)), kind.append(k))
    for _ in range(300):
        put(prose(120), "clean")
    insults = ["numpty", "wazzock", "plonker", "pillock"]
    for _ in range(120):
        w = prose(120)
        for at in rng.integers(0, 120, 6):
            w[at] = insults[rng.integers(4)]
        put(w, "toxic")
    for i in range(40):
        w = docs[i].split()
        w[60] = "edited"
        put(w if i % 2 else docs[i].split(), "copy")
    passage = prose(70)
    for _ in range(30):
        put(prose(60) + passage + prose(60), "passage")
    items = [" ".join(prose(35)) for _ in range(20)]
    for i in range(20):
        w = items[i].split()
        w[10] = "changed"
        put(prose(60) + w + prose(60), "leak")
    for i, k in enumerate(kind):
        if k in ("clean", "toxic") and i % 3:
            labels.append((i, 1, int(k == "toxic")))
    folder = tmp_path_factory.mktemp("planted")
    n = len(docs)
    pd.DataFrame({"doc_id": range(n), "text": docs, "lang": "en", "source": "s", "n_chars": [len(d) for d in docs]}).to_parquet(folder / "documents.parquet")
    pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).to_parquet(folder / "labels.parquet")
    pd.DataFrame({"item_id": range(20), "text": items}).to_parquet(folder / "benchmark.parquet")
    return str(folder), dict(enumerate(kind)), passage


def test_stages(spark, planted):
    folder, kind, passage = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        rows = {r.doc_id: r for r in docs.collect()}
        docs = spark.createDataFrame(list(rows.values()), docs.schema)
        gone = defaultdict(int)
        for d in before - set(rows):
            gone[kind[d]] += 1
        if name == "toxicity":
            assert gone["toxic"] >= 114 and sum(gone.values()) - gone["toxic"] <= 3
        elif name == "near_duplicates":
            assert dict(gone) == {"copy": 40}
        elif name == "repeated_passages":
            assert not gone
            held = [r for r in rows.values() if kind[r.doc_id] == "passage"]
            assert not any(" ".join(passage[10:60]) in r.text for r in held) and all(len(r.text.split()) >= 118 for r in held)
            assert all(r.n_chars == len(r.text) for r in rows.values())
        elif name == "decontamination":
            assert dict(gone) == {"leak": 20}


def test_run_packs_what_is_left(spark, planted):
    folder, kind, _ = planted
    got = corpus_pipeline.run(spark, folder).toPandas()
    left = set(got["doc_id"])
    assert sum(kind[d] == "clean" for d in left) >= 297 and not any(kind[d] in ("leak", "copy") for d in left)
    assert (got.groupby("sequence_id")["length"].sum() <= 1024).all()
    assert all(g["length"].sum() == g["doc_tokens"].iloc[0] for _, g in got.groupby("doc_id"))


@pytest.fixture(scope="module")
def messy(spark, tmp_path_factory):
    """Nulls, empty, very long and repeated texts, repeated and absent ids, and extra columns with names used inside."""
    rng = np.random.default_rng(3)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n))
    same = prose(90)
    texts = [None, "", " \n", "one", same, same, same + " more", prose(60_000), prose(30)]
    rows = [(i, t, "en", None, 1) for i, t in enumerate(texts)] + [(4, same, "en", None, 1), (4, prose(20), None, "s", 2), (None, same, None, None, None), (None, prose(25), None, None, None), (None, None, None, None, None)]
    names = ["left", "kept", "row", "doc", "u", "v", "sid", "key", "core", "score", "component_id", "nameless", "spans", "a.b"]
    folder = str(tmp_path_factory.mktemp("messy"))
    spark.createDataFrame([(8, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, same[:200]), (None, "x"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return out.selectExpr("*", *[f"'x' AS `{n}`" for n in names]), folder


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_on_messy_rows(spark, messy, name, stage):
    docs, folder = messy
    got = stage(spark, docs, folder)
    assert got.columns == docs.columns and stage(spark, docs.limit(0), folder).count() == 0
    rows = got.select("doc_id", "text", "left").collect()
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in rows)
    every = sorted((r.doc_id is None, r.doc_id or 0) for r in docs.select("doc_id").collect())
    assert all(r.left == "x" for r in rows)
    if name == "toxicity":
        assert ids == every
    elif name == "near_duplicates":  # the copies of one text, with ids and without, stay once; so do equal rows
        assert sum(r.text is not None and r.text.startswith(docs.where("doc_id = 5").first().text[:300]) for r in rows) == 1
        assert [x for x in ids if x == (False, 4)] == [(False, 4)] * 2 and (True, 0) in ids and len(ids) == len(every) - 4
    elif name == "repeated_passages":  # of the copies nothing is left
        assert len(ids) == len(every) - 4 and {3, 7, 8} <= {r.doc_id for r in rows}
    elif name == "decontamination":
        assert len(ids) == len(every) - 5 and {0, 1, 2, 3, 7, 8} <= {r.doc_id for r in rows}


def test_packing_of_messy_rows(spark, messy):
    docs, folder = messy
    got = corpus_pipeline.packing_stage(spark, docs, folder)
    assert got.where("start = 0").count() == docs.count() and corpus_pipeline.packing_stage(spark, docs.limit(0), folder).count() == 0
