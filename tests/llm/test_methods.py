"""Each method against brute force, an exact round trip or held-out accuracy."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelink.llm import decontamination, dedup, grouping, jaccard, language, packing, quality, queries, scoring, sharding, shared, toxicity


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def texts(data):
    return pd.read_parquet(f"{data}/documents.parquet").set_index("doc_id")["text"].to_dict()


# Packing


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 3), max_size=6), st.integers(1, 60))
@settings(max_examples=150, deadline=None)
def test_best_multiset(counts, capacity):
    taken = packing.best_multiset(counts, capacity)
    assert all(0 < k <= counts[x] for x, k in taken.items())
    sums = {0}
    for x, k in counts.items():
        sums |= {s + x * j for s in sums for j in range(k + 1)}
    assert sum(x * k for x, k in taken.items()) == max(s for s in sums if s <= capacity)


def test_packing_round_trip(spark, docs, texts):
    from tokenizers import Tokenizer

    files = queries.byte_bpe()
    tokenizer = Tokenizer.from_file(files[0])
    got = packing.pack(docs.repartition(3), files).toPandas()
    back = {d: np.full(int(n), -1) for d, n in got.groupby("doc_id")["doc_tokens"].first().items()}
    for r in got.itertuples():
        assert zlib.crc32(np.asarray(r.token_ids, "<u4").tobytes()) == r.ids_crc32 and len(r.token_ids) == r.length
        assert (back[r.doc_id][r.start : r.start + r.length] == -1).all()
        back[r.doc_id][r.start : r.start + r.length] = r.token_ids
    for d, text in texts.items():
        assert back[d].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
    sizes = got.groupby("sequence_id")["length"].sum()
    assert all(n == 1024 or n & (n - 1) == 0 for n in sizes) and (sizes <= 1024).all()
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id")["length"].cumsum() - got["length"] == got["offset"]).all()


def test_encoder_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    files = queries.byte_bpe()
    tokenizer, encode = Tokenizer.from_file(files[0]), packing.encoder(*files)
    rng = np.random.default_rng(0)
    alphabet = list("aZ09 .,'\n\t  éß中😀�-_|#") + ["'s", "  ", "\r\n", "<|endoftext|>", "don't", "ĠĠ"]
    for _ in range(400):
        text = "".join(rng.choice(alphabet, rng.integers(0, 30)))
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


# Suffix arrays


@given(st.lists(st.integers(0, 3), max_size=40))
@settings(max_examples=300, deadline=None)
def test_suffix_array(x):
    assert grouping.suffix_array(np.array(x, np.int64)).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


def brute_removed(raw: dict, length: int) -> dict:
    seen = collections.Counter(b[i : i + length] for b in raw.values() for i in range(len(b) - length + 1))
    out = {}
    for d, b in raw.items():
        cover = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                cover[i : i + length] = True
        out[d] = cover
    return out


def check_removal(spark, raw: dict, shape_length: int):
    frame = spark.createDataFrame([(d, b.decode()) for d, b in raw.items()], "doc_id long, text string")
    want = brute_removed(raw, shape_length)
    for r in dedup.remove_repeats(frame, shape_length).collect():
        b, cover = raw[r.doc_id], want[r.doc_id]
        kept = bytes(np.frombuffer(b, np.uint8)[~cover])
        runs = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), int(cover.sum()), runs, hashlib.sha256(kept).hexdigest())


def test_removal_on_tables(spark, texts):
    check_removal(spark, {d: t.encode() for d, t in list(texts.items())[:120]}, 400)


@pytest.mark.parametrize("seed", [0, 1])
def test_removal_of_edited_passages(spark, seed, monkeypatch):
    """Passages with random neighbours and edits, periodic texts, and overlaps of all sizes around the length."""
    rng = np.random.default_rng(seed)
    word = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8))
    passages = [word(int(rng.integers(230, 500))) for _ in range(5)]
    raw = {}
    for d in range(60):
        parts = []
        for _ in range(int(rng.integers(1, 4))):
            p = bytearray(passages[rng.integers(len(passages))])
            lo, hi = sorted(rng.integers(0, len(p), 2))
            p = p[lo:] if rng.random() < 0.3 else p[:hi] if rng.random() < 0.3 else p
            for _ in range(int(rng.integers(0, 2))):
                if p:
                    p[rng.integers(len(p))] = 65
            parts += [word(int(rng.integers(0, 30))), bytes(p)]
        raw[d] = b"".join(parts)
    for d in range(70, 90):  # one core with many contexts
        raw[d] = word(int(rng.integers(0, 200))) + passages[0][: int(rng.integers(200, 240))] + word(150)
    raw[100], raw[101], raw[102] = b"ab" * 400, b"x" * 450, b"abc" * 90 + word(50) + b"abc" * 90
    check_removal(spark, raw, 240)
    monkeypatch.setattr(dedup, "HOT", 2)
    check_removal(spark, raw, 240)


# Quality


def test_quality_order_and_short_circuit(spark, docs):
    rules = quality.default_rules()
    ordered = quality.order_rules(docs, rules)
    assert sorted(r.name for r, _, _ in ordered) == sorted(r.name for r in rules)
    gain = [share / cost for _, share, cost in ordered]
    assert gain == sorted(gain, reverse=True)
    verdict = lambda rs: {r.doc_id: r.kept for r in quality.quality(docs, rs).collect()}
    assert verdict(rules) == verdict(rules[::-1])
    plan = quality.quality(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_quality_against_sql(spark, data, docs):
    import duckdb

    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = duckdb.sql(quality.QUALITY_SQL).df().set_index("doc_id").sort_index()
    got = quality.quality(docs).drop("rejected_by").toPandas().set_index("doc_id").sort_index()
    pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False)


def test_quality_follows_labels(data, docs):
    labels = pd.read_parquet(f"{data}/labels.parquet").set_index("doc_id")["quality"]
    got = quality.quality(docs).toPandas().set_index("doc_id").join(labels, how="inner")
    assert got[(got["quality"] == 0)]["kept"].mean() == 0
    assert got[(got["quality"] == 1) & (got["n_words"] >= 50)]["kept"].mean() > 0.95


# Toxicity


def test_block_max_search_is_exact():
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(500):
        terms = np.unique(rng.integers(0, 40, rng.integers(1, 6)))
        w = rng.random(len(terms)) + 0.1
        rows.append((terms, w / np.sqrt((w * w).sum())))
    rows.sort(key=lambda r: r[0][0])
    index = toxicity.BlockMaxIndex(rows, 40)
    dense = np.zeros((500, 40))
    for i, (t, w) in enumerate(rows):
        dense[i, t] = w
    for q in range(60):
        t, w = rows[q * 7]
        cos = dense[:, t] @ w
        order = np.lexsort((np.arange(500), -np.round(cos, 12)))
        want = [i for i in order[:15] if cos[i] > 0]
        got, scores = index.search(t, w, 15)
        assert got.tolist() == want and np.allclose(scores, cos[want])
        assert q * 7 not in index.search(t, w, 15, without=q * 7)[0]


def test_toxicity_on_held_out_rows(spark):
    data = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{data}/{n}.parquet") for n in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert got["score"].between(0, 1).all()
    assert ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()
    toxic, clean = got[got["toxic"] == 1], got[got["toxic"] == 0]
    assert toxic["predicted"].mean() > 0.5 and clean["predicted"].mean() < 0.03
    assert (got[got["predicted"] == 1]["evidence"].map(len) > 0).all()


def test_scores_against_brute_force_neighbours(spark, data, docs, texts):
    """Every text's neighbours and score from plain cosines over all words of the examples; most texts have neighbours."""
    labels = spark.read.parquet(f"{data}/labels.parquet")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).toPandas().set_index("doc_id")
    assert (got["neighbours"].map(len) > 0).mean() > 0.95
    words = {d: collections.Counter(toxicity.letter_words([t.lower()])[0].tolist()) for d, t in texts.items()}
    place = {int(h): i for i, h in enumerate(model.terms)}

    def vector(d):
        v = np.zeros(len(model.terms))
        for h, n in words[d].items():
            if h in place:
                v[place[h]] = (1 + np.log(n)) * model.gain[place[h]]
        return v / max(np.sqrt((v * v).sum()), 1e-300)

    examples = np.stack([vector(d) for d in model.ids])
    for d in list(texts)[::3]:
        cos = examples @ vector(d)
        top = np.lexsort((np.arange(len(cos)), -np.round(cos, 12)))[:15]
        top = top[cos[top] > 0]
        assert np.allclose(got.loc[d, "similarities"], cos[top], atol=1e-9)
        w = cos[top] ** 2 * model.prior[top]
        rest = toxicity.FAR**2 * model.prior.mean()
        p = np.interp(((w * model.toxic[top]).sum() + rest * model.base) / (w.sum() + rest), *model.knots) if len(top) else model.base
        assert got.loc[d, "score"] == pytest.approx(p, abs=1e-6)


def test_words_that_mark_the_class_weigh_more():
    a, b = np.array([0, 5, 40, 40, 3]), np.array([0, 50, 0, 400, 0])
    f = toxicity.class_factor(a, b, 100, 1000)
    assert (f >= toxicity.FLOOR).all() and (f <= 1).all() and f[2] > 0.9 and f[[0, 1, 3]].max() < 0.03 and f[2] > f[4] > f[0]


# Language


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(1)
    emit, trans, start = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    bounds = np.array([0, 4, 4, 5, 9])
    gamma, pair, logz = language.forward_backward(emit, bounds, trans, start)
    want, want_pair, want_z = np.zeros((9, 3)), np.zeros((3, 3)), 0.0
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        if hi == lo:
            continue
        paths = list(itertools.product(range(3), repeat=hi - lo))
        p = np.array([np.exp(start[y[0]] + sum(emit[lo + t, y[t]] for t in range(hi - lo)) + sum(trans[a, b] for a, b in zip(y, y[1:]))) for y in paths])
        want_z += np.log(p.sum())
        for y, w in zip(paths, p / p.sum()):
            for t, s in enumerate(y):
                want[lo + t, s] += w
            for a, b in zip(y, y[1:]):
                want_pair[a, b] += w
    assert np.allclose(gamma, want) and np.allclose(pair, want_pair) and np.isclose(logz, want_z)


def test_language_on_held_out_rows(spark, docs):
    got = language.language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97


def test_predictions_against_plain_chains(spark, docs, texts):
    """The query's predictions from sums over neighbouring labels, in logs, one word after another."""
    model = language.fit(docs)
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    k = len(model.labels)
    log_sum = lambda v: max(v) + np.log(sum(np.exp(x - max(v)) for x in v))
    for d in sorted(texts, key=lambda d: len(texts[d]))[20:40]:
        words = language.Words([texts[d]])
        emit = words.emissions(model.weights).astype(float)[words.word]
        ahead, back = [list(model.start + emit[0])], [[0.0] * k]
        for e in emit[1:]:
            ahead.append([e[y] + log_sum([ahead[-1][x] + model.transitions[x, y] for x in range(k)]) for y in range(k)])
        for e in emit[:0:-1]:
            back.append([log_sum([model.transitions[y, z] + e[z] + back[-1][z] for z in range(k)]) for y in range(k)])
        whole = log_sum(ahead[-1])
        share = sum(n * np.exp(np.add(a, b) - whole) for n, a, b in zip(words.lengths, ahead, back[::-1])) / words.lengths.sum()
        assert got[d].lang_pred == model.labels[int(share.argmax())] and got[d].score == pytest.approx(float(share.max()), abs=1e-6)


def test_words_of_mixed_text_switch(docs):
    rows = docs.select("text", "lang").toPandas()
    names = sorted(rows["lang"].unique())
    model = language.train(list(rows["text"]), rows["lang"].map({n: i for i, n in enumerate(names)}).to_numpy(), names)
    text = "the and of that with this for " * 3 + "der die und nicht mit den von " * 3
    words = language.Words([text])
    gamma, _, _ = language.forward_backward(words.emissions(model.weights).astype(float)[words.word], words.bounds, model.transitions, model.start)
    best = [names[i] for i in gamma.argmax(axis=1)]
    assert best[2:19] == ["en"] * 17 and best[23:40] == ["de"] * 17
    assert np.diag(model.transitions).min() > model.transitions[~np.eye(len(names), dtype=bool)].max()


# Sharding


@given(st.lists(st.integers(1, 50), min_size=1, max_size=60))
@settings(max_examples=60, deadline=None)
def test_differencing(sizes):
    vectors = np.zeros((len(sizes), 4), np.int64)
    vectors[:, 2] = sizes
    labels = sharding.difference(vectors)
    assert all(sorted(r) == [0, 1, 2, 3] for r in labels.tolist())
    sums = np.bincount(labels[:, 2], sizes, 4)
    assert sums.sum() == sum(sizes) and sums.max() - sums.min() <= max(sizes)


def test_shards_are_even_and_groups_whole(spark, texts, docs):
    got = sharding.assign_shards(docs, 8, block=16).toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 8 and sums.max() < 1.03 * sums.mean()
    got["text"] = got["doc_id"].map(texts)
    assert (got.groupby("text")["shard"].nunique() == 1).all()
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
    assert all(r.size == len(r.text.encode()) + 16 and r.text_crc32 == zlib.crc32(r.text.encode()) for r in got.itertuples())


def test_a_group_beyond_a_shard_is_cut(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"text {i}") for i in range(900)], "doc_id long, text string")
    sums = sharding.assign_shards(rows, 10).groupBy("shard").sum("size").toPandas()["sum(size)"]
    assert len(sums) == 10 and sums.max() < 1.1 * sums.mean()


# Scoring


def test_gradient_lowers_the_loss():
    rng = np.random.default_rng(0)
    target = rng.integers(0, 5, 4000)
    context = np.stack([target, (target + 1) % 5, rng.integers(0, 5, 4000), target], axis=1)
    net = scoring.Network.fresh(np.bincount(target, minlength=scoring.CLASSES))
    before = net.log_probabilities(context, target).mean()
    for _ in range(5):
        net.train(context, target)
    assert net.log_probabilities(context, target).mean() > before + 0.5


def test_context_never_holds_the_token_itself():
    tokens, bounds = np.arange(7), np.array([0, 3, 7])
    got = scoring.contexts(tokens, bounds, np.arange(7)).tolist()
    pad = scoring.PAD
    assert got[0] == [pad, pad, 1, 2] and got[2] == [0, 1, pad, pad] and got[3] == [pad, pad, 4, 5] and got[5] == [3, 4, 6, pad]


def test_every_text_gives_positions():
    bounds = np.array([0, 3, 3, 4, 60, 61])
    for turn in range(3):
        where = scoring.sampled_positions(bounds, 24, turn)
        text = np.searchsorted(bounds, where, side="right") - 1
        assert set(text) == {0, 2, 3, 4} and len(where) == len(set(where)) and (np.diff(where[text == 3]) == 24).all()


def test_scores_beat_word_order_and_unigrams(spark, docs, texts):
    rng = np.random.default_rng(0)
    net, lexicon, counts = scoring.fit(docs)
    shuffled = spark.createDataFrame([(d, " ".join(rng.permutation(t.split()))) for d, t in texts.items()], "doc_id long, text string")
    mean = lambda df: df.selectExpr("sum(log_likelihood) / sum(n_tokens)").first()[0]
    scored = mean(scoring.score(docs, net, lexicon, counts))
    assert scored > mean(scoring.score(shuffled, net, lexicon, counts))
    n = collections.Counter(w.lower() for t in texts.values() for w in re.findall(r"[^\x20\x09-\x0D]+", t))
    unigrams = sum(k * np.log(k / sum(n.values())) for k in n.values()) / sum(n.values())
    assert scored > unigrams + 0.1
    one = scoring.score(docs.where("doc_id = 1"), net, lexicon, counts).first()
    tokens, bounds, hashes, seen = scoring.classes([texts[1]], lexicon)
    every = {r.word: r.n for r in counts.collect()}
    want = sum(net.log_probabilities(scoring.contexts(tokens, bounds, np.array([i])), tokens[i : i + 1])[0] for i in range(len(tokens)))
    want += sum(np.log(every[int(h)] / lexicon.totals[c]) for h, c in zip(hashes.view(np.int64), tokens) if c >= scoring.FREQUENT)
    assert one.log_likelihood == pytest.approx(float(want), rel=1e-3) and one.n_tokens == len(tokens)


@pytest.mark.parametrize("size", [1, 200])
def test_counts_of_rare_words_are_joined(spark, docs, monkeypatch, size):
    """The same scores whatever part of the words is in the lexicon."""
    want = {r.doc_id: r.log_likelihood for r in scoring.pseudo_likelihood(docs).collect()}
    monkeypatch.setattr(scoring, "LEXICON", scoring.FREQUENT + size)
    got = {r.doc_id: r.log_likelihood for r in scoring.pseudo_likelihood(docs).collect()}
    assert got == pytest.approx(want, rel=1e-6)


# Jaccard join


def brute_components(texts: dict, n: int = 5, percent: int = 80) -> dict:
    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_links_on_tables(docs, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_documents(docs).collect()}
    assert got == brute_components(texts)


@pytest.mark.parametrize("group, block", [(8, 1024), (2, 16)])
def test_links_of_edited_copies(spark, monkeypatch, group, block):
    """Groups of copies with edits around the threshold, common passages, and short texts; also with tiny groups and blocks."""
    monkeypatch.setattr(jaccard, "GROUP", group)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "SHINGLES", block * 60)
    rng = np.random.default_rng(group)
    words = [f"w{i}" for i in range(3000)]
    fresh = lambda n: list(rng.choice(words, n))
    passage, texts = fresh(40), {}
    for base in range(6):
        source = fresh(int(rng.integers(8, 160)))
        for _ in range(30):
            t = list(source)
            for _ in range(int(rng.integers(0, max(2, len(t) // 25)))):
                t[rng.integers(len(t))] = f"e{rng.integers(10**6)}"
            texts[len(texts)] = " ".join(t[int(rng.integers(0, 3)) :])
    for _ in range(40):
        texts[len(texts)] = " ".join(passage + fresh(int(rng.integers(0, 60))))
    for n in range(1, 12):
        for _ in range(3):
            texts[len(texts)] = " ".join(words[: n + int(rng.integers(0, 2))])
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_documents(frame).collect()}
    assert got == brute_components(texts)


def bitmap(buckets):
    out = np.zeros((1 << jaccard.BITS) // 8, np.uint8)
    np.bitwise_or.at(out, buckets >> 3, (1 << (buckets & 7)).astype(np.uint8))
    return out


@given(st.data())
@settings(max_examples=300, deadline=None)
def test_linked_sets_share_a_signature(data):
    n = data.draw(st.integers(1, 60))
    a = set(data.draw(st.lists(st.integers(0, 2**63), min_size=n, max_size=n, unique=True)))
    gone = data.draw(st.sets(st.sampled_from(sorted(a)), max_size=max(1, n // 5)))
    b = (a - gone) | set(data.draw(st.lists(st.integers(0, 2**63), max_size=n // 4)))
    often = bitmap(jaccard.bucket(np.array(sorted(data.draw(st.sets(st.sampled_from(sorted(a | b))))), np.uint64)))
    if b and 100 * len(a & b) >= 80 * len(a | b):
        sides = [set(jaccard.signatures(np.array(sorted(s), np.uint64), often, 80)[0].tolist()) for s in (a, b)]
        assert sides[0] & sides[1]


def test_frequent_tokens_come_in_pairs(spark):
    """A corpus of groups of near copies: their shingles are frequent, and pairs of them are what brings them together."""
    rng = np.random.default_rng(9)
    texts = {}
    for _ in range(8):
        source = [f"w{x}" for x in rng.integers(0, 10**6, 120)]
        for _ in range(25):
            t = list(source)
            for _ in range(int(rng.integers(0, 5))):
                t[rng.integers(len(t))] = f"e{rng.integers(10**6)}"
            texts[len(texts)] = " ".join(t)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    counts = collections.Counter()
    sets = list(jaccard.shingle_sets(list(texts.values()), 5))
    for s in sets:
        counts.update(jaccard.bucket(s).tolist())
    often = jaccard.frequent_buckets(frame, 5)
    assert (often == bitmap(np.array([b for b, n in counts.items() if n >= jaccard.FREQUENT]))).all()
    rows = jaccard._set_rows(jaccard.identified(frame), often, 5, 80).where("kind = 0").toPandas()
    single = {int(x) for s in sets for x in s.view(np.int64)}
    pairs = rows[~rows["sig"].isin(single)]
    assert pairs["sid"].nunique() > 0.9 * rows["sid"].nunique() and (pairs["place"] == -1).all()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_documents(frame).collect()}
    assert got == brute_components(texts)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (300, 200), (5, 5)]
    got = {r.node: r.root for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 100: 0, 201: 200, 300: 200}


# Decontamination


def test_smith_waterman_against_plain():
    rng = np.random.default_rng(2)
    items = [rng.integers(1, 6, rng.integers(1, 12)).astype(np.uint64) for _ in range(60)]
    windows = [rng.integers(1, 6, rng.integers(1, 20)).astype(np.uint64) for _ in range(60)]
    score, start, end = decontamination.smith_waterman(items, windows)
    for q, w, s, x, y in zip(items, windows, score, start, end):
        h = np.zeros((len(q) + 1, len(w) + 1), int)
        for i, j in itertools.product(range(1, len(q) + 1), range(1, len(w) + 1)):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if q[i - 1] == w[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert s == h.max() and (s == 0 or (0 <= x < y <= len(w) and h[:, y].max() == s))


def test_edited_copies_are_found(spark, data):
    items = pd.read_parquet(f"{data}/benchmark.parquet").set_index("item_id")["text"].to_dict()
    rng = np.random.default_rng(4)
    filler = lambda n: " ".join(f"f{x}" for x in rng.integers(0, 500, n))
    rows, want = [], set()
    for k, (i, text) in enumerate(items.items()):
        words = text.split()
        for _ in range(len(words) // 8):
            at = rng.integers(len(words))
            words[at : at + 1] = [] if rng.random() < 0.3 else ["edited"] if rng.random() < 0.6 else ["two", "new"]
        rows.append((k, f"{filler(50)} {' '.join(words)} {filler(50)}"))
        want.add((k, i))
    rows += [(1000 + k, filler(200)) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontamination.find_leaks(docs, spark.read.parquet(f"{data}/benchmark.parquet")).collect()
    assert len({(r.doc_id, r.item_id) for r in got} & want) >= 0.95 * len(want)
    assert not any(r.doc_id >= 1000 for r in got) and all(40 <= r.word_start < r.word_end <= 160 for r in got)


@pytest.mark.parametrize("min_score", [0.5, 0.8])
def test_all_pairs_of_the_least_score_are_found(min_score):
    """Heavily edited copies, some without three or two words in a row left, against aligning every pair."""
    rng = np.random.default_rng(6)
    vocabulary = np.array([f"w{x}" for x in range(300)])
    word = lambda n: list(vocabulary[np.minimum(rng.geometric(0.02, n), 300) - 1])
    items = [word(rng.integers(5, 40)) for _ in range(30)]
    texts = []
    for k in range(240):
        copy = []
        for place, w in enumerate(items[k % 30]):
            kind = rng.random() if k % 4 else 0.4 if place % 3 == 2 else 1
            copy += [] if kind < (k % 7) / 40 else word(1) if kind < (k % 7) / 12 else [w, *word(1)] if kind < (k % 7) / 9 else [w]
        texts.append(word(rng.integers(0, 60)) + copy + word(rng.integers(0, 60)))
    texts.append([y for x in items[0] for y in (x, "of")])
    texts += [[y for k, x in enumerate(items[1]) for y in ([x, "of", "of"] if k % 2 else [x])], [x for k, x in enumerate(items[2]) if k % 4 != 3], ["of" if k % 4 == 3 else x for k, x in enumerate(items[3])]]
    m = decontamination.Items(np.arange(30), [" ".join(x) for x in items], min_score, 5)
    hashes, bounds = decontamination._words([" ".join(t) for t in texts])
    for counts in (np.bincount(m.all.find(hashes, bounds)[1], minlength=len(m.all.values)), np.zeros(len(m.all.values), np.int64)):
        m.choose_seeds(counts)
        got = {(t, i): score for t, i, score, *_ in decontamination.leaks_of(m, hashes, bounds, [(t,) for t in range(len(texts))])}
        want = {}
        for t, i in itertools.product(range(len(texts)), range(30)):
            score = decontamination.smith_waterman([m.words[i]], [hashes[bounds[t] : bounds[t + 1]]])[0][0] / (2 * len(items[i]))
            if score >= min_score:
                want[t, i] = score
        assert got == want and len(want) > 20


def test_sure_pairs():
    """No edit of the least score keeps fewer pairs, at most a word apart, than `sure`: all edits of small items."""
    for n, score in itertools.product((5, 6), (0.5, 0.7)):
        item = [f"w{i}" for i in range(n)]
        m = decontamination.Items(np.arange(1), [" ".join(item)], score, 5)
        least = n
        for kinds in itertools.product(("keep", "drop", "swap", "one", "two"), repeat=n):
            text = [y for w, k in zip(item, kinds) for y in {"keep": [w], "drop": [], "swap": ["x"], "one": [w, "x"], "two": [w, "x", "x"]}[k]]
            cost = 2 * n * score
            if sum({"keep": 2, "drop": -1, "swap": -1, "one": 1, "two": 0}[k] for k in kinds) + 2 >= cost:  # what is put in last is not in the alignment
                hashes, bounds = decontamination._words([" ".join(text)])
                if decontamination.smith_waterman([m.words[0]], [hashes])[0][0] >= cost:
                    least = min(least, len(set(m.all.find(hashes, bounds)[0])) if m.paired[0] else m.sure[0])
        assert least >= m.sure[0] >= 1


def test_seed_hits_are_few(data, texts):
    """Of 200 items, passages of the documents themselves, the seeds' hits per word of all documents; in 100 items about half as many."""
    own = [" ".join(t.split()[20:55]) for t in texts.values() if t and len(t.split()) > 80]
    hashes, bounds = decontamination._words([t or "" for t in texts.values()])
    rate = {}
    for n in (len(own[:200]) // 2, len(own[:200])):
        m = decontamination.Items(np.arange(n), own[:n], 0.5, 5)
        m.choose_seeds(np.bincount(m.all.find(hashes, bounds)[1], minlength=len(m.all.values)))
        rate[n] = sum(len(w) for _, w, _ in m.hits(hashes, bounds)) / len(hashes)
    assert max(rate.values()) < 0.2


def test_a_benchmark_in_blocks(spark, data, docs, monkeypatch):
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    want = {tuple(r)[:3] for r in decontamination.find_leaks(docs, items).drop("n_seeds").collect()}
    monkeypatch.setattr(decontamination, "ITEMS_AT_ONCE", 15)
    assert want and {tuple(r)[:3] for r in decontamination.find_leaks(docs, items).drop("n_seeds").collect()} == want
    monkeypatch.setattr(decontamination, "ITEM_BYTES_AT_ONCE", 3_000)
    assert {tuple(r)[:3] for r in decontamination.find_leaks(docs, items).drop("n_seeds").collect()} == want


def test_copies_without_seeds_of_several_words(spark):
    words = [f"w{x}" for x in range(20)]
    texts = [
        " ".join(w + " of" for w in words),  # no two words in a row are left
        " ".join("of" if k % 4 == 3 else w for k, w in enumerate(words)),  # half of the 3-grams are in no document
        "of " * 40,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    got = {r.doc_id: (r.item_id, round(r.score, 3)) for r in decontamination.find_leaks(docs, items).collect()}
    assert got == {0: (7, 0.525), 1: (7, 0.65)}


def test_word_hashes_follow_the_pattern():
    for text in ["", " a  bC d\te\n", "É é x" * 3, "\x0b\x0c\r word"]:
        _, starts, ends, hashes, bounds = shared.scan_words([text, text])
        want = re.findall(r"[^\x20\x09-\x0D]+", text)
        assert np.diff(bounds).tolist() == [len(want)] * 2
        assert hashes[: len(want)].tolist() == hashes[len(want) :].tolist()
