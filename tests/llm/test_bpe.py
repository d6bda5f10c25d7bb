"""Byte-level BPE against the public library and plain merging, and the round trip."""

import hashlib
import itertools
import random

import public_tokenizers as public
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracelink.llm import queries
from tracelink.llm.bpe import Encoder, Vocabulary, decode, encode

FILE = public.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.read(FILE, public.PATTERN)


@pytest.fixture(scope="module")
def encoder(vocabulary):
    return Encoder(vocabulary)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks={w: i for i, w in enumerate(vocabulary.words)}, special_tokens={})


def merged(piece, ranks):
    """Plain merging of the least rank, leftmost first."""
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        rank, i = min((ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(itertools.pairwise(parts)))
        if rank == 1 << 40:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


@given(st.text(alphabet="ab éß \n\t中文字xyzэю😀's1#|\x1c\x85 ", max_size=80))
@settings(max_examples=400, deadline=None)
def test_like_the_library(encoder, library, text):
    ids = encoder.ids(text)
    assert ids.tolist() == library.encode_ordinary(text)
    assert encoder.bytes(ids) == text.encode()


@given(st.binary(max_size=40))
@settings(max_examples=300, deadline=None)
def test_any_bytes(encoder, piece):
    if piece:
        assert encoder.piece(piece) == merged(piece, encoder.ranks)


def test_random_vocabularies():
    """Small alphabets, so that tokens overlap in every way; the merges are drawn at random."""
    rng = random.Random(5)
    for _ in range(60):
        ranks = {bytes([b]): b for b in range(256)}
        made = [b"a", b"b", b"c"]
        for _ in range(rng.randrange(1, 25)):
            word = rng.choice(made) + rng.choice(made)
            if word not in ranks and len(merged(word, ranks)) == 2 and len(word) < 20:
                ranks[word] = len(ranks)
                made.append(word)
        e = Encoder(Vocabulary.of(ranks, public.PATTERN), pairs=5)
        for _ in range(80):
            piece = bytes(rng.choice(b"aabbc") for _ in range(rng.randrange(1, 30)))
            assert e.piece(piece) == merged(piece, ranks)


def test_a_token_that_no_merge_makes():
    """It is an id only where it is a whole match."""
    ranks = {bytes([b]): b for b in range(256)} | {b"xyz": 256}
    e = Encoder(Vocabulary.of(ranks, public.PATTERN))
    library = tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ("xyz", "xyzx", "a xyz", "xyz xyz1xyz"):
        assert e.ids(text).tolist() == library.encode_ordinary(text)


def test_bad_ranks():
    ranks = {bytes([b]): b for b in range(256)}
    with pytest.raises(ValueError):
        Vocabulary.of({b"a": 0}, public.PATTERN)
    with pytest.raises(ValueError):
        Vocabulary.of(ranks | {b"abc": 256, b"ab": 257}, public.PATTERN)


def test_every_character(encoder, library):
    """Characters that Unicode versions class differently too."""
    for low in range(0, 0x110000, 4096):
        text = "".join(f" {chr(c)}1{chr(c)}a{chr(c)} {chr(c)}{chr(c)}!{chr(c)}\n" for c in range(low, low + 4096) if not 0xD800 <= c < 0xE000)
        assert encoder.ids(text).tolist() == library.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 100_000, "ab" * 50_000, " " * 50_000, "é" * 50_000, "x y\n" * 400_000])
def test_long(encoder, library, text):
    assert encoder.ids(text).tolist() == library.encode_ordinary(text)


def test_tables_stay_small(vocabulary, library):
    e = Encoder(vocabulary, pairs=50)
    e.pieces.most = 20
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("abcdefghij klm") for _ in range(40))
        assert e.ids(text).tolist() == library.encode_ordinary(text)
        assert len(e.pairs) <= 50 and len(e.pieces) <= 20


def test_messy_rows(spark, vocabulary, library):
    long = " ".join(f"w{i % 977}" for i in range(200_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a b"), (4, "a b"), (None, "x"), (5, long), (6, "<|endoftext|> \x00")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("token_ids", "content", "n_tokens")})
    ids = encode(docs, vocabulary)
    got = decode(ids.withColumn("n", F.size("token_ids")), vocabulary).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(((d, len(library.encode_ordinary(t or "")), (t or "").encode()) for d, t in rows), key=order)
    assert sorted(((r.doc_id, r.n, bytes(r.content)) for r in got), key=order) == want
    assert encode(docs.limit(0), vocabulary).count() == 0
    assert decode(spark.createDataFrame([(1, None)], "doc_id long, token_ids array<int>"), vocabulary).first().content == b""
    with pytest.raises(Exception, match="not in the vocabulary"):
        decode(spark.createDataFrame([(1, [50256])], "doc_id long, token_ids array<int>"), vocabulary).collect()


def test_query(spark, data, library):
    got = {r.doc_id: r for r in queries.op12_bpe(spark, data).collect()}
    for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect():
        text, row = r.text or "", got.pop(r.doc_id)
        ids = library.encode_ordinary(text)
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert not got
