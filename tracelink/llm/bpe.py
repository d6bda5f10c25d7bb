"""Byte-level BPE from a table of ranks: encoding by backtracking over longest matches, and decoding.

Merging pairs until none is left takes quadratic time on long pieces. Instead, two facts are used. A sequence of tokens is the
encoding of its bytes exactly if each two neighbours are the encoding of theirs, and the encoding of a prefix is unique. So an
encoder walks from left to right: at each place it takes the longest token of the text there that may follow the one before,
then shorter ones, and goes back one token where none may. A place it went back from is never entered again, so a piece takes
as many steps as it has places, times the prefixes that a token has.

The longest tokens come from one pass of an Aho-Corasick automaton over the piece; its keys are strings, so bytes are mapped to
Latin-1 characters. Whether two tokens may stand side by side is found by undoing their last merges along the border, later
ones first: if at any time the pair at the border has a rank that would have been merged before, they may not. These answers,
and the ids of short pieces, are remembered in tables of bounded size.

The driver reads the ranks and derives the tables once; workers get them as a broadcast of the vocabulary's size.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from tracelink.llm.shared import small_batches

NEVER = 1 << 40
#: A character of each class that patterns name, and one of none of them; no pattern names these themselves.
STAND_IN = {r"\p{L}": "\u02b0", r"\p{N}": "\u00b2", r"\s": "\u2003", "": "\uffff"}


@functools.cache
def odd_characters() -> dict[int, str]:
    """Code points that the library of the rank files and the one that splits texts here put into different classes, as their
    Unicode versions differ, each with a stand-in of the class that the former has for it."""
    import tiktoken

    text = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))))
    out = dict.fromkeys(text, "")
    ours = dict.fromkeys(text, "")
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        # Only matches are encoded, so the ids of single bytes are the characters of the class.
        probe = tiktoken.Encoding("probe", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        out.update(dict.fromkeys(bytes(probe.encode_ordinary(text)).decode(), kind))
        ours.update(dict.fromkeys(regex.findall(_unicode(kind), text), kind))
    return {ord(c): STAND_IN[kind] for c, kind in out.items() if kind != ours[c]}


def _unicode(pattern: str) -> str:
    """Rank files mean Unicode's white space; \\s has four control characters more in Python."""
    return pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


@dataclass(frozen=True)
class Vocabulary:
    """Tokens by id (their ranks), the two ids that each is merged from (-1: a byte, -2: no merges make it), the pattern whose
    matches are encoded separately (its classes: letters, numbers and white space), and the code points whose class differs."""

    words: list[bytes]
    left: list[int]
    right: list[int]
    pattern: str
    odd: dict[int, str]
    name: str

    @staticmethod
    def read(path: str, pattern: str) -> Vocabulary:
        """From a file with a token in base 64 and its rank on each line."""
        with open(path, "rb") as f:
            raw = f.read()
        return Vocabulary.of({base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}, pattern)

    @staticmethod
    def of(ranks: dict[bytes, int], pattern: str) -> Vocabulary:
        """Derives the merges. Ranks must be gapless and hold all 256 bytes, before any token that is merged from them; a token's parts must have lower
        ranks than it has, as training leaves them."""
        words = sorted(ranks, key=ranks.__getitem__)
        if [ranks[w] for w in words] != list(range(len(words))) or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("ranks must count from 0 without gaps and hold every byte")
        left, right = [], []
        for w in words:
            parts, last = [bytes([b]) for b in w], (-1, -1)
            while len(parts) > 1:
                rank, i = min((ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(itertools.pairwise(parts)))
                if rank == NEVER:
                    last = (-2, -2)
                    break
                last = ranks[parts[i]], ranks[parts[i + 1]]
                if max(last) >= rank:
                    raise ValueError(f"the parts of {parts[i] + parts[i + 1]!r} do not rank before it")
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            left.append(last[0])
            right.append(last[1])
        return Vocabulary(words, left, right, pattern, odd_characters(), hashlib.sha256(repr((words, pattern)).encode()).hexdigest())


class _Pieces(dict):
    """Ids of pieces, encoded when first asked for."""

    def __init__(self, encode, most: int = 300_000, longest: int = 64):
        self.encode, self.most, self.longest = encode, most, longest

    def __missing__(self, piece: str) -> list[int]:
        ids = self.encode(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Encodes texts by a vocabulary, in one process."""

    def __init__(self, v: Vocabulary, pairs: int = 300_000):
        self.v, self.most_pairs = v, pairs
        self.ranks = {w: i for i, w in enumerate(v.words)}
        self.sizes = [len(w) for w in v.words]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        #: The longest token that is a proper prefix of a token, or -1.
        self.shorter = [-1] * len(v.words)
        for i, w in enumerate(v.words):
            if v.left[i] == -2:
                continue
            self.automaton.add_word(w.decode("latin-1"), (i, len(w) - 1))
            for n in range(len(w) - 1, 0, -1):
                p = self.ranks.get(w[:n])
                if p is not None and v.left[p] != -2:
                    self.shorter[i] = p
                    break
        self.automaton.make_automaton()
        self.split = regex.compile(_unicode(v.pattern))
        self.odd_set = set(map(chr, v.odd))
        # One range around them all is quick to look for.
        self.odd = re.compile(f"[{re.escape(chr(min(v.odd)))}-{re.escape(chr(max(v.odd)))}]") if v.odd else None
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces = _Pieces(self.piece)

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of the bytes of a and b is a and b. Of equal ranks, the leftmost is merged first."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= self.most_pairs:
                self.pairs.clear()
            known = self.pairs[a, b] = self._border_holds(a, b)
        return known

    def _border_holds(self, x: int, y: int) -> bool:
        words, v = self.v.words, self.v
        joins_left = joins_right = NEVER  # the ranks at which x and y are merged on their own sides
        while True:
            rank = self.ranks.get(words[x] + words[y], NEVER)
            if rank < joins_left and rank <= joins_right:
                return False
            if x > y and v.right[x] >= 0:
                joins_left, x = x, v.right[x]
            elif v.left[y] >= 0:
                joins_right, y = y, v.left[y]
            elif v.right[x] >= 0:
                joins_left, x = x, v.right[x]
            else:
                return True

    def piece(self, piece: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest = [0] * n
        for end, (token, before) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - before] = token  # of those that start at a place, the longest ends last
        sizes, shorter, compatible = self.sizes, self.shorter, self.compatible
        closed, out, at = bytearray(n + 1), [], 0
        token = longest[0]
        while True:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + sizes[token]
                if not closed[end] and (last < 0 or compatible(last, token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
            else:
                closed[at] = 1
                token = out.pop()
                at -= sizes[token]

    def ids(self, text: str, at_once: int = 1_000_000) -> np.ndarray:
        """The ids of a text; a long one's matches are taken step by step."""
        if self.odd is not None and self.odd.search(text) and not self.odd_set.isdisjoint(text):
            found = (text[m.start() : m.end()] for m in self.split.finditer(text.translate(self.v.odd)))
        elif len(text) <= at_once:
            found = self.split.findall(text)
        else:
            found = (m.group() for m in self.split.finditer(text))
        return np.fromiter(itertools.chain.from_iterable(map(self.pieces.__getitem__, found)), np.int32)

    def bytes(self, ids: np.ndarray, at_once: int = 1_000_000) -> bytes:
        """The bytes that ids stand for."""
        if len(ids) and not (ids.min() >= 0 and ids.max() < len(self.v.words)):
            raise ValueError("an id is not in the vocabulary")
        of = self.v.words.__getitem__
        return b"".join(b"".join(map(of, ids[i : i + at_once].tolist())) for i in range(0, len(ids), at_once))


_encoders: dict[str, Encoder] = {}


def _encoder(v: Vocabulary) -> Encoder:
    if v.name not in _encoders:
        _encoders[v.name] = Encoder(v)
    return _encoders[v.name]


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Adds nothing, drops nothing: a row (doc_id, token_ids) for each row of docs.

    A null or empty text has no ids. Repeated rows and rows without doc_id come back as they are, an empty table gives no
    rows, and columns other than doc_id and text are not read. A piece of any length is encoded whole.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tables = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = _encoder(tables.value).ids
        for batch in batches:
            each = [to_ids(t) if t else np.zeros(0, np.int32) for t in batch.column("text").to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int32)
            values = np.concatenate(each) if each else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "token_ids"])

    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("token_ids", ArrayType(IntegerType()))])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Takes token_ids away and puts the bytes they stand for, `content`, in their place; other columns stay.

    Null or no ids give no bytes; an id outside of the vocabulary is an error.
    """
    spark = encoded.sparkSession
    small_batches(spark)
    tables = spark.sparkContext.broadcast(vocabulary)
    others = [c for c in encoded.columns if c not in ("token_ids", "content")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_bytes = _encoder(tables.value).bytes
        for batch in batches:
            content = [to_bytes(np.asarray(x.values)) if x.is_valid else b"" for x in batch.column("token_ids")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(content, pa.binary())], [*others, "content"])

    schema = StructType([*(encoded.schema[c] for c in others), StructField("content", BinaryType())])
    return encoded.select(*(f"`{c}`" for c in others), "token_ids").mapInArrow(run, schema)
