"""Packing by minimum bin slack.

Documents become token sequences of at most `window` tokens. Whole windows are cut off a document as it is read; what
remains of each document goes to a pool of lengths. Each window is then filled by the multiset of remaining lengths
whose sum comes closest to the window: a subset-sum dynamic programme over bitsets, whose counts are backtracked. A slack
that no multiset can fill is filled by cutting a piece, so only the rest of a partition can be short; that is laid out in
powers of two, which need no padding.

There is no shuffle: each partition is packed as it streams by, with a bounded pool, and sequence ids start at the
partition's number, so a task that runs again gives the same rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tracelink.llm.shared import named, small_batches, unnamed

PIECES = (
    "doc_id long, nameless boolean, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, token_ids array<int>"
)
_encoders: dict[tuple, object] = {}


class Encoder:
    """Token ids of byte-level BPE files.

    `json_file` is a `tokenizers` file and decides the ids. Where `rank_file` holds the same vocabulary as ranks, texts
    without special tokens are encoded from it, which gives the same ids several times faster.
    """

    def __init__(self, json_file: str, rank_file: str | None, pattern: str | None):
        import json

        self.json_file, self.slow = json_file, None
        with open(json_file, encoding="utf-8") as f:
            self.special = tuple(t["content"] for t in json.load(f).get("added_tokens", []))
        self.fast = None
        if rank_file:
            import base64

            import tiktoken

            with open(rank_file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(s in text for s in self.special):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.json_file)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def encoder(*files: str | None) -> Encoder:
    if files not in _encoders:
        _encoders[files] = Encoder(*files)
    return _encoders[files]


def best_multiset(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths (at most counts[length] of each) whose sum is closest to capacity from below.

    Bit s of `bits` says whether sum s can be reached; each copy of a length is one shift. Backtracking over the states
    before each copy gives the counts taken.
    """
    mask, goal = (1 << capacity + 1) - 1, 1 << capacity
    bits, steps = 1, []
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        for _ in range(min(counts[length], capacity // length)):
            more = bits | bits << length & mask
            if more == bits:
                break
            steps.append((length, bits))
            bits = more
            if bits & goal:
                break
        if bits & goal:
            break
    left, taken = bits.bit_length() - 1, {}
    for length, before in reversed(steps):
        if not before >> left & 1:
            taken[length] = taken.get(length, 0) + 1
            left -= length
    return taken


class Packer:
    """Packs the pieces of one partition; `rows` are finished pieces."""

    def __init__(self, window: int, first_sequence: int, keep_ids: bool):
        self.window, self.sequence, self.keep_ids = window, first_sequence, keep_ids
        self.pool: dict[int, list] = {}
        self.total = self.n = 0
        self.rows: list[tuple] = []

    def put(self, piece: tuple, offset: int) -> int:
        doc, start, ids, doc_tokens = piece
        raw = ids.tobytes()
        self.rows.append((*doc, start, len(ids), zlib.crc32(raw), doc_tokens, self.sequence, offset, ids.astype(np.int32) if self.keep_ids else None))
        return offset + len(ids)

    def add(self, doc, ids: np.ndarray) -> None:
        ids = ids.astype("<u4", copy=False)
        n, at = len(ids), 0
        while n - at >= self.window:
            self.put((doc, at, ids[at : at + self.window], n), 0)
            self.sequence += 1
            at += self.window
        if at < n:
            self.hold((doc, at, ids[at:].copy(), n))

    def hold(self, piece: tuple) -> None:
        size = len(piece[2])
        self.pool.setdefault(size, []).append(piece)
        self.total, self.n = self.total + size, self.n + 1

    def take(self, size: int) -> tuple:
        kept = self.pool[size]
        piece = kept.pop()
        if not kept:
            del self.pool[size]
        self.total, self.n = self.total - size, self.n - 1
        return piece

    def cut(self, size: int) -> tuple:
        """The first `size` tokens of the shortest piece that is longer; the rest goes back to the pool."""
        doc, start, ids, n = self.take(min(x for x in self.pool if x > size))
        self.hold((doc, start + size, ids[size:], n))
        return doc, start, ids[:size], n

    def fill(self, capacity: int) -> None:
        """One sequence of exactly `capacity` tokens; the pool holds at least as many."""
        offset, largest = 0, max((x for x in self.pool if x <= capacity), default=0)
        if largest:
            offset = self.put(self.take(largest), 0)
        counts = {x: len(p) for x, p in self.pool.items()}
        for length, k in best_multiset(counts, capacity - offset).items():
            for _ in range(k):
                offset = self.put(self.take(length), offset)
        if offset < capacity:  # every piece left is longer than the slack, else the multiset was not the best
            offset = self.put(self.cut(capacity - offset), offset)
        self.sequence += 1

    def pack(self, down_to: int) -> None:
        while self.total >= self.window and self.n > down_to:
            self.fill(self.window)

    def finish(self) -> None:
        self.pack(0)
        while self.total:
            self.fill(1 << self.total.bit_length() - 1)


def pack(docs: DataFrame, encode: tuple[str, str | None, str | None], window: int = 1024, pool: int = 4096, end_id: int = 0, keep_ids: bool = True) -> DataFrame:
    """Packs (doc_id, text) into sequences of at most `window` tokens.

    encode: the files of `Encoder`. pool: the number of document rests at which windows are filled; a quarter stays for
    the next ones. A null or empty text is `end_id` alone. Rows are packed as often as they occur, those
    without doc_id too; an empty table gives no rows; other columns are not read. Returns a row for each piece, with its token ids unless keep_ids is false.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to_ids, names = encoder(*encode), [c.split()[0] for c in PIECES.split(", ")]
        packer = Packer(window, TaskContext.get().partitionId() << 40, keep_ids)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for *doc, text in zip(batch["doc_id"].array, batch["nameless"].array, batch["text"].array):
                packer.add(tuple(doc), np.concatenate([to_ids(text), end]) if isinstance(text, str) and text else end)
                if packer.n >= pool:
                    packer.pack(pool // 4)
                if len(packer.rows) >= 8192:
                    yield pd.DataFrame(packer.rows, columns=names)
                    packer.rows = []
        packer.finish()
        if packer.rows:
            yield pd.DataFrame(packer.rows, columns=names)

    small_batches(docs.sparkSession)
    return unnamed(named(docs.select("doc_id", "text")).select("doc_id", "nameless", "text").mapInPandas(run, PIECES))
