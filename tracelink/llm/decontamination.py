"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Seeds are pairs of words that follow each other in an item. In a document the words of a pair may have one other word
between them: a copy can reach the least score with a word put in everywhere, but then few gaps are left for two. How many
such pairs an alignment of the least score keeps at least follows from the scores (see `Items`); of each item so many of
the pairs that are rarest over the whole corpus are seeds that several of them must be hit. Items for which no pair is
sure to be kept, the shortest, have words as seeds. Which n-grams are seeds affects the work, never the result. Documents
are scanned once against the seeds. Where enough of them lie close together, and enough of all the item's words do, the
item and that window of the document are aligned word by word. Neither bound drops an alignment of the least score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelink.llm.shared import NO_LETTER, hashed_runs, mix, named, slabs, small_batches, unnamed

#: Items, and bytes of them, that are broadcast at once; a larger benchmark is taken in blocks.
ITEMS_AT_ONCE, ITEM_BYTES_AT_ONCE = 20_000, 32_000_000
#: Bounds of what is held at once: seed hits or words of windows, and words of windows while they are aligned.
HITS_AT_ONCE, CELLS_AT_ONCE = 2_000_000, 10_000
MATCH, MISMATCH, GAP = 2, -1, -1
MATCHES = "doc_id long, nameless boolean, item_id long, score double, word_start long, word_end long, n_seeds long"


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words (runs of letters and digits) of texts, and bounds."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    _, _, hashes, bounds = hashed_runs(buf, _GAP[buf], raw)
    return hashes, bounds


_GAP = NO_LETTER.copy()
_GAP[48:58] = False


#: Two words that are neighbours in an item may be so far apart in a document.
STEPS = (1, 2)
_SPOTS = 22


def _pairs(first: np.ndarray, second_mixed: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0x9E3779B97F4A7C15) + second_mixed)


class Grams:
    """A set of n-grams (hashes of words or pairs of words) to look for; a table of bits sorts out most others first."""

    def __init__(self, values: np.ndarray, words: bool):
        self.values, self.words = values, words
        self.bits = np.zeros(1 << _SPOTS, bool)
        self.bits[values >> np.uint64(64 - _SPOTS)] = True

    def find(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of words at which n-grams begin, in order, and the n-grams' places among the values."""
        mixed = mix(hashes)
        end = np.repeat(bounds[1:], np.diff(bounds))
        streams = [hashes] if self.words else []
        streams += [_pairs(hashes[:-k], mixed[k:]) for k in STEPS]
        steps = [0] * self.words + list(STEPS)
        where, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, grams in zip(steps, streams):
            maybe = np.flatnonzero(self.bits[grams >> np.uint64(64 - _SPOTS)])
            found, place = _found(self.values, grams[maybe])
            found = maybe[found]
            inside = found + k < end[found]  # n-grams end in the text they begin in
            where.append(found[inside])
            at.append(place[inside])
        where, at = np.concatenate(where), np.concatenate(at)
        by = np.argsort(where, kind="stable")
        return where[by], at[by]


class Items:
    """A block of benchmark items, their words, and the seeds among their n-grams.

    An alignment of the least score matches at least `need` words of an item of `length` words, and covers at most `span`
    words of a document. Let X of the item's words inside of it be unmatched, U at its ends, and I words be put in: then 3 X +
    2 U + I <= R = 2 (1 - score) length. Of the length - 1 pairs, X words break at most 2 X, U at most U, and I words drive
    at most I / 2 pairs more than one word apart, 2 R / 3 at the most together. So at least `sure` pairs are kept (or, where
    that is none, `need` words), and of any number - sure + least of an item's n-grams it keeps at least `least`.
    """

    def __init__(self, ids: np.ndarray, texts: list[str], min_score: float, least_words: int):
        self.ids = ids
        hashes, bounds = _words(texts)
        self.words = [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        self.length = np.diff(bounds)
        self.score = np.where(self.length < least_words, 1.0, min_score)
        self.need = np.maximum(1, np.ceil(self.score * self.length - 1e-9)).astype(np.int64)
        self.span = np.floor((3 - 2 * self.score) * self.length + 1e-9).astype(np.int64)
        pairs = self.length - 1 - np.floor(4 * (1 - self.score) * self.length / 3 + 1e-9).astype(np.int64)
        self.paired = pairs > 0
        self.sure = np.where(self.paired, pairs, self.need)
        self.number = self.length - self.paired  # n-grams of an item
        self.least = 1 + self.sure // 4
        item = np.repeat(np.arange(len(texts)), self.length)
        self.held = np.unique(_of_item(hashes, item))
        grams = hashes.copy()
        grams[:-1] = np.where(self.paired[item[:-1]], _pairs(hashes[:-1], mix(hashes[1:])), hashes[:-1])
        ends = np.zeros(len(hashes), bool)
        ends[bounds[1:][self.length > 0] - 1] = True
        begins = ~(ends & self.paired[item])  # no pair begins at an item's last word
        self.gram, self.item = grams[begins], item[begins]
        self.all = Grams(np.unique(self.gram), bool((~self.paired).any()))

    def choose_seeds(self, counts: np.ndarray) -> None:
        """Seeds are the rarest number - sure + least n-grams of each item (ties: by hash); counts is aligned with self.all."""
        by = np.lexsort((self.gram, counts[np.searchsorted(self.all.values, self.gram)], self.item))
        gram, item = self.gram[by], self.item[by]
        rank = np.arange(len(by)) - np.searchsorted(item, item)
        few = rank < (self.number - self.sure + self.least)[item]
        seeds = pd.DataFrame({"gram": gram[few], "item": item[few]}).drop_duplicates().sort_values(["gram", "item"])
        self.seed, self.seed_item = seeds["gram"].to_numpy(np.uint64), seeds["item"].to_numpy(np.int64)
        values, self.seed_at = np.unique(self.seed, return_index=True)
        self.seed_end = np.append(self.seed_at[1:], len(self.seed))
        self.seeds = Grams(values, self.all.words)

    def hits(self, hashes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, word, item) of all seeds' occurrences, some texts at a time."""
        where, at = self.seeds.find(hashes, bounds)
        n = (self.seed_end - self.seed_at)[at]
        total, edges = np.concatenate([[0], np.cumsum(n)]), np.searchsorted(where, bounds)
        for a, b in slabs_of(total[edges], HITS_AT_ONCE):
            part = slice(edges[a], edges[b])
            n_part, first = n[part], self.seed_at[at[part]]
            k = np.repeat(first - np.cumsum(n_part) + n_part, n_part) + np.arange(n_part.sum())
            word = np.repeat(where[part], n_part)
            yield np.searchsorted(bounds, word, side="right") - 1, word, self.seed_item[k]


def _found(values: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of hashes that are among the sorted values, and the values' places."""
    at = np.searchsorted(values, hashes)
    ok = at < len(values)
    ok[ok] = values[at[ok]] == hashes[ok]
    return np.flatnonzero(ok), at[ok]


def _of_item(words: np.ndarray, items: np.ndarray) -> np.ndarray:
    return mix(words ^ mix(items.astype(np.uint64) + np.uint64(1)))


def slabs_of(total: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cuts len(total) - 1 things, total[i] the weight before the i-th, into runs of `most` at most, or of a single one."""
    a = 0
    while a < len(total) - 1:
        b = max(a + 1, int(np.searchsorted(total, total[a] + most, side="right")) - 1)
        yield a, b
        a = b


def _windows(group: np.ndarray, place: np.ndarray, least: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, begin, stop) of windows around places first to last of one group; group and place are sorted.

    Whatever covers `span` words at most and at least `least` of a group's places lies inside one of them.
    """
    i = np.arange(len(group))
    i = i[i + least - 1 < len(group)]
    j = i + least[i] - 1
    i = i[(group[j] == group[i]) & (place[j] - place[i] < span[i])]
    j = i + least[i] - 1
    begin, stop = place[j] - span[i] + 1, place[i] + span[i]
    # Begins and stops of one group both ascend: windows that overlap are one.
    new = np.ones(len(i), bool)
    new[1:] = (group[i[1:]] != group[i[:-1]]) | (begin[1:] >= stop[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(i))[: len(first)] - 1
    return i[first], j[last], begin[first], stop[last]


def smith_waterman(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Local alignments of items[i] with windows[i], all at once: (score, start, end) with the span in the window.

    A row of the matrix is one item word against all window words; gaps along the row come from a running maximum. The
    start is carried along with each cell, packed under the score.
    """
    n, rows, cols = len(items), max(map(len, items)), max(map(len, windows))
    q, w = np.zeros((n, rows), np.uint64), np.ones((n, cols), np.uint64)
    q_len = np.array([len(x) for x in items])
    for i, (a, b) in enumerate(zip(items, windows)):
        q[i, : len(a)], w[i, : len(b)] = a, b
    real = np.arange(cols) < np.array([len(x) for x in windows])[:, None]
    shift = np.int64(1 << 32)  # a cell is score * shift + (shift - 1 - start): ties go to the earlier start
    fresh = (shift - 1 - np.arange(cols + 1)).astype(np.int64)
    prev = np.broadcast_to(fresh, (n, cols + 1)).copy()
    best, best_end = np.zeros(n, np.int64), np.zeros(n, np.int64)
    step = np.arange(cols + 1) * (-GAP * shift)
    for r in range(rows):
        same = (q[:, r : r + 1] == w) & real & (r < q_len)[:, None]
        cell = np.empty((n, cols + 1), np.int64)
        cell[:, 0] = fresh[0]
        cell[:, 1:] = np.maximum(prev[:, :-1] + np.where(same, MATCH, MISMATCH) * shift, prev[:, 1:] + GAP * shift)
        cell[:, 1:] = np.where(cell[:, 1:] >= shift, cell[:, 1:], fresh[1:])
        cell = np.maximum.accumulate(cell + step, axis=1) - step
        cell = np.where(cell >= shift, cell, fresh)
        end = cell.argmax(axis=1)
        top = cell[np.arange(n), end]
        better = top > best
        best[better], best_end[better] = top[better], end[better]
        prev = cell
    return best // shift, np.where(best >= shift, shift - 1 - best % shift, 0), best_end


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = 0.5, least_words: int = 5) -> DataFrame:
    """Pairs of documents (doc_id, text) and benchmark items (item_id, text) that the document holds a copy of.

    score is the alignment's score over that of the whole item (1: every word in order); all pairs of at least min_score come
    back, each once, with the best alignment's words (places among the document's words of letters and digits) and the
    number of seed hits. An item of fewer than `least_words` words must be there whole, all words in a row (score 1); empty
    and null texts match nothing. Repeated documents each get their pairs, and so do those without doc_id; items without
    item_id are no items; an empty table on either side gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / ITEMS_AT_ONCE), math.ceil(size / ITEM_BYTES_AT_ONCE))
    out = None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toPandas().drop_duplicates().sort_values("item_id", kind="stable")
        block = Items(part["item_id"].to_numpy(), list(part["text"]), min_score, least_words)
        block.choose_seeds(gram_counts(docs, block))
        found = _align(docs, spark.sparkContext.broadcast(block))
        out = found if out is None else out.unionByName(found)
    return out


def gram_counts(docs: DataFrame, items: Items) -> np.ndarray:
    """How often all documents hold each of the items' n-grams."""
    shared = docs.sparkSession.sparkContext.broadcast(items.all)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = shared.value
        n = np.zeros(len(grams.values), np.int64)
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"].array]
            for a, b in slabs(texts):
                n += np.bincount(grams.find(*_words(texts[a:b]))[1], minlength=len(n))
        yield pd.DataFrame({"gram": np.flatnonzero(n), "n": n[n > 0]})

    out = np.zeros(len(items.all.values), np.int64)
    if len(out):
        for r in docs.select("text").mapInPandas(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
            out[r["gram"]] = r["n"]
    return out


def _align(docs: DataFrame, shared) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            texts, ids = [t if isinstance(t, str) else "" for t in batch["text"].array], list(zip(batch["doc_id"].array, batch["nameless"].array))
            found = []
            for a, b in slabs(texts):
                hashes, bounds = _words(texts[a:b])
                found += leaks_of(m, hashes, bounds, ids[a:b])
            yield pd.DataFrame(found, columns=[c.split()[0] for c in MATCHES.split(", ")])

    return unnamed(named(docs.select("doc_id", "text")).select("doc_id", "nameless", "text").mapInPandas(run, MATCHES))


def candidates(m: Items, text: np.ndarray, word: np.ndarray, item: np.ndarray, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, item, begin, stop, seed hits) of the windows that hold all alignments of the least score.

    Seeds that lie close enough give windows; those stay where enough of all the item's words lie close enough.
    """
    by = np.lexsort((word, item, text))
    text, item, word = text[by], item[by], word[by]
    i, j, begin, stop = _windows(text * len(m.ids) + item, word, m.least[item], m.span[item])
    text, item, n = text[i], item[i], j - i + 1
    begin, stop = np.maximum(begin, bounds[text]), np.minimum(stop, bounds[text + 1])
    found = [(np.zeros(0, np.int64),) * 3]
    for a, b in slabs_of(np.concatenate([[0], np.cumsum(stop - begin)]), HITS_AT_ONCE):
        size = stop[a:b] - begin[a:b]
        which = np.repeat(np.arange(a, b), size)
        at = np.arange(size.sum()) + np.repeat(begin[a:b] - np.cumsum(size) + size, size)
        held = _found(m.held, _of_item(hashes[at], item[which]))[0]
        which, at = which[held], at[held]
        i, _, x, y = _windows(which, at, m.need[item[which]], m.span[item[which]])
        found.append((which[i], np.maximum(x, begin[which[i]]), np.minimum(y, stop[which[i]])))
    which, begin, stop = (np.concatenate(x) for x in zip(*found))
    return text[which], item[which], begin, stop, n[which]


def leaks_of(m: Items, hashes: np.ndarray, bounds: np.ndarray, ids: list[tuple]) -> list[tuple]:
    """Aligned pairs of a slab of texts."""
    best: dict[tuple, tuple] = {}
    for hits in m.hits(hashes, bounds):
        text, item, begin, stop, seeds = candidates(m, *hits, hashes, bounds)
        order = np.lexsort((m.length[item], stop - begin))
        for a, b in slabs_of(np.concatenate([[0], np.cumsum((stop - begin)[order])]), CELLS_AT_ONCE):
            part = order[a:b]
            score, start, end = smith_waterman([m.words[k] for k in item[part]], [hashes[x:y] for x, y in zip(begin[part], stop[part])])
            for c, s, x, y in zip(part, score, start, end):
                share = float(s) / (MATCH * int(m.length[item[c]]))
                if share >= m.score[item[c]]:
                    key, at = (int(text[c]), int(item[c])), int(begin[c] - bounds[text[c]])
                    row = (share, -(at + int(x)), at + int(y), int(seeds[c]))
                    best[key] = max(best.get(key, row), row)
    return [(*ids[t], m.ids[i], share, -neg, end, n) for (t, i), (share, neg, end, n) in sorted(best.items())]
