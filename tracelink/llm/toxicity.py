"""Toxicity by nearest labelled examples.

Examples and documents are TF-IDF vectors over all words of the examples; a word's weight is also scaled by how surely it
goes with the toxic class among the labelled rows (its log-odds and their standard error, as a smooth factor that is never
0, so no word list is needed and every text with known words has neighbours). The examples stand in a block-max inverted
index: long posting lists are cut into blocks of examples with the largest weight of the block, so that the blocks' upper
bounds decide in which blocks they must be summed at all; the k nearest by cosine are exact. Votes of the neighbours, weighted by
similarity, are mapped to a probability by isotonic calibration over the examples' own left-out votes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelink.llm.shared import letter_words, named, release, slabs, small_batches, unnamed

#: Bounds of the labelled sample that is fitted on, about so many rows of either class: for the words' weights, and of
#: these the examples in the index.
LABELLED, EXAMPLES = 20_000, 1_000
#: What a word weighs that says nothing of the class, against 1 for one that surely marks it.
FLOOR = 0.02
#: The share of toxic rows at large votes like an example of this cosine.
FAR = 0.2


class BlockMaxIndex:
    """Exact cosine search over sparse unit vectors, many queries at a time.

    The lists of rare terms are postings. A list of over a 20th of the rows is kept in blocks of rows, dense, with the
    largest weight of each block. A query's parts from rare terms are summed first; with the blocks' largest weights they
    bound what a block can score, and its long lists are only summed in blocks that may hold one of the k nearest.
    """

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int = 32):
        """rows: (terms, weights) of each example, unit length. Similar rows should be neighbours, as blocks are runs."""
        self.block, self.n, self.blocks = block, len(rows), len(rows) // block + 1
        term = np.concatenate([t for t, _ in rows]) if rows else np.zeros(0, np.int64)
        weight = np.concatenate([w for _, w in rows]) if rows else np.zeros(0)
        row = np.repeat(np.arange(len(rows)), [len(t) for t, _ in rows])
        long = np.flatnonzero(np.bincount(term, minlength=terms) > self.n / 20)
        self.place = np.full(terms, -1, np.int32)
        self.place[long] = np.arange(len(long))
        place = self.place[term]
        of = np.flatnonzero(place >= 0)
        self.dense = np.zeros((self.blocks, len(long), block))
        self.dense[row[of] // block, place[of], row[of] % block] = weight[of]
        self.most = np.ascontiguousarray(self.dense.max(axis=2).T)
        rest = np.flatnonzero(place < 0)
        by = rest[np.lexsort((row[rest], term[rest]))]
        self.row, self.weight = row[by].astype(np.int32), weight[by]
        self.begin = np.searchsorted(term[by], np.arange(terms + 1)).astype(np.int32)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k rows of largest cosine above 0 (ties: lower row first) and their cosines. without: a row to leave out."""
        return next(self.search_many([(terms, weights)], k, [without]))

    def search_many(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None, at_once: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same for each of many queries (terms, weights)."""
        for at in range(0, len(queries), at_once):
            yield from self._nearest(queries[at : at + at_once], k, without[at : at + at_once] if without else [])

    def _nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        m, width = len(queries), self.blocks * self.block
        of = np.repeat(np.arange(m), [len(t) for t, _ in queries])
        terms, weights = np.concatenate([t for t, _ in queries]).astype(np.int64), np.concatenate([w for _, w in queries])
        place = self.place[terms]
        rare, long = np.flatnonzero(place < 0), np.flatnonzero(place >= 0)
        posting, n = _spread(self.begin[terms[rare]], self.begin[terms[rare] + 1])
        scores = np.bincount(np.repeat(of[rare] * width, n) + self.row[posting], np.repeat(weights[rare], n) * self.weight[posting], m * width)
        scores = scores.astype(np.float64, copy=False).reshape(m, self.blocks, self.block)  # whole numbers if there is no posting
        for i, row in enumerate(without):
            if row >= 0:
                scores[i, row // self.block, row % self.block] = -np.inf
        query = np.zeros((m, self.most.shape[0]))
        query[of[long], place[long]] = weights[long]
        bound = scores.max(axis=2) + query @ self.most
        # The most promising block of each query first. Parts of scores are least scores, and so is the k-th of them.
        todo = np.zeros(bound.shape, bool)
        todo[np.arange(m), bound.argmax(axis=1)] = True
        self._sum_long(scores, query, todo)
        least = _kth(scores.reshape(m, width), k)
        self._sum_long(scores, query, (bound > 0) & (bound >= least[:, None] - 1e-9) & ~todo)
        scores = scores.reshape(m, width)
        of, row = np.nonzero((scores > 0) & (scores >= _kth(scores, k)[:, None] - 1e-9))
        cos = scores[of, row]
        by = np.lexsort((row, -np.round(cos, 12), of))
        row, cos, cut = row[by], cos[by], np.searchsorted(of, np.arange(m + 1))
        for lo, hi in zip(cut[:-1], cut[1:]):
            yield row[lo : min(hi, lo + k)], cos[lo : min(hi, lo + k)]

    def _sum_long(self, scores: np.ndarray, query: np.ndarray, todo: np.ndarray) -> None:
        """Adds what the long lists give to the blocks that are to do for each query."""
        for b in np.flatnonzero(todo.any(axis=0)):
            mine = np.flatnonzero(todo[:, b])
            scores[mine, b] += query[mine] @ self.dense[b]


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, 0 at least."""
    at = scores.shape[1] - k
    return np.maximum(np.partition(scores, at, axis=1)[:, at], 0) if at >= 0 else np.zeros(len(scores))


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges lo to hi, and how many each range has."""
    n = hi - lo
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) + np.repeat(lo - ends + n, n), n


@dataclass
class Model:
    terms: np.ndarray  # sorted hashes of the examples' words
    gain: np.ndarray  # idf times the factor of the class
    marking: np.ndarray  # words whose factor is nearer to 1
    index: BlockMaxIndex
    ids: np.ndarray  # doc_id of each example
    toxic: np.ndarray
    prior: np.ndarray  # rows of the labelled table that an example stands for
    base: float  # share of toxic rows
    knots: tuple[np.ndarray, np.ndarray]  # isotonic map from vote to probability
    k: int


def _vector(codes: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms, their weights at unit length, and where each term comes first."""
    terms, first, n = np.unique(codes, return_index=True, return_counts=True)
    w = (1 + np.log(n)) * gain[terms]
    return terms, w / np.sqrt((w * w).sum()), first


def _codes(texts: list[str], terms: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, Callable[[int], str]]]:
    """For each text the places in `terms` of those of its words that are there, where they stand, and the words there."""
    for a, b in slabs(texts):
        hashes, bounds, word = letter_words(texts[a:b], with_words=True)
        at = np.searchsorted(terms, hashes)
        found = at < len(terms)
        found[found] = terms[at[found]] == hashes[found]
        where = np.flatnonzero(found)
        cut = np.searchsorted(where, bounds)
        for i in range(b - a):
            mine = where[cut[i] : cut[i + 1]]
            yield at[mine], mine, word


def class_factor(a: np.ndarray, b: np.ndarray, toxic: float, clean: float) -> np.ndarray:
    """FLOOR to 1 by how surely words that are in a of the toxic and b of the clean rows mark the toxic class.

    Half where the odds are 6 times as high as in the clean class, or 3.5 standard errors away from even.
    """
    a, b = a + 0.5, b + 0.5
    rest_a, rest_b = np.maximum(toxic + 1 - a, 0.5), np.maximum(clean + 1 - b, 0.5)
    odds = np.log(a * rest_b / (rest_a * b))
    z = odds / np.sqrt(1 / a + 1 / b + 1 / rest_a + 1 / rest_b)
    half = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    return FLOOR + (1 - FLOOR) * half(3 * (z - 3.5)) * half(4 * (odds - np.log(6)))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: the monotone step function nearest to y, as knots for interpolation."""
    by = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x[by], y[by], w[by]):
        blocks.append([xi * wi, yi * wi, wi])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([(b[1] + 0.01) / (b[2] + 0.02) for b in blocks])


def _vote(model: Model, rows: np.ndarray, cos: np.ndarray) -> float:
    """The toxic share of the neighbours' votes; far neighbours give way to the share of toxic rows at large."""
    w, rest = cos**2 * model.prior[rows], FAR**2 * model.prior.mean()
    return float(((w * model.toxic[rows]).sum() + rest * model.base) / (w.sum() + rest))


def fit(docs: DataFrame, labels: DataFrame, k: int = 15, labelled: int = LABELLED, examples: int = EXAMPLES) -> Model:
    """Fits on the labelled rows of (doc_id, text) and (doc_id, toxic) that are not held out.

    Of each class at most about `labelled` rows, by hash of the id, give the words' factors, and `examples` of these are
    the neighbours. Document frequencies of the words are counted over all of `docs`. Runs jobs. What comes to the driver
    comes as arrays, without an object a row, and what earlier jobs left there goes first.
    """
    release(docs.sparkSession)
    small_batches(docs.sparkSession)
    labels = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(4, 2)).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    there = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    share = {(m, y): min(1.0, m / max(there.get(y, 0), 1)) for m in (labelled, examples) for y in (0, 1)}
    one = 1 << 30
    within = lambda m: F.pmod(F.xxhash64("doc_id"), F.lit(one)) < F.when(F.col("toxic") == 1, F.lit(int(share[m, 1] * one))).otherwise(F.lit(int(share[m, 0] * one)))
    # The sample has a bound, so it is what is broadcast, whatever the number of labels.
    known = F.broadcast(labels.where(within(labelled)))
    sample = docs.select("doc_id", "text").where("text IS NOT NULL").join(known, "doc_id")

    def words_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, found = [t.lower() for t in batch["text"].array], []
            for a, b in slabs(texts):
                hashes, bounds = letter_words(texts[a:b])
                found += [np.unique(hashes[lo:hi], return_counts=True) for lo, hi in zip(bounds[:-1], bounds[1:])]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "words": [w.view(np.int64) for w, _ in found], "n": [n for _, n in found]})

    chosen = sample.where(within(examples)).mapInPandas(words_of, "doc_id long, toxic int, words array<long>, n array<long>").toArrow()
    size = chosen["words"].combine_chunks().value_lengths().to_numpy()
    start, words, n = np.cumsum(size) - size, chosen["words"].combine_chunks().flatten().to_numpy().view(np.uint64), chosen["n"].combine_chunks().flatten().to_numpy()
    ids, toxic = chosen["doc_id"].to_numpy(), chosen["toxic"].to_numpy().astype(np.int64)
    some = np.flatnonzero(size > 0)
    some = some[np.argsort(ids[some], kind="stable")]
    terms = np.unique(words)
    seen = _frequencies(sample.select("text", "toxic"), terms)
    every = _frequencies(docs.select("text", F.lit(0).alias("toxic")), terms)
    factor = class_factor(seen[1][:-1], seen[0][:-1], seen[1][-1], seen[0][-1])
    gain = (np.log((every[0][-1] + 1) / (every[0][:-1] + 1)) + 1) * factor
    vectors = []
    for i in some:
        mine = slice(start[i], start[i] + size[i])
        at = np.searchsorted(terms, words[mine])
        w = (1 + np.log(n[mine].astype(np.float64))) * gain[at]
        by = np.argsort(at)
        vectors.append((at[by], (w / np.sqrt((w * w).sum()))[by]))
    order = sorted(range(len(vectors)), key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1])]), len(vectors[i][0]), i))
    ids, toxic = ids[some][order], toxic[some][order]
    prior = np.where(toxic == 1, 1 / share[examples, 1], 1 / share[examples, 0])
    base = float((prior * toxic).sum() / prior.sum()) if len(prior) else 0.0
    model = Model(terms, gain, factor > 0.5, BlockMaxIndex([vectors[i] for i in order], len(terms)), ids, toxic, prior, base, (np.array([0.0, 1.0]), np.array([0.0, 1.0])), k)
    left_out = model.index.search_many([vectors[i] for i in order], k, list(range(len(order))))
    left_out = [(_vote(model, rows, cos), at) for at, (rows, cos) in enumerate(left_out) if len(rows)]
    if left_out:
        x, at = np.array([v for v, _ in left_out]), np.array([a for _, a in left_out])
        model.knots = isotonic(x, toxic[at].astype(float), prior[at])
    return model


def _frequencies(docs: DataFrame, terms: np.ndarray) -> np.ndarray:
    """For toxic 0 and 1 the number of rows (text, toxic) with each term, and at the end that of all rows."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((2, len(shared.value) + 1), np.int64)
        for batch in batches:
            y = batch["toxic"].to_numpy(np.int64)
            for i, (codes, _, _) in enumerate(_codes([t.lower() if isinstance(t, str) else "" for t in batch["text"].array], shared.value)):
                n[y[i], np.unique(codes)] += 1
            n[:, -1] += np.bincount(y, minlength=2)
        toxic, term = np.nonzero(n)
        yield pd.DataFrame({"toxic": toxic, "term": term, "n": n[toxic, term]})

    out = np.zeros((2, len(terms) + 1), np.int64)
    got = docs.mapInPandas(run, "toxic long, term long, n long").groupBy("toxic", "term").agg(F.sum("n").alias("n")).toArrow()
    out[got["toxic"].to_numpy(), got["term"].to_numpy()] = got["n"].to_numpy()
    shared.unpersist()
    release(docs.sparkSession)
    return out


SCORES = "doc_id long, nameless boolean, score double, neighbours array<long>, similarities array<double>, evidence array<string>"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Scores (doc_id, text): score (0 to 1), the nearest labelled examples, their cosines and, as evidence, the words that
    mark the class, or without any the three that weigh most.

    A null or empty text, or one without any word of the examples, has no neighbours and gets the share of toxic labels.
    Repeated rows get equal scores; rows without doc_id are scored too; an empty table gives no rows; other columns are not
    read.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            texts = [t.lower() if isinstance(t, str) else "" for t in batch["text"].array]
            rows, queries, words = [], [], []
            for codes, where, word in _codes(texts, m.terms):
                terms, weights, first = _vector(codes, m.gain) if len(codes) else (codes, np.zeros(0), codes)
                marking = np.flatnonzero(m.marking[terms])
                if not len(marking):
                    marking = np.argsort(-m.gain[terms])[:3]
                queries.append((terms, weights))
                words.append([word(i) for i in where[first[marking]]])
            for doc, nameless, evidence, (found, cos) in zip(batch["doc_id"].array, batch["nameless"].array, words, m.index.search_many(queries, m.k)):
                p = float(np.interp(_vote(m, found, cos), *m.knots)) if len(found) else m.base
                rows.append((doc, nameless, min(max(p, 0.0), 1.0), m.ids[found], cos, evidence))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCORES.split(", ")])

    return unnamed(named(docs).select("doc_id", "nameless", "text").mapInPandas(run, SCORES))


def held_out(parts: int, part: int):
    """True where crc32 of the id as text leaves the remainder `part`."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts)) == part


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, k: int = 15) -> DataFrame:
    """Learns from the labelled rows that are not held out and scores every document; see `fit` and `score`.

    Adds held_out (false without a doc_id) and predicted (1 from `threshold` on). Without any toxic label all scores are 0.
    """
    out = score(docs, fit(docs, labels, k))
    return out.select("doc_id", F.coalesce(held_out(4, 2), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "neighbours", "similarities", "evidence")
