"""Language identification by a linear-chain conditional random field.

Each word of a text gets a language label, so that code-switched text is labelled word by word. Emissions are sums of
weights of affix, character n-gram and lexicon (whole word) features, hashed into one table; transitions are learned with
them, from chains that join segments of documents of known languages. Forward-backward gives each word's marginals, and
the text's language is the one with most of its letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelink.llm.shared import LOWER, NO_LETTER, hashed_runs, mix, named, slabs, small_batches, unnamed
from tracelink.llm.toxicity import held_out

#: Bound of the sample that is fitted on: at most about so many documents of each language.
DOCUMENTS_PER_LANGUAGE = 400
DIMENSIONS = 1 << 16


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # (DIMENSIONS, labels)
    transitions: np.ndarray  # (labels, labels), log
    start: np.ndarray  # (labels,), log


class Words:
    """Words of several texts: their features once for each distinct word, and which word stands where."""

    def __init__(self, texts: list[str]):
        raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
        buf = LOWER[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
        starts, ends, hashes, self.bounds = hashed_runs(buf, NO_LETTER[buf], raw)
        self.lengths = ends - starts
        distinct, first, self.word = np.unique(hashes, return_index=True, return_inverse=True)
        self.n = len(distinct)
        self.owner, self.feature = word_features(buf, starts[first], ends[first], distinct)

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        """(distinct words, labels) sums of feature weights, scaled by the root of the number of features."""
        out = np.zeros((self.n, weights.shape[1]), weights.dtype)
        if self.n:
            first = np.flatnonzero(np.concatenate([[True], self.owner[1:] != self.owner[:-1]]))
            out[self.owner[first]] = np.add.reduceat(weights[self.feature], first, axis=0)
        return out


def word_features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, feature) pairs sorted by owner: prefixes and suffixes of 1 to 4 bytes, byte 2- and 3-grams with the word's
    edges, and the word itself (its lexicon entry)."""
    owners, features = [], []
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids, length = np.arange(n), ends - starts
    value = buf.astype(np.uint64) + np.uint64(1)
    put = lambda o, h, kind: (owners.append(o), features.append(mix(h * np.uint64(31) + np.uint64(kind))))
    put(ids, hashes, 1)
    head = np.zeros(n, np.uint64)
    tail = np.zeros(n, np.uint64)
    for k in range(4):
        long = np.flatnonzero(length > k)
        head[long] = head[long] * np.uint64(257) + value[starts[long] + k]
        tail[long] = tail[long] * np.uint64(257) + value[ends[long] - 1 - k]
        put(long, head[long], 2 + k)
        put(long, tail[long], 6 + k)
    # All bytes of all words, with a gap on both sides: position i of a word of length m runs over 0..m+1.
    wide = length + 2
    owner = np.repeat(ids, wide)
    at = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
    inner = (at > 0) & (at <= length[owner])
    byte = np.zeros(len(at), np.uint64)
    byte[inner] = value[starts[owner[inner]] + at[inner] - 1]
    two = np.flatnonzero(at[1:] > 0)
    put(owner[two], byte[two] * np.uint64(257) + byte[two + 1], 10)
    three = np.flatnonzero(at[2:] > 1)
    put(owner[three], (byte[three] * np.uint64(257) + byte[three + 1]) * np.uint64(257) + byte[three + 2], 11)
    owner, feature = np.concatenate(owners), np.concatenate(features)
    by = np.argsort(owner, kind="stable")
    return owner[by], (feature[by] & np.uint64(DIMENSIONS - 1)).astype(np.int64)


def forward_backward(emit: np.ndarray, bounds: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of all chains at once.

    emit: (words, labels) log emissions; chain i is the words bounds[i]:bounds[i + 1]. Returns the marginals, the summed
    expected transitions and the summed log-likelihood's normaliser. All chains step together, longest first.
    """
    lengths = np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    begin, lengths = bounds[:-1][order], lengths[order]
    top = emit.max(axis=1, keepdims=True) if len(emit) else emit
    e = np.exp(emit - top)
    a, first = np.exp(transitions), np.exp(start)
    alpha, beta, scale = np.empty_like(e), np.empty_like(e), np.ones(len(e))
    steps = int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(steps), side="left")  # chains longer than t
    state = None
    for t in range(steps):
        m = alive[t]
        rows = begin[:m] + t
        state = e[rows] * first if t == 0 else (state[:m] @ a) * e[rows]
        z = state.sum(axis=1)
        state /= z[:, None]
        alpha[rows], scale[rows] = state, z
    pair = np.zeros_like(a)
    state = np.zeros((0, e.shape[1]))
    for t in range(steps - 1, -1, -1):
        m = alive[t]
        rows = begin[:m] + t
        if len(state):
            following = rows[: len(state)] + 1
            message = e[following] * state / scale[following][:, None]
            pair += (alpha[rows[: len(state)]].T @ message) * a
            state = message @ a.T
        if m > len(state):
            state = np.concatenate([state, np.ones((m - len(state), e.shape[1]))])
        beta[rows] = state
    gamma = alpha * beta
    if len(gamma):
        gamma /= gamma.sum(axis=1, keepdims=True)
    return gamma, pair, float(np.log(scale).sum() + top.sum())


def train(texts: list[str], labels: np.ndarray, names: list[str], chains: int = 4000, words: int = 24, epochs: int = 40, seed: int = 11, decay: float = 1e-3) -> Crf:
    """Fits the field by Adam on the exact gradient (expected minus observed features).

    Chains join one to three segments of up to `words` words that start anywhere in documents, mostly of one language.
    """
    rng = np.random.default_rng(seed)
    k = len(names)
    seen = Words(texts)
    full = np.flatnonzero(np.diff(seen.bounds) > 0)
    parts, gold, bounds = [], [], [0]
    per = [full[labels[full] == y] for y in range(k)]
    per = [p for p in per if len(p)]
    for _ in range(chains if per else 0):
        size = 0
        for _ in range(rng.choice([1, 2, 3], p=[0.6, 0.25, 0.15])):
            doc = rng.choice(per[rng.integers(len(per))])
            n = seen.bounds[doc + 1] - seen.bounds[doc]
            take = min(n, rng.integers(2, words + 1))
            at = seen.bounds[doc] + rng.integers(0, n - take + 1)
            parts.append(seen.word[at : at + take])
            gold.append(np.full(take, labels[doc]))
            size += take
        bounds.append(bounds[-1] + size)
    model = Crf(names, np.zeros((DIMENSIONS, k)), np.zeros((k, k)), np.zeros(k))
    if not parts:
        return model
    word, gold, bounds = np.concatenate(parts), np.concatenate(gold), np.array(bounds)
    hot = np.eye(k)[gold]
    link = np.ones(len(word), bool)
    link[bounds[1:] - 1] = False
    at = np.flatnonzero(link)
    pairs = np.zeros((k, k))
    np.add.at(pairs, (gold[at], gold[at + 1]), 1)
    firsts = hot[bounds[:-1]].sum(axis=0)
    theta = [model.weights, model.transitions, model.start]
    first, second = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    for step in range(1, epochs + 1):
        gamma, expected, _ = forward_backward(seen.emissions(theta[0])[word], bounds, theta[1], theta[2])
        miss = gamma - hot
        by_word = np.stack([np.bincount(word, weights=miss[:, y], minlength=seen.n) for y in range(k)], axis=1)
        grads = [
            np.stack([np.bincount(seen.feature, weights=by_word[seen.owner, y], minlength=DIMENSIONS) for y in range(k)], axis=1) / len(word) + decay * 1e-3 * theta[0],
            (expected - pairs) / len(word) + decay * theta[1],
            (gamma[bounds[:-1]].sum(axis=0) - firsts) / len(bounds) + decay * theta[2],
        ]
        for x, g, m, v in zip(theta, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model.weights = theta[0].astype(np.float32)
    return model


def fit(labelled: DataFrame, per_language: int = DOCUMENTS_PER_LANGUAGE) -> Crf:
    """Fits on (doc_id, text, lang); of each language a bounded sample by hash of the id."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    there = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    names = sorted(there)
    if not names:
        return Crf(["und"], np.zeros((DIMENSIONS, 1)), np.zeros((1, 1)), np.zeros(1))
    share = F.create_map(*[F.lit(x) for n in names for x in (n, int(min(1.0, per_language / there[n]) * (1 << 30)))])
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share[F.col("lang")]).limit(2 * per_language * len(names)).toPandas().sort_values("doc_id", kind="stable")
    return train(list(sample["text"]), sample["lang"].map({n: i for i, n in enumerate(names)}).to_numpy(np.int64), names)


PREDICTIONS = "doc_id long, nameless boolean, lang_pred string, score double, n_words long, n_switches long, share map<string,double>"


def predict(docs: DataFrame, model: Crf) -> DataFrame:
    """Labels every word of (doc_id, text) and the text.

    lang_pred is the label with the largest share of the text's letters, weighted by the words' marginals; score is that
    share. n_switches counts the neighbouring words whose most likely labels differ. A null text, or one without a letter,
    is 'und' with score 0. Repeated rows get equal results, rows without doc_id are predicted too, an empty table gives no
    rows, other columns are not read.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        names = np.array(m.labels, object)
        for batch in gathered(batches):
            by = np.argsort(batch["text"].str.len().fillna(0).to_numpy(), kind="stable")  # chains of a slab are of a length
            batch = batch.iloc[by]
            texts = [t if isinstance(t, str) else "" for t in batch["text"].array]
            rows = []
            for a, b in slabs(texts):
                words = Words(texts[a:b])
                gamma, _, _ = forward_backward(words.emissions(m.weights).astype(np.float64)[words.word], words.bounds, m.transitions, m.start)
                best = gamma.argmax(axis=1) if len(gamma) else np.zeros(0, np.int64)
                cum = np.concatenate([np.zeros((1, len(names))), np.cumsum(gamma * words.lengths[:, None], axis=0)])
                mass = cum[words.bounds[1:]] - cum[words.bounds[:-1]]
                change = np.concatenate([[0], np.cumsum(np.concatenate([[0], best[1:] != best[:-1]]))]) if len(best) else np.zeros(1, np.int64)
                for i in range(b - a):
                    lo, hi = words.bounds[i], words.bounds[i + 1]
                    if hi == lo or not has_letter(texts[a + i]):
                        rows.append(("und", 0.0, 0, 0, {}))
                        continue
                    share = mass[i] / mass[i].sum()
                    y = int(share.argmax())
                    rows.append((names[y], float(min(share[y], 1.0)), int(hi - lo), int(change[hi] - change[lo + 1]), dict(zip(m.labels, share.tolist()))))
            out = pd.DataFrame(rows, columns=["lang_pred", "score", "n_words", "n_switches", "share"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            out.insert(1, "nameless", batch["nameless"].to_numpy())
            yield out

    return unnamed(named(docs.select("doc_id", "text")).select("doc_id", "nameless", "text").mapInPandas(run, PREDICTIONS))


def gathered(batches: Iterator[pd.DataFrame], most: int = 6_000_000) -> Iterator[pd.DataFrame]:
    """Joins batches up to `most` characters: the more texts to choose from, the more alike the chains that step together."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += int(batch["text"].str.len().sum())
        if size >= most:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def language(docs: DataFrame) -> DataFrame:
    """Learns from the rows of (doc_id, text, lang) that are not held out and predicts all rows; see `predict`.

    Rows without doc_id are not learned from, and not held out.
    """
    model = fit(docs.select("doc_id", "text", "lang").where(~held_out(5, 0)))
    return predict(docs, model).withColumn("held_out", F.coalesce(held_out(5, 0), F.lit(False)))
