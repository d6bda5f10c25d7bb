"""Language-model scores by masked pseudo-likelihood.

A small window network predicts every token from the tokens on both sides of it, never from itself; a document's score
is the sum of its tokens' conditional log-probabilities. A word's probability is that of its class, which the network
predicts, times that of the word within the class, by the counts of the whole corpus: each of the most frequent words is a
class of its own, the others share classes by their endings.

Words are counted over the whole corpus. The most frequent ones have a bound and go to every task; the counts of the others
are joined to the texts that hold them. Training is spread: each task trains replicas on positions of all of its documents,
replicas are averaged in a tree, and the average is the start of the next round, so the work and what is gathered grow with
the corpus while the model and each task stay bounded. Texts are read once for the counts and once to become a byte a word,
which all rounds and the scores read. The rounds deal the positions among them, so every position of the
corpus is trained on. Scores depend, slightly, on the partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelink.llm.shared import BYTE_VALUE, Tally, mix, named, scan_words, slabs, small_batches, staged, unnamed

WINDOW = 2  # tokens on either side
EMBEDDING, HIDDEN = 12, 32
FREQUENT, SHARED = 160, 96  # classes of frequent words, and of the others by ending
CLASSES = FREQUENT + SHARED
GROUPS = 8  # of classes, each of the same number
WIDTH = CLASSES // GROUPS
PAD = CLASSES  # beyond the text's edges
#: Words whose counts go to every task; the others' counts are joined.
LEXICON = 1 << 18
#: Replicas are averaged in groups, these many at each level of the tree.
LEVELS = (1 << 15, 1 << 10, 1 << 5)


@dataclass
class Network:
    """Embeddings of the window's tokens, a hidden layer, and a softmax over groups of classes and one over the classes of the
    group, so that a position is held against GROUPS + WIDTH outputs; parameters are one flat vector."""

    flat: np.ndarray

    def parts(self) -> list[np.ndarray]:
        out, at = [], 0
        for shape in self.shapes():
            n = int(np.prod(shape))
            out.append(self.flat[at : at + n].reshape(shape))
            at += n
        return out

    @staticmethod
    def shapes() -> list[tuple]:
        # The hidden layer has a unit that is 1, for the biases of the outputs.
        return [(CLASSES + 1, EMBEDDING), (2 * WINDOW * EMBEDDING, HIDDEN), (HIDDEN,), (HIDDEN + 1, GROUPS), (GROUPS, HIDDEN + 1, WIDTH)]

    @classmethod
    def fresh(cls, counts: np.ndarray, seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        parts = [rng.normal(0, 1 / np.sqrt(s[-2]) if len(s) > 1 else 0, s) for s in cls.shapes()]
        parts[0] = rng.normal(0, 0.3, parts[0].shape)
        of_class = counts.reshape(GROUPS, WIDTH) + 1.0
        of_group = of_class.sum(axis=1)
        parts[3][-1] = np.log(of_group / of_group.sum())
        parts[4][:, -1] = np.log(of_class / of_group[:, None])
        return cls(np.concatenate([p.ravel() for p in parts]).astype(np.float32))

    def forward(self, context: np.ndarray, group: np.ndarray, parts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """For positions in order of their targets' groups: inputs, hidden units, outputs for the groups and for the classes
        of the target's group, and where each group starts."""
        emb, w1, b1, over, within = parts
        x = emb.take(context.ravel(), axis=0).reshape(len(context), -1)
        h = np.ones((len(context), HIDDEN + 1), np.float32)
        a = x @ w1
        a += b1
        np.divide(a, 1 + np.abs(a), out=h[:, :-1])  # softsign, a fraction of the time of tanh
        z = np.empty((len(context), WIDTH), np.float32)
        cut = group.searchsorted(np.arange(GROUPS + 1)).tolist()
        for g, (lo, hi) in enumerate(zip(cut[:-1], cut[1:])):
            if hi > lo:
                np.matmul(h[lo:hi], within[g], out=z[lo:hi])
        return x, h, h @ over, z, cut

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        group = target // WIDTH
        by = np.argsort(group, kind="stable")
        group, inner, row = group[by], target[by] % WIDTH, np.arange(len(by))
        _, _, over, z, _ = self.forward(context[by], group, self.parts())
        out = np.empty(len(by), np.float32)
        out[by] = over[row, group] - _log_sum(over) + z[row, inner] - _log_sum(z)
        return out

    def train(self, context: np.ndarray, target: np.ndarray, rate: float = 1.0, batch: int = 256) -> None:
        """One pass of stochastic gradient descent over the positions, in place."""
        parts = self.parts()
        emb, w1, b1, over, within = parts
        place = np.arange(EMBEDDING)
        # Positions go in order of their groups within each batch; a batch stays what it was.
        by = np.argsort(target // WIDTH + np.arange(len(target)) // batch * GROUPS, kind="stable")
        context, target = context[by], target[by]
        group, inner, row = target // WIDTH, target % WIDTH, np.arange(batch)
        for at in range(0, len(target), batch):
            c, own = context[at : at + batch], group[at : at + batch]
            n = len(c)
            x, h, zg, z, cut = self.forward(c, own, parts)
            _softmax(zg)
            _softmax(z)
            zg[row[:n], own] -= 1
            z[row[:n], inner[at : at + batch]] -= 1
            step = np.float32(rate / n)
            dh = zg @ over.T
            for g, (lo, hi) in enumerate(zip(cut[:-1], cut[1:])):
                if hi > lo:
                    dh[lo:hi] += z[lo:hi] @ within[g].T
                    within[g] -= step * (h[lo:hi].T @ z[lo:hi])
            over -= step * (h.T @ zg)
            slope = 1 - np.abs(h[:, :-1])
            dh = dh[:, :-1] * slope * slope
            dx = dh @ w1.T
            w1 -= step * (x.T @ dh)
            b1 -= step * dh.sum(axis=0)
            cell = (c.reshape(-1, 1) * EMBEDDING + place).ravel()
            emb -= (step * np.bincount(cell, dx.ravel(), emb.size)).reshape(emb.shape).astype(np.float32)


def _softmax(z: np.ndarray) -> None:
    """In place, over each row."""
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)


def _log_sum(z: np.ndarray) -> np.ndarray:
    """The logarithm of the sum of the exponentials of each row."""
    top = z.max(axis=1)
    return top + np.log(np.exp(z - top[:, None]).sum(axis=1))


@dataclass
class Lexicon:
    """The most frequent words: hashes (sorted), counts, and the class of those that have one of their own (else -1)."""

    words: np.ndarray
    counts: np.ndarray
    own: np.ndarray
    totals: np.ndarray  # occurrences of each class

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of words and whether they are known."""
        at = np.minimum(np.searchsorted(self.words, hashes), max(len(self.words) - 1, 0))
        return at, (self.words[at] == hashes) if len(self.words) else np.zeros(len(hashes), bool)


def endings(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The shared class of each word, by its last two bytes."""
    if not len(ends):
        return np.zeros(0, np.int64)
    ending = mix(BYTE_VALUE[buf[ends - 1]] * np.uint64(3) + BYTE_VALUE[buf[np.maximum(ends - 2, starts)]])
    return FREQUENT + (ending % np.uint64(SHARED)).astype(np.int64)


def vocabulary(docs: DataFrame) -> tuple[DataFrame, Lexicon]:
    """The counts of all words of all documents (word, class, n), staged, and the lexicon."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally = Tally(2)

        def frame() -> pd.DataFrame:
            words, (n, shared) = tally.take()
            return pd.DataFrame({"word": words.view(np.int64), "class": (shared // np.maximum(n, 1)).astype(np.int16), "n": n})

        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"].array]
            for a, b in slabs(texts):
                buf, starts, ends, hashes, _ = scan_words(texts[a:b])
                words, first, n = np.unique(hashes, return_index=True, return_counts=True)
                if tally.add(words, n, n * endings(buf, starts[first], ends[first])):
                    yield frame()
        yield frame()

    counts = docs.select("text").mapInPandas(run, "word long, class short, n long").groupBy("word").agg(F.first("class").alias("class"), F.sum("n").alias("n"))
    counts = staged(counts, "word-counts")
    # The lexicon is cut where a class of like counts would exceed it, so that the driver gets no more than it holds.
    level = F.floor(F.log2("n") * 16).cast("int")
    sizes = counts.groupBy(level.alias("level")).count().toPandas().sort_values("level", ascending=False)
    fits = sizes["level"][sizes["count"].cumsum() <= LEXICON]
    own = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).toPandas()
    known = counts.where(level >= int(fits.min())).toPandas() if len(fits) else own
    top = pd.concat([own, known]).drop_duplicates("word").sort_values(["n", "word"], ascending=[False, True]).reset_index(drop=True)
    totals = np.zeros(CLASSES)
    for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect():
        totals[r["class"]] = r["n"]
    own = np.full(len(top), -1)
    own[:FREQUENT] = np.arange(min(FREQUENT, len(top)))
    n, shared = top["n"].to_numpy(np.int64), top["class"].to_numpy(np.int64)
    totals[own[:FREQUENT]] = n[:FREQUENT]
    np.subtract.at(totals, shared[:FREQUENT], n[:FREQUENT])
    words = top["word"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(words)
    return counts, Lexicon(words[by], n[by], own[by], totals)


def classes(texts: list[str], lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token classes of all words of texts, bounds, hashes, and the words' counts (0: not in the lexicon)."""
    buf, starts, ends, hashes, bounds = scan_words(texts)
    at, known = lexicon.find(hashes)
    own = np.where(known, lexicon.own[at], -1) if len(lexicon.own) else np.full(len(hashes), -1)
    n = np.where(known, lexicon.counts[at], 0) if len(lexicon.own) else np.zeros(len(hashes), np.int64)
    return np.where(own >= 0, own, endings(buf, starts, ends)), bounds, hashes, n


def contexts(tokens: np.ndarray, bounds: np.ndarray, where: np.ndarray) -> np.ndarray:
    """The classes around positions `where`; PAD beyond the text's first and last token."""
    # Each text between PADs of its own: a token's neighbours are those beside it.
    size = np.diff(bounds)
    shift = np.repeat(np.arange(1, len(size) + 1) * WINDOW, size)
    padded = np.full(len(tokens) + (len(size) + 1) * WINDOW, PAD, np.int64)
    padded[np.arange(len(tokens)) + shift] = tokens
    near = np.array([*range(-WINDOW, 0), *range(1, WINDOW + 1)])
    return padded[(where + shift[where])[:, None] + near]


def sampled_positions(bounds: np.ndarray, every: int, turn: int) -> np.ndarray:
    """Every `every`-th position of each text, one at least, from another start for each text and turn."""
    size = np.diff(bounds)
    text = np.flatnonzero(size)
    start = (text * 7 + turn * 5) % every % size[text]
    n = (size[text] - start + every - 1) // every
    of = np.repeat(np.arange(len(text)), n)
    return bounds[text][of] + start[of] + (np.arange(len(of)) - (np.cumsum(n) - n)[of]) * every


ROWS = "kind byte, row long, doc_id long, nameless boolean, tokens binary, shares double, word long, times long"


def tokenised(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Reads the texts once for all that follows; stages a table.

    Of kind 1 are the documents, with a byte for each word's class and the sum of the words' log-shares of their classes as far as the
    lexicon goes; of kind 0 the words of a document that it lacks, and how often they occur there.
    """
    small_batches(docs.sparkSession)
    words = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = words.value
        spread = np.log(np.maximum(known.totals, 1))
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"].array]
            total, coded = np.zeros(len(texts)), []
            rows = row + np.arange(len(texts))
            row += len(texts)
            for a, b in slabs(texts):
                tokens, bounds, hashes, seen = classes(texts[a:b], known)
                # Within the class: the word's count, which is joined later where the lexicon lacks it, over the class's.
                logs = np.where(tokens >= FREQUENT, np.log(np.maximum(seen, 1)) - spread[tokens], 0)
                cum = np.concatenate([[0], np.cumsum(logs)])
                total[a:b] = cum[bounds[1:]] - cum[bounds[:-1]]
                flat = tokens.astype(np.uint8).tobytes()
                coded += [flat[lo:hi] for lo, hi in zip(bounds[:-1], bounds[1:])]
                rest = np.flatnonzero(seen == 0)
                if len(rest):
                    text = np.searchsorted(bounds, rest, side="right") - 1
                    by = np.lexsort((hashes[rest], text))
                    text, word = text[by], hashes[rest][by]
                    first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (word[1:] != word[:-1])]))
                    yield pd.DataFrame({
                        "kind": np.int8(0), "row": rows[a + text[first]], "doc_id": 0, "nameless": False, "tokens": b"", "shares": 0.0,
                        "word": word[first].view(np.int64), "times": np.diff(np.append(first, len(text))),
                    })
            yield pd.DataFrame({
                "kind": np.int8(1), "row": rows, "doc_id": batch["doc_id"].to_numpy(), "nameless": batch["nameless"].to_numpy(), "tokens": coded, "shares": total, "word": 0, "times": 0,
            })

    return staged(named(docs).select("doc_id", "nameless", "text").mapInPandas(run, ROWS), "tokens")


def _tokens(coded: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs (start, stop) of documents, the classes of their words, and bounds."""
    for a, b in slabs(coded, 200_000):
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in coded[a:b]])]).astype(np.int64)
        yield a, b, np.frombuffer(b"".join(coded[a:b]), np.uint8).astype(np.int64), bounds


def trained(rows: DataFrame, lexicon: Lexicon, rounds: int = 2, replica_positions: int = 200_000) -> Network:
    """Trains on every position of each of the tokenised documents, one in `rounds` in each round.

    A replica averages in with the number of its positions; one task trains at most replica_positions at a time and
    starts another replica beyond. Runs jobs.
    """
    sc = rows.sparkSession.sparkContext
    net = Network.fresh(lexicon.totals)
    for turn in range(rounds):
        start = sc.broadcast(net.flat)

        def run(batches: Iterator[pd.DataFrame], turn=turn, start=start) -> Iterator[pd.DataFrame]:
            mine, seen = Network(start.value.copy()), 0
            task = TaskContext.get().partitionId()
            rng = np.random.default_rng(turn)
            mean, total = np.zeros(len(mine.flat)), 0
            for batch in batches:
                for _, _, tokens, bounds in _tokens(list(batch["tokens"].array)):
                    where = sampled_positions(bounds, rounds, turn)
                    if not len(where):
                        continue
                    where = rng.permutation(where)
                    mine.train(contexts(tokens, bounds, where), tokens[where], rate=1.0 / (1 + turn))
                    seen += len(where)
                    if seen >= replica_positions:
                        mean, total = mean + mine.flat * float(seen), total + seen
                        mine, seen = Network(start.value.copy()), 0
            mean, total = mean + mine.flat * float(seen), total + seen
            if total:
                yield pd.DataFrame({"part": [task], "n": [float(total)], "flat": [mean / total]})

        def average(rows: pd.DataFrame) -> pd.DataFrame:
            total = rows["n"].sum()
            return pd.DataFrame({"part": [rows["part"].iloc[0]], "n": [total], "flat": [sum(np.asarray(f) * (n / total) for f, n in zip(rows["flat"], rows["n"]))]})

        schema = "part int, n double, flat array<double>"
        parts = rows.where("kind = 1").select("tokens").mapInPandas(run, schema)
        for width in LEVELS:
            parts = parts.withColumn("part", F.col("part") % width).groupBy("part").applyInPandas(average, schema)
        parts = parts.toPandas()
        if len(parts):
            net = Network(average(parts)["flat"].iloc[0].astype(np.float32))
    return net


def fit(docs: DataFrame) -> tuple[Network, Lexicon, DataFrame]:
    """The network, trained on every position of each document, the lexicon and the counts of all words. Runs jobs."""
    small_batches(docs.sparkSession)
    counts, lexicon = vocabulary(docs)
    return trained(tokenised(docs, lexicon), lexicon), lexicon, counts


def score(docs: DataFrame, net: Network, lexicon: Lexicon, counts: DataFrame) -> DataFrame:
    """Sums the conditional log-probabilities of all tokens of (doc_id, text), each given both sides.

    A null text, or one without words, has 0 tokens, log_likelihood 0 and a null per_token; a word that the counts lack
    counts as half an occurrence. Repeated rows score alike; rows without doc_id are scored too; an empty table gives no
    rows; other columns are not read. Stages a table.
    """
    return _scored(tokenised(docs, lexicon), net, counts)


def _scored(every: DataFrame, net: Network, counts: DataFrame) -> DataFrame:
    """The same for documents that are tokenised."""
    shared = every.sparkSession.sparkContext.broadcast(net.flat)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Network(shared.value)
        for batch in batches:
            coded, total = list(batch["tokens"].array), batch["shares"].to_numpy().copy()
            for a, b, tokens, bounds in _tokens(coded):
                logs, around = np.empty(len(tokens)), contexts(tokens, bounds, np.arange(len(tokens)))
                for at in range(0, len(tokens), 1024):
                    logs[at : at + 1024] = model.log_probabilities(around[at : at + 1024], tokens[at : at + 1024])
                cum = np.concatenate([[0], np.cumsum(logs)])
                total[a:b] += cum[bounds[1:]] - cum[bounds[:-1]]
            yield pd.DataFrame({"row": batch["row"], "doc_id": batch["doc_id"], "nameless": batch["nameless"], "n_tokens": [len(t) for t in coded], "log_likelihood": total})

    known = every.where("kind = 1").select("row", "doc_id", "nameless", "tokens", "shares").mapInPandas(run, "row long, doc_id long, nameless boolean, n_tokens long, log_likelihood double")
    rest = every.where("kind = 0").select("row", "word", "times").join(counts.select("word", "n"), "word", "left")
    rest = rest.groupBy("row").agg(F.sum(F.col("times") * F.log(F.coalesce("n", F.lit(0.5)))).alias("rest"))
    out = known.join(rest, "row", "left").withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("rest", F.lit(0.0)))
    out = unnamed(out.select("doc_id", "nameless", "n_tokens", "log_likelihood"))
    return out.withColumn("per_token", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """Fits on all documents and scores them; see `fit` and `score`. The texts are read twice, for counts and for classes."""
    small_batches(docs.sparkSession)
    counts, lexicon = vocabulary(docs)
    rows = tokenised(docs, lexicon)
    return _scored(rows, trained(rows, lexicon), counts)
