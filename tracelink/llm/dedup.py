"""Removal of long repeated substrings with suffix arrays.

Every byte that a string of `length` bytes covers which also starts elsewhere is removed. A suffix array of the whole
corpus fits no machine, so the text is cut up by content first, without losing a match:

- The anchor of a string is the least hash of its first `window` k-grams. Equal strings have their anchors at the same
  place, so strings need only be compared if their anchors' cores (the bytes from the anchor that every string of the
  anchor holds) are equal. All strings of an anchor lie in its context: some bytes on the left, the core, some on the right.
- Anchors meet by the hash of their core. Most are alone and go.
- The different contexts of the other cores become short texts of block symbols, left blocks, core, right blocks, a
  context that occurs more than once as two texts, and one suffix array over the texts of many cores (see `grouping`)
  brings the runs of symbols that occur twice together. The strings inside such a run are told apart by 64-bit hashes.
  What is found for a context goes for all anchors that have it.

Two cases do not need the order: a context that one text holds several times (periodic texts) is a repeat as it is read,
and a core with more than HOT different contexts is dealt out by the hashes of its runs of blocks and then by those of its
strings, as no task may hold it whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelink.llm.grouping import suffix_array
from tracelink.llm.shared import BYTE_VALUE, identified, mix, named, powers, release, remove, slabs, small_batches, staged, stored, unnamed

#: A core with more different contexts is dealt out string by string; tasks hold whole cores below that.
HOT = 1024
BLOCKS = 4
#: Bounds of what a Python worker holds at once: contexts and strings that are compared, and bytes of what it gives out.
CONTEXTS_AT_ONCE, STRINGS_AT_ONCE, BYTES_AT_ONCE = 3_000, 200_000, 4_000_000
_INVERSE = pow(int(powers(2)[1]), -1, 2**64)
_inverses = np.ones(1, np.uint64)


def inverses(n: int) -> np.ndarray:
    global _inverses
    while len(_inverses) < n:
        step = np.uint64(pow(_INVERSE, len(_inverses), 2**64))
        _inverses = np.concatenate([_inverses, _inverses * step])
    return _inverses[:n]


class Prefix:
    """Hashes of substrings from prefix sums."""

    def __init__(self, buf: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_VALUE[buf] * powers(len(buf)), dtype=np.uint64)])
        self.back = inverses(len(buf) + 1)

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.back[start] + (stop - start).astype(np.uint64))


class Shape:
    def __init__(self, length: int = 400, window: int = 192, gram: int = 16):
        if length < window + gram - 1 or window % (BLOCKS * STEPS[0]):
            raise ValueError("a string must hold its window, and blocks must fill it")
        self.length, self.window, self.gram = length, window, gram
        self.core, self.block = length - window + 1, window // BLOCKS


def raw_bytes(text) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def anchors(raw: list[bytes], shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor, least, most, core hash, context hash) of all anchors of the texts.

    The strings that start `least` to `most` bytes before the anchor are those that the anchor stands for.
    """
    buf = np.frombuffer(b"".join(raw), np.uint8)
    none = np.zeros(0, np.int64)
    if len(buf) < shape.length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    ends = np.cumsum([len(r) for r in raw])
    # Any order of k-grams will do, as long as it is a function of the bytes: two words of 8 bytes, mixed.
    eight = np.lib.stride_tricks.as_strided(np.frombuffer(buf.tobytes() + bytes(16), np.uint8), (len(buf) + 9, 8), (1, 1)).copy().view("<u8").ravel()
    h = eight[: len(buf) - shape.gram + 1] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += eight[shape.gram - 8 : len(buf) - 8 + 1]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    # The upper half is the hash, the lower half the place, so the least is the leftmost of the least hashes.
    h = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while width * 2 <= shape.window:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    if width < shape.window:
        h = np.minimum(h[: len(h) - (shape.window - width)], h[shape.window - width :])
    least_at = (h & np.uint64(0xFFFFFFFF)).astype(np.int64)[: len(buf) - shape.length + 1]
    starts = ends - np.array([len(r) for r in raw])
    valid = np.zeros(len(least_at) + 1, np.int64)  # starts of strings that stay inside their text
    fit = ends - starts >= shape.length
    np.add.at(valid, starts[fit], 1)
    np.add.at(valid, ends[fit] - shape.length + 1, -1)
    s = np.flatnonzero(np.cumsum(valid)[:-1] > 0)
    if not len(s):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    at = least_at[s]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (s[1:] != s[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s)) - 1
    a, lo, hi = at[first], at[first] - s[last], at[first] - s[first]
    doc = np.searchsorted(ends, a, side="right")
    prefix = Prefix(buf)
    core = prefix(a, a + shape.core)
    context = mix(prefix(a - hi, a - lo + shape.length) + hi.astype(np.uint64))
    return doc, a - starts[doc], lo, hi, core, context


ANCHORS = "core long, context long, u long, v int, at long, least int, most int, kind byte"
#: Kinds of rows: an anchor, the first of several of one text that have one context, and a span that such ones cover.
ALONE, SEVERAL, SPAN = 0, 1, 2


def _anchor_rows(docs: DataFrame, shape: Shape) -> DataFrame:
    """Anchors of all texts. A text of few patterns has very many anchors of one context; they come as one row, and their
    strings, which are repeats anyway, as merged spans (at, and the size in most)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            u, v, texts = batch["u"].to_numpy(), batch["v"].to_numpy(), batch["text"].array
            for a, b in slabs(texts):
                doc, at, lo, hi, core, context = anchors([raw_bytes(t) for t in texts[a:b]], shape)
                by = np.lexsort((at, context, core, doc))
                doc, at, lo, hi, core, context = (x[by] for x in (doc, at, lo, hi, core, context))
                new = np.ones(len(by), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (core[1:] != core[:-1]) | (context[1:] != context[:-1])
                first = np.flatnonzero(new)
                several = np.diff(np.append(first, len(by))) > 1
                within = np.repeat(several, np.diff(np.append(first, len(by))))
                owner, start, stop, lead = merged(doc[within], at[within] - hi[within], at[within] - lo[within] + shape.length)
                kind = np.concatenate([np.where(several, SEVERAL, ALONE), np.full(len(owner), SPAN)])
                both = lambda x, y: np.concatenate([x[first], y])
                place = both(doc, owner)
                yield pd.DataFrame(
                    {
                        "core": both(core, core[within][lead]).view(np.int64), "context": both(context, np.zeros(len(owner), np.uint64)).view(np.int64), "u": u[a:b][place], "v": v[a:b][place],
                        "at": both(at, start), "least": both(lo, np.zeros(len(owner), np.int64)).astype(np.int32), "most": both(hi, stop - start).astype(np.int32), "kind": kind.astype(np.int8),
                    }
                )

    return docs.where(F.octet_length("text") >= shape.length).select("text", "u", "v").mapInPandas(run, ANCHORS)


def merged(owner: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The maximal runs that intervals cover, per owner, and the place of each run's first interval."""
    by = np.lexsort((start, owner))
    owner, start, stop = owner[by], start[by], stop[by]
    if not len(by):
        return owner, start, stop, by
    # Furthest stop so far within the owner: owners are kept apart by a shift beyond all places.
    shift = (np.cumsum(np.concatenate([[0], owner[1:] != owner[:-1]]))) * (int(stop.max()) + 1)
    far = np.maximum.accumulate(stop + shift) - shift
    new = np.ones(len(by), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (start[1:] > far[:-1])
    first = np.flatnonzero(new)
    return owner[first], start[first], far[np.append(first[1:], len(by)) - 1], by[first]


def _grouped(docs: DataFrame, shape: Shape) -> tuple[DataFrame, DataFrame]:
    """Anchors (and spans) whose core occurs twice, and their different contexts with one place of each.

    Cores are counted first, with partial sums, so that only the repeated ones are brought together with their anchors;
    all steps after that are counts or joins, which Spark sums or splits where one core or context is frequent.
    """
    twice = F.when(F.col("kind") == SEVERAL, 2).otherwise(1)
    every, path = stored(_anchor_rows(docs, shape), "all-anchors")
    cores = every.where(F.col("kind") != SPAN).groupBy("core").agg(F.sum(twice).alias("n")).where("n > 1").select("core")
    rows = staged(every.join(cores, "core", "left_semi"), "anchors")
    remove(docs.sparkSession, path)
    release(docs.sparkSession)
    one = [F.first(c).alias(c) for c in ("u", "v", "at", "least", "most")]
    contexts = staged(rows.where(F.col("kind") != SPAN).groupBy("core", "context").agg(F.sum(twice).alias("n"), *one), "contexts")
    hot = staged(contexts.groupBy("core").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("core", F.lit(True).alias("hot")), "hot-cores")
    contexts = contexts.join(hot, "core", "left").withColumns({"hot": F.coalesce("hot", F.lit(False)), "times": F.least("n", F.lit(2)).cast("int")})
    return rows, contexts


MEMBERS = "core long, context long, least int, most int, times int, left binary, right binary"
RUNS = "key long, core long, context long, least int, most int, times int, left binary, right binary"
#: Runs of hot cores are taken apart in these steps, from blocks to single strings.
STEPS = (8, 1)


def _members(contexts: DataFrame, docs: DataFrame, shape: Shape, hot: bool) -> DataFrame:
    """One row for each context, with its bytes beside the core; hot: one for each of its runs of blocks (those left of the
    anchor, the core, those on the right), with the run's hash, its strings (least to most) and the bytes beside it.

    Rows of equal id and text come one after another, and only the first is cut up. If they are in several tasks, each
    cuts one; their contexts count as repeats in any case.
    """
    names = ["core", "context", "at", "least", "most", "times"]
    wanted = contexts.groupBy("u", "v").agg(F.collect_list(F.struct(*names)).alias("rows"))
    # doc_id goes along so that this join and the last one share a shuffle of the texts.
    joined = docs.join(wanted, ["u", "v"]).sortWithinPartitions("u", "v").select("doc_id", "text", "u", "v", *[F.col(f"rows.{c}").alias(c) for c in names])
    columns = [c.split()[0] for c in (RUNS if hot else MEMBERS).split(", ")]
    block = shape.block

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size, last = [], 0, None
        for batch in batches:
            for u, v, text, *lists in zip(*(batch[c].array for c in ("u", "v", "text", *names))):
                if last == (u, v):
                    continue
                last = u, v
                raw = raw_bytes(text)
                prefix = Prefix(np.frombuffer(raw, np.uint8)) if hot else None
                for core, context, at, lo, hi, times in zip(*lists):
                    if not hot:
                        left, right = raw[at - hi : at], raw[at + shape.core : at - lo + shape.length]
                        out.append((core, context, lo, hi, times, left, right))
                        size += 400 + len(left) + len(right)
                        continue
                    for q in range(lo // block, hi // block + 1):
                        begin, end = at - q * block, at + shape.core + (BLOCKS - 1 - q) * block
                        least, most = max(lo, q * block), min(hi, q * block + block - 1)
                        key = mix(prefix(np.array([begin]), np.array([end])) + np.uint64(q))
                        left, right = raw[at - most : begin], raw[end : at - least + shape.length]
                        out.append((key.view(np.int64)[0], core, context, least, most, times, left, right))
                        size += 400 + len(left) + len(right)
                if size > BYTES_AT_ONCE:
                    yield pd.DataFrame(out, columns=columns)
                    out, size = [], 0
        if out:
            yield pd.DataFrame(out, columns=columns)

    return joined.mapInPandas(run, RUNS if hot else MEMBERS)


def _refined(runs: DataFrame, width: int, finer: int) -> DataFrame:
    """Runs of blocks of `width` bytes as runs of blocks of `finer` bytes.

    What all strings of a run have in common grows by the bytes beside it that all those of the finer run have.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            least, most = batch["least"].to_numpy(np.int64), batch["most"].to_numpy(np.int64)
            lefts, rights = [x[::-1] for x in batch["left"]], list(batch["right"])  # both outwards
            size = lambda xs: np.array([len(x) for x in xs], np.int64)
            left_at, right_at = np.cumsum(size(lefts)) - size(lefts), np.cumsum(size(rights)) - size(rights)
            n = most // finer - least // finer + 1
            of = np.repeat(np.arange(len(batch)), n)
            start = (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + least[of] // finer) * finer
            inner = start - least[of] // width * width  # bytes of the left side that become common, and of the right one
            outer = width - inner - finer
            grown = Prefix(np.frombuffer(b"".join(lefts), np.uint8))(left_at[of], left_at[of] + inner) * np.uint64(0x9E3779B97F4A7C15)
            grown += Prefix(np.frombuffer(b"".join(rights), np.uint8))(right_at[of], right_at[of] + outer)
            key = mix(grown + mix(batch["key"].to_numpy().view(np.uint64)[of] + inner.astype(np.uint64)))
            low, high = np.maximum(start, least[of]), np.minimum(start + finer - 1, most[of])
            yield pd.DataFrame({
                "key": key.view(np.int64), **{c: batch[c].to_numpy()[of] for c in ("core", "context")}, "least": low.astype(np.int32), "most": high.astype(np.int32), "times": batch["times"].to_numpy()[of],
                "left": [lefts[i][a : a + k][::-1] for i, a, k in zip(of, inner, high - start)], "right": [rights[i][a : a + k] for i, a, k in zip(of, outer, start + finer - 1 - low)],
            })

    return runs.mapInPandas(run, RUNS)


def repeated(members: pd.DataFrame, shape: Shape) -> pd.DataFrame:
    """(core, context, low, high): the strings, by bytes before the anchor, that occur twice among the members of a core.

    members: whole groups of equal core, each context once; one with times 2 stands for two members.
    """
    block, window = shape.block, shape.window
    source = np.repeat(np.arange(len(members)), members["times"].to_numpy())
    n = len(source)
    core = members["core"].to_numpy()[source]
    least, most = members["least"].to_numpy(np.int64)[source], members["most"].to_numpy(np.int64)[source]
    lefts, rights = members["left"].to_numpy(), members["right"].to_numpy()
    left = np.frombuffer(b"".join([lefts[i][::-1] for i in source]), np.uint8)  # from the anchor outwards
    right = np.frombuffer(b"".join([rights[i] for i in source]), np.uint8)
    left_size, right_size = most, window - 1 - least
    left_at, right_at = np.cumsum(left_size) - left_size, np.cumsum(right_size) - right_size
    hash_left, hash_right = Prefix(left), Prefix(right)
    lefts, rights = left_size // block, right_size // block
    # Symbols: left blocks from far to near, the core, right blocks, a separator that no string crosses.
    width = lefts + rights + 2
    begin = np.cumsum(width) - width
    text = np.zeros(int(width.sum()), np.uint64)
    owner = np.repeat(np.arange(n), lefts)
    q = np.arange(len(owner)) - np.repeat(np.cumsum(lefts) - lefts, lefts)
    text[begin[owner] + lefts[owner] - 1 - q] = hash_left(left_at[owner] + q * block, left_at[owner] + (q + 1) * block)
    text[begin + lefts] = mix(core.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
    owner = np.repeat(np.arange(n), rights)
    q = np.arange(len(owner)) - np.repeat(np.cumsum(rights) - rights, rights)
    text[begin[owner] + lefts[owner] + 1 + q] = hash_right(right_at[owner] + q * block, right_at[owner] + (q + 1) * block)
    text[begin + width - 1] = 0
    _, symbols = np.unique(text, return_inverse=True)
    order = suffix_array(symbols)
    # A string with q whole blocks on the left of the anchor has BLOCKS - 1 - q on its right: BLOCKS symbols with the core.
    first_q, last_q = least // block, most // block
    owner = np.repeat(np.arange(n), last_q - first_q + 1)
    q = np.arange(len(owner)) - np.repeat(np.cumsum(last_q - first_q + 1) - (last_q - first_q + 1), last_q - first_q + 1) + first_q[owner]
    start = begin[owner] + lefts[owner] - q
    padded = np.concatenate([symbols, np.zeros(BLOCKS, symbols.dtype)])
    same = np.ones(len(order) - 1, bool)
    for k in range(BLOCKS):
        same &= padded[order[1:] + k] == padded[order[:-1] + k]
    run = np.empty(len(order), np.int64)
    run[order] = np.cumsum(np.concatenate([[0], ~same]))
    run = run[start]
    often = np.flatnonzero(np.bincount(run, minlength=1)[run] > 1)
    often = often[np.argsort(run[often], kind="stable")]
    owner, q, run = owner[often], q[often], run[often]
    # The strings of a run: what is left of them beyond the common blocks, by hash; whole runs at a time.
    ends = np.append(np.flatnonzero(run[1:] != run[:-1]) + 1, len(run)) if len(run) else np.zeros(0, np.int64)
    found, a = [], 0
    while a < len(run):
        b = ends[max(np.searchsorted(ends, a + STRINGS_AT_ONCE // block, side="right") - 1, np.searchsorted(ends, a, side="right"))]
        own, of = np.repeat(owner[a:b], block), np.repeat(run[a:b], block)
        back = np.repeat(q[a:b] * block, block) + np.tile(np.arange(block), b - a)
        ok = (back >= least[own]) & (back <= most[own])
        own, of, back = own[ok], of[ok], back[ok]
        key = hash_left(left_at[own], left_at[own] + back) * np.uint64(0x9E3779B97F4A7C15) + hash_right(right_at[own], right_at[own] + window - 1 - back)
        _, code, count = np.unique(mix(key + mix(of.astype(np.uint64))), return_inverse=True, return_counts=True)
        hit = count[code] > 1
        found.append((source[own[hit]].astype(np.int32), back[hit].astype(np.int16)))
        a = b
    if not found:
        found = [(np.zeros(0, np.int32), np.zeros(0, np.int16))]
    return _ranges(*(np.concatenate(x) for x in zip(*found)), members["core"].to_numpy(), members["context"].to_numpy())


def _ranges(owner: np.ndarray, back: np.ndarray, core: np.ndarray, context: np.ndarray) -> pd.DataFrame:
    """Maximal runs low to high of the backs of each owner."""
    by = np.lexsort((back, owner))
    owner, back = owner[by], back[by]
    new, end = np.ones(len(by), bool), np.ones(len(by), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (back[1:] > back[:-1] + 1)
    end[:-1] = new[1:]
    return pd.DataFrame({"core": core[owner[new]], "context": context[owner[new]], "low": back[new].astype(np.int32), "high": back[end].astype(np.int32)})


FOUND = "core long, context long, low int, high int"


def _compared(members: DataFrame, shape: Shape) -> DataFrame:
    """repeated() over all cores; a task takes some groups at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= CONTEXTS_AT_ONCE:
                rows = pd.concat(held, ignore_index=True)
                cut = int(np.searchsorted(rows["core"].to_numpy(), rows["core"].iloc[-1]))
                if cut:
                    yield repeated(rows.iloc[:cut].reset_index(drop=True), shape)
                held, size = [rows.iloc[cut:]], len(rows) - cut
        rows = pd.concat(held, ignore_index=True) if held else pd.DataFrame()
        if len(rows):
            yield repeated(rows, shape)

    rows = members.repartition("core").sortWithinPartitions("core")
    return rows.mapInPandas(run, FOUND)


def _counted(runs: DataFrame, shape: Shape) -> DataFrame:
    """The same for hot cores: from blocks to single strings, runs that are equal with all their strings are repeats, and
    one of each goes on, to be taken apart, where another run has the same key."""
    found, width = None, shape.block
    for finer in (*STEPS, 0):
        runs = staged(runs, "runs").withColumn("same", F.xxhash64("key", "least", "most", "left", "right"))
        one = [F.first(c).alias(c) for c in ("key", "core", "context", "least", "most", "left", "right")]
        groups = staged(runs.groupBy("same").agg(F.sum("times").alias("n"), *one), "run-groups")
        whole = runs.join(groups.where("n > 1").select("same"), "same", "left_semi").select("core", "context", F.col("least").alias("low"), F.col("most").alias("high"))
        found = whole if found is None else found.unionByName(whole)
        if finer:
            groups = groups.withColumn("times", F.least("n", F.lit(2)).cast("int"))
            again = groups.groupBy("key").agg(F.sum("times").alias("n")).where("n > 1").select("key")
            runs = _refined(groups.join(again, "key", "left_semi").select(*[c.split()[0] for c in RUNS.split(", ")]), width, finer)
            width = finer
    return found


def _spans(docs: DataFrame, shape: Shape) -> DataFrame:
    """(u, v, starts, stops) of what is to be removed; spans may overlap."""
    rows, contexts = _grouped(docs, shape)
    found = _compared(_members(contexts.where(~F.col("hot")), docs, shape, False), shape)
    if not contexts.where("hot").isEmpty():
        found = found.unionByName(_counted(_members(contexts.where("hot"), docs, shape, True), shape))
    of_context = rows.where(F.col("kind") != SPAN).join(found, ["core", "context"])
    of_context = of_context.select("u", "v", (F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + shape.length).alias("stop"))
    spans = of_context.unionByName(rows.where(F.col("kind") == SPAN).select("u", "v", F.col("at").alias("start"), (F.col("at") + F.col("most")).alias("stop")))
    # Rows of equal id and text have the same spans; once each is enough for all of them.
    spans = spans.distinct().groupBy("u", "v").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return spans.select("u", "v", F.col("spans.start").alias("starts"), F.col("spans.stop").alias("stops"))


RESULT = "doc_id long, nameless boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>, kept string"


def remove_repeats(docs: DataFrame, length: int = 400, keep_text: bool = True) -> DataFrame:
    """Removes from every text (doc_id, text) the bytes covered by strings of `length` bytes that start anywhere else too.

    Texts count as UTF-8 bytes, a null text as empty; strings lie within one text and are judged on the input. The places
    may overlap and may be in one text. Every row is a document of its own, rows without doc_id too: repeated rows are
    repeats of each other, so from `length` bytes on nothing of them stays. An empty table gives no rows; other columns are
    not read. Tables are staged in the shared folder, and jobs run, while the plan is made.
    Returns n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of the remaining bytes, spans and, on request,
    kept, the remaining text (halves of characters at a cut are dropped).
    """
    small_batches(docs.sparkSession)
    docs = identified(docs.select("doc_id", "text")).withColumn("v", F.col("v").bitwiseAND(0x7FFFFFFF).cast("int"))
    spans = _spans(docs, Shape(length))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RESULT.split(", ")]
        for batch in batches:
            out, held = [], 0
            for doc, nameless, text, starts, stops in zip(*(batch[c].array for c in ("doc_id", "nameless", "text", "starts", "stops"))):
                raw, parts, at, runs = raw_bytes(text), [], 0, ()
                if starts is not None:
                    starts, stops = np.asarray(starts, np.int64), np.asarray(stops, np.int64)
                    _, starts, stops, _ = merged(np.zeros(len(starts), np.int64), starts, stops)
                    runs = list(zip(starts.tolist(), stops.tolist()))
                for s, e in runs:
                    parts.append(raw[at:s])
                    at = e
                kept = b"".join([*parts, raw[at:]])
                out.append((doc, nameless, len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), [{"start": s, "stop": e} for s, e in runs], kept.decode("utf-8", "ignore") if keep_text else None))
                held += len(raw) if keep_text else 200
                if held > BYTES_AT_ONCE:
                    yield pd.DataFrame(out, columns=names)
                    out, held = [], 0
            yield pd.DataFrame(out, columns=names)

    joined = named(docs.join(spans, ["u", "v"], "left").select("doc_id", "text", "starts", "stops"))
    return unnamed(joined.mapInPandas(run, RESULT))
