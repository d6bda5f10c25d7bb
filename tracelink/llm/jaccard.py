"""N-gram Jaccard join with token-combination prefixes.

Documents are sets of word shingles; two link when their Jaccard similarity reaches a threshold. All sets share one
order of tokens: rare ones first, frequent ones last, each class by hash. Of a set with n tokens, a linked set can miss
at most (1 - threshold) n, so a prefix of one token more must share a token. Tokens of the rare class are indexed alone. Where
the rare tokens do not fill the prefix, it is extended into the frequent class, whose tokens are indexed in pairs of
neighbours: a missing token breaks at most two pairs and an added one a single pair, which gives the length of the
extension (see `signatures`). So a signature shared by very many dissimilar documents does not occur unless nearly all
of a document is common text.

The tokens of all sets are counted, in buckets by the upper bits of their hash; a bucket of FREQUENT tokens or more is of
the frequent class. So the class is a bitmap of fixed size, and a token of the rare class is in fewer than FREQUENT sets at
any size of the corpus; the larger that is, the more tokens share buckets and are indexed in pairs.

Candidates are verified exactly, on the texts. Copies collapse to one set first. The sets of a small signature group are
compared pair by pair. Larger groups, and what they hold together, are never expanded: all sets of a group are held
against one of them first, and where that leaves a cluster in parts, tasks count the overlaps of whole blocks of sets
with an inverted index, all but those of the largest part with itself, and give out no more links than connect it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelink.llm.shared import identified, mix, named, ngram_hashes, release, remove, scan_words, slabs, small_batches, staged, stored, unnamed

#: Tokens are counted in 2^BITS buckets; a bucket with so many is frequent.
BITS, FREQUENT = 27, 8
#: Counts are dealt to tasks by so many ranges of buckets; a task gives out so many tokens at a time.
RANGES, TOKENS_AT_ONCE = 1024, 500_000
#: Characters of texts that are hashed at once; arrays take some 80 bytes for each.
TEXT_AT_ONCE = 250_000
#: Sets up to this size also index single frequent tokens, as an extension needs some room.
SMALL = 12
BLOOM_BITS = 1 << 25
#: The driver gets these bits as so many rows of bytes.
BLOOM_RANGES = 256
#: Groups of a signature with more sets are compared inside of tasks, so many sets against as many at a time.
GROUP, BLOCK, SHINGLES = 8, 1024, 400_000
#: Staged tables of more rows are never broadcast while components are found.
FEW = 100_000


def apart(rows: DataFrame) -> DataFrame:
    """Joined by a merge. Spark sizes a staged table by its file, which a broadcast exceeds tenfold on the driver, and what is exploded by its source."""
    return rows.hint("merge")


def shingle_sets(texts: list[str], n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its n-word shingles; a shorter text is one shingle."""
    for a, b in slabs(texts, TEXT_AT_ONCE):
        _, _, _, hashes, bounds = scan_words(texts[a:b])
        grams = ngram_hashes(hashes, n)
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if hi - lo >= n:
                yield np.unique(grams[lo : hi - n + 1])
            elif hi > lo:
                yield mix(ngram_hashes(hashes[lo:hi], int(hi - lo)) + np.uint64(hi - lo))
            else:
                yield np.zeros(0, np.uint64)


def set_id(tokens: np.ndarray) -> int:
    """A 64-bit hash of the set; with the set's size it stands for the set."""
    return int((mix(tokens).sum(dtype=np.uint64) ^ mix(np.uint64([len(tokens)]))[0]).astype(np.int64))


def _spare(n: np.ndarray | int, percent: int):
    """Tokens that a set of n may lack in a linked one."""
    return n - (percent * n + 99) // 100


def bucket(tokens: np.ndarray) -> np.ndarray:
    """What tokens are counted by."""
    return (tokens >> np.uint64(64 - BITS)).astype(np.uint32)


def signatures(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a sorted token set, and the place in the order of the token each stands for; frequent: the bitmap.

    Places are -1 for pairs, and for all signatures of a set whose rare tokens do not fill the prefix.

    With s = floor((1 - t) n) and c rare tokens in the prefix: if c = s + 1 one of them is shared. Else, of D missing and I
    added tokens, D + t I <= (1 - t) n; c missing ones break the rare tokens, the rest at most 2 ((1 - t) n - c) pairs (added
    ones break fewer for their share), so one pair more makes sure that one is shared.
    """
    n = len(tokens)
    need = _spare(n, percent) + 1
    mine = bucket(tokens)
    common = (frequent[mine >> 3] >> (mine & 7) & 1).astype(bool)
    rare = tokens[~common][:need]
    sigs, places = [rare], [np.arange(len(rare))]
    if len(rare) < need:
        places = [np.full(len(rare), -1)]
        often = tokens[common]
        if n <= SMALL:
            more = often[: need - len(rare)]
            sigs.append(more)
            places.append(np.full(len(more), -1))
        length = 2 * (100 - percent) * n // 100 - 2 * len(rare) + 2
        often = often[: max(length, 0)]
        sigs.append(mix(often[:-1] * np.uint64(0x9E3779B97F4A7C15) + mix(often[1:])))
        places.append(np.full(max(len(often) - 1, 0), -1))
    return np.concatenate(sigs), np.concatenate(places)


def _texts(batch: pd.DataFrame) -> list[str]:
    return [t if isinstance(t, str) else "" for t in batch["text"].array]


def frequent_buckets(docs: DataFrame, n: int) -> np.ndarray:
    """The bitmap of the frequent class; counted over the sets of all documents.

    Tasks send sorted runs of buckets, dealt by range; a range's runs are summed as they stream by, so what a task holds is
    bounded by the buckets of a range.
    """
    wide = (1 << BITS) // RANGES

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def runs() -> pd.DataFrame:
            keys = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint32)
            cut = np.searchsorted(keys, np.arange(1, RANGES, dtype=np.uint32) * np.uint32(wide))
            parts = [(k, x.tobytes()) for k, x in enumerate(np.split(keys, cut)) if len(x)]
            return pd.DataFrame(parts, columns=["range", "keys"])

        for batch in batches:
            for tokens in shingle_sets(_texts(batch), n):
                held.append(bucket(tokens))
                size += len(tokens)
                if size >= TOKENS_AT_ONCE:
                    yield runs()
                    held, size = [], 0
        yield runs()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, counts = -1, np.zeros(wide, np.int64)

        def frame() -> pd.DataFrame:
            return pd.DataFrame({"range": [at], "bits": [np.packbits(counts >= FREQUENT, bitorder="little").tobytes()]})

        for batch in batches:
            for r, part in batch.groupby("range", sort=True):
                if r != at:
                    if at >= 0:
                        yield frame()
                    at, counts = r, np.zeros(wide, np.int64)
                keys = np.frombuffer(b"".join(part["keys"]), np.uint32) - np.uint32(r * wide)
                counts += np.bincount(keys, minlength=wide)
        if at >= 0:
            yield frame()

    sent = docs.select("text").mapInPandas(send, "range int, keys binary").repartition("range").sortWithinPartitions("range")
    out = np.zeros((1 << BITS) // 8, np.uint8)
    for r in sent.mapInPandas(count, "range int, bits binary").collect():  # 16 MB at any size
        out[r["range"] * wide // 8 : (r["range"] + 1) * wide // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


ROWS = "kind byte, sig long, place int, sid long, size int, doc_id long, nameless boolean, u long"


def _set_rows(docs: DataFrame, frequent: np.ndarray, n: int, percent: int) -> DataFrame:
    """In one pass each document's set (kind 1; size 0: none) and the signatures of the sets (kind 0), once in a task."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def frame(parts: list[tuple[np.ndarray, np.ndarray]], of: list[tuple[int, int]]) -> pd.DataFrame:
        count = [len(s) for s, _ in parts]
        return pd.DataFrame({
            "kind": np.int8(0), "sig": np.concatenate([s for s, _ in parts]).view(np.int64), "place": np.concatenate([p for _, p in parts]).astype(np.int32),
            "sid": np.repeat([i for i, _ in of], count), "size": np.repeat(np.array([k for _, k in of], np.int32), count), "doc_id": 0, "nameless": False, "u": 0,
        })

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often, seen = shared.value, set()  # copies inside a task's input give signatures once
        parts, of, held = [], [], 0
        for batch in batches:
            sets = []
            for tokens in shingle_sets(_texts(batch), n):
                own = (set_id(tokens), len(tokens)) if len(tokens) else (0, 0)
                sets.append(own)
                if len(tokens) and own[0] not in seen:
                    seen.add(own[0])
                    parts.append(signatures(tokens, often, percent))
                    of.append(own)
                    held += len(parts[-1][0])
                    if held > 100_000:
                        yield frame(parts, of)
                        parts, of, held = [], [], 0
            yield pd.DataFrame({
                "kind": np.int8(1), "sig": 0, "place": np.int32(0), "sid": np.array([i for i, _ in sets], np.int64), "size": np.array([k for _, k in sets], np.int32),
                "doc_id": batch["doc_id"].to_numpy(np.int64), "nameless": batch["nameless"].to_numpy(bool), "u": batch["u"].to_numpy(np.int64),
            })
        if parts:
            yield frame(parts, of)

    return named(docs).select("doc_id", "nameless", "text", "u").mapInPandas(run, ROWS)


def _near(a: str, b: str, percent: int):
    """Sizes of linked sets differ by no more than the threshold."""
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def _possible(percent: int):
    """Whether a pair that shares `both` tokens of its prefixes, the last at places a_last and b_last, can still link.

    Up to its last shared token each set has tokens that the other lacks; behind it, the set whose prefix ends first has
    all the rest of its prefix. With D tokens missing in the other set and I added ones, D + t I <= (1 - t) n must hold.
    """
    need = lambda c: F.col(c) - F.floor((percent * F.col(c) + 99) / 100) + 1
    missing, added = F.col("a_last") + 1 - F.col("both"), F.col("b_last") + 1 - F.col("both")
    rest_a, rest_b = need("a_size") - F.col("a_last") - 1, need("b_size") - F.col("b_last") - 1
    room = (100 - percent) * F.col("a_size")
    fits = lambda d, i: 100 * d + percent * i <= room
    return (F.col("least") < 0) | fits(missing + rest_a, added) | fits(missing, added + rest_b)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b): (node, root), root the least node. Large-star and small-star in turn.

    Minima are staged before they are joined: Spark splits the rows of a frequent node in a join of two plain shuffles.
    """
    edges = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen, rows = None, edges.count()
    while True:
        held = apart if rows > FEW else lambda table: table
        both = _either(edges, ("u", "v"), ("v", "u"))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(held(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staged(large, "large-star")
        first = staged(large.groupBy("u").agg(F.min("v").alias("m")), "first")
        small = _either(large.join(held(first), "u"), ("v", "m"), ("u", "m")).where("u <> v")
        edges = staged(small.distinct(), "small-star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen, rows = now, now[0]


def _either(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Rows (u, v) for each of the pairs of columns."""
    return rows.select(F.explode(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])).alias("e")).select("e.*")


def _bloom(ids: DataFrame, column: str):
    """A filter of fixed size over the column, as a predicate on the column of that name; it may let others through."""
    spot = lambda k: F.pmod(F.xxhash64(F.col(column), F.lit(k)), F.lit(BLOOM_BITS))
    bits = ids.select(F.explode(F.array(spot(0), spot(1))).alias("bit"))
    wide = BLOOM_BITS // BLOOM_RANGES

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, seen = -1, np.zeros(wide, bool)

        def frame() -> pd.DataFrame:
            return pd.DataFrame({"range": [at], "bits": [np.packbits(seen, bitorder="little").tobytes()]})

        for batch in batches:
            for r, part in batch.groupby("range", sort=True):
                if r != at:
                    if at >= 0:
                        yield frame()
                    at, seen = r, np.zeros(wide, bool)
                seen[part["bit"].to_numpy(np.int64) - r * wide] = True
        if at >= 0:
            yield frame()

    bits = bits.distinct().withColumn("range", F.floor(F.col("bit") / wide).cast("int")).repartition("range").sortWithinPartitions("range")
    filled = np.zeros(BLOOM_BITS // 8, np.uint8)
    for r in bits.mapInPandas(pack, "range int, bits binary").collect():  # 4 MB at any size
        filled[r["range"] * wide // 8 : (r["range"] + 1) * wide // 8] = np.frombuffer(r["bits"], np.uint8)
    table = filled.view("<u4")
    shared = ids.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def maybe(a: pd.Series, b: pd.Series) -> pd.Series:
        t = shared.value
        hit = lambda x: t[x >> 5] >> (x & 31).astype(np.uint32) & 1
        return pd.Series((hit(a.to_numpy(np.int64)) & hit(b.to_numpy(np.int64))).astype(bool))

    return maybe(spot(0), spot(1))


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts link."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, tokens = None, None
        for batch in batches:
            keep = []
            for (a, text), other in zip(zip(batch["a"].array, batch["a_text"].array), shingle_sets(list(batch["b_text"].array), n)):
                if a != last:
                    last, tokens = a, next(shingle_sets([text], n))
                both = len(np.intersect1d(tokens, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(tokens) + len(other) - both))
            yield batch.loc[keep, ["a", "b"]]

    with_b = pairs.join(texts.select(F.col("sid").alias("b"), F.col("text").alias("b_text")), "b")
    both = with_b.join(texts.select(F.col("sid").alias("a"), F.col("text").alias("a_text")), "a")
    return both.select("a", "b", "a_text", "b_text").mapInPandas(run, "a long, b long")


def link_documents(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Links documents (doc_id, text) whose sets of lower-cased n-word shingles have a Jaccard similarity of percent %.

    A text of fewer than n words is one shingle; a null text, or one without words, has the empty set and links with
    nothing. Returns one row per document: doc_id, n_shingles, component_id (the least doc_id reachable by links) and
    copies, the number of documents with the same set. Every row is a document of its own, rows of a repeated doc_id and
    those without one too; these link like others but are no component_id (null where no linked row has an id). An empty table
    gives no rows; other columns are not read. Tables are staged in the shared folder, and jobs run, while the plan is made.
    """
    small_batches(docs.sparkSession)
    docs = identified(docs.select("doc_id", "text"))
    spark = docs.sparkSession
    often = frequent_buckets(docs, n)
    release(spark)
    every, path = stored(_set_rows(docs, often, n, percent), "sets-and-signatures")
    sets = unnamed(every.where("kind = 1").select("doc_id", "nameless", "u", F.expr("CASE WHEN size > 0 THEN sid END").alias("sid"), "size"))
    sets = staged(sets, "sets")
    rows = every.where("kind = 0").select("sig", "place", "sid", "size")

    # Signatures are counted before anything else moves; from here on only those of several sets are joined.
    repeated = staged(rows.groupBy("sig").count().where("count > 1").select("sig"), "repeated")
    release(spark)
    hits = staged(rows.join(apart(repeated), "sig", "left_semi").distinct(), "hits")
    remove(spark, path)
    release(spark)
    groups = staged(hits.groupBy("sig").agg(F.count("*").alias("m"), F.min("sid").alias("first")).where("m > 1"), "groups")
    known = sets.where(F.col("sid").isNotNull()).groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.min("u").alias("u"), F.count("*").alias("copies"))
    pairs = staged(_pairs(hits.join(apart(groups.where(F.col("m") <= GROUP).select("sig")), "sig", "left_semi"), percent), "pairs")
    crowd = staged(hits.join(groups.where(F.col("m") > GROUP).select("sig", "first"), "sig").select("sid", "size", "first").distinct(), "crowd")
    clusters = staged(_spanned(crowd), "clusters")
    # In a large group all are held against one; what that connects need not be compared again.
    star = crowd.where("sid <> first").select(F.col("first").alias("a"), F.col("sid").alias("b"))
    pairs = pairs.unionByName(star).distinct()
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).unionByName(clusters.select(F.col("node").alias("sid"))).distinct()
    involved = staged(wanted.join(known, "sid").select("sid", "u"), "involved")
    # Rows of equal id and text share u; one text stands for a set, before anything is joined with it.
    texts = docs.select("u", "text").where(_bloom(involved, "u")).dropDuplicates(["u"]).join(apart(involved), "u")
    texts = staged(texts.select("sid", "text"), "texts")

    release(spark)
    few = components(staged(_verified(pairs, texts, n, percent), "links"))
    release(spark)
    many = staged(_crowded(_unsettled(clusters, few), texts, n, percent), "crowded-links")
    release(spark)
    roots = components(few.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(many))
    known = known.drop("u")
    least = apart(roots).join(known.withColumnRenamed("sid", "node"), "node").groupBy("root").agg(F.min("doc_id").alias("low"))
    least = roots.select("root").distinct().join(known.withColumnRenamed("sid", "root"), "root").select("root", F.col("doc_id").alias("own")).join(least, "root").select("root", F.least("own", "low").alias("component_id"))
    class_of = known.join(apart(roots.withColumnRenamed("node", "sid")), "sid", "left").withColumn("root", F.coalesce("root", "sid")).join(least, "root", "left").select("sid", F.coalesce("component_id", "doc_id").alias("component_id"), "copies")
    out = sets.join(class_of, "sid", "left")
    return out.select("doc_id", F.col("size").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("copies", F.lit(1)).alias("copies"))


def _pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets that share signatures of small groups, if these can be enough.

    A pair that shares one of a large group as well may be left out here: its cluster holds it.
    """
    as_ = lambda c: members.select("sig", F.col("sid").alias(c), F.col("size").alias(f"{c}_size"), F.col("place").alias(f"{c}_place"))
    rows = as_("a").join(as_("b"), "sig").where("a < b").where(_near("a_size", "b_size", percent))
    pairs = rows.groupBy("a", "b", "a_size", "b_size").agg(
        F.count("*").alias("both"), F.max("a_place").alias("a_last"), F.max("b_place").alias("b_last"), F.min(F.least("a_place", "b_place")).alias("least")
    )
    return pairs.where(_possible(percent)).select("a", "b")


def _spanned(rows: DataFrame) -> DataFrame:
    """Clusters of the sets (sid, size, first) that large groups hold together: (node, root, size)."""
    sizes = rows.select(F.col("sid").alias("node"), "size").distinct()
    clusters = components(rows.select(F.col("sid").alias("a"), F.col("first").alias("b")))
    return sizes.join(apart(clusters), "node", "left").withColumn("root", F.coalesce("root", "node"))


def _unsettled(clusters: DataFrame, found: DataFrame) -> DataFrame:
    """Clusters (node, root, size) that the components found so far leave in parts, with `rest`, whether a set is outside of
    its cluster's largest part."""
    parts = clusters.join(apart(found.select("node", F.col("root").alias("part"))), "node", "left").withColumn("part", F.coalesce("part", "node"))
    parts = staged(parts, "parts")
    largest = parts.groupBy("root", "part").agg(F.count("*").alias("n")).groupBy("root").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.count("*").alias("parts"))
    return parts.join(largest.where("parts > 1"), "root").select("node", "root", "size", (F.col("part") != F.col("main")).alias("rest"))


def _crowded(clusters: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links inside clusters, as far as they connect: a task counts the overlaps of two blocks of sets.

    The rest of a cluster is held against its largest part and against itself. Linked sets are of like size, so a cluster
    falls into levels of sizes, each with the sets of its own and the level below. A block has BLOCK sets or SHINGLES
    shingles. No pair leaves a task but one that joins two parts.
    """
    width = math.log(100 / percent) * 1.000001  # sets that can link are at most one level apart, rounding included
    own = F.floor(F.log("size") / F.lit(width)).cast("int")
    rows = clusters.withColumn("own", own).withColumn("level", F.explode(F.array("own", F.col("own") + 1)))
    blocks = lambda side: F.greatest(F.ceil(F.count_if(side) / BLOCK), F.ceil(F.coalesce(F.sum(F.when(side, F.col("size"))), F.lit(0)) / SHINGLES)).cast("int")
    shape = rows.groupBy("root", "level").agg(blocks(~F.col("rest")).alias("mains"), blocks(F.col("rest")).alias("rests"), F.count_if(F.col("own") == F.col("level")).alias("top"))
    rows = rows.join(shape.where("top > 0 AND rests > 0"), ["root", "level"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.when(F.col("rest"), F.col("rests")).otherwise(F.col("mains"))).cast("int"))
    # Tasks (i, j): blocks i <= j of the rest, or block -1 - i of the largest part with block j of the rest.
    each = lambda count, task: F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), task)).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    pair = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    block = F.col("block")
    with_rest = each(F.col("rests"), lambda o: F.when(F.col("rest"), pair(F.least(block, o), F.greatest(block, o))).otherwise(pair(-1 - block, o)))
    with_main = F.when(F.col("rest"), each(F.col("mains"), lambda o: pair(-1 - o, block))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    rows = rows.select("root", "level", "block", "rest", (F.col("own") < F.col("level")).alias("below"), F.col("node").alias("sid"), F.explode(F.concat(with_rest, with_main)).alias("task"))
    rows = rows.select("root", "level", "block", "rest", "below", "sid", "task.i", "task.j")
    rows = apart(rows).join(texts, "sid")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("sid").sort_values("sid", kind="stable")
        sid, block, rest, below = (group[c].to_numpy() for c in ("sid", "block", "rest", "below"))
        i, j = group["i"].iloc[0], group["j"].iloc[0]
        side = rest.astype(int) if i < 0 else None if i == j else block
        return pd.DataFrame(connecting_links(sid, list(shingle_sets(_texts(group), n)), percent, below, side), columns=["a", "b"])

    return rows.groupBy("root", "level", "i", "j").applyInPandas(run, "a long, b long")


def connecting_links(ids: np.ndarray, sets: list[np.ndarray], percent: int, below: np.ndarray, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets, by an inverted index.

    Pairs that are both below are left out, and with side those of one side.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets])
    _, code, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), size)
    keep = df[code] > 1
    code, row = code[keep], row[keep]
    by = np.argsort(code, kind="stable")
    posting, begin = row[by], np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(df)))])
    cut = np.searchsorted(row, np.arange(m + 1))
    parent = list(range(m))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i in range(m):
        mine = code[cut[i] : cut[i + 1]]
        if not len(mine):
            continue
        lo, count = begin[mine], begin[mine + 1] - begin[mine]
        at = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
        both = np.bincount(posting[at], minlength=m)
        linked = 100 * both >= percent * (size[i] + size - both)
        linked[: i + 1] = False
        if below[i]:
            linked &= ~below
        if side is not None:
            linked &= side != side[i]
        for j in np.flatnonzero(linked).tolist():
            x, y = root(i), root(j)
            if x != y:
                parent[y] = x
                out.append((int(ids[i]), int(ids[j])))
    return out
