"""The trie of conversation prefixes as succinct level-order tries.

A node is a distinct sequence of first turns. Its key is its depth and 128 bits of hash, the exclusive or over its turns of
hashes of place, role and text; so nodes are found by one grouping, which counts members before rows move: a prefix that a
third of all conversations share is a few rows by then.

Sums over subtrees come from tries that fit a task. A node is heavy if its members have more than `limit` turns from it on.
Heavy nodes form the upper levels; below them hang light subtrees of at most `limit` turns each, which are dealt to shards by
their top's hash. In a task, numpy lays a shard out in level order: a LOUDS bitvector (for each node as many ones as it has
children, then a zero) and label arrays. A node's parent is the number of zeros before its one, and sums go up by `add.at` over the
levels in reverse. The upper levels are merged after that, with the sums of the subtrees below them. There are at most
turns / limit heavy nodes on a level: 200 while the limit grows with the input, one per million turns from there on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelink.llm.shared import staged
from tracelink.operators.ordering import XOR, Ordered, plain

SPACE = r"[\x20\x09-\x0D]+"
KEY = ["depth", "u", "v"]
NODES = "depth long, u long, v long, pu long, pv long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, top boolean"


def shared_turns(conv_id: Column, modulus: int = 4) -> Column:
    """How many first turns a conversation takes from that of its block: the CRC-32 of its decimal id, modulo `modulus`."""
    return F.crc32(conv_id.cast("string").cast("binary")) % modulus


def rebuild(conversations: DataFrame, block: int = 20, modulus: int = 4) -> tuple[DataFrame, DataFrame]:
    """Gives each conversation c the first h turns of conversation c - c % block in place of its own first h; all of them if
    there are fewer, and none if there is no such conversation. h: `shared_turns`.

    Turns are ordered by turn, nulls first, then role and text; null roles and texts are empty, and repeated rows are turns of
    their own. Rows without conv_id belong to no conversation and are left out. Places come from an order of all turns over
    range partitions, so a conversation of very many turns is spread like any others.
    Returns (turns, conversations): conv_id, depth from 1, a and b (hashes of role and text) and words; and all conv_ids.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    words = F.size(F.array_remove(F.split("text", SPACE), "")).cast("long")
    turns = turns.withColumns({"a": F.xxhash64("role", "text"), "b": F.xxhash64("text", F.lit(11), "role"), "words": words})
    order = Ordered(turns, "conv_id", F.col("turn").asc_nulls_first(), "role", "text", keep=["conv_id", "a", "b", "words"])
    turns = plain(order.numbered("n"))

    convs = turns.groupBy("conv_id").agg(F.min("n").alias("first"), F.count("*").alias("size"))
    convs = staged(convs.withColumns({"h": shared_turns(F.col("conv_id"), modulus), "giver": F.col("conv_id") - F.col("conv_id") % block}), "conversations")
    givers = convs.where("conv_id = giver").select("giver", F.col("size").alias("given"))
    known = convs.join(givers, "giver", "left").withColumn("taken", F.least("h", F.coalesce("given", F.lit(0))))
    placed = turns.join(known.select("conv_id", "first", "h", "taken"), "conv_id").withColumn("place", F.col("n") - F.col("first"))
    own = placed.where("place >= h").withColumn("depth", F.col("place") - F.col("h") + F.col("taken") + 1)
    given = placed.where((F.col("conv_id") % block == 0) & (F.col("place") < modulus - 1)).select(F.col("conv_id").alias("giver"), (F.col("place") + 1).alias("depth"), "a", "b", "words")
    taken = convs.join(given, "giver").where("depth <= h")
    columns = ["conv_id", "depth", "a", "b", "words"]
    return own.select(*columns).unionByName(taken.select(*columns)), convs.select("conv_id")


def prefixes(turns: DataFrame) -> DataFrame:
    """Adds to turns (conv_id, depth, a, b, words) the key of their node (u, v), that of the parent (pu, pv), and `rest`, the
    turns from there to the conversation's end.

    A running exclusive or over all turns in order is a conversation's own once what came before its first turn is taken out
    again, and a parent's once the turn's own hash is.
    """
    terms = turns.withColumns({"x": F.xxhash64("a", "depth"), "y": F.xxhash64("depth", F.lit(5), "b")})
    order = Ordered(terms, "conv_id", "depth", keep=["conv_id", "depth", "words", "x", "y"])
    rows = order.running(order.running(order.numbered("n"), "x", "all_x", XOR), "y", "all_y", XOR)
    xor = lambda a, b: F.col(a).bitwiseXOR(F.col(b))
    before = F.struct(xor("all_x", "x").alias("bx"), xor("all_y", "y").alias("by"))
    of = rows.groupBy("conv_id").agg(F.min_by(before, "n").alias("before"), F.max("n").alias("last"))
    rows = rows.join(of, "conv_id").withColumns({"u": xor("all_x", "before.bx"), "v": xor("all_y", "before.by")})
    return rows.select("conv_id", *KEY, xor("u", "x").alias("pu"), xor("v", "y").alias("pv"), "words", (F.col("last") - F.col("n") + 1).alias("rest"))


class Louds:
    """A forest in level order: bit vector, labels and levels. Node 0 is above all tops.

    level: the levels of the nodes below their tops, from 0; parent: the row of each node's parent, -1 for tops; label: what
    orders siblings. `row` maps nodes (from 1) to rows.
    """

    def __init__(self, level: np.ndarray, parent: np.ndarray, label: np.ndarray):
        n = len(level)
        number = np.zeros(n + 1, np.int64)  # of rows, in level order; the last entry is that of row -1
        rows = np.argsort(level, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(level[rows])) + 1, [n]])
        self.levels = [(int(a) + 1, int(b) + 1) for a, b in pairwise(cuts) if b > a]
        for a, b in self.levels:
            of = rows[a - 1 : b - 1]
            of = of[np.lexsort((label[of], number[parent[of]]))]
            rows[a - 1 : b - 1] = of
            number[of] = np.arange(a, b)
        self.row = rows
        self.labels = label[rows]
        degree = np.bincount(number[parent], minlength=n + 1)
        self.bits = np.ones(2 * n + 1, bool)
        self.bits[np.cumsum(degree + 1) - 1] = False

    def parents(self) -> np.ndarray:
        """The parent of each node from 1: the zeros before its one."""
        ones = np.flatnonzero(self.bits)
        return ones - np.arange(len(ones))

    def degrees(self) -> np.ndarray:
        """The number of children of each node from 0."""
        return np.diff(np.flatnonzero(~self.bits), prepend=-1) - 1

    def rollup(self, values: np.ndarray) -> np.ndarray:
        """Sums of (nodes from 1, columns) over subtrees."""
        total = np.concatenate([np.zeros((1, values.shape[1]), values.dtype), values])
        parent = self.parents()
        for a, b in reversed(self.levels):
            np.add.at(total, parent[a - 1 : b - 1], total[a:b])
        return total[1:]


def _parent_rows(rows: pd.DataFrame) -> np.ndarray:
    """The row of each row's parent, or -1."""
    n = len(rows)
    columns = [np.concatenate([rows[own].to_numpy(np.int64), rows[of].to_numpy(np.int64) - less]) for own, of, less in (("v", "pv", 0), ("u", "pu", 0), ("depth", "depth", 1))]
    order = np.lexsort(columns)
    new = np.zeros(2 * n, bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    code = np.empty(2 * n, np.int64)
    code[order] = np.cumsum(new)
    at = np.full(2 * n, -1)
    at[code[:n]] = np.arange(n)
    return at[code[n:]]


def roll_up(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard: nodes with what hangs below them elsewhere (children, leaves, saved) become finished nodes."""
    parent = _parent_rows(rows)
    trie = Louds((rows["depth"] - rows["top_depth"]).to_numpy(np.int64), parent, rows["conv_id"].to_numpy(np.int64))
    rows = rows.iloc[trie.row].reset_index(drop=True)
    above = trie.parents()
    children = trie.degrees()[1:] + rows["children"].to_numpy(np.int64)
    saved = (rows["n_convs"].to_numpy(np.int64) - 1) * rows["words"].to_numpy(np.int64) + rows["saved"].to_numpy(np.int64)
    sums = trie.rollup(np.stack([(children == 0) + rows["leaves"].to_numpy(np.int64), saved], axis=1))
    named = pd.array(np.concatenate([[0], trie.labels])[above], dtype="Int64")
    named[above == 0] = pd.NA
    return rows[[*KEY, "pu", "pv", "conv_id"]].assign(parent_conv_id=named, n_convs=rows["n_convs"], n_children=children, n_leaves=sums[:, 0], saved_tokens=sums[:, 1], top=above == 0)


def _small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """Broadcast if it has been counted to be small, else left to Spark."""
    return F.broadcast(df) if df.count() <= most else df


def prefix_trie(turns: DataFrame, convs: DataFrame, limit: int | None = None, shard: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """The nodes of all prefixes, and the conversations that end at each.

    turns: conv_id, depth (gapless from 1), a, b (hashes of what makes turns equal) and words; convs: all conv_ids, once each, those without
    turns too. limit: turns of a light subtree at most (default: a 200th of all, within 1,000 and 1,000,000); shard: nodes of a task,
    about. Without conversations there are no nodes, not even the root.
    Returns nodes: depth, u, v (the key), conv_id (the smallest member), parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens; and ends: depth, u, v and conv_id of the conversations that have no further turn.
    """
    rows = staged(prefixes(turns), "prefixes")
    most = limit or min(max(rows.count() // 200, 1_000), 1_000_000)
    heavy = staged(rows.groupBy(*KEY).agg(F.sum("rest").alias("size")).where(F.col("size") > most).select(*KEY, F.lit(True).alias("heavy")), "heavy")
    marked = rows.join(_small(heavy), KEY, "left")
    # A conversation's first light node is the top of all its light ones.
    top = F.struct(F.col("depth").alias("d"), F.col("u").alias("tu"), F.col("v").alias("tv"))
    tops = marked.where("heavy IS NULL").groupBy("conv_id").agg(F.min_by(top, "depth").alias("top"))
    marked = marked.join(tops, "conv_id", "left").withColumn("at", F.when(F.col("heavy").isNull(), F.col("top")))
    parent = F.min(F.struct("pu", "pv"))
    nodes = marked.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), parent.alias("p"), F.min("at").alias("at"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.selectExpr("0L AS depth", "0L AS u", "0L AS v", "conv_id", "n_convs", "0L AS words", "named_struct('pu', 0L, 'pv', 0L) AS p", "CAST(NULL AS struct<d: bigint, tu: bigint, tv: bigint>) AS at")
    nodes = staged(nodes.unionByName(root), "nodes")

    parts = max(1, -(-nodes.count() // shard))
    none = {c: F.lit(0).cast("long") for c in ("children", "leaves", "saved")}
    flat = nodes.select(*KEY, "p.pu", "p.pv", "conv_id", "n_convs", "words", F.col("at.d").alias("top_depth"), F.pmod(F.xxhash64("at.tu", "at.tv"), F.lit(parts)).alias("shard"))
    below = flat.where("top_depth IS NOT NULL").withColumns(none).groupBy("shard").applyInPandas(lambda rows: roll_up(rows), NODES)
    below = staged(below, "light")

    hung = below.where("top").groupBy((F.col("depth") - 1).alias("depth"), F.col("pu").alias("u"), F.col("pv").alias("v"))
    hung = hung.agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    upper = flat.where("top_depth IS NULL").join(hung, KEY, "left").fillna(0, ["children", "leaves", "saved", "top_depth"])
    above = staged(upper.groupBy("top_depth").applyInPandas(lambda rows: roll_up(rows), NODES), "upper")

    over = _small(above.selectExpr("depth + 1 AS of_depth", "u AS of_u", "v AS of_v", "conv_id AS over_conv_id"))
    met = below["top"] & (below["depth"] == over["of_depth"]) & (below["pu"] == over["of_u"]) & (below["pv"] == over["of_v"])
    below = below.join(over, met, "left").withColumn("parent_conv_id", F.coalesce("over_conv_id", "parent_conv_id"))
    out = [*KEY, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    ends = rows.where("rest = 1").select(*KEY, "conv_id")
    turnless = convs.join(rows.where("depth = 1").select("conv_id"), "conv_id", "left_anti")
    return below.select(*out).unionByName(above.select(*out)), ends.unionByName(turnless.selectExpr("0L AS depth", "0L AS u", "0L AS v", "conv_id"))


def ends_digests(ends: DataFrame, chunk: int = 4096) -> DataFrame:
    """ends_sha256 for each key with members: the SHA-256 of their decimal ids, ascending, joined by commas.

    A digest takes its bytes in order. So ids are sorted over all tasks and written as chunks of text, and what one task reads
    for a large group is a row for each chunk; it keeps no more than the state of the digest.
    """
    columns = ", ".join(f"{c} long" for c in KEY)

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            ids, key = rows["conv_id"].to_numpy(), rows[KEY].to_numpy()
            cut = np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])
            starts = np.flatnonzero(cut)
            starts = np.concatenate([np.arange(a, b, chunk) for a, b in pairwise([*starts, len(ids)])])
            texts = [",".join(map(str, ids[a:b].tolist())) for a, b in pairwise([*starts, len(ids)])]
            yield rows.iloc[starts][KEY].assign(first=ids[starts], ids=texts)

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, out = None, None, []
        for rows in batches:
            for *key, ids in zip(*(rows[c].tolist() for c in KEY), rows["ids"]):
                if key == now:
                    state.update(b"," + ids.encode())
                    continue
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = key, hashlib.sha256(ids.encode())
            if out:
                yield pd.DataFrame(out, columns=[*KEY, "ends_sha256"])
                out = []
        if now is not None:
            yield pd.DataFrame([(*now, state.hexdigest())], columns=[*KEY, "ends_sha256"])

    order = [*KEY, "conv_id"]
    texts = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(chunks, f"{columns}, first long, ids string")
    return texts.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInPandas(digests, f"{columns}, ends_sha256 string")


def conversation_trie(conversations: DataFrame, limit: int | None = None) -> DataFrame:
    """`rebuild` and `prefix_trie` with the digest of the conversations that end at each node (none: that of no bytes)."""
    nodes, ends = prefix_trie(*rebuild(conversations), limit=limit)
    out = nodes.join(ends_digests(ends), KEY, "left")
    return out.drop("u", "v").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
