"""Conversation tries against a plain trie of dictionaries."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tracelink.llm import queries, trie


def by_hand(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    members, words = collections.defaultdict(set), {}
    ends = collections.defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        new = own.get(c - c % 20, [])[:h] + turns[h:]
        for d in range(len(new) + 1):
            members[tuple(new[:d])].add(c)
        ends[tuple(new)].append(c)
    children = collections.defaultdict(list)
    for s in members:
        if s:
            children[s[:-1]].append(s)
    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        n = len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        leaves[s] = sum(leaves[x] for x in children[s]) or 1
        saved[s] = (len(members[s]) - 1) * n + sum(saved[x] for x in children[s])
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(children[s]), leaves[s], saved[s], sha(ends[s])) for s, m in members.items())


def collected(df):
    order = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    assert sorted(df.columns) == sorted(order)
    return sorted(tuple(r[c] for c in order) for r in df.select(*order).collect())


SCHEMA = "conv_id long, turn long, role string, text string"


def some(seed, n, words=3, length=6):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        c = rng.randrange(3 * n)
        first = rng.randrange(3)
        rows += [(c, first + k, rng.choice(["user", "bot", None]), rng.choice(["", None, "a b", "a  b\tc", "d"][:words])) for k in range(rng.randrange(1, length))]
    return rows


@pytest.mark.parametrize("limit", [None, 1, 5, 40])
def test_random(spark, limit):
    rows = some(3, 150)
    assert collected(trie.conversation_trie(spark.createDataFrame(rows, SCHEMA), limit)) == by_hand(rows)


def test_messy(spark):
    rows = [(0, None, None, None), (0, 1, "u", "x y"), (0, 2, "u", "z"), (0, 3, "u", "w"), (3, 1, "u", "late"), (None, 1, "u", "nobody"), (7, 1, "u", "p"), (7, 1, "u", "p"), (7, None, "u", "first"), (45, 1, "u", "no giver"), (61, 1, "é", "日本 語"), (62, 1, "é", "long " * 200_000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for clash in ("depth", "u", "place", "words", "h", "giver", "at", "shard"):
        docs = docs.selectExpr("*", f"'x' AS {clash}")
    assert collected(trie.conversation_trie(docs)) == by_hand(rows)
    assert trie.conversation_trie(docs.limit(0)).count() == 0


def test_many_share_and_many_are_equal(spark):
    """Hot prefixes and hot ends: 4,000 conversations with one first turn, 3,000 of them equal, and a long chain."""
    rows = [(c, t, "u", "same" if t == 0 or c % 4 else f"own {c}") for c in range(4_000) for t in range(4)]
    rows += [(c, t, "u", f"step {t} of") for c in (100_000, 100_020) for t in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = by_hand(rows)
    assert collected(trie.conversation_trie(docs, 100)) == want == collected(trie.conversation_trie(docs))


def test_one_conversation_of_most_turns(spark):
    """It is spread over tasks: no window goes by conversation."""
    rows = [(40, t, "u", f"turn {t % 7}") for t in range(2_000)] + [(41 + c, t, "u", f"turn {t}") for c in range(25) for t in range(3)]
    turns, convs = trie.rebuild(spark.createDataFrame(rows, SCHEMA))
    plan = trie.prefixes(turns)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "windowspecdefinition(conv_id" not in plan
    nodes, _ = trie.prefix_trie(turns, convs)
    want = by_hand(rows)
    assert sorted(map(tuple, nodes.select("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens").collect())) == sorted((c, d, n, k, m, s) for c, d, _, n, k, m, s, _ in want)


def test_digest_over_chunks(spark):
    ends = spark.range(10_000).selectExpr("2L AS depth", "id % 2 AS u", "1L AS v", "id - 5000 AS conv_id").repartition(7)
    got = {r.u: r.ends_sha256 for r in trie.ends_digests(ends, chunk=16).collect()}
    assert got == {u: hashlib.sha256(",".join(str(i - 5000) for i in range(u, 10_000, 2)).encode()).hexdigest() for u in (0, 1)}


def test_louds():
    """Level order, bits and parents of a small forest: tops 0 and 1, below 0 the nodes 2 and 3, below 3 the node 4."""
    t = trie.Louds(np.array([0, 0, 1, 1, 2]), np.array([-1, -1, 0, 0, 3]), np.array([5, 6, 9, 8, 7]))
    assert t.labels.tolist() == [5, 6, 8, 9, 7]
    assert "".join("01"[int(b)] for b in t.bits) == "110" + "110" + "0" + "10" + "0" + "0"
    assert t.parents().tolist() == [0, 0, 1, 1, 3] and t.degrees().tolist() == [2, 2, 0, 1, 0, 0]
    assert t.rollup(np.ones((5, 1), int))[:, 0].tolist() == [4, 1, 2, 1, 1]


def test_query(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collected(queries.op11_conversation_trie(spark, data)) == by_hand(rows)
