"""Sharding by Karmarkar-Karp differencing.

Documents with equal texts form an indivisible group; the groups are dealt to shards so that the shards' bytes come out
nearly equal. Differencing keeps a heap of partial partitions (a vector of shard sums each), takes the two of largest
spread and combines them in opposite order, until one is left. It runs as a tree: blocks of a few thousand groups are
differenced in parallel, then blocks of the resulting vectors, level by level, so neither a task nor the driver ever
holds more than one block.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelink.llm.shared import staged


def difference(vectors: np.ndarray) -> np.ndarray:
    """Karmarkar-Karp over n partial partitions of k shards each.

    vectors: (n, k) sums. Returns (n, k) labels: labels[i, j] is the shard that takes slot j of partition i.
    """
    n, k = vectors.shape
    order = np.argsort(vectors, axis=1, kind="stable")
    sums = np.take_along_axis(vectors, order, axis=1)
    nodes: list[tuple] = [(None, None, o) for o in order]
    live = {i: s for i, s in enumerate(sums)}
    heap = [(-int(s[-1] - s[0]), i) for i, s in live.items()]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = live.pop(a) + live.pop(b)[::-1]
        by = np.argsort(both, kind="stable")
        both = both[by]
        heapq.heappush(heap, (-int(both[-1] - both[0]), len(nodes)))
        live[len(nodes)] = both
        nodes.append((a, b, by.astype(np.int16)))
    out = np.empty((n, k), np.int32)
    todo = [(heap[0][1], np.arange(k, dtype=np.int32))]
    while todo:
        at, shard = todo.pop()
        a, b, by = nodes[at]
        mine = np.empty(k, np.int32)
        mine[by] = shard
        if a is None:
            out[at] = mine
        else:
            todo += [(a, mine), (b, mine[::-1])]
    return out


def _deal(shards: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        """Rows (unit, slot, bytes) of one block to rows (unit, slot, up_slot)."""
        block = block.sort_values(["unit", "slot"], kind="stable")
        code, unit = pd.factorize(block["unit"])
        vectors = np.zeros((len(unit), shards), np.int64)
        vectors[code, block["slot"].to_numpy()] = block["bytes"].to_numpy()
        labels = difference(vectors)
        return pd.DataFrame({"block": block["block"].to_numpy(), "unit": block["unit"].to_numpy(), "slot": block["slot"].to_numpy(), "up_slot": labels[code, block["slot"].to_numpy()]})

    return run


def assign_shards(docs: DataFrame, shards: int = 40, block: int = 4096) -> DataFrame:
    """Deals documents (doc_id, text) to `shards` shards of nearly equal bytes.

    A document weighs its UTF-8 bytes plus 16; a null text weighs 16 and counts as equal to an empty one. Documents of
    equal text share a shard, unless together they weigh more than a whole shard: no balance is possible then, so such
    a group (there are fewer of them than shards) is cut into slices of about a quarter shard. Rows are cut and numbered by a
    number of their own, which is staged with them, so repeated rows, and rows without an id, are dealt like any others; an empty table
    gives no rows; other columns are not read.
    Returns doc_id, size, text_crc32, shard and slot, the gapless place in the shard.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("key"), F.monotonically_increasing_id().alias("row")
    )
    rows = staged(rows, "shard-documents")
    groups = staged(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "shard-groups")
    n, total = groups.agg(F.count("*"), F.sum("bytes")).first()
    if not n:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    target = total / shards
    # At most `shards` groups weigh more than a shard, so this table has a fixed bound.
    large = groups.where(F.col("bytes") > F.lit(target)).select("key", F.ceil(F.col("bytes") * 4 / target).cast("int").alias("cuts"))
    cut = rows.join(F.broadcast(large), "key", "left").withColumn("cut", F.coalesce(F.pmod(F.xxhash64("row"), F.col("cuts")).cast("int"), F.lit(0))).drop("cuts")
    sliced = cut.join(F.broadcast(large.select("key")), "key", "left_semi").groupBy("key", "cut").agg(F.sum("size").alias("bytes"))
    whole = groups.where(F.col("bytes") <= F.lit(target)).select("key", F.lit(0).alias("cut"), "bytes")
    blocks = max(1, math.ceil(n / block))
    items = whole.unionByName(sliced).withColumn("unit", F.xxhash64("key", "cut"))
    level = items.groupBy("unit").agg(F.sum("bytes").alias("bytes")).withColumn("slot", F.lit(0))
    placed = None
    while True:
        level = level.withColumn("block", F.pmod(F.xxhash64("unit", F.lit(blocks)), F.lit(blocks)).cast("long"))
        dealt = level.groupBy("block").applyInPandas(_deal(shards), "block long, unit long, slot int, up_slot int")
        step = staged(level.join(dealt, ["block", "unit", "slot"]), "shard-level")
        if placed is None:
            placed = step.select(F.col("unit").alias("leaf"), F.col("block").alias("up"), "up_slot")
        else:
            now = step.select(F.col("unit").alias("up"), F.col("slot").alias("up_slot"), F.col("block").alias("next"), F.col("up_slot").alias("next_slot"))
            placed = placed.join(now, ["up", "up_slot"]).select("leaf", F.col("next").alias("up"), F.col("next_slot").alias("up_slot"))
        if blocks == 1:
            break
        level = step.groupBy(F.col("block").alias("unit"), F.col("up_slot").alias("slot")).agg(F.sum("bytes").alias("bytes"))
        blocks = math.ceil(blocks * shards / (block * 8)) if blocks * shards > block * 8 else 1
    where = items.select("key", "cut", F.col("unit").alias("leaf")).join(placed, "leaf").select("key", "cut", F.col("up_slot").alias("shard"))
    found = cut.join(where, ["key", "cut"]).select("row", "doc_id", "size", "text_crc32", "shard")
    return with_slots(found)


def with_slots(rows: DataFrame, per_slice: int = 50_000) -> DataFrame:
    """Adds slot, a gapless number from 0 in each shard: counts of small slices of the numbered rows first, then places inside
    each."""
    rows = staged(rows, "shard-rows")
    slices = max(16, math.ceil(rows.count() / per_slice))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("shard", "slice").count().withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("row"))
    return (
        rows.withColumn("inside", inside)
        .join(first, ["shard", "slice"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("inside") - 1).cast("long").alias("slot"))
    )
