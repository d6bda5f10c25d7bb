"""CSV files whose quoted fields span lines, read by many tasks.

Such a file cannot be cut at a line end without knowing whether it lies inside quotes. That is a matter of parity: quotes inside
a field are doubled, so a line end is inside one exactly if an odd number of quotes comes before it in the file. A first
pass counts the quotes of each split, and a running parity over the splits of a file (a row each) tells in which state every
split begins. The second pass puts the lines of a split together to records; only what reaches over a split's end is
shuffled, to be put together with the rest of its record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of lines that go to a Python worker at once; it holds them a few times over, as records too.
_BATCH = 4 << 20
_PIECES = "file string, start long, owner long, whole boolean, first boolean, record string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, value): lines, up to line feeds, with the split they are in; in a task they come in their order.

    Bounds, for this session, the bytes that go to a Python worker at once: how many lines a split has says nothing of their size.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(_BATCH))
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _quotes(values: pd.Series) -> np.ndarray:
    return values.str.count('"').to_numpy(np.int64) & 1


def split_states(spark: SparkSession, path: str) -> dict[tuple[str, int], tuple[int, int]]:
    """For each split (file, start) its parity at the start, and the split in which the record that is open there began.

    The driver gets a row for each split of some megabytes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parity = _quotes(batch["value"])
            for (file, start), at in batch.groupby(["file", "start"], sort=False).indices.items():
                state = np.cumsum(parity[at]) & 1  # after each line, if the batch began outside of quotes
                yield pd.DataFrame({"file": [file], "start": [start], "at": [int(at[0])], "parity": [int(state[-1])], "closes0": [bool((state == 0).any())], "closes1": [bool((state == 1).any())]})

    # Batches of a split are folded in order: a batch's number grows within its task.
    rows = _lines(spark, path).mapInPandas(run, "file string, start long, at long, parity int, closes0 boolean, closes1 boolean")
    rows = rows.withColumn("batch", F.monotonically_increasing_id())
    folded = rows.groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("batch", "parity", "closes0", "closes1"))).alias("b"))
    out, last = {}, None
    for r in folded.orderBy("file", "start").collect():
        if r["file"] != last:
            last, state, owner = r["file"], 0, r["start"]
        out[r["file"], r["start"]] = (state, owner)
        for b in r["b"]:
            # With an odd state in front, a record ends where the batch's own count is odd.
            if b["closes1"] if state else b["closes0"]:
                owner = r["start"]
            state ^= b["parity"]
    return out


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, first, record): the records of CSV files, whole, and whether each is its file's first. Quotes must be escaped by
    doubling."""
    states = split_states(spark, path)
    shared = spark.sparkContext.broadcast(states)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, owner, held, closed, out = None, 0, 0, [], False, []

        def piece(whole: bool) -> tuple:
            # The end of a record from an earlier split goes to where it began; the beginning of one stays at its own split.
            return (*now, owner if not closed else now[1], whole, now[1] == 0 and not closed, "\n".join(held))

        for batch in batches:
            for file, start, value, odd in zip(batch["file"], batch["start"], batch["value"], _quotes(batch["value"])):
                if (file, start) != now:
                    if held:
                        out.append(piece(False))
                    now, held, closed = (file, start), [], False
                    state, owner = shared.value[now]
                    begun_before = bool(state)
                held.append(value)
                state ^= int(odd)
                if not state:
                    out.append(piece(closed or not begun_before))
                    held, closed = [], True
            if out:
                yield pd.DataFrame(out, columns=["file", "start", "owner", "whole", "first", "record"])
                out = []
        if held:
            out.append(piece(False))
        if out:
            yield pd.DataFrame(out, columns=["file", "start", "owner", "whole", "first", "record"])

    rows = _lines(spark, path).mapInPandas(run, _PIECES)
    whole = rows.where("whole").select("file", "first", "record")
    # A record over split ends has one piece a split.
    parts = rows.where("NOT whole").groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("start", "first", "record"))).alias("p"))
    joined = parts.select("file", F.get("p.first", F.lit(0)).alias("first"), F.array_join("p.record", "\n").alias("record"))
    return whole.unionByName(joined).withColumn("record", F.regexp_replace("record", "\r$", ""))


def quoted_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file or folder with a header in each file, with the types of `schema`, or as text under the header's names.

    Quotes are escaped by doubling and fields may hold line ends; one file is read by as many tasks as it has splits. Empty
    lines outside of quotes are passed over, missing fields are null, and files must have the same header.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if schema is None:
        names = reader.csv(path).columns  # the header alone
        schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in names)
    records = quoted_records(spark, path).where("NOT first AND record <> ''")
    # Line feeds inside fields survive as they are.
    return records.select(F.from_csv("record", F.lit(schema), {"escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}).alias("r")).select("r.*")
