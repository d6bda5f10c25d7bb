"""What several operators share: the cluster's shared folder, staged tables and vectorised word scanning."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes 0x20 and 0x09-0x0D separate words; in UTF-8 they never occur inside another character.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in a single process, one of our own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tracelink-"))
    return sc._jsc.sc().getCheckpointDir().get()


_scopes: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that operators have staged inside; what they feed must be written by then."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.remove(paths)
        for p in paths:
            remove(spark, p)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a stored table."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffles of plans that nothing refers to; it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df to the shared folder as Parquet and reads it back: a cut of the lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracelink/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame, name: str) -> DataFrame:
    """The same; the table stays until the end of the surrounding `scratch`, if there is one."""
    out, path = stored(df, name)
    if _scopes:
        _scopes[-1].append(path)
    return out


def small_batches(spark: SparkSession, records: int = 500) -> None:
    """Bounds the rows that go to a Python worker at once, for this session: texts can be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > records:
        spark.conf.set(key, str(records))


def identified(docs: DataFrame) -> DataFrame:
    """Adds (u, v), 128 bits of hash that stand for a row: only rows of equal doc_id (null included) and text share them."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return docs.withColumns({"u": F.xxhash64(key, "text"), "v": F.xxhash64("text", F.lit(7), key)})


def named(docs: DataFrame, column: str = "doc_id") -> DataFrame:
    """Rows without an id get 0 and the flag `nameless`, as pandas would make floats of a column with nulls."""
    return docs.withColumns({"nameless": F.col(column).isNull(), column: F.coalesce(F.col(column).cast("long"), F.lit(0))})


def unnamed(rows: DataFrame, column: str = "doc_id") -> DataFrame:
    """Gives the rows that `named` has flagged their null id again."""
    return rows.withColumn(column, F.when(~F.col("nameless"), F.col(column))).drop("nameless")


class Tally:
    """Sums of counts per key, for partial aggregation in a task; it is given out whenever it has grown to `most` entries."""

    def __init__(self, columns: int, most: int = 1_000_000):
        self.columns, self.most = columns, most
        self.clear()

    def clear(self) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray, *counts: np.ndarray) -> bool:
        """Adds keys with a count in each column; true if the tally is full."""
        self.keys.append(keys)
        self.counts.append(np.stack(counts))
        self.size += len(keys)
        return self.size >= self.most

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys and (columns, keys) sums; the tally is empty after."""
        if not self.keys:
            return np.zeros(0, np.uint64), np.zeros((self.columns, 0), np.int64)
        keys, code = np.unique(np.concatenate(self.keys), return_inverse=True)
        counts = np.concatenate(self.counts, axis=1)
        self.clear()
        return keys, np.stack([np.bincount(code, c, len(keys)) for c in counts]).astype(np.int64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base, modulo 2**64."""
    global _powers
    while len(_powers) < n:
        step = np.uint64(pow(_BASE, len(_powers), 2**64))
        _powers = np.concatenate([_powers, _powers * step])
    return _powers[:n]


#: A random 64-bit value for each byte, so that the polynomial does not run over small numbers.
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def scan_words(texts: list[str], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts at once.

    Returns (buffer, starts, ends, hashes, bounds): UTF-8 bytes of the texts joined by newlines (A-Z lower-cased on
    request), byte offsets and 64-bit hashes of the words, and bounds, so that words bounds[i]:bounds[i + 1] are text i's.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    if lower:
        buf = LOWER[buf]
    return buf, *hashed_runs(buf, SPACE[buf], raw)


def hashed_runs(buf: np.ndarray, gap: np.ndarray, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes, bounds) of the runs of buf outside of `gap`; raw: the texts, each followed by a gap."""
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(gap) and not gap[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    text_end = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, np.int64)
    bounds = np.concatenate([[0], np.searchsorted(starts, text_end)]).astype(np.int64)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64), bounds
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    inside = np.flatnonzero(~gap)
    offset = np.arange(len(inside)) - np.repeat(first, lengths)
    terms = BYTE_VALUE[buf[inside]] * powers(int(lengths.max()) + 1)[offset]
    return starts, ends, mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64)), bounds


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive word hashes; run i starts at word i."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - n + 1 + k])
    return out


def slabs(texts, most: int = 1_000_000):
    """Cuts a sequence of texts into runs (start, stop) of about `most` characters, so that arrays stay small."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


#: ASCII bytes that are no letters; every byte from 0x80 on counts as part of a letter.
NO_LETTER = np.ones(256, bool)
NO_LETTER[65:91] = NO_LETTER[97:123] = NO_LETTER[128:] = False


def letter_words(texts: list[str], with_words: bool = False):
    """Hashes of the runs of letters in texts, and bounds as in scan_words; with_words adds a function from place to word."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    starts, ends, hashes, bounds = hashed_runs(buf, NO_LETTER[buf], raw)
    if with_words:
        return hashes, bounds, lambda i: buf[starts[i] : ends[i]].tobytes().decode("utf-8", "replace")
    return hashes, bounds
