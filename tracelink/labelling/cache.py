"""A stored cache of responses by content key.

A batch is a folder `batch=<first>-<last>-<id>` of Parquet files under key prefixes. It counts once Spark's committer has left
its mark in it, so a run that is killed loses the batch it was writing and nothing else; the next run asks for those prompts
again. Batches are numbered; of several responses to a key the one of the first batch wins. Compaction writes one batch over
the numbers of those it replaces, which are passed over from then on and deleted after, so it may be interrupted at any time.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelink.labelling.labeller import Labeller, respond

_NAME = re.compile(r"batch=(\d{10})-(\d{10})-[0-9a-f]+$")
ROWS = "key string, raw string, batch string, prefix string"


class ResponseCache:
    """Responses (key, raw) under `path`, a folder that driver and executors share. `digits`: how many first digits of a key make its
    prefix; 2 give 256 folders a batch."""

    def __init__(self, spark: SparkSession, path: str, digits: int = 2):
        self.spark, self.path, self.digits = spark, path.rstrip("/"), digits

    def _folder(self, name: str = ""):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        at, fs = self._folder()
        return sorted(n for s in (fs.listStatus(at) if fs.exists(at) else []) if _NAME.search(n := s.getPath().getName()))

    def batches(self) -> list[str]:
        """The batches that count, in order: committed, and not replaced by one over a wider range."""
        done = []
        for name in self._names():
            at, fs = self._folder(f"{name}/_SUCCESS")
            if fs.exists(at):
                done.append((name, *map(int, _NAME.search(name).groups())))
        within = lambda a, b: b[1] <= a[1] and a[2] <= b[2] and (b[2] - b[1], b[0]) > (a[2] - a[1], a[0]) and b[2] > b[1]
        return [a[0] for a in done if not any(within(a, b) for b in done if b is not a)]

    def read(self, prefixes: Sequence[str] | None = None) -> DataFrame:
        """(key, raw), one row a key; prefixes: only the folders of these."""
        names = self.batches()
        if not names:
            return self.spark.createDataFrame([], "key string, raw string")
        rows = self.spark.read.schema(ROWS).option("basePath", self.path).parquet(*[f"{self.path}/{n}" for n in names])
        if prefixes is not None:
            rows = rows.where(F.col("prefix").isin(list(prefixes)))
        return rows.groupBy("key").agg(F.min_by("raw", "batch").alias("raw"))

    def find(self, keys: DataFrame) -> DataFrame:
        """The cached responses to keys (key); only folders of prefixes that occur are read."""
        some = keys.select(F.col("key")).where("key IS NOT NULL")
        prefixes = [r[0] for r in some.select(F.substring("key", 1, self.digits)).distinct().collect()]  # 16 ** digits at most
        return self.read(prefixes).join(some, "key", "left_semi")

    def _write(self, rows: DataFrame, first: int, last: int) -> None:
        placed = rows.select("key", "raw", F.substring("key", 1, self.digits).alias("prefix")).repartition("prefix")
        placed.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").partitionBy("prefix").parquet(f"{self.path}/batch={first:010d}-{last:010d}-{uuid.uuid4().hex}")

    def append(self, rows: DataFrame) -> None:
        """Commits one batch of (key, raw). Rows without a key or response, such as failures, are not stored."""
        last = max((int(_NAME.search(n)[2]) for n in self._names()), default=-1)
        good = rows.where("key IS NOT NULL AND raw IS NOT NULL").groupBy("key").agg(F.min("raw").alias("raw"))
        self._write(good, last + 1, last + 1)

    def fill(self, prompts: DataFrame, labeller: Labeller, rows_a_batch: int = 100_000, tries: int = 5) -> int:
        """Asks for what is not cached of (key, prompt), about rows_a_batch prompts a batch, and commits each batch; the
        number of batches that were needed.

        What is not cached is made once and put beside the cache until all batches are committed.
        """
        wanted = prompts.select("key", "prompt").where("key IS NOT NULL")
        if self.batches():
            wanted = wanted.join(self.read().select("key"), "key", "left_anti")
        name = f"asked-{uuid.uuid4().hex}"
        wanted.dropDuplicates(["key"]).write.parquet(f"{self.path}/{name}")
        missing = self.spark.read.schema("key string, prompt string").parquet(f"{self.path}/{name}")
        parts = -(-missing.count() // rows_a_batch)
        part = F.pmod(F.xxhash64("key"), F.lit(max(parts, 1)))
        try:
            for i in range(parts):
                self.append(respond(missing.where(part == i), labeller, tries, distinct=True))
        finally:
            at, fs = self._folder(name)
            fs.delete(at, True)
        return parts

    def compact(self) -> None:
        """Puts all batches into one and deletes those it replaces."""
        names = self.batches()
        if len(names) > 1:
            numbers = [tuple(map(int, _NAME.search(n).groups())) for n in names]
            self._write(self.read(), min(a for a, _ in numbers), max(b for _, b in numbers))
            for name in names:
                at, fs = self._folder(name)
                fs.delete(at, True)

    def clean(self) -> list[str]:
        """Deletes folders of batches that were never committed or have been replaced; run it while nothing writes. Returns their names."""
        kept, gone = set(self.batches()), []
        for name in self._names():
            if name not in kept:
                at, fs = self._folder(name)
                fs.delete(at, True)
                gone.append(name)
        return gone
