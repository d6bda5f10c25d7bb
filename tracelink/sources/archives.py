"""Tar archives read member by member."""

from __future__ import annotations

import itertools
import tarfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Tar files are a whole number of these.
BLOCK = 512
#: Archives that a task reads one after another, where there are many.
AT_ONCE = 256
VOLUMES = "source string, raw binary"


class _Blocks:
    """A readable stream over the blocks of one archive as they come."""

    def __init__(self, blocks: Iterator[bytes]):
        self.blocks, self.held = blocks, bytearray()

    def read(self, n: int) -> bytes:
        while len(self.held) < n:
            block = next(self.blocks, None)
            if block is None:
                break
            self.held += block
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def archive_members(spark: SparkSession, path: str, inside: str = "/data/xml/", ending: str = ".xml", block: int = BLOCK) -> DataFrame:
    """(archive, name, raw): the files of tar archives (plain, or compressed as their ending says) under `inside` with the given
    `ending`; archive is a number for each of the archives that path (a file, folder or pattern) names.

    Hadoop's input format decompresses an archive and hands it on block by block, from any store that Spark reads; a task holds
    one member of it at a time, never an archive. An archive is a stream, which one task reads; what it holds is dealt out as it comes.
    block: bytes read at once; archives must be a whole number of them (512 always are, 10240 if they were written in full
    records, as by default).
    """
    conf = {"fixedlengthinputformat.record.length": str(block), "mapreduce.input.fileinputformat.split.minsize": str((1 << 63) - 1)}
    hadoop = "org.apache.hadoop"
    blocks = spark.sparkContext.newAPIHadoopFile(path, f"{hadoop}.mapreduce.lib.input.FixedLengthInputFormat", f"{hadoop}.io.LongWritable", f"{hadoop}.io.BytesWritable", conf=conf)

    # Small archives share tasks: where a key, the block's place in its file, is 0, the next archive begins.
    tasks = max(4 * spark.sparkContext.defaultParallelism, blocks.getNumPartitions() // AT_ONCE)

    def members(task: int, blocks: Iterator[tuple[int, bytes]]) -> Iterator[Row]:
        numbered = itertools.accumulate(blocks, lambda last, block: (last[0] + (block[0] == 0), block[1]), initial=(0, b""))
        for number, one in itertools.groupby(itertools.islice(numbered, 1, None), key=lambda x: x[0]):
            stream = _Blocks(bytes(b) for _, b in one)
            with tarfile.open(fileobj=stream, mode="r|") as tar:
                for m in tar:
                    if m.isfile() and inside in f"/{m.name}" and m.name.endswith(ending):
                        yield Row(archive=(task << 32) + number, name=m.name, raw=tar.extractfile(m).read())
                    tar.members = []  # the library keeps all it has seen otherwise

    rows = spark.createDataFrame(blocks.coalesce(tasks).mapPartitionsWithIndex(members), "archive long, name string, raw binary")
    return rows.repartition("archive", "name")


def volumes(spark: SparkSession, path: str, inside: str = "/data/xml/", most: int | None = None) -> DataFrame:
    """XML volumes (source, raw) of archives, of each archive the first `most` by name."""
    rows = archive_members(spark, path, inside)
    if most is not None:
        # Names alone decide which members stay.
        first = rows.groupBy("archive").agg(F.slice(F.array_sort(F.collect_set("name")), 1, most).alias("names"))
        rows = rows.join(first.select("archive", F.explode("names").alias("name")), ["archive", "name"], "left_semi")
    return rows.select(F.substring_index("name", "/", -1).alias("source"), "raw")
