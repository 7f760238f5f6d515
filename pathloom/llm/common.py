"""Shared plumbing: tables, the shared work folder, and written intermediate tables."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Row groups of intermediate tables: writers hold one each in memory.
ROW_GROUP_BYTES = 16 << 20
#: Characters of text that a Python function takes up at once; a longer text stands alone.
BLOCK_CHARS = 4_000_000
#: Bytes that a worker's memory of words may take.
CACHE_BYTES = 24 << 20
SPACE = "\t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or on one machine, where it is unset, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="pathloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder and read again: lineage ends there, and a lost executor costs nothing before it."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """name, or what becomes of it by adding underscores until df has no such column in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table made by written()."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def words(text: str | None) -> list[str]:
    """Runs of characters other than ASCII white space, in order."""
    if not text:
        return []
    for c in SPACE:
        if c in text:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


_LOWER = {i: i + 32 for i in range(65, 91)}


def lower_ascii(text: str) -> str:
    """A-Z to a-z, everything else as it is."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of so many rows for the jobs run inside, where a row can hold two long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def blocks_of(batch: pa.RecordBatch, text: int, chars: int = BLOCK_CHARS) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts in column `text` have about `chars` bytes together."""
    at = total = 0
    sizes = batch.column(text).nbytes // max(1, len(batch))
    if sizes * len(batch) <= chars:
        if len(batch):
            yield batch
        return
    for i, t in enumerate(batch.column(text)):
        total += len(t.as_buffer() or b"") if t.is_valid else 0
        if total > chars:
            yield batch.slice(at, i + 1 - at)
            at, total = i + 1, 0
    if at < len(batch):
        yield batch.slice(at)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *clear: Callable[[], None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a worker gives back what it held: workers are used again, by other operators too."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for f in clear:
                f()
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not this C library
                pass

    return task


class Bounded(dict):
    """A memory of what was worked out for words, emptied when it would take more than `limit` bytes."""

    def __init__(self, limit: int = CACHE_BYTES):
        super().__init__()
        self.limit, self.held = limit, 0

    def keep(self, word: str, value, size: int) -> None:
        """Remember value, which takes about size bytes beside the word."""
        self.held += size + 2 * len(word) + 160
        if self.held > self.limit:
            self.clear()
            self.held = size + 2 * len(word) + 160
        self[word] = value

    def clear(self) -> None:
        super().clear()
        self.held = 0
