"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: the longest run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_serial = itertools.count()


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Keep batches to and from Python small, as rows hold whole texts, sets or files: so memory follows the longest rows, not their number."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it; a local session may name none and takes one for tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "/tmp/checkpoints"
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread of files, not a
    recomputation.  Names are unique per application and call.  The driver's
    garbage of the step goes at once.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{next(_serial)}"
    df.write.mode("overwrite").parquet(path)
    release_driver(spark)
    return spark.read.schema(df.schema).parquet(path)


def frugal(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn``, after which the worker gives freed memory back to the system: workers outlive their tasks, and an executor's share is small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            release()

    return run


def release() -> None:
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def release_driver(spark: SparkSession) -> None:
    """The driver's Python and its JVM give freed memory back to the system: a run of many steps else keeps the room of its largest one.

    A full collection also shrinks the heap; without it the heap of a run of many small plans grows to its limit.
    """
    release()
    spark.sparkContext._jvm.java.lang.System.gc()


def free_name(columns: Sequence[str], name: str) -> str:
    """``name``, with underscores added until no column has it (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The strings of a column; null counts as the empty text."""
    return [t if t is not None else "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def bytes_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as the empty text."""
    column = batch.column(batch.schema.get_field_index(name))
    return [t if t is not None else b"" for t in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


class WordHashes(dict):
    """word bytes -> 64-bit hash, kept between documents; ``trim`` bounds it."""

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        self[word] = value
        return value

    def trim(self, most: int = 150_000) -> None:
        if len(self) > most:
            self.clear()


def hash_words(words: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
