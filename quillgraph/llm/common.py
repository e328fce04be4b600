"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import beside, cut, size_of  # noqa: F401  beside is for the operators

#: The word rule of the text contracts: runs of anything but the six ASCII white-space characters.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Only A-Z are lower-cased.
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
#: Bytes that workers take at a time.
BATCH = 4 << 20
#: Spark's limit for the bytes that it hands over at a time; the row that passes it is in, too.
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: str) -> str:
    """Lower-cases A-Z and leaves every other character alone."""
    return text.lower() if text.isascii() else text.translate(ASCII_LOWER)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Workers get rows in batches of BATCH bytes and a row at most meanwhile, not of 10,000 rows or 64 MB.

    An executor holds each batch several times outside its heap, and seldom gives that memory back. All rows are handed over.
    """
    before = spark.conf.get(BATCH_KEY)
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before) <= BATCH:
        spark.conf.set(BATCH_KEY, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(BATCH_KEY, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet into the shared folder and reads it back (see ``plans.lineage``).

    What is read has a known size, survives the loss of any executor and is never computed twice.
    """
    with small_batches(df.sparkSession):
        return cut(df, name)


def give_back() -> None:
    """Gives memory that this process has freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: gives a task's memory back to the system at its end, as Spark keeps its workers for later tasks."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return lean


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt_out(df: DataFrame, size: int = 64 << 20) -> int:
    """How many tasks to deal ``df`` out to: the session's shuffle partitions, more where each would get over ``size`` bytes of what Catalyst estimates."""
    estimate = size_of(df)
    return max(shuffle_partitions(df.sparkSession), -(-estimate // size) if estimate < 1 << 60 else 0)  # without statistics it is no size


def text_column(docs: DataFrame, column: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` only (a null text becomes empty): extra columns never reach the workers."""
    doc_id = F.col("doc_id") if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id")  # an alias would keep exchanges from being reused
    return docs.select(doc_id, F.coalesce(F.col(column).cast("string"), F.lit("")).alias("text"))


def slices(batch: pa.RecordBatch, column: str = "text", size: int = BATCH) -> Iterator[pa.RecordBatch]:
    """A batch in parts whose texts have about ``size`` bytes, so that what a part becomes fits in a worker's memory."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, end - at)
        at = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers (the public splitmix64 one)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start+1, ... of every run, one run after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
