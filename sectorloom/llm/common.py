"""What the text operators share: the shared folder, scratch tables, word hashing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import ctypes.util
import gc
import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch sent to Python, so that long texts don't pile up in a worker.
BATCH_BYTES = 2 << 20
BATCH_ROWS = 2000
#: Bytes of input for each file of a derived table, so that no table consists of tiny files.
FILE_BYTES = 16 << 20
#: Files of a small table at most, whatever the estimate; it is boundless for rows that no file holds.
MOST_FILES = 100_000
#: Bytes of text whose words are hashed in one vectorised step.
PIECE_BYTES = 1 << 20

_SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


Batches = Iterator[pa.RecordBatch]


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """The same function of a task's batches, whose worker gives back at its end what it doesn't use.

    A worker serves one task after another; without this its peaks would add up over the stages of a job.
    """

    @wraps(run)
    def task(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            release()

    return task


def lean_arrays(run: Callable[[pa.Array], pa.Array]) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """The same for a function of one column's batches."""

    def task(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield run(batch)
        release()

    return task


def release() -> None:
    """Hands freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(ctypes.util.find_library("c"))
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset, a temporary one, which only a local master can share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sectorloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Folders and catalog tables of this session that go when the driver ends; results may be read until then.
_left: list[tuple[SparkSession, str, str | None]] = []


def leaves(spark: SparkSession, path: str, table: str | None = None) -> None:
    """Has the folder, and the catalog's table in it, removed when the driver ends."""
    _left.append((spark, path, table))


def remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def clean() -> None:
    """Removes what is left, as far as the session still runs."""
    while _left:
        spark, path, table = _left.pop()
        if SparkContext._active_spark_context is not spark.sparkContext:
            continue
        with contextlib.suppress(Py4JError, OSError):
            if table:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            remove(spark, path)


def planned_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size; that of its files for a scan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


class Scratch:
    """Tables written in the shared folder, which cut lineage and outlive a lost executor.

    ``drop`` removes them once a later table has taken over what they hold; the rest go when the driver ends. ``source``: the table that they
    derive from; one kept as ``small`` has no more files than that has pieces of FILE_BYTES, or twice as many as there are cores.
    """

    def __init__(self, spark: SparkSession, source: DataFrame | None = None):
        self.spark = spark
        self.files = None if source is None else min(MOST_FILES, max(2 * spark.sparkContext.defaultParallelism, planned_bytes(source) // FILE_BYTES))
        self.root = f"{shared_dir(spark).rstrip('/')}/sectorloom-{uuid.uuid4().hex}"
        self.kept: dict[int, tuple[DataFrame, str]] = {}
        leaves(spark, self.root)

    def keep(self, df: DataFrame, small: bool = False) -> DataFrame:
        """The table as written. What makes a small one may not number its rows by partition: several meet in a task."""
        path = f"{self.root}/{uuid.uuid4().hex[:12]}"
        (df.coalesce(self.files) if small and self.files else df).write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.kept[id(out)] = (out, path)
        return out

    def tables(self) -> list[DataFrame]:
        return [t for t, _ in self.kept.values()]

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            remove(self.spark, self.kept.pop(id(t))[1])


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


# ---------------------------------------------------------------- word hashes

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(_SPACE_BYTES)] = True
_U = np.uint64
#: Words of more bytes are hashed one by one.
LONG_WORD = 32
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _piece_words(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each run of non-space bytes.

    A hash takes in a word's length and its bytes, eight at a time, with a full mix after each; that of a
    long word is a keyless BLAKE2b.
    """
    flag = np.zeros(len(b) + 2, np.int8)
    flag[1:-1] = ~_IS_SPACE[b]
    step = np.diff(flag)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    size = end - start
    padded = np.zeros(len(b) + 8, np.uint8)
    padded[: len(b)] = b
    lanes = np.ndarray(len(b) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each position on
    h = mix64(size.astype(np.uint64))
    long = size > LONG_WORD
    at = np.flatnonzero(~long)
    for i in range(0, LONG_WORD, 8):
        at = at[size[at] > i]
        if not len(at):
            break
        h[at] = mix64((h[at] * _U(0x9E3779B97F4A7C15)) ^ (lanes[start[at] + i] & _TAIL[np.minimum(size[at] - i, 8)]))
    for i in np.flatnonzero(long):
        h[i] = int.from_bytes(hashlib.blake2b(b[start[i] : end[i]], digest_size=8).digest(), "little")
    return start, end, h


def word_hashes(data: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of the words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes; A-Z count as a-z."""
    b = _LOWER[data] if lower else data
    if len(b) <= PIECE_BYTES:
        return _piece_words(b)
    parts, at = [], 0
    while at < len(b):
        cut = min(len(b), at + PIECE_BYTES)
        while cut < len(b) and not _IS_SPACE[b[cut]]:
            ahead = np.flatnonzero(_IS_SPACE[b[cut : cut + PIECE_BYTES]])
            cut = cut + int(ahead[0]) if len(ahead) else min(len(b), cut + PIECE_BYTES)
        s, e, h = _piece_words(b[at:cut])
        parts.append((s + at, e + at, h))
        at = cut
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every run of n words, in order."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = mix64(out * _U(0xD6E8FEB86659FD93) + words[i : i + len(out)])
    return out


def string_chunks(column: pa.Array | pa.ChunkedArray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts as (first row, past the last row, their bytes, offsets); nulls count as empty.

    A run holds ``most`` bytes at most, or one longer text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        last = min(last, n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def apart(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space after each, so that no word spans two, and their offsets."""
    at = np.arange(len(offsets) - 1)
    out = np.full(len(data) + len(at), 0x20, np.uint8)
    out[np.arange(len(data)) + np.repeat(at, np.diff(offsets))] = data
    return out, offsets + np.arange(len(offsets))


def text_column(df: DataFrame) -> DataFrame:
    return df.withColumn("text", F.col("text").cast("string"))
