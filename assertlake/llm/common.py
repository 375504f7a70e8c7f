"""Shared pieces of the training-data operators: the shared folder, Arrow batches, vectorised words."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that are looked at together; a longer document is looked at alone.
SLICE_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: `[^\x20\x09-\x0D]+`
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 1 << 64)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The paths that this session has written to, in order.
WRITTEN: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. Without that setting a session on one machine gets a folder of its own; on a cluster it's an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        top = "file://" + tempfile.mkdtemp(prefix="assertlake-")
        spark.conf.set("spark.checkpoint.dir", top)
    WRITTEN.append(f"{top}/{name}-{uuid.uuid4().hex}")
    return WRITTEN[-1]


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads it again."""
    path = shared_dir(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> int:
    """A mark for removed(): what was written before it stays."""
    return len(WRITTEN)


def deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def removed(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes what was written since a mark but for the last keep paths. A result that is still to be computed from it must be saved before."""
    gone = WRITTEN[since : len(WRITTEN) - keep]
    for path in gone:
        deleted(spark, path)
    del WRITTEN[since : since + len(gone)]


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that are run here leave no shuffle files behind: what they write is read again, not they."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Bytes of a table, as its files have them, for each part.
PART_BYTES = 128 << 20


def parts(spark: SparkSession, *tables: DataFrame) -> int:
    """The number of shuffle partitions, or more where the tables are large."""
    size = sum(int(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for t in tables)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-size // PART_BYTES)) if size < 1 << 60 else least  # unknown sizes are huge


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores as it takes to clash with no column (names of any case are one to Spark)."""
    taken = {c.lower() for c in columns}
    return [next(n for n in (name + "_" * k for k in range(len(taken) + 1)) if n.lower() not in taken) for name in names]


#: What a worker process keeps from task to task, by name.
KEPT: dict[str, object] = {}


def settled(run: Callable, keep: str | None = None) -> Callable:
    """run, a function of Arrow batches, in a worker that holds nothing else: what earlier tasks kept (but for keep) and freed memory go back
    to the system before it and after it, since workers live on and share the executor's memory with it."""

    def settle() -> None:
        for name in [k for k in KEPT if k != keep]:
            del KEPT[name]
        pa.set_memory_pool(pa.system_memory_pool())  # the default one keeps what it frees
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # not the GNU library
            pass

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        yield from run(batches)
        settle()

    return whole


def _powers(kind: str, n: int) -> np.ndarray:
    """_R or its inverse to the powers 0 to n - 1, modulo 2**64."""
    have = _POWERS[kind]
    if len(have) < n:
        step = np.full(n, _R if kind == "up" else _R_INV, np.uint64)
        step[0] = 1
        have = _POWERS[kind] = np.multiply.accumulate(step)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values; one-to-one."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of several texts: byte offsets start and end, 64-bit hash, and first[i] to first[i + 1] are those of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = word[data]
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        cuts = offsets[(offsets > 0) & (offsets < n)]
        start[cuts] = inside[cuts]
        self.start = np.flatnonzero(start)
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[cuts - 1] = inside[cuts - 1]
        self.end = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, offsets)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A polynomial of a word's bytes modulo 2**64, mixed with its length."""
        n = len(self.data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _powers("up", n), out=total[1:])
        h = (total[self.end] - total[self.start]) * _powers("down", n + 1)[self.start]
        return mix(h ^ mix((self.end - self.start).astype(np.uint64)))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole texts of about limit bytes."""
    data, offsets = buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive values."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = (out ^ h[i : i + m]) * np.uint64(_R) + np.uint64(i + 1)
        out ^= out >> np.uint64(29)
    return mix(out)


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... count[i] numbers for each i, end to end."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    return at + np.arange(total)
