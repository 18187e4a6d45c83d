"""What the operators of this subpackage share: the run's shared folder, word
patterns, and walking Arrow batches of text in pieces of bounded size.

Nothing here keeps state on one machine: tables that cut lineage are written as
Parquet below ``spark.checkpoint.dir``, so any executor can read them back after
another one is lost.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and the five ASCII controls from tab to carriage return.
GAP = r"[\x20\x09-\x0D]+"
#: The same characters, for translate().
GAP_CHARS = " \t\n\x0b\x0c\r"
#: UTF-8 bytes of text that one numpy step works on; longer documents go alone.
STEP_BYTES = 256 << 10

# Workers import this module: give freed batches back to the system, as a worker lives on
# beside an executor's other memory.
pa.set_memory_pool(pa.system_memory_pool())

try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):
    _libc = None

#: What stash() and new_path() have written: session, path, and the owner at that time.
_written: list[tuple[SparkSession, str, str | None]] = []
_owner: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only a local session that
    names none gets a temporary folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="twinscope-"))
    return spark.sparkContext.getCheckpointDir()


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path, _owner))
    return spark.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for files that an operator writes itself."""
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path, _owner))
    return path


@contextmanager
def owned(owner: str) -> Iterator[None]:
    """What is written inside belongs to ``owner``, and can be released apart from the rest."""
    global _owner
    before, _owner = _owner, owner
    try:
        yield
    finally:
        _owner = before


def release(owner: str | None = None) -> None:
    """Delete what has been written, or only what belongs to ``owner``; results that read
    it are then gone too."""
    for entry in [x for x in _written if owner is None or x[2] == owner]:
        _written.remove(entry)
        session, path, _ = entry
        jvm = session.sparkContext._jvm
        if jvm is None:
            continue
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _at_exit() -> None:
    try:
        release()
    except Exception:  # the gateway is gone: the session was stopped before
        pass


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete shuffle files whose plans are done with. It does so when the
    driver's JVM collects garbage, after Python has let go of the plans: twice round."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def text_batches(spark: SparkSession, rows: int = 2000, size: int = 4 << 20) -> None:
    """Have Spark send rows with texts to Python in smaller Arrow batches than numbers
    need: both sides hold a batch whole, so its size is memory in every task."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def if_small(df: DataFrame, row_bytes: int = 64, rows: int | None = None, most: int = 24 << 20) -> DataFrame:
    """``df`` marked for broadcast if its rows (counted, unless given) come to ``most``
    bytes at most; else as it is, to be joined by a shuffle."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * row_bytes <= most else df


def parts_for(spark: SparkSession, rows: int, per_part: int) -> int:
    """Partitions for ``rows`` rows: as many as the session shuffles into, or more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_part))


def text_steps(column, step: int = STEP_BYTES, rows: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces of an Arrow string or binary column: (first row, end row, bytes, row
    offsets into them). Null rows are empty. A piece holds whole rows, ``rows`` at most,
    and more than ``step`` bytes only if it is one row."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        width = np.int32
    else:
        width = np.int64
    n = len(column)
    if n == 0:
        return
    _, starts, data = column.buffers()
    at = np.frombuffer(starts, dtype=width)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(at, at[lo] + step, side="right")) - 1
        hi = min(n, lo + rows, max(hi, lo + 1))
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi
    trim()


def trim() -> None:
    """Give memory that numpy has freed back to the system, where the C library can."""
    if _libc is not None:
        _libc.malloc_trim(0)


_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of a number modulo 2^64, from two small tables."""

    STEP = 4096

    def __init__(self, base: int):
        self._base = pow(base, self.STEP, 1 << 64)
        self._low, self._high = _powers(base, self.STEP), _powers(self._base, 256)

    def _grow(self, n: int) -> None:
        if n // self.STEP >= len(self._high):
            self._high = _powers(self._base, 2 * (n // self.STEP + 1))

    def first(self, n: int) -> np.ndarray:
        self._grow(n)
        return np.multiply.outer(self._high[: n // self.STEP + 1], self._low).ravel()[:n]

    def at(self, i: np.ndarray) -> np.ndarray:
        if len(i):
            self._grow(int(i.max()))
        return self._high[i // self.STEP] * self._low[i % self.STEP]


_up, _down = _Powers(_BASE), _Powers(pow(_BASE, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a murmur finaliser)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


IS_NO_LETTER = np.ones(256, bool)
IS_NO_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def lower(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and the capital letters of Latin-1 in lower case."""
    up = (data >= 65) & (data <= 90)
    if len(data) > 1:
        up[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    return data + (up * np.uint8(32))


class Spans:
    """Hashes of any spans of one byte array, each in constant time: a prefix
    polynomial modulo 2^64. Equal spans have equal hashes wherever they lie. Texts of a
    thousand bytes and more can be made to collide in any such polynomial, so spans of
    more than ``SHORT`` bytes are hashed by XXH3."""

    SHORT = 256

    def __init__(self, data: np.ndarray):
        self._data = data
        self._sum = np.zeros(len(data) + 1, np.uint64)
        terms = mix(np.arange(1, 257, dtype=np.uint64))[data]
        terms *= _up.first(len(data))
        np.cumsum(terms, out=self._sum[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = mix((self._sum[end] - self._sum[start]) * _down.at(start) + (end - start).astype(np.uint64))
        long = np.flatnonzero(end - start > self.SHORT)
        if len(long):
            from xxhash import xxh3_64_intdigest

            out[long] = [xxh3_64_intdigest(self._data[a:b].tobytes()) for a, b in zip(start[long].tolist(), end[long].tolist())]
        return out


_IS_GAP = np.zeros(256, bool)
_IS_GAP[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray, rows: np.ndarray, is_gap: np.ndarray = _IS_GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each row) of the words in ``data``; rows are
    boundaries too. ``is_gap`` says which bytes separate words."""
    solid = ~is_gap[data]
    edge = np.empty(len(data), bool)
    if len(data):
        edge[0] = True
        edge[1:] = ~solid[:-1]
        edge[rows[:-1][rows[:-1] < len(data)]] = True
    starts = np.flatnonzero(solid & edge)
    last = np.empty(len(data), bool)
    if len(data):
        last[-1] = True
        last[:-1] = ~solid[1:]
        cut = rows[1:] - 1
        last[cut[cut >= 0]] = True
    ends = np.flatnonzero(solid & last) + 1
    return starts, ends, np.searchsorted(starts, rows)
