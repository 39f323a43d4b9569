"""What the operators share: the shared folder, written tables, and byte-level views of Arrow text."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that may be broadcast, counted first (ids and a few numbers each, some 30 MB); beyond that a shuffled join is used.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the cluster names it; one of our own only in a local session."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not set_.isDefined():
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="folio-"))
        set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
    return set_.get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> str:
    """Write ``df`` to the shared folder; lineage ends there, so a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, name))


def drop_table(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def put(store: fs.FileSystem, own: str, place: str) -> None:
    """Move a finished file to its place. Where a task that ran before has left one, that one goes: some stores don't replace."""
    if store.get_file_info(place).type != fs.FileType.NotFound:
        store.delete_file(place)
    store.move(own, place)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if a small input comes in fewer partitions; a table of many files is left as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def word_count(text: Column | str) -> Column:
    """Words in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each starts (one more at the end). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def text_chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``text_bytes`` in runs of rows of about ``limit`` bytes: first row, row after the last, bytes, offsets."""
    raw, off = text_bytes(column)
    n, at = len(off) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield at, to, raw[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


_HELD: dict = {}


def held(key: tuple, make: Callable[[], object]) -> object:
    """One large thing at a time that a worker keeps between tasks, such as an encoder with its memory."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Give up what ``held`` keeps, and give free memory back: workers live on through stages that need other things."""
    _HELD.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), base, np.uint64)
        step[0] = 1
        with np.errstate(over="ignore"):
            have = _POWERS[base] = np.multiply.accumulate(step)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (in place)."""
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Hashes:
    """64-bit hashes of any byte ranges of one buffer, from one pass over it."""

    def __init__(self, raw: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            self.prefix = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(_BYTE[raw] * _powers(_MULT, len(raw)), out=self.prefix[1:])
        self.inverse = _powers(_INV, len(raw) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (self.prefix[ends] - self.prefix[starts]) * self.inverse[starts]
            x += (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        return mixed(x)


SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and how many words stand before each text's first (one more at the end)."""
    n = len(raw)
    solid = np.zeros(n + 2, bool)
    np.logical_not(SPACE[raw], out=solid[1:-1])
    cut = np.zeros(n + 1, bool)  # a text may start or end here
    cut[off] = True
    start = np.flatnonzero(solid[1:-1] & (~solid[:-2] | cut[:-1]))
    end = np.flatnonzero(solid[1:-1] & (~solid[2:] | cut[1:])) + 1
    return start, end, np.searchsorted(start, off)
