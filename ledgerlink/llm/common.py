"""Helpers shared by the training-data operators: durable cuts of lineage, and vectorised views of text batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64

# Large arrays go back to the system when they are freed, so workers that wait between stages are small.
with contextlib.suppress(OSError, AttributeError):
    ctypes.CDLL("libc.so.6").mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD

#: Text is handled in slices of about so many bytes, which bounds the memory of a task whatever the batch holds.
SLICE_BYTES = 2 << 20

_own_dirs: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where it is unset and all runs on this machine."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    key = id(spark.sparkContext)
    if key not in _own_dirs:
        _own_dirs[key] = tempfile.mkdtemp(prefix="ledgerlink-")
        atexit.register(shutil.rmtree, _own_dirs[key], ignore_errors=True)
    return _own_dirs[key]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop_cuts(*tables: DataFrame) -> None:
    """Delete tables made by cut() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def buckets(spark: SparkSession, least: int = 1) -> int:
    """Partitions of a shuffle of packed rows; follows the session's setting, so a cluster sizes it as any other shuffle."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def slices(lengths: np.ndarray, most: int = SLICE_BYTES):
    """(first, last+1) runs of rows of about `most` bytes; a longer row stands alone."""
    i, n = 0, len(lengths)
    ends = np.cumsum(lengths, dtype=np.int64)
    while i < n:
        j = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right"))
        j = max(j, i + 1)
        yield i, j
        i = j


def arrow_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and its n+1 offsets; null is empty."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


# --- hashes of byte ranges -------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_SEEDS = (U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93))
_SIZE = U64(0xA24BAED4963EE407)
_TAIL = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)


def chunk_view(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position, as one number; zeros follow the buffer."""
    data = np.append(buf, np.zeros(8, np.uint8))
    return np.ndarray((len(buf) + 1,), np.dtype("<u8"), data.data, 0, (1,))


def range_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0, view: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of byte ranges of one buffer: equal bytes have equal hashes wherever they stand.

    Each chunk of eight bytes is mixed with its place before the chunks are added, so no algebra over letters gives
    collisions. Two seeds make 128 bits.
    """
    if not len(start):
        return np.zeros(0, U64)
    view = chunk_view(buf) if view is None else view
    size = (end - start).astype(np.int64)
    salt = _SEEDS[seed]
    h = mix(((view[start] & _TAIL[np.minimum(size, 8)]) ^ salt) + size.astype(U64) * _SIZE)
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) >> 3
        first = np.cumsum(more) - more
        step = np.arange(int(more.sum())) - np.repeat(first, more) + 1
        place = mix(np.arange(int(more.max()) + 2, dtype=U64) * _SIZE + salt)
        at = np.repeat(start[long], more) + 8 * step
        left = np.minimum(np.repeat(size[long], more) - 8 * step, 8)
        h[long] = mix(h[long] + np.add.reduceat(mix((view[at] & _TAIL[left]) ^ place[step]), first))
    return h


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def word_ranges(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word [^\\x20\\x09-\\x0D]+; words never cross rows."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~_SPACE[buf]
    first = np.zeros(len(buf), bool)
    first[offsets[:-1][offsets[:-1] < len(buf)]] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | first[1:]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | first[1:]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def csr_gather(flat: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The ranges [first, first+length) of flat, one after another."""
    total = int(length.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(length)
    return flat[np.repeat(first - (ends - length), length) + np.arange(total)]
