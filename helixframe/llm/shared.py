"""Plumbing shared by the training-data operators.

Text reaches the operators as Arrow buffers: one UTF-8 byte array and one offset array for a
whole record batch, so that numpy works on millions of bytes at a time without a Python object
per document.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``. Only a local master may go without and gets one of its own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir is unset: on {master} it must name a folder that all executors see")
        folder = "file://" + tempfile.mkdtemp(prefix="helixframe-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what ``materialize`` wrote; only for frames that nothing still to be computed reads."""
    for df in frames:
        path = getattr(df, "scratch_path", None)
        if path:
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_buckets(docs: DataFrame, text: str, size: int = 16 << 20) -> int:
    """How many buckets hold ``size`` bytes of text each; one a shuffle partition at least."""
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return max(partitions(docs.sparkSession), -(-total // size))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, one more than rows) of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.empty(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_ranges(offsets: np.ndarray, limit: int):
    """Consecutive row ranges ``[a, b)`` of at most ``limit`` bytes, or one row where it is longer."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every input bit over the word. Works in place on a copy."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), np.uint64)
    out[1:] = np.uint64(base)
    return np.cumprod(out, dtype=np.uint64)


BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
#: One pseudo-random 64-bit value per byte.
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
#: The ASCII white space that separates words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_POWERS: dict[int, np.ndarray] = {}


def cached_powers(base: int, n: int) -> np.ndarray:
    """powers(base, n) from one array per base, which grows as needed."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        _POWERS[base] = powers(base, max(n, 1 << 16))
    return _POWERS[base][:n]


def trim() -> None:
    """Give freed memory back to the system, so that an idle worker does not hold what its last task needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def by_batch(run):
    """A mapInArrow function that trims when its task ends."""

    def trimmed(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return trimmed


def by_group(run):
    """The same for applyInArrow."""

    def trimmed(table: pa.Table) -> pa.Table:
        out = run(table)
        trim()
        return out

    return trimmed


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of values[t] * BASE**t over i <= t < j, modulo 2**64."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * cached_powers(BASE, len(values)), out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end], independent of where the range stands."""
    return mix((sums[end] - sums[start]) * cached_powers(INVERSE, len(sums))[start])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word, a maximal run without ASCII white space inside one row."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    first[edge] |= solid[edge]
    last[edge - 1] |= solid[edge - 1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def crc_bucket(modulus: int):
    """crc32 of doc_id written as decimal text, modulo; null where doc_id is null."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int = 1 << 21):
    """Byte ranges that cut no word and hold about ``limit`` bytes: (lo, hi, row boundaries inside, first row).

    Ranges end at row ends, and inside a longer row after white space, so that arrays over one range
    stay small however long a text is. A range without white space goes on to the next one.
    """
    for a, b in row_ranges(offsets, limit):
        lo, hi = int(offsets[a]), int(offsets[b])
        if hi - lo <= limit or b - a > 1:
            yield lo, hi, offsets[a : b + 1] - lo, a
            continue
        while lo < hi:
            cut = min(lo + limit, hi)
            while cut < hi and not SPACE[data[cut - 1]]:
                gap = np.flatnonzero(SPACE[data[cut : cut + 4096]])
                cut = cut + int(gap[0]) + 1 if len(gap) else min(cut + 4096, hi)
            yield lo, cut, np.array([0, cut - lo]), a
            lo = cut


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool, bounds: bool = False):
    """Hash of every word and the index of each row's first word; with ``bounds`` also the words' byte ranges."""
    hashes, starts, ends = [], [], []
    counts = np.zeros(len(offsets) - 1, np.int64)
    for lo, hi, inner, row in pieces(data, offsets):
        part = data[lo:hi]
        if lower:
            part = LOWER[part]
        start, end, where = words(part, inner)
        hashes.append(range_hash(prefix_sums(BYTE_VALUE[part]), start, end))
        counts[row : row + len(inner) - 1] += np.bincount(where, minlength=len(inner) - 1)
        if bounds:
            starts.append(start + lo)
            ends.append(end + lo)
    first = np.zeros(len(offsets), np.int64)
    np.cumsum(counts, out=first[1:])
    out = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    if not bounds:
        return out, first
    empty = np.empty(0, np.int64)
    return out, first, np.concatenate(starts) if starts else empty, np.concatenate(ends) if ends else empty


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` hashes, by its first place; runs over row ends included."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    size = len(hashes) - n + 1
    total = np.zeros(size, np.uint64)
    for k, factor in enumerate(powers(BASE, n + 1)[1:]):
        total += hashes[k : k + size] * factor
    return mix(total)
