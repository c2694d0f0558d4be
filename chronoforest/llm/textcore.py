"""Vectorised text primitives over Arrow buffers, and small session helpers.

A "word" is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]`` after A-Z are
lower-cased; it is identified by a 64-bit polynomial hash of its bytes.  All
work runs on whole slices of an Arrow string column (concatenated UTF-8 bytes
plus offsets), so no Python object is made per word.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once in a worker; a longer single text forms a slice of its own.
SLICE_BYTES = 2 << 20

#: Bits of the bitmaps that spare texts a shuffle, whatever the input's size: 1 MB.
FILTER_BITS = 1 << 23

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the polynomial base, modulo 2**64."""
    global _POW
    if len(_POW) < n:
        with np.errstate(over="ignore"):
            _POW = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 4096), _BASE)]).astype(np.uint64), dtype=np.uint64)
    return _POW[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (two multiply-xorshift rounds)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; a null reads as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary()) if col.type != pa.large_binary() else col
    if col.null_count:
        col = col.fill_null(b"")
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[col.offset : col.offset + len(col) + 1] if offs else np.zeros(len(col) + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = int(offsets[0]) if len(offsets) else 0
    hi = int(offsets[-1]) if len(offsets) else 0
    return raw[lo:hi], offsets - lo


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch by rows so that each part holds about ``limit`` bytes of text, or one row."""
    if not batch.num_rows:
        return
    _, offsets = column_bytes(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


class Words:
    """Words of a slice: ``hash``, byte ``start`` and ``length``, owning ``doc`` row and ``first`` word of each row."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        n_docs = len(offsets) - 1
        solid = ~_SPACE[raw]
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[offsets[:-1]] = True
        edge[len(raw)] = True
        begins = solid & edge[:-1]
        if len(raw):
            begins[1:] |= solid[1:] & ~solid[:-1]
            ends = solid & edge[1:]
            ends[:-1] |= solid[:-1] & ~solid[1:]
        else:
            ends = begins
        self.start = np.flatnonzero(begins)
        self.length = np.flatnonzero(ends) + 1 - self.start
        self.first = np.searchsorted(self.start, offsets)
        self.n_docs = n_docs
        self.count = np.diff(self.first)
        if len(self.start):
            body = _LOWER[raw[solid]]
            at = np.concatenate([[0], np.cumsum(self.length)[:-1]])
            inside = np.arange(len(body)) - np.repeat(at, self.length)
            with np.errstate(over="ignore"):
                self.hash = mix(np.add.reduceat(_BYTE[body] * powers(int(self.length.max()))[inside], at))
        else:
            self.hash = np.zeros(0, np.uint64)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.count)


def words_of(batch: pa.RecordBatch, text: str = "text") -> Words:
    return Words(*column_bytes(batch.column(batch.schema.get_field_index(text))))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hashes of the ``k``-word windows of one text; a shorter text is one window; none without words."""
    if not len(h):
        return h
    k = min(k, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mix(out + h[i : len(h) - k + 1 + i] * np.uint64(2 * i + 0x2545F491))
    return out


def binary_column(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder under the cluster's ``spark.checkpoint.dir``.  Where that is unset a local session, whose executors are
    the driver, has its own; on a cluster no machine's folder would do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later reads neither recompute nor need the writers.

    The write's shuffle files go as soon as it ends, so that the stages of an operator don't add up on disk.
    """
    spark = df.sparkSession
    path, flag = shared_dir(spark, what), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(flag, None)
    spark.conf.set(flag, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(flag)
        else:
            spark.conf.set(flag, before)
    return spark.read.schema(df.schema).parquet(path)


def tasks_for(df: DataFrame, at_least: int = 1) -> int:
    """A partition count that follows the session's setting."""
    return max(at_least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def remainder(col: str, mod: int):
    """crc32 of the key written as text, modulo ``mod``: the folds of the learned operators."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(mod))


def row_slices(batch: pa.RecordBatch, text: str = "text", rows: int = 256, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """slices() with at most ``rows`` rows each."""
    for part in slices(batch, text, limit):
        for at in range(0, part.num_rows, rows):
            yield part.slice(at, min(rows, part.num_rows - at))


def trim() -> None:
    """Give memory that a worker has freed back to the system; workers live on between stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        return


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values[offsets[i]:offsets[i+1]]``, empty segments included."""
    c = np.concatenate([[0], np.cumsum(values)])
    return c[offsets[1:]] - c[offsets[:-1]]


def byte_ngram_counts(raw: np.ndarray, offsets: np.ndarray, orders: tuple[int, ...], buckets: int) -> np.ndarray:
    """(rows x buckets) counts of hashed byte n-grams of lower-cased texts; n-grams don't cross rows."""
    n_docs = len(offsets) - 1
    low = _LOWER[raw].astype(np.uint32)
    doc = np.repeat(np.arange(n_docs, dtype=np.int64) * buckets, np.diff(offsets))
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(raw))
    out = np.zeros(n_docs * buckets, np.int64)
    shift = np.uint32(32 - (buckets - 1).bit_length())
    h = np.zeros(len(raw), np.uint32)
    with np.errstate(over="ignore"):
        for n in range(1, max(orders) + 1):
            h = h[: len(low) - n + 1] * np.uint32(0x01000193) + low[n - 1 :] + np.uint32(1) if len(low) >= n else h[:0]
            if n in orders and len(h):
                ok = left[: len(h)] >= n
                g = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                b = ((g ^ (g >> np.uint32(13))) * np.uint32(0xC2B2AE35)) >> shift
                out += np.bincount((doc[: len(h)] + b)[ok], minlength=len(out))
    return out.reshape(n_docs, buckets)


def pack(*arrays: np.ndarray) -> bytes:
    """Unsigned arrays as byte planes behind a small header: the high planes of small numbers are runs of zeros, which
    the shuffle's and Parquet's compression removes."""
    parts = [np.uint32(len(arrays)).tobytes()]
    for a in arrays:
        a = np.ascontiguousarray(a)
        code = {"u1": 1, "u2": 2, "u4": 4, "u8": 8, "f8": 9}[a.dtype.str[1:]]
        parts.append(np.array([code, len(a)], np.uint32).tobytes())
        parts.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    return b"".join(parts)


def unpack(data: bytes) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(data, np.uint32, 1)[0]), 4, []
    for _ in range(n):
        code, size = (int(x) for x in np.frombuffer(data, np.uint32, 2, at))
        kind = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64, 9: np.float64}[code]
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(data, np.uint8, size * width, at + 8).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(-1))
        at += 8 + size * width
    return out


def remove(df: DataFrame) -> None:
    """Delete a table made by stored()."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for f in {name.rpartition("/")[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(conf).delete(path, True)


def flagged(rows: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with ``_hit``: true for every row whose ``on`` is in ``ids``, and for few others.

    A bitmap of FILTER_BITS bits, in rows of 32,768, tells; its size doesn't depend on the input, so it is broadcast.  It
    spares rows a shuffle; what must be exact is decided by a join of the rows that hit.
    """
    bit = F.pmod(F.xxhash64(*on), F.lit(FILTER_BITS)) + 1
    maps = ids.select(bit.alias("_b")).groupBy(F.bitmap_bucket_number("_b").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_b")).alias("_map"))
    cells = rows.withColumn("_b", bit).withColumn("_at", F.bitmap_bit_position("_b")).withColumn("_bucket", F.bitmap_bucket_number("_b"))
    byte = F.conv(F.hex(F.expr("substring(_map, cast(_at div 8 AS int) + 1, 1)")), 16, 10).cast("int")
    joined = cells.join(F.broadcast(maps), "_bucket", "left").withColumn("_byte", F.coalesce(byte, F.lit(0)))
    hit = F.expr("shiftright(_byte, cast(_at % 8 AS int))").bitwiseAND(F.lit(1)) == 1
    return joined.withColumn("_hit", hit).select(*rows.columns, "_hit")


def drop_rows(rows: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` without those whose ``on`` is in ``gone``; only rows that may be are shuffled.  A null never matches."""
    f = flagged(rows, gone, on)
    sure = f.where("NOT _hit").drop("_hit")
    return sure.unionByName(f.where("_hit").drop("_hit").join(gone.select(*on), on, "left_anti").select(rows.columns))
