"""Shared pieces: flat text batches, vectorised hashes, shared checkpoints.

Words are maximal runs of bytes other than space, tab, LF, VT, FF and CR. All of those are ASCII, so
words can be cut on UTF-8 bytes without decoding.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from rangeloom.session import shared_dir

#: Java regex for one word.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that one numpy step handles; a longer single text is a step of its own.
STEP_BYTES = 2 << 20

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

U = np.uint64


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/rangeloom/{spark.sparkContext.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """Write df into the shared folder and read it back: lineage ends here, and no executor owns the rows."""
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def mounted_dir(spark: SparkSession) -> str:
    """A new folder in the shared one, as a path that files can be mapped from: the folder must be mounted, as NFS or the like
    is, on the driver and on all executors."""
    path = f"{_own_dir(spark)}/{uuid.uuid4().hex}"
    plain = path.removeprefix("file:")
    if "://" in plain.removeprefix("//"):
        raise ValueError(f"files can't be mapped from {path}: spark.checkpoint.dir must be a mounted folder here")
    plain = "/" + plain.lstrip("/")
    os.makedirs(plain, exist_ok=True)
    return plain


def discard(df: DataFrame) -> None:
    """Delete what written() left for df; nothing may read it afterwards."""
    _delete(df.sparkSession, df.written_to)


def clear(spark: SparkSession) -> None:
    """Delete all that written() left in this application. Results that were not saved can't be read afterwards."""
    _delete(spark, _own_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: Spans with more bytes are hashed one by one.
LONG_SPAN = 64


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each span of bytes: eight at a time, the mixed state carried from one to the next. Unlike one
    polynomial modulo 2**64 it has no inputs that collide whatever the seed."""
    sizes = ends - starts
    out = mix(sizes.astype(np.uint64) + U(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    live = np.flatnonzero((sizes > 0) & (sizes <= LONG_SPAN))
    for at in range(0, LONG_SPAN, 8):
        live = live[sizes[live] > at]
        if not len(live):
            break
        drop = np.maximum(8 - (sizes[live] - at), 0).astype(np.uint64) * U(8)
        chunk = (eight[starts[live] + at] << drop) >> drop
        out[live] = mix((out[live] ^ chunk) * U(0xD6E8FEB86659FD93) + U(0xA0761D6478BD642F))
    for i in np.flatnonzero(sizes > LONG_SPAN).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    return out


class Rolling:
    """Polynomial hashes of short spans of a sequence of well-mixed values, from one prefix sum modulo 2**64. Their structure
    shows in spans of a thousand values and more that take two values alone, so what they say is verified."""

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.base = int(rng.integers(0, 1 << 61)) * 8 + 3
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up = self._powers(self.base, n)
            self.down = self._powers(self.inverse, n)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(np.uint64))


class Texts:
    """Texts laid end to end in one byte array; text i is data[offsets[i]:offsets[i + 1]]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte start and end of each word, and where in them each text begins (one more than texts)."""
        inside = ~SEPARATOR[self.data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cut = self.offsets[(self.offsets > 0) & (self.offsets < len(inside))]
        first[cut] = inside[cut]
        last[cut - 1] = inside[cut - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


def text_array(column: pa.Array) -> pa.Array:
    return column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column


def texts_of(column: pa.Array) -> Texts:
    """A string column as Texts; null counts as empty."""
    column = text_array(column)
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return Texts(data, offsets - offsets[0])


def steps(batch: pa.RecordBatch, text: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about limit bytes of text each, so that temporaries stay bounded."""
    if not batch.num_rows:
        return
    ends = texts_of(batch.column(text)).offsets[1:]
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def long_array(x: np.ndarray) -> pa.Array:
    """uint64 or integer values as the bigint column of the same bits."""
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


#: A table is broadcast up to this size, which is measured first.
BROADCAST_BYTES = 8 << 20


def small_side(df: DataFrame, bytes_of_row) -> DataFrame:
    """df, a written table, marked for broadcast if its rows, of bytes_of_row bytes (a column), fit BROADCAST_BYTES."""
    from pyspark.sql import functions as F

    size = df.agg(F.coalesce(F.sum(bytes_of_row), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def row_key(text: str = "text", ident: str = "doc_id"):
    """With the id, what tells rows apart: rows of one id but other texts stay apart, exact repeats fall together."""
    from pyspark.sql import functions as F

    return F.xxhash64(F.col(ident), F.col(text))


class Sieve:
    """A Bloom filter of 64-bit values with a fixed largest size; too full, it only lets more values pass."""

    SEGMENT = 1 << 16  # bytes
    SEEDS = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9))

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def size_for(expected: int, limit: int) -> int:
        """Bytes: about 10 bits a value, a power of two, at most limit."""
        need = max(Sieve.SEGMENT, expected * 10 // 8)
        return min(1 << (need - 1).bit_length(), 1 << (limit.bit_length() - 1))

    @classmethod
    def slots(cls, values: np.ndarray, size: int) -> list[np.ndarray]:
        return [mix(values ^ s) & U(size * 8 - 1) for s in cls.SEEDS]

    def passes(self, values: np.ndarray) -> np.ndarray:
        out = np.ones(len(values), bool)
        for at in self.slots(values, len(self.bits)):
            out &= (self.bits[at >> U(3)] >> (at & U(7)).astype(np.uint8)) & 1 == 1
        return out

    @classmethod
    def of(cls, values: DataFrame, expected: int, limit: int = 32 << 20) -> Sieve:
        """From a one-column frame of bigints. The driver receives the filter alone, limit bytes at most."""
        size, segment = cls.size_for(expected, limit), cls.SEGMENT

        def fill(batches):
            bits = np.zeros(size, np.uint8)
            for batch in batches:
                for at in cls.slots(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), size):
                    np.bitwise_or.at(bits, at >> U(3), np.uint8(1) << (at & U(7)).astype(np.uint8))
            yield from cls.pieces({i: part for i, part in enumerate(bits.reshape(-1, segment)) if part.any()})

        rows = values.mapInArrow(fill, "segment int, bits binary").repartition("segment").mapInArrow(cls.merge, "segment int, bits binary")
        return cls.gathered(rows, size)

    @classmethod
    def pieces(cls, parts: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for i, part in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["segment", "bits"])

    @classmethod
    def merge(cls, batches) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, bits in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = np.frombuffer(bits.as_buffer(), np.uint8)
                parts[i] = parts[i] | got if i in parts else got.copy()
        yield from cls.pieces(parts)

    @classmethod
    def gathered(cls, rows: DataFrame, size: int) -> Sieve:
        bits = np.zeros(size, np.uint8)
        for row in rows.toLocalIterator():
            bits[row.segment * cls.SEGMENT : (row.segment + 1) * cls.SEGMENT] = np.frombuffer(row.bits, np.uint8)
        return cls(bits)
