"""Lines that many documents share, removed by two Bloom filters and an exact count of what passes them.

A first scan deals the hashes of keys out by filter segment. A segment's task sets a hash in the once-seen
filter, or, if that has it already, in the twice-seen filter. A second scan sends only lines whose key passes
the twice-seen filter; their documents are counted exactly, and the largest doc_id keeps the line.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.llm.common import Sieve, U, mix, row_key, text_array, written

BLANK = b" \t\n\x0b\x0c\r"
LOWERED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: A key's least code points, the documents that make it common.
MIN_CHARS, MIN_DOCS = 20, 3
#: Largest size of the twice-seen filter. More lines than it can tell apart make it pass more, and the exact count decides.
FILTER_BYTES = 64 << 20
#: Hashes that one shuffled row of the first scan holds at most.
PACK = 1 << 16


def key_of(line: bytes) -> bytes:
    return line.strip(BLANK).translate(LOWERED)


def n_chars(raw: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return len(raw) - sum(map((0x80).__le__, raw)) + sum(map((0xC0).__le__, raw)) if not raw.isascii() else len(raw)


def digests(text: bytes, min_chars: int) -> list[tuple[int, bytes]]:
    """Place and 128-bit digest of the lines whose keys are long enough."""
    out = []
    for i, line in enumerate(text.split(b"\n")):
        if len(line) >= min_chars and len(key := key_of(line)) >= min_chars and n_chars(key) >= min_chars:
            out.append((i, xxhash.xxh3_128_digest(key)))
    return out


def _rows(docs: DataFrame, text: str, ident: str) -> DataFrame:
    return docs.select(F.col(ident).cast("bigint").alias("doc_id"), row_key(text, ident).alias("key"), F.col(text).alias("text"))


def _texts(batch: pa.RecordBatch):
    return (memoryview(x.as_buffer()).tobytes() if x.is_valid else b"" for x in text_array(batch.column("text")).cast(pa.large_binary()))


def twice_seen(rows: DataFrame, min_chars: int, filter_bytes: int = FILTER_BYTES) -> Sieve:
    """Passes every key that two documents hold, and few others while the filter is large enough."""
    # About one line in 64 bytes of text; the filter's size follows the text up to its limit.
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    size = Sieve.size_for(n_bytes // 64, filter_bytes)
    segments = size // Sieve.SEGMENT

    def deal(batches):
        for batch in batches:
            own = []
            for text in _texts(batch):
                own.extend({d[:8] for _, d in digests(text, min_chars)})
            # A hash twice is enough to say "twice", so a batch sends each two times at most.
            values, times = np.unique(np.frombuffer(b"".join(own), np.uint64), return_counts=True)
            values = np.concatenate([values, values[times > 1]])
            segment = (mix(values) >> U(40)) % U(segments)
            order = np.argsort(segment, kind="stable")
            values, segment = values[order], segment[order]
            cuts = np.flatnonzero(np.diff(segment)) + 1
            parts = np.split(values, cuts)
            names = segment[np.concatenate([[0], cuts])] if len(values) else segment
            for i in range(0, len(names), PACK):
                yield pa.RecordBatch.from_arrays([pa.array(names[i : i + PACK].astype(np.int32)), pa.array([x.tobytes() for x in parts[i : i + PACK]], pa.binary())], ["segment", "bits"])

    def fill(batches):
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = np.frombuffer(raw.as_buffer(), np.uint64)
                first = once.setdefault(segment, np.zeros(Sieve.SEGMENT, np.uint8))
                values, times = np.unique(values, return_counts=True)
                again = Sieve(first).passes(values) | (times > 1)
                _put(first, values[~again])
                if again.any():
                    _put(first, values[again])
                    _put(twice.setdefault(segment, np.zeros(Sieve.SEGMENT, np.uint8)), values[again])
        yield from Sieve.pieces(twice)

    dealt = rows.select("text").mapInArrow(deal, "segment int, bits binary")
    return Sieve.gathered(dealt.repartition("segment").mapInArrow(fill, "segment int, bits binary"), size)


def _put(bits: np.ndarray, values: np.ndarray) -> None:
    for at in Sieve.slots(values, len(bits)):
        np.bitwise_or.at(bits, at >> U(3), np.uint8(1) << (at & U(7)).astype(np.uint8))


class Segmented:
    """A filter of segments, each a Sieve of its own; a value belongs to one."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.segments = bits, len(bits) // Sieve.SEGMENT

    def passes(self, values: np.ndarray) -> np.ndarray:
        base = ((mix(values) >> U(40)) % U(self.segments)) * U(Sieve.SEGMENT)
        out = np.ones(len(values), bool)
        for at in Sieve.slots(values, Sieve.SEGMENT):
            out &= (self.bits[base + (at >> U(3))] >> (at & U(7)).astype(np.uint8)) & 1 == 1
        return out


def common_lines(docs: DataFrame, text: str = "text", ident: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """doc_id, key (see row_key), places array<int>: lines to drop, from 0, of the documents that have any.
    min_docs must be 2 at least. Rows of one doc_id count as one document; a null doc_id is a document and the smallest."""
    if min_docs < 2:
        raise ValueError("the filters tell keys of two documents and more")
    rows = _rows(docs, text, ident)
    shared = docs.sparkSession.sparkContext.broadcast(twice_seen(rows, min_chars, filter_bytes).bits)

    def suspects(batches):
        sieve = Segmented(shared.value)
        for batch in batches:
            owner, place, digest = [], [], []
            for i, text in enumerate(_texts(batch)):
                for at, d in digests(text, min_chars):
                    owner.append(i)
                    place.append(at)
                    digest.append(d)
            use = np.flatnonzero(sieve.passes(np.frombuffer(b"".join(x[:8] for x in digest), np.uint64)))
            take = pa.array(np.array(owner, np.int64)[use])
            yield pa.RecordBatch.from_arrays([pa.array([digest[i] for i in use], pa.binary()), batch.column("doc_id").take(take), batch.column("key").take(take), pa.array(np.array(place, np.int32)[use])], ["line", "doc_id", "key", "place"])

    found = written(rows.mapInArrow(suspects, "line binary, doc_id bigint, key bigint, place int"))
    # Distinct pairs first: a line that a third of all documents hold is spread over its documents, then summed.
    holders = found.select("line", "doc_id").distinct().groupBy("line").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last"))
    common = written(holders.where(F.col("docs") >= min_docs).select("line", "last"))
    drop = found.join(common, "line").where(~F.col("doc_id").eqNullSafe(F.col("last")))
    return drop.groupBy("key", "doc_id").agg(F.collect_set("place").alias("places"))


def without_common_lines(docs: DataFrame, text: str = "text", ident: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, filter_bytes: int = FILTER_BYTES, with_kept: bool = True) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 and, unless with_kept is off, kept: one row for each row of docs.

    A null or empty text is one empty line. Rows that repeat are one document, so they alone don't make a line
    common; all of them lose or keep it. Null ids stay null. Other columns are not read.
    """
    found = common_lines(docs, text, ident, min_chars, min_docs, filter_bytes)
    rows = _rows(docs, text, ident)
    joined = rows.join(found.withColumnRenamed("doc_id", "__id"), (rows.key == found.key) & rows.doc_id.eqNullSafe(F.col("__id")), "left").select("doc_id", "text", "places")

    def cut(batches):
        for batch in batches:
            n_lines, n_dropped, sha, kept = [], [], [], []
            for text, places in zip(_texts(batch), batch.column("places").to_pylist(), strict=True):
                lines, gone = text.split(b"\n"), set(places or ())
                stay = b"\n".join([x for i, x in enumerate(lines) if i not in gone]) if gone else text
                n_lines.append(len(lines))
                n_dropped.append(len(gone))
                sha.append(hashlib.sha256(stay).hexdigest())
                kept.append(stay if with_kept else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(sha), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept"])

    out = joined.mapInArrow(cut, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string, kept string")
    return out if with_kept else out.drop("kept")
