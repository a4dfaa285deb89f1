"""Benchmark decontamination by the q-gram lemma.

Texts are compared as letters and digits: A-Z lower-cased, every run of other ASCII characters one space. A
passage of m bytes within k edits of a benchmark item shares at least m + 1 - q - k * q of the item's q-grams
with it, all within k + 1 neighbouring diagonals. Diagonals are cut into bands that overlap by k, so one band
holds them all; bands with enough shared q-grams are verified by banded alignment.

The benchmark is a stated query set: it is sent in blocks of bounded size, and each block meets all documents.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.llm.common import LOWER, U, mix, row_key, steps, texts_of

Q = 12
#: Edits allowed for each byte of an item.
EDIT_SHARE = 0.05
#: Bytes of items that one block holds at most, one longer item aside. A block as built has about 30 times as many.
BLOCK_BYTES = 2 << 20
#: Pairs of equal q-grams that are listed at once.
PAIRS = 1 << 20
#: Cells of one row of the alignments that are made at once.
CELLS = 1 << 18

PLAIN = LOWER.copy()
for _b in range(128):
    if not chr(_b).isalnum():
        PLAIN[_b] = 0x20


def plain(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts in plain form, a zero byte after each, and where each begins (and one more)."""
    n = len(offsets) - 1
    flat = np.zeros(len(data) + n, np.uint8)
    flat[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))] = PLAIN[data]
    flat[offsets[1:] + np.arange(n)] = 0  # a text's own zero bytes have become spaces
    space = flat == 0x20
    keep = np.ones(len(flat), bool)
    keep[1:] = ~(space[1:] & (space[:-1] | (flat[:-1] == 0)))  # runs, and spaces that begin a text
    if n:
        keep[0] = not space[0]
    keep[:-1] &= ~(space[:-1] & (flat[1:] == 0))
    place = np.concatenate([[0], np.cumsum(keep)])
    return flat[keep], place[np.concatenate([[0], offsets[1:] + np.arange(1, n + 1)])]


def grams(flat: np.ndarray) -> np.ndarray:
    """A hash of the Q bytes at each place."""
    n = len(flat) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    flat = np.ascontiguousarray(flat)
    first = np.ndarray((n,), "<u8", flat, 0, (1,))
    last = np.ndarray((n,), "<u4", flat, 8, (1,))
    return mix(first ^ (last.astype(np.uint64) * U(0x9E3779B97F4A7C15)))


class Items:
    """One block of the benchmark."""

    def __init__(self, ids: list, texts: list[bytes]):
        data = np.frombuffer(b"".join(texts), np.uint8)
        flat, at = plain(data, np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64))
        self.ids = ids
        self.texts = [flat[a : b - 1].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        size = np.array([len(x) for x in self.texts])
        self.budget = np.minimum((size * EDIT_SHARE).astype(int), np.maximum(size - Q, 0) // Q)
        self.least = size + 1 - Q - self.budget * Q
        self.width = 1 << np.ceil(np.log2(np.maximum(self.budget, 1))).astype(int)
        codes, owner, place = [], [], []
        for i, text in enumerate(self.texts):
            own = grams(np.frombuffer(text, np.uint8))
            codes.append(own)
            owner.append(np.full(len(own), i, np.int32))
            place.append(np.arange(len(own), dtype=np.int32))
        codes, owner, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (codes, owner, place))
        order = np.argsort(codes, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.codes, self.first = np.unique(codes[order], return_index=True)
        self.codes = self.codes.astype(np.uint64)
        self.first = np.append(self.first, len(order)).astype(np.int32)
        #: A match and the bands around it lie within so many bytes.
        self.reach = int((size + 2 * self.width + 4 * self.budget).max(initial=0)) + Q
        bits = max(16, int(8 * max(1, len(self.codes))).bit_length())
        self.shift = U(64 - bits)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[self.codes >> self.shift] = True

    def hits(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in flat whose q-gram some item has, and which q-gram it is."""
        codes = grams(flat)
        at = np.flatnonzero(self.maybe[codes >> self.shift])
        nth = np.minimum(np.searchsorted(self.codes, codes[at]), max(len(self.codes) - 1, 0))
        same = self.codes[nth] == codes[at] if len(self.codes) else np.zeros(0, bool)
        return at[same], nth[same]

    def matches(self, flat: np.ndarray, begin: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, item, edits) of verified matches, the best of each pair.

        Where q-grams recur in an item and in a text, pairs of them are many more than either; they are listed for a stretch of
        text at a time. Stretches overlap by more than a match and its bands take, so each match lies whole in one."""
        at, nth = self.hits(flat)
        best: dict[tuple[int, int], int] = {}
        pairs = np.concatenate([[0], np.cumsum(self.first[nth + 1] - self.first[nth], dtype=np.int64)])
        i = 0
        while i < len(at):
            j = max(int(np.searchsorted(pairs, pairs[i] + PAIRS, "right")) - 1, int(np.searchsorted(at, at[i] + 2 * self.reach)))
            self._stretch(flat, begin, at[i:j], nth[i:j], best)
            i = j if j >= len(at) else max(int(np.searchsorted(at, at[j] - self.reach)), i + 1)
        return [(t, it, e) for (t, it), e in best.items()]

    def _stretch(self, flat: np.ndarray, begin: np.ndarray, at: np.ndarray, nth: np.ndarray, best: dict[tuple[int, int], int]) -> None:
        n = self.first[nth + 1] - self.first[nth]
        every = np.repeat(self.first[nth] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at, item, place = np.repeat(at, n), self.owner[every], self.place[every]
        text = np.searchsorted(begin, at, "right") - 1
        diagonal = at - begin[text] - place  # below 0 where an item's start lies before a text's
        width, budget = self.width[item], self.budget[item]
        band = diagonal // width
        also = diagonal - band * width < budget  # the band before reaches as far
        # One number for each text, item and band: how often it comes is how many q-grams they share.
        first_text, first_band = int(text.min()), int(band.min()) - 1
        n_bands = int(band.max()) - first_band + 1
        code = ((text - first_text) * len(self.texts) + item) * n_bands + (band - first_band)
        code, shared = np.unique(np.concatenate([code, code[also] - 1]), return_counts=True)
        pair, band = np.divmod(code, n_bands)
        owner, item = np.divmod(pair, len(self.texts))
        enough = shared >= self.least[item]
        passed = np.stack([owner + first_text, item, band + first_band], 1)[enough]
        for it in np.unique(passed[:, 1]).tolist():
            self._verify(flat, begin, it, passed[passed[:, 1] == it], best)

    def _verify(self, flat: np.ndarray, begin: np.ndarray, it: int, bands: np.ndarray, best: dict[tuple[int, int], int]) -> None:
        """Aligns one item within its bands (text, item, band), many at a time; a text that holds it as it is needs no more."""
        item, k, w = self.texts[it], int(self.budget[it]), int(self.width[it])
        texts, low = bands[:, 0], bands[:, 2] * w
        end = begin[texts + 1] - 1
        starts = np.minimum(begin[texts] + np.maximum(low - k, 0), end)
        ends = np.minimum(begin[texts] + np.maximum(low + w + 2 * k + len(item), 0), end)
        for t, a, b in zip(texts.tolist(), starts.tolist(), ends.tolist(), strict=True):
            if best.get((t, it)) != 0 and item in flat[a:b].tobytes():
                best[t, it] = 0
        left = np.flatnonzero([best.get((t, it)) != 0 for t in texts.tolist()]) if k else []
        step = max(1, CELLS // (w + 5 * k + 1))
        for i in range(0, len(left), step):
            use = left[i : i + step]
            for t, edits in zip(texts[use].tolist(), aligned(item, flat, starts[use], ends[use], k).tolist(), strict=True):
                if edits <= min(k, best.get((t, it), k)):
                    best[t, it] = edits


def aligned(item: bytes, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int) -> np.ndarray:
    """For each region of flat the least edits between item and a substring of it, budget + 1 for more. A region is a band's:
    as much longer than the item as the band is wide, so one row of the alignment holds all its diagonals."""
    a, sizes = np.frombuffer(item, np.uint8), (ends - starts)[:, None]
    out = np.full(len(starts), budget + 1)
    # Column j of row i is region place i + j - budget: diagonals from -budget to what the regions leave.
    width = max(int(sizes.max(initial=0)) - len(a), 0) + 2 * budget + 1
    far = np.int32(len(a) + int(sizes.max(initial=0)) + 1)
    column = np.arange(width, dtype=np.int32)
    who = np.arange(len(starts))
    place = column - budget
    row = np.where((place >= 0) & (place <= sizes), np.int32(0), far)
    padded = np.append(flat, np.zeros(1, np.uint8))
    edge = np.full((len(starts), 1), far, np.int32)
    for i in range(1, len(a) + 1):
        place = i + column - budget
        own = padded[np.clip(starts[who][:, None] + place - 1, 0, len(flat))]
        outside = (place < 0) | (place > sizes[who])
        now = np.where((place >= 1) & ~outside, row + (own != a[i - 1]), far)
        now = np.minimum(now, np.concatenate([row[:, 1:], edge[: len(row)]], 1) + 1)
        now[outside] = far
        row = np.minimum.accumulate(now - column, 1) + column
        row[outside] = far
        open_ = row.min(1) <= budget
        if not open_.all():
            row, who = row[open_], who[open_]
            if not len(who):
                return out
    out[who] = row.min(1)
    return out


def blocks(benchmark: DataFrame, text: str = "text", ident: str = "item_id", limit: int = BLOCK_BYTES):
    """The benchmark's rows in blocks of at most limit bytes, one after the other."""
    ids, texts, held = [], [], 0
    for row in benchmark.select(F.col(ident).cast("bigint"), F.col(text)).where(F.col(text).isNotNull()).toLocalIterator():
        raw = row[1].encode()
        if ids and held + len(raw) > limit:
            yield Items(ids, texts)
            ids, texts, held = [], [], 0
        ids.append(row[0])
        texts.append(raw)
        held += len(raw)
    if ids:
        yield Items(ids, texts)


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", ident: str = "doc_id", item_text: str = "text", item: str = "item_id") -> DataFrame:
    """doc_id, item_id, edits: a row for each row of docs and each item that it holds within the item's edit budget.

    Null and empty texts hold nothing. Items of fewer than Q plain bytes are no evidence and aren't searched: see unsearched. Rows
    that repeat on either side repeat their matches. Null ids stay null. Other columns are not read.
    """
    rows = docs.select(F.col(ident).cast("bigint").alias("doc_id"), row_key(text, ident).alias("key"), F.col(text).alias("text"))
    spark = docs.sparkSession
    found = []
    for block in blocks(benchmark, item_text, item):
        shared = spark.sparkContext.broadcast(block)

        def scan(batches, shared=shared):
            items = shared.value
            for batch in batches:
                for part in steps(batch, "text"):
                    texts = texts_of(part.column("text"))
                    got = items.matches(*plain(texts.data, texts.offsets))
                    at = pa.array([t for t, _, _ in got], pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(at), pa.array([items.ids[i] for _, i, _ in got], pa.int64()), pa.array([e for _, _, e in got], pa.int32())], ["doc_id", "item_id", "edits"])

        found.append(rows.mapInArrow(scan, "doc_id bigint, item_id bigint, edits int"))
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], "doc_id bigint, item_id bigint, edits int")


def unsearched(benchmark: DataFrame, text: str = "text", ident: str = "item_id") -> DataFrame:
    """item_id, plain_bytes of the items that leaks() doesn't look for, null ones included: a word or a number of an answer
    stands in any text, so finding it there says nothing."""
    plain_text = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " "))
    return benchmark.select(F.col(ident).cast("bigint").alias("item_id"), F.octet_length(plain_text).alias("plain_bytes")).where(F.col("plain_bytes") < Q)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item: str = "item_id") -> DataFrame:
    """docs without the rows that hold an item (see leaks). Rows pass where they lie; nothing is shuffled."""
    for block in blocks(benchmark, item_text, item):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches, shared=shared):
            items = shared.value
            for batch in batches:
                for part in steps(batch, text):
                    texts = texts_of(part.column(text))
                    stay = np.ones(part.num_rows, bool)
                    stay[[t for t, _, _ in items.matches(*plain(texts.data, texts.offsets))]] = False
                    yield part.filter(pa.array(stay))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
