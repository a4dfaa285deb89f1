"""A language model in an Elias-Fano n-gram trie.

Level 1 is the vocabulary: the words' 64-bit hashes in order, their places the word ids, with exact counts.
Level n holds n-grams as children of level n - 1: pointers, a monotone sequence, say where each context's
children begin, and the children are word ids relative to their context, made monotone by the context's base.
A query is a successor search within the context's children. A child has the discounted share of its context,
(c - D) / c(context), and a context the share left for shorter contexts, both as 16-bit logarithms. With u the
words before w,  p(w | u) = share(u w) + left(u) * p(w | shorter u),  and p(w) = (c + 0.5) / (N + 0.5 * (V + 1)).

Counts cover all training texts. An n-gram of two words and more becomes a child from min_count on; what the
others had stays in their context's left share.

A level is cut into segments of neighbouring contexts, by how often those occur; a context with more next words than
a segment holds has several, by ranges of words. One task builds one segment from counts that were shuffled once, and
writes its raw file into the folder that the cluster shares. The driver keeps a directory, one row a segment. Workers
map the segments that their texts touch, from the one copy, and keys are relative to their segment.
"""

from __future__ import annotations

import functools
import math
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rangeloom.llm.common import LOWER, Texts, U, mounted_dir, span_hashes, steps, texts_of
from rangeloom.llm.eliasfano import Builder, Sequence, Shape

ORDER = 3
MIN_COUNT = 2
DISCOUNT = 0.75
#: Steps of the 16-bit logarithms: 1 / SCALE of a power of ten.
SCALE = 4096
SEED = 21
#: n-grams a task holds before it sends them on.
HELD = 1 << 20
#: Occurrences of contexts that a segment is cut for: no more children than that, but for chance among ranges of words.
SEGMENT = 1 << 21
#: Small corpora have segments of at least so many occurrences, or as many segments as shuffle partitions.
LEAST_SEGMENT = 1 << 16


def learned_from(ident: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(ident).cast("string"), F.lit("null")).cast("binary")) % 5 != 1


def code(share: np.ndarray) -> np.ndarray:
    """Quantised -log10 of shares; nothing is smaller than 65535 steps."""
    return np.clip(np.rint(-np.log10(np.maximum(share, 1e-16)) * SCALE), 0, 65535).astype(np.uint16)


def left_code(given: np.ndarray) -> np.ndarray:
    """What contexts leave that gave this much to their children; one without children leaves all, code 0."""
    return np.maximum(code(1 - np.minimum(given, 1 - 1e-9)), 1)


#: The end's hash: a line feed's, which no word holds.
@functools.cache
def end_hash() -> np.uint64:
    return span_hashes(np.array([10], np.uint8), np.array([0]), np.array([1]), SEED)[0]


DECODED = 10.0 ** (-np.arange(65536) / SCALE)
DECODED[65535] = 0.0


class ByHash:
    """Segments of the vocabulary: leading bits of the hash."""

    def __init__(self, bits: int):
        self.n, self.width = 1 << bits, 64 - bits

    def place(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (hashes >> U(self.width)).astype(np.int64), hashes & U((1 << self.width) - 1)

    def universe(self, segment: int) -> int:
        return 1 << self.width

    def contexts(self, segment: int) -> int:
        return 0


class ByContext:
    """Segments of the children of contexts. Range i holds the contexts from begins[i] to the next range's; it is one segment,
    or, where it is a single context that occurs often (mass), parts[i] segments of equally wide ranges of words."""

    def __init__(self, begins: np.ndarray, mass: np.ndarray, contexts: int, words: int, quota: int):
        self.begins, self.mass, self.words = begins, mass, words
        self.parts = np.maximum(-(-np.minimum(mass, words) // quota), 1)
        self.first = np.cumsum(self.parts) - self.parts
        self.sizes = np.diff(begins, append=contexts)
        self.n = int(self.parts.sum())
        self.width = (int(self.sizes.max(initial=1)) * words).bit_length()

    def place(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segments, and keys relative to them."""
        i = np.searchsorted(self.begins, context, "right") - 1
        part = word * self.parts[i] // self.words
        low = -(-part * self.words // self.parts[i])
        return self.first[i] + part, ((context - self.begins[i]) * self.words + word - low).astype(np.uint64)

    def range_of(self, segment: int) -> int:
        return int(np.searchsorted(self.first, segment, "right")) - 1

    def universe(self, segment: int) -> int:
        i = self.range_of(segment)
        return int(self.sizes[i]) * self.words if self.parts[i] == 1 else self.words // int(self.parts[i]) + 1

    def contexts(self, segment: int) -> int:
        return int(self.sizes[self.range_of(segment)])


class File:
    """The layout of one segment's file of n keys."""

    def __init__(self, n: int, universe: int, contexts: int):
        self.keys, self.contexts = Shape(n, universe), contexts
        parts = self.keys.arrays("keys")
        if contexts:
            self.pointers = Shape(contexts + 1, n + 1)
            parts |= self.pointers.arrays("pointers") | {"share": ("<u2", n), "left": ("<u2", contexts)}
        else:
            parts["count"] = ("<u8", n)
        self.layout, at = {}, 0
        for part, (kind, size) in parts.items():
            self.layout[part] = (at, kind, size)
            at += -(-size * np.dtype(kind).itemsize // 64) * 64
        self.bytes = at

    def arrays(self, raw: np.ndarray) -> dict[str, np.ndarray]:
        return {k: raw[at : at + size * np.dtype(kind).itemsize].view(kind) for k, (at, kind, size) in self.layout.items()}


class Mapped:
    """A segment as a worker sees it: pages of the file, read on demand."""

    def __init__(self, path: str, file: File):
        a = file.arrays(np.memmap(path, np.uint8, "r"))
        self.keys = Sequence(file.keys, a, "keys")
        if file.contexts:
            self.pointers, self.share, self.left = Sequence(file.pointers, a, "pointers"), a["share"], a["left"]
        else:
            self.count = a["count"]

    def children(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the children of contexts of this segment begin and end in it."""
        return self.pointers.get(context).astype(np.int64), self.pointers.get(context + 1).astype(np.int64)


class Level:
    """The directory of a level: its segments' files and sizes. built holds what their tasks said, in order of segment."""

    def __init__(self, address: ByHash | ByContext, built: list):
        self.address, self.name = address, uuid.uuid4().hex
        self.paths = {r.segment: r.path for r in built}
        self.sizes = np.zeros(address.n, np.int64)
        for r in built:
            self.sizes[r.segment] = r.n
        self.first = np.cumsum(self.sizes) - self.sizes
        self.n = int(self.sizes.sum())
        if isinstance(address, ByContext):
            # A context of several segments leaves what all of them together didn't take.
            given = np.zeros(len(address.begins))
            for r in built:
                given[address.range_of(r.segment)] += r.given
            self.left = {i: left_code(given[i : i + 1])[0] for i in np.flatnonzero((address.parts > 1) & (given > 0)).tolist()}

    def open(self) -> Opened:
        if self.name not in _opened:
            _opened[self.name] = Opened(self)
        return _opened[self.name]


_opened: dict[str, Opened] = {}


def in_order(segment: np.ndarray, key: np.ndarray, width: int) -> np.ndarray:
    """The order by segment, then key of width bits: one sort of both in one value where they fit."""
    if width + int(segment.max(initial=0)).bit_length() <= 64:
        return np.argsort((segment.astype(np.uint64) << U(width)) | key)
    return np.lexsort((key, segment))


def firsts(segment: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which entries of sorted ones differ from those before them."""
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (segment[1:] != segment[:-1])
    return new


def runs(segment: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """segment, begin and end of each run of a sorted array."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(segment)) + 1, [len(segment)]]).tolist()
    for a, b in zip(cuts, cuts[1:]):  # noqa: B905
        if a < b:
            yield int(segment[a]), a, b


class Opened:
    """A level as a worker sees it. Equal queries are asked once, those of one segment together."""

    def __init__(self, level: Level):
        self.level, self.address, self.segments = level, level.address, {}

    def segment(self, i: int) -> Mapped | None:
        if i not in self.segments:
            path, at = self.level.paths.get(i), self.address
            self.segments[i] = Mapped(path, File(int(self.level.sizes[i]), at.universe(i), at.contexts(i))) if path else None
        return self.segments[i]

    def _asked(self, segment: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct queries in order, and where each query is among them."""
        order = in_order(segment, key, self.address.width)
        segment, key = segment[order], key[order]
        new = firsts(segment, key)
        back = np.empty(len(order), np.int64)
        back[order] = np.cumsum(new) - 1
        return segment[new], key[new], back

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word ids, -1: unknown, and counts."""
        segment, key, back = self._asked(*self.address.place(hashes))
        ids, count = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
        for i, a, b in runs(segment):
            if file := self.segment(i):
                at = file.keys.find(key[a:b])
                got = np.flatnonzero(at >= 0)
                ids[a + got] = self.level.first[i] + at[got]
                count[a + got] = file.count[at[got]]
        return ids[back], count[back]

    def look(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each context (-1: none) and word (-1: unknown): the child's place or -1, its share, and what the context leaves."""
        child, share, left = np.full(len(context), -1, np.int64), np.zeros(len(context)), np.ones(len(context))
        use = np.flatnonzero(context >= 0)
        if not len(use):
            return child, share, left
        known = word[use] >= 0
        segment, key, back = self._asked(*self.address.place(context[use], np.maximum(word[use], 0)))
        places, shares, leaves = np.full(len(key), -1, np.int64), np.zeros(len(key)), np.ones(len(key))
        for i, a, b in runs(segment):
            split = self.address.range_of(i)
            if split in self.level.left:
                leaves[a:b] = DECODED[self.level.left[split]]
            if file := self.segment(i):
                if split not in self.level.left:
                    leaves[a:b] = DECODED[file.left[(key[a:b] // U(self.address.words)).astype(np.int64)]]
                at = file.keys.find(key[a:b])
                got = np.flatnonzero(at >= 0)
                places[a + got] = self.level.first[i] + at[got]
                shares[a + got] = DECODED[file.share[at[got]]]
        left[use] = leaves[back]
        child[use] = np.where(known, places[back], -1)
        share[use] = np.where(known, shares[back], 0)
        return child, share, left


class Tokens:
    """Word ids of texts, an end after each text; a word that training doesn't have is -1."""

    def __init__(self, texts, vocabulary: Opened | None):
        lower = Texts(LOWER[texts.data], texts.offsets)
        starts, ends, at = lower.words()
        hashes = span_hashes(lower.data, starts, ends, SEED)
        self.begin = at + np.arange(len(at))  # of each text's tokens, one end each
        place = np.arange(len(starts)) + np.repeat(np.arange(len(texts)), np.diff(at))
        self.hashes = np.full(len(starts) + len(texts), end_hash())
        self.hashes[place] = hashes
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.begin))
        if vocabulary:
            self.ids, self.count = vocabulary.words(self.hashes)

    def after(self, places: np.ndarray) -> np.ndarray:
        """Each token's context, when places are those of the n-grams that end at each token; -1 at a text's start."""
        out = np.full(len(places), -1, np.int64)
        out[1:] = np.where(self.text[1:] == self.text[:-1], places[:-1], -1)
        return out


class Model:
    def __init__(self, levels: list[Level], total: int):
        self.levels, self.total = levels, total
        self.unknown = total + 0.5 * (levels[0].n + 1)

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.5) / self.unknown

    def score(self, tokens: Tokens, levels: list[Opened]) -> tuple[np.ndarray, np.ndarray]:
        """Count and log10 probability of each token."""
        p, places = self.unigram(tokens.count), tokens.ids
        for level in levels[1:]:
            places, share, left = level.look(tokens.after(places), tokens.ids)
            p = share + left * p
        return tokens.count, np.log10(np.minimum(p, 1.0))  # rounding may lift a certain word above one


def _built(rows: DataFrame, keys_of, address: ByHash | ByContext, folder: str, quota: int, min_count: int, discount: float) -> list:
    """Counts the keys that keys_of(part) gives, as segments and keys in them, and builds each segment's file in one task.

    Tasks send packed arrays, sorted and added up, so a frequent key is one entry for each send. What comes back is a row a
    segment: path, n, what a context of several segments gave here, and cuts of its keys for the level below (see _cuts)."""
    width = address.width

    def send(batches):
        held, size = [], 0
        for batch in batches:
            for part in steps(batch, "text"):
                segment, key = keys_of(part)
                held.append(merged([(segment, key, np.ones(len(key), np.int64))], width))
                size += len(held[-1][1])
                if size > HELD:
                    held = [merged(held, width)]
                    size = len(held[0][1])
                    if size > HELD // 2:
                        yield packed(*held[0])
                        held, size = [], 0
        if size:
            yield packed(*merged(held, width))

    def build(batches):
        held: dict[int, list] = {}
        size: dict[int, int] = {}
        for batch in batches:
            for s, keys, n in zip(batch.column("segment").to_pylist(), batch.column("keys"), batch.column("n"), strict=True):
                key = np.cumsum(from_planes(keys.as_buffer(), "<u8"), dtype=np.uint64)
                held.setdefault(s, []).append((np.full(len(key), s), key, from_planes(n.as_buffer(), "<u4").astype(np.int64)))
                size[s] = size.get(s, 0) + len(key)
                if size[s] > 4 * HELD:
                    held[s] = [merged(held[s], width)]
                    size[s] = len(held[s][0][1]) // 2  # what is merged already counts half, so that merges stay few
        for s in list(held):
            _, key, n = merged(held.pop(s), width)
            total = int(n.sum())
            path, n, given = _write(folder, address, s, key, n, min_count, discount)
            begins, mass = _cuts(n, quota)
            yield pa.RecordBatch.from_arrays(
                [pa.array([s]), pa.array([path]), pa.array([len(n)]), pa.array([total]), pa.array([given]), pa.array([begins.tobytes()], pa.binary()), pa.array([mass.tobytes()], pa.binary())],
                ["segment", "path", "n", "total", "given", "begins", "mass"],
            )

    sent = rows.mapInArrow(send, "segment int, keys binary, n binary").repartitionById(address.n, F.col("segment"))
    built = sent.mapInArrow(build, "segment long, path string, n long, total long, given double, begins binary, mass binary")
    return sorted(built.collect(), key=lambda r: r.segment)


def packed(segment: np.ndarray, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """A row for each segment: differences of its sorted keys, and counts."""
    parts = list(runs(segment))
    keys = [planes(np.diff(key[a:b], prepend=U(0))) for _, a, b in parts]
    return pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in parts], pa.int32()), pa.array(keys, pa.binary()), pa.array([planes(n[a:b].astype(np.uint32)) for _, a, b in parts], pa.binary())], ["segment", "keys", "n"])


def planes(values: np.ndarray) -> bytes:
    """The values' bytes, all first bytes, then all second ones and so on: small values then compress well in the shuffle."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def from_planes(raw: pa.Buffer, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def merged(parts: list[tuple], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments, keys and counts of all parts, sorted, equal keys added up."""
    segment, key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = in_order(segment, key, width)
    segment, key, n = segment[order], key[order], n[order]
    first = np.flatnonzero(firsts(segment, key))
    return segment[first], key[first], np.add.reduceat(n, first) if len(first) else n


def _cuts(n: np.ndarray, quota: int) -> tuple[np.ndarray, np.ndarray]:
    """Where to cut keys that occur n times so that about quota occurrences are between cuts. A key that alone occurs more often
    is between two cuts and has its occurrences as mass; elsewhere mass is 0."""
    share, hot = (np.cumsum(n) - n) // quota, n > quota
    new = np.ones(len(n), bool)
    new[1:] = (share[1:] != share[:-1]) | hot[1:] | hot[:-1]
    begins = np.flatnonzero(new)
    return begins.astype(np.int64), np.where(hot[begins], n[begins], 0).astype(np.int64)


def _write(folder: str, address: ByHash | ByContext, segment: int, key: np.ndarray, n: np.ndarray, min_count: int, discount: float) -> tuple[str, np.ndarray, float]:
    """Write a segment's file: its path, the counts of the keys it holds, and what its children have of a split context."""
    contexts, given = address.contexts(segment), 0.0
    if contexts:
        i = address.range_of(segment)
        context = (key // U(address.words)).astype(np.int64)
        # Every occurrence of a context but the end's is before one token, so its children's counts add up to its own.
        total = np.bincount(context, n, contexts) if address.parts[i] == 1 else address.mass[i : i + 1]
        kept = n >= min_count
        key, n, context = key[kept], n[kept], context[kept]
        shares = (n - discount) / total[context]
        gave, many = np.bincount(context, shares, contexts), np.bincount(context, minlength=contexts)
        given = float(gave.sum()) if address.parts[i] > 1 else 0.0
    file = File(len(key), address.universe(segment), contexts)
    raw = np.zeros(max(file.bytes, 64), np.uint8)
    a = file.arrays(raw)
    _fill(file.keys, a, "keys", key)
    if contexts:
        _fill(file.pointers, a, "pointers", np.concatenate([[0], np.cumsum(many)]))
        a["share"][:] = code(shares)
        a["left"][:] = np.where(many > 0, left_code(gave), 0)
    else:
        a["count"][:] = n
    path = os.path.join(folder, f"ngrams-{uuid.uuid4().hex}")  # a task that runs twice leaves two; the directory names one
    raw.tofile(path)
    return path, n, given


def _fill(shape: Shape, arrays: dict[str, np.ndarray], name: str, values: np.ndarray) -> None:
    builder = Builder(shape, arrays, name)
    builder.add(values)
    builder.done()


def train(docs: DataFrame, text: str = "text", order: int = ORDER, min_count: int = MIN_COUNT, discount: float = DISCOUNT, segment: int = SEGMENT) -> Model:
    """The model of all texts of docs; a null text is one end. It may be used in this Spark application. Segments are cut for
    at most segment occurrences of their contexts, fewer where that gives each shuffle partition one."""
    spark = docs.sparkSession
    rows = docs.select(F.col(text).alias("text"))
    folder = mounted_dir(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Words are fewer than bytes by far; a level of words needs fewer segments than one of n-grams.
    vocabulary = ByHash(max(1, (max(min(partitions, n_bytes // LEAST_SEGMENT), n_bytes // (16 * segment)) - 1).bit_length()))

    def words(part):
        return vocabulary.place(Tokens(texts_of(part.column("text")), None).hashes)

    def quota_of(total: int) -> int:
        return max(1, min(segment, max(total // partitions, LEAST_SEGMENT)))

    # An end and a word are two bytes at least, so this bounds the tokens before they are counted.
    quota = quota_of(n_bytes // 4)
    built = _built(rows, words, vocabulary, folder, quota, 1, discount)
    levels = [Level(vocabulary, built)]
    model = Model(levels, sum(r.total for r in built))

    for _ in range(2, order + 1):
        above = levels[-1]
        if not above.n:
            break  # no context, no child
        cuts = [np.frombuffer(r.begins, np.int64) + above.first[r.segment] for r in built if r.n]
        address = ByContext(np.concatenate(cuts), np.concatenate([np.frombuffer(r.mass, np.int64) for r in built if r.n]), above.n, levels[0].n, quota)
        known = list(levels)

        def ngrams(part, known=known, address=address):
            opened = [x.open() for x in known]
            tokens = Tokens(texts_of(part.column("text")), opened[0])
            places = tokens.ids
            for level in opened[1:]:
                places = level.look(tokens.after(places), tokens.ids)[0]
            context = tokens.after(places)
            use = np.flatnonzero(context >= 0)
            return address.place(context[use], tokens.ids[use])

        built = _built(rows, ngrams, address, folder, quota, min_count, discount)
        levels.append(Level(address, built))
    return model


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score, score. A null or empty text is one end. Columns of docs with
    these names are replaced; the text alone is read. Without training texts every word is unknown."""
    added = {"n_tokens": "long", "n_known": "long", "train_tokens": "long", "base_score": "double", "score": "double"}
    rest = [c for c in docs.columns if c not in added]
    schema = StructType(list(docs.select(*rest).schema.fields))
    for name, kind in added.items():
        schema = schema.add(name, kind)

    def scan(batches):
        levels = [x.open() for x in model.levels]
        for batch in batches:
            for part in steps(batch, text):
                tokens = Tokens(texts_of(part.column(text)), levels[0])
                count, log = model.score(tokens, levels)
                begin = tokens.begin[:-1]
                columns = [
                    pa.array(np.diff(tokens.begin).astype(np.int64)), pa.array(np.add.reduceat((count > 0).astype(np.int64), begin)), pa.array(np.full(len(begin), model.total, np.int64)),
                    pa.array(np.add.reduceat(np.log10(model.unigram(count)), begin)), pa.array(np.add.reduceat(log, begin)),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *added])

    return docs.select(*rest).mapInArrow(scan, schema)


def perplexity(log10_score: float, n_tokens: int) -> float:
    return math.pow(10, -log10_score / n_tokens)
