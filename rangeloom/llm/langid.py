"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has a context tree of orders 0 to 3 with frozen counts. A byte s after a context with n bytes
seen, q of them different, costs -log2(count(s) / (n + q)) if s was seen there, or else the escape's
-log2(q / (n + q)) and its cost one order lower; below order 0 a byte costs 8 bits. A text's code length in a
language is the exact sum, and the shortest code names the language.

The trees are sorted arrays of what was seen, so they grow with the texts learned from alone. A text's grams of four bytes
are looked up once each, however often they come.

Trees of a bounded sample are held in memory. Those of whole tables are built by executors in segments, raw files in the
folder that the cluster shares; workers map them, and the driver keeps a directory, one row a segment.
"""

from __future__ import annotations

import uuid
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rangeloom.llm.common import discard, mounted_dir, steps, text_array, texts_of, written

#: Bytes of text a language's tree is fitted on, about: rows in order of a hash until they are reached.
SAMPLE_BYTES = 4 << 20
PAD = 0x0A
#: A text is in none of the languages if its bits a byte are beyond so many times this quantile of the training texts'.
RATE_QUANTILE, REACH = Fraction(999, 1000), 2.0
#: Entries that a task holds before it writes them as a segment, 12 bytes each.
SEGMENT = 1 << 20
#: Parts that a pass over rates tells apart in each language.
RATE_PARTS = 4096


def held_out(ident: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(ident).cast("string"), F.lit("null")).cast("binary")) % 4 == 2


def padded(texts) -> tuple[np.ndarray, np.ndarray]:
    """The texts with three pad bytes before each, and the place of each text byte."""
    sizes = np.diff(texts.offsets)
    flat = np.full(len(texts.data) + 3 * len(sizes), PAD, np.uint8)
    place = np.arange(len(texts.data)) + np.repeat(3 * (np.arange(len(sizes)) + 1), sizes)
    flat[place] = texts.data
    return flat, place


def _grams(texts) -> np.ndarray:
    """Each text byte with the three before it, as a number, the byte itself lowest."""
    flat, place = padded(texts)
    wide = flat.astype(np.uint32)
    return (wide[place - 3] << 24) | (wide[place - 2] << 16) | (wide[place - 1] << 8) | wide[place]


def gram_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, gram (four bytes as a number, the last lowest), n."""

    def count(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                names = part.column("lang").to_pylist()
                for name in sorted(set(names)):
                    own = part.filter(pa.array([x == name for x in names]))
                    grams, n = np.unique(_grams(texts_of(own.column("text"))), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(count, "lang string, gram bigint, n bigint")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Order:
    """A language's frozen counts after contexts of one length: what was seen, in order, and what it costs."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, order: int):
        self.order, self.mask = order, np.uint32((1 << 8 * (order + 1)) - 1)
        self.seen, at = np.unique(grams & self.mask, return_inverse=True)
        times = np.bincount(at, n, len(self.seen))
        self.contexts, at = np.unique(self.seen >> np.uint32(8), return_inverse=True)
        total, kinds = np.bincount(at, times, len(self.contexts)), np.bincount(at, minlength=len(self.contexts))
        self.known = np.log2(total + kinds)[at] - np.log2(times)
        self.escape = np.log2(total + kinds) - np.log2(kinds)

    def save(self, file) -> None:
        for part in (self.known, self.escape, self.seen, self.contexts):
            file.write(part.tobytes())
        file.write(bytes(-file.tell() % 8))

    @classmethod
    def mapped(cls, raw: np.ndarray, at: int, entries: int, contexts: int, order: int) -> Order:
        """What save() wrote at a place of a file."""
        self = cls.__new__(cls)
        self.order, self.mask = order, np.uint32((1 << 8 * (order + 1)) - 1)
        for name, kind, size in (("known", "<f8", entries), ("escape", "<f8", contexts), ("seen", "<u4", entries), ("contexts", "<u4", contexts)):
            to = at + size * np.dtype(kind).itemsize
            setattr(self, name, raw[at:to].view(kind))
            at = to
        return self

    def cost(self, grams: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Bits of each gram's last byte after the ones before it; lower: one order lower."""
        own = grams & self.mask
        at, same = _found(self.contexts, own >> np.uint32(8))
        out = lower + np.where(same, self.escape[at], 0.0)
        at, same = _found(self.seen, own)
        return np.where(same, self.known[at], out)


def _found(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


class Trees:
    """Frozen context trees of all languages: every context and byte of the samples, nothing else, so a language has at most
    four entries for each byte of its sample."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts, key=lambda x: x.encode())
        self.trees = [[Order(counts[name][0].astype(np.uint32), counts[name][1], k) for k in range(4)] for name in self.langs]

    def code_lengths(self, texts) -> np.ndarray:
        """Bits of each text in each language: looked up once for each different gram."""
        out = np.zeros((len(texts), len(self.langs)))
        full = np.flatnonzero(np.diff(texts.offsets))
        if len(full):
            asked, at = np.unique(_grams(texts), return_inverse=True)
            for i, orders in enumerate(self.trees):
                cost = np.full(len(asked), 8.0)
                for order in orders:
                    cost = order.cost(asked, cost)
                out[full, i] = np.add.reduceat(cost[at], texts.offsets[full])
        return out


class Segments:
    """An Order in several pieces. Each has whole contexts, in order; begins: the first of each."""

    def __init__(self, built: list, order: int, files: dict[str, np.ndarray]):
        built = sorted(built, key=lambda r: r.begin)
        self.begins = np.array([r.begin for r in built], np.uint32)
        self.mask = np.uint32((1 << 8 * (order + 1)) - 1)
        self.parts = [Order.mapped(files[r.path], r.at, r.entries, r.contexts, order) for r in built]

    def cost(self, grams: np.ndarray, lower: np.ndarray) -> np.ndarray:
        if len(self.parts) == 1:
            return self.parts[0].cost(grams, lower)
        part = np.maximum(np.searchsorted(self.begins, (grams & self.mask) >> np.uint32(8), "right") - 1, 0)
        order = np.argsort(part, kind="stable")
        ends = np.cumsum(np.bincount(part, minlength=len(self.parts)))
        out = np.empty(len(grams))
        for i in np.flatnonzero(np.diff(ends, prepend=0)).tolist():
            own = order[ends[i - 1] if i else 0 : ends[i]]
            out[own] = self.parts[i].cost(grams[own], lower[own])
        return out


class StoredTrees(Trees):
    """Trees whose arrays are files that the cluster shares, and their directory: lang, order, begin, entries, contexts,
    path, at. A process maps the files when it first asks; pages are read on demand, and workers of a machine share them."""

    def __init__(self, built: list):
        self.built: dict[str, list[list]] = {}
        for r in built:
            self.built.setdefault(r.lang, [[] for _ in range(4)])[r.order].append(r)
        self.langs = sorted(self.built, key=lambda x: x.encode())
        self.opened = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"opened": None}

    @property
    def trees(self) -> list[list[Segments]]:
        if self.opened is None:
            paths = {r.path for orders in self.built.values() for own in orders for r in own}
            files = {path: np.memmap(path, np.uint8, "r").view(np.ndarray) for path in paths}
            self.opened = [[Segments(own, k, files) for k, own in enumerate(self.built[name])] for name in self.langs]
        return self.opened


def labelled(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, text of every row that has both."""
    return docs.where(F.col(lang).isNotNull() & (F.octet_length(text) > 0)).select(F.col(lang).alias("lang"), F.col(text).alias("text"))


def stored(rows: DataFrame, segment: int = SEGMENT) -> StoredTrees | None:
    """Trees of all rows of labelled(), None without any. A task builds the segments of a range of contexts, of about so many
    entries, in one file; none passes through the driver. spark.checkpoint.dir must be a mounted folder."""
    counted = written(gram_counts(rows, "text", "lang"))
    entries = counted.count()
    if not entries:
        return None
    folder = mounted_dir(rows.sparkSession)

    def build(batches):
        rows = []
        path = f"{folder}/{uuid.uuid4().hex}.tree"
        with open(path, "wb") as file:
            for lang, order, grams, n in _pieces(batches, segment):
                piece, at = Order(grams, n, order), file.tell()
                piece.save(file)
                rows.append((lang, order, int(piece.contexts[0]), len(piece.seen), len(piece.contexts), path, at))
        if rows:  # what the file holds is complete
            columns = [pa.array(x, pa.int32() if i == 1 else None) for i, x in enumerate(zip(*rows, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "order", "begin", "entries", "contexts", "path", "at"])

    each = F.explode(F.array(*[F.struct(F.lit(k).alias("order"), F.col("gram").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("gram")) for k in range(4)]))
    of_orders = counted.select("lang", "n", each.alias("of")).groupBy("lang", "of.order", "of.gram").agg(F.sum("n").alias("n"))
    ranges = of_orders.repartitionByRange(-(-entries // segment), "lang", "order", F.shiftright("gram", 8)).sortWithinPartitions("lang", "order", "gram")
    built = ranges.select("lang", "order", "gram", "n").mapInArrow(build, "lang string, order int, begin bigint, entries bigint, contexts bigint, path string, at bigint").collect()
    discard(counted)
    return StoredTrees(built)


def _pieces(batches, segment: int):
    """lang, order, grams and their counts, from rows in order: of one language and order each, with whole contexts, and little
    more than segment entries."""
    own, held, size = None, [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column("lang").dictionary_encode()
        orders, grams, n = (batch.column(x).to_numpy() for x in ("order", "gram", "n"))
        kind = np.asarray(names.indices).astype(np.int64) * 4 + orders
        cuts = [0, *(np.flatnonzero(np.diff(kind)) + 1).tolist(), len(kind)]
        for a, b in zip(cuts, cuts[1:]):  # noqa: B905
            of = (names.dictionary[int(kind[a]) // 4].as_py(), int(orders[a]))
            if of != own:
                if size:
                    yield *own, *_joined(held)
                own, held, size = of, [], 0
            held.append((grams[a:b].astype(np.uint32), n[a:b]))
            size += b - a
            if size > segment:
                have, times = _joined(held)
                to = int(np.searchsorted(have, have[-1] & ~np.uint32(255)))  # more of the last context may come
                if to:
                    yield *own, have[:to], times[:to]
                held, size = [(have[to:], times[to:])], len(have) - to
    if size:
        yield *own, *_joined(held)


def _joined(held: list) -> tuple[np.ndarray, np.ndarray]:
    grams, n = zip(*held, strict=True)
    return np.concatenate(grams), np.concatenate(n)


def sampled(docs: DataFrame, text: str = "text", lang: str = "lang", ident: str = "doc_id", sample_bytes: int = SAMPLE_BYTES) -> DataFrame | None:
    """lang, text of the rows that a language's tree is fitted on: in order of a hash of doc_id and text until they have
    sample_bytes, so one row at least and the whole language while that has fewer; rows of one hash go together. None
    without any language."""
    coin = F.pmod(F.xxhash64(F.lit("sample"), F.col(ident), F.col(text)), F.lit(1 << 40))
    rows = docs.where(F.col(lang).isNotNull() & (F.octet_length(text) > 0))
    rows = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), coin.alias("coin"), F.octet_length(text).cast("bigint").alias("size"))

    def reached(found: DataFrame, before: dict) -> dict:
        """For each language the step of found (lang, step, size) that reaches the bound, and the bytes before it."""
        out, sums = {}, dict(before)
        for r in sorted(found.collect(), key=lambda r: (r.lang, r.step)):
            if r.lang not in out:
                had = sums.get(r.lang, 0)
                sums[r.lang] = had + r["size"]
                if sums[r.lang] >= sample_bytes:
                    out[r.lang] = (r.step, had)
        return out | {name: None for name in sums if name not in out}

    def of(values: dict):
        return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("lang")]

    # First which 1,024th of the hashes reaches the bound, then which of its rows.
    part = F.shiftright("coin", 30)
    coarse = reached(rows.groupBy("lang", part.alias("step")).agg(F.sum("size").alias("size")), {})
    if not coarse:
        return None
    last = {name: 1 << 40 for name in coarse}
    cut = {name: x for name, x in coarse.items() if x}
    if cut:
        inside = rows.where(part == of({name: step for name, (step, _) in cut.items()}))
        fine = reached(inside.groupBy("lang", F.col("coin").alias("step")).agg(F.sum("size").alias("size")), {name: had for name, (_, had) in cut.items()})
        last |= {name: step for name, (step, _) in fine.items()}
    return rows.where(F.col("coin") <= of(last)).select("lang", "text")


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", ident: str = "doc_id", sample_bytes: int = SAMPLE_BYTES) -> Trees | None:
    """Trees of the languages in lang (null is none), each fitted on its sampled rows; None without any."""
    rows = sampled(docs, text, lang, ident, sample_bytes)
    return learned(rows) if rows is not None else None


def learned(rows: DataFrame) -> Trees | None:
    """Trees of what sampled() gives."""
    counted = gram_counts(rows, "text", "lang").toArrow()
    names = counted.column("lang").to_pylist()
    grams, n = counted.column("gram").to_numpy(), counted.column("n").to_numpy()
    at = {name: np.flatnonzero(np.array([x == name for x in names])) for name in set(names)}
    return Trees({name: (grams[i], n[i]) for name, i in at.items()}) if at else None


def rate_limits(rows: DataFrame, trees: Trees) -> dict[str, float]:
    """For each language of rows (lang, text) the bits a byte that a text in it may cost: REACH times the RATE_QUANTILE of its rows."""
    rates = written(identified(rows, trees, with_rate=True).select("lang", "rate"))
    found = quantiles(rates, RATE_QUANTILE)
    discard(rates)
    return {name: REACH * rate for name, rate in found.items()}


def quantiles(rates: DataFrame, share: Fraction) -> dict[str, float]:
    """For each lang the smallest rate, of a written table, that at least this share of its rows doesn't exceed, exactly. Passes
    narrow the range it is in until one value is left; each brings RATE_PARTS rows a language to the driver."""
    found, inside = {}, {}
    seen = (F.count("*").alias("n"), F.min("rate").alias("low"), F.max("rate").alias("high"))
    for r in rates.groupBy("lang").agg(*seen).collect():
        inside[r.lang] = (-(-share.numerator * r.n // share.denominator), r.low, r.high)
    while True:
        found |= {name: low for name, (_, low, high) in inside.items() if low == high}
        inside = {name: x for name, x in inside.items() if x[1] < x[2]}
        if not inside:
            return found
        low, high = (F.create_map(*[F.lit(x) for name, of in inside.items() for x in (name, of[i])])[F.col("lang")] for i in (1, 2))
        part = F.floor((F.col("rate") - low) / (high - low) * RATE_PARTS)
        parts = rates.where(F.col("rate").between(low, high)).groupBy("lang", part.alias("part")).agg(*seen).collect()
        left = {name: rank for name, (rank, _, _) in inside.items()}
        for r in sorted(parts, key=lambda r: (r.lang, r.part)):
            if left.get(r.lang, 0) > r.n:
                left[r.lang] -= r.n
            elif r.lang in left:
                inside[r.lang] = (left.pop(r.lang), r.low, r.high)


def identified(docs: DataFrame, trees: Trees | None, text: str = "text", with_rate: bool = False) -> DataFrame:
    """docs with lang_pred and score, the share of the predicted language's code among all languages' codes if each
    were as likely at first. Null texts, texts without a letter, and all texts where nothing was learned: und, 0.
    The text alone is read; columns of docs named lang_pred or score are replaced. Ties: the first name wins.
    with_rate adds rate, the bits a byte of the text in the predicted language, 0 where nothing was learned."""
    added = {"lang_pred": "string", "score": "double"} | ({"rate": "double"} if with_rate else {})
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by the sample, or a directory: see Trees, StoredTrees
    rest = [c for c in docs.columns if c not in added]
    schema = StructType(list(docs.select(*rest).schema.fields))
    for name, kind in added.items():
        schema = schema.add(name, kind)

    def predict(batches):
        model = shared.value
        for batch in batches:
            for part in steps(batch, text):
                column = text_array(part.column(text))
                letters = pc.fill_null(pc.match_substring_regex(column, r"\pL"), False)
                if model is None:
                    letters = pa.array([False] * len(column))
                    names, score, rate = pa.array(["und"] * len(column)), np.zeros(len(column)), np.zeros(len(column))
                else:
                    texts = texts_of(column)
                    bits = model.code_lengths(texts)
                    rate = bits.min(1) / np.maximum(np.diff(texts.offsets), 1)
                    best = bits.argmin(1)
                    score = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
                    names = pa.array(model.langs).take(pa.array(best))
                names = pc.if_else(letters, names, "und")
                score = pc.if_else(letters, pa.array(score), 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns, *[names, score, pa.array(rate)][: len(added)]], [*part.schema.names, *added])

    return docs.select(*rest).mapInArrow(predict, schema)
