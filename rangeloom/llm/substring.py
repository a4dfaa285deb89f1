"""Repeated spans of words, removed by De Bruijn compaction.

The graph: an edge is a window of LENGTH words, from the node of its words but the last to that of its words but
the first; a document is a walk. Edges are dealt into buckets by anchor, the leftmost smallest hash of ANCHOR words
in the window, so a document's windows come in runs over one anchor. A run whose anchor has no other run is already
a nonbranching path and is one vertex of what follows; where runs over one anchor differ, each edge is one.

A vertex is kept if it occurs more than once. Its in- and out-degree are counted over all its occurrences, document
ends included: where a vertex has one successor, and that has one predecessor, the two are one path. Pointer doubling
over joins finds where each path begins and how many windows it has, so long repeats, whole copies among them, become
one row. The path's words are read at its source, its first occurrence; every occurrence is compared with them, at its
own coordinates, by a 128-bit cryptographic digest before anything is removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.llm.common import Rolling, Sieve, discard, long_array, row_key, span_hashes, steps, texts_of, written

LENGTH = 35
ANCHOR = 16
#: Turns of pointer doubling at most: no text has 2**40 windows.
TURNS = 40

RUNS = "anchor bigint, path bigint, doc_id bigint, key bigint, start int, n int, head bigint, tail bigint, before bigint, after bigint, edges binary"
SPANS = "doc_id bigint, key bigint, spans array<struct<start:int,end:int>>"


class Walk:
    """The runs of one step's documents: windows from first to last, over one anchor each."""

    def __init__(self, texts, length: int, anchor: int, rolls):
        grams, self.spans = rolls
        self.length = length
        starts, ends, at = texts.words()
        words = span_hashes(texts.data, starts, ends, 11)
        n = len(words)
        self.first = self.last = self.doc = self.start = np.zeros(0, np.int64)
        self.anchors = self.paths = np.zeros(0, np.uint64)
        if n < length:
            return
        places = np.arange(n - anchor + 1)
        low = grams.spans(grams.prefix(words), places, places + anchor)
        where = places.astype(np.int32)
        width, size = length - anchor + 1, 1
        while size < width:  # a sliding minimum over width values; the left one wins a tie
            d = min(size, width - size)
            right = low[d:] < low[:-d]
            low, where = np.where(right, low[d:], low[:-d]), np.where(right, where[d:], where[:-d])
            size += d
        doc = np.repeat(np.arange(len(texts)), np.diff(at))
        self.inside = doc[: len(where)] == doc[length - 1 :]
        turn = np.zeros(len(where) + 1, bool)
        turn[1:-1] = (where[1:] != where[:-1]) | (doc[1 : len(where)] != doc[: len(where) - 1])
        turn[[0, -1]] = True
        self.first = np.flatnonzero(turn[:-1] & self.inside)
        # A run ends where the next begins, or at the last window inside its document.
        stop = np.zeros(len(where), bool)
        stop[:-1] = turn[1:-1] | ~self.inside[1:]
        stop[-1] = True
        self.last = np.flatnonzero(stop & self.inside)
        self.doc = doc[self.first]
        self.start = self.first - at[self.doc]
        self.prefix = self.spans.prefix(words)
        self.anchors = low[self.first]
        offset = (where[self.first] - self.first).astype(np.uint64)
        self.paths = self.spans.spans(self.prefix, self.first, self.last + length) + offset * np.uint64(0x9E3779B97F4A7C15)

    def edge(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the windows at these words, never 0."""
        return np.maximum(self.spans.spans(self.prefix, at, at + self.length), np.uint64(1))

    def neighbours(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The edges before and after the runs, 0 at a document's ends."""
        first, last = self.first[which], self.last[which]
        before, after = np.zeros(len(which), np.uint64), np.zeros(len(which), np.uint64)
        inner = self.start[which] > 0
        before[inner] = self.edge(first[inner] - 1)
        further = np.append(self.inside, False)[last + 1]  # the window after a run's last lies in the same document, or in none
        after[further] = self.edge(last[further] + 1)
        return before, after


def _walks(docs: DataFrame, length: int, anchor: int, sieve: Sieve | None = None, branching: Sieve | None = None) -> DataFrame:
    """Anchor and path of every run; with sieves, whole rows of the runs whose anchor passes the first, edges where it passes both."""
    context = docs.sparkSession.sparkContext
    some, split = (context.broadcast(x.bits) if x else None for x in (sieve, branching))

    def scan(batches):
        rolls = Rolling(12), Rolling(13)
        only, single = (Sieve(x.value) if x else None for x in (some, split))
        for batch in batches:
            for part in steps(batch, "text"):
                walk = Walk(texts_of(part.column("text")), length, anchor, rolls)
                if not only:
                    yield pa.RecordBatch.from_arrays([long_array(walk.anchors), long_array(walk.paths)], ["anchor", "path"])
                    continue
                use = np.flatnonzero(only.passes(walk.anchors))
                if not len(use):
                    continue
                doc, first, last = pa.array(walk.doc[use]), walk.first[use], walk.last[use]
                before, after = walk.neighbours(use)
                wanted = single.passes(walk.anchors[use]).tolist()
                edges = [walk.edge(np.arange(a, b + 1)).tobytes() if w else None for a, b, w in zip(first.tolist(), last.tolist(), wanted, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        long_array(walk.anchors[use]), long_array(walk.paths[use]), part.column("doc_id").take(doc), part.column("key").take(doc), pa.array(walk.start[use].astype(np.int32)), pa.array((last - first + 1).astype(np.int32)),
                        long_array(walk.edge(first)), long_array(walk.edge(last)), long_array(before), long_array(after), pa.array(edges, pa.binary()),
                    ],
                    [x.split()[0] for x in RUNS.split(", ")],
                )

    return docs.mapInArrow(scan, RUNS if sieve else "anchor bigint, path bigint")


EDGES = "anchor bigint, path bigint, place int, edge bigint, times bigint, doc_id bigint, key bigint, start int, low_before bigint, high_before bigint, low_after bigint, high_after bigint"


def _expand(batches):
    """The edges of runs, each with the ones before and after it."""
    for batch in batches:
        for i in range(0, batch.num_rows, 2000):
            part = batch.slice(i, 2000)
            column = {name: part.column(name) for name in part.schema.names}
            size = column["n"].to_numpy(zero_copy_only=False).astype(np.int64)
            nth = np.repeat(np.arange(len(size)), size)
            begin = np.cumsum(size) - size
            place = np.arange(size.sum()) - begin[nth]
            edge = np.frombuffer(b"".join(column["edges"].to_pylist()), np.int64)
            own = {name: column[name].to_numpy(zero_copy_only=False)[nth] for name in ("start", "times", "low_before", "high_before", "low_after", "high_after")}
            for name in ("low_before", "high_before"):
                own[name] = np.where(place > 0, np.roll(edge, 1), own[name])
            for name in ("low_after", "high_after"):
                own[name] = np.where(place < size[nth] - 1, np.roll(edge, -1), own[name])
            at = pa.array(nth)
            start = pa.array((own["start"] + place).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [column["anchor"].take(at), column["path"].take(at), pa.array(place.astype(np.int32)), pa.array(edge), pa.array(own["times"]), column["doc_id"].take(at), column["key"].take(at), start, *(pa.array(own[x]) for x in ("low_before", "high_before", "low_after", "high_after"))],
                [x.split()[0] for x in EDGES.split(", ")],
            )


def _only(low: str, high: str):
    """The one neighbour that all occurrences have; 0 if they differ, or if a document ends there."""
    return F.when(F.col(low) == F.col(high), F.col(low)).otherwise(F.lit(0))


def graph(rows: DataFrame, length: int, anchor: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(occurrences of runs, distinct runs, vertices), all written. A vertex: head, tail (its first and last edge), n (windows),
    before, after (its one neighbour, or 0), source (doc_id, key, start), anchor and path where it is a whole run."""
    anchors = _walks(rows, length, anchor).groupBy("anchor").agg(F.count("*").alias("times"), F.min("path").alias("low"), F.max("path").alias("high"))
    anchors = written(anchors.where("times > 1").select("anchor", (F.col("low") != F.col("high")).alias("branching")))
    n_all, n_split = (x or 0 for x in anchors.agg(F.count("*"), F.sum(F.col("branching").cast("int"))).first())
    # The sieves spare what occurs once; a run that passes by chance occurs once, and goes where that counts.
    some = Sieve.of(anchors.select("anchor"), n_all), Sieve.of(anchors.where("branching").select("anchor"), n_split)
    runs = written(_walks(rows, length, anchor, *some))
    discard(anchors)
    each = runs.groupBy("anchor", "path").agg(
        F.count("*").alias("times"), F.min(F.struct("doc_id", "key", "start")).alias("source"), F.min("n").alias("n"), F.min("head").alias("head"), F.min("tail").alias("tail"),
        *(f(x).alias(f"{name}_{x}") for x in ("before", "after") for name, f in (("low", F.min), ("high", F.max))), F.min("edges").alias("edges"),
    )
    paths = written(each)
    before, after = _only("low_before", "high_before").alias("before"), _only("low_after", "high_after").alias("after")
    whole = paths.where("edges IS NULL AND times > 1").select("head", "tail", "n", before, after, "source", "anchor", "path")
    counted = _edges(paths).groupBy("edge").agg(
        F.sum("times").alias("times"), F.min(F.struct("doc_id", "key", "start")).alias("source"),
        *(f(f"{name}_{x}").alias(f"{name}_{x}") for x in ("before", "after") for name, f in (("low", F.min), ("high", F.max))),
    )
    none = F.lit(None).cast("bigint")
    single = counted.where("times > 1").select(F.col("edge").alias("head"), F.col("edge").alias("tail"), F.lit(1).alias("n"), before, after, "source", none.alias("anchor"), none.alias("path"))
    return runs, paths, written(whole.union(single))


def _edges(paths: DataFrame) -> DataFrame:
    return paths.where("edges IS NOT NULL").select("anchor", "path", "times", "source.*", "n", "low_before", "high_before", "low_after", "high_after", "edges").mapInArrow(_expand, EDGES)


def compacted(vertices: DataFrame) -> DataFrame:
    """The nonbranching paths: head, n (windows), source. Each turn a path's pointers reach twice as far."""
    v, w = vertices.select("head", "tail", "after").where("after <> 0"), vertices.select(F.col("head").alias("to"), "before").where("before <> 0")
    follow = written(v.join(w, (F.col("after") == F.col("to")) & (F.col("before") == F.col("tail"))).select("head", "to"))
    now = written(vertices.select("head", F.col("n").cast("bigint").alias("n")).join(follow, "head", "left"))
    for _ in range(TURNS):
        if now.where("to IS NOT NULL").isEmpty():
            break
        far = now.select(F.col("head").alias("to"), F.col("n").alias("more"), F.col("to").alias("next"))
        # What has arrived needs no join; paths are few rows against texts.
        step = now.where("to IS NOT NULL").join(far, "to").select("head", (F.col("n") + F.col("more")).alias("n"), F.col("next").alias("to"))
        turned = written(step.unionByName(now.where("to IS NULL")))
        discard(now)
        now = turned
    else:  # only hashes that collide can close a circle: then vertices stay as they are
        now, follow = vertices.select("head", F.col("n").cast("bigint").alias("n")), follow.limit(0)
    begins = now.select("head", "n").join(follow.select(F.col("to").alias("head")), "head", "left_anti")
    return written(begins.join(vertices.select("head", "source", "anchor", "path"), "head"))


def _digest(raw: bytes, starts: np.ndarray, ends: np.ndarray, first: int, last: int) -> bytes:
    words = b" ".join([raw[a:b] for a, b in zip(starts[first:last].tolist(), ends[first:last].tolist(), strict=True)])
    return hashlib.blake2b(words, digest_size=16).digest()


def _at_source(rows: DataFrame, paths: DataFrame, length: int) -> DataFrame:
    """head, digest: of each path's words, read from the row that it was first found in."""
    wanted = written(paths.select("source.doc_id", "source.key", F.struct("source.start", "n", "head").alias("path")).groupBy("doc_id", "key").agg(F.collect_list("path").alias("paths")))
    sieve = rows.sparkSession.sparkContext.broadcast(Sieve.of(wanted.select("key"), wanted.count()).bits)

    def some(batches):
        only = Sieve(sieve.value)
        for batch in batches:
            yield batch.filter(pa.array(only.passes(batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64))))

    def read(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                texts = texts_of(part.column("text"))
                starts, ends, at = texts.words()
                raw, heads, digests = texts.data.tobytes(), [], []
                for i, own in enumerate(part.column("paths").to_pylist()):
                    for p in own:
                        first = at[i] + p["start"]
                        heads.append(p["head"])
                        digests.append(_digest(raw, starts, ends, first, min(first + p["n"] + length - 1, at[i + 1])))
                yield pa.RecordBatch.from_arrays([pa.array(heads, pa.int64()), pa.array(digests, pa.binary())], ["head", "digest"])

    texts = rows.mapInArrow(some, rows.schema).join(wanted.withColumnRenamed("key", "__key").withColumnRenamed("doc_id", "__id"), (F.col("key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    found = texts.select("text", "paths").mapInArrow(read, "head bigint, digest binary")
    return written(found.groupBy("head").agg(F.min("digest").alias("digest")))  # rows that repeat say the same


def _claims(rows: DataFrame, length: int, anchor: int) -> DataFrame:
    """doc_id, key, claims array<struct<start, end, digest>>: where a path that occurs more than once should lie."""
    runs, distinct, vertices = graph(rows, length, anchor)
    paths = compacted(vertices)
    paths = paths.join(_at_source(rows, paths, length), "head").select("head", "n", "digest", "anchor", "path")
    # A path occurs where its first vertex does: a run as a whole, or one edge of it.
    whole = paths.where("anchor IS NOT NULL").select("anchor", "path", F.lit(0).alias("place"), "n", "digest")
    single = _edges(distinct).select("anchor", "path", "place", F.col("edge").alias("head")).join(paths.where("anchor IS NULL").select("head", "n", "digest"), "head").drop("head")
    marks = written(whole.unionByName(single))
    found = runs.select("anchor", "path", "doc_id", "key", "start").join(marks, ["anchor", "path"])  # both sides were written
    first = F.col("start") + F.col("place")
    claim = F.struct(first.alias("start"), (first + F.col("n").cast("int") + (length - 1)).alias("end"), "digest")
    return found.groupBy("key", "doc_id").agg(F.collect_set(claim).alias("claims"))


def _merged(claims: list, raw: bytes, starts: np.ndarray, ends: np.ndarray, begin: int, stop: int) -> list[tuple[int, int]]:
    """Claims whose words, at their place in the text, are the source's; sorted, joined where they touch or overlap."""
    out: list[list[int]] = []
    for c in sorted(claims or (), key=lambda c: c["start"]):
        if begin + c["end"] > stop or _digest(raw, starts, ends, begin + c["start"], begin + c["end"]) != c["digest"]:
            continue
        if out and c["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], c["end"])
        else:
            out.append([c["start"], c["end"]])
    return [tuple(x) for x in out]


def _joined(docs: DataFrame, text: str, ident: str, length: int, anchor: int, how: str) -> DataFrame:
    rows = docs.select(F.col(ident).cast("bigint").alias("doc_id"), row_key(text, ident).alias("key"), F.col(text).alias("text"))
    found = _claims(rows, length, anchor).withColumnRenamed("doc_id", "__id").withColumnRenamed("key", "__key")
    return rows.join(found, (F.col("key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")), how).select("doc_id", "key", "text", "claims")


def repeated_spans(docs: DataFrame, text: str = "text", ident: str = "doc_id", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, key (see row_key), spans array<struct<start, end>> of word positions, sorted and disjoint: the words that
    windows of length words cover whose word sequence starts more than once in docs. Rows without any are absent."""

    def spans(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                texts = texts_of(part.column("text"))
                starts, ends, at = texts.words()
                raw = texts.data.tobytes()
                own = [_merged(claims, raw, starts, ends, at[i], at[i + 1]) for i, claims in enumerate(part.column("claims").to_pylist())]
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array([[{"start": a, "end": b} for a, b in x] for x in own], kind)], ["doc_id", "key", "spans"])

    return _joined(docs, text, ident, length, anchor, "inner").mapInArrow(spans, SPANS).where(F.size("spans") > 0)


def without_repeats(docs: DataFrame, text: str = "text", ident: str = "doc_id", length: int = LENGTH, anchor: int = ANCHOR, with_kept: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, unless with_kept is off, kept (the words that stay, one space
    between them): one row for each row of docs.

    A null text counts as empty. Rows that repeat are repeats of each other, so all their windows go. Fewer than
    length words: nothing goes. Null ids stay null. Words whose sequence isn't the one at the source of their path
    stay, whatever their hashes say. Other columns are not read.
    """

    def cut(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                texts = texts_of(part.column("text"))
                starts, ends, at = texts.words()
                raw = texts.data.tobytes()
                n_words, n_removed, sha, kept = [], [], [], []
                for i, claims in enumerate(part.column("claims").to_pylist()):
                    stay = np.ones(at[i + 1] - at[i], bool)
                    for a, b in _merged(claims, raw, starts, ends, at[i], at[i + 1]):
                        stay[a:b] = False
                    use = np.flatnonzero(stay) + at[i]
                    words = b" ".join([raw[a:b] for a, b in zip(starts[use].tolist(), ends[use].tolist(), strict=True)])
                    n_words.append(len(stay))
                    n_removed.append(len(stay) - len(use))
                    sha.append(hashlib.sha256(words).hexdigest())
                    kept.append(words if with_kept else None)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    out = _joined(docs, text, ident, length, anchor, "left").mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")
    return out if with_kept else out.drop("kept")
