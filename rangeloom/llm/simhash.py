"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits link at three or fewer differing bits, so the bits of one of the two halves differ
in one place at most. The anchors of a half are the words of a covering code: the perfect Hamming code of
length 31 (covering radius 1) beside one plain bit. A fingerprint goes to its nearest anchor, its home, and
to every anchor that is the home of a word one bit away: the code words within covering radius plus one.
Linked fingerprints thus meet at the home of either, and are compared there. An anchor with very many is dealt
out once more, to a task for each byte of the other half that two of them can share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.llm.common import LOWER, U, long_array, row_key, steps, texts_of, written
from rangeloom.llm.components import components, local_stars

DISTANCE = 3
#: Fingerprints at one anchor that are compared each with each; of more, see close_pairs.
CROWD = 512
#: Fingerprints that are compared each with each in any case; of more, see connected.
DENSE = 4096
#: Fingerprints that a task holds of one anchor; of more, all are dealt out by bytes of the other half.
SPLIT = 1 << 17

#: SYNDROME[k][byte]: exclusive or of the places (from 1) of the bits of byte k of a 31-bit word.
SYNDROME = np.zeros((4, 256), np.uint8)
for _k in range(4):
    for _j in range(8):
        if 8 * _k + _j < 31:
            SYNDROME[_k] ^= (((np.arange(256) >> _j) & 1) * (8 * _k + _j + 1)).astype(np.uint8)


def shingle_hashes(texts, size: int = 3, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each text's lower-cased word shingles, and where each text's begin. A text with fewer words than
    size has one shingle, all its words; a text without words has none."""
    starts, ends, at = texts.words()
    words = np.diff(at)
    # The words once more, one space between them, so that a shingle is one slice.
    lengths = ends - starts
    to = np.concatenate([[0], np.cumsum(lengths + 1)])
    flat = np.full(to[-1], 0x20, np.uint8)
    inside = np.ones(to[-1], bool)
    inside[to[1:] - 1] = False
    shift = np.repeat(starts - to[:-1], lengths)
    where = np.flatnonzero(inside)
    flat[where] = LOWER[texts.data[where + shift]]
    first, last = to[:-1], to[1:] - 1
    count = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    nth = np.arange(begin[-1]) - np.repeat(begin[:-1], count) + np.repeat(at[:-1], count)
    final = nth + np.repeat(np.minimum(words, size), count) - 1
    raw, digest = flat.tobytes(), xxhash.xxh64_intdigest
    out = np.fromiter((digest(raw[a:b], seed) for a, b in zip(first[nth].tolist(), last[final].tolist(), strict=True)), np.uint64, len(nth))
    return out, begin


def fingerprints(texts) -> np.ndarray:
    """Bit b is 1 where over half the shingles' hashes have it; no words: zero."""
    hashes, begin = shingle_hashes(texts)
    count = np.diff(begin)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(count)
    if len(full):
        for b in range(64):
            ones = np.add.reduceat((hashes >> U(b)) & U(1), begin[full], dtype=np.int64)
            out[full] |= (2 * ones > count[full]).astype(np.uint64) << U(b)
    return out


def nearest(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code word nearest to each 31-bit word, and the syndrome (the place that differs, 0: none)."""
    s = np.zeros(len(word), np.uint8)
    for k in range(4):
        s ^= SYNDROME[k][(word >> U(8 * k)) & U(255)]
    flip = np.where(s > 0, U(1) << (np.maximum(s, 1) - 1).astype(np.uint64), U(0))
    return word ^ flip, s


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of every anchor that each fingerprint goes to, and the fingerprint's position; a key holds half and anchor."""
    keys, owners = [], []
    everyone = np.arange(len(prints))
    for half in (0, 1):
        own = (prints >> U(32 * half)) & U(0xFFFFFFFF)
        plain, word = own & U(1 << 31), own & U((1 << 31) - 1)
        mark = U(half << 32)
        home, s = nearest(word)
        keys += [home | plain | mark, home | (plain ^ U(1 << 31)) | mark]
        owners += [everyone, everyone]
        off = np.flatnonzero(s)  # a code word's neighbours all have it as their home
        for j in range(1, 32):
            use = off[(s[off] != j) & (j < (s[off] ^ j))]  # flips of j and of s ^ j lead to one anchor
            near = word[use] ^ U(1 << (j - 1)) ^ (U(1) << ((s[use] ^ j) - 1).astype(np.uint64))
            keys.append(near | plain[use] | mark)
            owners.append(use)
    return np.concatenate(keys), np.concatenate(owners)


def close_pairs(keys: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs that connect what all pairs under one key within distance connect; keys are sorted. In a crowd only
    those are compared that agree in one of the four bytes of the half that the key doesn't speak of, as any two within three
    bits do."""
    cut = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.append(cut, len(keys)))
    crowds = np.flatnonzero(size > CROWD)
    alone = np.ones(len(keys), bool)
    pairs = []
    for i in crowds.tolist():
        own = np.arange(cut[i], cut[i] + size[i])
        alone[own] = False
        other = _other(keys[own], prints[own])
        for k in range(4):
            byte = (other >> U(8 * k)) & U(255)
            order = np.argsort(byte, kind="stable")
            pairs.append([own[order][x] for x in in_groups(byte[order], prints[own[order]], distance)])
    rest = np.flatnonzero(alone)
    pairs.append([rest[x] for x in _compared(keys[rest], prints[rest], distance)])
    return np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs])


def _other(keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """The half of each fingerprint that its anchor's key doesn't speak of."""
    second = (keys >> U(32)) & U(1)
    return (prints >> (U(32) * (U(1) - second))) & U(0xFFFFFFFF)


def in_groups(keys: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs that connect what all pairs under one key within distance connect; keys are sorted."""
    cut = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.append(cut, len(keys)))
    few = np.repeat(size <= DENSE, size)
    rest = np.flatnonzero(few)
    pairs = [[rest[x] for x in _compared(keys[rest], prints[rest], distance)]]
    for i in np.flatnonzero(size > DENSE).tolist():
        pairs.append([cut[i] + x for x in connected(prints[cut[i] : cut[i] + size[i]], distance)])
    return np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs])


def connected(prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs that connect what all pairs within distance connect. Neighbours in a few orders find most of a
    dense group's largest component first. A link that they leave out between components has an end outside the largest,
    so only those ends are compared with all."""
    a = b = np.zeros(0, np.int64)
    for turn in range(0, 64, 8):
        order = np.argsort((prints << U(turn)) | (prints >> U((64 - turn) % 64)), kind="stable")
        ends_a, ends_b = [a], [b]
        for d in range(1, 17):
            x, y = order[:-d], order[d:]
            hit = np.bitwise_count(prints[x] ^ prints[y]) <= distance
            ends_a.append(x[hit])
            ends_b.append(y[hit])
        a, b = local_stars(np.concatenate(ends_a), np.concatenate(ends_b))
    root = np.arange(len(prints))
    root[a] = b
    ends_a, ends_b = [a], [b]
    for i in np.flatnonzero(root != np.bincount(root).argmax()).tolist():
        hit = np.flatnonzero((np.bitwise_count(prints ^ prints[i]) <= distance) & (root != root[i]))
        ends_a.append(np.full(len(hit), i))
        ends_b.append(hit)
    return np.concatenate(ends_a), np.concatenate(ends_b)


def _compared(keys: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs under one key within distance; keys are sorted."""
    found_a, found_b = [], []
    at, d = np.arange(len(keys)), 0
    while True:
        d += 1
        at = at[at + d < len(keys)]
        at = at[keys[at] == keys[at + d]]
        if not len(at):
            break
        hit = at[np.bitwise_count(prints[at] ^ prints[at + d]) <= distance]
        found_a.append(hit)
        found_b.append(hit + d)
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (none, none)


def links(prints: DataFrame, distance: int = DISTANCE, split: int = SPLIT) -> DataFrame:
    """prints: fp (bigint, distinct). Returns a, b: edges that connect exactly the fingerprints that chains of links
    within distance (3 at most) connect. A task keeps one edge a fingerprint, not all pairs of a dense group, and holds
    split fingerprints of one anchor at most: of more, it passes all on, each to four groups by a byte of its other half."""
    if distance > DISTANCE:
        raise ValueError("the two halves cover three differing bits at most")

    def replicate(batches):
        for batch in batches:
            own = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(own), 20_000):
                part = own[i : i + 20_000]
                keys, owner = anchors(part)
                yield pa.RecordBatch.from_arrays([long_array(keys), long_array(part[owner])], ["key", "fp"])

    def compare(batches, pairs, most):
        """Edges (crowd null), and what is to be compared elsewhere: a, a fingerprint, in crowd (b null)."""
        none = np.zeros(0, np.uint64)
        edges_a, edges_b, held = [none], [none], 0
        carry_k = carry_p = none
        crowd = None  # the anchor that is being passed on

        def stars():
            a, b = local_stars(np.concatenate(edges_a), np.concatenate(edges_b))
            return [a], [b], len(a)

        def sent():
            a, b = long_array(edges_a[0]), long_array(edges_b[0])
            return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), a, b], ["crowd", "a", "b"])

        def passed_on(keys, own):
            other = _other(keys, own)
            for k in range(4):
                group = keys | U(k << 33) | (((other >> U(8 * k)) & U(255)) << U(35))
                yield pa.RecordBatch.from_arrays([long_array(group), long_array(own), pa.nulls(len(own), pa.int64())], ["crowd", "a", "b"])

        for batch in batches:
            keys = np.concatenate([carry_k, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)])
            own = np.concatenate([carry_p, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if crowd is not None:
                end = np.searchsorted(keys, crowd, "right")
                yield from passed_on(keys[:end], own[:end])
                keys, own = keys[end:], own[end:]
            cut = np.searchsorted(keys, keys[-1]) if len(keys) else 0
            carry_k, carry_p = keys[cut:], own[cut:]
            if len(keys):
                crowd = None
            if most is not None and len(carry_k) > most:
                crowd = carry_k[0]
                yield from passed_on(carry_k, carry_p)
                carry_k = carry_p = none
            a, b = pairs(keys[:cut], own[:cut], distance)
            edges_a.append(own[a])
            edges_b.append(own[b])
            held += len(a)
            if held > 500_000:
                edges_a, edges_b, held = stars()
                if held > 250_000:  # a task's own state stays bounded; what is sent keeps its links
                    yield sent()
                    edges_a, edges_b, held = [none], [none], 0
        a, b = pairs(carry_k, carry_p, distance)
        edges_a.append(carry_p[a])
        edges_b.append(carry_p[b])
        edges_a, edges_b, _ = stars()
        yield sent()

    found = "crowd bigint, a bigint, b bigint"
    met = prints.mapInArrow(replicate, "key bigint, fp bigint").repartition("key").sortWithinPartitions("key")
    first = written(met.mapInArrow(lambda batches: compare(batches, close_pairs, split), found))
    crowds = first.where("crowd IS NOT NULL").select("crowd", "a").repartition("crowd").sortWithinPartitions("crowd")
    second = crowds.mapInArrow(lambda batches: compare(batches, in_groups, None), found)
    return first.where("crowd IS NULL").select("a", "b").union(second.select("a", "b"))


def fingerprint_table(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """doc_id, key (see row_key), fp (bigint bits of the fingerprint), one row for each row of docs."""

    def scan(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), long_array(fingerprints(texts_of(part.column("text"))))], ["doc_id", "key", "fp"])

    rows = docs.select(F.col(ident).cast("bigint").alias("doc_id"), row_key(text, ident).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(scan, "doc_id bigint, key bigint, fp bigint")


def near_duplicates(docs: DataFrame, text: str = "text", ident: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id, the smallest doc_id that
    chains of links reach, and stays, true for the row (and its exact repeats) that stands for its component.

    Null and empty texts, and texts of separators alone, have fingerprint zero and link like any other. Rows that
    repeat share fingerprint and component. A null doc_id stays null and sorts after all others: its component is
    the smallest doc_id that is not null, or null. Other columns are not read, so their names may clash.
    """
    rows = written(fingerprint_table(docs, text, ident))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    classes = written(rows.groupBy("fp").agg(F.min(first).alias("least")))
    found = components(links(classes.select("fp"), distance))
    linked = classes.join(found, classes.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = linked.groupBy("root").agg(F.min("least").alias("first"))
    named = written(linked.join(least, "root").select("fp", "first"))
    joined = rows.join(named, "fp")  # both sides were written: Spark can split the partition of a hot fingerprint
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"), stays.alias("stays"), "key")


def one_of_each(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """docs with one row of each component: the one with the smallest doc_id (see near_duplicates)."""
    stay = near_duplicates(docs, text, ident).where("stays").select(F.col("key").alias("__key"), F.col("doc_id").alias("__id")).distinct()
    keyed = docs.withColumn("__key", row_key(text, ident))
    same = (keyed["__key"] == stay["__key"]) & keyed[ident].cast("bigint").eqNullSafe(stay["__id"])
    return keyed.join(stay, same, "left_semi").dropDuplicates(["__key", ident]).drop("__key")
