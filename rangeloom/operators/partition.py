"""Sharing ranges among ranks, and packing them into slots.

Both fill parts in order, so both work on the running sums of the sizes. Contiguous spans need few of them: the
sums at the edges of blocks bound each cut, and only blocks that a cut may lie in are looked into. Slots and the
largest-first rule depend on every range; their sizes go to the driver, 8 bytes a range, up to a stated number.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from rangeloom.operators.ranges import flatten

POLICIES = ("spans", "chunks", "files")
#: Ranges whose sizes the driver takes at most for slots and largest-first, half a GB.
DRIVER_RANGES = 1 << 26
#: Blocks that spans are first looked at in; with fewer ranges a block is one range.
BLOCKS = 1 << 16
#: Capacities that one turn of a search tries side by side.
TRIED = 64


def least_loaded(sizes: np.ndarray, ranks: int) -> np.ndarray:
    """Ranks of the sizes: largest first, each to the least loaded rank; ties keep input order and take the lowest rank."""
    out = np.zeros(len(sizes), np.int32)
    loads = [(0, r) for r in range(ranks)]
    for i in np.argsort(-sizes, kind="stable"):
        load, rank = loads[0]
        out[i] = rank
        heapq.heapreplace(loads, (load + int(sizes[i]), rank))
    return out


def sums_of(sizes: np.ndarray) -> np.ndarray:
    """Running sums from 0: place i holds the bytes before range i."""
    return np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))])


def filled(sums: np.ndarray, capacities: np.ndarray, parts: int) -> np.ndarray:
    """For each capacity the place in sums that so many parts reach if each takes in order all that fits."""
    place = np.zeros(len(capacities), np.int64)
    for _ in range(parts):
        place = np.searchsorted(sums, sums[place] + capacities, "right") - 1
    return place


def least_capacity(sums: np.ndarray, parts: int, low: int, high: int) -> int | None:
    """The smallest whole capacity from low to high with which so many parts hold everything; None if high is too small."""
    while True:
        tried = np.array(sorted({low + (high - low) * i // (TRIED - 1) for i in range(TRIED)}), np.int64)
        enough = filled(sums, tried, parts) == len(sums) - 1
        if not enough.any():
            return None
        first = int(enough.argmax())
        if not first or tried[first] == tried[first - 1] + 1:
            return int(tried[first])
        low, high = int(tried[first - 1]) + 1, int(tried[first])


def slot_starts(sizes: np.ndarray, slot_bytes: int, most_rows: int | None = None) -> np.ndarray:
    """First ordinals of the slots: each takes ranges in order while they fit; a range without bytes always fits."""
    if len(sizes) and int(sizes.max()) > slot_bytes:
        raise ValueError(f"a range of {int(sizes.max())} bytes does not fit a slot of {slot_bytes}")
    sums = sums_of(sizes)
    # Where a slot that began at each range would end; the slots are one chain through these.
    after = np.searchsorted(sums, sums[:-1] + slot_bytes, "right") - 1
    if most_rows:
        after = np.minimum(after, np.arange(len(sizes)) + most_rows)
    chain, at, after = [], 0, after.tolist()
    while at < len(after):
        chain.append(at)
        at = after[at]
    return np.array(chain, np.int64)


def span_starts(sizes: np.ndarray, ranks: int) -> np.ndarray:
    """First ordinals of the contiguous parts whose largest is as small as possible; later parts may be empty."""
    sums = sums_of(sizes)
    total, largest = int(sums[-1]), int(np.max(sizes, initial=0))
    return _cut(sums, np.arange(len(sums)), ranks, *_bounds(total, largest, ranks))


def _bounds(total: int, largest: int, ranks: int) -> tuple[int, int]:
    return max(largest, -(-total // ranks)), max(total, largest)


def _cut(sums: np.ndarray, ordinals: np.ndarray, ranks: int, low: int, high: int) -> np.ndarray:
    best = np.array([least_capacity(sums, ranks, low, high)])
    return np.array([0, *(int(ordinals[filled(sums, best, k)[0]]) for k in range(1, ranks))], np.int64)


def span_cuts(flat: DataFrame, ranks: int, blocks: int = BLOCKS) -> np.ndarray:
    """span_starts of a frame with ordinal, start and size, which stays where it lies.

    The best capacity for cuts at block edges is at most the largest block above the best one, so every cut of the
    answer lies between two known sums; the driver gets a row for each block, and the ranges of the blocks that these
    bounds touch, about ranks squared of them."""
    n, total, largest = flat.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    width = max(1, -(-n // blocks))
    edges = flat.groupBy(F.expr(f"ordinal div {width}").alias("block")).agg(F.min("start").alias("start")).toArrow()
    edge = np.sort(edges.column("start").to_numpy())
    sums, ordinals = np.append(edge, total), np.minimum(np.arange(len(edge) + 1) * width, n)
    low, high = _bounds(total, largest, ranks)
    if width > 1:
        high = least_capacity(sums, ranks, max(low, int(np.diff(sums).max())), high)
        low = max(low, high - int(np.diff(sums).max()))
        touched, least, most = set(), 0, 0
        for _ in range(ranks):
            first = np.searchsorted(edge, least + low, "right") - 1
            least, most = int(edge[first]), min(most + high, total)
            touched.update(range(first, int(np.searchsorted(edge, most, "right"))))
        within = flat.sparkSession.createDataFrame(pa.table({"block": pa.array(sorted(touched), pa.int64())}))
        inside = flat.select(F.expr(f"ordinal div {width}").alias("block"), "ordinal", "start").join(F.broadcast(within), "block").toArrow()  # a row a block at most
        rows = np.unique(np.stack([np.append(sums, inside.column("start").to_numpy()), np.append(ordinals, inside.column("ordinal").to_numpy())], 1), axis=0)
        sums, ordinals = rows[:, 0], rows[:, 1]
    return _cut(sums, ordinals, ranks, low, high)


def stream_sizes(flat: DataFrame) -> np.ndarray:
    """Sizes by ordinal, on the driver: DRIVER_RANGES of them at most."""
    if (n := flat.count()) > DRIVER_RANGES:
        raise ValueError(f"{n} ranges; slots and largest-first are decided over {DRIVER_RANGES} at most: pack groups of files, or use the policy spans or files")
    table = flat.select("ordinal", "size").toArrow()
    out = np.zeros(table.num_rows, np.int64)
    out[table.column("ordinal").to_numpy()] = table.column("size").to_numpy()
    return out


def part_of(starts: np.ndarray) -> Column:
    """Which of the parts that begin at these ordinals a row's ordinal is in; for as many parts as there are ranks."""
    return (F.size(F.filter(F.array(*[F.lit(int(x)) for x in starts]), lambda x: x <= F.col("ordinal"))) - 1).cast("int")


def _placed(flat: DataFrame, column: str, of) -> DataFrame:
    """flat with an int column that numpy derives from ordinal."""

    def add(batches):
        for batch in batches:
            values = of(batch.column("ordinal").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values.astype(np.int32))], [*batch.schema.names, column])

    return flat.mapInArrow(add, StructType([*flat.schema.fields, StructField(column, IntegerType())]))


def partitioned(ranges: DataFrame, ranks: int, policy: str = "spans") -> DataFrame:
    """ranges with ordinal, start and rank. spans: contiguous parts; chunks: each range by itself; files: whole files."""
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    flat = flatten(ranges, by_offset=policy == "spans")
    if policy == "spans":
        return flat.withColumn("rank", part_of(span_cuts(flat, ranks)))
    if policy == "chunks":
        of = ranges.sparkSession.sparkContext.broadcast(least_loaded(stream_sizes(flat), ranks))
        return _placed(flat, "rank", lambda x: of.value[x])
    files = ranges.groupBy("file_id").agg(F.sum("size").alias("size")).orderBy("file_id").toArrow()
    rank = least_loaded(files.column("size").to_numpy(), ranks)
    table = ranges.sparkSession.createDataFrame(pa.table({"file_id": files.column("file_id"), "rank": pa.array(rank)}))
    return flat.join(table, "file_id")


def share_of(ranges: DataFrame, ranks: int, rank: int, policy: str = "spans") -> DataFrame:
    return partitioned(ranges, ranks, policy).where(F.col("rank") == rank)


def rank_bytes(placed: DataFrame, ranks: int) -> DataFrame:
    """rank, bytes, n_ranges, runs (sequential stretches by file and offset); ranks without data have zeros."""
    from pyspark.sql import Window

    order = Window.partitionBy("rank", "file_id").orderBy("offset", "size", "range_index")
    rows = placed.withColumn("__new", (~F.coalesce(F.col("offset") == F.lag(F.col("offset") + F.col("size")).over(order), F.lit(False))).cast("bigint"))
    sums = rows.groupBy("rank").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_ranges"), F.sum("__new").alias("runs"))
    everyone = placed.sparkSession.range(ranks).select(F.col("id").cast("int").alias("rank"))
    return everyone.join(sums, "rank", "left").na.fill(0, ["bytes", "n_ranges", "runs"])


def packed(flat: DataFrame, slot_bytes: int, most_rows: int | None = None) -> DataFrame:
    """flat (with ordinal and size) with slot_id and slot_offset, the bytes before the range in its slot."""
    from pyspark.sql import Window

    starts = flat.sparkSession.sparkContext.broadcast(slot_starts(stream_sizes(flat), slot_bytes, most_rows))
    rows = _placed(flat, "slot_id", lambda x: np.searchsorted(starts.value, x, "right") - 1)
    earlier = Window.partitionBy("slot_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("slot_offset", F.coalesce(F.sum("size").over(earlier), F.lit(0)))


def slot_fill(slots: DataFrame, slot_bytes: int) -> DataFrame:
    """n_slots, bytes, widest (ranges in one slot), fill (share of the slots' bytes)."""
    each = slots.groupBy("slot_id").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    return each.agg(F.count("*").alias("n_slots"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"), F.coalesce(F.max("n"), F.lit(0)).alias("widest")).withColumn("fill", F.round(F.col("bytes") / (F.col("n_slots") * slot_bytes), 6))


def predicted_slots(ranges: DataFrame, ranks: int, slot_bytes: int, most_rows: int | None = None) -> DataFrame:
    """Slots of every rank of the spans policy, from the file list alone: adds rank, slot_id (from 0 in each rank), slot_offset."""
    from pyspark.sql import Window

    flat = flatten(ranges)
    sizes = stream_sizes(flat)
    starts = span_starts(sizes, ranks)
    ends = np.append(starts[1:], len(sizes))
    slots = [a + slot_starts(sizes[a:b], slot_bytes, most_rows) for a, b in zip(starts, ends, strict=True)]
    context = ranges.sparkSession.sparkContext
    every, before = context.broadcast(np.concatenate(slots)), [0, *np.cumsum([len(x) for x in slots]).tolist()]
    rows = _placed(flat, "__slot", lambda x: np.searchsorted(every.value, x, "right") - 1).withColumn("rank", part_of(starts))
    rows = rows.withColumn("slot_id", F.col("__slot") - F.get(F.array(*[F.lit(x) for x in before]), F.col("rank"))).drop("__slot")
    earlier = Window.partitionBy("rank", "slot_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("slot_offset", F.coalesce(F.sum("size").over(earlier), F.lit(0)))


def delivered(placed: DataFrame, ranks: int) -> DataFrame:
    """Every range once for each rank that receives it: owners send to all. The rows grow with ranks, so ranks is one small range."""
    to = placed.sparkSession.range(ranks).select(F.col("id").cast("int").alias("to_rank"))
    return placed.withColumnRenamed("rank", "from_rank").crossJoin(F.broadcast(to))
