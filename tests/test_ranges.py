import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangeloom.operators import division, partition, ranges
from rangeloom.plans import ring

COLUMNS = "file_id int, path string, range_index int, offset bigint, size bigint"


def table(spark, rows):
    return spark.createDataFrame([(f, f"p{f}", i, o, s) for f, i, o, s in rows], COLUMNS)


def test_coalesce_keeps_input_order_and_empty_ranges(spark):
    df = table(spark, [(0, 0, 8, 4), (0, 1, 12, 0), (0, 2, 12, 5), (0, 3, 20, 1), (0, 4, 17, 3), (1, 0, 17, 2)])
    got = {(r.file_id, r.range_index): r.run_id for r in ranges.coalesce_runs(df).collect()}
    assert got == {(0, 0): 0, (0, 1): 0, (0, 2): 0, (0, 3): 1, (0, 4): 2, (1, 0): 0}


def test_layout_faults_sorts_empty_ranges_first(spark):
    fine = table(spark, [(0, 0, 0, 4), (0, 1, 4, 6), (0, 2, 4, 0), (1, 0, 0, 0)])
    assert ranges.layout_faults(fine).count() == 0
    bad = table(spark, [(0, 0, 1, 4), (0, 1, 4, 2), (0, 2, 9, 0), (1, 0, 0, -1)])
    assert {(r.file_id, r.range_index, r.fault) for r in ranges.layout_faults(bad).collect()} == {(0, 0, "starts late"), (0, 0, "overlap"), (0, 1, "gap"), (1, 0, "negative")}


def walk_division(sizes, block, most):
    total = sum(sizes)
    workers = max(min(total // block, most), 1)
    share = total // block // workers * block
    left = [share + total - share * workers] + [share] * (workers - 1)
    worker, out = 0, []
    for i, size in enumerate(sizes):
        while True:
            if left[worker] == 0 and size > 0 and worker + 1 < workers:
                worker += 1
            take = min(size, left[worker])
            out.append((i, worker, take))
            left[worker] -= take
            size -= take
            if not size:
                break
    return out


@pytest.mark.parametrize("seed", range(4))
def test_division_equals_a_walk(spark, seed):
    draw = random.Random(seed)
    sizes = [draw.choice([0, 0, 1, draw.randint(1, 30)]) for _ in range(40)]
    rows, at = [], 0
    for i, s in enumerate(sizes):
        rows.append((0, i, at, s))
        at += s
    got = sorted((r.range_index, r.worker, r.piece_size) for r in division.divided(table(spark, rows), 10, 5).collect())
    assert got == sorted(walk_division(sizes, 10, 5))


def test_task_cuts_keep_empty_ranges_and_cut_at_multiples(spark):
    got = sorted((r.range_index, r.task_offset, r.task_size) for r in division.task_cuts(table(spark, [(0, 0, 6, 9), (0, 1, 16, 0), (0, 2, 8, 8)]), 8).collect())
    assert got == [(0, 6, 2), (0, 8, 7), (1, 16, 0), (2, 8, 8)]


def test_chunk_of_empty_tasks_alone_is_none(spark):
    assert division.chunk_groups(table(spark, [(0, 0, 8, 0), (0, 1, 8, 0)]), 8).count() == 0


def test_least_loaded_ties():
    assert partition.least_loaded(np.array([5, 3, 3, 2]), 2).tolist() == [0, 1, 1, 0]
    assert partition.least_loaded(np.array([0, 0, 0]), 2).tolist() == [0, 0, 0]


@pytest.mark.parametrize("seed", range(30))
def test_spans_are_optimal(seed):
    draw = random.Random(seed)
    sizes = np.array([draw.choice([0, draw.randint(0, 20)]) for _ in range(draw.randint(0, 12))], np.int64)
    n = draw.randint(1, 5)
    starts = partition.span_starts(sizes, n).tolist()
    assert len(starts) == n and starts == sorted(starts) and starts[0] == 0
    parts = [sizes[a:b].sum() for a, b in zip(starts, [*starts[1:], len(sizes)], strict=True)]

    def best(i, k):
        if k == 1:
            return sizes[i:].sum()
        return min(max(sizes[i:j].sum(), best(j, k - 1)) for j in range(i, len(sizes) + 1))

    assert max(parts, default=0) == max(best(0, n), 0)


@pytest.mark.parametrize("cap", [None, 3])
def test_slots_equal_a_fold(cap):
    draw = random.Random(7)
    sizes = np.array([draw.choice([0, draw.randint(1, 50)]) for _ in range(200)])
    starts, used, n = [0], 0, 0
    for i, s in enumerate(sizes):
        if used + s > 60 or (cap and n == cap):
            starts.append(i)
            used = n = 0
        used, n = used + s, n + 1
    assert partition.slot_starts(sizes, 60, cap).tolist() == starts
    with pytest.raises(ValueError, match="does not fit"):
        partition.slot_starts(np.array([61]), 60)


def test_rank_bytes_shows_idle_ranks(spark):
    placed = partition.partitioned(table(spark, [(0, 0, 0, 4), (0, 1, 4, 0)]), 3)
    assert {r.rank: (r.bytes, r.n_ranges, r.runs) for r in partition.rank_bytes(placed, 3).collect()} == {0: (4, 2, 1), 1: (0, 0, 0), 2: (0, 0, 0)}
    with pytest.raises(ValueError, match="policy"):
        partition.partitioned(placed, 2, "none")


def test_names(spark):
    df = table(spark, [(0, 0, 0, 4), (1, 0, 4, 0), (1, 1, 4, 0)]).withColumn("name", ranges.F.concat(ranges.F.lit("t"), ranges.F.col("range_index")))
    assert ranges.select_names(df, None).count() == 3
    assert ranges.select_names(df, ["t1"]).count() == 1
    for bad in ("t1", [], ["t1", "lost"], ["t0"]):
        with pytest.raises(ValueError):
            ranges.select_names(df, bad)


def test_checked_ranges(spark):
    assert ranges.checked_ranges(table(spark, [(0, 0, 0, 0)])).count() == 1
    with pytest.raises(Exception, match="zero or more"):
        ranges.checked_ranges(table(spark, [(0, 0, 0, -1)])).collect()


def test_rings():
    assert ring.host_ring([], -1) == (0, 1)
    assert ring.host_ring([0, 0], 100) == (0, 1)
    assert ring.host_ring([10, 30, 5], 0) == (30, 1)
    assert ring.host_ring([10] * 40, -1, 4) == (100, 4)
    assert ring.host_ring([10] * 40, 100, 4) == (25, 4)
    assert ring.host_ring([7] * 10, 200, 4) == (21, 4)  # 17 holds two of them; room beyond the stream buys three
    with pytest.raises(ring.LimitError):
        ring.host_ring([10], 5)
    with pytest.raises(ring.LimitError):
        ring.host_ring([10], -2)
    assert ring.device_ring([100], 150, 1) is None and ring.device_ring([100], None) is None and ring.device_ring([0], 0) == (0, 1)
    assert ring.device_ring([100], 1000) == (100, 1)  # a stream that fits one slot keeps one
    assert ring.device_ring([100] * 8, 1000, 1) == (500, 2) and ring.device_ring([100] * 8, 1000) == (250, 2)
    assert ring.device_ring([100] * 8, 10_000) == (800, 1) and ring.device_ring([100] * 8, 10_000, most_rows=5) == (800, 2)
    assert ring.device_ring([100] * 8, 10_000, limit=300) == (150, 2)
    assert ring.device_ring([100] * 8, 10_000, limit=300, beside=1) == (100, 2) and ring.device_ring([100] * 8, 10_000, limit=250, beside=1) == (100, 1)
    assert ring.device_ring([100] * 8, 10_000, limit=200, beside=2) is None
    for bad in ({"share": 0}, {"share": 1.5}, {"limit": 0}, {"limit": -1}):
        with pytest.raises(ValueError):
            ring.device_ring([1], 10, **bad)


@pytest.mark.parametrize("seed", range(4))
def test_spans_from_blocks_equal_those_from_all_sizes(spark, seed):
    draw = np.random.Generator(np.random.PCG64(seed))
    sizes = draw.integers(0, [3, 1000, 10**12, 50][seed], 500)
    sizes[draw.random(500) < [0.9, 0.1, 0, 0.5][seed]] = 0
    start = np.cumsum(sizes) - sizes
    flat = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(start, sizes, strict=True))], "ordinal bigint, start bigint, size bigint")
    for ranks in (1, 2, 5, 40):
        whole = partition.span_starts(sizes, ranks).tolist()
        for blocks in (3, 29, 10**6):
            assert partition.span_cuts(flat, ranks, blocks).tolist() == whole
    assert partition.span_cuts(flat.limit(0), 3).tolist() == [0, 0, 0]


def test_too_many_ranges_for_the_driver_are_refused(spark, monkeypatch):
    monkeypatch.setattr(partition, "DRIVER_RANGES", 3)
    rows = spark.range(4).select(F.col("id").alias("ordinal"), F.lit(1).cast("bigint").alias("size"))
    with pytest.raises(ValueError, match="4 ranges"):
        partition.packed(rows, 10)
    assert ring.rank_limit(-1, 8, 5) == -1 and ring.rank_limit(80, 8, 50) == 50
