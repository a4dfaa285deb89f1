"""Division of ranges among workers, tasks and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.operators.ranges import flatten


def worker_shares(ranges: DataFrame, block: int, most: int, group: str | None = None) -> DataFrame:
    """group_id (0 without a group), workers, share and first_share: shares are whole blocks, and worker 0 has the rest as well."""
    total = ranges.groupBy((F.col(group) if group else F.lit(0)).alias("group_id")).agg(F.sum("size").cast("bigint").alias("total"))
    rows = total.withColumn("workers", F.greatest(F.least(F.expr(f"total div {block}"), F.lit(most)), F.lit(1)).cast("bigint"))
    rows = rows.withColumn("share", F.expr(f"(total div {block}) div workers * {block}"))
    return rows.withColumn("first_share", F.expr("share + total - share * workers"))


def divided(ranges: DataFrame, block: int, most: int, group: str | None = None) -> DataFrame:
    """Pieces of the ranges by worker: ordinal, worker, piece_offset, piece_size. The stream's bytes are dealt out in order; a range
    is cut where a worker has its share. A range without bytes goes to the worker being filled, at an edge to the earlier one.

    With a group (a column that all ranges of a file share), each group of files is divided among workers of its own.
    A range's workers follow from its first and last byte, so this needs no join of intervals."""
    flat = flatten(ranges, by_offset=False, group=group)
    shares = worker_shares(ranges, block, most, group)  # one row for each group
    rows = flat.join(shares, flat[group] == shares.group_id) if group else flat.crossJoin(F.broadcast(shares))
    worker = lambda place: f"IF(share = 0 OR {place} < first_share, 0L, 1L + ({place} - first_share) div share)"
    first = F.expr(f"IF(size = 0, {worker('greatest(start - 1, 0L)')}, {worker('start')})")
    last = F.expr(f"IF(size = 0, {worker('greatest(start - 1, 0L)')}, {worker('start + size - 1')})")
    rows = rows.withColumn("worker", F.explode(F.sequence(first, last)))
    low = F.expr("greatest(start, IF(worker = 0, 0L, first_share + (worker - 1) * share))")
    high = F.expr("least(start + size, first_share + worker * share)")
    return rows.select(*ranges.columns, "ordinal", "worker", (F.col("offset") + F.when(F.col("size") == 0, 0).otherwise(low - F.col("start"))).alias("piece_offset"), F.when(F.col("size") == 0, 0).otherwise(high - low).cast("bigint").alias("piece_size"))


def task_cuts(ranges: DataFrame, chunk: int, offset: str = "offset", size: str = "size") -> DataFrame:
    """Tasks: ranges cut at the multiples of chunk of their file's offsets. A range without bytes is one task."""
    last = f"greatest({offset} + {size} - 1, {offset})"
    rows = ranges.withColumn("block", F.explode(F.expr(f"sequence({offset} div {chunk}, {last} div {chunk})")))
    begin = F.expr(f"greatest({offset}, block * {chunk})")
    end = F.expr(f"least({offset} + {size}, (block + 1) * {chunk})")
    return rows.withColumn("task_offset", begin).withColumn("task_size", (end - begin).cast("bigint"))


def chunk_groups(ranges: DataFrame, chunk: int) -> DataFrame:
    """Reads: tasks of one file and one aligned block that touch are one read; tasks without bytes ride along, and a block of
    nothing else is none. file_id, block, chunk_offset, chunk_bytes, n_tasks."""
    from pyspark.sql import Window

    tasks = task_cuts(ranges, chunk)
    order = Window.partitionBy("file_id", "block").orderBy("range_index", "task_offset")
    turn = F.coalesce((F.col("task_offset") != F.lag(F.col("task_offset") + F.col("task_size")).over(order)).cast("int"), F.lit(0))
    tasks = tasks.withColumn("__turn", turn).withColumn("__group", F.sum("__turn").over(order))
    rows = tasks.groupBy("file_id", "block", "__group").agg(F.min("task_offset").alias("chunk_offset"), F.sum("task_size").alias("chunk_bytes"), F.count("*").alias("n_tasks"))
    return rows.where("chunk_bytes > 0").drop("__group")
