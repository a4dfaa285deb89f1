"""Completion, error accounting and order of responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rangeloom.model import FILE_ACCESS, FINISHED, RETRYABLE, SUCCESS


def request_completion(tasks: DataFrame) -> DataFrame:
    """tasks: request_id, event_seq, code (null: still open). A request is finished when all its tasks are; the last code that
    isn't success is its code."""
    done = tasks.groupBy("request_id").agg(
        F.count("*").alias("n_tasks"), F.count("code").alias("n_done"),
        F.coalesce(F.max_by("code", F.when(F.col("code") != SUCCESS, F.col("event_seq"))), F.lit(SUCCESS)).alias("code"),
    )
    return done.withColumn("finished", F.col("n_tasks") == F.col("n_done"))


def submission_completion(responses: DataFrame) -> DataFrame:
    """responses: submission_id, size, at_ms (null: not yet). remaining, bytes, elapsed_ms, bytes_per_s (0 for no time)."""
    rows = responses.groupBy("submission_id").agg(
        (F.count("*") - F.count("at_ms")).alias("remaining"), F.coalesce(F.sum(F.when(F.col("at_ms").isNotNull(), F.col("size"))), F.lit(0)).alias("bytes"),
        F.coalesce(F.max("at_ms") - F.min("at_ms"), F.lit(0)).alias("elapsed_ms"),
    )
    return rows.withColumn("bytes_per_s", F.when(F.col("elapsed_ms") == 0, F.lit(0)).otherwise(F.expr("bytes * 1000 div greatest(elapsed_ms, 1)")))


def session_throughput(responses: DataFrame) -> DataFrame:
    """One row: bytes, elapsed_ms and bytes_per_s over everything that was answered."""
    return submission_completion(responses.withColumn("submission_id", F.lit(0))).drop("submission_id", "remaining")


def attributed_errors(tasks: DataFrame) -> DataFrame:
    """tasks: workload_id, file_id, range_index, event_seq, code (null: unanswered). The first error of a file in a workload is
    given to all of the file's ranges there that had no success; answered ranges keep theirs. A retryable code leaves as file access error."""
    each = tasks.groupBy("workload_id", "file_id", "range_index").agg(F.max(F.coalesce((F.col("code") == SUCCESS).cast("int"), F.lit(0))).alias("ok"))
    failed = tasks.where(F.col("code") != SUCCESS)
    first = failed.groupBy("workload_id", "file_id").agg(F.min_by("code", "event_seq").alias("error"))
    code = F.when(F.col("ok") == 1, F.lit(SUCCESS)).when(F.col("error") == RETRYABLE, F.lit(FILE_ACCESS)).otherwise(F.col("error"))
    return each.join(first, ["workload_id", "file_id"], "left").select("workload_id", "file_id", "range_index", code.cast("int").alias("code"))


def stray_responses(responses: DataFrame, submissions: DataFrame) -> DataFrame:
    """Responses of unknown submissions, and those beyond one for each range: with the reason."""
    unknown = responses.join(submissions.select("submission_id").distinct(), "submission_id", "left_anti").withColumn("reason", F.lit("unknown submission"))
    order = Window.partitionBy("submission_id", "file_index", "range_index").orderBy("event_seq")
    again = responses.withColumn("__nth", F.row_number().over(order)).where("__nth > 1").drop("__nth").withColumn("reason", F.lit("delivered before"))
    return unknown.unionByName(again.join(submissions.select("submission_id").distinct(), "submission_id", "left_semi"))


def live_only(responses: DataFrame, live: DataFrame) -> DataFrame:
    """Late responses of submissions that have failed or ended are dropped, without an error."""
    return responses.join(live.select("submission_id").distinct(), "submission_id", "left_semi")


def ordered_yield(arrivals: DataFrame, stream: str | None = None) -> DataFrame:
    """arrivals: ordinal, arrival_seq. emit_at: the arrival that lets the row go, the latest of all ordinals up to its own.
    Rows of one stream share a window; without streams all rows do."""
    window = (Window.partitionBy(stream) if stream else Window.partitionBy()).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return arrivals.withColumn("emit_at", F.max("arrival_seq").over(window))


def to_global(responses: DataFrame, requests: DataFrame) -> DataFrame:
    """responses: submission_id, file_index, range_index; requests: submission_id, file_index, file_id, range_base. Adds the file
    and range that the caller asked for."""
    rows = responses.join(requests, ["submission_id", "file_index"])
    return rows.withColumn("global_range", F.col("range_base") + F.col("range_index"))


def greatest_base(handles: DataFrame, bases: DataFrame, width: int) -> DataFrame:
    """handles: handle; bases: base. Adds base, the greatest one not above the handle, or null.

    Handles and bases meet in strips of width; what reaches a strip from those before it is one row a strip, so no window
    holds more than a strip or the table of strips."""
    strip = F.expr(f"pmod(handle, {width})")
    rows = handles.withColumn("__strip", ((F.col("handle") - strip) / width).cast("bigint"))
    marks = bases.select(F.col("base").alias("handle"), F.col("base").alias("__base")).distinct()
    marks = marks.withColumn("__strip", ((F.col("handle") - strip) / width).cast("bigint"))
    strips = marks.groupBy("__strip").agg(F.max("__base").alias("__last")).unionByName(rows.select("__strip").distinct().withColumn("__last", F.lit(None).cast("bigint")))
    strips = strips.groupBy("__strip").agg(F.max("__last").alias("__last"))
    earlier = Window.orderBy("__strip").rowsBetween(Window.unboundedPreceding, -1)  # a row a strip
    carried = strips.select("__strip", F.max("__last").over(earlier).alias("__carried"))
    both = rows.withColumn("__base", F.lit(None).cast("bigint")).withColumn("__asked", F.lit(1)).unionByName(marks.withColumn("__asked", F.lit(0)), allowMissingColumns=True)
    own = Window.partitionBy("__strip").orderBy("handle", "__asked").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__own", F.max("__base").over(own)).where("__asked = 1").join(carried, "__strip")
    return found.select(*handles.columns, F.coalesce("__own", "__carried").alias("base"))


def torn_down(tasks: DataFrame) -> DataFrame:
    """After a teardown nothing is still open: what has no code has the one of the end of all responses."""
    return tasks.withColumn("code", F.coalesce("code", F.lit(FINISHED)).cast("int"))


def chunk_outcomes(attempts: DataFrame) -> DataFrame:
    """attempts: chunk_id, range_id, at_ms, code, timeout_ms, a row for each try of a range. chunk_id, range_id, code.

    A chunk's ranges are read, fail and are tried again together. Its clock starts with its first try; tries beyond the
    timeout never happen, and a chunk without a success by then leaves as file access error, as does one that may not retry."""
    first = attempts.groupBy("chunk_id").agg(F.min("at_ms").alias("__first"))
    made = attempts.join(first, "chunk_id").where((F.col("at_ms") == F.col("__first")) | ((F.col("timeout_ms") > 0) & (F.col("at_ms") < F.col("__first") + F.col("timeout_ms"))))
    whole = made.groupBy("chunk_id", "at_ms").agg(F.max("code").alias("worst"))
    ends = whole.groupBy("chunk_id").agg(F.max((F.col("worst") == SUCCESS).cast("int")).alias("ok"), F.max_by("worst", "at_ms").alias("last"))
    code = F.when(F.col("ok") == 1, F.lit(SUCCESS)).when(F.col("last") == RETRYABLE, F.lit(FILE_ACCESS)).otherwise(F.col("last"))
    return attempts.select("chunk_id", "range_id").distinct().join(ends.select("chunk_id", code.cast("int").alias("code")), "chunk_id")


def in_slot_order(slots: DataFrame) -> DataFrame:
    return slots.orderBy("slot_id", "slot_offset", "ordinal")


def all_agree(values: DataFrame, column: str) -> DataFrame:
    """least, most, agree: whether all ranks hold one value; the least is what a group can count on."""
    return values.agg(F.min(column).alias("least"), F.max(column).alias("most")).withColumn("agree", F.col("least") == F.col("most"))
