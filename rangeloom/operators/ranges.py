"""Operators on the relation of byte ranges: file_id, path, range_index, offset, size.

Sequences over all files are taken in two steps, within a file and over the table of files, so that no window
holds the rows of more than one file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contiguous_offsets(ranges: DataFrame, base: int = 0) -> DataFrame:
    """offset = base plus the sizes of the file's earlier ranges."""
    earlier = Window.partitionBy("file_id").orderBy("range_index").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("offset", base + F.coalesce(F.sum("size").over(earlier), F.lit(0)))


def flatten(ranges: DataFrame, by_offset: bool = True, group: str | None = None) -> DataFrame:
    """Adds ordinal (from 0) and start, the bytes before the range, in one stream: files in order of file_id, in a file by
    (offset, size, range_index), or in the order given by range_index. With a group, each group of files is a stream."""
    own = Window.partitionBy("file_id").orderBy(*(["offset", "size", "range_index"] if by_offset else ["range_index"]))
    rows = ranges.withColumn("__nth", F.row_number().over(own).cast("bigint") - 1)
    rows = rows.withColumn("__before", F.coalesce(F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    earlier = Window.partitionBy(*[group] * bool(group)).orderBy("file_id").rowsBetween(Window.unboundedPreceding, -1)  # over one row a file
    files = ranges.groupBy("file_id", *[group] * bool(group)).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    files = files.select("file_id", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__n"), F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("__bytes"))
    rows = rows.join(files, "file_id")
    return rows.withColumn("ordinal", F.col("__nth") + F.col("__n")).withColumn("start", F.col("__before") + F.col("__bytes")).drop("__nth", "__before", "__n", "__bytes")


def coalesce_runs(ranges: DataFrame) -> DataFrame:
    """Adds run_id (from 0 in each file): a range continues a run if it begins where the one before it, by range_index,
    ends. Input order is kept and never sorted; zero-size ranges continue runs. Destinations have no counterpart."""
    order = Window.partitionBy("file_id").orderBy("range_index")
    turn = F.coalesce((F.col("offset") != F.lag(F.col("offset") + F.col("size")).over(order)).cast("bigint"), F.lit(0))
    return ranges.withColumn("__turn", turn).withColumn("run_id", F.sum("__turn").over(order)).drop("__turn")


def run_totals(ranges: DataFrame) -> DataFrame:
    """One row for each run: file_id, run_id, offset, bytes, n_ranges."""
    return coalesce_runs(ranges).groupBy("file_id", "run_id").agg(F.min("offset").alias("offset"), F.sum("size").alias("bytes"), F.count("*").alias("n_ranges"))


def rebuilt_files(ordered: DataFrame) -> DataFrame:
    """Consecutive ranges of one path, in order of ordinal, become one new file with a new id: adds chunk_id and chunk_index."""
    order = Window.partitionBy("rank").orderBy("ordinal")
    turn = F.coalesce((F.col("path") != F.lag("path").over(order)).cast("bigint"), F.lit(0))
    rows = ordered.withColumn("__turn", turn).withColumn("chunk_id", F.sum("__turn").over(order)).drop("__turn")
    return rows.withColumn("chunk_index", F.row_number().over(Window.partitionBy("rank", "chunk_id").orderBy("ordinal")).cast("bigint") - 1)


def largest_and_total(ranges: DataFrame) -> DataFrame:
    return ranges.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"), F.coalesce(F.max("size"), F.lit(0)).alias("largest"), F.count("*").alias("n_ranges"), F.greatest(F.lit(1), F.count("*")).alias("metadata_rows"))


def bytes_per_file(ranges: DataFrame) -> DataFrame:
    return ranges.groupBy("file_id", "path").agg(F.sum("size").alias("bytes"), F.max("size").alias("largest"), F.count("*").alias("n_ranges"))


def layout_faults(ranges: DataFrame) -> DataFrame:
    """Ranges that break the rules of a file's data section: file_id, range_index, fault. Rows are taken by (offset, size), so
    that an empty range comes before a full one at the same place; every rule is reported, not just the first."""
    order = Window.partitionBy("file_id").orderBy("offset", "size", "range_index")
    end = F.col("offset") + F.col("size")
    following, nth = F.lead("offset").over(order), F.row_number().over(order)
    faults = F.array(
        F.when(F.col("size") < 0, "negative"), F.when((nth == 1) & (F.col("offset") != 0), "starts late"),
        F.when(following < end, "overlap"), F.when(following > end, "gap"),
    )
    return ranges.withColumn("__faults", faults).select("file_id", "range_index", F.explode(F.filter("__faults", lambda x: x.isNotNull())).alias("fault"))


def repeated_file_ids(files: DataFrame) -> DataFrame:
    return files.groupBy("file_id").agg(F.count("*").alias("times")).where("times > 1")


def checked_ranges(ranges: DataFrame) -> DataFrame:
    """The rows as they are; reading them fails where an offset or size is null or negative."""
    fine = F.coalesce((F.col("offset") >= 0) & (F.col("size") >= 0), F.lit(False))
    return ranges.withColumn("size", F.when(fine, F.col("size")).otherwise(F.raise_error(F.lit("offset and size must be zero or more"))))


def selected_names(ranges: DataFrame, names: DataFrame) -> DataFrame:
    """Ranges of the requested names (column name)."""
    return ranges.join(names.select("name").distinct(), "name", "left_semi")


def missing_names(ranges: DataFrame, names: DataFrame) -> DataFrame:
    return names.select("name").distinct().join(ranges, "name", "left_anti")


def names_in_several_files(ranges: DataFrame, names: DataFrame) -> DataFrame:
    return selected_names(ranges, names).groupBy("name").agg(F.countDistinct("file_id").alias("n_files")).where("n_files > 1")


def select_names(ranges: DataFrame, names) -> DataFrame:
    """What a reader asked for by name gets. None: everything, names in several files included. A string or nothing at all is
    refused; so are names that no file has, and names that more than one has."""
    if names is None:
        return ranges
    if isinstance(names, str) or not list(names):
        raise ValueError("names must be a collection with at least one name")
    asked = ranges.sparkSession.createDataFrame([(x,) for x in sorted(set(names))], "name string")
    typed = asked.select(F.col("name").cast(dict(ranges.dtypes)["name"]).alias("name"))
    if lost := [r.name for r in missing_names(ranges, typed).orderBy("name").take(20)]:
        raise ValueError(f"no file has {lost}")
    if twice := [r.name for r in names_in_several_files(ranges, typed).orderBy("name").take(20)]:
        raise ValueError(f"more than one file has {twice}")
    return selected_names(ranges, typed)
