"""Checks that hold between the tables of a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def conserved(asked: DataFrame, given: DataFrame) -> DataFrame:
    """One row: bytes and ranges that were asked for, and that were given out."""
    a = asked.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("asked"), F.count("*").alias("n_asked"))
    return a.crossJoin(given.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("given"), F.count("*").alias("n_given")))  # one row each


def differences(predicted: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of one side that the other lacks, with the side; none if the prediction held."""
    return predicted.exceptAll(found).withColumn("side", F.lit("predicted")).unionByName(found.exceptAll(predicted).withColumn("side", F.lit("found")))


def wrong_lengths(tensors: DataFrame, files: DataFrame) -> DataFrame:
    """tensors: path, file_offset, nbytes; files: path, length. Files whose length isn't what their last tensor's end says."""
    ends = tensors.groupBy("path").agg(F.max(F.col("file_offset") + F.col("nbytes")).alias("declared"))
    return ends.join(files.select("path", "length"), "path").where("declared <> length")


def unknown_dtypes(tensors: DataFrame) -> DataFrame:
    from rangeloom.model import dtype_table

    return tensors.join(F.broadcast(dtype_table(tensors.sparkSession)), "dtype", "left_anti")  # 18 rows
