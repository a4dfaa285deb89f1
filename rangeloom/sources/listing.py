"""Listing files, and downloading them once."""

from __future__ import annotations

import fcntl
import os
import posixpath
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.functions.scalars import allowed, uri_parts
from rangeloom.model import MESSAGES, MIXED_BACKENDS
from rangeloom.sources import storage

DONE = "_SUCCESS"


def list_files(spark: SparkSession, path: str, recursive: bool = True, allow: list[str] | None = None, ignore: list[str] | None = None, match_on: str = "path") -> DataFrame:
    """path, length of regular files below path; a missing path is an error. Patterns meet the whole path, or with match_on
    "key" what follows scheme and bucket. Contents aren't read. An empty allow list keeps nothing."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "length")
    subject = F.col("path")
    if match_on == "key":
        subject = F.regexp_replace("path", r"^[a-z0-9]+:/+(?:[^/]+/)?", "") if "://" in path else F.regexp_replace("path", r"^file:/+", "")
    return rows.where(allowed(subject, allow, ignore))


def list_safetensors(spark: SparkSession, path: str) -> DataFrame:
    """The *.safetensors files right in a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.safetensors").load(path).select("path", "length")


def one_backend(files: DataFrame, path: str = "path") -> None:
    """Refuses a list that mixes storage schemes."""
    schemes = [r[0] for r in files.select(uri_parts(F.col(path))[0].alias("s")).distinct().limit(5).collect()]
    if len(schemes) > 1:
        raise ValueError(f"{MESSAGES[MIXED_BACKENDS]}: {sorted(schemes)}")


def safe_destination(base: str, relative: str) -> str:
    """Where a file goes below base; a path that leaves base is refused."""
    to = os.path.realpath(os.path.join(base, relative))
    root = os.path.realpath(base)
    if to != root and not to.startswith(root.rstrip(os.sep) + os.sep):
        raise ValueError(f"{relative!r} leads out of {base!r}")
    return to


def pull_files(spark: SparkSession, source: str, destination: str, allow: list[str] | None = None, ignore: list[str] | None = None, from_local: bool = False) -> DataFrame:
    """Copies files below source, a storage URI, into destination, a folder that all executors share, and leaves the mark
    _SUCCESS. With the mark there, nothing is copied again. Nothing to copy is an error, and leaves no mark; a local source is
    refused unless asked for. Returns path, to, length of the files copied."""
    os.makedirs(destination, exist_ok=True)
    with locked(destination):
        return _pull(spark, source, destination, allow, ignore, from_local)


@contextmanager
def locked(folder: str, kind: int = fcntl.LOCK_EX):
    """LOCK_EX: one process at a time; LOCK_SH: readers beside each other, none while files are being pulled. Between machines
    this holds where the shared folder's file system passes locks on; elsewhere the mark is what readers go by."""
    with open(os.path.join(folder, ".lock"), "w") as f:
        fcntl.flock(f, kind)
        yield


@contextmanager
def pulled(folder: str):
    """The folder for reading, once its pull is complete; pulls wait until the reader is done."""
    if not os.path.exists(os.path.join(folder, DONE)):
        raise FileNotFoundError(f"{folder} has no {DONE}: its files were not pulled, or not all")
    with locked(folder, fcntl.LOCK_SH):
        yield folder


def _pull(spark: SparkSession, source: str, destination: str, allow, ignore, from_local: bool) -> DataFrame:
    mark = os.path.join(destination, DONE)
    if os.path.exists(mark):
        return spark.createDataFrame([], "path string, to string, length bigint")
    if "://" not in source and not from_local:
        raise NotImplementedError("a local source has its files already")
    root = source.rstrip("/") + "/"
    found = list_files(spark, source, True, allow, ignore)
    cut = posixpath.join("file:" + root) if "://" not in source else root

    def copy(batches):
        for batch in batches:
            to_all, sizes = [], []
            for path in batch.column("path").to_pylist():
                plain = path.removeprefix("file:") if path.startswith("file:") else path
                to = safe_destination(destination, path.removeprefix(cut))
                os.makedirs(os.path.dirname(to), exist_ok=True)
                system, inner = storage.located(plain)
                part = f"{to}.part-{os.getpid()}"
                with system.open_input_stream(inner) as f, open(part, "wb") as out:
                    while block := f.read(8 << 20):
                        out.write(block)
                os.replace(part, to)  # a task that runs twice leaves one whole file
                to_all.append(to)
                sizes.append(os.path.getsize(to))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(to_all, pa.string()), pa.array(sizes, pa.int64())], ["path", "to", "length"])

    copied = found.select("path").repartition(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(copy, "path string, to string, length bigint").toArrow()
    if not copied.num_rows:
        raise FileNotFoundError(f"no file below {source} matches")
    with open(mark, "w"):
        pass
    return spark.createDataFrame(copied)
