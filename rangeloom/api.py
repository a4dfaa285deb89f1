"""Readers in the pull style: open files, then iterate tensors or ranges."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from rangeloom.functions.decode import values_of
from rangeloom.model import FINISHED, MESSAGES
from rangeloom.operators.partition import packed
from rangeloom.operators.ranges import checked_ranges, flatten
from rangeloom.operators.responses import in_slot_order
from rangeloom.session import ship
from rangeloom.sources.safetensors import read_ranges, scan


class TensorReader:
    """with TensorReader(spark) as r: r.stream_files(paths); for name, array in r.get_tensors(): ...

    tensor_names None: all; a string or an empty collection is refused. Tensors come in order of files and bytes; arrays are
    the caller's own. One partition at a time lies in the driver's memory."""

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark, self.tensors = spark, None

    def __enter__(self) -> TensorReader:
        return self

    def __exit__(self, *_) -> None:
        self.tensors = None

    def stream_file(self, path: str, tensor_names: Iterable[str] | None = None, **options) -> DataFrame:
        return self.stream_files([path], tensor_names, **options)

    def stream_files(self, paths: list[str], tensor_names: Iterable[str] | None = None, distributed: bool = False, **options) -> DataFrame:
        """The DataFrame behind get_tensors. distributed: files in order of their paths, not as given."""
        if isinstance(tensor_names, str):
            raise ValueError("tensor_names must be a collection of names")
        if tensor_names is not None:
            options["names"] = sorted(set(tensor_names))
            if not options["names"]:
                raise ValueError("tensor_names must have at least one name")
        self.in_order = options.get("partitionPolicy", "spans") == "spans"
        self.tensors = scan(self.spark, sorted(paths) if distributed else paths, **options)
        return self.tensors

    def get_tensors(self) -> Iterator[tuple[str, np.ndarray]]:
        if self.tensors is None:
            raise ValueError(MESSAGES[FINISHED])
        if not self.in_order:
            raise ValueError("get_tensors gives tensors in order of files and bytes, which only the policy spans keeps; use the DataFrame")
        for r in self.tensors.select("name", "dtype", "storage_shape", "data").toLocalIterator():
            yield r.name, values_of(bytes(r.data), r.dtype).reshape(r.storage_shape).copy()


class RangeReader:
    """Raw ranges: stream_ranges(df of file_id, path, range_index, offset, size), then get_chunks or get_slots."""

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark, self.ranges = spark, None

    def stream_ranges(self, ranges: DataFrame) -> None:
        self.ranges = checked_ranges(ranges)

    def get_chunks(self) -> Iterator[tuple[int, int, bytes]]:
        """(file_id, range_index, bytes), one for each range, empty ones included."""
        for r in read_ranges(self.ranges).select("file_id", "range_index", "data").toLocalIterator():
            yield r.file_id, r.range_index, bytes(r.data)

    def get_slots(self, slot_bytes: int, most_rows: int | None = None) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
        """(slot, its ranges), slot after slot."""
        rows = read_ranges(packed(flatten(self.ranges, by_offset=False), slot_bytes, most_rows))
        slot, held = None, []
        for r in in_slot_order(rows).select("slot_id", "file_id", "range_index", "data").toLocalIterator():
            if slot is not None and r.slot_id != slot:
                yield slot, held
                held = []
            slot = r.slot_id
            held.append((r.file_id, r.range_index, bytes(r.data)))
        if slot is not None:
            yield slot, held
