"""The Spark data source "safetensors": one row for each tensor, or for each block of one.

Options: withData (true), blockBytes (0: whole tensors), partitionPolicy (spans, chunks, files), numPartitions
(the default parallelism given as an option by register, or 8), chunkBytes (8 MiB: small tensors beside each other
are read at once up to this size), checkLength (true), ordered (true: paths stay in the order given), retrySeconds (0),
names (JSON list: only these tensors; unknown ones and ones in several files are refused), pathRewrite (old=new: a prefix
of paths is replaced, so that tests read local files in place of remote ones). Credentials and endpoints are the file
system's own settings.

Headers are read and checked once, by the planner, before any filter. Filters on name and path skip bytes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import BinaryType, StructField, StructType

from rangeloom.model import MESSAGES, MIXED_BACKENDS, TENSORS
from rangeloom.operators.partition import POLICIES, least_loaded, span_starts
from rangeloom.functions.scalars import scheme_of
from rangeloom.sources import storage
from rangeloom.sources.header import Tensor, packed_header, read_header

BATCH_BYTES = 32 << 20
#: Headers that the planner reads side by side.
HEADERS_AT_ONCE = 32


@dataclass
class Share(InputPartition):
    """What one task reads: (file_id, path, where the data starts, tensors)."""

    files: list[tuple[int, str, int, list[Tensor]]]

    def __init__(self, files):
        self.value = 0
        self.files = files


class SafetensorsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "safetensors"

    def _on(self, key: str, default: str) -> str:
        return self.options.get(key, default)

    def schema(self) -> str:
        if int(self._on("blockBytes", "0")) > 0:
            return TENSORS + ", block_index int, block_offset bigint, block binary"
        return TENSORS + (", data binary" if self._on("withData", "true") == "true" else "")

    def reader(self, schema):
        return (PushingReader if self._on("pushdown", "false") == "true" else Reader)(self.options)


class Reader(DataSourceReader):
    def __init__(self, options):
        self.o = dict(options)
        raw = self.o.get("paths")
        self.paths = json.loads(raw) if raw else [self.o["path"]]
        old, sign, new = self._option("pathRewrite", "").partition("=")
        if sign:
            self.paths = [new + p[len(old) :] if p.startswith(old) else p for p in self.paths]
        self.with_data = self.o.get("withdata", self.o.get("withData", "true")) == "true"
        self.block = int(self.o.get("blockBytes", self.o.get("blockbytes", "0")))
        self.chunk = int(self.o.get("chunkBytes", self.o.get("chunkbytes", str(8 << 20))))
        self.retry = float(self.o.get("retrySeconds", self.o.get("retryseconds", "0")))
        self.names: set[str] | None = None
        self.only_paths: set[str] | None = None

    def _option(self, key: str, default: str) -> str:
        return self.o.get(key, self.o.get(key.lower(), default))

    def _files(self) -> list[tuple[int, str, int, list[Tensor]]]:
        def header(path: str) -> tuple[int, list[Tensor]]:
            read, close = storage.reader(path, self.retry)
            try:
                return read_header(read, path, storage.length_of(path) if self._option("checkLength", "true") == "true" else None)
            finally:
                close()

        paths = storage.expand(self.paths)
        with ThreadPoolExecutor(max(1, min(HEADERS_AT_ONCE, len(paths)))) as pool:
            return [(i, path, *found) for i, (path, found) in enumerate(zip(paths, pool.map(header, paths), strict=True))]

    def _asked(self, files) -> set[str] | None:
        raw = self._option("names", "")
        if not raw:
            return None
        names = json.loads(raw)
        if isinstance(names, str) or not names:
            raise ValueError("names must be a list with at least one name")
        seen: dict[str, int] = {}
        for _, _, _, tensors in files:
            for t in tensors:
                seen[t.name] = seen.get(t.name, 0) + 1
        if lost := sorted(set(names) - set(seen)):
            raise ValueError(f"no file has {lost}")
        if twice := sorted(x for x in set(names) if seen[x] > 1):
            raise ValueError(f"more than one file has {twice}")
        return set(names)

    def partitions(self) -> list[InputPartition]:
        files = self._files()
        asked = self._asked(files)
        chosen = [(f, t) for f in files for t in f[3] if (asked is None or t.name in asked) and (self.names is None or t.name in self.names) and (self.only_paths is None or f[1] in self.only_paths)]
        parts = int(self._option("numPartitions", "8"))
        policy = self._option("partitionPolicy", "spans")
        if policy not in POLICIES:
            raise ValueError(f"partitionPolicy must be one of {POLICIES}")
        sizes = np.array([t.end - t.start for _, t in chosen], np.int64)
        if policy == "spans":
            rank = np.searchsorted(span_starts(sizes, parts), np.arange(len(sizes)), "right") - 1
        elif policy == "chunks":
            rank = least_loaded(sizes, parts)
        else:
            ids = np.array([f[0] for f, _ in chosen], np.int64)
            rank = least_loaded(np.bincount(ids, sizes, len(files)).astype(np.int64), parts)[ids] if len(ids) else ids
        shares: list[dict] = [{} for _ in range(parts)]
        for (f, t), r in zip(chosen, rank, strict=True):
            shares[r].setdefault(f[0], (f[0], f[1], f[2], []))[3].append(t)
        return [Share(list(s.values())) for s in shares if s] or [Share([])]

    def _rows(self, share: Share) -> Iterator[tuple[list, int]]:
        for file_id, path, base, tensors in share.files:
            close = None
            if self.with_data or self.block:
                read, close = storage.reader(path, self.retry)
            for run in _runs(tensors, self.chunk):
                whole = None
                if self.with_data and not self.block:
                    whole = storage.exact(read, base + run[0].start, run[-1].end - run[0].start, path)
                for t in run:
                    row = [file_id, path, t.index, t.name, t.dtype, list(t.shape), list(t.storage_shape), t.item_count, t.start, t.end, base + t.start, t.end - t.start]
                    if self.block:
                        # A tensor without bytes is one empty block.
                        for i, at in enumerate(range(t.start, max(t.end, t.start + 1), self.block)):
                            size = min(self.block, t.end - at)
                            yield [*row, i, at - t.start, storage.exact(read, base + at, size, path)], size
                    elif self.with_data:
                        yield [*row, whole[t.start - run[0].start : t.end - run[0].start]], t.end - t.start
                    else:
                        yield row, 0
            if close:
                close()

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        fields = [
            ("file_id", pa.int32()), ("path", pa.string()), ("tensor_index", pa.int32()), ("name", pa.string()), ("dtype", pa.string()), ("shape", pa.list_(pa.int64())), ("storage_shape", pa.list_(pa.int64())),
            ("item_count", pa.int64()), ("data_start", pa.int64()), ("data_end", pa.int64()), ("file_offset", pa.int64()), ("nbytes", pa.int64()),
        ]
        if self.block:
            fields += [("block_index", pa.int32()), ("block_offset", pa.int64()), ("block", pa.binary())]
        elif self.with_data:
            fields.append(("data", pa.binary()))
        schema, held, size = pa.schema(fields), [], 0
        for row, n in self._rows(partition):
            held.append(row)
            size += n
            if size >= BATCH_BYTES or len(held) >= 8192:
                yield _batch(held, schema)
                held, size = [], 0
        if held:
            yield _batch(held, schema)


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _runs(tensors: list[Tensor], chunk: int) -> Iterator[list[Tensor]]:
    """Tensors that touch, read at once while they stay within chunk bytes."""
    run: list[Tensor] = []
    for t in tensors:
        if run and (t.start != run[-1].end or t.end - run[0].start > chunk):
            yield run
            run = []
        run.append(t)
    if run:
        yield run


class PushingReader(Reader):
    """Takes equality and IN on name and path; Spark applies the rest."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column not in ("name", "path"):
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            kept = self.names if column == "name" else self.only_paths
            values = values if kept is None else values & kept
            if column == "name":
                self.names = values
            else:
                self.only_paths = values


def scan(spark: SparkSession, paths: str | list[str], **options):
    """A DataFrame of tensors; paths of one storage backend. Filter pushdown into Python sources is switched on for the session."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if len(schemes := {scheme_of(p) for p in paths}) > 1:
        raise ValueError(f"{MESSAGES[MIXED_BACKENDS]}: {sorted(schemes)}")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SafetensorsSource)
    read = spark.read.format("safetensors").option("paths", json.dumps(paths)).option("pushdown", "true")
    read = read.option("numPartitions", options.pop("numPartitions", spark.sparkContext.defaultParallelism))
    for key, value in options.items():
        read = read.option(key, json.dumps(value) if isinstance(value, list) else str(value).lower() if isinstance(value, bool) else value)
    return read.load()


def write(tensors, folder: str, align: int = 8):
    """Writes tensors (file, name, dtype, shape, data) below folder, which all executors share, each file's tensors in order
    of name; a row a file comes back: file, n_tensors, bytes. A file is one task, and appears whole: a task that runs twice
    replaces it by an equal one. A file's tensors pass through the task's memory one batch at a time; its header comes first,
    so names and sizes are gathered before."""
    heads = tensors.select("file", "name", "dtype", "shape", F.octet_length("data").cast("bigint").alias("nbytes"))
    entries = heads.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("name", "dtype", "shape", "nbytes"))).alias("entries"))  # a row a tensor, without data
    rows = tensors.select("file", "name", "data", F.lit(None).cast(dict(entries.dtypes)["entries"]).alias("entries"))
    heads = entries.select("file", F.lit(None).cast("string").alias("name"), F.lit(None).cast("binary").alias("data"), "entries")
    rows = heads.union(rows).repartition("file").sortWithinPartitions("file", F.col("name").asc_nulls_first())

    def put(batches):
        system, base = storage.located(folder)
        system.create_dir(base, recursive=True)
        now = out = part = None
        held, done = [0, 0], []

        def close():
            out.close()
            system.move(part, f"{base}/{now}")
            done.append((now, *held))

        for batch in batches:
            for name, data, entry in zip(batch.column("file").to_pylist(), batch.column("data"), batch.column("entries").to_pylist(), strict=True):
                if entry is not None:
                    if out:
                        close()
                    now, part, held = name, f"{base}/.{name}.{uuid.uuid4().hex}", [len(entry), 0]
                    out = system.open_output_stream(part)
                    out.write(packed_header([(e["name"], e["dtype"], e["shape"], e["nbytes"]) for e in entry], align))
                else:
                    raw = data.as_buffer()
                    held[1] += raw.size
                    out.write(raw)
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "n_tensors", "bytes"])

    return rows.mapInArrow(put, "file string, n_tensors bigint, bytes bigint")


def read_ranges(ranges, retry_seconds: float = 0):
    """ranges with data: the bytes at (path, offset, size), sorted within a task by path and offset. A short read fails."""
    schema = StructType([*ranges.schema.fields, StructField("data", BinaryType())])

    def fetch(batches):
        for batch in batches:
            data: list[bytes | None] = [None] * batch.num_rows
            rows = list(zip(batch.column("path").to_pylist(), batch.column("offset").to_pylist(), batch.column("size").to_pylist(), strict=True))
            opened, close, now = None, None, None
            for i in sorted(range(len(rows)), key=lambda i: rows[i][:2]):
                path, offset, size = rows[i]
                if path != now:
                    if close:
                        close()
                    (opened, close), now = storage.reader(path, retry_seconds), path
                data[i] = storage.exact(opened, offset, size, path)
            if close:
                close()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], [*batch.schema.names, "data"])

    return ranges.mapInArrow(fetch, schema)
