"""The safetensors layout: 8 bytes of header length, a JSON header, data. Parsing, checks and writing."""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from rangeloom.model import DTYPES

MAX_HEADER = 100 << 20
METADATA = "__metadata__"


@dataclass(frozen=True)
class Tensor:
    index: int
    name: str
    dtype: str
    shape: tuple[int, ...]
    start: int
    end: int

    @property
    def storage_shape(self) -> tuple[int, ...]:
        """Elements as stored: packed dtypes have fewer on the last axis."""
        packed = DTYPES[self.dtype][1]
        return self.shape if packed == 1 else (*self.shape[:-1], self.shape[-1] // packed)

    @property
    def item_count(self) -> int:
        return math.prod(self.storage_shape)


def header_length(first: bytes, path: str) -> int:
    if len(first) < 8:
        raise ValueError(f"{path}: shorter than 8 bytes")
    (n,) = struct.unpack("<Q", first)
    if n > MAX_HEADER:
        raise ValueError(f"{path}: a header of {n} bytes is beyond {MAX_HEADER}")
    return n


def parse(raw: bytes, path: str) -> list[Tensor]:
    """Tensors in order of their bytes. All layout rules hold afterwards, whatever part of the file is read later."""
    try:
        entries = json.loads(raw.decode("utf-8"))
    except (UnicodeDecodeError, json.JSONDecodeError) as e:
        raise ValueError(f"{path}: the header is not UTF-8 JSON: {e}") from None
    if not isinstance(entries, dict):
        raise ValueError(f"{path}: the header is not a JSON object")
    found = []
    for name, e in entries.items():
        if name == METADATA:
            continue
        if "data_offsets" not in e:
            raise ValueError(f"{path}: tensor {name!r} has no data_offsets")
        start, end = e["data_offsets"]
        found.append((start, end - start, name, e["dtype"], tuple(e["shape"])))
    # An empty tensor comes before a full one at the same place; a stable sort keeps the header's order otherwise.
    found.sort(key=lambda x: x[:2])
    tensors = [Tensor(i, name, kind, shape, start, start + size) for i, (start, size, name, kind, shape) in enumerate(found)]
    expected = 0
    for t in tensors:
        _check_tensor(t, path)
        if t.start != expected:
            what = "the data starts late" if not expected and t.index == 0 else "a hole" if t.start > expected else "an overlap"
            raise ValueError(f"{path}: {what} before tensor {t.name!r}: {t.start}, not {expected}")
        expected = t.end
    return tensors


def _check_tensor(t: Tensor, path: str) -> None:
    if t.dtype not in DTYPES:
        raise ValueError(f"{path}: tensor {t.name!r} has the unsupported dtype {t.dtype!r}")
    if t.end < t.start:
        raise ValueError(f"{path}: tensor {t.name!r} ends before it starts")
    width, packed = DTYPES[t.dtype]
    if packed > 1 and (not t.shape or t.shape[-1] % packed):
        raise ValueError(f"{path}: the last dimension of {t.name!r} must be a multiple of {packed}")
    if t.item_count * width != t.end - t.start:
        raise ValueError(f"{path}: tensor {t.name!r} of shape {list(t.shape)} has {t.end - t.start} bytes, not {t.item_count * width}")


def read_header(read: Callable[[int, int], bytes], path: str, length: int | None = None) -> tuple[int, list[Tensor]]:
    """(where the data starts, tensors). read(offset, size) gives bytes; length, where known, must be the file's exactly."""
    n = header_length(read(0, 8), path)
    raw = read(8, n)
    if len(raw) < n:
        raise ValueError(f"{path}: the header is cut off")
    tensors = parse(raw, path)
    declared = 8 + n + (tensors[-1].end if tensors else 0)
    if length is not None and length != declared:
        raise ValueError(f"{path}: {length} bytes; the header declares {declared}")
    return 8 + n, tensors


def packed_header(entries: Iterable[tuple[str, str, Sequence[int], int]], align: int = 8, metadata: dict[str, str] | None = None) -> bytes:
    """What comes before the data of (name, dtype, shape, bytes): the header and its length, padded to a multiple of align."""
    header, at = ({METADATA: metadata} if metadata else {}), 0
    for name, kind, shape, size in entries:
        header[name] = {"dtype": kind, "shape": list(shape), "data_offsets": [at, at + size]}
        at += size
    raw = json.dumps(header, separators=(",", ":")).encode()
    raw += b" " * (-(8 + len(raw)) % align)
    return struct.pack("<Q", len(raw)) + raw


def write(path: str, tensors: dict[str, tuple[str, tuple[int, ...], bytes]], align: int = 8, metadata: dict[str, str] | None = None) -> None:
    """A file of name -> (dtype, shape, bytes), in that order. The header is padded so that the data starts at a multiple of align."""
    with open(path, "wb") as f:
        f.write(packed_header([(name, kind, shape, len(data)) for name, (kind, shape, data) in tensors.items()], align, metadata))
        for _, _, data in tensors.values():
            f.write(data)
