"""Tensor bytes to values, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rangeloom.model import DTYPES


def _small_float(exponent: int, mantissa: int, bias: int, kind: str) -> np.ndarray:
    """Values of all bytes of a float of 1 + exponent + mantissa bits. kind fn: no infinities, all ones is NaN; ieee: both."""
    code = np.arange(256)
    e, m = (code >> mantissa) & ((1 << exponent) - 1), code & ((1 << mantissa) - 1)
    value = np.where(e > 0, (1 + m / (1 << mantissa)) * 2.0 ** (e - bias), m / (1 << mantissa) * 2.0 ** (1 - bias))
    top = e == (1 << exponent) - 1
    if kind == "fn":
        value[top & (m == (1 << mantissa) - 1)] = np.nan
    else:
        value[top] = np.where(m[top] == 0, np.inf, np.nan)
    return np.where(code >> 7, -value, value).astype(np.float32)


with np.errstate(invalid="ignore"):
    E4M3 = _small_float(4, 3, 7, "fn")
    E5M2 = _small_float(5, 2, 15, "ieee")
E8M0 = np.where(np.arange(256) == 255, np.nan, 2.0 ** (np.arange(256) - 127.0)).astype(np.float32)
PLAIN = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U64": "<u8", "U32": "<u4", "U16": "<u2", "U8": "u1", "BOOL": "u1", "F4": "u1"}


def values_of(data: bytes, dtype: str) -> np.ndarray:
    """The elements, little-endian. F4 stays packed, two values in a byte; C64 is complex."""
    if dtype not in DTYPES:
        raise ValueError(f"unsupported dtype {dtype!r}")
    if dtype == "BF16":
        return (np.frombuffer(data, "<u2").astype(np.uint32) << 16).view(np.float32)
    if dtype == "C64":
        return np.frombuffer(data, "<c8")
    if dtype in ("F8_E4M3", "F8_E5M2", "F8_E8M0"):
        return {"F8_E4M3": E4M3, "F8_E5M2": E5M2, "F8_E8M0": E8M0}[dtype][np.frombuffer(data, np.uint8)]
    return np.frombuffer(data, PLAIN[dtype])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def decode_double(data: pd.Series, dtype: pd.Series) -> pd.Series:
    """Real values as doubles; exact for all dtypes but I64 and U64 beyond 2**53."""
    return pd.Series([None if d is None else values_of(d, t).astype(np.float64) for d, t in zip(data, dtype, strict=True)])


@F.pandas_udf(T.ArrayType(T.LongType()))
def decode_long(data: pd.Series, dtype: pd.Series) -> pd.Series:
    """Whole values as bigints; U64 must fit."""

    def one(d, t):
        values = values_of(d, t)
        if values.dtype.kind not in "iu":
            raise ValueError(f"{t} is not a whole-number dtype")
        if t == "U64" and len(values) and values.max() > np.uint64(2**63 - 1):
            raise OverflowError("a U64 value is beyond bigint; use decode_unsigned")
        return values.astype(np.int64)

    return pd.Series([None if d is None else one(d, t) for d, t in zip(data, dtype, strict=True)])


def _lists(batch: pa.RecordBatch, elements) -> pa.Array:
    """An array column from data and dtype, made of one flat run of elements; elements turns numpy values into Arrow's."""
    data, kinds = batch.column("data"), batch.column("dtype").to_pylist()
    each = [values_of(d.as_buffer(), t) if d.is_valid else np.zeros(0, "<i8") for d, t in zip(data, kinds, strict=True)]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int32)
    parts = [elements(x) for x in each if len(x)]
    flat = pa.concat_arrays(parts) if parts else elements(np.zeros(0, "<u8"))
    at = pa.array(offsets, mask=np.append(~data.is_valid().to_numpy(zero_copy_only=False), False))  # a null's offset makes its list null
    return pa.ListArray.from_arrays(at, flat)


def _complex(values: np.ndarray) -> pa.Array:
    values = values.astype(np.complex64)
    return pa.StructArray.from_arrays([pa.array(values.real.copy()), pa.array(values.imag.copy())], ["re", "im"])


def _decimals(values: np.ndarray) -> pa.Array:
    """Whole numbers as decimal(20,0): 16 bytes each, the upper eight the sign."""
    if values.dtype.kind not in "iu":
        raise ValueError(f"{values.dtype} is not a whole-number dtype")
    words = np.zeros((len(values), 2), np.int64)
    words[:, 0] = values.astype(np.uint64).view(np.int64)
    if values.dtype.kind == "i":
        words[:, 1] = np.where(values < 0, -1, 0)
    return pa.Array.from_buffers(pa.decimal128(20, 0), len(values), [None, pa.py_buffer(words.tobytes())])


def decode_complex(tensors: DataFrame) -> DataFrame:
    """tensors with values array<struct<re, im>>."""

    def add(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(batch, _complex)], [*batch.schema.names, "values"])

    return tensors.mapInArrow(add, _with(tensors, "values array<struct<re:float,im:float>>"))


def decode_unsigned(tensors: DataFrame) -> DataFrame:
    """tensors with values array<decimal(20,0)>, exact for all whole-number dtypes."""

    def add(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(batch, _decimals)], [*batch.schema.names, "values"])

    return tensors.mapInArrow(add, _with(tensors, "values array<decimal(20,0)>"))


def _with(df: DataFrame, column: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), column])


def element_count(shape: str = "shape") -> Column:
    return F.aggregate(shape, F.lit(1).cast("bigint"), lambda a, x: a * x)
