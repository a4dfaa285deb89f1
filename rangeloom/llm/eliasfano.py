"""Elias-Fano sequences in raw arrays, so that a memory-mapped file can be queried as it lies."""

from __future__ import annotations

import numpy as np

from rangeloom.llm.common import U


class Shape:
    """What the arrays of a sequence of n monotone values below universe look like."""

    def __init__(self, n: int, universe: int):
        self.n, self.universe = n, universe
        #: Low bits that are stored as they are; the rest is unary.
        self.low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        self.high_bits = n + (universe >> self.low_bits) + 1

    def arrays(self, name: str) -> dict[str, tuple[str, int]]:
        words = self.high_bits // 64 + 2
        return {f"{name}.low": ("<u8", self.n * self.low_bits // 64 + 2), f"{name}.high": ("<u8", words), f"{name}.zeros": ("<u8", words)}


class Builder:
    """Fills the arrays from chunks of values in order."""

    def __init__(self, shape: Shape, arrays: dict[str, np.ndarray], name: str):
        self.shape, self.at = shape, 0
        self.low, self.high, self.zeros = (arrays[f"{name}.{x}"] for x in ("low", "high", "zeros"))

    def add(self, values: np.ndarray) -> None:
        values = values.astype(np.uint64)
        i = np.arange(self.at, self.at + len(values), dtype=np.uint64)
        self.at += len(values)
        bits = self.shape.low_bits
        one = (values >> U(bits)) + i
        np.bitwise_or.at(self.high, one >> U(6), U(1) << (one & U(63)))
        if bits:
            low, where = values & U((1 << bits) - 1), i * U(bits)
            shift = where & U(63)
            np.bitwise_or.at(self.low, where >> U(6), low << shift)
            over = shift + U(bits) > U(64)
            np.bitwise_or.at(self.low, (where[over] >> U(6)) + U(1), low[over] >> (U(64) - shift[over]))

    def done(self) -> None:
        if self.at != self.shape.n:
            raise ValueError(f"{self.at} values; {self.shape.n} were announced")
        total, step = 0, 1 << 18
        for i in range(0, len(self.high), step):
            zeros = np.cumsum(64 - np.bitwise_count(self.high[i : i + step]).astype(np.int64))
            self.zeros[i] = total
            self.zeros[i + 1 : i + len(zeros)] = total + zeros[:-1]
            total += int(zeros[-1])


def _select(word: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Place of the nth set bit (from 0) of each word."""
    place = np.zeros(len(word), np.uint64)
    nth = nth.copy()
    for width in (32, 16, 8, 4, 2, 1):
        count = np.bitwise_count(word & U((1 << width) - 1)).astype(np.uint64)
        go = nth >= count
        nth -= np.where(go, count, U(0))
        step = np.where(go, U(width), U(0))
        word = word >> step
        place += step
    return place


class Sequence:
    def __init__(self, shape: Shape, arrays: dict[str, np.ndarray], name: str):
        self.shape = shape
        self.low, self.high, self.zeros = (arrays[f"{name}.{x}"] for x in ("low", "high", "zeros"))
        self.ones = None

    def _low(self, i: np.ndarray) -> np.ndarray:
        bits = self.shape.low_bits
        if not bits:
            return np.zeros(len(i), np.uint64)
        where = i.astype(np.uint64) * U(bits)
        shift, word = where & U(63), where >> U(6)
        # A shift by 64 in two steps, for values that end with their word.
        return ((self.low[word] >> shift) | ((self.low[word + U(1)] << U(1)) << (U(63) - shift))) & U((1 << bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at the places i."""
        if self.ones is None:
            self.ones = np.arange(len(self.zeros), dtype=np.uint64) * U(64) - self.zeros
        i = i.astype(np.uint64)
        word = np.searchsorted(self.ones, i, "right") - 1
        place = word.astype(np.uint64) * U(64) + _select(self.high[word], i - self.ones[word])
        return ((place - i) << U(self.shape.low_bits)) | self._low(i)

    def _ends(self, high: np.ndarray) -> np.ndarray:
        """How many values have at most these high parts."""
        word = np.searchsorted(self.zeros, high, "right") - 1
        return word.astype(np.uint64) * U(64) + _select(~self.high[word], high - self.zeros[word]) - high

    def find(self, values: np.ndarray) -> np.ndarray:
        """Places of the values, by successor search; -1 where a value isn't in the sequence."""
        out = np.full(len(values), -1, np.int64)
        if not self.shape.n or not len(values):
            return out
        values = values.astype(np.uint64)
        high, low = values >> U(self.shape.low_bits), values & U((1 << self.shape.low_bits) - 1)
        end = self._ends(high).astype(np.int64)
        begin = np.where(high > 0, self._ends(np.maximum(high, U(1)) - U(1)).astype(np.int64), 0)
        at = np.flatnonzero(begin < end)
        a, b, want = begin[at], end[at], low[at]
        stop = b.copy()
        while True:  # the first value of the bucket that isn't smaller
            open_ = np.flatnonzero(a < b)
            if not len(open_):
                break
            middle = (a[open_] + b[open_]) // 2
            smaller = self._low(middle) < want[open_]
            a[open_] = np.where(smaller, middle + 1, a[open_])
            b[open_] = np.where(smaller, b[open_], middle)
        inside = a < stop
        same = np.zeros(len(a), bool)
        same[inside] = self._low(a[inside]) == want[inside]
        out[at[same]] = a[same]
        return out
