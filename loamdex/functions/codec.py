"""Integer-list codecs as Column expressions: four bytes an integer, and delta with variable-length bytes.

Bytes are made and read in Arrow batches, all lists of a batch at once; built-in
functions would evaluate several expressions a byte.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType

_EMPTY = "array<bigint>"


def _bounds(sizes: np.ndarray) -> np.ndarray:
    """Where each list begins, and where the last one ends."""
    return np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def _integers(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The integers of all lists, and the bounds of each; a null list is an empty one, null elements go."""
    flat, bounds = lists.flatten(), _bounds(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
    if flat.null_count:
        bounds = _bounds(flat.is_valid().to_numpy(zero_copy_only=False))[bounds]
        flat = flat.drop_null()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64, copy=False), bounds


def _octets(data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values, and the bounds of each; null is an empty value."""
    data = data.cast(pa.large_binary()).fill_null(b"")
    _, offsets, held = data.buffers()
    bounds = np.frombuffer(offsets, np.int64)[data.offset : data.offset + len(data) + 1] if len(data) else np.zeros(1, np.int64)
    octets = np.frombuffer(held, np.uint8)[bounds[0] : bounds[-1]] if held is not None else np.zeros(0, np.uint8)
    return octets, bounds - bounds[0]


def _as_binary(octets: np.ndarray, bounds: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(octets)]
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, buffers).cast(pa.binary())


def _as_lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int64()))


@F.arrow_udf(returnType=BinaryType())
def _naive_spelled(lists: pa.Array) -> pa.Array:
    values, bounds = _integers(lists)
    return _as_binary(values.astype(np.uint32).astype(">u4").view(np.uint8), bounds * 4)


@F.arrow_udf(returnType=ArrayType(LongType()))
def _naive_read(data: pa.Array) -> pa.Array:
    octets, bounds = _octets(data)
    sizes = np.diff(bounds)
    words = _bounds(-(-sizes // 4))
    # A value's last word may be short; its bytes are the lowest.
    at = np.arange(len(octets)) - np.repeat(bounds[:-1], sizes)
    short = np.maximum(4 - (np.repeat(sizes, sizes) - at // 4 * 4), 0)
    padded = np.zeros(4 * words[-1], np.uint8)
    padded[4 * np.repeat(words[:-1], sizes) + at + short] = octets
    return _as_lists(padded.view(">i4").astype(np.int64), words)


@F.arrow_udf(returnType=BinaryType())
def _delta_spelled(lists: pa.Array) -> pa.Array:
    values, bounds = _integers(lists)
    before = np.concatenate(([0], values[:-1]))[: len(values)]
    before[bounds[:-1][np.diff(bounds) > 0]] = 0
    if (values < before).any():
        raise ValueError("delta_encode needs non-negative, non-decreasing integers")
    gaps, widths = values - before, np.ones(len(values), np.int64)
    for n in range(1, 9):
        widths += gaps >= 1 << 7 * n
    ends = _bounds(widths)
    octets = np.empty(ends[-1], np.uint8)
    for k in range(widths.max(initial=0)):
        wide = np.flatnonzero(widths > k)
        octets[ends[wide + 1] - 1 - k] = gaps[wide] >> 7 * k & 127 | (128 if k else 0)
    return _as_binary(octets, ends[bounds])


@F.arrow_udf(returnType=ArrayType(LongType()))
def _delta_read(data: pa.Array) -> pa.Array:
    octets, bounds = _octets(data)
    final = octets < 128
    ends = final.copy()
    ends[bounds[1:][np.diff(bounds) > 0] - 1] = True  # no gap goes beyond its value
    ends = np.flatnonzero(ends)
    widths = np.diff(ends, prepend=-1)
    gaps = np.zeros(len(ends), np.int64)
    for k in range(min(widths.max(initial=0), 10)):  # higher groups lie beyond 64 bits
        wide = np.flatnonzero(widths > k)
        gaps[wide] |= (octets[ends[wide] - k] & 127).astype(np.int64) << 7 * k
    whole = final[ends]  # a gap without its last byte is none
    sums = _bounds(gaps[whole])
    bounds = np.searchsorted(ends[whole], bounds)
    return _as_lists(sums[1:] - np.repeat(sums[bounds[:-1]], np.diff(bounds)), bounds)


def naive_encode(values: Column) -> Column:
    """Big-endian, four bytes an integer; null and [] give no bytes."""
    return _naive_spelled(values.cast(_EMPTY))


def naive_decode(data: Column) -> Column:
    return _naive_read(data)


def delta_encode(values: Column) -> Column:
    """Gaps of non-decreasing, non-negative integers, in 7-bit groups, highest first; 0x80 marks all but a gap's last byte.  Others raise."""
    return _delta_spelled(values.cast(_EMPTY))


def delta_decode(data: Column, start: Column | None = None, length: Column | None = None) -> Column:
    """The integers of data, or of length bytes from start on; null where that range is negative or out of bounds."""
    if start is None or length is None:
        return _delta_read(data)
    inside = (length >= 0) & (start >= 0) & (start + length <= F.length(data))
    return F.when(inside, _delta_read(F.substring(data, start + 1, F.greatest(length, F.lit(0)))))


def delta_size(values: Column) -> Column:
    """The number of bytes that delta_encode() would give, without making them."""
    values = F.coalesce(values, F.array().cast(_EMPTY)).cast(_EMPTY)
    zero = F.struct(F.lit(0).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("last"))

    def step(acc: Column, x: Column) -> Column:
        gap = x - acc["last"]
        size = F.lit(9)
        for n in range(8, 0, -1):
            size = F.when(gap < 1 << 7 * n, n).otherwise(size)
        return F.struct((acc["size"] + size).alias("size"), x.alias("last"))

    return F.aggregate(values, zero, step, lambda acc: acc["size"])


def naive_size(values: Column) -> Column:
    """The number of bytes that naive_encode() would give."""
    return F.when(values.isNull(), 0).otherwise(4 * F.size(values)).cast("bigint")


@dataclass(frozen=True)
class Compressor:
    """A codec of integer lists, as an index stores them; any pair of such Column functions makes one.

    spelled, if given, is encode on an Arrow array, for where lists are made in Arrow batches anyway.
    """

    name: str
    encode: Callable[[Column], Column]
    decode: Callable[[Column], Column]
    spelled: Callable[[pa.Array], pa.Array] | None = None


NAIVE = Compressor("naive", naive_encode, naive_decode, _naive_spelled.func)
DELTA = Compressor("delta", delta_encode, delta_decode, _delta_spelled.func)
