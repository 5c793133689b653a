"""Numbers out of binary columns (A3, A10, F3, F4, F6, C6, E6): Catalyst expressions for
single fields, one Arrow pass where every byte becomes an array element."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def byte_at(data: Column, at: Column | int) -> Column:
    """Unsigned byte at a zero-based place; null past the end."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.substring(data, at + 1, F.lit(1))), 16, 10).cast("int")


def u16le(data: Column, at: Column | int) -> Column:
    return byte_at(data, at) + F.lit(256) * byte_at(data, at + 1)


def u32le(data: Column, at: Column | int) -> Column:
    low, high = u16le(data, at).cast("bigint"), u16le(data, at + 2).cast("bigint")
    return low + F.lit(65536) * high


def u32be(data: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(data, F.lit(at + 1), F.lit(4))), 16, 10).cast("bigint")


def _lists(data: pa.Array, kind: np.dtype, of_bytes: Callable[[np.ndarray], np.ndarray], channels: int = 1) -> pa.Array:
    """A list for each binary value: of_bytes over all values' bytes at once, in whole items of `kind`."""
    if isinstance(data, pa.ChunkedArray):
        data = data.combine_chunks()
    wide = pa.types.is_large_binary(data.type)
    valid = data.is_valid().to_numpy(zero_copy_only=False)
    if data.null_count:
        data = data.fill_null(b"")
    cuts = np.frombuffer(data.buffers()[1], np.int64 if wide else np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)[cuts[0] : cuts[-1]] if len(data) else np.zeros(0, np.uint8)
    sizes = np.diff(cuts)
    if kind.itemsize > 1 and (sizes % kind.itemsize).any():
        # an item that a value's end cuts off is dropped
        ends = cuts[1:] - cuts[0]
        keep = np.ones(len(raw), bool)
        for k in range(1, kind.itemsize):
            keep[ends[sizes % kind.itemsize >= k] - k] = False
        raw = raw[keep]
    values = of_bytes(raw.view(kind))
    ends = np.append(0, np.cumsum(sizes // kind.itemsize * channels)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=pa.array(~valid) if not valid.all() else None)


def _widened(b: np.ndarray) -> np.ndarray:
    return (b.astype(np.int16) - 128) << 8


@F.arrow_udf(T.ArrayType(T.ShortType()))
def _pcm8(data: pa.Array) -> pa.Array:
    return _lists(data, np.dtype(np.uint8), _widened)


@F.arrow_udf(T.ArrayType(T.ShortType()))
def _pcm8_stereo(data: pa.Array) -> pa.Array:
    return _lists(data, np.dtype(np.uint8), lambda b: np.repeat(_widened(b), 2), 2)


@F.arrow_udf(T.ArrayType(T.ShortType()))
def _pcm16(data: pa.Array) -> pa.Array:
    return _lists(data, np.dtype("<i2"), lambda v: v)


def unsigned_bytes(data: Column) -> Column:
    """array<int> of all bytes, in Catalyst through hexadecimal text: for short values such as palettes."""
    pairs = F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1))
    return F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int"))


def pcm8(data: Column) -> Column:
    """array<smallint>: unsigned 8-bit samples widened to 16 bits."""
    return _pcm8(data)


def pcm8_stereo(data: Column) -> Column:
    """pcm8, each sample twice: mono sound on two channels."""
    return _pcm8_stereo(data)


def pcm16(data: Column) -> Column:
    """array<smallint>: little-endian pairs in two's complement; an odd last byte is dropped."""
    return _pcm16(data)


def stereo(samples: Column) -> Column:
    """Each sample twice."""
    return F.flatten(F.transform(samples, lambda s: F.array(s, s)))


def mixdown(samples: Column) -> Column:
    """Mean of left and right, cut toward zero."""
    pairs = F.sequence(F.lit(1), F.size(samples).cast("int") - 1, F.lit(2))
    mean = F.transform(pairs, lambda i: ((F.get(samples, i - 1).cast("int") + F.get(samples, i).cast("int")) / 2).cast("int").cast("smallint"))
    return F.when(F.size(samples) < 2, F.array().cast("array<smallint>")).otherwise(mean)


def six_to_eight(v: Column) -> Column:
    """A 6-bit palette component as 8 bits."""
    low = v.bitwiseAND(63)
    return low * 4 + F.shiftright(low, 4)


def five_to_eight(v: Column) -> Column:
    low = v.bitwiseAND(31)
    return low * 8 + F.shiftright(low, 2)


def palette_entries(data: Column) -> Column:
    """array<struct<r, g, b>> of a palette chunk."""
    b = unsigned_bytes(data)
    n = F.floor(F.size(b) / 3).cast("int")
    entries = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(*[six_to_eight(F.get(b, i * 3 + k)).cast("smallint").alias(c) for k, c in enumerate("rgb")]),
    )
    return F.when(n > 0, entries).otherwise(F.array().cast("array<struct<r:smallint,g:smallint,b:smallint>>"))


def hicolor_rgb(pixel: Column) -> list[Column]:
    """r, g, b of a 15-bit pixel; its top bit is not a colour."""
    return [five_to_eight(F.shiftright(pixel, 10)).alias("r"), five_to_eight(F.shiftright(pixel, 5)).alias("g"), five_to_eight(pixel).alias("b")]


def xrgb(r: Column, g: Column, b: Column) -> Column:
    return (r * 65536 + g * 256 + b).cast("bigint")
