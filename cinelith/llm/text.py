"""Vectorised text work on Arrow batches: bytes, words, hashes.

Texts are handled as one UTF-8 byte array with offsets, in slices of about
SLICE bytes (one text at least), so temporaries stay small however large an
Arrow batch or a document is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 18
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)

#: Word separators: space and 0x09 to 0x0D.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z lower-cased, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The same, and ASCII that is neither letter nor digit becomes a space.
PLAIN = LOWER.copy()
PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 0x20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit over all output bits."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over an Arrow string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi, whole[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, document) of every word; bytes are mapped by table first.

    A word is a longest run of bytes that are not blank, inside one document.
    """
    data = table[data]
    solid = ~BLANK[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begins[inner] = solid[inner]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts
    spans = np.diff(starts, append=len(data))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, spans)
    values = np.where(solid[starts[0] :], data[starts[0] :].astype(np.uint64) + np.uint64(1), np.uint64(0))
    hashed = mix(np.add.reduceat(values * powers(int(spans.max()))[place], starts - starts[0]))
    return hashed, starts, np.searchsorted(offsets, starts, "right") - 1


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    while len(_powers) < n:
        _powers = np.concatenate([_powers, _powers * (_powers[-1:] * _BASE)])
    return _powers


def crc_bucket(ids: pa.Array, modulus: int) -> np.ndarray:
    """crc32 of each id as text, modulo; null counts as the empty text."""
    import zlib

    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % modulus for x in ids.to_pylist()], np.int64)
