"""Byte kernels: LCW, Westwood ADPCM, IMA ADPCM, FNV-1a.

Each takes and gives bytes or NumPy arrays; faults are raised as Fault.
"""

from __future__ import annotations

import numpy as np

from cinelith.functions.faults import Fault

# Fixed values of the IMA codec.
STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173,
    190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066,
    2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818,
    18500, 20350, 22385, 24623, 27086, 29794, 32767,
)
INDEX_MOVES = (-1, -1, -1, -1, 2, 4, 6, 8)
# Fixed values of the Westwood codec: what a 4-bit code adds.
NIBBLE_MOVES = (-9, -8, -6, -5, -4, -3, -2, -1, 0, 1, 2, 3, 4, 5, 6, 8)


def lcw(data: bytes, most: int, relative: bool | None = None) -> bytes:
    """LCW decompression into at most `most` bytes.

    relative None: told by a leading zero byte, which is then skipped.
    """
    at = 0
    if relative is None:
        relative = data[:1] == b"\0"
        at = int(relative)
    out = bytearray()

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise Fault("Lcw", "LcwTruncated")
        at += n
        return data[at - n : at]

    def room(n: int) -> None:
        if len(out) + n > most:
            raise Fault("Lcw", "LcwTooLarge")

    def copy(back: int, n: int) -> None:
        if not 0 < back <= len(out):
            raise Fault("Lcw", "BadOffset")
        room(n)
        start = len(out) - back
        pattern = bytes(out[start : start + n])
        out.extend((pattern * (n // len(pattern) + 1))[:n])

    while at < len(data):
        op = take(1)[0]
        if op == 0x80:
            break
        if op < 0x80:
            n, back = (op >> 4) + 3, (op & 15) << 8 | take(1)[0]
            copy(back, n)
        elif op < 0xC0:
            literal = take(op & 63)
            room(len(literal))
            out += literal
        elif op == 0xFE:
            n, value = int.from_bytes(take(2), "little"), take(1)
            room(n)
            out += value * n
        else:
            n = int.from_bytes(take(2), "little") if op == 0xFF else (op & 63) + 3
            place = int.from_bytes(take(2), "little")
            if n:
                copy(place if relative else len(out) - place, n)
    return bytes(out)


def lcw_literals(data: bytes) -> bytes:
    """The simplest LCW form of data: literal runs and the end mark."""
    runs = [data[i : i + 63] for i in range(0, len(data), 63)]
    return b"".join(bytes([0x80 + len(r)]) + r for r in runs) + b"\x80"


def westwood(chunk: bytes) -> np.ndarray:
    """A whole SND1 chunk as unsigned 8-bit samples."""
    if len(chunk) < 4:
        return np.zeros(0, np.uint8)
    size, packed = int.from_bytes(chunk[:2], "little"), int.from_bytes(chunk[2:4], "little")
    data = chunk[4:]
    if size == packed:
        return np.frombuffer(data[:size], np.uint8)
    out: list[np.ndarray] = []
    sample, at, n_out = 0x80, 0, 0
    while at < len(data) and n_out < size:
        op, at = data[at], at + 1
        kind, n = op >> 6, (op & 63) + 1
        if kind == 3:
            out.append(np.full(n, sample))
        elif kind == 2 and op & 32:
            sample = (sample + (op & 31) - (32 if op & 16 else 0)) % 256
            out.append(np.array([sample]))
        else:
            block = np.frombuffer(data[at : at + n], np.uint8).astype(np.int64)
            if len(block) < n:
                break
            at += n
            if kind == 0:
                block = clamped_sums(((block[:, None] >> _TWO_BITS & 3) - 2).ravel(), 0, 255, sample)
            elif kind == 1:
                block = clamped_sums(_NIBBLES[np.stack([block & 15, block >> 4], 1).ravel()], 0, 255, sample)
            out.append(block)
            sample = int(block[-1])
        n_out += len(out[-1])
    return np.concatenate(out)[:size].astype(np.uint8) if out else np.zeros(0, np.uint8)


def clamped_sums(moves: np.ndarray, low: int, high: int, start: int, lanes: int = 64) -> np.ndarray:
    """x after each x = min(high, max(low, x + move)), from x = start.

    A step, and so any row of steps, is a map x -> min(h, max(l, x + d)).  Long
    inputs are cut into rows: all rows' maps are put together side by side, one
    step at a time; then the rows' first values follow from these maps.
    """
    sums = np.cumsum(moves) + start
    if not len(sums) or (sums.min() >= low and sums.max() <= high):
        return sums
    if len(moves) < 8 * lanes:
        out, x = [], start
        for move in moves.tolist():
            x = min(high, max(low, x + move))
            out.append(x)
        return np.array(out, np.int64)
    rows = -(-len(moves) // lanes)
    padded = np.zeros(rows * lanes, np.int64)
    padded[: len(moves)] = moves
    table = np.ascontiguousarray(padded.reshape(rows, lanes).T)
    d, least, most = np.zeros(rows, np.int64), np.full(rows, low), np.full(rows, high)
    for step in table:
        d += step
        least = np.minimum(np.maximum(least + step, low), high)
        most = np.minimum(np.maximum(most + step, low), high)
    first, x = [], start
    for move, l, h in zip(d.tolist(), least.tolist(), most.tolist(), strict=True):
        first.append(x)
        x = min(h, max(l, x + move))
    now, out = np.array(first, np.int64), np.empty_like(table)
    for k, step in enumerate(table):
        now = np.minimum(np.maximum(now + step, low), high)
        out[k] = now
    return out.T.ravel()[: len(moves)]


def _difference(step: int, code: int) -> int:
    size = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
    return -size if code & 8 else size


#: By step index and code: what is added.
_ADD = np.array([[_difference(s, c) for c in range(16)] for s in STEPS])
_MOVES, _NIBBLES, _TWO_BITS = np.array(INDEX_MOVES), np.array(NIBBLE_MOVES), np.array([0, 2, 4, 6])


def ima(data: bytes, sample: int = 0, index: int = 0) -> tuple[np.ndarray, int, int]:
    """(two samples a byte, low nibble first; the state after).

    The step index follows from the codes alone, the samples from codes and
    indices; both are sums that are clamped at every step.
    """
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int16), sample, index
    code = np.stack([raw & 15, raw >> 4], 1).ravel()
    after = clamped_sums(_MOVES[code & 7], 0, 88, index)
    samples = clamped_sums(_ADD[np.append(index, after[:-1]), code], -32768, 32767, sample)
    return samples.astype(np.int16), int(samples[-1]), int(after[-1])


def ima_stereo(data: bytes, version: int, left: tuple[int, int], right: tuple[int, int]) -> tuple[np.ndarray, tuple[int, int], tuple[int, int]]:
    """Interleaved samples of a stereo chunk and both states after it.

    Version 3 holds the left half before the right half, others alternate bytes.
    A byte without a partner moves its channel's state and is not heard.
    """
    half = len(data) // 2
    one, two = (data[:half], data[half:]) if version == 3 else (data[::2], data[1::2])
    l, *left = ima(one, *left)
    r, *right = ima(two, *right)
    return np.stack([l[: 2 * half], r[: 2 * half]], 1).ravel(), tuple(left), tuple(right)


def fnv1a(data: bytes, digest: int = 0xCBF29CE484222325) -> int:
    for byte in data:
        digest = (digest ^ byte) * 0x100000001B3 % 2**64
    return digest


def resample(samples: np.ndarray, source: int, target: int) -> np.ndarray:
    """Interleaved stereo at another rate, linear, cut toward zero."""
    frames = np.asarray(samples, np.int16).reshape(-1, 2)
    if source == target or not len(frames):
        return frames.ravel()
    place = np.arange(len(frames) * target // source) * float(source) / float(target)
    whole = place.astype(np.int64)
    a, b = frames[whole].astype(float), frames[np.minimum(whole + 1, len(frames) - 1)].astype(float)
    return np.trunc(a + (b - a) * (place - whole)[:, None]).astype(np.int16).ravel()
