"""Byte codecs against plain models of their command lists, on inputs made here."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cinelith.functions import codecs as K
from cinelith.functions.faults import Fault, message

# ---- LCW: random command lists, packed and carried out side by side ----

LCW_OPS = st.lists(
    st.one_of(
        st.tuples(st.just("literal"), st.binary(min_size=1, max_size=63)),
        st.tuples(st.just("fill"), st.integers(0, 400), st.integers(0, 255)),
        st.tuples(st.just("near"), st.integers(3, 10), st.integers(1, 4095)),
        st.tuples(st.just("middle"), st.integers(3, 64), st.integers(0, 60_000)),
        st.tuples(st.just("long"), st.integers(0, 500), st.integers(0, 60_000)),
    ),
    max_size=12,
)


def lcw_by_hand(ops, relative):
    """(packed, plain)."""
    packed, plain = bytearray(b"\0" if relative else b""), bytearray()
    for op, *args in [("literal", b"start"), *ops]:
        if op == "literal":
            packed += bytes([0x80 | len(args[0])]) + args[0]
            plain += args[0]
            continue
        if op == "fill":
            packed += b"\xfe" + args[0].to_bytes(2, "little") + bytes([args[1]])
            plain += bytes([args[1]]) * args[0]
            continue
        n, place = args
        at = len(plain) - (place % min(len(plain), 4095) + 1) if op == "near" else place % len(plain)
        if op == "near":
            back = len(plain) - at
            packed += bytes([(n - 3) << 4 | back >> 8, back & 255])
        else:
            # code 62 of the middle copy is the fill's, 63 the long copy's
            op = "long" if op == "middle" and n - 3 > 61 else op
            where = (len(plain) - at if relative else at).to_bytes(2, "little")
            packed += (bytes([0xC0 | (n - 3)]) if op == "middle" else b"\xff" + n.to_bytes(2, "little")) + where
        for k in range(n):
            plain.append(plain[at + k])
    return bytes(packed), bytes(plain)


@given(LCW_OPS, st.booleans(), st.booleans())
@settings(max_examples=300, deadline=None)
def test_lcw_commands(ops, relative, ended):
    packed, plain = lcw_by_hand(ops, relative)
    assert K.lcw(packed + (b"\x80rest" if ended else b""), len(plain)) == plain
    assert K.lcw(packed[1:] if relative else packed, len(plain), relative=relative) == plain
    with pytest.raises(Fault) as e:
        K.lcw(packed, len(plain) - 1)
    assert e.value.cause == "LcwTooLarge"


@pytest.mark.parametrize(
    ("packed", "cause"),
    [
        (b"\x83xyz\x10\x04", "BadOffset"), (b"\x82xy\xc1\x07\x00", "BadOffset"), (b"\x00\x82xy\xc1\x03\x00", "BadOffset"), (b"\x82xy\x20\x00", "BadOffset"),
        (b"\x90short", "LcwTruncated"), (b"\x82xy\x30", "LcwTruncated"), (b"\xfe\x01\x00", "LcwTruncated"), (b"\x82xy\xff\x01\x00\x00", "LcwTruncated"),
        (b"\xfe\x00\x10Q", "LcwTooLarge"), (b"\x82xy\xff\xff\x00\x00\x00", "LcwTooLarge"),
    ],
)
def test_lcw_faults(packed, cause):
    with pytest.raises(Fault) as e:
        K.lcw(packed, 100)
    assert e.value.cause == cause


def test_lcw_long_copy_of_nothing():
    assert K.lcw(b"\xff\x00\x00\x50\xc3\x81k\x80", 9) == b"k"


@given(st.binary(max_size=500))
def test_lcw_round_trip(data):
    assert K.lcw(K.lcw_literals(data), len(data)) == data


# ---- IMA ----


def ima_by_hand(data, sample=0, index=0):
    out = []
    for byte in data:
        for code in (byte & 15, byte >> 4):
            step = K.STEPS[index]
            move = step // 8 + (code >> 2 & 1) * step + (code >> 1 & 1) * (step // 2) + (code & 1) * (step // 4)
            sample = min(32767, max(-32768, sample - move if code & 8 else sample + move))
            index = min(88, max(0, index + K.INDEX_MOVES[code & 7]))
            out.append(sample)
    return out, sample, index


@given(st.binary(max_size=900), st.integers(-32768, 32767), st.integers(0, 88))
@settings(deadline=None)
def test_ima(data, sample, index):
    found, *state = K.ima(data, sample, index)
    want, *after = ima_by_hand(data, sample, index)
    assert found.tolist() == want and state == after


def test_ima_of_loud_sound():
    """Long and clamped at both ends, so that the rows of the scan are used."""
    rng = np.random.default_rng(2)
    data = bytes(np.repeat(rng.choice([0x77, 0xFF, 0x70, 0x08, 0x7F], 300), rng.integers(1, 60, 300)).astype(np.uint8))
    found, *state = K.ima(data, 5, 40)
    want, *after = ima_by_hand(data, 5, 40)
    assert found.tolist() == want and state == after and min(want) == -32768 and max(want) == 32767
    assert len(K.STEPS) == 89


# Fixed value: the codec's published example.
def test_ima_published_example():
    assert K.ima(bytes.fromhex("773f09"))[0].tolist() == [11, 41, -22, 41, 17, 24]


@given(st.lists(st.binary(max_size=21), max_size=5), st.sampled_from([1, 2, 3]))
@settings(deadline=None)
def test_ima_stereo(blocks, version):
    states, heard = [(0, 0), (0, 0)], [[], []]
    left, right, found = (0, 0), (0, 0), []
    for data in blocks:
        half = len(data) // 2
        parts = (data[:half], data[half:]) if version == 3 else (data[::2], data[1::2])
        for c, part in enumerate(parts):
            samples, *state = ima_by_hand(part, *states[c])
            states[c] = tuple(state)
            heard[c] += samples[: 2 * half]
        samples, left, right = K.ima_stereo(data, version, left, right)
        found += samples.tolist()
    assert found == [s for pair in zip(*heard, strict=True) for s in pair] and [left, right] == states


# ---- Westwood: random command lists ----

WESTWOOD_OPS = st.lists(
    st.one_of(
        st.tuples(st.just("twos"), st.binary(min_size=1, max_size=64)), st.tuples(st.just("fours"), st.binary(min_size=1, max_size=64)),
        st.tuples(st.just("raw"), st.binary(min_size=1, max_size=32)), st.tuples(st.just("step"), st.integers(-16, 15)), st.tuples(st.just("repeat"), st.integers(1, 64)),
    ),
    max_size=14,
)


def westwood_by_hand(ops):
    """(commands, samples)."""
    packed, out, now = bytearray(), [], 0x80
    for op, value in ops:
        if op == "repeat":
            packed.append(0xC0 | (value - 1))
            out += [now] * value
        elif op == "step":
            packed.append(0xA0 | value & 31)
            now = (now + value) % 256
            out.append(now)
        else:
            packed += bytes([{"twos": 0x00, "fours": 0x40, "raw": 0x80}[op] | (len(value) - 1)]) + value
            for byte in value:
                if op == "raw":
                    moves, now = [0], byte
                elif op == "twos":
                    moves = [byte // 4**k % 4 - 2 for k in range(4)]
                else:
                    moves = [K.NIBBLE_MOVES[byte % 16], K.NIBBLE_MOVES[byte // 16]]
                for move in moves:
                    now = min(255, max(0, now + move))
                    out.append(now)
    return bytes(packed), out


@given(WESTWOOD_OPS, st.integers(0, 40))
@settings(max_examples=300, deadline=None)
def test_westwood(ops, less):
    packed, samples = westwood_by_hand(ops)
    size = max(len(samples) - less, 0)
    # a packed size that equals the other marks raw samples
    head = size.to_bytes(2, "little") + (size ^ 0x8001).to_bytes(2, "little")
    assert K.westwood(head + packed).tolist() == samples[:size]
    # a command that is cut off ends the chunk
    assert K.westwood((len(samples) + 9).to_bytes(2, "little") + b"\xfe\xff" + packed + b"\x43zz").tolist() == samples


def test_westwood_raw_and_short_chunks():
    assert K.westwood(b"\x04\x00\x04\x00wxyz!").tolist() == list(b"wxyz")
    assert K.westwood(b"\x09\x00\x09\x00wx").tolist() == list(b"wx")
    assert K.westwood(b"\x01\x00\x02").tolist() == [] and K.westwood(b"").tolist() == []


# ---- digests, resampling, messages ----


# Fixed value: FNV-1a's published digest of one letter.
def test_fnv():
    assert K.fnv1a(b"a") == 0xAF63DC4C8601EC8C and K.fnv1a(b"ab") == (0xAF63DC4C8601EC8C ^ 0x62) * 0x100000001B3 % 2**64


def test_resample_and_message():
    s = np.array([10, -10, 20, -21, 30, 7], np.int16)
    assert K.resample(s, 2, 4).tolist() == [10, -10, 15, -15, 20, -21, 25, -7, 30, 7, 30, 7]
    assert K.resample(s, 5, 5).tolist() == s.tolist()
    assert message(Fault("Truncated", chunk="VQFL", offset=0x1F2)) == "unexpected end of data (VQFL chunk at offset 0x1f2)"
    assert message(Fault("TooLarge", "Codebook", frame=7)) == "codebook exceeds sanity limits (frame 7)"
