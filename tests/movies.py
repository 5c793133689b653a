"""Small movies written out by hand."""

from cinelith.operators.container import FIELDS
from cinelith.sources.movies import chunk_bytes as chunk

PLAIN = {
    "version": 2, "num_frames": 1, "width": 8, "height": 4, "block_width": 4, "block_height": 2, "frame_rate": 15, "colors": 256,
    "maxblocks": 0x0F00, "freq": 22050, "channels": 1, "bits": 16,
}
HICOLOR = PLAIN | {"version": 3, "colors": 0, "channels": 2}


def vqhd(values):
    return b"".join(values.get(name, 0).to_bytes(n, "little") for name, _, n in FIELDS) + bytes(10)


def movie(values, *chunks):
    body = b"WVQA" + chunk("VQHD", vqhd(values)) + b"".join(chunks)
    return b"FORM" + len(body).to_bytes(4, "big") + body


def book(entries, size):
    out = bytearray(size * 8)
    for i, block in entries.items():
        out[8 * i : 8 * i + 8] = bytes(block)
    return bytes(out)


def words(*values):
    return b"".join(v.to_bytes(2, "little") for v in values)
