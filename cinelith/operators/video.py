"""Frames: decoder state, 8-bit and HiColor drawing, the frame scan."""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinelith.functions.codecs import fnv1a, lcw
from cinelith.functions.faults import ERROR, Fault
from cinelith.operators.container import BODY, CONTAINERS, HEADER_AT, TABLES, Chunk, Header, Movie, ends_frame, in_blocks, parse, walk

MOST_PIXELS = 1 << 24


_FIVE = np.arange(32, dtype=np.uint32) * 8 + (np.arange(32, dtype=np.uint32) >> 2)
#: R, G, B and 255 of each 15-bit pixel, as the bytes of a little-endian word.
_HICOLOR = (np.uint32(0xFF000000) | _FIVE[None, None, :] << 16 | _FIVE[None, :, None] << 8 | _FIVE[:, None, None]).ravel().astype("<u4")


@dataclass
class Frame:
    width: int
    height: int
    pixels: np.ndarray  # uint8 indices, or uint16 HiColor
    palette: np.ndarray | None  # (n, 3) uint8 for indexed frames

    def words(self) -> np.ndarray:
        """(height, width) words whose bytes are R, G, B, 255; an index without a palette entry is black."""
        if self.palette is None:
            return np.take(_HICOLOR, self.pixels & 0x7FFF, mode="clip")
        table = np.zeros((256, 4), np.uint8)
        table[: len(self.palette), :3] = self.palette
        table[:, 3] = 255
        return np.take(table.view("<u4").ravel(), self.pixels, mode="clip")

    def rgba(self) -> np.ndarray:
        """(height, width, 4) uint8."""
        return self.words().view(np.uint8).reshape(self.height, self.width, 4)

    def rgb(self) -> np.ndarray:
        """(height, width, 3) uint8."""
        out, whole = np.empty((self.height, self.width, 3), np.uint8), self.rgba()
        for k in range(3):
            out[..., k] = whole[..., k]
        return out

    def xrgb(self) -> np.ndarray:
        """(height, width) of 0x00RRGGBB."""
        w = self.words()
        return (w & 0xFF) << 16 | w & 0xFF00 | w >> 16 & 0xFF

    def digest(self, state: int) -> int:
        """FNV-1a over little-endian pixels, then the palette's bytes."""
        state = fnv1a(self.pixels.astype(self.pixels.dtype.newbyteorder("<")).tobytes(), state)
        return fnv1a(self.palette.tobytes(), state) if self.palette is not None else state


def unpack(data: bytes, most: int, too_long: Fault | None = None) -> bytes:
    """LCW with its own size fault replaced by too_long."""
    try:
        return lcw(data, most)
    except Fault as f:
        raise (too_long if too_long and f.cause == "LcwTooLarge" else f) from None


class Decoder:
    """The state one movie's frames are folded over.  Scan.state() is a checkpoint of it."""

    def __init__(self, header: Header):
        self.bw, self.bh = header.block_width, header.block_height
        if not self.bw or not self.bh:
            raise Fault("InvalidHeader")
        self.width, self.height = header.width, header.height
        if self.width * self.height > MOST_PIXELS:
            raise Fault("TooLarge", "FrameSize")
        self.version, self.hicolor, self.parts_per_book = header.version, header.is_hicolor, header.cbparts
        self.columns, self.rows = self.width // self.bw, self.height // self.bh
        self.kind = np.dtype("<u2") if self.hicolor else np.dtype(np.uint8)
        self.most_book = min((header.maxblocks or 0xFF00) * self.bw * self.bh * self.kind.itemsize, MOST_PIXELS)
        #: Solid blocks of each colour, kept behind the codebook's entries.
        self.fills = np.repeat(np.arange(0 if self.hicolor else 256, dtype=self.kind), self.bw * self.bh).reshape(-1, self.bh * self.bw)
        self.entries, self.book = 0, self.fills
        self.staged, self.staged_chunks, self.staged_packed = b"", 0, False
        self.palette = np.zeros((0, 3), np.uint8)
        #: What each block shows, row by row of blocks; a frame is put together from it.
        self.blocks = np.zeros((self.columns * self.rows, self.bh * self.bw), self.kind)

    # -- codebooks and palettes --

    def set_codebook(self, data: bytes) -> None:
        if len(data) > self.most_book:
            raise Fault("TooLarge", "Codebook")
        entry = self.bw * self.bh * self.kind.itemsize
        self.entries = len(data) // entry
        self.book = np.concatenate([np.frombuffer(data, self.kind, self.entries * self.bw * self.bh).reshape(-1, self.bh * self.bw), self.fills])

    def stage(self, data: bytes, packed: bool) -> None:
        if self.staged_chunks and packed != self.staged_packed:
            raise Fault("Video", "MixedCodebookParts")
        if len(self.staged) + len(data) > self.most_book:
            raise Fault("TooLarge", "Codebook")
        self.staged, self.staged_chunks, self.staged_packed = self.staged + data, self.staged_chunks + 1, packed

    def swap(self) -> None:
        """Staged parts become the codebook; they are used up even if they are bad."""
        if self.staged_chunks:
            data, self.staged, self.staged_chunks = self.staged, b"", 0
            self.set_codebook(unpack(data, self.most_book, Fault("TooLarge", "Codebook")) if self.staged_packed else data)

    def set_palette(self, data: bytes) -> None:
        if len(data) % 3 or len(data) > 768:
            raise Fault("Video", "PaletteSize")
        six = np.frombuffer(data, np.uint8) & 63
        self.palette = (six << 2 | six >> 4).reshape(-1, 3)

    def side(self, c: Chunk) -> bool:
        """Applies a codebook or palette chunk; False for any other."""
        if c.id in ("CBP0", "CBPZ"):
            self.stage(c.data, c.id == "CBPZ")
        elif c.id in ("CBF0", "CBFZ"):
            self.set_codebook(c.data if c.id == "CBF0" else unpack(c.data, self.most_book, Fault("TooLarge", "Codebook")))
        elif c.id in ("CPL0", "CPLZ"):
            self.set_palette(c.data if c.id == "CPL0" else unpack(c.data, 768, Fault("Video", "PaletteSize")))
        else:
            return False
        return True

    # -- drawing --

    def draw_table(self, table: bytes) -> None:
        """A pointer table: one entry or one colour for every block, by a gather."""
        if self.hicolor:
            raise Fault("Video", "WrongPointerFormat")
        n = self.columns * self.rows
        if len(table) != 2 * n:
            raise Fault("Video", "PointerTableSize")
        raw = np.frombuffer(table, np.uint8)
        low, high = (raw[::2], raw[1::2]) if self.version == 1 else (raw[:n], raw[n:])
        fill = high == (0xFF if self.version == 1 or self.bh == 4 else 0x0F)
        if self.version == 1:
            entry, colour = np.frombuffer(table, "<u2") >> 3, 255 - low
        else:
            entry, colour = high.astype(np.uint16) << 8 | low, low
        bad = entry >= self.entries
        bad &= ~fill
        drawn = int(bad.argmax()) if bad.any() else n
        source = np.where(fill, self.entries + colour.astype(np.int64), entry)[:drawn]
        np.take(self.book, source, axis=0, out=self.blocks[:drawn], mode="clip")
        if drawn < n:
            raise Fault("Video", "BlockIndexOutOfRange")

    def draw_stream(self, data: bytes) -> None:
        """A HiColor pointer stream."""
        if not self.hicolor:
            raise Fault("Video", "WrongPointerFormat")
        n = self.columns * self.rows
        for block, entry, alpha in stream_runs(data, n):
            if len(entry) and entry.max() >= self.entries:
                known = entry < self.entries
                block, entry, alpha = block[known], entry[known], alpha[known]
            if not len(block):
                continue
            drawn = np.take(self.book, entry, axis=0)
            if alpha.any():
                drawn = np.where(alpha[:, None] & (drawn >> 15 == 1), self.blocks[block], drawn)
            first, end = int(block[0]), int(block[-1]) + 1
            if end - first == len(block):
                self.blocks[first:end] = drawn
            else:
                whole_rows(self.blocks)[block] = whole_rows(drawn)

    def frame_chunk(self, c: Chunk) -> None:
        if self.side(c):
            return
        if c.id in TABLES:
            n = 2 * self.columns * self.rows
            self.draw_table(c.data if c.id == "VPT0" else unpack(c.data, n, Fault("Video", "PointerTableSize")))
        elif c.id in ("VPTR", "VPRZ"):
            self.draw_stream(c.data if c.id == "VPTR" else unpack(c.data, 8 * self.columns * self.rows + 256))

    def end_frame(self) -> None:
        if self.parts_per_book and self.staged_chunks >= self.parts_per_book:
            self.swap()

    def decode_frame(self, data: bytes, base: int = 0) -> Frame:
        """One frame from its sub-chunks."""
        self.apply(data, base)
        return self.frame()

    def apply(self, data: bytes, base: int = 0) -> None:
        for c in walk(data, base, True):
            try:
                self.frame_chunk(c)
            except Fault as f:
                raise f.place(c.id, c.offset) from None
        self.end_frame()

    def refresh(self, data: bytes, base: int = 0) -> None:
        """A VQFL: codebooks and palettes only."""
        for c in walk(data, base, True):
            try:
                self.side(c)
            except Fault as f:
                raise f.place(c.id, c.offset) from None

    @property
    def pixels(self) -> np.ndarray:
        """The raster; what lies right of or below the blocks stays 0."""
        out = np.zeros((self.height, self.width), self.kind)
        high, wide = self.rows * self.bh, self.columns * self.bw
        line, blocks = self.bw * self.kind.itemsize, self.blocks
        if line in (2, 4, 8):
            # a block's line moves as one word
            blocks = blocks.view(f"<u{line}")
        shown = blocks.reshape(self.rows, self.columns, self.bh, blocks.shape[1] // self.bh).swapaxes(1, 2)
        out[:high, :wide] = np.ascontiguousarray(shown).view(self.kind).reshape(high, wide)
        return out

    def frame(self) -> Frame:
        return Frame(self.width, self.height, self.pixels, None if self.hicolor else self.palette)


#: By command: blocks written (1, 2, 5 and 6 say how many), the bits of the entry, whether top bits keep pixels.
_COUNTS = np.array([0, 1, 1, 1, 1, 1, 1, 1])
_ENTRIES = np.array([0x1FFF, 0xFF, 0xFF, 0x1FFF, 0x1FFF, 0x1FFF, 0x1FFF, 0x1FFF])
_ALPHA = np.array([False, False, False, False, True, False, True, False])


def command_starts(data: bytes) -> tuple[np.ndarray, int]:
    """Where each command of a pointer stream starts, and where the one behind the last would.

    Only this depends on the command before.  Most commands take two bytes, so
    the chain is followed from one longer command to the next.
    """
    last = len(data) - 1
    even = np.frombuffer(data, "<u2", len(data) // 2) >> 13
    if not np.isin(even, (2, 5, 6)).any():
        return np.arange(0, len(data) // 2 * 2, 2), len(data) // 2 * 2
    raw = np.frombuffer(data, np.uint8)
    high = raw[1:].astype(np.int64)
    command = high >> 5
    longer = np.flatnonzero((command == 2) | (command >= 5) & (command < 7))
    size = np.where(command[longer] == 2, 2 * (high[longer] & 31) + 4, 3)
    by_parity = [(longer[longer % 2 == k].tolist(), size[longer % 2 == k].tolist()) for k in (0, 1)]
    froms, tos, at = [], [], 0
    while at < last:
        places, sizes = by_parity[at & 1]
        i = bisect_left(places, at)
        froms.append(at)
        if i < len(places):
            tos.append(places[i])
            at = places[i] + sizes[i]
        else:
            tos.append(last - 1 - (last - 1 - at) % 2)
            at = tos[-1] + 2
    first = np.array(froms, np.int64)
    n = (np.array(tos, np.int64) - first) // 2 + 1
    return np.repeat(first - 2 * (np.cumsum(n) - n), n) + 2 * np.arange(int(n.sum())), at


def whole_rows(table: np.ndarray) -> np.ndarray:
    """Rows as items where a type is as wide, so that each moves at once; bits are copied, not read."""
    kind = {8: "<u8", 16: "<c16"}.get(table.shape[1] * table.itemsize)
    return table.view(kind).ravel() if kind else table


def stream_runs(data: bytes, blocks: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(block, entry, alpha) arrays of a pointer stream's writes, none of them twice.

    All commands up to the first faulty one are expanded at once.  The faulty one
    is left to stream_writes, which knows what it still draws.
    """
    raw = np.frombuffer(data, np.uint8)
    start, at = command_starts(data)
    word = raw[start].astype(np.int64) | raw[start + 1].astype(np.int64) << 8
    command, run = word >> 13, 2 * ((word >> 8 & 31) + 1)
    cut = at > len(raw)
    count = _COUNTS[command]
    for one in np.flatnonzero(np.bincount(command, minlength=8)).tolist():
        if one in (1, 2):
            count = np.where(command == one, run + (one - 1), count)
        elif one in (5, 6):
            count = np.where(command == one, raw[np.minimum(start + 2, len(raw) - 1)], count)
    step = np.where(command == 0, word & 0x1FFF, count)
    block = np.cumsum(step) - step
    faulty = (command == 7) | ((count > 0) & (block + count > blocks))
    if cut:
        faulty[-1:] = True
    good = int(faulty.argmax()) if faulty.any() else len(start)
    entry, alpha, size = word & _ENTRIES[command], _ALPHA[command], count[:good]
    if good == len(start) and size.min(initial=1) == 1 == size.max(initial=1):
        yield block, entry, alpha
    else:
        owner = np.repeat(np.arange(good), size)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        entry = entry[owner]
        listed = (command[owner] == 2) & (inner > 0)
        entry[listed] = raw[start[owner[listed]] + 1 + inner[listed]]
        yield block[owner] + inner, entry, alpha[owner]
    if good < len(start) or at < len(raw):
        rest, here = (int(start[good]), int(block[good])) if good < len(start) else (at, int(step.sum()))
        for one, n, alpha, skip in stream_writes(data, blocks, rest, here):
            yield np.arange(here, here + n), np.full(n, one if n else 0), np.full(n, alpha)
            here += n + skip


def stream_writes(data: bytes, blocks: int, at: int = 0, block: int = 0) -> Iterator[tuple[int | None, int, bool, int]]:
    """(entry, blocks written, alpha, blocks skipped) of a pointer stream from byte `at` and `block` on.

    Skips may pass the last block, writes may not.
    """

    def fits(count: int) -> None:
        if block + count > blocks:
            raise Fault("Video", "PointerStreamOverrun")

    while at < len(data):
        if at + 2 > len(data):
            raise Fault("Video", "TruncatedPointerStream")
        word = data[at] | data[at + 1] << 8
        at += 2
        command, entry, run = word >> 13, word & 0x1FFF, 2 * ((word >> 8 & 31) + 1)
        if command == 0:
            yield None, 0, False, entry
            block += entry
            continue
        if command == 7:
            raise Fault("Video", "UnknownPointerCommand")
        if command == 2:
            fits(1)
            yield word & 255, 1, False, 0
            block += 1
            for place in range(at, at + run):
                if place >= len(data):
                    raise Fault("Video", "TruncatedPointerStream")
                fits(1)
                yield data[place], 1, False, 0
                block += 1
            at += run
            continue
        count, alpha = 1, command in (4, 6)
        if command == 1:
            entry, count = word & 255, run
        elif command in (5, 6):
            if at >= len(data):
                raise Fault("Video", "TruncatedPointerStream")
            count, at = data[at], at + 1
        if count and block + count > blocks:
            # what still fits is drawn before the fault
            yield entry, max(0, blocks - block), alpha, 0
            raise Fault("Video", "PointerStreamOverrun")
        yield entry, count, alpha, 0
        block += count


class Scan:
    """A movie's frames in order; the first fault ends it, placed.

    state() is all that a later scan needs to go on from here (E4): decoder,
    frame number, what is left of the schedule, and the place in the body.
    """

    def __init__(self, movie: Movie):
        self.movie = movie
        try:
            self.decoder = Decoder(movie.header)
        except Fault as f:
            raise f.place("VQHD", HEADER_AT) from None
        self.number, self.at = 0, 0
        # with a part count in the header the schedule has no say
        self.starts = [] if movie.header.cbparts else list(movie.schedule)
        self.begun = False

    def state(self) -> bytes:
        return pickle.dumps((self.decoder, self.number, self.at, self.starts, self.begun))

    @classmethod
    def resumed(cls, movie: Movie, state: bytes) -> Scan:
        scan = cls(movie)
        scan.decoder, scan.number, scan.at, scan.starts, scan.begun = pickle.loads(state)
        return scan

    def begin(self) -> None:
        """The swap that is due at the frame ahead, if there is one, before any chunk of that frame."""
        if self.begun:
            return
        self.begun, due = True, False
        while self.starts and self.starts[0] <= self.number:
            due |= self.starts.pop(0) == self.number
        if due and self.frame_ahead():
            self.decoder.swap()

    def frame_ahead(self) -> bool:
        try:
            return any(ends_frame(c.id) for c in walk(self.movie.body[self.at :]))
        except Fault:
            return False

    def run(self, shown=lambda number: True) -> Iterator[tuple[int, Frame | None]]:
        """(number, frame) of each frame; only those that shown() accepts are put together."""
        decoder = self.decoder
        try:
            self.begin()
            for c in walk(self.movie.body[self.at :], BODY + self.at):
                self.at = c.offset - BODY + 8 + len(c.data) + len(c.data) % 2
                try:
                    if c.id in CONTAINERS:
                        decoder.apply(c.data, c.offset + 8)
                    elif c.id in TABLES:
                        decoder.frame_chunk(c)
                        decoder.end_frame()
                    elif c.id == "VQFL":
                        decoder.refresh(c.data, c.offset + 8)
                    else:
                        decoder.side(c)
                except Fault as f:
                    raise f.place(c.id, c.offset) from None
                if ends_frame(c.id):
                    number, self.number, self.begun = self.number, self.number + 1, False
                    yield number, decoder.frame() if shown(number) else None
                    self.begin()
        except Fault as f:
            raise f.place(frame=self.number) from None


def frames(movie: Movie) -> Iterator[Frame]:
    for _, frame in Scan(movie).run():
        yield frame


FRAMES = f"movie_id string, frame_no int, width int, height int, format string, pixels binary, palette binary, error {ERROR.simpleString()}"


_FRAME_NAMES = [c.split()[0] for c in FRAMES.split(", ")[:8]]


def _frame_row(path: str, number: int, f: Frame) -> tuple:
    indexed = f.palette is not None
    return (path, number, f.width, f.height, "indexed" if indexed else "hicolor", f.pixels.tobytes(), f.palette.tobytes() if indexed else None, None)


def frame_rows(files: DataFrame, first: int = 0, last: int | None = None, every: int = 1) -> DataFrame:
    """The frames of all movies; a movie's fault is a row after its good frames.

    Only frames first..last, every n-th, are put together; decoding stops at last
    (E2).  One movie is one row's work: movies run in parallel, frames of a movie
    are a fold whose rows leave in blocks.
    """

    def rows_of(path: str, content: bytes) -> Iterator[tuple]:
        number = -1
        try:
            for number, f in Scan(parse(content)).run(lambda n: n >= first and (n - first) % every == 0 and (last is None or n <= last)):
                if last is not None and number > last:
                    break
                if f is not None:
                    yield _frame_row(path, number, f)
        except Fault as e:
            yield (path, number + 1, None, None, None, None, None, e.row())

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each = (rows_of(*file) for batch in batches for file in zip(batch["path"], batch["content"], strict=True))
        yield from in_blocks(chain.from_iterable(each), _FRAME_NAMES)

    return files.select("path", "content").mapInPandas(scanned, FRAMES)


def checkpoints(files: DataFrame, every: int) -> DataFrame:
    """movie_id, frame_no, state: the scan as it stands before every n-th frame.

    A state is as large as a codebook and a raster.  The rows end where a fault ends the scan.
    """

    def rows_of(path: str, content: bytes) -> Iterator[tuple]:
        try:
            scan = Scan(parse(content))
            yield (path, 0, scan.state())
            for number, _ in scan.run(lambda n: False):
                if (number + 1) % every == 0:
                    yield (path, number + 1, scan.state())
        except Fault:
            return

    def saved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each = (rows_of(*file) for batch in batches for file in zip(batch["path"], batch["content"], strict=True))
        yield from in_blocks(chain.from_iterable(each), ["movie_id", "frame_no", "state"])

    return files.select("path", "content").mapInPandas(saved, "movie_id string, frame_no int, state binary")


def resumed_rows(files: DataFrame, states: DataFrame, count: int) -> DataFrame:
    """The `count` frames from each state of checkpoints() on, as frame_rows() has them.

    States of one movie are rows of their own, so a long movie is decoded by many tasks.
    """

    def rows_of(path: str, content: bytes, frame_no: int, state: bytes) -> Iterator[tuple]:
        number = frame_no - 1
        try:
            for number, f in Scan.resumed(parse(content), state).run(lambda n: n < frame_no + count):
                if f is None:
                    break
                yield _frame_row(path, number, f)
                if number + 1 == frame_no + count:
                    break
        except Fault as e:
            yield (path, number + 1, None, None, None, None, None, e.row())

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each = (rows_of(*row) for batch in batches for row in zip(*(batch[c] for c in ("path", "content", "frame_no", "state")), strict=True))
        yield from in_blocks(chain.from_iterable(each), _FRAME_NAMES)

    return files.select("path", "content").join(states, F.col("path") == F.col("movie_id")).select("path", "content", "frame_no", "state").mapInPandas(scanned, FRAMES)


def command_writes(word: Column, count: Column) -> Column:
    """Blocks that one command writes, from its word and the count byte behind it."""
    command, run = F.shiftright(word, 13), F.shiftright(word, 8).bitwiseAND(31) + 1
    return (
        F.when(command == 1, run * 2).when(command == 2, run * 2 + 1).when(command.isin(3, 4), 1).when(command.isin(5, 6), count).otherwise(0)
    )
