"""The chunked container: chunk walk, header, index and schedule."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinelith.functions.binary import byte_at, u16le, u32be
from cinelith.functions.faults import ERROR, Fault

BODY = 62
HEADER_AT = 12
HEADER_START = b"VQHD" + (42).to_bytes(4, "big")
_ID = re.compile(rb"[A-Z0-9]*")

# Header fields as (name, offset, bytes).
FIELDS = (
    ("version", 0, 2), ("flags", 2, 2), ("num_frames", 4, 2), ("width", 6, 2), ("height", 8, 2), ("block_width", 10, 1), ("block_height", 11, 1),
    ("frame_rate", 12, 1), ("cbparts", 13, 1), ("colors", 14, 2), ("maxblocks", 16, 2), ("x_pos", 18, 2), ("y_pos", 20, 2), ("max_frame_size", 22, 2),
    ("freq", 24, 2), ("channels", 26, 1), ("bits", 27, 1), ("alt_freq", 28, 2), ("alt_channels", 30, 1), ("alt_bits", 31, 1),
)
CONTAINERS = ("VQFR", "VQFK")
TABLES = ("VPT0", "VPTZ", "VPTK", "VPTD")
SIDE = ("CBF0", "CBFZ", "CBP0", "CBPZ", "CPL0", "CPLZ")
SOUND = ("SND0", "SND1", "SND2")


@dataclass
class Chunk:
    id: str
    offset: int
    data: bytes


def walk(content: bytes, base: int = 0, nested: bool = False) -> Iterator[Chunk]:
    """Chunks in order; raises one located Fault where the stream goes wrong."""
    at, short = 0, "InvalidChunk" if nested else "Truncated"
    while at < len(content):
        name = content[at : at + 4]
        if not _ID.fullmatch(name):
            raise Fault("InvalidChunk", offset=base + at)
        known = name.decode() if len(name) == 4 else None
        size = int.from_bytes(content[at + 4 : at + 8], "big")
        if at + 8 > len(content) or at + 8 + size > len(content):
            raise Fault(short, chunk=known, offset=base + at)
        yield Chunk(known, base + at, content[at + 8 : at + 8 + size])
        at += 8 + size + size % 2


@dataclass
class Header:
    values: dict
    future_use: tuple

    def __getattr__(self, name: str):
        try:
            return self.__dict__["values"][name]
        except KeyError:
            raise AttributeError(name) from None

    @property
    def sample_rate(self) -> int:
        return self.freq or 22050

    @property
    def num_channels(self) -> int:
        return self.channels or 1

    @property
    def bit_depth(self) -> int:
        return self.bits or 8

    @property
    def is_hicolor(self) -> bool:
        return self.colors == 0


def parse_header(data: bytes) -> Header:
    values = {name: int.from_bytes(data[at : at + n], "little") for name, at, n in FIELDS}
    if values["version"] not in (1, 2, 3):
        raise Fault("InvalidHeader")
    return Header(values, tuple(int.from_bytes(data[i : i + 2], "little") for i in range(32, 42, 2)))


@dataclass
class Movie:
    form_size: int
    header: Header
    frame_index: list | None
    schedule: list
    body: bytes

    def chunks(self) -> Iterator[Chunk]:
        return walk(self.body, BODY)


def frame_index_of(data: bytes) -> list[tuple[int, bool]]:
    raw = (int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data) - 3, 4))
    return [((e & 0x0FFFFFFF) * 2, bool(e & 0x40000000)) for e in raw]


def schedule_of(data: bytes) -> list[int]:
    """Start frames of a CINF chunk; none if it cannot be read."""
    try:
        for c in walk(data, nested=True):
            if c.id == "CIND":
                return [int.from_bytes(c.data[i : i + 2], "little") for i in range(0, len(c.data) - 5, 6)]
    except Fault:
        pass
    return []


def is_frame_data(chunk_id: str) -> bool:
    """Chunks behind which no index or schedule is looked for."""
    return chunk_id in (*CONTAINERS, "VQFL", *SOUND, *TABLES, *SIDE)


def ends_frame(chunk_id: str) -> bool:
    """Top-level chunks that make a frame, in either layout."""
    return chunk_id in (*CONTAINERS, *TABLES)


def parse(content: bytes) -> Movie:
    if len(content) < HEADER_AT:
        cut = content and b"FORM".startswith(content[:4]) and b"WVQA".startswith(content[8:12])
        raise Fault("Truncated" if cut else "NotVqa")
    if content[:4] != b"FORM" or content[8:12] != b"WVQA":
        raise Fault("NotVqa")
    start = content[HEADER_AT : HEADER_AT + 8]
    found = start[:4]
    name = found.decode() if len(found) == 4 and _ID.fullmatch(found) else None
    if start != HEADER_START:
        raise Fault("Truncated" if len(start) < 8 and HEADER_START.startswith(start) else "InvalidHeader", chunk=name, offset=HEADER_AT)
    if len(content) < BODY:
        raise Fault("Truncated", chunk=name, offset=HEADER_AT)
    try:
        header = parse_header(content[20:BODY])
    except Fault as f:
        raise f.place(name, HEADER_AT) from None
    index, schedule, drawn = None, None, False
    try:
        for c in walk(content[BODY:], BODY):
            if c.id == "FINF" and index is None:
                index = frame_index_of(c.data)
            elif c.id == "CINF" and schedule is None:
                schedule = schedule_of(c.data)
            drawn = drawn or is_frame_data(c.id)
            if index is not None and (schedule is not None or drawn):
                break
    except Fault:
        pass
    return Movie(int.from_bytes(content[4:8], "big"), header, index, schedule or [], content[BODY:])


# ---- relations ----


def header_struct(data: Column) -> Column:
    """The 42-byte header as a struct, in Catalyst expressions (A3)."""
    plain = [(byte_at(data, at) if n == 1 else u16le(data, at)).alias(name) for name, at, n in FIELDS]
    return F.struct(*plain, F.array(*[u16le(data, 32 + 2 * i) for i in range(5)]).alias("future_use"))


def derived(h: str = "header") -> list[Column]:
    """Derived header columns (A5)."""
    c = lambda name: F.col(f"{h}.{name}")
    return [
        F.coalesce(F.nullif(c("freq"), F.lit(0)), F.lit(22050)).alias("sample_rate"),
        F.coalesce(F.nullif(c("channels"), F.lit(0)), F.lit(1)).alias("num_channels"),
        F.coalesce(F.nullif(c("bits"), F.lit(0)), F.lit(8)).alias("bit_depth"),
        (c("future_use")[1].cast("bigint") + c("future_use")[2].cast("bigint") * 65536).alias("max_cbfz_size"),
        (c("flags").bitwiseAND(1) == 1).alias("has_sound"),
        (c("colors") == 0).alias("is_hicolor"),
    ]


def movies(files: DataFrame) -> DataFrame:
    """movie_id, form_size, header, error of each file (path, content); no Python."""
    b = F.col("content")
    text = lambda at, n: F.substring(b, F.lit(at + 1), F.lit(n)).cast("string")
    start, found = F.hex(F.substring(b, 13, 8)), F.decode(F.substring(b, 13, 4), "ISO-8859-1")
    named = F.when(found.rlike("^[A-Z0-9]{4}$"), found)
    full = HEADER_START.hex().upper()
    cut = (F.length(b) > 0) & F.startswith(F.lit("FORM"), text(0, 4)) & F.startswith(F.lit("WVQA"), text(8, 4))
    kind = (
        F.when((F.length(b) < 12) & cut, "Truncated")
        .when((F.length(b) < 12) | (text(0, 4) != "FORM") | (text(8, 4) != "WVQA"), "NotVqa")
        .when(start != full, F.when((F.length(b) < 20) & F.startswith(F.lit(full), start), "Truncated").otherwise("InvalidHeader"))
        .when(F.length(b) < BODY, "Truncated")
        .when(~u16le(b, 20).isin(1, 2, 3), "InvalidHeader")
    )
    placed = (F.length(b) >= 12) & (kind != "NotVqa")
    error = F.when(kind.isNotNull(), F.struct(kind.alias("kind"), F.when(placed, named).alias("chunk"), F.when(placed, F.lit(HEADER_AT)).cast("bigint").alias("offset")))
    header = F.when(kind.isNull(), header_struct(F.substring(b, 21, 42)))
    return files.select(F.col("path").alias("movie_id"), F.when(kind.isNull(), u32be(b, 4)).alias("form_size"), header.alias("header"), error.alias("error"))


def in_blocks(rows: Iterator[tuple], names: list[str], kinds: dict | None = None, most_bytes: int = 8 << 20) -> Iterator[pd.DataFrame]:
    """Rows as frames of about most_bytes of payload: many small movies in one, no large one held whole."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(x.nbytes if isinstance(x, np.ndarray) else len(x) for x in row if isinstance(x, (bytes, np.ndarray)))
        if size >= most_bytes:
            yield pd.DataFrame(held, columns=names).astype(kinds or {})
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=names).astype(kinds or {})


CHUNKS = f"movie_id string, seq int, parent_seq int, id string, offset bigint, size bigint, data binary, error {ERROR.simpleString()}"


def chunks(files: DataFrame, with_payload: bool = True, nested: tuple[str, ...] = (*CONTAINERS, "VQFL", "CINF")) -> DataFrame:
    """All chunks of all movies, sub-chunks of `nested` ones after their parent.

    A fault is a row with error, after the rows read before it; files whose
    envelope or header cannot be read give that one row.
    """

    names = [c.split()[0] for c in CHUNKS.split(", ")[:8]]

    def rows_of(path: str, content: bytes) -> Iterator[tuple]:
        seq = -1
        try:
            for c in parse(content).chunks():
                seq += 1
                yield (path, seq, None, c.id, c.offset, len(c.data), c.data if with_payload else None, None)
                if c.id in nested:
                    parent = seq
                    try:
                        for s in walk(c.data, c.offset + 8, True):
                            seq += 1
                            yield (path, seq, parent, s.id, s.offset, len(s.data), s.data if with_payload else None, None)
                    except Fault as f:
                        seq += 1
                        yield (path, seq, parent, None, None, None, None, f.row())
        except Fault as f:
            yield (path, seq + 1, None, None, None, None, None, f.row())

    def walked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each = (rows_of(*file) for frame in frames for file in zip(frame["path"], frame["content"], strict=True))
        yield from in_blocks(chain.from_iterable(each), names, {"parent_seq": "Int32"})

    return files.select("path", "content").mapInPandas(walked, CHUNKS)


def frame_index(chunk_rows: DataFrame) -> DataFrame:
    """movie_id, entry_no, offset, has_palette from the first FINF (A10), in Catalyst expressions."""
    first = Window.partitionBy("movie_id").orderBy("seq")
    finf = chunk_rows.where("id = 'FINF' AND parent_seq IS NULL").withColumn("n", F.row_number().over(first)).where("n = 1")
    words = F.regexp_extract_all(F.hex("data"), F.lit("(........)"), F.lit(1))
    entries = finf.select("movie_id", F.posexplode(words).alias("entry_no", "w"))
    raw = F.conv(F.concat(*[F.substring("w", i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("bigint")
    return entries.select("movie_id", "entry_no", (raw.bitwiseAND(0x0FFFFFFF) * 2).alias("offset"), (raw.bitwiseAND(0x40000000) != 0).alias("has_palette"))


def codebook_schedule(chunk_rows: DataFrame) -> DataFrame:
    """movie_id, entry_no, start_frame from the CIND of the first CINF."""
    first = Window.partitionBy("movie_id").orderBy("seq")
    cinf = chunk_rows.where("id = 'CINF' AND parent_seq IS NULL").withColumn("n", F.row_number().over(first)).where("n = 1").select("movie_id", F.col("seq").alias("parent_seq"))
    cind = chunk_rows.where("id = 'CIND'").join(cinf, ["movie_id", "parent_seq"]).withColumn("n", F.row_number().over(first)).where("n = 1")
    records = F.regexp_extract_all(F.hex("data"), F.lit("(............)"), F.lit(1))
    entries = cind.select("movie_id", F.posexplode(records).alias("entry_no", "w"))
    start = F.conv(F.concat(F.substring("w", 3, 2), F.substring("w", 1, 2)), 16, 10).cast("int")
    return entries.select("movie_id", "entry_no", start.alias("start_frame"))


def framed(chunk_rows: DataFrame) -> DataFrame:
    """Top-level chunks with the number of the frame they lead to."""
    ends = F.col("id").isin(*CONTAINERS, *TABLES)
    before = Window.partitionBy("movie_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    top = chunk_rows.where("parent_seq IS NULL AND error IS NULL")
    return top.withColumn("frame_no", F.coalesce(F.sum(ends.cast("int")).over(before), F.lit(0)).cast("int")).withColumn("ends_frame", ends)


def swap_frames(schedule: DataFrame) -> DataFrame:
    """movie_id, frame_no at which staged parts are due, from codebook_schedule's rows.

    Entries are taken in file order; one above its predecessors holds them up to
    its frame, so one below any predecessor is late and dropped.
    """
    before = Window.partitionBy("movie_id").orderBy("entry_no").rowsBetween(Window.unboundedPreceding, -1)
    held = schedule.withColumn("most", F.max("start_frame").over(before))
    due = held.where("most IS NULL OR start_frame >= most")
    return due.select("movie_id", F.col("start_frame").alias("frame_no")).distinct()


def joined_parts(parts: DataFrame, cbparts: int) -> DataFrame:
    """movie_id, cycle, data: every cbparts parts appended in order (C3, C4), from movie_id, seq, data.

    A cycle that the movie leaves unfinished is never shown, so it is left out.
    """
    place = F.row_number().over(Window.partitionBy("movie_id").orderBy("seq")) - 1
    cycles = parts.withColumn("cycle", F.floor(place / cbparts).cast("int")).groupBy("movie_id", "cycle")
    whole = cycles.agg(F.array_sort(F.collect_list(F.struct("seq", "data"))).alias("p")).where(F.size("p") == cbparts)
    return whole.select("movie_id", "cycle", F.aggregate("p", F.lit(b""), lambda all_, x: F.concat(all_, x["data"])).alias("data"))
