from collections import Counter

import numpy as np
import pytest
from movies import HICOLOR, PLAIN, book, chunk, movie, vqhd, words

from cinelith.functions.codecs import lcw_literals, resample
from cinelith.functions.faults import Fault
from cinelith.operators import audio, container, video
from cinelith.sources.movies import expand, ppm
from pyspark.sql import functions as F

def decoder(values):
    return video.Decoder(container.parse_header(vqhd(values)))


def test_walk_and_faults():
    good = chunk("PINF", b"ab") + chunk("CINF", b"abc")
    assert [(c.id, c.offset) for c in container.walk(good, 62)] == [("PINF", 62), ("CINF", 72)]
    for nested, kind in ((False, "Truncated"), (True, "InvalidChunk")):
        with pytest.raises(Fault) as e:
            list(container.walk(good + b"SND2\0\0\0\x09", 62, nested))
        assert (e.value.kind, e.value.chunk, e.value.offset) == (kind, "SND2", 62 + len(good))
    with pytest.raises(Fault) as e:
        list(container.walk(b"snd2\0\0\0\0"))
    assert (e.value.kind, e.value.chunk) == ("InvalidChunk", None)
    for content, kind in ((b"", "NotVqa"), (b"FOR", "Truncated"), (b"FORMxxxxWVQB", "NotVqa"), (movie(PLAIN)[:40], "Truncated"), (movie(PLAIN | {"version": 4}), "InvalidHeader")):
        with pytest.raises(Fault) as e:
            container.parse(content)
        assert e.value.kind == kind


def test_index_and_schedule():
    raw = b"".join(x.to_bytes(4, "little") for x in (0x10, 0x40000015, 0x0FFFFFFF, 0x4FFFFFFF))
    assert container.frame_index_of(raw + b"x") == [(0x20, False), (0x2A, True), (0x1FFFFFFE, False), (0x1FFFFFFE, True)]
    cind = b"".join(n.to_bytes(2, "little") + bytes(4) for n in (3, 9))
    m = container.parse(movie(PLAIN, chunk("CINF", chunk("CINH", bytes(8)) + chunk("CIND", cind))))
    assert m.schedule == [3, 9]


def drawn_by_hand(raster, entries, values, table):
    """The raster after a pointer table, block by block and pixel by pixel; the first bad block's number, if any."""
    bw, bh = values["block_width"], values["block_height"]
    columns, rows = values["width"] // bw, values["height"] // bh
    n = columns * rows
    for b in range(n):
        low, high = (table[2 * b], table[2 * b + 1]) if values["version"] == 1 else (table[b], table[n + b])
        solid = high == (0xFF if values["version"] == 1 or bh == 4 else 0x0F)
        if solid:
            block = [255 - low if values["version"] == 1 else low] * (bw * bh)
        else:
            entry = (high * 256 + low) // (8 if values["version"] == 1 else 1)
            if entry >= len(entries):
                return b
            block = entries[entry]
        for k, pixel in enumerate(block):
            raster[b // columns * bh + k // bw][b % columns * bw + k % bw] = pixel
    return None


@pytest.mark.parametrize("version", [1, 2, 3])
@pytest.mark.parametrize(("width", "height", "bw", "bh"), [(24, 10, 4, 2), (20, 12, 4, 4), (17, 11, 3, 5), (16, 8, 8, 2), (3, 3, 4, 4)])
def test_tables(version, width, height, bw, bh):
    rng = np.random.default_rng(version * 1000 + width)
    values = PLAIN | {"version": version, "width": width, "height": height, "block_width": bw, "block_height": bh, "maxblocks": 0}
    d = decoder(values)
    n = (width // bw) * (height // bh)
    raster = [[0] * width for _ in range(height)]
    bad = 0
    for turn in range(12):
        entries = rng.integers(0, 256, (700, bw * bh)).astype(np.uint8)
        d.set_codebook(entries.tobytes() + b"x" * (turn % (bw * bh)))
        high = rng.choice([0, 1, 0x0F, 0xFF], n, p=[0.5, 0.3, 0.1, 0.1]) if version > 1 else rng.choice([0, 7, 0xFF], n, p=[0.5, 0.3, 0.2])
        if turn % 4 == 3 and n:
            high[rng.integers(n)] = 0x40
        low = rng.integers(0, 256, n)
        table = bytes(np.stack([low, high], 1).astype(np.uint8).ravel()) if version == 1 else bytes(np.concatenate([low, high]).astype(np.uint8))
        fails = drawn_by_hand(raster, entries.tolist(), values, table)
        if fails is None:
            d.draw_table(table)
        else:
            bad += 1
            with pytest.raises(Fault) as e:
                d.draw_table(table)
            assert e.value.cause == "BlockIndexOutOfRange"
        assert d.frame().pixels.tolist() == raster
    assert bad or not n
    with pytest.raises(Fault) as e:
        d.draw_table(bytes(2 * n + 1))
    assert e.value.cause == "PointerTableSize"


def test_palette_and_conversions():
    rng = np.random.default_rng(21)
    d = decoder(PLAIN)
    raw = bytes(rng.integers(0, 256, 3 * 100, dtype=np.uint8))
    d.set_palette(raw)
    d.blocks[:] = rng.integers(0, 256, d.blocks.shape)
    f = d.frame()
    assert f.pixels.max() >= 100
    for y in range(f.height):
        for x in range(f.width):
            at = 3 * int(f.pixels[y, x])
            rgb = [(v & 63) << 2 | (v & 63) >> 4 for v in raw[at : at + 3]] or [0, 0, 0]
            assert f.rgb()[y, x].tolist() == rgb and f.rgba()[y, x].tolist() == [*rgb, 255] and f.xrgb()[y, x] == rgb[0] << 16 | rgb[1] << 8 | rgb[2]
    assert ppm(f) == b"P6\n8 4\n255\n" + f.rgb().tobytes()
    d = decoder(HICOLOR)
    d.blocks[:] = rng.integers(0, 65536, d.blocks.shape)
    f = d.frame()
    for p, rgb in zip(f.pixels.ravel().tolist(), f.rgb().reshape(-1, 3).tolist(), strict=True):
        assert rgb == [c * 8 + c // 4 for c in (p >> 10 & 31, p >> 5 & 31, p & 31)]
    for bad in (b"ab", bytes(771)):
        with pytest.raises(Fault) as e:
            d.set_palette(bad)
        assert e.value.cause == "PaletteSize"


def streamed_by_hand(shown, entries, stream):
    """Blocks after a HiColor stream, command by command, and the fault's cause."""
    at = block = 0

    def put(entry, alpha=False):
        nonlocal block
        if block >= len(shown):
            return False
        if entry < len(entries):
            shown[block] = [old if alpha and new & 0x8000 else new for old, new in zip(shown[block], entries[entry], strict=True)]
        block += 1
        return True

    while at < len(stream):
        if at + 1 == len(stream):
            return "TruncatedPointerStream"
        value = stream[at] + 256 * stream[at + 1]
        command, at, run = value >> 13, at + 2, 2 * ((value >> 8 & 31) + 1)
        if command == 0:
            block += value & 0x1FFF
            continue
        if command == 7:
            return "UnknownPointerCommand"
        if command == 2:
            if not put(value & 255):
                return "PointerStreamOverrun"
            for _ in range(run):
                if at == len(stream):
                    return "TruncatedPointerStream"
                if not put(stream[at]):
                    return "PointerStreamOverrun"
                at += 1
            continue
        count, entry = (run, value & 255) if command == 1 else (1, value & 0x1FFF)
        if command in (5, 6):
            if at == len(stream):
                return "TruncatedPointerStream"
            count, at = stream[at], at + 1
        for _ in range(count):
            if not put(entry, command in (4, 6)):
                return "PointerStreamOverrun"
    return None


def test_streams():
    rng = np.random.default_rng(22)
    causes = Counter()
    for turn in range(400):
        values = HICOLOR | {"width": 20, "height": 13, "block_width": 4, "block_height": int(rng.choice([2, 4]))}
        d = decoder(values | {"maxblocks": 0})
        entries = rng.integers(0, 65536, (300, 4 * values["block_height"]))
        d.set_codebook(entries.astype("<u2").tobytes())
        shown = [[0] * entries.shape[1] for _ in range(len(d.blocks))]
        for _ in range(3):
            stream = b""
            for _ in range(rng.integers(0, 9)):
                command = int(rng.choice(8, p=[0.2, 0.12, 0.1, 0.2, 0.12, 0.12, 0.12, 0.02]))
                low = int(rng.integers(0, 4)) if command == 0 else int(rng.integers(0, 320))
                stream += (command << 13 | (low & 255 | int(rng.integers(0, 2)) << 8 if command in (1, 2) else low)).to_bytes(2, "little")
                stream += bytes(rng.integers(0, 5, 1 if command in (5, 6) else 0).astype(np.uint8)) if command != 2 else bytes(rng.integers(0, 256, 2 * ((stream[-1] & 31) + 1)).astype(np.uint8))
            stream = stream[: len(stream) - int(rng.integers(0, 2))] if turn % 3 == 0 else stream
            cause = streamed_by_hand(shown, entries.tolist(), stream)
            causes[cause] += 1
            try:
                d.draw_stream(stream)
                assert cause is None
            except Fault as f:
                assert f.cause == cause
            assert d.blocks.tolist() == shown
    assert len(causes) == 4 and causes[None] > 100
    d.draw_stream(b"\xff\x1f" * 3)  # skips may pass the end
    with pytest.raises(Fault):
        d.draw_table(b"")


def test_parts_swap_after_their_frame():
    a, b = book({0: [1] * 8}, 1), book({0: [2] * 8}, 1)
    table = chunk("VPT0", bytes(8))
    m = movie(
        PLAIN | {"cbparts": 2},
        chunk("VQFR", chunk("CBF0", a) + chunk("CBP0", b[:4]) + table),
        chunk("VQFR", chunk("CBP0", b[4:]) + table),
        chunk("VQFR", table),
        chunk("VQFR", b""),
    )
    assert [int(f.pixels[0, 0]) for f in video.frames(container.parse(m))] == [1, 1, 2, 2]
    packed = lcw_literals(b)
    m = movie(PLAIN | {"cbparts": 2}, chunk("VQFR", chunk("CBF0", a) + chunk("CBPZ", packed[:3])), chunk("VQFR", chunk("CBPZ", packed[3:]) + table), chunk("VQFR", chunk("VPTZ", lcw_literals(bytes(8)))))
    assert [int(f.pixels[0, 0]) for f in video.frames(container.parse(m))] == [0, 1, 2]


def test_scan_stops_at_the_first_fault():
    table = chunk("VPT0", bytes(8))
    m = movie(PLAIN, chunk("CBF0", book({0: [9] * 8}, 1)), table, chunk("VQFR", chunk("VPT0", b"x")), table)
    seen = []
    with pytest.raises(Fault) as e:
        for f in video.frames(container.parse(m)):
            seen.append(int(f.pixels.sum()))
    assert seen == [9 * 32]
    assert (e.value.cause, e.value.chunk, e.value.frame) == ("PointerTableSize", "VPT0", 1)


def fault_of(content):
    with pytest.raises(Fault) as e:
        list(video.frames(container.parse(content)))
    return e.value.kind, e.value.cause, e.value.chunk, e.value.offset, e.value.frame


def test_places_of_faults():
    table = chunk("VPT0", bytes(8))
    assert fault_of(movie(PLAIN | {"block_height": 0})) == ("InvalidHeader", None, "VQHD", 12, None)
    assert fault_of(movie(PLAIN | {"width": 5000, "height": 5000})) == ("TooLarge", "FrameSize", "VQHD", 12, None)
    # a bad side chunk comes before the bad walk behind it
    assert fault_of(movie(PLAIN, chunk("CPL0", b"ab"), b"bad!")) == ("Video", "PaletteSize", "CPL0", 62, 0)
    assert fault_of(movie(PLAIN, chunk("VQFL", chunk("PINF", b"") + chunk("CPLZ", b"\xfe\x00\x10\x01")), table)) == ("Video", "PaletteSize", "CPLZ", 78, 0)
    # a codebook that the end of a frame swaps in badly is the frame's fault
    bad = movie(PLAIN | {"cbparts": 1}, chunk("CBF0", bytes(8)), chunk("VQFR", table + chunk("CBPZ", b"\x85no")))
    assert fault_of(bad) == ("Lcw", "LcwTruncated", "VQFR", 78, 0)
    # one that the schedule swaps in badly has no chunk, and none is swapped in where no frame follows
    starts = chunk("CINF", chunk("CIND", words(1, 0, 0)))
    frame = chunk("VQFR", chunk("CBPZ", b"\x85no") + table)
    assert fault_of(movie(PLAIN, starts, chunk("CBF0", bytes(8)), frame, chunk("VQFR", table))) == ("Lcw", "LcwTruncated", None, None, 1)
    assert len(list(video.frames(container.parse(movie(PLAIN, starts, chunk("CBF0", bytes(8)), frame))))) == 1


@pytest.mark.parametrize("name", ["VQFR", "VQFK", "VQFL", "SND0", "SND1", "SND2", "VPT0", "VPTZ", "VPTK", "VPTD", "CBF0", "CBFZ", "CBP0", "CBPZ", "CPL0", "CPLZ"])
def test_no_schedule_behind_frame_data(name):
    starts, index = chunk("CINF", chunk("CIND", words(3, 0, 0))), chunk("FINF", bytes(4))
    assert container.parse(movie(PLAIN, index, chunk(name, b""), starts)).schedule == []
    assert container.parse(movie(PLAIN, index, chunk("LINF", b""), starts)).schedule == [3]
    # without an index so far it is still looked for
    assert container.parse(movie(PLAIN, chunk(name, b""), starts, index)).schedule == [3]


def test_checkpoints(spark):
    rng = np.random.default_rng(23)
    parts = [chunk("VQFL", chunk("CBP0", bytes([k] * 8))) + chunk("VQFR", chunk("VPT0", bytes(4) + bytes(4))) for k in range(11)]
    starts = chunk("CINF", chunk("CIND", b"".join(words(k, 0, 0) for k in (2, 5, 5, 4, 9))))
    bodies = {
        "schedule": movie(PLAIN, starts, chunk("CBF0", bytes([200] * 8)), *parts), "parts": movie(PLAIN | {"cbparts": 4}, chunk("CBF0", bytes([200] * 8)), *parts),
        "hicolor": movie(HICOLOR, chunk("CBF0", rng.integers(0, 255, 160, dtype=np.uint8).tobytes()), *[chunk("VQFR", chunk("VPTR", words(k % 3, 0x6000 | k, 0x8000 | k % 4))) for k in range(9)]),
        "bad": movie(PLAIN, chunk("CBF0", bytes(8)), *parts[:4], chunk("VQFR", chunk("VPT0", b""))),
    }
    files = spark.createDataFrame(list(bodies.items()), "path string, content binary")
    rows = lambda df: sorted(((r.movie_id, r.frame_no, r.pixels, r.error.cause if r.error else None) for r in df.collect()), key=str)
    whole = rows(video.frame_rows(files))
    assert Counter(r[0] for r in whole) == {"schedule": 11, "parts": 11, "hicolor": 9, "bad": 5}
    states = video.checkpoints(files, 3)
    assert rows(video.resumed_rows(files, states, 3)) == whole
    assert rows(video.frame_rows(files, first=2, last=6, every=2)) == [r for r in whole if r[3] or r[1] in (2, 4, 6)]
    saved = container.parse(bodies["parts"])
    scan = video.Scan(saved)
    run = scan.run()
    next(run)
    copy = video.Scan.resumed(saved, scan.state())
    assert [f.pixels.tolist() for _, f in run] == [f.pixels.tolist() for _, f in copy.run()]


def test_expand_keeps_frames():
    m = movie(PLAIN, chunk("VQFR", chunk("CBFZ", lcw_literals(book({0: [7] * 8}, 1))) + chunk("VPTZ", lcw_literals(bytes(8)))))
    grown = expand(m)
    assert b"CBFZ" not in grown
    assert [f.pixels.tolist() for f in video.frames(container.parse(grown))] == [f.pixels.tolist() for f in video.frames(container.parse(m))]


def test_relations(spark, tmp_path):
    sound = movie(PLAIN | {"channels": 2, "bits": 8}, chunk("SND1", bytes.fromhex("0200020000ff")), chunk("SND0", b"\x00\x80\xff"), chunk("SND2", bytes.fromhex("774c3f05")))
    frame = movie(PLAIN, chunk("FINF", (0x40000015).to_bytes(4, "little")), chunk("VQFR", chunk("CBF0", book({0: [5] * 8}, 1)) + chunk("VPT0", bytes(8))), chunk("VQFR", b"BAD!"))
    for name, content in (("a.vqa", sound), ("b.vqa", frame), ("c.vqa", b"nothing here")):
        (tmp_path / name).write_bytes(content)
    from cinelith.sources.movies import movie_files, ppm_rows

    files = movie_files(spark, str(tmp_path)).select(F.element_at(F.split("path", "/"), -1).alias("path"), "content")
    meta = {r.movie_id: r for r in container.movies(files).collect()}
    assert meta["a.vqa"].header.version == 2 and meta["c.vqa"].error.kind == "NotVqa"
    rows = container.chunks(files)
    assert [(r.id, r.parent_seq) for r in rows.where("movie_id = 'b.vqa'").orderBy("seq").collect()] == [("FINF", None), ("VQFR", None), ("CBF0", 1), ("VPT0", 1), ("VQFR", None), (None, 4)]
    assert [tuple(r) for r in container.frame_index(rows).collect()] == [("b.vqa", 0, 42, True)]
    heard = audio.audio_rows(files).where("error IS NULL").orderBy("chunk_no").collect()
    assert [r.samples for r in heard] == [[-32768, -32768, 32512, 32512], [-32768, 0, 32512], [11, -7, 41, 3, -22, 17, 41, 19]]
    track = {r.movie_id: r for r in audio.soundtracks(audio.audio_rows(files)).collect()}
    assert len(track["a.vqa"].samples) == 15
    assert {r.movie_id: r.error.kind for r in audio.soundtracks(audio.audio_rows(files), 3).where("error IS NOT NULL").collect()}["a.vqa"] == "TooLarge"
    drawn = video.frame_rows(files).orderBy("movie_id", "frame_no").collect()
    assert [(r.movie_id, r.frame_no, r.error.kind if r.error else None) for r in drawn] == [("b.vqa", 0, None), ("b.vqa", 1, "InvalidChunk"), ("c.vqa", 0, "NotVqa")]
    assert ppm_rows(video.frame_rows(files)).count() == 1


def test_sound_before_a_fault(spark):
    good = [chunk("SND0", words(1, 2)), chunk("SND2", b"\x12\x34")]
    cut = movie(PLAIN, *good, chunk("SND2", b"\x56"))[:-2]
    files = spark.createDataFrame([("cut", cut), ("bad", movie(PLAIN, *good, b"no")), ("none", movie(PLAIN)), ("whole", movie(PLAIN, *good))], "path string, content binary")
    heard = {}
    for r in audio.audio_rows(files).orderBy("movie_id", "chunk_no").collect():
        heard.setdefault(r.movie_id, []).append((r.chunk_no, r.samples, r.error.kind if r.error else None))
    first = [(0, [1, 2], None), (1, audio.ima(b"\x12\x34")[0].tolist(), None)]
    assert heard == {"cut": [*first, (2, None, "Truncated")], "bad": [*first, (2, None, "InvalidChunk")], "whole": first}
    tracks = {r.movie_id: (r.samples, r.error.kind if r.error else None) for r in audio.soundtracks(audio.audio_rows(files)).collect()}
    assert tracks == {"cut": (None, "Truncated"), "bad": (None, "InvalidChunk"), "whole": ([1, 2, *first[1][1]], None)}


def test_written_images_and_expanded_errors(spark, tmp_path):
    from cinelith.sources.movies import dump_frames, expanded

    frame = chunk("VQFR", chunk("VPT0", bytes(8)))
    good = movie(PLAIN, chunk("CBF0", bytes([3] * 8)), chunk("CPL0", bytes(range(12))), frame, frame, frame)
    files = spark.createDataFrame([("x/a.vqa", good), ("b.vqa", movie(PLAIN, chunk("CBFZ", b"\xc0"))), ("c.vqa", b"FORM")], "path string, content binary")
    wrote = dump_frames(video.frame_rows(files), str(tmp_path), 2).orderBy("frame_no").collect()
    assert [(r.movie_id, r.frame_no) for r in wrote] == [("x/a.vqa", 0), ("x/a.vqa", 2)]
    image = (tmp_path / "a.vqa" / "frame_0002.ppm").read_bytes()
    assert image == b"P6\n8 4\n255\n" + bytes([36, 40, 44] * 32)
    rows = {r.path: (r.content, r.error.kind if r.error else None, r.error.chunk if r.error else None) for r in expanded(files).collect()}
    assert bytes(rows["x/a.vqa"][0])[8:] == good[8:] and rows["b.vqa"] == (None, "Lcw", "CBFZ") and rows["c.vqa"][1] == "Truncated"


def test_rows_leave_in_blocks():
    rows = [("m", k, bytes(100)) for k in range(50)]
    blocks = list(container.in_blocks(iter(rows), ["movie_id", "seq", "data"], most_bytes=1000))
    assert [len(b) for b in blocks] == [7] * 7 + [1] and [k for b in blocks for k in b["seq"]] == list(range(50))


def test_stream(spark, tmp_path):
    from cinelith.streaming.ingest import arriving, chunk_stream, relation_stream

    src = tmp_path / "in"
    src.mkdir()
    frame = chunk("VQFR", chunk("VPT0", bytes(8)))
    (src / "a.vqa").write_bytes(movie(PLAIN, chunk("SND0", b"ab"), chunk("CBF0", bytes([4] * 8)), frame))
    chunk_stream(arriving(spark, str(src)), str(tmp_path / "chunks"), str(tmp_path / "check")).awaitTermination(60)
    assert [r.id for r in spark.read.parquet(str(tmp_path / "chunks")).orderBy("seq").collect()] == ["SND0", "CBF0", "VQFR", "VPT0"]
    for turn in range(2):
        # a second run reads the new file only
        for name, relation in (("frames", video.frame_rows), ("sound", audio.audio_rows)):
            relation_stream(arriving(spark, str(src)), relation, str(tmp_path / name), str(tmp_path / f"check-{name}")).awaitTermination(60)
            assert spark.read.parquet(str(tmp_path / name)).count() == turn + 1
        (src / "b.vqa").write_bytes(movie(PLAIN, chunk("SND0", b"cd"), chunk("CBF0", bytes([5] * 8)), frame))


def test_byte_columns(spark):
    from cinelith.functions import binary as B

    rng = np.random.default_rng(24)
    values = [None, b"", b"\x7f", *(rng.bytes(int(n)) for n in rng.integers(1, 40, 30))]
    rows = spark.createDataFrame(list(enumerate(values)), "k int, b binary").repartition(2)
    b = F.col("b")
    columns = [B.pcm8(b).alias("one"), B.pcm8_stereo(b).alias("two"), B.pcm16(b).alias("wide"), B.unsigned_bytes(b).alias("plain"), B.palette_entries(b).alias("palette")]
    found = rows.select("k", *columns).withColumn("also", B.stereo(F.col("one")))
    for r in found.collect():
        raw = values[r.k]
        if raw is None:
            assert (r.one, r.two, r.wide, r.plain) == (None, None, None, None)
            continue
        widened = [(x - 128) * 256 for x in raw]
        assert r.one == widened and r.two == r.also == [x for x in widened for _ in (0, 1)] and r.plain == list(raw)
        assert r.wide == [int.from_bytes(raw[i : i + 2], "little", signed=True) for i in range(0, len(raw) - 1, 2)]
        scaled = [(x & 63) * 4 + (x & 63) // 16 for x in raw]
        assert [tuple(e) for e in r.palette] == [tuple(scaled[i : i + 3]) for i in range(0, len(raw) - 2, 3)]


@pytest.mark.parametrize(("source", "target"), [(3, 4), (22050, 44100), (5, 2), (7, 7)])
def test_resampled_columns(spark, source, target):
    rng = np.random.default_rng(5)
    tracks = {m: rng.integers(-32768, 32768, (n, 2)).astype(np.int16) for m, n in (("a", 1), ("b", 17), ("c", 2))}
    rows = [(m, k, int(l), int(r)) for m, t in tracks.items() for k, (l, r) in enumerate(t)]
    found = audio.resampled(spark.createDataFrame(rows, "movie_id string, sample_no long, left long, right long"), source, target).collect()
    for m, t in tracks.items():
        got = [x for r in sorted(found, key=lambda r: r.sample_no) if r.movie_id == m for x in (r.left, r.right)]
        assert got == resample(t, source, target).tolist()


def test_swap_frames_and_parts(spark):
    starts = [0, 4, 2, 4, 9, 8, 12]
    schedule = spark.createDataFrame([("m", k, s) for k, s in enumerate(starts)], "movie_id string, entry_no int, start_frame int")
    assert sorted(r.frame_no for r in container.swap_frames(schedule).collect()) == [0, 4, 9, 12]
    parts = spark.createDataFrame([("m", k, bytes([k])) for k in (3, 1, 2, 0, 4)], "movie_id string, seq int, data binary")
    assert sorted((r.cycle, bytes(r.data)) for r in container.joined_parts(parts, 2).collect()) == [(0, b"\0\1"), (1, b"\2\3")]
