"""Queries that build whole movies out of table rows and run them through the decoder, each with its SQL.

A movie's bytes are put together as hexadecimal text in Catalyst; a movie holds a
bounded number of rows, so files stay small however large the tables are.  What a
frame must show, a chunk's place or a sound's sum follows from the rows in closed
form, which is what the SQL computes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelith.functions import binary as B
from cinelith.functions import codecs
from cinelith.functions.faults import message_column
from cinelith.operators import audio as A
from cinelith.operators import container as C
from cinelith.operators import video as V
from cinelith.sources.movies import expanded, ppm_rows

PER_MOVIE = 32


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def header(**values: int) -> str:
    """A 42-byte header as hexadecimal text."""
    plain = {"version": 2, "block_width": 4, "block_height": 2, "frame_rate": 15, "colors": 256} | values
    return (b"".join(plain.get(name, 0).to_bytes(n, "little") for name, _, n in C.FIELDS) + bytes(10)).hex().upper()


def envelope(head: str) -> str:
    """A movie up to its body; the size in it is not read."""
    return "FORM".encode().hex().upper() + "0" * 8 + "WVQA".encode().hex().upper() + C.HEADER_START.hex().upper() + head


def chunk(name: str, data: Column | str) -> Column:
    """A chunk as hexadecimal text, with its pad byte."""
    data = F.lit(data) if isinstance(data, str) else data
    size = F.length(data) / 2
    return F.concat(F.lit(name.encode().hex().upper()), F.lpad(F.hex(size.cast("bigint")), 8, "0"), data, F.when(size % 2 == 1, "00").otherwise(""))


def byte(value: Column) -> Column:
    return F.lpad(F.hex(value.cast("bigint")), 2, "0")


def word(value: Column) -> Column:
    """Two bytes, little-endian."""
    return F.concat(byte(value % 256), byte(F.floor(value / 256)))


def movie_of(rows: DataFrame, key: str, order: str, head: Column, frame: Column) -> DataFrame:
    """path and content: each key's rows in order, behind `head`; at most PER_MOVIE rows a movie, or a conversation."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), frame.alias("c"))))
    body = F.array_join(F.transform(parts, lambda x: x["c"]), "")
    return rows.groupBy(key).agg(F.unhex(F.concat(F.first(head), body)).alias("content")).select(F.col(key).cast("string").alias("path"), "content")


def entry_bytes(entries: int, pixel: Callable[[int, int], int], size: int, width: int = 1) -> str:
    return b"".join((pixel(e, k) % 256**width).to_bytes(width, "little") for e in range(entries) for k in range(size)).hex().upper()


# ---- 8-bit frames: orders are frames, lines are blocks ----

TABLE_HEAD = envelope(header(width=32, height=2)) + "".join(
    [
        "CBF0".encode().hex() + (768 * 8).to_bytes(4, "big").hex() + entry_bytes(768, lambda e, k: e * 7 + k * 31, 8),
        "CPL0".encode().hex() + (768).to_bytes(4, "big").hex() + bytes(x for i in range(256) for x in (i * 5 % 64, i * 11 % 64, i * 3 % 64)).hex(),
    ]
).upper()


def _order_movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("n"))
    blocks = blocks.agg(F.max(F.col("l_partkey") % 256).alias("lo"), F.max(F.col("l_suppkey") % 4).alias("hi"))
    held = F.map_from_entries(F.collect_list(F.struct("n", F.struct("lo", F.when(F.col("hi") == 3, 15).otherwise(F.col("hi")).alias("hi")))))
    frames = blocks.groupBy("l_orderkey").agg(held.alias("b"))
    low = [byte(F.coalesce(F.col("b")[k + 1]["lo"], F.lit(200))) for k in range(8)]
    high = [byte(F.coalesce(F.col("b")[k + 1]["hi"], F.lit(15))) for k in range(8)]
    frames = frames.select("l_orderkey", F.floor(F.col("l_orderkey") / PER_MOVIE).alias("movie"), F.concat(*low, *high).alias("t"))
    return movie_of(frames, "movie", "l_orderkey", F.lit(TABLE_HEAD), chunk("VQFR", chunk("VPT0", F.col("t"))))


def vpt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pointer tables with fills and copies, drawn by the decoder."""
    rows = V.frame_rows(_order_movies(spark, sf_dir))
    return rows.select(F.col("movie_id").cast("bigint").alias("movie"), "frame_no", "width", "height", F.hex("pixels").alias("pixels"))


_PIXELS = f"""
l AS (SELECT l_orderkey AS o, l_linenumber - 1 AS b, max(l_partkey % 256) AS lo, max(l_suppkey % 4) AS hi FROM lineitem GROUP BY 1, 2),
n AS (SELECT o, o // {PER_MOVIE} AS movie, (row_number() OVER (PARTITION BY o // {PER_MOVIE} ORDER BY o) - 1)::INTEGER AS frame_no FROM (SELECT DISTINCT o FROM l)),
p AS (SELECT movie, frame_no, y, x, (CASE WHEN l.o IS NULL THEN 200 WHEN hi = 3 THEN lo ELSE ((hi * 256 + lo) * 7 + (y * 4 + x % 4) * 31) % 256 END)::INTEGER AS v
  FROM n CROSS JOIN range(2) a(y) CROSS JOIN range(32) c(x) LEFT JOIN l ON l.o = n.o AND l.b = x // 4)
"""
VPT_SQL = f"WITH {_PIXELS} SELECT movie::BIGINT AS movie, frame_no, 32 AS width, 2 AS height, string_agg(printf('%02X', v), '' ORDER BY y, x) AS pixels FROM p GROUP BY movie, frame_no"


def ppm_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth frame through its palette, as a PPM image."""
    rows = ppm_rows(V.frame_rows(_order_movies(spark, sf_dir), every=5), 5)
    return rows.select(F.col("movie_id").cast("bigint").alias("movie"), "frame_no", F.hex("ppm").alias("ppm"))


PPM_SQL = f"""
WITH {_PIXELS}, s AS (SELECT movie, frame_no, y, x, v * 5 % 64 AS r, v * 11 % 64 AS g, v * 3 % 64 AS b FROM p WHERE frame_no % 5 = 0)
SELECT movie::BIGINT AS movie, frame_no, hex(encode('P6' || chr(10) || '32 2' || chr(10) || '255' || chr(10)))
  || string_agg(printf('%02X%02X%02X', (r * 4 + r // 16)::INTEGER, (g * 4 + g // 16)::INTEGER, (b * 4 + b // 16)::INTEGER), '' ORDER BY y, x) AS ppm
FROM s GROUP BY movie, frame_no
"""

# ---- HiColor frames: an event is a frame ----

STREAM_HEAD = (envelope(header(version=3, colors=0, width=32, height=4)) + "CBF0".encode().hex() + (512 * 16).to_bytes(4, "big").hex() + entry_bytes(512, lambda e, k: e * 97 + k * 8231, 8, 2)).upper()


def _stream_movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    run = e % 2
    stream = F.concat(
        word(e % 5),
        word(0x6000 + 256 + e * 7 % 200),
        word(0xA000 + e % 300), byte(e % 4),
        word(0x2000 + run * 256 + e % 256),
        word(0x4000 + e * 3 % 256), byte((e * 3 + 1) % 256), byte((e * 3 + 2) % 256),
        word(0x8000 + e * 11 % 700),
    )
    rows = _table(spark, sf_dir, "events").select("event_id", F.floor(e / PER_MOVIE).alias("movie"), stream.alias("s"))
    return movie_of(rows, "movie", "event_id", F.lit(STREAM_HEAD), chunk("VQFK", chunk("VPTR", F.col("s"))))


def vptr_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skips, single writes, runs, listed writes and writes that keep pixels by their top bit."""
    rows = V.frame_rows(_stream_movies(spark, sf_dir))
    return rows.select(F.col("movie_id").cast("bigint").alias("movie"), "frame_no", F.md5(F.hex("pixels").cast("binary")).alias("pixels"))


VPTR_SQL = f"""
WITH e AS (SELECT event_id AS e, event_id // {PER_MOVIE} AS movie, (row_number() OVER (PARTITION BY event_id // {PER_MOVIE} ORDER BY event_id) - 1)::INTEGER AS frame_no,
    event_id % 5 AS p, event_id % 4 AS c, 2 * (event_id % 2 + 1) AS r FROM events),
w AS (SELECT movie, frame_no, p AS block, 256 + e * 7 % 200 AS entry, false AS keep FROM e
  UNION ALL SELECT movie, frame_no, p + 1 + i, e % 300, false FROM e, range(3) t(i) WHERE i < c
  UNION ALL SELECT movie, frame_no, p + 1 + c + i, e % 256, false FROM e, range(4) t(i) WHERE i < r
  UNION ALL SELECT movie, frame_no, p + 1 + c + r + i, (e * 3 + i) % 256, false FROM e, range(3) t(i)
  UNION ALL SELECT movie, frame_no, p + 4 + c + r, e * 11 % 700, true FROM e),
g AS (SELECT movie, frame_no, b.i AS block, k.i AS k FROM e, range(16) b(i), range(8) k(i)),
v AS (SELECT g.*, CASE WHEN entry < 512 AND NOT (keep AND (entry * 97 + k * 8231) % 65536 >= 32768) THEN (entry * 97 + k * 8231) % 65536 END AS px
  FROM g LEFT JOIN w USING (movie, frame_no, block)),
s AS (SELECT movie, frame_no, block, k, coalesce(last_value(px IGNORE NULLS) OVER (PARTITION BY movie, block, k ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)::INTEGER AS px FROM v)
SELECT movie::BIGINT AS movie, frame_no, md5(string_agg(printf('%02X%02X', px % 256, px // 256), '' ORDER BY block // 8, k // 4, block % 8, k % 4)) AS pixels FROM s GROUP BY movie, frame_no
"""


def resumed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same frames, eight from each checkpoint on, by scans that resume there."""
    files = _stream_movies(spark, sf_dir)
    rows = V.resumed_rows(files, V.checkpoints(files, 8), 8)
    return rows.select(F.col("movie_id").cast("bigint").alias("movie"), "frame_no", F.md5(F.hex("pixels").cast("binary")).alias("pixels"))


# ---- the older layout: codebooks and tables at the top level ----

SOLID_HEAD = envelope(header(width=8, height=4))


def _solid(value: Column) -> Column:
    """A codebook of one entry in one colour."""
    return F.repeat(byte(value), 8)


def _older_movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    book = chunk("CBF0", _solid(e % 256))
    load = F.when(e % 7 == 0, book).when(e % 7 == 3, chunk("VQFL", book)).otherwise("")
    rows = _table(spark, sf_dir, "events").select("event_id", F.floor(e / PER_MOVIE).alias("movie"), F.concat(load, chunk("VPT0", "00" * 8)).alias("c"))
    return movie_of(rows, "movie", "event_id", F.concat(F.lit(SOLID_HEAD), chunk("CBF0", _solid(F.lit(255)))), F.col("c"))


def codebook_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codebook in force at each frame, loaded at the top level or by a refresh."""
    rows = V.frame_rows(_older_movies(spark, sf_dir))
    return rows.select(F.col("movie_id").cast("bigint").alias("movie"), "frame_no", F.hex("pixels").alias("pixels"))


_BOOKS = f"""
e AS (SELECT event_id // {PER_MOVIE} AS movie, event_id, (row_number() OVER m - 1)::INTEGER AS frame_no,
  coalesce(last_value(CASE WHEN event_id % 7 IN (0, 3) THEN event_id % 256 END IGNORE NULLS) OVER (m ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 255) AS book
  FROM events WINDOW m AS (PARTITION BY event_id // {PER_MOVIE} ORDER BY event_id))
"""
ASOF_SQL = f"WITH {_BOOKS} SELECT movie::BIGINT AS movie, frame_no, repeat(printf('%02X', book::INTEGER), 32) AS pixels FROM e"


def every_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third frame from the second on, up to the twentieth."""
    rows = V.frame_rows(_older_movies(spark, sf_dir), first=1, last=19, every=3)
    return rows.select(F.col("movie_id").cast("bigint").alias("movie"), "frame_no", F.hex("pixels").alias("pixels"))


NTH_SQL = f"{ASOF_SQL} WHERE frame_no % 3 = 1 AND frame_no <= 19"


def frame_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each top-level chunk and the frame it leads to."""
    rows = C.framed(C.chunks(_older_movies(spark, sf_dir), with_payload=False))
    return rows.select(F.col("movie_id").cast("bigint").alias("movie"), "id", "offset", "frame_no", "ends_frame")


NUMBERS_SQL = f"""
WITH {_BOOKS}, c AS (SELECT movie, -1 AS event_id, 0 AS part, 'CBF0' AS id, 16 AS size, 0 AS frame_no FROM e GROUP BY movie
  UNION ALL SELECT movie, event_id, 1, CASE event_id % 7 WHEN 0 THEN 'CBF0' ELSE 'VQFL' END, CASE event_id % 7 WHEN 0 THEN 16 ELSE 24 END, frame_no FROM e WHERE event_id % 7 IN (0, 3)
  UNION ALL SELECT movie, event_id, 2, 'VPT0', 16, frame_no FROM e)
SELECT movie::BIGINT AS movie, id, (62 + sum(size) OVER (PARTITION BY movie ORDER BY event_id, part) - size)::BIGINT AS "offset", frame_no::INTEGER AS frame_no, id = 'VPT0' AS ends_frame FROM c
"""


def frame_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table in each movie is too short; the frames before it and where the scan ends."""
    e = F.col("event_id")
    bad = e % PER_MOVIE == F.floor(e / PER_MOVIE) % PER_MOVIE
    table = F.when(bad, chunk("VPT0", "00" * 6)).otherwise(chunk("VPT0", "00" * 8))
    rows = _table(spark, sf_dir, "events").select("event_id", F.floor(e / PER_MOVIE).alias("movie"), chunk("VQFR", table).alias("c"))
    files = movie_of(rows, "movie", "event_id", F.concat(F.lit(SOLID_HEAD), chunk("CBF0", _solid(F.lit(255)))), F.col("c"))
    f = F.col("error")
    said = message_column(f["kind"], f["cause"], f["chunk"], f["offset"], f["frame"])
    return V.frame_rows(files).select(F.col("movie_id").cast("bigint").alias("movie"), "frame_no", f["cause"].alias("cause"), f["offset"].alias("offset"), F.when(f.isNotNull(), said).alias("message"))


FAULTS_SQL = f"""
WITH e AS (SELECT event_id // {PER_MOVIE} AS movie, row_number() OVER (PARTITION BY event_id // {PER_MOVIE} ORDER BY event_id) - 1 AS frame_no, event_id % {PER_MOVIE} = (event_id // {PER_MOVIE}) % {PER_MOVIE} AS bad FROM events),
b AS (SELECT movie, min(frame_no) AS first FROM e WHERE bad GROUP BY movie),
r AS (SELECT e.movie, frame_no, first, 62 + 16 + 24 * frame_no + 8 AS pos FROM e LEFT JOIN b USING (movie) WHERE first IS NULL OR frame_no <= first)
SELECT movie::BIGINT AS movie, frame_no::INTEGER AS frame_no, CASE WHEN frame_no = first THEN 'PointerTableSize' END AS cause, CASE WHEN frame_no = first THEN pos::BIGINT END AS "offset",
  CASE WHEN frame_no = first THEN 'malformed video data: pointer table size mismatch (frame ' || frame_no || ', VPT0 chunk at offset 0x' || lower(ltrim(hex(pos::BIGINT), '0')) || ')' END AS message FROM r
"""

# ---- codebook parts: a turn of a conversation is a part and a frame ----

_TURNS = "row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1"


def _part_movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even conversations swap by a schedule, every second frame; odd ones whenever three parts are there.  Every other one's parts are packed."""
    turns = _table(spark, sf_dir, "conversations").withColumn("k", F.expr(_TURNS).cast("bigint"))
    turns = turns.withColumn("n", F.expr("count(*) OVER (PARTITION BY conv_id)"))
    solid = _solid((F.octet_length(F.coalesce("text", F.lit(""))) + F.col("k")) % 256)
    part = F.when(F.col("conv_id") % 4 < 2, chunk("CBP0", solid)).otherwise(chunk("CBPZ", F.concat(F.lit("88"), solid)))
    starts = F.array_join(F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("n")), lambda i: F.concat(word(i * 2), F.lit("00" * 4))), "")
    schedule = chunk("CINF", F.concat(chunk("CINH", "00" * 8), chunk("CIND", starts)))
    odd = F.col("conv_id") % 2 == 1
    head = F.when(odd, envelope(header(width=8, height=4, cbparts=3))).otherwise(F.concat(F.lit(SOLID_HEAD), schedule))
    rows = turns.select("conv_id", "k", F.concat(head, chunk("CBF0", _solid(F.lit(250)))).alias("head"), F.concat(chunk("VQFL", part), chunk("VQFR", chunk("VPT0", "00" * 8))).alias("c"))
    return movie_of(rows, "conv_id", "k", F.col("head"), F.col("c"))


def codebook_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each frame shows as staged parts become the codebook."""
    rows = V.frame_rows(_part_movies(spark, sf_dir))
    return rows.select(F.col("movie_id").cast("bigint").alias("conv_id"), "frame_no", F.hex("pixels").alias("pixels"))


SWAPS_SQL = f"""
WITH t AS (SELECT conv_id, {_TURNS} AS k, strlen(coalesce(text, '')) AS size FROM conversations),
f AS (SELECT conv_id, k, CASE WHEN conv_id % 2 = 1 THEN k // 3 * 3 - 3 ELSE k // 2 * 2 - 2 END AS source FROM t)
SELECT f.conv_id, f.k::INTEGER AS frame_no, repeat(printf('%02X', CASE WHEN source < 0 THEN 250 ELSE ((t.size + t.k) % 256)::INTEGER END), 32) AS pixels
FROM f LEFT JOIN t ON t.conv_id = f.conv_id AND t.k = f.source
"""


def schedule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schedule chunk's entries as a relation."""
    rows = C.codebook_schedule(C.chunks(_part_movies(spark, sf_dir)))
    return rows.select(F.col("movie_id").cast("bigint").alias("conv_id"), "entry_no", "start_frame")


SCHEDULE_SQL = f"SELECT conv_id, ({_TURNS})::INTEGER AS entry_no, (2 * ({_TURNS}) + 2)::INTEGER AS start_frame FROM conversations WHERE conv_id % 2 = 0"


def nested_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of both levels, numbered in file order, with their parents and absolute places."""
    rows = C.chunks(_part_movies(spark, sf_dir), with_payload=False)
    return rows.select(F.col("movie_id").cast("bigint").alias("conv_id"), "seq", "parent_seq", "id", "offset", "size")


NESTED_SQL = f"""
WITH t AS (SELECT conv_id, {_TURNS} AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
c AS (SELECT conv_id, -2 AS k, 0 AS part, 'CINF' AS id, 24 + 6 * n AS size, true AS top FROM t WHERE conv_id % 2 = 0 AND k = 0
  UNION ALL SELECT conv_id, -2, 1, 'CINH', 8, false FROM t WHERE conv_id % 2 = 0 AND k = 0
  UNION ALL SELECT conv_id, -2, 2, 'CIND', 6 * n, false FROM t WHERE conv_id % 2 = 0 AND k = 0
  UNION ALL SELECT conv_id, -1, 0, 'CBF0', 8, true FROM t WHERE k = 0
  UNION ALL SELECT conv_id, k, 0, 'VQFL', CASE WHEN conv_id % 4 < 2 THEN 16 ELSE 18 END, true FROM t
  UNION ALL SELECT conv_id, k, 1, CASE WHEN conv_id % 4 < 2 THEN 'CBP0' ELSE 'CBPZ' END, CASE WHEN conv_id % 4 < 2 THEN 8 ELSE 9 END, false FROM t
  UNION ALL SELECT conv_id, k, 2, 'VQFR', 16, true FROM t
  UNION ALL SELECT conv_id, k, 3, 'VPT0', 8, false FROM t),
s AS (SELECT *, row_number() OVER m - 1 AS seq,
  62 + coalesce(sum(CASE WHEN top AND id <> 'CBF0' THEN 8 ELSE 8 + size + size % 2 END) OVER (m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM c WINDOW m AS (PARTITION BY conv_id ORDER BY k, part))
SELECT conv_id, seq::INTEGER AS seq, CASE WHEN NOT top THEN last_value(CASE WHEN top THEN seq END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END::INTEGER AS parent_seq,
  id, pos::BIGINT AS "offset", size::BIGINT AS size FROM s
"""

# ---- sound ----


def soundtrack_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as stereo sound of 16 or 8 bits, whole soundtracks and their mixdown."""
    turns = _table(spark, sf_dir, "conversations").withColumn("k", F.expr(_TURNS).cast("bigint"))
    head = F.when(F.col("conv_id") % 2 == 0, envelope(header(channels=2, bits=16))).otherwise(envelope(header(channels=2)))
    rows = turns.select("conv_id", "k", head.alias("head"), chunk("SND0", F.hex(F.coalesce("text", F.lit("")).cast("binary"))).alias("c"))
    track = A.soundtracks(A.audio_rows(movie_of(rows, "conv_id", "k", F.col("head"), F.col("c"))))
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return track.select(F.col("movie_id").cast("bigint").alias("conv_id"), F.size("samples").cast("bigint").alias("n_samples"), total(F.col("samples")).alias("total"), total(B.mixdown(F.col("samples"))).alias("mono"))


SOUND_SQL = f"""
WITH t AS (SELECT conv_id, {_TURNS} AS k, hex(encode(coalesce(text, ''))) AS h FROM conversations),
i AS (SELECT conv_id, k, unnest(range(length(h) // CASE WHEN conv_id % 2 = 0 THEN 4 ELSE 2 END)) AS i, h FROM t),
v AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k, i) - 1 AS n,
  CASE WHEN conv_id % 2 = 1 THEN (('0x' || substr(h, 2 * i + 1, 2))::INTEGER - 128) * 256
    ELSE (('0x' || substr(h, 4 * i + 3, 2) || substr(h, 4 * i + 1, 2))::INTEGER + 32768) % 65536 - 32768 END AS v FROM i),
p AS (SELECT conv_id, n // 2 AS n, sum(v) AS pair, count(*) AS c FROM v GROUP BY conv_id, n // 2)
SELECT conv_id, sum(c)::BIGINT AS n_samples, sum(pair)::BIGINT AS total, coalesce(sum(CASE WHEN c = 2 THEN trunc(pair / 2) END), 0)::BIGINT AS mono FROM p GROUP BY conv_id
"""


def ima_stereo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item twice as a stereo chunk, halves or alternating bytes by version; the state runs on."""
    items = _table(spark, sf_dir, "benchmark").select("item_id", F.hex(F.coalesce("text", F.lit("")).cast("binary")).alias("h"))
    head = F.when(F.col("item_id") % 2 == 0, envelope(header(channels=2))).otherwise(envelope(header(version=3, channels=2)))
    rows = items.select("item_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), head.alias("head"), chunk("SND2", F.col("h")).alias("c"))
    heard = A.audio_rows(movie_of(rows, "item_id", "k", F.col("head"), F.col("c"))).groupBy("movie_id").agg(
        F.sum(F.size("samples")).alias("n"), F.sum(F.aggregate("samples", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("total"),
        F.max_by(F.element_at("samples", -2), "chunk_no").alias("l"), F.max_by(F.element_at("samples", -1), "chunk_no").alias("r"),
    )
    return heard.select(F.col("movie_id").cast("bigint").alias("item_id"), F.col("n").alias("n_samples"), "total", F.col("l").cast("int").alias("last_left"), F.col("r").cast("int").alias("last_right"))


IMA_STEREO_SQL = f"""
WITH RECURSIVE q AS (SELECT {list(codecs.STEPS)} AS steps, {list(codecs.INDEX_MOVES)} AS moves),
t AS (SELECT item_id, hex(encode(coalesce(text, ''))) AS h, length(hex(encode(coalesce(text, '')))) // 2 AS n FROM benchmark),
u AS (SELECT item_id, c, n // 2 AS half, CASE WHEN item_id % 2 = 1 THEN (CASE c WHEN 0 THEN h[1:2 * (n // 2)] ELSE h[2 * (n // 2) + 1:] END)
    ELSE array_to_string(list_transform(range(c, n, 2), lambda i: substr(h, 2 * i + 1, 2)), '') END AS h FROM t, range(2) x(c)),
s AS (SELECT item_id, c, half, length(h) AS size, h || h AS h FROM u WHERE half > 0),
r(item_id, c, half, size, h, i, sample, idx, total, shown) AS (
  SELECT item_id, c, half, size, h, 0, 0, 0, 0::BIGINT, 0 FROM s UNION ALL
  SELECT item_id, c, half, size, h, i + 1, now, greatest(0, least(88, idx + moves[code % 8 + 1])),
      total + CASE WHEN i % size < 2 * half THEN now ELSE 0 END, CASE WHEN i % size < 2 * half THEN now ELSE shown END FROM (
    SELECT *, greatest(-32768, least(32767, sample + CASE WHEN code >= 8 THEN -d ELSE d END)) AS now FROM (
      SELECT *, (step // 8) + CASE WHEN code & 4 > 0 THEN step ELSE 0 END + CASE WHEN code & 2 > 0 THEN step // 2 ELSE 0 END + CASE WHEN code & 1 > 0 THEN step // 4 ELSE 0 END AS d FROM (
        SELECT r.*, moves, steps[idx + 1] AS step, ('0x' || substr(h, i + 2 - 2 * (i % 2), 1))::INTEGER AS code FROM r, q WHERE i < length(h)))))
SELECT item_id, sum(4 * half)::BIGINT AS n_samples, sum(total)::BIGINT AS total, max(CASE c WHEN 0 THEN shown END)::INTEGER AS last_left, max(CASE c WHEN 1 THEN shown END)::INTEGER AS last_right
FROM r WHERE i = length(h) GROUP BY item_id
"""


def mixdown_av(spark: SparkSession, sf_dir: str) -> DataFrame:
    """two samples to one, cut toward zero, and the frame shown at the sample's time."""
    l = F.floor(F.col("value") * 100).cast("bigint") % 32768
    pair = F.array(l.cast("smallint"), (16384 - l).cast("smallint"), (-l).cast("smallint"), (l % 100).cast("smallint"))
    mono = B.mixdown(pair)
    frame = A.frame_at(F.col("event_id") / 22050, F.lit(15))
    return _table(spark, sf_dir, "events").select("event_id", F.get(mono, 0).cast("int").alias("one"), F.get(mono, 1).cast("int").alias("two"), frame.alias("frame_no"))


MIX_SQL = """
WITH t AS (SELECT event_id, floor(value * 100)::BIGINT % 32768 AS s FROM events)
SELECT event_id, trunc((s + 16384 - s) / 2)::INTEGER AS one, trunc((s % 100 - s) / 2)::INTEGER AS two, floor(event_id / 22050 * 15)::INTEGER AS frame_no FROM t
"""


def westwood_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw samples, 2-bit and 4-bit steps, a 5-bit step and repeats in one chunk an event."""
    rows = _table(spark, sf_dir, "events").select("event_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for e in f["event_id"].tolist():
                data = bytes([0x81, 7, 100 + e % 50, 0x00, e % 256, 0x40, e * 7 % 256, 0xA0 | e % 32, 0xC0 | e % 64])
                samples = codecs.westwood((9 + e % 64 + 1).to_bytes(2, "little") + b"\xff\xff" + data).tolist()
                out.append((e, len(samples), *samples[:9], sum(samples)))
            yield pd.DataFrame(out, columns=["event_id", "n_samples", *(f"s{i}" for i in range(9)), "total"])

    names = ", ".join(f"s{i} int" for i in range(9))
    return rows.mapInPandas(run, f"event_id bigint, n_samples bigint, {names}, total bigint")


WESTWOOD_ALL_SQL = f"""
WITH m AS (SELECT {list(codecs.NIBBLE_MOVES)} AS moves),
a AS (SELECT event_id, 7 AS s0, 100 + event_id % 50 AS s1, event_id % 256 AS p, event_id * 7 % 256 AS q FROM events),
b AS (SELECT *, s1 + p % 4 - 2 AS s2, s1 + p % 4 + p // 4 % 4 - 4 AS s3, s1 + p % 4 + p // 4 % 4 + p // 16 % 4 - 6 AS s4, s1 + p % 4 + p // 4 % 4 + p // 16 % 4 + p // 64 - 8 AS s5 FROM a),
c AS (SELECT b.*, s5 + moves[q % 16 + 1] AS s6, s5 + moves[q % 16 + 1] + moves[q // 16 + 1] AS s7 FROM b, m),
d AS (SELECT *, s7 + (event_id % 32 + 16) % 32 - 16 AS s8 FROM c)
SELECT event_id, (10 + event_id % 64)::BIGINT AS n_samples, {", ".join(f"s{i}::INTEGER AS s{i}" for i in range(9))}, (s0 + s1 + s2 + s3 + s4 + s5 + s6 + s7 + s8 * (event_id % 64 + 2))::BIGINT AS total FROM d
"""

# ---- bytes ----


def lcw_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals, fills, short, middle and long copies, by absolute places or by distances as a first zero byte tells."""
    rows = _table(spark, sf_dir, "customer").select("c_custkey", F.coalesce("c_name", F.lit("")).alias("name"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for key, name in zip(f["c_custkey"].tolist(), f["name"], strict=True):
                text, fill = (name + "......")[:60].encode(), key % 300
                near, n = key % 5 + 1, len(text) + key % 300
                packed = bytes([0x80 + len(text)]) + text + b"\xfe" + fill.to_bytes(2, "little") + b"*"
                packed += bytes([(key % 8) << 4, near])
                n += key % 8 + 3

                def place(at: int, written: int, relative: bool = bool(key % 2)) -> bytes:
                    return (written - at if relative else at).to_bytes(2, "little")

                packed += bytes([0xC0 + 2]) + place(1, n)
                packed += b"\xff" + (6).to_bytes(2, "little") + place(0, n + 5) + (b"\x80tail" if key % 3 else b"")
                out.append((key, codecs.lcw(b"\0" * (key % 2) + packed, 4096).decode()))
            yield pd.DataFrame(out, columns=["c_custkey", "plain"])

    return rows.mapInPandas(run, "c_custkey bigint, plain string")


LCW_SQL = """
WITH t AS (SELECT c_custkey AS k, substr(coalesce(c_name, '') || '......', 1, 60) AS t FROM customer),
f AS (SELECT k, t || repeat('*', (k % 300)::INTEGER) AS s FROM t),
n AS (SELECT k, s || substr(repeat(right(s, (k % 5 + 1)::INTEGER), 11), 1, (k % 8 + 3)::INTEGER) AS s FROM f)
SELECT k AS c_custkey, s || substr(s, 2, 5) || substr(s, 1, 6) AS plain FROM n
"""


def expand_movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movies with packed chunks rewritten with plain ones; those that cannot be read say why."""
    name = F.hex(F.rpad(F.coalesce("c_name", F.lit("")), 24, ".").cast("binary"))
    packed = chunk("VQFR", F.concat(chunk("CBFZ", F.concat(F.lit("98"), name, F.lit("80"))), chunk("VPTZ", "FE0800" + "0080"), chunk("CPL0", "010203")))
    bad = chunk("VQFR", chunk("CBFZ", "C2"))
    body = F.when(F.col("c_custkey") % 10 == 9, bad).otherwise(packed)
    files = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.unhex(F.concat(F.lit(SOLID_HEAD), body)).alias("content"))
    rows = expanded(files)
    return rows.select(F.col("path").cast("bigint").alias("c_custkey"), F.hex(F.expr("substring(content, 63)")).alias("body"), F.col("error.cause").alias("cause"), F.col("error.chunk").alias("chunk"), F.col("error.offset").alias("offset"))


EXPAND_SQL = """
SELECT c_custkey, CASE WHEN c_custkey % 10 <> 9 THEN hex(encode('VQFR')) || '0000003C' || hex(encode('CBF0')) || '00000018' || hex(encode(rpad(coalesce(c_name, ''), 24, '.')))
  || hex(encode('VPT0')) || '00000008' || repeat('00', 8) || hex(encode('CPL0')) || '00000003' || '01020300' END AS body,
  CASE WHEN c_custkey % 10 = 9 THEN 'LcwTruncated' END AS cause, CASE WHEN c_custkey % 10 = 9 THEN 'CBFZ' END AS chunk, CASE WHEN c_custkey % 10 = 9 THEN 70::BIGINT END AS "offset" FROM customer
"""


def broken_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A2, A4: envelopes cut at every length, other magics and versions 0 to 4."""
    k = F.col("c_custkey")
    head = envelope(header(version=0))
    version = F.concat(F.lit(head[:40]), byte(k % 5), F.lit(head[42:]))
    h = F.when(k % 3 == 0, version).when(k % 3 == 1, F.lit(envelope(header()))).otherwise(F.when(k % 2 == 0, F.lit("524946" + head[6:])).otherwise(F.lit(head[:24] + "56514845" + head[32:])))
    size = F.when(k % 3 == 0, 62).otherwise(F.floor(k / 3) % 63).cast("int")
    files = _table(spark, sf_dir, "customer").select(k.cast("string").alias("path"), F.unhex(F.substring(h, F.lit(1), size * 2)).alias("content"))
    rows = C.movies(files)
    return rows.select(F.col("movie_id").cast("bigint").alias("c_custkey"), F.col("header.version").alias("version"), F.col("error.kind").alias("kind"), F.col("error.chunk").alias("chunk"), F.col("error.offset").alias("offset"))


HEADERS_SQL = """
WITH t AS (SELECT c_custkey AS k, c_custkey // 3 % 63 AS n FROM customer),
c AS (SELECT k, n, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 5 IN (1, 2, 3) THEN NULL ELSE 'InvalidHeader' END
  WHEN k % 3 = 1 THEN CASE WHEN n = 0 THEN 'NotVqa' WHEN n < 62 THEN 'Truncated' END
  WHEN k % 2 = 0 THEN CASE WHEN n = 0 THEN 'NotVqa' ELSE 'NotVqa' END
  ELSE CASE WHEN n = 0 THEN 'NotVqa' WHEN n < 16 THEN 'Truncated' ELSE 'InvalidHeader' END END AS kind FROM t)
SELECT k AS c_custkey, CASE WHEN kind IS NULL THEN CASE WHEN k % 3 = 0 THEN (k % 5)::INTEGER ELSE 2 END END AS version, kind,
  CASE WHEN kind IS NULL OR kind = 'NotVqa' THEN NULL WHEN k % 3 = 0 THEN 'VQHD' WHEN n < 16 THEN NULL WHEN k % 3 = 1 THEN 'VQHD' ELSE 'VQHE' END AS chunk,
  CASE WHEN kind IS NULL OR kind = 'NotVqa' OR (k % 3 > 0 AND n < 12) THEN NULL ELSE 12::BIGINT END AS "offset" FROM c
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        vpt_render, ppm_dump, vptr_pixels, resumed_frames, codebook_asof, every_nth, frame_numbers, frame_faults, codebook_swaps, schedule_rows,
        nested_walk, soundtrack_sums, ima_stereo, mixdown_av, westwood_commands, lcw_commands, expand_movies, broken_headers,
    )
}

ORACLES: dict[str, str] = {
    "vpt_render": VPT_SQL, "ppm_dump": PPM_SQL, "vptr_pixels": VPTR_SQL, "resumed_frames": VPTR_SQL, "codebook_asof": ASOF_SQL, "every_nth": NTH_SQL,
    "frame_numbers": NUMBERS_SQL, "frame_faults": FAULTS_SQL, "codebook_swaps": SWAPS_SQL, "schedule_rows": SCHEDULE_SQL, "nested_walk": NESTED_SQL,
    "soundtrack_sums": SOUND_SQL, "ima_stereo": IMA_STEREO_SQL, "mixdown_av": MIX_SQL, "westwood_commands": WESTWOOD_ALL_SQL, "lcw_commands": LCW_SQL,
    "expand_movies": EXPAND_SQL, "broken_headers": HEADERS_SQL,
}
