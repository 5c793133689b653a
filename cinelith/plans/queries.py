"""Queries over the driver's tables that exercise the engine, each with its SQL.

The tables hold no movies, so byte streams are derived from them: text bytes are
sound or header images, keys are packed words, conversations are chunked files.
Every query reads its whole table and stays in Catalyst unless its operator is a
Python kernel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinelith.functions import binary as B
from cinelith.functions import codecs
from cinelith.functions.faults import message_column
from cinelith.operators import audio as A
from cinelith.operators import container as C
from cinelith.operators import video as V
from cinelith.plans import movie_queries


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _image(n: int):
    """The first n bytes of a text, as a payload of that size."""
    return F.substring(F.col("text").cast("binary"), 1, n)


def header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3, A5: each long enough text read as a 42-byte header, every field of it."""
    rows = _table(spark, sf_dir, "documents").where(F.octet_length("text") >= 42).select("doc_id", C.header_struct(_image(42)).alias("header"))
    spare = [F.col("header.future_use")[i].alias(f"spare{i}") for i in range(5)]
    return rows.select("doc_id", *[F.col(f"header.{name}") for name, _, _ in C.FIELDS], *spare, *C.derived())


def _u16(at: int) -> str:
    return f"('0x' || substr(h, {2 * at + 3}, 2) || substr(h, {2 * at + 1}, 2))::INTEGER"


def _u8(at: int) -> str:
    return f"('0x' || substr(h, {2 * at + 1}, 2))::INTEGER"


HEADER_SQL = f"""
WITH t AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE strlen(text) >= 42)
SELECT doc_id, {", ".join(f"{_u8(at) if n == 1 else _u16(at)} AS {name}" for name, at, n in C.FIELDS)}, {", ".join(f"{_u16(32 + 2 * i)} AS spare{i}" for i in range(5))},
  coalesce(nullif({_u16(24)}, 0), 22050) AS sample_rate, coalesce(nullif({_u8(26)}, 0), 1) AS num_channels, coalesce(nullif({_u8(27)}, 0), 8) AS bit_depth,
  {_u16(34)}::BIGINT + {_u16(36)}::BIGINT * 65536 AS max_cbfz_size, ({_u16(2)} & 1) = 1 AS has_sound, {_u16(14)} = 0 AS is_hicolor
FROM t
"""


def _conversation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One movie a conversation, one SNDx chunk a turn; x is 0, 1 or 2 by role."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    name = F.when(F.col("role") == "user", "SND0").when(F.col("role") == "assistant", "SND1").otherwise("SND2")
    size = F.octet_length("data")
    chunk = F.concat(F.hex(F.encode(name, "US-ASCII")), F.lpad(F.hex(size.cast("bigint")), 8, "0"), F.hex("data"), F.when(size % 2 == 1, "00").otherwise(""))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", chunk.alias("c")))), lambda x: x["c"]), "")
    head = "464F524D000000005756514156514844" + "0000002A" + "0200" + "00" * 40
    return turns.groupBy("conv_id").agg(F.unhex(F.concat(F.lit(head), body)).alias("content")).select(F.col("conv_id").cast("string").alias("path"), "content")


def chunk_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk of each conversation's file."""
    rows = C.chunks(_conversation_files(spark, sf_dir), with_payload=False)
    return rows.select(F.col("movie_id").cast("bigint").alias("conv_id"), "seq", "id", "offset", "size")


CHUNKS_CTE = """
t AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'SND0' WHEN 'assistant' THEN 'SND1' ELSE 'SND2' END AS id, strlen(coalesce(text, ''))::BIGINT AS size,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS seq FROM conversations),
c AS (SELECT *, 62 + coalesce(sum(8 + size + size % 2) OVER (PARTITION BY conv_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM t)
"""
CHUNK_WALK_SQL = f'WITH {CHUNKS_CTE} SELECT conv_id, seq::INTEGER AS seq, id, pos::BIGINT AS "offset", size FROM c'


def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and counts by chunk id: the first question asked of a library of movies."""
    return chunk_walk(spark, sf_dir).groupBy("id").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("offset").alias("last_offset"))


CHUNK_STATS_SQL = f"WITH {CHUNKS_CTE} SELECT id, count(*)::BIGINT AS n, sum(size)::BIGINT AS bytes, max(pos)::BIGINT AS last_offset FROM c GROUP BY id"


def finf_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: order keys as raw index words, packed into one FINF a customer."""
    orders = _table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") * 2654435761 % 4294967296).alias("raw"), "o_orderkey")
    h = F.lpad(F.hex("raw"), 8, "0")
    word = F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", word.alias("w")))), lambda x: x["w"]), "")
    rows = orders.groupBy("o_custkey").agg(F.unhex(joined).alias("data")).select(
        F.col("o_custkey").cast("string").alias("movie_id"), F.lit(0).alias("seq"), F.lit(None).cast("int").alias("parent_seq"), F.lit("FINF").alias("id"), "data"
    )
    return C.frame_index(rows).select(F.col("movie_id").cast("bigint").alias("o_custkey"), "entry_no", "offset", "has_palette")


FINF_SQL = """
WITH t AS (SELECT o_custkey, o_orderkey, (o_orderkey * 2654435761) % 4294967296 AS raw FROM orders)
SELECT o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INTEGER AS entry_no,
  ((raw & 268435455) * 2)::BIGINT AS "offset", (raw & 1073741824) <> 0 AS has_palette FROM t
"""


def pcm8_widen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whole texts as 8-bit sound, summed per text after widening to stereo."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", B.pcm8_stereo(F.col("text").cast("binary")).alias("s"))
    total = F.aggregate("s", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select("doc_id", F.size("s").cast("bigint").alias("n_samples"), total.alias("total"), F.get("s", 0).cast("int").alias("first"))


PCM8_SQL = """
WITH t AS (SELECT doc_id, string_split(regexp_replace(hex(encode(text)), '(..)', '\\1 ', 'g'), ' ') AS p FROM documents),
s AS (SELECT doc_id, list_transform(list_filter(p, lambda x: x <> ''), lambda x: (('0x' || x)::INTEGER - 128) * 256) AS s FROM t)
SELECT doc_id, 2 * len(s)::BIGINT AS n_samples, coalesce(2 * list_sum(s), 0)::BIGINT AS total, s[1]::INTEGER AS first FROM s
"""


def pcm16_le(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whole texts as 16-bit sound."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", B.pcm16(F.col("text").cast("binary")).alias("s"))
    total = F.aggregate("s", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select("doc_id", F.size("s").cast("bigint").alias("n_samples"), total.alias("total"))


PCM16_SQL = """
WITH t AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '....') AS p FROM documents),
s AS (SELECT doc_id, list_transform(p, lambda x: ('0x' || x[3:4] || x[1:2])::INTEGER) AS s FROM t)
SELECT doc_id, len(s)::BIGINT AS n_samples, coalesce(list_sum(list_transform(s, lambda v: CASE WHEN v >= 32768 THEN v - 65536 ELSE v END)), 0)::BIGINT AS total FROM s
"""


def ima_adpcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item texts of the benchmark as IMA ADPCM, decoded whole."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, t in zip(f["item_id"], f["text"], strict=True):
                samples, sample, index = codecs.ima((t or "").encode())
                rows.append((i, len(samples), sample, index))
            yield pd.DataFrame(rows, columns=["item_id", "n_samples", "sample", "step_index"])

    return _table(spark, sf_dir, "benchmark").select("item_id", "text").mapInPandas(run, "item_id bigint, n_samples bigint, sample bigint, step_index bigint")


IMA_SQL = f"""
WITH RECURSIVE k AS (SELECT {list(codecs.STEPS)} AS steps, {list(codecs.INDEX_MOVES)} AS moves),
t AS (SELECT item_id, hex(encode(text)) AS h FROM benchmark WHERE text IS NOT NULL),
r(item_id, h, i, sample, idx) AS (
  SELECT item_id, h, 0, 0, 0 FROM t UNION ALL
  SELECT item_id, h, i + 1, greatest(-32768, least(32767, sample + CASE WHEN code >= 8 THEN -d ELSE d END)), greatest(0, least(88, idx + moves[code % 8 + 1])) FROM (
    SELECT item_id, h, i, sample, idx, moves, code, (step // 8) + CASE WHEN code & 4 > 0 THEN step ELSE 0 END
      + CASE WHEN code & 2 > 0 THEN step // 2 ELSE 0 END + CASE WHEN code & 1 > 0 THEN step // 4 ELSE 0 END AS d FROM (
      SELECT r.*, moves, steps[idx + 1] AS step, ('0x' || substr(h, i + 2 - 2 * (i % 2), 1))::INTEGER AS code FROM r, k WHERE i < length(h))))
SELECT item_id, length(h)::BIGINT AS n_samples, sample::BIGINT AS sample, idx::BIGINT AS step_index FROM r WHERE i = length(h)
"""


def lcw_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page packed as literal runs and unpacked again."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, h in zip(f["page_id"], f["html"], strict=True):
                data = (h or "").encode()
                out = codecs.lcw(codecs.lcw_literals(data), len(data), relative=False)
                rows.append((i, len(out), out.decode()))
            yield pd.DataFrame(rows, columns=["page_id", "n_bytes", "html"])

    rows = _table(spark, sf_dir, "pages").select("page_id", "html").mapInPandas(run, "page_id bigint, n_bytes bigint, html string")
    return rows.select("page_id", "n_bytes", F.md5("html").alias("md5"))


LCW_SQL = "SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n_bytes, md5(coalesce(html, '')) AS md5 FROM pages"


def westwood_adpcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event values as chunks of one 5-bit step and a run of repeats."""
    rows = _table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 32).cast("int").alias("step"), (F.col("user_id") % 64).cast("int").alias("run"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for e, step, n in zip(f["event_id"], f["step"], f["run"], strict=True):
                samples = codecs.westwood((n + 2).to_bytes(2, "little") + b"\xff\xff" + bytes([0xA0 | step, 0xC0 | n]))
                out.append((e, len(samples), int(samples[-1]), int(samples.sum())))
            yield pd.DataFrame(out, columns=["event_id", "n_samples", "last", "total"])

    return rows.mapInPandas(run, "event_id bigint, n_samples bigint, last int, total bigint")


WESTWOOD_SQL = """
WITH t AS (SELECT event_id, (user_id % 64) + 2 AS n, (128 + CASE WHEN event_id % 32 >= 16 THEN event_id % 32 - 32 ELSE event_id % 32 END) AS v FROM events)
SELECT event_id, n::BIGINT AS n_samples, v::INTEGER AS last, (n * v)::BIGINT AS total FROM t
"""


def fnv1a_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FNV-1a of every benchmark item, as hexadecimal text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"item_id": f["item_id"], "fnv": [f"{codecs.fnv1a((t or '').encode()):016x}" for t in f["text"]]})

    return _table(spark, sf_dir, "benchmark").select("item_id", "text").mapInPandas(run, "item_id bigint, fnv string")


FNV_SQL = """
WITH RECURSIVE t AS (SELECT item_id, hex(encode(text)) AS h FROM benchmark),
r(item_id, h, i, d) AS (SELECT item_id, h, 0, 14695981039346656037::UHUGEINT FROM t UNION ALL
  SELECT item_id, h, i + 1, (xor(d, ('0x' || substr(h, 2 * i + 1, 2))::UHUGEINT) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT FROM r WHERE 2 * i < length(h))
SELECT item_id, lpad(lower(hex(d::UBIGINT)), 16, '0') AS fnv FROM r WHERE 2 * i = length(h)
"""


def palette_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """6-bit components as 8 bits."""
    rows = _table(spark, sf_dir, "part")
    return rows.select("p_partkey", B.six_to_eight((F.col("p_partkey") % 256).cast("int")).alias("r"), B.six_to_eight(F.col("p_size")).alias("g"))


PALETTE_SQL = """
SELECT p_partkey, ((p_partkey % 256 & 63) * 4 + ((p_partkey % 256 & 63) >> 4))::INTEGER AS r, ((p_size & 63) * 4 + ((p_size & 63) >> 4))::INTEGER AS g FROM part
"""


def hicolor_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part keys as 15-bit pixels, as RGB and XRGB."""
    pixel = (F.col("l_partkey") % 65536).cast("int")
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *B.hicolor_rgb(pixel))
    return rows.withColumn("xrgb", B.xrgb(F.col("r"), F.col("g"), F.col("b")))


HICOLOR_SQL = """
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey % 65536 AS v FROM lineitem),
f AS (SELECT *, (v >> 10) & 31 AS r5, (v >> 5) & 31 AS g5, v & 31 AS b5 FROM p),
e AS (SELECT *, (r5 * 8 + (r5 >> 2))::INTEGER AS r, (g5 * 8 + (g5 >> 2))::INTEGER AS g, (b5 * 8 + (b5 >> 2))::INTEGER AS b FROM f)
SELECT l_orderkey, l_linenumber, r, g, b, (r * 65536 + g * 256 + b)::BIGINT AS xrgb FROM e
"""


def indexed_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indices through a palette; one without an entry is black."""
    palette = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("idx"), B.six_to_eight(F.col("n_regionkey") * 13).alias("r"))
    rows = _table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 32).cast("int").alias("idx"))
    return rows.join(palette, "idx", "left").select("c_custkey", "idx", F.coalesce("r", F.lit(0)).alias("r"))


INDEXED_SQL = """
SELECT c_custkey, (c_custkey % 32)::INTEGER AS idx, coalesce((n_regionkey * 13 & 63) * 4 + ((n_regionkey * 13 & 63) >> 4), 0)::INTEGER AS r
FROM customer LEFT JOIN nation ON n_nationkey = c_custkey % 32
"""


def error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's file cut at a byte of its own, and what the walk says of it."""
    files = _conversation_files(spark, sf_dir)
    files = files.select("path", F.expr("substring(content, 1, length(content) - cast(path AS bigint) % 97 - 1)").alias("content"))
    e = F.col("error")
    rows = C.chunks(files, with_payload=False).where("error IS NOT NULL")
    said = message_column(e["kind"], e["cause"], e["chunk"], e["offset"], e["frame"])
    return rows.select(F.col("movie_id").cast("bigint").alias("conv_id"), e["kind"].alias("kind"), e["offset"].alias("offset"), said.alias("message"))


ERROR_SQL = f"""
WITH {CHUNKS_CTE}, n AS (SELECT conv_id, max(pos + 8 + size + size % 2) - (conv_id % 97) - 1 AS len FROM c GROUP BY conv_id),
x AS (SELECT c.conv_id, c.id, c.pos, n.len, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.pos) AS k FROM c JOIN n USING (conv_id)
      WHERE n.len >= 62 AND c.pos < n.len AND c.pos + 8 + c.size > n.len)
SELECT conv_id, 'Truncated' AS kind, pos::BIGINT AS "offset", 'unexpected end of data (' || CASE WHEN len - pos >= 4 THEN id || ' chunk ' ELSE '' END || 'at offset 0x' || lower(ltrim(hex(pos::BIGINT), '0')) || ')' AS message FROM x WHERE k = 1
UNION ALL SELECT conv_id, 'Truncated', 12, 'unexpected end of data (' || CASE WHEN len >= 16 THEN 'VQHD chunk ' ELSE '' END || 'at offset 0xc)' FROM n WHERE len < 62 AND len >= 12
UNION ALL SELECT conv_id, 'Truncated', NULL, 'unexpected end of data' FROM n WHERE len < 12 AND len > 0
UNION ALL SELECT conv_id, 'NotVqa', NULL, 'not a VQA file' FROM n WHERE len <= 0
"""

def swap_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as a schedule in file order, and the frames at which it swaps."""
    entry = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    schedule = _table(spark, sf_dir, "events").select(F.col("user_id").alias("movie_id"), entry.alias("entry_no"), (F.col("event_id") * 7919 % 500).cast("int").alias("start_frame"))
    return C.swap_frames(schedule).withColumnRenamed("movie_id", "user_id")


SWAP_SQL = """
WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, (event_id * 7919 % 500)::INTEGER AS start FROM events)
SELECT DISTINCT user_id, start AS frame_no FROM s WHERE NOT EXISTS (SELECT 1 FROM s AS b WHERE b.user_id = s.user_id AND b.k < s.k AND b.start > s.start)
"""


def codebook_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as codebook parts, three to a cycle."""
    order = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    parts = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("movie_id"), order.alias("seq"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    whole = C.joined_parts(parts, 3)
    return whole.select(F.col("movie_id").alias("conv_id"), "cycle", F.octet_length("data").cast("bigint").alias("size"), F.md5("data").alias("digest"))


PARTS_SQL = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text NULLS FIRST) - 1 AS k, coalesce(text, '') AS text FROM conversations),
j AS (SELECT conv_id, (k // 3)::INTEGER AS cycle, string_agg(text, '' ORDER BY k) AS data, count(*) AS n FROM t GROUP BY conv_id, k // 3)
SELECT conv_id, cycle, strlen(data)::BIGINT AS size, md5(data) AS digest FROM j WHERE n = 3
"""


def vptr_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as the commands of a HiColor frame, and the blocks they write."""
    word, count = (F.col("l_partkey") * 7919 % 57344).cast("int"), F.col("l_quantity").cast("int")
    writes = V.command_writes(word, count).cast("bigint")
    return _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(writes).alias("writes"))


WRITES_SQL = """
WITH w AS (SELECT l_orderkey, l_quantity::INTEGER AS count, l_partkey * 7919 % 57344 AS word FROM lineitem),
c AS (SELECT *, word // 8192 AS command, word // 256 % 32 + 1 AS run FROM w)
SELECT l_orderkey, sum(CASE command WHEN 1 THEN run * 2 WHEN 2 THEN run * 2 + 1 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN count WHEN 6 THEN count ELSE 0 END)::BIGINT AS writes
FROM c GROUP BY l_orderkey
"""


def resample_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a user's values as a stereo soundtrack, from three samples to four."""
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    s = F.col("event_id") * 7919 % 65536 - 32768
    samples = _table(spark, sf_dir, "events").select(F.col("user_id").alias("movie_id"), order.alias("sample_no"), s.alias("left"), (-1 - s).alias("right"))
    return A.resampled(samples, 3, 4).select(F.col("movie_id").alias("user_id"), F.col("sample_no").cast("bigint").alias("sample_no"), "left", "right")


RESAMPLE_SQL = """
WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, event_id * 7919 % 65536 - 32768 AS v FROM events),
n AS (SELECT user_id, count(*) AS n FROM s GROUP BY user_id),
o AS (SELECT user_id, n, unnest(range(n * 4 // 3)) AS place FROM n),
p AS (SELECT user_id, place, place * 3 // 4 AS i, least(place * 3 // 4 + 1, n - 1) AS j, place * 3 % 4 / 4.0::DOUBLE AS part FROM o)
SELECT p.user_id, p.place::BIGINT AS sample_no, trunc(a.v + (b.v - a.v) * part)::BIGINT AS "left", trunc(-1 - a.v + (a.v - b.v) * part)::BIGINT AS "right"
FROM p JOIN s a ON a.user_id = p.user_id AND a.k = p.i JOIN s b ON b.user_id = p.user_id AND b.k = p.j
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        header_fields, chunk_walk, chunk_stats, finf_decode, pcm8_widen, pcm16_le, ima_adpcm, lcw_roundtrip, westwood_adpcm, fnv1a_digest, palette_scale,
        hicolor_convert, indexed_convert, error_report, swap_frames, codebook_parts, vptr_writes, resample_linear,
    )
} | movie_queries.QUERIES

ORACLES: dict[str, str] = {
    "header_fields": HEADER_SQL, "chunk_walk": CHUNK_WALK_SQL, "chunk_stats": CHUNK_STATS_SQL, "finf_decode": FINF_SQL, "pcm8_widen": PCM8_SQL,
    "pcm16_le": PCM16_SQL, "ima_adpcm": IMA_SQL, "lcw_roundtrip": LCW_SQL, "westwood_adpcm": WESTWOOD_SQL, "fnv1a_digest": FNV_SQL,
    "palette_scale": PALETTE_SQL, "hicolor_convert": HICOLOR_SQL, "indexed_convert": INDEXED_SQL, "error_report": ERROR_SQL,
    "swap_frames": SWAP_SQL, "codebook_parts": PARTS_SQL, "vptr_writes": WRITES_SQL, "resample_linear": RESAMPLE_SQL,
} | movie_queries.ORACLES
