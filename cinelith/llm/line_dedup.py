"""Line dedup, DataFrame operations only.

Lines become 128-bit key hashes.  The hashes are range-partitioned and sorted
inside each partition by (hash, document, position), so one streaming pass over
a run sees a key's first occurrence first and its documents one after another.
What comes back is not text but, per document, a sparse bitmap of dropped
lines: one 64-bit word for each block of 64 lines that loses any.

Hot keys: a key's run is cut into SALTS sub-runs by document, each with its own
first occurrence and document count; sub-runs (at most SALTS rows a key) are
merged by a partially aggregated group-by.  No task holds a key's rows together.

Defined cases: null or empty text is one empty line; a null doc_id counts as
one document; rows that repeat a doc_id are one document when documents are
counted, and each is returned; blank lines (empty keys) are never dropped;
columns besides doc_id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinelith.llm.shared import ascii_lower, materialize, row_keys, whole_text

BLANKS = " \t\n\x0b\f\r"
SALTS = 64


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_bitmaps(docs: DataFrame, min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """(rk1, rk2, dropped array<struct<word int, bits bigint>>) for rows that lose lines.

    A key of one code point or more that is found in min_docs documents or more
    loses its lines; with keep_first the first occurrence, by (doc_id, position),
    stays.  A null doc_id orders first.
    """
    rows = docs.select("doc_id", whole_text().alias("text"))
    lines = rows.select("doc_id", *row_keys(), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = lines.select("doc_id", "rk1", "rk2", "pos", line_key(F.col("line")).alias("key")).where("key <> ''")
    found = materialize(
        keyed.select("doc_id", "rk1", "rk2", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")), "lines"
    )
    salted = found.select("h1", "h2", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"), "doc_id", "pos")
    run = Window.partitionBy("h1", "h2", "salt").orderBy("doc_id", "pos")
    streamed = salted.repartitionByRange("h1", "h2", "salt").select(
        "*", F.lag(F.struct("doc_id")).over(run).alias("before")
    )
    heads = streamed.groupBy("h1", "h2", "salt").agg(
        F.count_if(F.col("before").isNull() | ~F.col("before.doc_id").eqNullSafe(F.col("doc_id"))).alias("n"),
        F.min(F.struct("doc_id", "pos")).alias("first"),
    )
    keys = heads.groupBy("h1", "h2").agg(F.sum("n").alias("n_docs"), F.min("first").alias("first")).where(F.col("n_docs") >= min_docs)
    # written, so that its size is known before the join and a hot key's side can be split
    hits = found.join(materialize(keys.select("h1", "h2", "first"), "repeated"), ["h1", "h2"])
    if keep_first:
        hits = hits.where(~F.struct("doc_id", "pos").eqNullSafe(F.col("first")))
    words = hits.groupBy("rk1", "rk2", F.shiftright("pos", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits")
    )
    return words.groupBy("rk1", "rk2").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Each row of docs as struct `row`, with its new text, n_lines before and n_dropped."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", whole_text().alias("text")).select("row", "text", *row_keys())
    joined = rows.join(bitmaps, ["rk1", "rk2"], "left").withColumn("lines", F.split("text", "\n"))
    gone = F.expr(
        "flatten(transform(dropped, w -> transform("
        "filter(sequence(0, 63), b -> (shiftright(w.bits, b) & 1L) = 1L), b -> w.word * 64 + b)))"
    )
    kept = F.expr("array_join(transform(array_except(sequence(0, size(lines) - 1), gone), i -> lines[i]), '\\n')")
    return joined.withColumn("gone", gone).select(
        "row",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def dedup_lines(docs: DataFrame, min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """docs whose text has lost its repeated lines; other columns unchanged."""
    done = apply_bitmaps(docs, line_bitmaps(docs.select("doc_id", "text"), min_docs, keep_first))
    return done.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def digest(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    slim = docs.select("doc_id", "text")
    done = apply_bitmaps(slim, line_bitmaps(slim, min_docs))
    return done.select("row.doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents),
lines AS (SELECT r, doc_id, unnest(t) AS line, generate_subscripts(t, 1) AS pos FROM d),
keyed AS (SELECT r, doc_id, pos, line,
  translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
hot AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT coalesce(doc_id::VARCHAR, '')) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(h.k)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE h.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN hot h ON keyed.k = h.k GROUP BY r, doc_id
"""
