"""Values of a model of any size for the keys (words, byte n-grams) of each text.

Nothing here is broadcast but what orders 0 and 1 of an n-gram model count (at most
257 * 257 grams a class).  Texts are gathered in chunks of about CHUNK bytes (one text
at least).  Each chunk asks for the value of each of its different keys once; the
values come back to the chunk, where they are summed over its texts.  So no row is
made for a place of a text, a key that every text holds is one row a chunk, and no
count is left out.

An n-gram model is dealt out by the two symbols nearest to a gram's own, so that
all of a part's contexts of two symbols or more are whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelith.llm.shared import materialize
from cinelith.llm.text import slices

CHUNK = 16 << 20
PART_GRAMS = 1 << 18
#: The bits of a gram's symbol and nearest context symbol.
LOW = (1 << 18) - 1

#: A field that keeps a struct from being empty.
NOTHING = "__"

#: (bytes, offsets) of some texts -> (keys, the text of each).
KeysOf = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def chunked(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(chunk, rest, text) of rows with a column text; rest has the other columns."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            ids = np.zeros(b.num_rows, np.int64)
            for i, size in enumerate(pc.binary_length(b.column("text")).fill_null(0).to_pylist()):
                if held and held + size > chunk:
                    at, held = at + 1, 0
                held += size + 1
                ids[i] = at
            yield pa.RecordBatch.from_arrays([pa.array(ids), b.column("rest"), b.column("text")], ["chunk", "rest", "text"])

    rest = F.struct(F.lit(0).alias(NOTHING), *[F.col(c) for c in rows.columns if c != "text"]).alias("rest")
    packed = rows.select(rest, F.col("text").cast("string").alias("text"))
    return materialize(packed.mapInArrow(dealt, f"chunk bigint, rest {packed.schema['rest'].dataType.simpleString()}, text string"), "chunks")


def asked(chunks: DataFrame, keys_of: KeysOf) -> DataFrame:
    """(chunk, key): the different keys of each chunk."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0

        def emit() -> Iterator[pa.RecordBatch]:
            each = np.unique(np.concatenate(held))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(each), now)), pa.array(each)], ["chunk", "key"])

        for b in batches:
            ids = b.column("chunk").to_numpy()
            for lo, hi, data, offsets in slices(b.column("text")):
                key, doc = keys_of(data, offsets)
                owner = ids[lo:hi][doc]
                # a chunk's texts stand together, in as many files' parts as read them
                for c in np.unique(ids[lo:hi]).tolist():
                    if held and (c != now or size > 1 << 22):
                        yield from emit()
                        held, size = [], 0
                    now = c
                    held.append(np.unique(key[owner == c]))
                    size += len(held[-1])
        if held:
            yield from emit()

    return materialize(chunks.select("chunk", "text").mapInArrow(listed, "chunk bigint, key bigint").distinct(), "wanted")


def model_values(wanted: DataFrame, counts: DataFrame, n_grams: int, values_of: Callable, part_grams: int = PART_GRAMS) -> DataFrame:
    """(chunk, key, value) of asked()'s rows; counts has class, gram and n (n_grams rows).

    values_of(keys, held, low) gives each key's value from {class: (grams, counts)}
    of its part and of orders 0 and 1.
    """
    parts = max(1, 2 * n_grams // max(part_grams, 1))
    low = counts.groupBy("class", F.col("gram").bitwiseAND(LOW).alias("gram")).agg(F.sum("n").alias("n")).toArrow()
    sent = wanted.sparkSession.sparkContext.broadcast(by_class(low))

    def valued(keys: pa.Table, held: pa.Table) -> pa.Table:
        key = keys.column("key").to_numpy()
        return pa.table({"key": key, "value": values_of(key, by_class(held), sent.value)})

    def part(gram: str):
        return F.pmod(F.xxhash64(F.shiftright(gram, 9).bitwiseAND(LOW)), F.lit(parts)).alias("part")

    keys = wanted.select("key").distinct().select(part("key"), "key").groupBy("part")
    values = keys.cogroup(counts.select(part("gram"), "class", "gram", "n").groupBy("part")).applyInArrow(valued, "key bigint, value double")
    return wanted.join(materialize(values, "key-values"), "key").select("chunk", "key", "value")


def added(chunks: DataFrame, values: DataFrame, sums_of: Callable, names: list[str], columns: list[str]) -> DataFrame:
    """chunked()'s rows as struct `row` of `columns`, with sums `names` (double) over each text.

    values: (chunk, kind, key, value).  sums_of(data, offsets, lookup) gives the sums'
    arrays for some texts; lookup(kind, keys) gives the keys' values.
    """

    def summed(texts: pa.Table, found: pa.Table) -> pa.Table:
        kind = found.column("kind").to_numpy()
        held = {}
        for k in np.unique(kind).tolist():
            key, value = (found.column(c).to_numpy()[kind == k] for c in ("key", "value"))
            order = np.argsort(key)
            held[k] = (key[order], value[order])

        def lookup(k: int, keys: np.ndarray) -> np.ndarray:
            return held[k][1][np.searchsorted(held[k][0], keys)]

        totals = np.zeros((len(names), texts.num_rows))
        for lo, hi, data, offsets in slices(texts.column("text")):
            for total, part in zip(totals, sums_of(data, offsets, lookup), strict=True):
                total[lo:hi] = part
        return pa.table([texts.column("rest"), texts.column("text"), *[pa.array(t) for t in totals]], ["rest", "text", *names])

    schema = f"rest {chunks.schema['rest'].dataType.simpleString()}, text string, " + ", ".join(f"{n} double" for n in names)
    done = chunks.groupBy("chunk").cogroup(values.groupBy("chunk")).applyInArrow(summed, schema)
    row = F.struct(*[F.col("text") if c == "text" else F.col("rest")[c].alias(c) for c in columns])
    return done.select(row.alias("row"), *names)


def by_class(counts: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    kind, gram, n = (counts.column(c).to_numpy() for c in ("class", "gram", "n"))
    return {c: (gram[kind == c], n[kind == c]) for c in (0, 1)}
