"""LM scoring: prediction by partial matching, and a unigram baseline.

The model is a trie of byte contexts up to ORDER long with method C escapes: in
a context seen n times with d different successors, a successor seen c times has
probability c / (n + d) and the escape to the next shorter context d / (n + d).
After an escape the successors of the longer context are excluded from the
shorter one.  A text is its UTF-8 bytes and one END; END also pads its start.
The last resort is uniform over the symbols no context has shown.  A document's
score is the log10 probability, that is minus its code length, pretrained on
the training rows (crc32(doc_id as text) mod 10 is not 0).

Since the successors of a context are a subset of those of its suffix, what is
excluded depends on the longer context alone, so a part of the trie computes its
tables once for all keys it is asked for.

Scale: counts of all training texts leave each task summed, and are summed again
by hash; no count is left out.  While there are at most MAX_WORDS different words
and MAX_GRAMS grams both are broadcast (16 MB of grams, 50 MB of words), and scoring
is one pass without a shuffle.  Beyond that nothing that grows passes through the
driver: texts are gathered in chunks, each chunk asks once for each of its
different words and grams, words are joined to their counts, grams to the part of
the trie that holds their contexts, and the values are summed in the chunk
(gram_values).  Both give equal results.

Defined cases: null or empty text is the END alone; a null doc_id counts as the
empty text for the split; without training rows every count is 0 and the trie is
uniform over 257 symbols (base_score is then the sum over log10(0.1 / 0.1), that
is 0); rows that repeat are scored each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelith.llm import gram_values
from cinelith.llm.shared import id_bucket, materialize
from cinelith.llm.text import slices, words
from cinelith.llm.url_filter import grams

ORDER = 4
MAX_GRAMS = 1 << 20
MAX_WORDS = 1 << 22
END_WORD = -1  # stands for the end token among word hashes
_HOLD = 4_000_000


class Ppm:
    """The trie's tables, from distinct (context, symbol) keys of the top order and counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int = ORDER, low: tuple[np.ndarray, np.ndarray] | None = None):
        """low has the keys and counts of order 1 where keys is a part of the grams."""
        self.levels = []
        finer = None
        for k in range(order, -1, -1):
            if k == 1 and low is not None:
                keys, counts = low
            kept = keys & ((1 << 9 * (k + 1)) - 1)
            gram, where = np.unique(kept, return_inverse=True)
            count = np.bincount(where, counts, len(gram))
            context, owner = np.unique(gram >> 9, return_inverse=True)
            n, d = np.bincount(owner, count, len(context)), np.bincount(owner, minlength=len(context)).astype(float)
            if finer is not None:
                # what is left of this level for each longer context, once its successors are excluded
                up_gram, up_context, up_owner, up_d = finer
                short = up_gram & ((1 << 9 * (k + 1)) - 1)
                seen = np.bincount(up_owner, count[np.searchsorted(gram, short)], len(up_context))
                at = np.searchsorted(context, up_context & ((1 << 9 * k) - 1))
                self.levels[-1]["left_n"], self.levels[-1]["left_d"] = n[at] - seen, d[at] - up_d
            self.levels.append({"gram": gram, "count": count, "context": context, "n": n, "d": d, "left_n": None, "left_d": None})
            finer = (gram, context, owner, d)
        self.unseen = 257 - (self.levels[-1]["d"][0] if len(keys) else 0)

    def log10(self, key: np.ndarray) -> np.ndarray:
        """log10 probability of each key's symbol after its context."""
        total = np.zeros(len(key))
        n, d = np.full(len(key), np.nan), np.full(len(key), np.nan)
        todo = np.arange(len(key))
        for below, level in enumerate(self.levels):
            k = len(self.levels) - 1 - below
            if not len(todo):
                break
            if not len(level["context"]):
                continue
            mine = key[todo] & ((1 << 9 * (k + 1)) - 1)
            at = np.minimum(np.searchsorted(level["context"], mine >> 9), len(level["context"]) - 1)
            known = level["context"][at] == mine >> 9
            fresh = known & np.isnan(n[todo])
            n[todo[fresh]], d[todo[fresh]] = level["n"][at[fresh]], level["d"][at[fresh]]
            who = todo[known]
            mass = n[who] + d[who]
            slot = np.minimum(np.searchsorted(level["gram"], mine[known]), len(level["gram"]) - 1)
            hit = level["gram"][slot] == mine[known]
            total[who[hit]] += np.log10(level["count"][slot[hit]] / mass[hit])
            miss = who[~hit & (mass > 0)]
            total[miss] += np.log10(d[miss] / (n[miss] + d[miss]))
            if level["left_n"] is not None:
                n[who], d[who] = level["left_n"][at[known]], level["left_d"][at[known]]
            done = np.zeros(len(key), bool)
            done[who[hit]] = True
            todo = todo[~done[todo]]
        total[todo] -= np.log10(max(self.unseen, 1))
        return total


def _summed(texts: DataFrame, keys_of, schema: str) -> DataFrame:
    """(key, n) over all texts, summed in each task and again by hash."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merge() -> None:
            at, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            held[:] = [(at, np.bincount(where, np.concatenate([n for _, n in held]), len(at)))]

        def emit() -> Iterator[pa.RecordBatch]:
            if held:
                merge()
                (at, n), held[:] = held[0], []
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.astype(np.int64))], ["key", "n"])

        for b in batches:
            for _, _, data, offsets in slices(b.column("text")):
                held.append(np.unique(keys_of(data, offsets), return_counts=True))
            if sum(len(k) for k, _ in held) > _HOLD:
                merge()
                if len(held[0][0]) > _HOLD:  # the task's memory stays bounded
                    yield from emit()
        yield from emit()

    return texts.select("text").mapInArrow(counted, schema).groupBy("key").agg(F.sum("n").alias("n"))


def token_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every word, then of the end of each text."""
    h, _, doc = words(data, offsets)
    n = len(offsets) - 1
    return np.append(h.view(np.int64), np.full(n, END_WORD)), np.append(doc, np.arange(n))


def gram_keys(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(gram, text) of every byte and end, by text."""
    return grams(data, offsets, order), np.repeat(np.arange(len(offsets) - 1), np.diff(offsets) + 1)


def fit_ppm(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, n) of every gram."""
    return materialize(_summed(texts, lambda d, o: grams(d, o, order), "key bigint, n bigint"), "grams")


def fit_words(texts: DataFrame) -> tuple[DataFrame, int, int]:
    """((key, n) of every training token, N, V)."""
    counts = materialize(_summed(texts, lambda d, o: token_keys(d, o)[0], "key bigint, n bigint"), "tokens")
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    return counts, total.n or 0, total.v


def by_broadcast(docs: DataFrame, counts: DataFrame, trie: DataFrame, smooth: float, mass: float, order: int) -> DataFrame:
    """docs as struct `row`, n_tokens, n_known, base_score and score, in one pass."""
    found, grams_found = counts.toArrow().sort_by("key"), trie.toArrow()
    model = Ppm(grams_found.column("key").to_numpy(), grams_found.column("n").to_numpy().astype(float), order)
    sent = docs.sparkSession.sparkContext.broadcast((found.column("key").to_numpy(), found.column("n").to_numpy().astype(np.int32 if mass < 2**31 else np.int64), model))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, model = sent.value
        for b in batches:
            out = np.zeros((4, b.num_rows))
            for lo, hi, data, offsets in slices(b.column("text")):
                key, doc = token_keys(data, offsets)
                each, where = np.unique(key, return_inverse=True)
                at = np.minimum(np.searchsorted(known, each), max(len(known) - 1, 0))
                c = np.where(known[at] == each, n[at], 0)[where] if len(known) else np.zeros(len(key))
                each, where = np.unique(grams(data, offsets, order), return_inverse=True)
                ends = np.diff(offsets) + 1
                out[:3, lo:hi] = [np.bincount(doc, minlength=hi - lo), np.bincount(doc, c > 0, hi - lo), np.bincount(doc, np.log10((c + smooth) / mass), hi - lo)]
                out[3, lo:hi] = np.add.reduceat(model.log10(each)[where], np.cumsum(ends) - ends)
            yield pa.RecordBatch.from_arrays([b.column("row"), *map(pa.array, out)], ["row", "n_tokens", "n_known", "base_score", "score"])

    packed = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    return packed.mapInArrow(scored, f"row {docs.schema.simpleString()}, n_tokens double, n_known double, base_score double, score double")


def by_join(docs: DataFrame, counts: DataFrame, trie: DataFrame, smooth: float, mass: float, order: int, n_grams: int, chunk: int, part_grams: int) -> DataFrame:
    """As by_broadcast, for any number of words and grams."""

    def log_values(key: np.ndarray, held: dict, low: dict) -> np.ndarray:
        return Ppm(held[0][0], held[0][1].astype(float), order, (low[0][0], low[0][1].astype(float))).log10(key)

    def sums(data: np.ndarray, offsets: np.ndarray, lookup) -> list[np.ndarray]:
        size = len(offsets) - 1
        key, doc = token_keys(data, offsets)
        c = lookup(0, key)
        key, _ = gram_keys(data, offsets, order)
        ends = np.diff(offsets) + 1
        return [
            np.bincount(doc, minlength=size), np.bincount(doc, c > 0, size), np.bincount(doc, np.log10((c + smooth) / mass), size),
            np.add.reduceat(lookup(1, key), np.cumsum(ends) - ends),
        ]

    chunks = gram_values.chunked(docs, chunk)
    known = gram_values.asked(chunks, token_keys).join(counts, "key", "left").select("chunk", F.lit(0).alias("kind"), "key", F.coalesce("n", F.lit(0)).cast("double").alias("value"))
    classed = trie.select(F.lit(0).alias("class"), F.col("key").alias("gram"), "n")
    drawn = gram_values.model_values(gram_values.asked(chunks, lambda d, o: gram_keys(d, o, order)), classed, n_grams, log_values, part_grams)
    values = known.unionByName(drawn.select("chunk", F.lit(1).alias("kind"), "key", "value"))
    return gram_values.added(chunks, values, sums, ["n_tokens", "n_known", "base_score", "score"], docs.columns)


def score(
    docs: DataFrame, smooth: float = 0.1, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS, chunk: int = gram_values.CHUNK, part_grams: int = gram_values.PART_GRAMS, order: int = ORDER
) -> DataFrame:
    """docs as struct `row`, n_tokens, n_known, train_tokens, base_score and score."""
    train = docs.where(id_bucket(10) != 0).select(F.col("text").cast("string").alias("text"))
    trie = fit_ppm(train, order)
    counts, n, v = fit_words(train)
    mass, n_grams = n + smooth * (v + 1), trie.count()
    if v <= max_words and n_grams <= max_grams:
        done = by_broadcast(docs, counts, trie, smooth, mass, order)
    else:
        done = by_join(docs, counts, trie, smooth, mass, order, n_grams, chunk, part_grams)
    whole = [F.col(c).cast("bigint").alias(c) for c in ("n_tokens", "n_known")]
    return done.select("row", *whole, F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score")


def digest(docs: DataFrame) -> DataFrame:
    done = score(docs.select("doc_id", "text"))
    return done.select("row.doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score").withColumn("held_out", id_bucket(10) == 0)
