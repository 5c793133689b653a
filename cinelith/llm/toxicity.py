"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes, in 2**BITS slots, of its words,
word pairs and pairs that skip one word, after lower-casing A-Z and turning
ASCII punctuation into blanks.  Values are binary.  FTRL-proximal keeps a
learning rate per coordinate and, by its L1 term, all but some hundreds of
weights at zero; those are broadcast as (slot, weight) pairs, 2**BITS at most.
A toxic row counts as POSITIVE rows, as toxic rows are the rarer ones.

Fit: on at most MAX_TRAIN labelled documents (a documented bound), those of the
least hash of doc_id among those whose crc32(doc_id as text) mod 5 is not 0, and of
them, in that order, as many as have MAX_TRAIN_BYTES of features together (two at
least).  Only these features reach the driver, so what it holds is bounded.  The order
of the rows is that of a hash too, so the fit is the same for any partitioning.
Labels that contradict each other for one doc_id count as toxic; of rows that
repeat a doc_id the one whose text has the least hash is learnt from.

Scoring runs over every whole text, batch by batch, without a shuffle.

Defined cases: null or empty text has no features and scores the bias alone; a
null doc_id is never learnt from; rows that repeat are scored each; columns
besides doc_id and text are not read; without labels of both kinds no document
is rejected (score 0).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelith.llm.shared import id_bucket, materialize, whole_text
from cinelith.llm.text import PLAIN, mix, slices, words

BITS = 22
MAX_TRAIN = 8000
MAX_TRAIN_BYTES = 128 << 20
PASSES = 3
POSITIVE = 5.0
_PAIR, _SKIP = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def features(data: np.ndarray, offsets: np.ndarray, of_use: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(slot, document) pairs, distinct, by document; only slots marked in of_use, if given."""
    h, _, doc = words(data, offsets, PLAIN)
    keys = []
    for gap, salt in ((0, None), (1, _PAIR), (2, _SKIP)):
        if len(h) <= gap:
            continue
        slot = (h if not gap else mix(h[:-gap] * salt + h[gap:])) >> np.uint64(64 - BITS)
        keep = of_use[slot] if of_use is not None else np.ones(len(slot), bool)
        if gap:
            keep &= doc[gap:] == doc[:-gap]
        keys.append((doc[gap:][keep] << BITS) | slot[keep].astype(np.int64))
    key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return key & ((1 << BITS) - 1), key >> BITS


class Ftrl:
    """FTRL-proximal with per-coordinate rates; weight 2**BITS is the bias."""

    def __init__(self, alpha: float = 2.0, beta: float = 1.0, l1: float = 12.0, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        dense = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, dense)

    def learn(self, slots: np.ndarray, label: int, importance: float) -> None:
        at = np.append(slots, 1 << BITS)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = (p - label) * importance
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(doc_id, toxic, text, at) of max_rows documents at most; at orders them."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # max_rows rows of two numbers at most: the size of this broadcast is bounded
    known = known.where(id_bucket(5) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(known), "doc_id")
    one = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    return rows.groupBy("doc_id", "toxic").agg(one).withColumn("at", F.xxhash64("doc_id"))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN, passes: int = PASSES) -> np.ndarray:
    """The weights, bias last.  Needs doc_id, text of docs and doc_id, toxic of labels."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for lo, hi, data, offsets in slices(b.column("text")):
                slot, doc = features(data, offsets)
                cuts = np.searchsorted(doc, np.arange(hi - lo + 1))
                out += [slot[cuts[i] : cuts[i + 1]].astype(np.int32).tobytes() for i in range(hi - lo)]
            columns = [b.column("at"), b.column("toxic").cast(pa.int32()), pa.array([len(x) for x in out], pa.int64()), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["at", "toxic", "size", "slots"])

    rows = training_rows(docs, labels, max_rows).select("at", "toxic", "text")
    rows = materialize(rows.mapInArrow(extract, "at bigint, toxic int, size bigint, slots binary"), "training")
    so_far = 0
    for n, (last, size) in enumerate(sorted(zip(*rows.select("at", "size").toArrow().to_pydict().values(), strict=True))):
        so_far += size
        if n > 1 and so_far > MAX_TRAIN_BYTES:
            rows = rows.where(F.col("at") < last)
            break
    rows = rows.select("at", "toxic", "slots").toArrow().sort_by("at")
    label = np.array(rows.column("toxic")) > 0
    slots = [np.frombuffer(x, np.int32) for x in rows.column("slots").to_pylist()]
    # the L1 term is set for MAX_TRAIN rows; gradients add up over rows, so fewer rows take less of it
    model = Ftrl(l1=12.0 * min(1.0, len(label) / MAX_TRAIN) ** 0.25)
    if not label.any() or label.all():
        return np.append(np.zeros(1 << BITS), -np.inf)
    for _ in range(passes):
        for x, y in zip(slots, label, strict=True):
            model.learn(x, int(y), POSITIVE if y else 1.0)
    return model.weights(slice(None))


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs (all columns) as struct `row`, with score."""
    at = np.flatnonzero(weights[:-1]).astype(np.int32)
    sent = docs.sparkSession.sparkContext.broadcast((at, weights[at], float(weights[-1])))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, bias = sent.value
        w = np.zeros(1 << BITS, np.float32)
        w[at] = values
        of_use = w != 0
        for b in batches:
            total = np.full(b.num_rows, bias)
            for lo, hi, data, offsets in slices(b.column("text")):
                slot, doc = features(data, offsets, of_use)
                total[lo:hi] += np.bincount(doc, w[slot], hi - lo)
            p = 1 / (1 + np.exp(-np.clip(total, -700, 700)))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(np.where(np.isneginf(total), 0.0, p))], ["row", "score"])

    packed = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    return packed.mapInArrow(scored, f"row {docs.schema.simpleString()}, score double")


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_rows: int = MAX_TRAIN) -> DataFrame:
    """The rows of docs that score below threshold, columns unchanged."""
    return score(docs, fit(docs, labels, max_rows)).where(F.col("score") < threshold).select("row.*")


def digest(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN) -> DataFrame:
    slim = docs.select("doc_id", "text")
    done = score(slim, fit(slim, labels, max_rows))
    return done.select("row.doc_id", "score").select(
        "doc_id", (id_bucket(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
