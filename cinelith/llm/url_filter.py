"""URL filters: rules, and a character language-model ratio where no rule fits.

Two variable-order Markov models over bytes, one learnt from URLs that rules
allow and one from those that rules block, interpolate orders 0 to ORDER with
Witten-Bell smoothing.  A URL's score is the difference of its two
log-likelihoods divided by its length; the threshold is calibrated on rule-judged
URLs that neither model has seen (least sum of the two error rates).

Scale: n-gram counts leave each task already summed and are summed again by
hash.  Models of at most MAX_GRAMS n-grams a class are broadcast, and scoring is
one pass without a shuffle, so repeated URLs are no hot key.  Larger ones are
dealt out by gram_values; no count is left out, and both give equal results.
Calibration sees a histogram of BINS bins.

Defined cases: models learn and score whole URLs, scheme, query and fragment
included; a null URL or one without :// has an empty host and path and fits no rule (a null or empty one scores 0, which is
allowed only if the threshold is not above 0); rows that repeat are judged each;
with only one class to learn from every score is 0 and the threshold 0; columns
besides page_id and url are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinelith.llm import gram_values
from cinelith.llm.shared import ascii_lower, materialize
from cinelith.llm.text import slices

#: Fixed values: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
ORDER = 4
MAX_GRAMS = 1 << 20
CALIBRATION = 5
BINS = 2048
REACH = 4.0  # scores outside -REACH..REACH fall into the outer bins
END = 256


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.contains(url, F.lit("://")), F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def ruled(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, url, host, path, rule and by_rule (the rule's verdict), null where none fits.

    The longest host and path together wins; of equals, the first listed.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in reversed(sorted(rules, key=lambda r: -len(r[0] + r[1]))):
        fits = ((F.col("host") == h) | F.endswith("host", F.lit("." + h))) & F.startswith("path", F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rows.withColumns({"rule": rule, "by_rule": verdict})


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """(bytes and ends, order + 1) as one 64-bit key a place: the symbol and its context.

    9 bits a symbol, nearest context first; END stands before a text and closes it.
    """
    n = len(offsets) - 1
    symbols = np.full(len(data) + n, END, np.int64)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    symbols[np.arange(len(data)) + doc] = data
    begins = offsets[:-1] + np.arange(n)
    since = np.arange(len(symbols)) - np.repeat(begins, np.diff(offsets) + 1)
    key = symbols.copy()
    for k in range(1, order + 1):
        back = np.full(len(symbols), END, np.int64)
        back[k:] = symbols[:-k]
        back[since < k] = END
        key |= back << 9 * k
    return key


class Markov:
    """Interpolated orders 0..order from distinct top-order keys and their counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int, low: tuple[np.ndarray, np.ndarray] | None = None):
        """low has the keys and counts of order 1 where keys is a part of the grams."""
        self.order, self.levels = order, []
        for k in range(order + 1):
            mine, n = low if k < 2 and low is not None else (keys, counts)
            kept = mine & ((1 << 9 * (k + 1)) - 1)
            at, where = np.unique(kept, return_inverse=True)
            count = np.bincount(where, n, len(at))
            contexts, owner = np.unique(at >> 9, return_inverse=True)
            self.levels.append((at, count, contexts, np.bincount(owner, count, len(contexts)), np.bincount(owner, minlength=len(contexts))))

    def log_probability(self, key: np.ndarray) -> np.ndarray:
        p = np.full(len(key), 1 / 257)
        for k, (at, count, contexts, total, kinds) in enumerate(self.levels):
            if not len(at):
                continue
            kept = key & ((1 << 9 * (k + 1)) - 1)
            i = np.minimum(np.searchsorted(at, kept), len(at) - 1)
            c = np.where(at[i] == kept, count[i], 0)
            j = np.minimum(np.searchsorted(contexts, kept >> 9), len(contexts) - 1)
            known = contexts[j] == kept >> 9
            n, d = np.where(known, total[j], 0), np.where(known, kinds[j], 1)
            p = np.where(known, (c + d * p) / (n + d), p)
        return np.log(p)


def count_grams(labelled: DataFrame, order: int) -> DataFrame:
    """(class, gram, n) from columns class and text."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind = b.column("class").to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in slices(b.column("text")):
                key = grams(data, offsets, order)
                owner = np.repeat(kind[lo:hi], np.diff(offsets) + 1)
                for c in np.unique(owner):
                    at, n = np.unique(key[owner == c], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c, np.int32)), pa.array(at), pa.array(n)], ["class", "gram", "n"])

    return labelled.select("class", "text").mapInArrow(counted, "class int, gram bigint, n bigint").groupBy("class", "gram").agg(F.sum("n").alias("n"))


def fit(rows: DataFrame, order: int = ORDER, max_grams: int = MAX_GRAMS) -> tuple[dict | tuple[DataFrame, int, int], float]:
    """(models, threshold) from columns text, class (1, 0 or null).

    models is {1: accepted, 0: rejected} as (keys, counts), or (counts, their
    rows, max_grams) where a class has more than max_grams n-grams.
    """
    known = rows.where("class IS NOT NULL")
    split = F.pmod(F.xxhash64("text"), F.lit(CALIBRATION))
    counts = materialize(count_grams(known.where(split != 0), order), "url-grams")
    sizes = {r["class"]: r["rows"] for r in counts.groupBy("class").agg(F.count("*").alias("rows")).collect()}
    if len(sizes) < 2:
        return {c: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for c in (1, 0)}, 0.0
    models = gram_values.by_class(counts.toArrow()) if max(sizes.values()) <= max_grams else (counts, sum(sizes.values()), max_grams)
    held = score(known.where(split == 0).select("class", "text"), models, order)
    at = F.floor((F.least(F.greatest("score", F.lit(-REACH)), F.lit(REACH)) + REACH) / (2 * REACH) * (BINS - 1)).cast("int")
    table = np.zeros((2, BINS))
    for r in held.groupBy(F.col("row.class").alias("c"), at.alias("bin")).agg(F.count("*").alias("n")).collect():
        table[r.c, r.bin] += r.n
    share = table / np.maximum(table.sum(1, keepdims=True), 1)
    below, above = np.append(0, np.cumsum(share[1])), share[0].sum() - np.append(0, np.cumsum(share[0]))
    best = np.flatnonzero(below + above == (below + above).min())
    return models, float(best[len(best) // 2] / (BINS - 1) * 2 * REACH - REACH) if table.sum(1).all() else 0.0


def score_by_join(rows: DataFrame, counts: DataFrame, n_grams: int, max_grams: int, order: int = ORDER) -> DataFrame:
    """As score, for models of any size."""

    def values(key: np.ndarray, held: dict, low: dict) -> np.ndarray:
        good, bad = (Markov(*held[c], order, low[c]) for c in (1, 0))
        return good.log_probability(key) - bad.log_probability(key)

    def keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return grams(data, offsets, order), np.repeat(np.arange(len(offsets) - 1), np.diff(offsets) + 1)

    def sums(data: np.ndarray, offsets: np.ndarray, lookup) -> list[np.ndarray]:
        ends = np.diff(offsets) + 1
        return [np.add.reduceat(lookup(0, keys(data, offsets)[0]), np.cumsum(ends) - ends)]

    chunks = gram_values.chunked(rows)
    found = gram_values.model_values(gram_values.asked(chunks, keys), counts, n_grams, values, max_grams)
    done = gram_values.added(chunks, found.withColumn("kind", F.lit(0)), sums, ["total"], rows.columns)
    size = F.coalesce(F.octet_length("row.text"), F.lit(0))
    return done.select("row", F.when(size > 0, F.col("total") / (size + 1)).otherwise(0.0).alias("score"))


def score(rows: DataFrame, models: dict | tuple[DataFrame, int, int], order: int = ORDER) -> DataFrame:
    """rows (with a column text) as struct `row`, with the length-normalised difference."""
    if isinstance(models, tuple):
        return score_by_join(rows, *models, order)
    sent = rows.sparkSession.sparkContext.broadcast(models)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = (Markov(*sent.value[c], order) if len(sent.value[c][0]) else None for c in (1, 0))
        for b in batches:
            out = np.zeros(b.num_rows)
            for lo, hi, data, offsets in slices(b.column("text")):
                if good is None or bad is None or not len(data):
                    continue
                key = grams(data, offsets, order)
                size = np.diff(offsets) + 1
                each = good.log_probability(key) - bad.log_probability(key)
                out[lo:hi] = np.where(size > 1, np.add.reduceat(each, np.cumsum(size) - size) / size, 0.0)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(out)], ["row", "score"])

    packed = rows.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    return packed.mapInArrow(scored, f"row {rows.schema.simpleString()}, score double")


def judge(pages: DataFrame, rules: tuple = RULES, max_grams: int = MAX_GRAMS) -> DataFrame:
    """page_id, url, host, path, rule, score and verdict of every row."""
    rows = ruled(pages, rules)
    text = rows.withColumn("text", F.coalesce("url", F.lit("")))
    models, threshold = fit(text.select("text", F.when(F.col("by_rule").isNotNull(), (F.col("by_rule") == "allow").cast("int")).alias("class")), max_grams=max_grams)
    done = score(text, models).select("row.*", "score")
    verdict = F.coalesce("by_rule", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return done.select("page_id", "url", "host", "path", "rule", "score", verdict.alias("verdict"))


def digest(pages: DataFrame) -> DataFrame:
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "score")
