"""Soundtracks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinelith.functions.codecs import ima, ima_stereo, westwood
from cinelith.functions.faults import ERROR, Fault
from cinelith.operators.container import Movie, in_blocks, parse

MOST_SAMPLES = 1 << 26
AUDIO = f"movie_id string, chunk_no int, samples array<smallint>, error {ERROR.simpleString()}"


def audio_chunks(movie: Movie) -> Iterator[np.ndarray]:
    """16-bit samples of each top-level sound chunk; IMA state runs on over chunks."""
    h = movie.header
    two = h.num_channels >= 2
    left = right = (0, 0)
    for c in movie.chunks():
        if c.id == "SND0":
            if h.bit_depth == 16:
                yield np.frombuffer(c.data[: len(c.data) // 2 * 2], "<i2")
            else:
                yield ((np.frombuffer(c.data, np.uint8).astype(np.int16) - 128) * 256).astype(np.int16)
        elif c.id == "SND1":
            mono = ((westwood(c.data).astype(np.int16) - 128) * 256).astype(np.int16)
            yield np.repeat(mono, 2) if two else mono
        elif c.id == "SND2" and two:
            samples, left, right = ima_stereo(c.data, h.version, left, right)
            yield samples
        elif c.id == "SND2":
            samples, *state = ima(c.data, *left)
            left = tuple(state)
            yield samples


def soundtrack(movie: Movie, most: int = MOST_SAMPLES) -> np.ndarray:
    parts, size = [], 0
    for samples in audio_chunks(movie):
        parts.append(samples)
        size += len(samples)
        if size > most:
            raise Fault("TooLarge", "Soundtrack")
    return np.concatenate(parts) if parts else np.zeros(0, np.int16)


def audio_rows(files: DataFrame) -> DataFrame:
    """Samples of each sound chunk of all movies; a fault is a row after the good ones."""

    def rows_of(path: str, content: bytes) -> Iterator[tuple]:
        n = 0
        try:
            for samples in audio_chunks(parse(content)):
                yield (path, n, samples, None)
                n += 1
        except Fault as f:
            yield (path, n, None, f.row())

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each = (rows_of(*file) for batch in batches for file in zip(batch["path"], batch["content"], strict=True))
        yield from in_blocks(chain.from_iterable(each), ["movie_id", "chunk_no", "samples", "error"])

    return files.select("path", "content").mapInPandas(decoded, AUDIO)


def soundtracks(audio: DataFrame, most: int = MOST_SAMPLES) -> DataFrame:
    """movie_id, samples, error: whole soundtracks from audio_rows (F1).

    One pass over the sound: a chunk that ends beyond `most` samples goes on
    without them, so what is gathered stays below most plus one chunk.
    """
    size = F.coalesce(F.size("samples"), F.lit(0)).cast("bigint")
    before = Window.partitionBy("movie_id").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    timed = audio.withColumn("so_far", F.coalesce(F.sum(size).over(before), F.lit(0).cast("bigint")))
    kept = F.struct("chunk_no", F.when(F.col("so_far") <= most, F.col("samples")).alias("samples"))
    whole = timed.groupBy("movie_id").agg(
        F.max(F.col("so_far") + size).alias("n"), F.first("error", ignorenulls=True).alias("error"), F.array_sort(F.collect_list(kept)).alias("parts")
    )
    too_large = F.struct(F.lit("TooLarge").alias("kind"), F.lit("Soundtrack").alias("cause"))
    error = F.when(F.col("n") > most, too_large).otherwise(F.when(F.col("error").isNotNull(), F.struct("error.kind", "error.cause")))
    samples = F.flatten(F.transform("parts", lambda x: x["samples"]))
    return whole.select("movie_id", error.alias("error"), samples.alias("samples")).select("movie_id", F.when(F.col("error").isNull(), F.col("samples")).alias("samples"), "error")


def frame_at(seconds, frame_rate):
    """The frame shown at a time."""
    return F.floor(seconds * F.greatest(frame_rate, F.lit(1))).cast("int")


def resampled(samples: DataFrame, source: int, target: int) -> DataFrame:
    """movie_id, sample_no, left, right at another rate, linear, cut toward zero.

    Every sample yields the places that fall between it and its successor, so
    no join is needed; sample_no counts from 0 without gaps.
    """
    order = Window.partitionBy("movie_id").orderBy("sample_no")
    near = samples.withColumns(
        {
            "next_left": F.lead("left").over(order), "next_right": F.lead("right").over(order),
            "n": F.count("*").over(Window.partitionBy("movie_id")),
        }
    )
    low = F.expr(f"(sample_no * {target} + {source - 1}) div {source}")
    high = F.expr(f"least(((sample_no + 1) * {target} + {source - 1}) div {source}, n * {target} div {source}) - 1")
    places = F.when(low <= high, F.sequence(low, high))
    out = near.withColumn("at", F.explode(places))
    part = F.col("at") * F.lit(float(source)) / F.lit(float(target)) - F.col("sample_no")

    def between(a: str, b: str):
        return (F.col(a) + (F.coalesce(b, a) - F.col(a)) * part).cast("bigint").alias(a)

    return out.select("movie_id", F.col("at").alias("sample_no"), between("left", "next_left"), between("right", "next_right"))
