"""Movies as they arrive: chunks, frames and sound over Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cinelith.operators.container import chunks


def arriving(spark: SparkSession, path: str, pattern: str = "*.vqa", per_trigger: int = 64) -> DataFrame:
    """path and content of files as they appear, a bounded number a batch."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern)
    return reader.option("maxFilesPerTrigger", per_trigger).load(path).select("path", "content")


def relation_stream(files: DataFrame, relation: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Appends a relation of arriving files to Parquet, exactly once, and stops when none is left.

    relation takes (path, content) and works file by file: container.chunks,
    video.frame_rows, video.checkpoints or audio.audio_rows.
    """
    writer = relation(files).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def chunk_stream(files: DataFrame, out: str, checkpoint: str, with_payload: bool = False) -> StreamingQuery:
    return relation_stream(files, lambda f: chunks(f, with_payload), out, checkpoint)
