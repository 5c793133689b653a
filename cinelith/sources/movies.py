"""Movie files in, PPM frames and expanded movies out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelith.functions.codecs import lcw
from cinelith.functions.faults import ERROR, Fault
from cinelith.operators.container import BODY, CONTAINERS, Chunk, parse, walk
from cinelith.operators.video import Frame

#: Compressed chunk -> what it is called once expanded.
EXPANDED = {"CBFZ": "CBF0", "CPLZ": "CPL0", "VPTZ": "VPT0", "VPTK": "VPT0", "VPTD": "VPT0", "VPRZ": "VPTR"}


def movie_files(spark: SparkSession, path: str, pattern: str = "*.vqa") -> DataFrame:
    """path and content of each file; nothing else of it is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def chunk_bytes(name: str, data: bytes) -> bytes:
    return name.encode() + len(data).to_bytes(4, "big") + data + b"\0" * (len(data) % 2)


def expand(content: bytes, most: int = 1 << 24) -> bytes:
    """The movie with its LCW chunks decompressed; joined CBPZ parts stay as they are."""
    parse(content)

    def rewrite(c: Chunk) -> bytes:
        try:
            if c.id in (*CONTAINERS, "VQFL"):
                return chunk_bytes(c.id, b"".join(map(rewrite, walk(c.data, c.offset + 8, True))))
            return chunk_bytes(EXPANDED[c.id], lcw(c.data, most)) if c.id in EXPANDED else chunk_bytes(c.id, c.data)
        except Fault as f:
            raise f.place(c.id, c.offset) from None

    body = content[8:BODY] + b"".join(map(rewrite, walk(content[BODY:], BODY)))
    return b"FORM" + len(body).to_bytes(4, "big") + body


def expanded(files: DataFrame) -> DataFrame:
    """path, rewritten content and error of each movie; content is null where there is an error."""

    def rewritten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    row = (path, expand(content), None)
                except Fault as f:
                    row = (path, None, f.row())
                yield pd.DataFrame([row], columns=["path", "content", "error"])

    return files.select("path", "content").mapInPandas(rewritten, f"path string, content binary, error {ERROR.simpleString()}")


def ppm(frame: Frame) -> bytes:
    return f"P6\n{frame.width} {frame.height}\n255\n".encode() + frame.rgb().tobytes()


def ppm_rows(frame_rows: DataFrame, every: int = 1) -> DataFrame:
    """movie_id, frame_no, ppm of every n-th good frame; write it with any Spark sink."""

    @F.pandas_udf("binary")
    def image(width: pd.Series, height: pd.Series, kind: pd.Series, pixels: pd.Series, palette: pd.Series) -> pd.Series:
        out = []
        for w, h, k, p, c in zip(width, height, kind, pixels, palette, strict=True):
            raster = np.frombuffer(p, np.uint8 if k == "indexed" else "<u2").reshape(h, w)
            out.append(ppm(Frame(w, h, raster, np.frombuffer(c, np.uint8).reshape(-1, 3) if k == "indexed" else None)))
        return pd.Series(out)

    good = frame_rows.where(F.col("error").isNull() & (F.col("frame_no") % every == 0))
    return good.select("movie_id", "frame_no", image("width", "height", "format", "pixels", "palette").alias("ppm"))


def dump_frames(frame_rows: DataFrame, folder: str, every: int = 1) -> DataFrame:
    """Writes every n-th good frame to folder/<movie's file name>/frame_0000.ppm; movie_id, frame_no, file of each.

    folder is a path or URI that executors share and pyarrow's file systems open.
    The files are written as the result is read; one written twice is the same.
    """
    where = folder if "://" in folder else "file://" + folder

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(where)
        for b in batches:
            files = []
            for movie, number, image in zip(*(b.column(c).to_pylist() for c in ("movie_id", "frame_no", "ppm")), strict=True):
                place = f"{top}/{movie.rsplit('/', 1)[-1]}"
                store.create_dir(place, recursive=True)
                files.append(f"{place}/frame_{number:04d}.ppm")
                with store.open_output_stream(files[-1]) as out:
                    out.write(image)
            yield pa.RecordBatch.from_arrays([b.column("movie_id"), b.column("frame_no"), pa.array(files, pa.string())], ["movie_id", "frame_no", "file"])

    return ppm_rows(frame_rows, every).mapInArrow(written, "movie_id string, frame_no int, file string")
