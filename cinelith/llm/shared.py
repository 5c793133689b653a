"""Session plumbing every operator here shares: where intermediate tables live,
how a row is identified, and how text columns reach numpy.

Nothing in this module depends on the size of the input.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where that is unset a temporary folder is made, in local sessions (tests)
    only: on a cluster each executor would write to its own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="cinelith-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Spark then removes a job's shuffle files as it ends, instead of when the driver's garbage is collected.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back.

    Cuts the lineage: a lost executor costs a re-read, never a recomputation.
    Jobs' shuffle files go as they end (set once for the session, so queries that
    share it do not undo each other's setting), the written ones at the end of
    scratch() or when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    spark.conf.set(_CLEANUP, "true")
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch() -> Iterator[None]:
    """Removes what was written inside it as it ends, but for the last table, the result."""
    start = len(_written)
    yield
    for spark, path in _written[start:-1]:
        _remove(spark, path)
    del _written[start:-1]


def _remove(spark: SparkSession, path: str) -> None:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


@atexit.register
def _remove_written() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the session may be gone already
            return


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_keys() -> list[Column]:
    """Two 64-bit hashes of (doc_id, text): equal rows share them, others don't."""
    doc, text = F.col("doc_id"), F.col("text")
    return [F.xxhash64(doc, text).alias("rk1"), F.xxhash64(F.lit(7), text, doc).alias("rk2")]


def id_bucket(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))
