"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of characters outside space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; in local mode, where it is unset, one of this machine's."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table written by :func:`stage`."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Whether Spark deletes an execution's shuffle files when it ends.
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANED, None)
    spark.conf.set(_CLEANED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANED)
        else:
            spark.conf.set(_CLEANED, before)


class Stage:
    """Tables written to the shared folder to cut lineage: readable by all, and still there when an executor is lost.

    Tables kept for a lazily evaluated result are removed when the process
    ends; the others by :meth:`drop` as soon as nothing reads them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.top = spark, f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: dict[int, str] = {}
        _written.append((spark, self.top))

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.top}/{self.n}"
        # once the table is there, nothing reads the shuffles that made it
        with _shuffles_cleaned(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._tidemark_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            forget(self.spark, t._tidemark_path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):
            forget(spark, path)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def uniform(*columns: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the values and the seed only."""
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 11).cast("double") / float(1 << 53)


def lean(run):
    """A function over Arrow batches that gives unused memory back to the system when it ends: its process waits for further tasks beside the executor."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow

            pyarrow.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies, on whichever machine asks."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
