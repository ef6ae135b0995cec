"""Cutting lineage where a plan would be worked out again and again."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table of texts and what was found in them that may be broadcast.
SENT_WHOLE = 50_000

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; in local mode, where that is unset, one of this machine's."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, written as Parquet to the shared folder and read from there; removed when the process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/table-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once(df: DataFrame, column: str, work: Callable[[DataFrame], DataFrame], values: DataFrame | None = None) -> DataFrame:
    """``df`` with the columns that ``work`` adds to a table of ``column`` alone, worked out once for each different value (null too).

    ``values``: a table of ``column`` that has all of df's values and costs less to read.
    """
    source = df if values is None else values
    known = checkpointed(work(source.select(column).distinct())).withColumnRenamed(column, "_once")
    # a table of counted rows may go to every executor; a larger one is joined by key
    known = F.broadcast(known) if known.count() <= SENT_WHOLE else known
    return df.join(known, df[column].eqNullSafe(F.col("_once")), "left").drop("_once")


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
