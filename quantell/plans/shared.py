"""Tables written to the cluster's shared folder, to cut lineage or to read a result more than once.

A written table survives the loss of any executor, and unlike ``checkpoint()`` its plan runs only once.
"""

from __future__ import annotations

import atexit
import getpass
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Shuffled files of a table are of no use once it is written; else they stay on disk until the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode, where it is unset, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), f"quantell-{getpass.getuser()}")


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` once, free its shuffled files, and return the table read back, with the same schema."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quantell-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _written.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._written_at = path
    return back


def settled(df: DataFrame) -> DataFrame:
    """``df`` as it is if reading it again is a plain scan, with filters and columns at most; else written once.

    For what an operator reads more than once.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    again = any(node in plan for node in ("Join", "Aggregate", "Window", "MapIn", "FlatMap", "Generate", "Distinct", "Sort"))
    return written(df) if again else df


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`written` returned, once nothing that is still to run reads it."""
    path = getattr(df, "_written_at", None)
    for entry in [e for e in _written if e[1] == path]:
        _written.remove(entry)
        _remove(*entry)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; the folder's owner clears it
        pass


def drop_written() -> None:
    """Delete all tables written by this process. DataFrames built on them can't be read afterwards."""
    while _written:
        _remove(*_written.pop())


atexit.register(drop_written)
