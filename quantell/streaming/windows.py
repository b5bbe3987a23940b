"""Grouped means over streams of values, in windows of event time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_stats(stream: DataFrame, *, at: str, keys: Sequence[str], value: str, window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """``start, end, keys…, n, total, mean, logmean`` per window; rows later than the watermark allows are left out.

    Works on streams and on tables. State is a row per key and open window. Null keys are keys of their own, null times
    are left out by the window.
    """
    t = stream.withColumn("__at", F.col(at).cast("timestamp"))
    if stream.isStreaming:
        t = t.withWatermark("__at", late)
    w = F.window("__at", window, slide) if slide else F.window("__at", window)
    g = t.groupBy(w.alias("w"), *keys).agg(F.count(value).alias("n"), F.sum(value).alias("total"))
    mean = F.col("total") / F.nullif(F.col("n"), F.lit(0))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total", mean.alias("mean"), F.log1p(F.greatest(mean, F.lit(0.0))).alias("logmean"))


def latest_by_key(stream: DataFrame, *, key: str, at: str) -> DataFrame:
    """The latest row of each key as a table that a stream keeps up to date (output mode ``complete`` or ``update``)."""
    cols = [c for c in stream.columns if c not in (key, at)]
    return stream.groupBy(key).agg(F.max(F.struct(at, *cols)).alias("r")).select(key, "r.*")
