"""Problem 2: a sample that stays the same for any rerun and keeps its rows as data grows, by stratified hash thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantell.llm.latest import first_rows
from quantell.llm.topn import top_n
from quantell.plans.shared import written

#: Values of the hash: the first 8 hexadecimal digits of an MD5.
RANGE = 1 << 32


def key_hash(key: Column, salt: str) -> Column:
    """A number in [0, RANGE) from the key and the salt alone."""
    digest = F.md5(F.concat(F.lit(salt + ":"), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def key_hash_sql(key: str, salt: str) -> str:
    return f"CAST('0x' || substr(md5('{salt}:' || CAST({key} AS VARCHAR)), 1, 8) AS BIGINT)"


def raise_thresholds(before: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(stratum, threshold)``: the greater of both tables for each stratum, so no earlier selection is undone."""
    return before.unionByName(wanted).where("stratum IS NOT NULL").groupBy("stratum").agg(F.max("threshold").alias("threshold"))


def _seconds(at: str, kind: str) -> Column:
    """A time as a number that keeps its order, whatever the session's time zone; other kinds as they are."""
    if kind == "timestamp_ntz":
        since = f"(`{at}` - TIMESTAMP_NTZ'1970-01-01 00:00:00')"
        return F.expr(f"extract(DAY FROM {since}) * 86400D + extract(HOUR FROM {since}) * 3600D + extract(MINUTE FROM {since}) * 60D + CAST(extract(SECOND FROM {since}) AS DOUBLE)")
    return F.unix_micros(at).cast("double") if kind == "timestamp" else F.col(at).cast("double")


def stable_sample(
    df: DataFrame, key: str, at: str, strata: list[Column], rate: float, floor: int = 0, salt: str = "sample", thresholds: DataFrame | None = None,
) -> DataFrame:
    """``(key, stratum, hash, threshold, by_floor)`` of the chosen keys.

    A key is chosen where its salted hash lies below its stratum's threshold: ``rate`` of the range, or more where
    ``thresholds`` (stratum, threshold) says so; see :func:`raise_thresholds`. The first ``floor`` keys to arrive in a
    stratum, ties by hash, are chosen too, so small strata are present. Everything that decides is fixed once a key
    has arrived: its stratum is that of its first row, and later arrivals don't change who came first. So rows with a
    later ``at`` add keys and remove none, and order, partitioning and repeated rows don't matter.

    Rows with a null key or time are left out (they can't be placed in order). A null part of a stratum is a value of
    its own. Of rows tied for a key's first time, the one with the least stratum counts. Empty tables give no rows.
    """
    parts = {f"p{i}": F.coalesce(c.cast("string"), F.lit("")) for i, c in enumerate(strata)}
    first = first_rows(df, key, at, **parts)
    rows = first.select(F.col(key).alias("k"), "at", F.concat_ws("\u001f", *parts).alias("stratum"), key_hash(F.col(key), salt).alias("h"))
    base = F.lit(int(rate * RANGE))
    if thresholds is not None:
        rows = rows.join(thresholds.select("stratum", F.col("threshold").alias("t")), "stratum", "left").withColumn("t", F.greatest(base, F.coalesce("t", base)))
    else:
        rows = rows.withColumn("t", base)
    rows = written(rows) if floor > 0 else rows  # read several times below
    chosen = rows.where("h < t").select("k", "stratum", "h", "t", F.lit(0).alias("f"))
    if floor > 0:
        early = top_n(rows.select("*", _seconds("at", dict(df.dtypes)[at]).alias("m")), F.col("stratum"), F.col("k"), [F.col("m"), F.col("h")], floor)
        early = early.select(F.col("item").cast(dict(df.dtypes)[key]).alias("k"), F.col("group").alias("stratum"))
        early = early.join(rows.where("h >= t"), ["k", "stratum"]).select("k", "stratum", "h", "t", F.lit(1).alias("f"))
        chosen = chosen.union(early)
    return chosen.select(F.col("k").alias(key), "stratum", F.col("h").alias("hash"), F.col("t").alias("threshold"), F.col("f").alias("by_floor"))
