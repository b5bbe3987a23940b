"""One row per key of tables that deliver keys more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, key: str, at: str, **values: Column) -> DataFrame:
    """``(key, …)``: the values of the row with the greatest ``at`` of each key; rows that tie: the greatest values.

    Null times come before all others; rows with a null key are left out.
    """
    picked = df.select(F.col(key).alias("k"), F.struct(F.col(at).alias("at"), *[v.alias(n) for n, v in values.items()]).alias("r"))
    last = picked.where(F.col("k").isNotNull()).groupBy("k").agg(F.max("r").alias("r"))
    return last.select(F.col("k").alias(key), *[F.col(f"r.{n}").alias(n) for n in values])


def first_rows(df: DataFrame, key: str, at: str, **values: Column) -> DataFrame:
    """As :func:`latest_rows` for the least ``at`` that isn't null, kept as column ``at``; keys without any time are left out."""
    picked = df.select(F.col(key).alias("k"), F.struct(F.col(at).alias("at"), *[v.alias(n) for n, v in values.items()]).alias("r"))
    first = picked.where(F.col("k").isNotNull() & F.col("r.at").isNotNull()).groupBy("k").agg(F.min("r").alias("r"))
    return first.select(F.col("k").alias(key), *[F.col(f"r.{n}").alias(n) for n in ["at", *values]])
