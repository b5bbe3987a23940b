"""Aggregation of tables of which a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantell.functions.labels import clean_label
from quantell.plans.shared import written


def key_counts(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """``(k0, …, n)``: rows per key, written once. Counted map-side, so what is shuffled is a row per key and partition."""
    named = df.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    return written(named.groupBy(*named.columns).agg(F.count("*").alias("n")))


def heavy_keys(df: DataFrame, keys: Sequence[Column], share: float, counts: DataFrame | None = None, nulls: bool = False) -> DataFrame:
    """``(k0, …, n, total, share)`` of the keys that hold at least ``share`` of all rows.

    At most ``1/share`` keys can qualify, which bounds the result whatever the input. Keys with a null part
    qualify only with ``nulls``, but their rows always count in the total. An empty table gives an empty result.
    """
    counts = key_counts(df, keys) if counts is None else counts
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = F.lit(True)
    for i in range(0 if nulls else len(keys)):
        known = known & F.col(f"k{i}").isNotNull()
    return counts.where(known & (F.col("n") >= share * total)).withColumns({"total": F.lit(total), "share": F.col("n") / F.lit(float(total))})


def salted_aggregate(
    df: DataFrame, keys: Mapping[str, Column], values: Mapping[str, Column], salts: int = 32, heavy_share: float = 0.01, counts: DataFrame | None = None,
) -> DataFrame:
    """Count, and per value: count, sum, sum of squared deviations from the key's mean, least and greatest, of every key; two stages with salt.

    1. Keys holding ``heavy_share`` of the rows (at most ``1/heavy_share`` of them, hence broadcast) get one of
       ``salts`` salts per row. The salt is a hash of the row's values and its place in its partition, not ``rand()``,
       so a recomputed task sends each row where the lost one did. Partials are formed by key and salt.
    2. Partials are merged by key.

    Values that are null are left out of that value's figures only. Rows with a null key form keys of their own. The
    result has the keys, ``n`` and ``<value>_n, _sum, _m2, _min, _max``; other columns of ``df`` don't matter.
    ``counts``: what :func:`key_counts` gave for the same keys, if it is at hand.
    """
    ks, vs = list(keys), list(values)
    rows = df.select(*[c.alias(f"k{i}") for i, c in enumerate(keys.values())], *[c.alias(f"v{i}") for i, c in enumerate(values.values())])
    kcols, vcols = rows.columns[: len(ks)], rows.columns[len(ks) :]
    hot = heavy_keys(df, list(keys.values()), heavy_share, counts, nulls=True).select(*[F.col(c).alias(f"hot_{c}") for c in kcols], F.lit(True).alias("hot"))
    same = F.lit(True)
    for c in kcols:
        same = same & F.col(c).eqNullSafe(F.col(f"hot_{c}"))
    salt = F.pmod(F.xxhash64(*vcols, F.monotonically_increasing_id()), F.lit(salts))
    salted = rows.join(F.broadcast(hot), same, "left").withColumn("salt", F.when(F.col("hot"), salt).otherwise(F.lit(0)))
    first = [F.count("*").alias("n")]
    for v in vcols:
        first += [F.count(v).alias(f"{v}_n"), F.sum(v).alias(f"{v}_sum"), (F.var_pop(v) * F.count(v)).alias(f"{v}_m2"), F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max")]
    partial = salted.groupBy(*kcols, "salt").agg(*first)
    of_key = Window.partitionBy(*kcols)  # at most ``salts`` partials
    merged = [F.sum("n").alias("n")]
    for v in vcols:
        n, s = F.col(f"{v}_n"), F.col(f"{v}_sum")
        mean = F.sum(s).over(of_key) / F.nullif(F.sum(n).over(of_key), F.lit(0))
        partial = partial.withColumn(f"{v}_m2", F.coalesce(F.col(f"{v}_m2") + n * (s / F.nullif(n, F.lit(0)) - mean) ** 2, F.lit(0.0)))
        merged += [F.sum(f"{v}_n").alias(f"{v}_n"), F.sum(f"{v}_sum").alias(f"{v}_sum"), F.sum(f"{v}_m2").alias(f"{v}_m2"), F.min(f"{v}_min").alias(f"{v}_min"), F.max(f"{v}_max").alias(f"{v}_max")]
    out = partial.groupBy(*kcols).agg(*merged)
    names = {f"k{i}": k for i, k in enumerate(ks)} | {f"v{i}_{s}": f"{v}_{s}" for i, v in enumerate(vs) for s in ("n", "sum", "m2", "min", "max")}
    return out.select(*[F.col(c).alias(names.get(c, c)) for c in out.columns])


def valid(col: Column, most: float | None = None) -> Column:
    """The value where it is finite, at least 0 and at most ``most``; else null."""
    ok = ~F.isnan(col) & (col >= 0) & (col < float("inf"))
    return F.when(ok & (col <= most) if most is not None else ok, col)


def cell_summaries(cells: DataFrame, dominant_share: float = 0.05, salts: int = 32) -> DataFrame:
    """A row per cleaned-up (annotation, batch) of every delivered row: counts, quality figures, whether it dominates.

    Only valid numbers enter the figures (see :func:`valid`). A missing annotation or batch is a key part of its own,
    null, which never counts as dominant. Means and deviations of keys without valid numbers are null.
    """
    keys = {"annotation": clean_label(F.col("annotation")), "batch": clean_label(F.col("batch"))}
    values = {
        "total_counts": valid(F.col("total_counts")),
        "pct_counts_mt": valid(F.col("pct_counts_mt"), 100),
        "n_genes": valid(F.col("n_genes_by_counts").cast("double")),
    }
    counts = key_counts(cells, list(keys.values()))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out = salted_aggregate(cells, keys, values, salts, counts=counts).withColumn("total", F.lit(total))
    cols = [F.col("annotation"), F.col("batch"), F.col("n").alias("n_rows"), (F.col("n") / F.col("total")).alias("share")]
    for v in values:
        n = F.col(f"{v}_n")
        sd = F.when(n > 1, F.sqrt(F.col(f"{v}_m2") / F.nullif(n - 1, F.lit(0))))
        cols += [n.alias(f"{v}_valid"), (F.col(f"{v}_sum") / F.nullif(n, F.lit(0))).alias(f"{v}_mean"), sd.alias(f"{v}_sd"), F.col(f"{v}_min"), F.col(f"{v}_max")]
    known = F.col("annotation").isNotNull() & F.col("batch").isNotNull()
    dominant = known & (F.col("n") >= F.lit(dominant_share) * F.col("total"))
    return out.select(*cols, dominant.alias("dominant"))
