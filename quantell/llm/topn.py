"""Problem 4: the N best items of every group, by partition lower bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantell.plans.shared import written

#: Rows that a partition gathers before it reduces them to the first n of each group.
HELD_ROWS = 1_000_000


def _starts(*cols: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before it in any of the columns."""
    new = np.ones(len(cols[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return new


def _codes(col: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of strings in the byte order of their values, and the values."""
    enc = pc.dictionary_encode(col)
    values = enc.dictionary
    order = pc.array_sort_indices(values).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[enc.indices.to_numpy(zero_copy_only=False)], values.take(pa.array(order))


def top_n(df: DataFrame, group: Column, item: Column, scores: list[Column], n: int) -> DataFrame:
    """``(group, item, s0, …, place)``: the first ``n`` items of each group by scores ascending, then item in byte order.

    Of an item that occurs more than once in a group only its best row counts. Rows with a null group, a null item or
    a score that is null, NaN or infinite are left out. Groups with fewer than ``n`` items give all of them; an empty
    table gives an empty result.

    1. Each partition keeps its own first ``n`` items per group. If it has that many, the last of them is a lower bound
       of the group: no item after it can be among the group's first ``n``.
    2. The tightest bound of each group is joined to the kept rows, and rows beyond it are dropped.
    3. Survivors lose repeats of an item and are ranked.

    So a group of any size sends at most ``n`` rows per partition, and few of them to the task that ranks it.
    """
    s = [f"s{i}" for i in range(len(scores))]
    ok = F.col("g").isNotNull() & F.col("i").isNotNull()
    for c in s:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    rows = df.select(group.cast("string").alias("g"), item.cast("string").alias("i"), *[(c.cast("double") + 0.0).alias(a) for c, a in zip(scores, s, strict=True)]).where(ok)

    def first(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
        """The first ``n`` items of each group of ``t``, and which rows are their group's n-th."""
        arrays = [pa.concat_arrays(c.chunks) for c in t.columns]
        (gc, _), (ic, _) = _codes(arrays[0]), _codes(arrays[1])
        ss = [a.to_numpy() for a in arrays[2:]]
        order = np.lexsort((*ss[::-1], ic, gc))  # the best row of each item in its group
        best = order[_starts(gc[order], ic[order])]
        order = best[np.lexsort((ic[best], *[x[best] for x in ss[::-1]], gc[best]))]
        start = np.flatnonzero(_starts(gc[order]))
        place = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
        return t.take(pa.array(order[place < n])), place[place < n] == n - 1

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows_held, most = 0, HELD_ROWS
        for b in batches:
            held.append(b)
            rows_held += b.num_rows
            if rows_held > most:
                held = first(pa.Table.from_batches(held))[0].to_batches()
                rows_held = sum(x.num_rows for x in held)
                most = HELD_ROWS + 2 * rows_held
        if rows_held:
            t, last = first(pa.Table.from_batches(held))
            yield from t.append_column("bound", pa.array(last)).to_batches()

    kinds = ", ".join(f"{c} double" for c in s)
    kept = written(rows.mapInArrow(keep, f"g string, i string, {kinds}, bound boolean"))
    key = F.struct(*s, "i")
    bounds = kept.where("bound").groupBy("g").agg(F.min(key).alias("tightest"))
    alive = kept.join(bounds, "g", "left").where(F.col("tightest").isNull() | (key <= F.col("tightest")))
    best = alive.groupBy("g", "i").agg(F.min(F.struct(*s)).alias("b"))
    ranked = best.select("g", "i", *[F.col(f"b.{c}").alias(c) for c in s])
    place = F.row_number().over(Window.partitionBy("g").orderBy(*s, "i"))
    ranked = ranked.withColumn("place", place).where(F.col("place") <= n)
    return ranked.withColumnsRenamed({"g": "group", "i": "item"})
