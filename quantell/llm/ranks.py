"""Problem 5: percentiles with a bounded error, from mergeable rank-interval summaries.

A summary of n values is a list of tuples (value, le, lt): at least ``le`` of the values are at most this one, and at
most ``lt`` are less. So the value's ranks are known as an interval, as in Greenwald and Khanna's public papers (2001,
2004); runs of equal values are kept whole. Merging adds the bounds and makes no new error. Compressing drops tuples
as long as the ranks between those that are left stay known to within the permitted uncertainty, a share of n that
the caller gives: summaries of partitions may use half of it, each level of the hierarchy a further part. So the error
of every answer is at most ``floor(error * n)`` ranks however often summaries are merged, and exact for groups of less
than ``1 / error`` values. The error is tracked by the bounds themselves (:func:`rank_error`) and checked at each step.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantell.plans.shared import written

#: Summaries that one step of the hierarchy merges per key, at most.
FAN_IN = 16
#: Values a partition holds before it summarises them and goes on.
RUN_ROWS = 1_000_000
#: Tuples that a merging task is meant to hold; the number of tasks follows the summaries' size.
PART_TUPLES = 500_000

Summary = tuple[np.ndarray, np.ndarray, np.ndarray]


def of_values(values: np.ndarray) -> Summary:
    """The exact summary of some values."""
    v, count = np.unique(values, return_counts=True)
    le = np.cumsum(count)
    return v, le, le - count


def rank_error(s: Summary, n: int) -> int:
    """The greatest rank error of :func:`ask`: half the widest gap between a tuple's ``le`` and the next one's ``lt``."""
    _, le, lt = s
    if not len(le):
        return 0
    inside = int(((lt[1:] + 1 - le[:-1]) // 2).max()) if len(le) > 1 else 0
    return max(inside, int(lt[0]), n - int(le[-1]), 0)


def merge(a: Summary, b: Summary) -> Summary:
    """The summary of both; the bounds add up."""
    if not len(a[0]) or not len(b[0]):
        return b if not len(a[0]) else a
    (va, lea, lta), (vb, leb, ltb) = a, b

    def bounds(v: np.ndarray, s: Summary, total: int) -> tuple[np.ndarray, np.ndarray]:
        vs, le, lt = s
        at_most = np.searchsorted(vs, v, "right") - 1
        at_least = np.searchsorted(vs, v, "left")
        return np.where(at_most >= 0, le[np.maximum(at_most, 0)], 0), np.where(at_least < len(vs), lt[np.minimum(at_least, len(vs) - 1)], total)

    v = np.union1d(va, vb)
    # compress() keeps the greatest value of a summary, so its le is the number of values summarised.
    le1, lt1 = bounds(v, a, int(lea[-1]))
    le2, lt2 = bounds(v, b, int(leb[-1]))
    return v, le1 + le2, lt1 + lt2


def ask(s: Summary, n: int, rank: np.ndarray) -> np.ndarray:
    """Positions of the tuples that answer the ranks with the least possible error."""
    _, le, lt = s
    # An answer is off by at most max(rank - le, lt + 1 - rank); the first falls, the second rises along the summary.
    at = np.minimum(np.searchsorted(le + lt + 1, 2 * rank, "left"), len(le) - 1)
    before = np.maximum(at - 1, 0)
    off = [np.maximum(np.maximum(rank - le[i], lt[i] + 1 - rank), 0) for i in (at, before)]
    return np.where(off[1] < off[0], before, at)


def compress(s: Summary, permitted: int) -> Summary:
    """The fewest tuples, the least and the greatest included, between which no rank is known worse than ``permitted``."""
    v, le, lt = s
    if permitted < 1 or len(v) < 3:
        return s
    ranks, kept, last = lt.tolist(), [0], len(v) - 1
    while kept[-1] < last:
        i = kept[-1]
        kept.append(min(max(bisect_right(ranks, int(le[i]) + 2 * permitted) - 1, i + 1), last))
    return v[kept], le[kept], lt[kept]


def _pack(rows: list[tuple]) -> pa.Table:
    keys, names, nodes, n, s = zip(*rows, strict=True) if rows else ((), (), (), (), ())
    cols = [pa.array([x[i] for x in s], pa.list_(k)) for i, k in enumerate((pa.float64(), pa.int64(), pa.int64()))]
    return pa.table({"key": pa.array(keys, pa.string()), "metric": pa.array(names, pa.string()), "node": pa.array(nodes, pa.int32()), "n": pa.array(n, pa.int64()), "v": cols[0], "le": cols[1], "lt": cols[2]})


SCHEMA = "key string, metric string, node int, n long, v array<double>, le array<long>, lt array<long>"


def rank_summaries(df: DataFrame, key: Column, values: Mapping[str, Column], error: float = 0.001) -> DataFrame:
    """``(key, metric, node, n, v, le, lt)``: summaries per partition, key and value; null, NaN and infinite values and null keys are left out.

    A partition summarises ``RUN_ROWS`` rows at a time, with half the permitted ``error`` (a share of each summary's n),
    so what it holds and what is shuffled is bounded whatever the size of a key.
    """
    names = list(values)
    rows = df.select(key.cast("string").alias("key"), *[c.cast("double").alias(f"v{i}") for i, c in enumerate(values.values())]).where(F.col("key").isNotNull())

    def run(held: list[pa.RecordBatch]) -> pa.Table:
        t = pa.Table.from_batches(held)
        enc = pa.concat_arrays(t.column(0).chunks).dictionary_encode()
        code, keys = enc.indices.to_numpy(), enc.dictionary.to_pylist()
        out = []
        for i, name in enumerate(names):
            x = np.asarray(t.column(1 + i).to_numpy(), np.float64)
            ok = np.isfinite(x)
            c, x = code[ok], x[ok] + 0.0
            order = np.lexsort((x, c))
            c, x = c[order], x[order]
            new = np.ones(len(c) + 1, bool)
            new[1:-1] = c[1:] != c[:-1]
            edge = np.flatnonzero(new)  # where each key's values begin, and the end
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                out.append((keys[c[a]], name, TaskContext.get().partitionId(), b - a, compress(of_values(x[a:b]), math.floor(error / 2 * (b - a)))))
        return _pack(out)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= RUN_ROWS:
                yield from run(held).to_batches()
                held, n = [], 0
        if held:
            yield from run(held).to_batches()

    return rows.mapInArrow(summarise, SCHEMA)


def merge_summaries(summaries: DataFrame, error: float = 0.001) -> DataFrame:
    """The same columns, a row per key and metric; summaries of several loads may be united before.

    Merged in a hierarchy, ``FAN_IN`` nodes of each load at a time; tasks hold about ``PART_TUPLES`` tuples. Raises
    where summaries were made with a greater error than ``error`` and an answer would be off by more.
    """
    summaries = written(summaries)
    size = summaries.agg(F.coalesce(F.max("node"), F.lit(0)).alias("node"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("tuples")).first()
    parts = max(1, -(-size.tuples // PART_TUPLES))
    levels = 1
    while FAN_IN**levels <= size.node:
        levels += 1

    def join(share: float) -> Callable[[pa.Table], pa.Table]:
        def joined(t: pa.Table) -> pa.Table:
            ks, ms, node, ns = t.column("key").to_pylist(), t.column("metric").to_pylist(), t.column("node").to_numpy(), t.column("n").to_numpy()
            columns = []
            for c in ("v", "le", "lt"):
                arr = pa.concat_arrays(t.column(c).chunks)
                columns.append((arr.flatten().to_numpy(), np.append(0, np.cumsum(arr.value_lengths().to_numpy()))))
            groups: dict[tuple[str, str], list[int]] = {}
            for i in np.argsort(node, kind="stable"):
                groups.setdefault((ks[i], ms[i]), []).append(int(i))
            out = []
            for (k, m), at in sorted(groups.items()):
                total, held = 0, [tuple(x[o[i] : o[i + 1]] for x, o in columns) for i in at]
                while len(held) > 1:
                    held = [merge(*held[i : i + 2]) if len(held[i : i + 2]) == 2 else held[i] for i in range(0, len(held), 2)]
                total = int(ns[at].sum())
                permitted = math.floor(share * total)
                s = compress(held[0], permitted)
                if rank_error(s, total) > math.floor(error * total):
                    raise ValueError(f"summaries of {k} were made with an error above {error}")
                out.append((k, m, int(node[at[0]]) // FAN_IN, total, s))
            return _pack(out)

        return joined

    for level in range(1, levels + 1):
        up = summaries.withColumn("up", F.floor(F.col("node") / FAN_IN)).withColumn("part", F.pmod(F.xxhash64("key", "metric"), F.lit(parts)))
        summaries = up.groupBy("part", "up").applyInArrow(join(error / 2 * (1 + level / levels)), SCHEMA)
    return summaries


def percentiles(summaries: DataFrame, shares: Mapping[str, float]) -> DataFrame:
    """``(key, metric, n, err, <name>…)``: per key and metric the answers to the ranks ``share * (n - 1) + 1``, midway ranks
    as the mean of both neighbours' answers weighted as in linear interpolation, and the greatest rank error."""
    names = list(shares)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(3).to_numpy()
            got: list[list[float]] = []
            errs = []
            for i in range(b.num_rows):
                s = tuple(np.asarray(b.column(c)[i].values.to_numpy()) for c in (4, 5, 6))
                at = np.array(list(shares.values())) * (n[i] - 1) + 1
                low = np.floor(at)
                a, c = s[0][ask(s, n[i], low)], s[0][ask(s, n[i], np.minimum(low + 1, n[i]))]
                got.append(list(a + (c - a) * (at - low)))
                errs.append(rank_error(s, int(n[i])))
            cols = [pa.array([g[j] for g in got], pa.float64()) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(errs, pa.int64()), *cols], ["key", "metric", "n", "err", *names])

    return summaries.mapInArrow(answer, "key string, metric string, n long, err long, " + ", ".join(f"`{x}` double" for x in names))
