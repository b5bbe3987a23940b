"""Blocks of near vectors: a k-d tree over principal axes, and the rows that a ball of given radius sends to each leaf.

The tree is fitted on a bounded sample (``SAMPLE_ROWS``); every row is routed through it, so the sample decides how
evenly the work is spread and never the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantell.functions.vectors import matrix

#: Rows that the tree is fitted on: a 200th of all, at least and at most about this many (they are held by the driver).
SAMPLE_ROWS = 60_000, 1_000_000
#: Principal axes that the tree splits on.
AXES = 12
#: Rows that a leaf or a salted part of a leaf is meant to hold.
LEAF_ROWS = 16_384


@dataclass
class Tree:
    """Split nodes as arrays; a negative child ``-1 - i`` is leaf i. ``parts``: how many salted parts leaf i has."""

    mean: np.ndarray
    axes: np.ndarray
    dim: list[int] = field(default_factory=list)
    at: list[float] = field(default_factory=list)
    low: list[int] = field(default_factory=list)
    high: list[int] = field(default_factory=list)
    parts: list[int] = field(default_factory=list)
    root: int = -1

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x.astype(np.float64) - self.mean) @ self.axes

    def home(self, y: np.ndarray) -> np.ndarray:
        """The leaf of each projected row."""
        leaf = np.zeros(len(y), np.int64)
        todo = [(self.root, np.arange(len(y)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                leaf[rows] = -1 - node
                continue
            left = y[rows, self.dim[node]] <= self.at[node]
            todo += [(self.low[node], rows[left]), (self.high[node], rows[~left])]
        return leaf

    def reached(self, y: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, leaf)`` for every leaf whose box comes within ``radius`` of the projected row.

        Projection on orthonormal axes never lengthens a distance, so no pair within the radius is missed.
        """
        rows_out, leaf_out = [], []
        n = len(y)
        todo = [(self.root, np.arange(n), np.zeros((n, y.shape[1])), np.zeros(n))]
        limit = (radius + 1e-3) ** 2
        while todo:
            node, rows, off, d2 = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                rows_out.append(rows)
                leaf_out.append(np.full(len(rows), -1 - node))
                continue
            k = self.dim[node]
            beyond = y[rows, k] - self.at[node]
            for child, side in ((self.low[node], beyond), (self.high[node], -beyond)):
                far = np.maximum(off[:, k], side)
                now = d2 - off[:, k] ** 2 + far**2
                keep = now <= limit[rows]
                there = off[keep]
                there[:, k] = far[keep]
                todo.append((child, rows[keep], there, now[keep]))
        if not rows_out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(rows_out), np.concatenate(leaf_out)


def moments(vectors: DataFrame, col: str, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance over all rows; partitions send one row per pair of dimensions."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            x = matrix(b.column(0), dim, np.float64)
            n, s, q = n + len(x), s + x.sum(0), q + x.T @ x
        i, j = np.triu_indices(dim)
        yield pa.RecordBatch.from_pydict({
            "i": pa.array(np.concatenate([[-2], np.full(dim, -1), i]), pa.int32()),
            "j": pa.array(np.concatenate([[0], np.arange(dim), j]), pa.int32()),
            "s": pa.array(np.concatenate([[float(n)], s, q[i, j]])),
        })

    rows = vectors.select(col).mapInArrow(sums, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    s, q, n = np.zeros(dim), np.zeros((dim, dim)), 0
    for r in rows:  # dim * (dim + 3) / 2 + 1 rows
        if r.i == -2:
            n = int(r.s)
        elif r.i == -1:
            s[r.j] = r.s
        else:
            q[r.i, r.j] = q[r.j, r.i] = r.s
    mean = s / max(n, 1)
    return n, mean, q / max(n, 1) - np.outer(mean, mean)


def fit_tree(vectors: DataFrame, id_col: str, col: str, dim: int, radius: float, leaf_rows: int = LEAF_ROWS, sample_rows: tuple[int, int] = SAMPLE_ROWS) -> Tree:
    """A tree over the principal axes of all rows, its splits taken at the medians of a hash sample."""
    n, mean, cov = moments(vectors, col, dim)
    axes = np.linalg.eigh(cov)[1][:, ::-1][:, : min(AXES, dim)]
    tree = Tree(mean, axes)
    rate = min(1.0, min(max(n / 200, sample_rows[0]), sample_rows[1]) / max(n, 1))
    cut = int(rate * (1 << 30))
    sample = vectors.where(F.pmod(F.xxhash64(id_col, F.lit("tree")), F.lit(1 << 30)) < cut).select(col)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = tree.project(matrix(b.column(0), dim)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in y], pa.binary())], ["y"])

    got = sample.mapInArrow(project, "y binary").toArrow().column("y").to_pylist()
    y = np.frombuffer(b"".join(got), np.float32).reshape(-1, axes.shape[1])
    y = y[np.lexsort(y.T[::-1])] if len(y) else y
    size = max(leaf_rows, 12 / rate)  # at least 12 sampled rows a leaf

    def split(rows: np.ndarray) -> int:
        if len(rows) / rate > size:
            part = y[rows]
            lo, hi = np.quantile(part, [0.05, 0.95], axis=0)
            k = int(np.argmax(hi - lo))
            if hi[k] - lo[k] > radius:
                at = float(np.median(part[:, k]))
                left = part[:, k] <= at
                if 0 < left.sum() < len(rows):
                    node = len(tree.dim)
                    for values, v in ((tree.dim, k), (tree.at, at), (tree.low, 0), (tree.high, 0)):
                        values.append(v)
                    tree.low[node], tree.high[node] = split(rows[left]), split(rows[~left])
                    return node
        tree.parts.append(max(1, int(np.ceil(len(rows) / rate / (2 * leaf_rows)))))
        return -len(tree.parts)

    tree.root = split(np.arange(len(y)))
    return tree


def homes(vectors: DataFrame, tree: Tree, id_col: str, col: str, dim: int) -> DataFrame:
    """``(id, x, leaf, part)``: where each row belongs; a leaf too full to split is divided by a hash of the id."""
    shared = vectors.sparkSession.sparkContext.broadcast(tree)  # bounded by the sample it was fitted on

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        parts = np.asarray(t.parts)
        for b in batches:
            leaf = t.home(t.project(matrix(b.column(1), dim)))
            ids = b.column(0).to_numpy().astype(np.uint64)
            mixed = (ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(leaf, pa.int32()), pa.array((mixed % parts[leaf].astype(np.uint64)).astype(np.int32))],
                ["id", "x", "leaf", "part"],
            )

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(col).cast("array<float>").alias("x"))
    return rows.mapInArrow(place, "id long, x array<float>, leaf int, part int")


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of centred float32 rows; callers recheck what lies near a bound."""
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.maximum(d, 0, out=d)


def frame(**columns: np.ndarray) -> pa.Table:
    return pa.Table.from_pandas(pd.DataFrame(columns), preserve_index=False)
