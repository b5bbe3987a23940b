"""Problem 1: a varied subset, by tournament-pivoted rank-revealing QR in deflated rounds.

Feature rows. Raw vectors of 30 values span only 30 directions, which would end after 30 picks. Each vector is
therefore lifted to random Fourier features of a Gaussian kernel (public: Rahimi and Recht 2007): rows of length 1
whose inner product falls with distance, so near-alike rows are nearly dependent and rows of different regions nearly
independent. Beside them stands the row's label, as a unit vector of its own scaled by ``label_weight``: a row of a
label not chosen yet keeps more of its length than any other row, so all labels come first, the small ones too.

Rounds. In each round every block of rows nominates ``per_round`` rows by QR with column pivoting (modified
Gram-Schmidt, the longest remaining row next) after taking out what the rows chosen in earlier rounds span; nominees
meet pairwise in a tree, each pair re-pivoted, until one set is left. When no row has anything left that these
features tell apart, the next epoch takes fresh ones of half the kernel's width, as many as ``k`` rows need. Rows are
written once, a leaf to a row of the table, so rounds shuffle nominees only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantell.functions.vectors import lists, matrix, usable
from quantell.plans.shared import discard, written

#: Rows pivoted together; also the unit of the first nominations.
BLOCK_ROWS = 4096
#: Rows of a leaf of the tree: what one task nominates from.
LEAF_ROWS = 32_768
#: Picks shorter than this are no longer independent of what has been chosen.
LEAST_GAIN = 1e-3
#: Epochs after which vectors that differ count as beyond telling apart, an error; and from which features are taken in
#: double precision.
MOST_EPOCHS, EXACT_FROM = 64, 8


class Features:
    """Maps vectors and labels to feature rows; a few seeded matrices, the same in every task."""

    def __init__(self, dim: int, n: int, width: float, labels: list[str], label_weight: float, seed: int, exact: bool = False):
        rng = np.random.default_rng(seed)
        self.w = (rng.standard_normal((dim, n // 2)) / width).astype(np.float64 if exact else np.float32)
        self.at = {v: i for i, v in enumerate(labels)}
        self.label_weight = label_weight

    @property
    def size(self) -> int:
        return 2 * self.w.shape[1] + len(self.at)

    def rows(self, x: np.ndarray, label: list[str | None]) -> np.ndarray:
        """Features of the vector, then a direction of its own for every label."""
        half = self.w.shape[1]
        z = x.astype(self.w.dtype) @ self.w
        scale = np.float32(1 / math.sqrt(half))
        out = np.zeros((len(x), self.size), np.float32)
        out[:, :half] = np.cos(z) * scale
        out[:, half : 2 * half] = np.sin(z) * scale
        code = np.array([self.at.get(v, -1) for v in label], np.int64)
        has = np.flatnonzero(code >= 0)
        out[has, 2 * half + code[has]] = self.label_weight
        return out


def pivoted(rows: np.ndarray, n: int) -> tuple[list[int], list[float]]:
    """The first ``n`` pivots of QR with row pivoting and their lengths; ties go to the first row. Changes ``rows``."""
    left = np.einsum("ij,ij->i", rows, rows)
    free = np.ones(len(rows), bool)
    picked: list[int] = []
    gains: list[float] = []
    while len(picked) < n and free.any():
        k = int(np.where(free, left, -1).argmax())
        gain2 = float(rows[k] @ rows[k])
        if gain2 < 0.8 * left[k]:  # the running lengths have lost digits
            left = np.einsum("ij,ij->i", rows, rows)
            k = int(np.where(free, left, -1).argmax())
            gain2 = float(left[k])
        if gain2 < LEAST_GAIN**2:
            break
        free[k] = False
        picked.append(k)
        gains.append(math.sqrt(gain2))
        q = rows[k] / np.float32(gains[-1])
        along = rows @ q
        rows -= along[:, None] * q
        left = np.maximum(left - along * along, 0)
    return picked, gains


def _nominate(ids: np.ndarray, x: np.ndarray, label: list[str | None], features: Features, basis: np.ndarray, n: int) -> tuple[np.ndarray, list[float]]:
    """Numbers and lengths of the rows that a pairwise tree over blocks of them leaves."""

    def play(rows: np.ndarray) -> tuple[np.ndarray, list[float]]:
        f = features.rows(x[rows], [label[i] for i in rows])
        if len(basis):
            f -= (f @ basis.T) @ basis
            f -= (f @ basis.T) @ basis
        k, gains = pivoted(f, n)
        return rows[k], gains

    order = np.argsort(ids, kind="stable")
    left = [play(order[i : i + BLOCK_ROWS]) for i in range(0, len(order), BLOCK_ROWS)]
    while len(left) > 1:
        left = [play(np.concatenate([r for r, _ in left[i : i + 2]])) if len(left[i : i + 2]) == 2 else left[i] for i in range(0, len(left), 2)]
    return left[0] if left else (np.zeros(0, np.int64), [])


SCHEMA = "node int, id long, label string, x array<float>, gain double, place int"


def _nominees(node: int, ids: np.ndarray, x: np.ndarray, label: list[str | None], rows: np.ndarray, gains: list[float]) -> pa.Table:
    return pa.table({
        "node": pa.array([node] * len(rows), pa.int32()), "id": ids[rows], "label": pa.array([label[i] for i in rows], pa.string()),
        "x": lists(x[rows]), "gain": pa.array(gains, pa.float64()), "place": pa.array(range(len(rows)), pa.int32()),
    })


def _packed(rows: DataFrame, dim: int, leaves: int) -> DataFrame:
    """``(leaf, ids, labels, x)``: a row per leaf of the tree, written once; x is all its vectors in a row."""

    def pack(key, t):  # noqa: ANN001, ANN202 - Spark takes the kind of function from its two arguments
        def one(values: pa.Array, kind: pa.DataType) -> pa.ListArray:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind))

        flat = pa.array(matrix(t.column("x"), dim).ravel(), pa.float32())
        cols = [one(t.column("id").combine_chunks(), pa.int64()), one(t.column("label").combine_chunks(), pa.string()), one(flat, pa.float32())]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), *cols], ["leaf", "ids", "labels", "x"])

    leaf = F.pmod(F.xxhash64("id"), F.lit(leaves)).cast("int")
    return written(rows.withColumn("leaf", leaf).groupBy("leaf").applyInArrow(pack, "leaf int, ids array<long>, labels array<string>, x array<float>"))


def _first(shared: Broadcast, size: int, dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Nominations of the leaves."""

    def nominate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, label = b.column(1)[i].values.to_numpy(), b.column(2)[i].as_py()
                x = b.column(3)[i].values.to_numpy().reshape(-1, dim)
                rows, gains = _nominate(ids, x, label, *shared.value, size)
                yield from _nominees(b.column(0)[i].as_py() // 2, ids, x, label, rows, gains).to_batches()

    return nominate


def _next(shared: Broadcast, size: int, dim: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Nominations of a node of the tree, named after the node above it."""

    def nominate(key, t):  # noqa: ANN001, ANN202
        ids, x, label = t.column("id").to_numpy(), matrix(t.column("x"), dim), t.column("label").to_pylist()
        return _nominees(key[0].as_py() // 2, ids, x, label, *_nominate(ids, x, label, *shared.value, size))

    return nominate


def varied_subset(
    vectors: DataFrame, labels: DataFrame, k: int, id_col: str = "cell_id", vector_col: str = "x_scvi", label_col: str = "annotation",
    dim: int = 30, per_round: int = 64, n_features: int | None = None, width: float = 4.0, label_weight: float = 2.0, seed: int = 17, max_labels: int = 2048,
) -> DataFrame:
    """``(cell_id, label, pick, gain)``: ``k`` rows, or all distinct ones if there are fewer, in the order of their choice.

    ``labels`` has one label per id at most (of several the least counts); rows without a label take part without one.
    Rows with a null id or an unusable vector are left out; of several vectors of an id the least counts. Ties of
    length go to the smaller id within a block. ``gain`` is what the row adds to those chosen before it in its round.
    The same rows give the same result in any order and partitioning. Exact copies of a chosen vector with the same
    label add nothing and are never chosen: ``k`` rows come out, or as many as there are distinct vectors and labels.
    Raises where distinct vectors can't be told apart after ``MOST_EPOCHS`` halvings of the kernel's width. The driver
    holds ``k`` rows and the distinct labels; more labels than ``max_labels`` raise an error, since each label has a
    feature of its own. The number of features bounds how many rows can be independent; by default it is half as large
    again as ``k``, at least 256, and a smaller number given is raised to that once it is used up.
    """
    enough = 2 * math.ceil(max(256, 1.5 * k) / 2)
    n_features = n_features or enough
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("x"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("x"), dim)).groupBy("id").agg(F.min("x").alias("x"))
    named = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label")).groupBy("id").agg(F.min("label").alias("label"))
    rows = written(rows.join(named, "id", "left"))
    plain = F.transform("x", lambda v: v + F.lit(0).cast("float"))  # zeros without a sign
    counts = rows.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct(F.xxhash64(plain)).alias("distinct")).limit(max_labels + 1).collect()
    if len(counts) > max_labels:
        raise ValueError(f"more than {max_labels} labels")
    known = sorted(c.label for c in counts if c.label is not None)
    n, wanted = sum(c.n for c in counts), min(k, sum(c.distinct for c in counts))
    levels = max(0, math.ceil(math.log2(max(n, 1) / LEAF_ROWS)))
    leaves = _packed(rows, dim, 1 << levels)
    discard(rows)
    chosen: list[tuple[int, str | None, float]] = []
    picks: list[tuple[np.ndarray, str | None]] = []
    epoch = 0
    while len(chosen) < wanted:
        if epoch > MOST_EPOCHS:
            raise RuntimeError(f"{len(chosen)} of {wanted} rows chosen; the others are too near to tell apart")
        features = Features(dim, n_features, width / 2**epoch, known, label_weight, seed + epoch, epoch >= EXACT_FROM)
        size = min(per_round, wanted - len(chosen))
        basis = np.zeros((0, features.size), np.float32)
        if picks:
            f = features.rows(np.array([p[0] for p in picks], np.float32), [p[1] for p in picks]).astype(np.float64)
            u, s, v = np.linalg.svd(f, full_matrices=False)
            basis = v[s > 1e-4 * max(s.max(), 1e-30)].astype(np.float32)
        shared = spark.sparkContext.broadcast((features, basis))  # bounded by k, n_features and max_labels
        left = leaves.mapInArrow(_first(shared, size, dim), SCHEMA)
        for _ in range(levels):
            left = left.groupBy("node").applyInArrow(_next(shared, size, dim), SCHEMA)
        won = left.orderBy("place").collect()  # at most per_round rows
        shared.unpersist()
        chosen += [(r.id, r.label, r.gain) for r in won]
        picks += [(np.array(r.x, np.float32), r.label) for r in won]
        if len(won) < size:
            epoch += 1
            n_features = max(n_features, enough)
    discard(leaves)
    data = [(i, label, place, round(gain, 5)) for place, (i, label, gain) in enumerate(chosen, 1)]
    return spark.createDataFrame(data, f"{id_col} long, label string, pick int, gain double")
