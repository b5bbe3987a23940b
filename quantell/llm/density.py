"""Problem 6: clusters of mutually similar vectors, by density peaks over blocked neighbour joins.

How the method is carried to any size:

* *Records.* Vectors are gathered into balls of half the cutoff around one of them, the ball's *lead*, so that any
  two of a ball are alike. Leads carry their ball's weight through the joins; a crowd of near-copies costs one record,
  and no pairs are formed within it.
* *Blocks.* Leads are routed to the leaves of a k-d tree; a lead also visits the later leaves that its reach touches.
  Each pair within reach meets in exactly one leaf (see :mod:`quantell.llm.blocks`); the rows of a crowded leaf are
  divided into parts, and every two parts meet in a task of their own.
* *Density.* Weight of the leads within the cutoff, own ball included.
* *Distance to the nearest denser record*, ``delta``: searched up to ``HORIZON`` cutoffs, ties of density and of
  distance to the smaller id. A lead whose delta is within the cutoff points to that denser lead; one whose delta is
  greater, or that has no denser lead within the horizon, is chosen as a peak. Every lead gets the peak that its
  pointers lead to (:func:`follow`).
* *Touching peaks.* Where a record of one peak's basin is alike to a record of another's, the less dense of the peaks
  points to the denser, and the pointers are followed as those of records are (:func:`climb`), until no basin touches a
  denser one. Blocks whose records all follow one peak are skipped. Balls whose leads are farther apart than the
  cutoff but whose members may be alike are settled by the members that face each other.

A cluster is what follows one last peak. Peaks, basins and pointers depend on the densities; which vectors end in one
cluster doesn't: these are exactly the vectors linked, directly or through others, by distances within the cutoff.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantell.functions.vectors import lists, matrix, usable
from quantell.llm.blocks import Tree, fit_tree, homes, squared
from quantell.plans.shared import discard, written

#: Rows that are compared with as many others at a time.
STEP = 2048
#: How far, in cutoffs, the nearest denser lead is searched.
HORIZON = 1.5
#: Leads of a leaf, visitors included, above which it is divided into parts that meet in pairs.
MEET_ROWS = 32_768
#: Members of a ball that face another ball above which they are divided; also the rows of a task of small balls.
FACE_ROWS = 4096


def _cover(x: np.ndarray, radius: float) -> np.ndarray:
    """For each row the row that leads its ball: every row lies within ``radius`` of its lead."""
    x = x.astype(np.float64)
    near32 = (x - x.mean(0) if len(x) else x).astype(np.float32)
    lead = np.full(len(x), -1, np.int64)
    leads: list[int] = []
    r2 = radius * radius
    for i in range(0, len(x), 512):
        own = x[i : i + 512]
        if leads:
            at = np.asarray(leads)[squared(near32[i : i + 512], near32[leads]).argmin(1)]
            hit = ((own - x[at]) ** 2).sum(1) <= r2
            lead[i : i + 512][hit] = at[hit]
        free = np.flatnonzero(lead[i : i + 512] < 0)
        if len(free):
            rows = near32[i + free]
            size = (rows * rows).sum(1)
            maybe = squared(rows, rows) <= np.float32(r2) + np.float32(1e-5) * (size[:, None] + size[None]) + np.float32(1e-6)
            left = np.ones(len(free), bool)
            for j in range(len(free)):
                if left[j]:
                    mine = np.flatnonzero(maybe[j] & left)
                    mine = mine[((own[free[mine]] - own[free[j]]) ** 2).sum(1) <= r2]
                    lead[i + free[mine]] = i + free[j]
                    left[mine] = False
                    left[j] = False
                    lead[i + free[j]] = i + free[j]
                    leads.append(i + int(free[j]))
    return lead


def _balls(rows: DataFrame, dim: int, cutoff: float) -> DataFrame:
    """``(id, x, lead, dist, n, radius)``; n and radius of the ball on the lead's own row, else null."""

    def ball(t: pa.Table) -> pa.Table:
        x = matrix(t.column("x"), dim, np.float64)
        ids = t.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        x, ids = x[order], ids[order]
        lead = _cover(x, cutoff / 2)
        dist = np.sqrt(((x - x[lead]) ** 2).sum(1))
        n = np.bincount(lead, minlength=len(x))
        radius = np.zeros(len(x))
        np.maximum.at(radius, lead, dist)
        return pa.table({
            "id": ids, "x": lists(x), "lead": ids[lead], "dist": dist,
            "n": pa.array(n, pa.int64(), mask=n == 0), "radius": pa.array(radius, mask=n == 0),
        })

    return rows.groupBy("leaf", "part").applyInArrow(ball, "id long, x array<float>, lead long, dist double, n long, radius double")


def _routed(leads: DataFrame, tree: Tree, dim: int, cutoff: float, parts: np.ndarray | None = None) -> DataFrame:
    """Each lead in its home leaf, and as a visitor in the later leaves that may hold a lead within its reach.

    ``parts``: how many parts the leads of each leaf are divided into; a lead then comes once for every part that its
    own part meets, ``i`` and ``j`` being the two parts, ``mine`` whether its own is j and not i.
    """
    shared = leads.sparkSession.sparkContext.broadcast((tree, parts))  # bounded by the sample it was fitted on
    cols = leads.columns

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, many = shared.value
        for b in batches:
            y = t.project(matrix(b.column(cols.index("x")), dim))
            home = t.home(y)
            reach = HORIZON * cutoff + b.column(cols.index("radius")).to_numpy()  # the other ball's radius is at most cutoff / 2
            row, leaf = t.reached(y, reach)
            keep = leaf >= home[row]
            row, leaf = row[keep], leaf[keep]
            p = np.ones(len(row), np.int64) if many is None else many[leaf]
            ids = b.column(cols.index("id")).to_numpy()[row].astype(np.uint64)
            own = ((ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % p
            other = np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p)
            row, leaf, own = np.repeat(row, p), np.repeat(leaf, p), np.repeat(own, p)
            out = b.take(pa.array(row))
            more = [leaf.astype(np.int32), leaf == home[row], np.minimum(own, other).astype(np.int32), np.maximum(own, other).astype(np.int32), own > other]
            yield pa.RecordBatch.from_arrays([*out.columns, *(pa.array(c) for c in more)], [*cols, "leaf", "at_home", "i", "j", "mine"])

    kinds = ", ".join(f"`{c}` {k}" for c, k in leads.dtypes)
    return leads.mapInArrow(route, f"{kinds}, leaf int, at_home boolean, i int, j int, mine boolean")


def _parts(leads: DataFrame, tree: Tree, dim: int, cutoff: float) -> np.ndarray:
    """Into how many parts the leads of each leaf are divided: one row per leaf of the tree is collected."""
    many = np.ones(len(tree.parts), np.int64)
    for r in _routed(leads.select("id", "x", "radius"), tree, dim, cutoff).groupBy("leaf").count().collect():
        many[r["leaf"]] = -(-r["count"] // MEET_ROWS)
    return many


class Meeting:
    """The leads that meet in one task, and their pairs of which at least one is at home; each pair comes once."""

    def __init__(self, t: pa.Table, dim: int, label: np.ndarray | None = None):
        home, ids = t.column("at_home").to_numpy().astype(bool), t.column("id").to_numpy()
        mine, cross = t.column("mine").to_numpy().astype(bool), t.num_rows > 0 and t.column("i")[0] != t.column("j")[0]
        label = np.zeros(len(ids), np.int64) if label is None else label
        order = np.lexsort((ids, label, ~home))
        self.t = t.take(pa.array(order))
        self.ids, self.label = ids[order], label[order]
        self.radius = self.t.column("radius").to_numpy()
        self.exact = matrix(self.t.column("x"), dim, np.float64)
        if len(ids):
            self.exact = self.exact - self.exact.mean(0)
        self.x = self.exact.astype(np.float32)
        self.size = (self.x * self.x).sum(1)
        home, mine, rows = home[order], mine[order], np.arange(len(ids))
        if cross:
            self.sides = [(rows[home & ~mine], rows[mine], False), (rows[~home & ~mine], rows[home & mine], False)]
        else:
            self.sides = [(rows[home], rows, True)]

    def pairs(self, reach: Callable[[np.ndarray, np.ndarray], np.ndarray], unlike: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(row, row, distance)`` with distance <= reach, recomputed in double precision.

        ``unlike``: only pairs of different labels; blocks of one label are passed over.
        """
        for one, two, same in self.sides:
            for i in range(0, len(one), STEP):
                p = one[i : i + STEP]
                for j in range(i if same else 0, len(two), STEP):
                    q = two[j : j + STEP]
                    if unlike and self.label[p[0]] == self.label[q[0]] and (self.label[p] == self.label[p[0]]).all() and (self.label[q] == self.label[p[0]]).all():
                        continue
                    limit = reach(p[:, None], q[None]) ** 2 + 1e-5 * (self.size[p][:, None] + self.size[q][None]) + 1e-6
                    a, b = np.nonzero(squared(self.x[p], self.x[q]) <= limit.astype(np.float32))
                    a, b = p[a], q[b]
                    keep = (a < b) if same else np.ones(len(a), bool)
                    if unlike:
                        keep &= self.label[a] != self.label[b]
                    a, b = a[keep], b[keep]
                    if len(a):
                        d = np.sqrt(((self.exact[a] - self.exact[b]) ** 2).sum(1))
                        keep = d <= reach(a, b)
                        yield a[keep], b[keep], d[keep]


def _meetings(routed: DataFrame, work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work`` on the leads of every leaf, or of every two parts of a leaf; its batches leave as they come."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(pa.Table.from_batches(list(batches)))

    return routed.groupBy("leaf", "i", "j").applyInArrow(each, schema)


def _densities(routed: DataFrame, dim: int, cutoff: float) -> DataFrame:
    """``(id, w)``: weight of the leads within the cutoff, partial by task."""

    def count(t: pa.Table) -> Iterator[pa.RecordBatch]:
        m = Meeting(t, dim)
        n, w = m.t.column("n").to_numpy(), np.zeros(t.num_rows, np.int64)
        for a, b, _ in m.pairs(lambda a, b: np.float64(cutoff)):
            np.add.at(w, a, n[b])
            np.add.at(w, b, n[a])
        some = w > 0
        yield pa.RecordBatch.from_pydict({"id": m.ids[some], "w": w[some]})

    return _meetings(routed, count, "id long, w long")


def _denser(routed: DataFrame, dim: int, cutoff: float) -> DataFrame:
    """``(id, other, d)``: the nearest denser lead within the horizon, of those met in each task."""

    def nearest(t: pa.Table) -> Iterator[pa.RecordBatch]:
        m = Meeting(t, dim)
        rho, ids = m.t.column("rho").to_numpy(), m.ids
        best_d, best = np.full(len(ids), np.inf), np.full(len(ids), -1, np.int64)
        for a, b, d in m.pairs(lambda a, b: np.float64(HORIZON * cutoff)):
            up = (rho[b] > rho[a]) | ((rho[b] == rho[a]) & (ids[b] < ids[a]))
            low, high = np.where(up, a, b), np.where(up, b, a)
            order = np.lexsort((ids[high], d, low))
            low, high, dd = low[order], high[order], d[order]
            first = np.ones(len(low), bool)
            first[1:] = low[1:] != low[:-1]
            low, high, dd = low[first], high[first], dd[first]
            better = (dd < best_d[low]) | ((dd == best_d[low]) & (ids[high] < ids[best[low]]))
            best_d[low[better]], best[low[better]] = dd[better], high[better]
        has = np.flatnonzero(best >= 0)
        yield pa.RecordBatch.from_pydict({"id": ids[has], "other": ids[best[has]], "d": best_d[has]})

    return _meetings(routed, nearest, "id long, other long, d double")


def follow(pointers: DataFrame) -> DataFrame:
    """``(id, peak)``: where the pointers ``(id, other)`` lead, of every id that has one.

    By doubling, so it ends after the logarithm of the longest chain. Each pointer goes to a denser record, so there are no circles.
    """
    before = now = written(pointers.select("id", F.col("other").alias("peak")))
    while True:
        ahead = now.select(F.col("id").alias("peak"), F.col("peak").alias("next"))
        joined = written(now.join(ahead, "peak", "left").select("id", F.coalesce("next", "peak").alias("peak"), F.col("next").isNotNull().alias("moved")))
        discard(before)
        before, now = joined, joined.select("id", "peak")
        if joined.where("moved").isEmpty():
            return now


def _join_trees(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of ``parent`` that the links touch; afterwards every node points to the least of its tree."""
    while len(a):
        u, v = parent[a], parent[b]
        apart = u != v
        a, b, u, v = a[apart], b[apart], u[apart], v[apart]
        np.minimum.at(parent, np.maximum(u, v), np.minimum(u, v))
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]


def _borders(routed: DataFrame, dim: int, cutoff: float) -> DataFrame:
    """``(a, ra, b, rb, id, other)``. Without id: peak a's basin touches that of the denser peak b, directly or through
    others of this task. With id and other: leads of the basins of a and b whose balls reach each other though they are
    farther apart than the cutoff, unless their peaks are linked in this task already."""

    def border(t: pa.Table) -> Iterator[pa.RecordBatch]:
        peak, prho = t.column("peak").to_numpy(), t.column("prho").to_numpy()
        # peaks by falling density, so that the least number of joined peaks is the densest
        order = np.lexsort((peak, -prho))
        first = np.ones(len(order), bool)
        first[1:] = peak[order][1:] != peak[order][:-1]
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(first) - 1
        names, dense = peak[order][first], prho[order][first]
        m = Meeting(t, dim, number)
        parent = np.arange(len(names))
        for a, b, _ in m.pairs(lambda a, b: np.float64(cutoff), unlike=True):
            _join_trees(parent, m.label[a], m.label[b])
        low = np.flatnonzero(parent != np.arange(len(names)))
        high = parent[low]
        none = pa.nulls(len(low), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (names[low], dense[low], names[high], dense[high])] + [none, none], ["a", "ra", "b", "rb", "id", "other"])
        if not m.radius.any():
            return
        for a, b, d in m.pairs(lambda a, b: cutoff + m.radius[a] + m.radius[b], unlike=True):
            p, q = m.label[a], m.label[b]
            open_ = (d > cutoff) & (parent[p] != parent[q])
            a, b, p, q = a[open_], b[open_], p[open_], q[open_]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (names[p], dense[p], names[q], dense[q], m.ids[a], m.ids[b])], ["a", "ra", "b", "rb", "id", "other"])

    return _meetings(routed, border, "a long, ra long, b long, rb long, id long, other long")


def _raised(df: DataFrame, moved: DataFrame, peak: str = "peak", rho: str = "rho") -> DataFrame:
    """``df`` with a peak and its density replaced by what the peak has followed; ``moved`` is ``(id, peak, rho)``."""
    to = moved.select(F.col("id").alias(peak), F.col("peak").alias("to"), F.col("rho").alias("to_rho"))
    return df.join(to, peak, "left").withColumns({peak: F.coalesce("to", peak), rho: F.coalesce("to_rho", rho)}).select(*df.columns)


def climb(links: DataFrame) -> DataFrame:
    """``(id, peak, rho)``: the last peak of every peak of the links ``(a, ra, b, rb)`` between touching peaks and their densities.

    Each peak points to the densest that it touches, if that one is denser than itself (ties: the smaller id), and the
    pointers are followed; then the links are those between what the peaks have followed, until none are left. A peak
    that can't move has taken in another or touches a denser one in the next round, so the number of rounds grows with
    the logarithm of the number of peaks.
    """
    links = written(links.select("a", "ra", "b", "rb").where("a <> b").distinct())
    top = links.select(F.col("a").alias("id"), F.col("b").alias("peak"), F.col("rb").alias("rho")).limit(0)
    while not links.isEmpty():
        both = links.union(links.select("b", "rb", "a", "ra"))
        best = both.groupBy("a", "ra").agg(F.max(F.struct(F.col("rb").alias("r"), (-F.col("b")).alias("b"))).alias("m"))
        up = best.where((F.col("m.r") > F.col("ra")) | ((F.col("m.r") == F.col("ra")) & (-F.col("m.b") < F.col("a"))))
        followed = follow(up.select(F.col("a").alias("id"), (-F.col("m.b")).alias("other")))
        heights = both.select(F.col("a").alias("peak"), F.col("ra").alias("rho")).distinct()
        moved = written(followed.join(heights, "peak").select("id", "peak", "rho"))
        if moved.isEmpty():
            break
        top = written(_raised(top, moved).union(moved))  # who moves in this round hasn't moved before
        before, links = links, written(_raised(_raised(links, moved, "a", "ra"), moved, "b", "rb").where("a <> b").distinct())
        discard(before)
    return top


def _facing(candidates: DataFrame, balls: DataFrame, leads: DataFrame, dim: int, cutoff: float) -> DataFrame:
    """``(id, other)`` of the candidate balls that hold alike members.

    Of a ball only members far enough towards the other lead can be alike to a member of the other ball; they are few.
    Small balls are settled many in a task; of large ones parts meet in tasks of their own.
    """
    a = leads.select("id", F.col("x").alias("xa"), F.col("radius").alias("ra"))
    b = leads.select(F.col("id").alias("other"), F.col("x").alias("xb"), F.col("radius").alias("rb"))
    both = candidates.join(a, "id").join(b, "other")
    one = both.select("id", "other", F.lit(True).alias("first"), F.col("id").alias("lead"), F.col("xa").alias("own"), F.col("xb").alias("far"), F.col("rb").alias("r"))
    two = both.select("id", "other", F.lit(False).alias("first"), F.col("other").alias("lead"), F.col("xb").alias("own"), F.col("xa").alias("far"), F.col("ra").alias("r"))
    members = balls.select("lead", "x", F.col("id").alias("member")).join(one.union(two), "lead")

    def front(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m in batches:
            own, far, x = (matrix(m.column(k), dim, np.float64) for k in (4, 5, 7))
            gap = np.sqrt(((far - own) ** 2).sum(1))
            r = m.column(6).to_numpy()
            ahead = ((x - own) * (far - own)).sum(1) / np.maximum(gap, 1e-30)
            slack = 1e-6 + 1e-9 * gap
            keep = (ahead + r >= gap - cutoff - slack) & (np.sqrt(((x - far) ** 2).sum(1)) <= cutoff + r + slack)
            yield pa.RecordBatch.from_arrays([m.column(k).filter(pa.array(keep)) for k in (0, 1, 2, 3, 7)], ["id", "other", "first", "member", "x"])

    cols = ["id", "other", "first", "member", "own", "far", "r", "x"]
    facing = written(members.select(*cols).mapInArrow(front, "id long, other long, first boolean, member long, x array<float>"))
    counts = facing.groupBy("id", "other").agg(F.count_if("first").alias("na"), F.count_if(~F.col("first")).alias("nb")).where("na > 0 AND nb > 0")
    tasks = max(1, facing.count() // FACE_ROWS)
    na, nb = (F.ceil(F.col(c) / FACE_ROWS).cast("int") for c in ("na", "nb"))
    big = (na > 1) | (nb > 1)
    bucket = F.when(big, F.lit(-1)).otherwise(F.pmod(F.xxhash64("id", "other"), F.lit(tasks)).cast("int"))
    meet = counts.select("id", "other", na.alias("na"), nb.alias("nb"), bucket.alias("bucket"), F.when(big, F.col("id")).alias("ka"), F.when(big, F.col("other")).alias("kb"))
    rows = facing.join(meet, ["id", "other"]).withColumn("own", F.pmod(F.xxhash64("member"), F.when(F.col("first"), F.col("na")).otherwise(F.col("nb"))).cast("int"))
    rows = rows.withColumn("met", F.explode(F.sequence(F.lit(0), F.when(F.col("first"), F.col("nb")).otherwise(F.col("na")) - 1)))
    rows = rows.withColumns({"i": F.when(F.col("first"), F.col("own")).otherwise(F.col("met")), "j": F.when(F.col("first"), F.col("met")).otherwise(F.col("own"))})

    def alike(t: pa.Table) -> pa.Table:
        a, b, first = t.column("id").to_numpy(), t.column("other").to_numpy(), t.column("first").to_numpy().astype(bool)
        order = np.lexsort((~first, b, a))
        x, a, b, first = matrix(t.column("x"), dim, np.float64)[order], a[order], b[order], first[order]
        edge = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]), [True]]))
        found = []
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            k = s + int(first[s:e].sum())
            p, q = x[s:k], x[k:e]
            if any((((p[i : i + 256, None] - q[None, j : j + 256]) ** 2).sum(2) <= cutoff * cutoff).any() for i in range(0, len(p), 256) for j in range(0, len(q), 256)):
                found.append(s)
        return pa.table({"id": a[found], "other": b[found]}) if found else t.select(["id", "other"]).slice(0, 0)

    out = rows.select("bucket", "ka", "kb", "i", "j", "id", "other", "first", "x").groupBy("bucket", "ka", "kb", "i", "j").applyInArrow(alike, "id long, other long")
    return out.distinct()


def density_clusters(df: DataFrame, id_col: str, vector_col: str, cutoff: float, dim: int = 30) -> DataFrame:
    """``(id, cluster, lead, peak, density, delta, dist)`` for every id with a usable vector.

    ``cluster`` is the least id of the cluster: vectors within ``cutoff`` of each other, directly or through others.
    ``peak`` is the peak that the vector's lead points to, ``density`` the weight around its lead, ``delta`` the
    distance from its lead to the nearest denser one (null: none within the horizon), ``dist`` the distance to its lead.
    Rows with a null id or a vector that isn't usable (null, other length, a value null or not finite, all zero) are
    left out. Of several vectors with the same id the least counts. Ties of distance go to the smaller id. An empty
    table gives an empty result; other columns are ignored.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("x"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("x"), dim)).groupBy("id").agg(F.min("x").alias("x"))
    rows = written(rows)
    tree = fit_tree(rows, "id", "x", dim, cutoff)
    balls = written(_balls(homes(rows, tree, "id", "x", dim), dim, cutoff))
    discard(rows)  # the balls hold the vectors from here on
    leads = balls.where("n IS NOT NULL").select("id", "x", "n", "radius")
    parts = _parts(leads, tree, dim, cutoff)
    weights = _densities(_routed(leads, tree, dim, cutoff, parts), dim, cutoff).groupBy("id").agg(F.sum("w").alias("w"))
    dense = written(leads.join(weights, "id", "left").select("id", "x", "radius", (F.col("n") + F.coalesce("w", F.lit(0))).alias("rho")))
    nearest = _denser(_routed(dense, tree, dim, cutoff, parts), dim, cutoff).groupBy("id").agg(F.min(F.struct("d", "other")).alias("m"))
    nearest = written(nearest.select("id", "m.other", F.col("m.d").alias("delta")))
    peaks = follow(nearest.where(F.col("delta") <= cutoff))
    heights = dense.join(peaks.select(F.col("peak").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("peak"), F.col("rho").alias("prho"))
    based = peaks.join(heights, "peak").select("id", "peak", "prho")
    based = written(dense.join(based, "id", "left").withColumns({"peak": F.coalesce("peak", "id"), "prho": F.coalesce("prho", "rho")}))
    borders = written(_borders(_routed(based.drop("rho"), tree, dim, cutoff, parts), dim, cutoff))
    tops = climb(borders.where("id IS NULL"))

    unsure = written(_raised(_raised(borders.where("id IS NOT NULL"), tops, "a", "ra"), tops, "b", "rb").where("a <> b"))
    if not unsure.isEmpty():
        found = _facing(unsure.select("id", "other").distinct(), balls, based, dim, cutoff)
        last = climb(unsure.join(found, ["id", "other"], "left_semi"))
        tops = _raised(tops, last).union(last)
    labels = based.select("id", "rho", "peak").join(nearest.select("id", "delta"), "id", "left")
    labels = labels.join(tops.select(F.col("id").alias("peak"), F.col("peak").alias("top")), "peak", "left")
    labels = labels.select(F.col("id").alias("lead"), "peak", F.col("rho").alias("density"), "delta", F.coalesce("top", "peak").alias("group"))
    placed = balls.select("id", "lead", "dist").join(labels, "lead")
    names = placed.groupBy("group").agg(F.min("id").alias("cluster"))
    return placed.join(names, "group").select("id", "cluster", "lead", "peak", "density", "delta", "dist")


def describe_clusters(members: DataFrame, labels: DataFrame, id_col: str, label: str, typical: int = 3, least: int = 2) -> DataFrame:
    """A row per cluster of ``least`` or more: size, the most typical members with their labels, and its main label.

    The most typical members are those of the densest ball, nearest to its lead first. Members without a label count
    as null; of several labels of an id the least counts.
    """
    names = labels.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label).alias("label"))
    rows = members.join(names, "id", "left")
    sizes = rows.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    main = sizes.groupBy("cluster").agg(F.sum("n").alias("size"), F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("m"))
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("density"), "lead", "dist", "id"))
    top = rows.withColumn("place", place).where(F.col("place") <= typical)  # partitions keep their own first rows only
    top = top.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("place", "id", "label"))).alias("t"))
    out = main.where(F.col("size") >= least).join(top, "cluster")
    return out.select(
        F.col("cluster").alias("lead_cell"), "size", F.col("m.label").alias("main_label"), F.round(-F.col("m.n") / F.col("size"), 6).alias("main_share"),
        F.col("t.id").alias("typical_cells"), F.col("t.label").alias("typical_labels"),
    )
