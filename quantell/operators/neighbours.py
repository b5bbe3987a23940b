"""Nearest neighbours, mutual neighbours, anchors and diffusion over neighbour graphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantell.experiment import Experiment
from quantell.functions.nearest import fit_tree, gaps, nearest, place
from quantell.functions.vectors import matrix
from quantell.operators.communities import leiden
from quantell.operators.expression import div
from quantell.plans.shared import discard, settled, written

#: Rows of a tile of the exact search, up to 64 columns.
TILE = 32_768
#: Regions that a task of the second pass takes.
GROUP = 5
#: Rows of an area, about, at most.
AREA = 4096
#: About as many rows, at most, does the tree of the regions see.
SAMPLE = 50_000
#: Digits at which distances count as tied, so that ties are settled by id on every platform.
DIGITS = 6


def _dim(vectors: DataFrame, col: str = "vec") -> int:
    r = vectors.where(F.col(col).isNotNull()).select(F.size(col).alias("d")).first()
    return r.d if r else 1


def knn(queries: DataFrame, base: DataFrame | None = None, k: int = 15, include_self: bool = False, cosine: bool = False, tile: int = TILE, within: str | None = None) -> DataFrame:
    """``src, dst, dist, place``: the ``k`` nearest rows of ``base`` to each query, exact, ties by id.

    Both are ``(cell_id, vec)``. A base of more than ``tile`` rows is divided into regions of about as many by a tree over its
    columns, fitted on a sample. A query is searched in its own region, and then in those others whose box is as near as its
    ``k``-th neighbour so far, see :func:`_in_regions`. Work depends on how many regions that are: few in a few dimensions or with many equal rows, up to
    the product of both sizes where all rows are about as far from each other.

    ``within``: a column of both; only rows that share its value are compared, in tiles of that value, a frequent value
    in several. Rows without a value have no neighbours. These tiles, and those of the cosine distance, are cut by a hash; all
    pairs of them meet.
    """
    base = queries if base is None else base
    dim = _dim(base)
    tile = min(tile, max(4096, TILE * 64 // dim))
    if within:
        key = [F.col(within).alias("g")]
        sizes = base.groupBy(*key).agg(F.ceil(F.count("*") / tile).cast("int").alias("nb")).join(queries.groupBy(*key).agg(F.ceil(F.count("*") / tile).cast("int").alias("nq")), "g")
    else:
        key = [F.lit(0).alias("g")]
        n_base = base.agg(F.count("*")).first()[0]
        if n_base > tile and not cosine:
            return _placed(near_lists(queries, base, k, include_self, tile))
        counts = n_base, queries.agg(F.count("*")).first()[0]
        nb, nq = (max(1, -(-c // tile)) for c in counts)

    def tiles(df: DataFrame, own: str, other: str) -> DataFrame:
        df = df.where(F.col("vec").isNotNull()).select(*key, "cell_id", F.col("vec").cast("array<double>").alias("vec"))
        df = df.join(sizes, "g") if within else df.withColumns({"nb": F.lit(nb), "nq": F.lit(nq)})
        return df.withColumn(own, F.pmod(F.xxhash64("cell_id"), F.col(f"n{own}"))).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"n{other}") - 1)))

    q = tiles(queries, "q", "b").withColumns({"side": F.lit(0), "bound": F.lit(float("inf"))})
    b = tiles(base, "b", "q").withColumns({"side": F.lit(1), "bound": F.lit(float("inf"))})
    return _by_place(_meet(q, b, ["g", "q", "b"], k, include_self, dim, cosine), k)


def near_lists(queries: DataFrame, base: DataFrame | None = None, k: int = 15, include_self: bool = False, tile: int = TILE, rows: Rows | None = None, most: int | None = None) -> DataFrame:
    """``src, dst, dist``, a row per query with lists in order: what :func:`knn` finds. ``rows``: how base, then with a column ``asked`` for
    the queries, keeps its vectors. With ``most`` also ``area`` and ``areas``; see :func:`_in_regions`."""
    if rows is None:
        rows, kind = Rows(_dim(queries if base is None else base)), F.col("vec").cast("array<double>").alias("vec")
        own = (queries if base is None else base).select("cell_id", kind, F.lit(True).alias("asked"))
        queries = None if base is None or base is queries else queries.select("cell_id", kind)
    else:
        own, queries = base, None
    tile = min(tile, max(4096, TILE * 64 // rows.dim))
    return _in_regions(queries, own, k, include_self, tile, max(1, own.agg(F.count("*")).first()[0]), rows, most)


def _by_place(near: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))
    return near.withColumn("place", place).where(F.col("place") <= k)


def _placed(lists: DataFrame) -> DataFrame:
    """``src, dst, dist, place`` of ``(src, dst, dist)`` with lists of neighbours in order."""
    one = lists.select("src", F.posexplode(F.arrays_zip("dst", "dist")).alias("i", "n"))
    return one.select("src", F.col("n.dst").alias("dst"), F.col("n.dist").alias("dist"), (F.col("i") + 1).alias("place"))


def _listed(near: DataFrame) -> DataFrame:
    """``src, dst, dist`` of ``(src, dst, dist)``, the ``k`` neighbours of a row as lists in order."""
    per = near.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dist", "dst"))).alias("n"))
    return per.select("src", F.col("n.dst").alias("dst"), F.col("n.dist").alias("dist"))


def _meet(q: DataFrame, b: DataFrame, keys: list[str], k: int, include_self: bool, dim: int, cosine: bool = False) -> DataFrame:
    """``src, dst, dist``: per query and group of ``keys`` the ``k`` nearest within ``bound``; q and b have keys, side (0, 1), cell_id, vec, bound."""
    kind = dict(q.dtypes)["cell_id"]

    def near(t: pa.Table) -> pa.Table:
        side, ids, x = t.column("side").to_numpy(), t.column("cell_id").to_numpy(), matrix(t.column("vec"), dim, np.float64)
        if cosine:
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        ids, a, row, to, dist = _found(ids, x, np.flatnonzero(side == 0), np.flatnonzero(side == 1), k, include_self, t.column("bound").to_numpy(), cosine)
        key = t.schema.field("cell_id").type
        return pa.table({"src": pa.array(ids[a][row]).cast(key), "dst": pa.array(ids[to]).cast(key), "dist": pa.array(dist, pa.float64())})

    cols = [*keys, "side", "cell_id", "vec", "bound"]
    return q.select(*cols).union(b.select(*cols)).groupBy(*keys).applyInArrow(near, f"src {kind}, dst {kind}, dist double")


def _found(ids: np.ndarray, x: np.ndarray, a: np.ndarray, c: np.ndarray, k: int, include_self: bool, bound: np.ndarray | None = None, cosine: bool = False) -> tuple[np.ndarray, ...]:
    """``ids, a``, and of each neighbour the place in ``a``, that in ``ids``, and the distance, in order: of rows ``a`` among rows ``c``."""
    c = c[np.argsort(ids[c], kind="stable")]  # equal distances stay in order of ids
    numbers = None
    if not include_self and len(c):
        names, of = np.unique(ids[c], return_inverse=True)
        at = np.minimum(np.searchsorted(names, ids[a]), len(names) - 1)
        numbers = np.where(names[at] == ids[a], at, -1), of
    row, to, dist = nearest(x[a], x[c], k, numbers, None if bound is None else bound[a], cosine, DIGITS)
    return ids, a, row, c[to], dist


class Rows:
    """How a table keeps its vectors: the columns, and ``read``, which makes a matrix of them in a task."""

    def __init__(self, dim: int, cols: tuple[str, ...] = ("vec",)):
        self.dim, self.cols = dim, list(cols)

    def read(self, t: pa.Table | pa.RecordBatch) -> np.ndarray:
        return matrix(t.column(self.cols[0]), self.dim, np.float64)


class Counts(Rows):
    """Counts as lists of places ``at`` and values ``x``, repeated places adding up, that are read as log-normalised rows."""

    def __init__(self, dim: int):
        super().__init__(dim, ("at", "x"))

    def read(self, t: pa.Table | pa.RecordBatch) -> np.ndarray:
        at, x = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in map(t.column, self.cols))
        row = np.repeat(np.arange(len(at)), at.value_lengths().to_numpy(zero_copy_only=False))
        out = np.bincount(row * self.dim + at.flatten().to_numpy(), x.flatten().to_numpy(), len(at) * self.dim).reshape(-1, self.dim)
        total = out.sum(1, keepdims=True)
        return np.log1p(np.divide(out * 1e4, total, out=np.zeros_like(out), where=total != 0))


def _lists_of(row: np.ndarray, n: int, *cols: pa.Array) -> list[pa.Array]:
    """Columns of lists, one per row 0 … n - 1; ``row`` is sorted."""
    at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]), pa.int32())
    return [pa.ListArray.from_arrays(at, c) for c in cols]


def _in_regions(queries: DataFrame | None, base: DataFrame, k: int, include_self: bool, tile: int, n_base: int, rows: Rows, most: int | None = None) -> DataFrame:
    """``src, dst, dist``: the ``k`` nearest rows of each query as lists in order; see :func:`knn`. Without ``queries`` they are the rows of base
    that are ``asked``.

    Each region is searched for its own queries first. Where no other region's box is as near as the ``k``-th found, that's it; the
    other queries are sought within this bound in groups of ``GROUP`` regions. A vector is shuffled once for that, and a
    query's neighbours stay together as a row.

    Regions are numbered along the tree, so neighbours in number are near; one that equal rows make too large is several, by
    a hash. The driver holds the tree and a box per region, tasks a row per region. With ``most`` columns ``area`` and ``areas`` say
    in which areas of about as many rows the query and its neighbours are; see :func:`areas`.
    """
    spark, kind, dim, cols = base.sparkSession, dict(base.dtypes)["cell_id"], rows.dim, rows.cols
    kinds = ", ".join(f"{c} {dict(base.dtypes)[c]}" for c in cols)
    there = lambda df: df.where(" AND ".join(f"{c} IS NOT NULL" for c in cols))
    base, queries = settled(base), None if queries is None else settled(queries)
    cut = int(min(1.0, SAMPLE / n_base) * (1 << 30))
    x = rows.read(there(base).where(F.pmod(F.xxhash64("cell_id", F.lit(0)), F.lit(1 << 30)) <= cut).select(*cols).toArrow())
    x = x[np.lexsort(x.T)]
    tree, fine = (fit_tree(x, max(1, m * len(x) // n_base)) for m in (tile, most or tile))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = rows.read(b)
            home = place(x, tree)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home), pa.array(place(x, fine) if most else home)], [*b.schema.names, "home", "area"])

    own = there(base).select("cell_id", *cols, (F.when(F.col("asked"), 1).otherwise(0) if queries is None else F.lit(0)).cast("tinyint").alias("role"))
    if queries is not None:
        own = own.union(there(queries).select("cell_id", *cols, F.lit(2).cast("tinyint").alias("role")))
    own = own.withColumn("h", F.pmod(F.xxhash64("cell_id", F.lit(1)), F.lit(1 << 20)).cast("int"))
    b = own.mapInArrow(go, f"cell_id {kind}, {kinds}, role tinyint, h int, home int, area int")  # places are found again rather than kept

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}
        for b in batches:
            x, of, role = rows.read(b), b.column("home").to_numpy(), b.column("role").to_numpy()
            for r, n in zip(*np.unique(of[role == 2], return_counts=True), strict=True):
                seen.setdefault(r, [0, 0, np.full(dim, np.inf), np.full(dim, -np.inf)])[1] += int(n)
            x, of = x[role < 2], of[role < 2]
            order = np.argsort(of, kind="stable")
            x, (names, begin, n) = x[order], np.unique(of[order], return_index=True, return_counts=True)
            low, high = (f.reduceat(x, begin, axis=0) if len(x) else x for f in (np.minimum, np.maximum))
            for i, r in enumerate(names):
                got = seen.setdefault(r, [0, 0, np.full(dim, np.inf), np.full(dim, -np.inf)])
                got[0] += int(n[i])
                got[2], got[3] = np.minimum(got[2], low[i]), np.maximum(got[3], high[i])
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        table = [list(seen), *([v[i] for v in seen.values()] for i in range(4))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(table, kinds, strict=True)], ["home", "n", "asked", "lo", "hi"])

    found = b.select(*cols, "home", "role").mapInArrow(boxes, "home int, n long, asked long, lo array<double>, hi array<double>").toArrow()
    home = found.column("home").to_numpy()
    last = int(home.max(initial=0)) + 1
    size, asked = (np.bincount(home, found.column(c).to_numpy(), last) for c in ("n", "asked"))
    lo, hi = np.full((last, dim), np.inf), np.full((last, dim), -np.inf)
    np.minimum.at(lo, home, matrix(found.column("lo"), dim, np.float64))
    np.maximum.at(hi, home, matrix(found.column("hi"), dim, np.float64))
    parts = np.maximum(1, np.ceil(size / (1.5 * tile))).astype(int)
    first = np.cumsum(parts) - parts
    chunks = np.maximum(1, np.ceil(asked / (2 * tile))).astype(int)  # of queries that aren't rows of base
    lo, hi = np.repeat(lo, parts, axis=0), np.repeat(hi, parts, axis=0)
    groups = min(len(lo), max(4, -(-n_base // (GROUP * tile))))
    table = spark.createDataFrame([(i, int(first[i]), int(parts[i]), int(chunks[i])) for i in range(last)], "home int, first int, parts int, chunks int")
    region = (F.col("first") + F.col("h") % F.col("parts")).alias("region")
    part = F.floor(F.col("h") / F.col("parts"))
    b = b.join(F.broadcast(table), "home").select("cell_id", *cols, "role", "area", region, "chunks", part.alias("part"))  # a row per region is broadcast
    boxed = spark.sparkContext.broadcast((lo, hi, np.flatnonzero(np.repeat(size, parts))))
    digit = 10.0**-DIGITS

    def settle(t: pa.Table) -> pa.Table:
        """Of the queries of a region: their neighbours, or the vector and the groups to be sought in."""
        lo, hi, full = boxed.value
        here, role = t.column("region")[0].as_py(), t.column("role").to_numpy()
        ids, a, row, to, dist = _found(t.column("cell_id").to_numpy(), x := rows.read(t), np.flatnonzero(role > 0), np.flatnonzero(role < 2), k, include_self)
        n = np.bincount(row, minlength=len(a))
        bound = np.full(len(a), np.inf)
        bound[n >= k] = dist[np.cumsum(n)[n >= k] - 1]
        # equal rows have the same regions within reach: those of the greatest bound, which is the same unless some are few
        keys = np.hstack([x[a] + 0.0, bound[:, None]])
        one, code = np.unique(keys.view(np.dtype((np.void, keys.dtype.itemsize * keys.shape[1])))[:, 0], return_index=True, return_inverse=True)[1:] if len(a) else (a, a)
        others, groups_of = full[full != here], full * groups // len(lo)
        begin = np.flatnonzero(np.diff(groups_of, prepend=-1))
        reach, at = [np.zeros((0, len(begin)), bool)], 0
        while at < len(one):
            some = one[at : at + 1024]
            at += 1024
            near = np.zeros((len(some), len(lo)), bool)
            near[:, others] = gaps(x[a[some]], lo[others], hi[others]) <= ((bound[some] + digit) ** 2 * (1 + 1e-9))[:, None]
            wide = near.any(1)
            near[:, here] = wide
            reach.append(np.logical_or.reduceat(near[:, full], begin, axis=1) if len(full) else np.zeros((len(some), 0), bool))
        reach = np.concatenate(reach)
        open_ = reach.any(1)[code] if len(a) else np.zeros(0, bool)
        key = t.schema.field("cell_id").type
        i, j = np.nonzero(reach[code[open_]] if len(a) else reach)
        near = _lists_of(i, int(open_.sum()), pa.array(groups_of[begin][j], pa.int32()))[0]
        keep = ~open_[row]
        row, to, dist = (np.cumsum(~open_) - 1)[row[keep]], to[keep], dist[keep]
        area = t.column("area").to_numpy()
        dst, dist, areas = _lists_of(row, int((~open_).sum()), pa.array(ids[to]).cast(key), pa.array(dist, pa.float64()), pa.array(area[to], pa.int32()))
        some = t.take(pa.array(a[open_]))
        done = pa.table({"src": pa.array(ids[a[~open_]]).cast(key), "dst": dst, "dist": dist, "area": pa.array(area[a[~open_]], pa.int32()), "areas": areas})
        rest = pa.table({"src": some.column("cell_id"), "area": some.column("area"), **{c: some.column(c) for c in cols}, "near": near, "region": some.column("region"), "part": some.column("part"), "bound": pa.array(bound[open_], pa.float64())})
        both = pa.concat_tables([done, rest], promote_options="default")
        return both.select(["src", "dst", "dist", "area", "areas", *cols, "near", "region", "part", "bound"])

    to = b
    if chunks.max() > 1:
        to = to.withColumn("chunk", F.explode(F.when(F.col("role") == 2, F.array(F.col("part") % F.col("chunks"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1))))
    else:
        to = to.withColumn("chunk", F.lit(0))
    lists = f"src {kind}, dst array<{kind}>, dist array<double>, area int, areas array<int>"
    to = to.select("cell_id", *cols, "role", "area", "region", "part", "chunk")
    got = written(to.groupBy("region", "chunk").applyInArrow(settle, f"{lists}, {kinds}, near array<int>, region int, part long, bound double"))
    done = got.where("near IS NULL").select("src", "dst", "dist", "area", "areas")
    rest = got.where("near IS NOT NULL")
    waiting = {r.region: r.n for r in rest.groupBy("region").agg(F.count("*").alias("n")).collect()}  # a row per region
    if not waiting:
        return done
    lead = max(1, min(GROUP * tile, -(-sum(waiting.values()) // 3)))  # queries of a group of the second pass
    table, before = [], 0
    for r, n in sorted(waiting.items()):
        table.append((r, before // lead, -(-n // lead)))
        before += n
    leads = F.broadcast(spark.createDataFrame(table, "region int, lead int, leads int"))  # a row per region is broadcast
    led = rest.join(leads, "region").select(F.col("src").alias("cell_id"), *cols, F.explode("near").alias("group"), (F.col("lead") + F.col("part") % F.col("leads")).alias("lead"), "bound", "area", F.lit(2).cast("tinyint").alias("role"))
    group = F.floor(F.col("region") * groups / len(lo)).cast("int").alias("group")
    met = b.where("role < 2").select("cell_id", *cols, "area", group).join(led.select("group", "lead").distinct(), "group")
    met = met.select("cell_id", *cols, "group", "lead", F.lit(float("inf")).alias("bound"), "area", F.lit(0).cast("tinyint").alias("role"))

    def seek(t: pa.Table) -> pa.Table:
        role = t.column("role").to_numpy()
        ids, a, row, to, dist = _found(t.column("cell_id").to_numpy(), rows.read(t), np.flatnonzero(role == 2), np.flatnonzero(role < 2), k, include_self, t.column("bound").to_numpy())
        key, area = t.schema.field("cell_id").type, t.column("area").to_numpy()
        dst, dist, areas = _lists_of(row, len(a), pa.array(ids[to]).cast(key), pa.array(dist, pa.float64()), pa.array(area[to], pa.int32()))
        return pa.table({"src": pa.array(ids[a]).cast(key), "dst": dst, "dist": dist, "area": pa.array(area[a], pa.int32()), "areas": areas})

    sought = led.unionByName(met).groupBy("group", "lead").applyInArrow(seek, lists)
    near = F.slice(F.sort_array(F.flatten(F.collect_list(F.arrays_zip("dist", "dst", "areas")))), 1, k)
    sought = sought.groupBy("src").agg(near.alias("n"), F.first("area").alias("area"))
    return done.unionByName(written(sought.select("src", F.col("n.dst").alias("dst"), F.col("n.dist").alias("dist"), "area", F.col("n.areas").alias("areas"))))


def areas(vectors: DataFrame, most: int = AREA) -> DataFrame:
    """``cell_id, area``: the area of every row of ``(cell_id, vec)``, about ``most`` rows at most in each, cut by a tree over the columns that
    is fitted on a sample; areas are numbered along the tree, so those near in number are near."""
    dim, kind = _dim(vectors), dict(vectors.dtypes)["cell_id"]
    n = vectors.agg(F.count("*")).first()[0]
    rows = vectors.where(F.col("vec").isNotNull()).select("cell_id", F.col("vec").cast("array<double>").alias("vec"))
    cut = int(min(1.0, SAMPLE / max(n, 1)) * (1 << 30))
    x = matrix(rows.where(F.pmod(F.xxhash64("cell_id", F.lit(0)), F.lit(1 << 30)) <= cut).select("vec").toArrow().column("vec"), dim, np.float64)
    tree = fit_tree(x[np.lexsort(x.T)], max(1, most * len(x) // max(n, 1)))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(place(matrix(b.column(1), dim, np.float64), tree))], ["cell_id", "area"])

    return rows.mapInArrow(go, f"cell_id {kind}, area int")


def mutual_neighbours(a: DataFrame, b: DataFrame, k: int = 5) -> DataFrame:
    """``cell_a, cell_b, dist``: pairs each of which is among the other's ``k`` nearest across both sets."""
    ab, ba = knn(a, b, k, include_self=True), knn(b, a, k, include_self=True)
    back = ba.select(F.col("src").alias("cell_b"), F.col("dst").alias("cell_a"))
    return ab.select(F.col("src").alias("cell_a"), F.col("dst").alias("cell_b"), "dist").join(back, ["cell_a", "cell_b"], "left_semi")


def score_anchors(anchors: DataFrame, a: DataFrame, b: DataFrame, k: int = 30) -> DataFrame:
    """Anchors with ``shared`` (neighbours that both ends have in common, in either set) and ``score`` in [0, 1].

    The score is the count scaled between its 1st and 90th percentile.
    """

    def lists(src: DataFrame, dst: DataFrame) -> DataFrame:
        return knn(src, dst, k, include_self=True).groupBy("src").agg(F.collect_set("dst").alias("n"))  # k ids

    aa, ab = lists(a, a), lists(a, b)
    ba, bb = lists(b, a), lists(b, b)
    left = aa.withColumnRenamed("n", "aa").join(ab.withColumnRenamed("n", "ab"), "src").withColumnRenamed("src", "cell_a")
    right = ba.withColumnRenamed("n", "ba").join(bb.withColumnRenamed("n", "bb"), "src").withColumnRenamed("src", "cell_b")
    j = anchors.join(left, "cell_a").join(right, "cell_b")
    shared = F.size(F.array_intersect("aa", "ba")) + F.size(F.array_intersect("ab", "bb"))
    j = written(j.select("cell_a", "cell_b", "dist", shared.alias("shared")))
    q = j.agg(F.expr("percentile(shared, 0.01)").alias("lo"), F.expr("percentile(shared, 0.9)").alias("hi"))
    s = div(F.col("shared") - F.col("lo"), F.col("hi") - F.col("lo"))
    return j.join(F.broadcast(q)).withColumn("score", F.greatest(F.least(F.coalesce(s, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))).drop("lo", "hi")  # one row is broadcast


def filter_anchors(anchors: DataFrame, a: DataFrame, b: DataFrame, k: int = 200) -> DataFrame:
    """Anchors whose second end is among the ``k`` nearest of the first, on rows scaled to length 1."""
    near = knn(a, b, k, include_self=True, cosine=True).select(F.col("src").alias("cell_a"), F.col("dst").alias("cell_b"))
    return anchors.join(near, ["cell_a", "cell_b"], "left_semi")


def correct_by_anchors(query: DataFrame, ref: DataFrame, anchors: DataFrame, k: int = 100, sd: float = 1.0) -> DataFrame:
    """``cell_id, vec``: each query vector moved by the weighted mean of its nearest anchors' differences.

    ``anchors`` are (cell_a in ``query``, cell_b in ``ref``, score). Weights are ``1 - exp(-d * sd² / 4)`` with d the
    score times one less the distance relative to the farthest of the ``k`` anchors.
    """
    dim = _dim(query)
    diff = anchors.join(query.withColumnsRenamed({"cell_id": "cell_a", "vec": "va"}), "cell_a").join(ref.withColumnsRenamed({"cell_id": "cell_b", "vec": "vb"}), "cell_b")
    bias = diff.select("cell_a", "score", F.zip_with("vb", "va", lambda x, y: (x - y).cast("double")).alias("bias"))
    ends = query.join(anchors.select(F.col("cell_a").alias("cell_id")).distinct(), "cell_id", "left_semi")
    near = knn(query, ends, k, include_self=True)
    far = F.max("dist").over(Window.partitionBy("src"))
    near = near.withColumn("close", 1 - F.coalesce(div(F.col("dist"), far), F.lit(0.0))).withColumnRenamed("dst", "cell_a").join(bias, "cell_a")
    w = 1 - F.exp(-F.col("close") * F.col("score") * (sd * sd / 4))
    near = near.withColumn("w", w)
    sums = near.groupBy("src").agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col("bias")[i]).alias(f"b{i}") for i in range(dim)])
    moved = F.transform(F.array(*[F.coalesce(div(F.col(f"b{i}"), F.col("w")), F.lit(0.0)) for i in range(dim)]), lambda x: x)
    out = query.join(sums, query["cell_id"] == sums["src"], "left")
    return out.select("cell_id", F.zip_with(F.col("vec").cast("array<double>"), moved, lambda x, y: x + F.coalesce(y, F.lit(0.0))).alias("vec"))


def merge_order(n_anchors: dict[tuple[str, str], int], sizes: dict[str, int]) -> list[tuple[tuple[str, ...], tuple[str, ...]]]:
    """In which order datasets are aligned: average linkage on one over the anchors per cell; one step per dataset less one."""
    groups = [(n,) for n in sorted(sizes)]

    def gap(g: tuple[str, ...], h: tuple[str, ...]) -> float:
        ds = []
        for x in g:
            for y in h:
                n = n_anchors.get((x, y), n_anchors.get((y, x), 0))
                ds.append(min(sizes[x], sizes[y]) / n if n else 1e12)
        return sum(ds) / len(ds)

    steps = []
    while len(groups) > 1:
        g, h = min(((g, h) for i, g in enumerate(groups) for h in groups[i + 1 :]), key=lambda p: (gap(*p), p))
        steps.append((g, h))
        groups = [x for x in groups if x not in (g, h)] + [g + h]
    return steps


def fuzzy_weights(near: DataFrame, k: int) -> DataFrame:
    """``src, dst, weight`` of neighbours ``(src, dst, dist)``: ``exp(-(d - ρ) / σ)``, 1 up to ρ, the least distance above 0.

    σ is such that the weights of a cell sum up to the binary logarithm of ``k``, which counts the cell itself (public: the
    smooth distances of UMAP, McInnes and others 2018); found by halving intervals 64 times, at least 1/1000 of the mean
    distance (of all cells' where ρ is 0). A cell's neighbours are ``k - 1`` rows, so they are gathered per cell.
    """
    return one_way(weighed(_listed(near.select("src", "dst", F.col("dist").cast("double").alias("dist"))), k, near.agg(F.avg("dist").alias("mean"))))


def one_way(lists: DataFrame) -> DataFrame:
    """``src, dst, weight`` of lists."""
    return lists.select("src", F.explode(F.arrays_zip("dst", "weight")).alias("n")).select("src", F.col("n.dst").alias("dst"), F.col("n.weight").alias("weight"))


def weighed(lists: DataFrame, k: int, mean: DataFrame | None = None) -> DataFrame:
    """``lists`` (src, dst, dist, …) of neighbours with ``weight``, a list too, instead of the distances; see :func:`fuzzy_weights`.

    ``mean``: the mean distance, in one row, else it is taken of the lists.
    """
    kinds = dict(lists.dtypes)
    if mean is None:
        mean = lists.agg((F.sum(F.aggregate("dist", F.lit(0.0), lambda a, x: a + x)) / F.sum(F.size("dist"))).alias("mean"))
    names = [c for c in lists.columns if c != "dist"]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dist = b.column("dist")
            d, size = dist.flatten().to_numpy(), dist.value_lengths().to_numpy()
            at = np.repeat(np.arange(len(size)), size)
            rho = np.full(len(size), np.inf)
            np.minimum.at(rho, at[d > 0], d[d > 0])
            rho = np.where(np.isfinite(rho), rho, 0.0)
            over = np.maximum(d - rho[at], 0)
            target, lo, hi, mid = np.log2(k), np.zeros(len(size)), np.full(len(size), np.inf), np.ones(len(size))
            for _ in range(64 if over.any() else 0):
                total = np.bincount(at, np.exp(-over / mid[at]), minlength=len(size))
                high = total > target
                hi, lo = np.where(high, mid, hi), np.where(high, lo, mid)
                mid = np.where(np.isinf(hi), mid * 2, (lo + hi) / 2)
            own = np.bincount(at, d, minlength=len(size)) / np.maximum(size, 1)
            mid = np.maximum(mid, 1e-3 * np.where(rho > 0, own, b.column("mean").to_numpy()))
            w = np.exp(-over / np.maximum(mid, 1e-300)[at])
            ends = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
            yield pa.RecordBatch.from_arrays([*map(b.column, names), pa.ListArray.from_arrays(ends, pa.array(w, pa.float64()))], [*names, "weight"])

    rows = lists.join(F.broadcast(mean.select(F.coalesce("mean", F.lit(0.0)).alias("mean"))))  # one row is broadcast
    return rows.mapInArrow(weigh, ", ".join(f"{c} {kinds[c]}" for c in names) + ", weight array<double>")


def united(links: DataFrame) -> DataFrame:
    """``src, dst, weight``, both directions: links of ``(src, dst, weight)`` united with those back as ``a + b - ab``."""
    both = links.select("src", "dst", "weight").union(links.select("dst", "src", "weight"))
    return both.groupBy("src", "dst").agg((1 - F.product(1 - F.col("weight"))).alias("weight"))


def neighbour_graph(vectors: DataFrame, k: int = 15, lists: int | None = None, probes: int = 8, within: str | None = None) -> DataFrame:
    """``src, dst, weight``, both directions: fuzzy connectivities (see :func:`fuzzy_weights`) of ``k`` neighbours, the cell itself
    counted, united as ``a + b - ab``.

    Neighbours are exact, which compares all pairs; with ``lists`` they are searched in ``probes`` of that many lists. With
    ``within`` only cells that share its value are linked.
    """
    if lists:
        index = fit_lists(vectors, lists)
        near = search_lists(vectors, listed(vectors, index), index, k - 1, probes)
    else:
        near = knn(vectors, None, k - 1, within=within)
    return united(fuzzy_weights(near, k))


def spread_labels(graph: DataFrame, rounds: int = 1000, settle: int = 20) -> DataFrame:
    """``cell_id, label``: communities by label propagation: each node takes the heaviest label among its neighbours, ties to
    the smaller, until no node would take another.

    Nodes of alternating halves move in turn. After ``settle`` rounds, of nodes that are neighbours and both would move
    only one does, chosen by a hash of the round; with equal weights both ways each such round adds to the weight inside
    labels, or keeps it and takes smaller ones, so labels can't swap for ever. Weights count in steps of 1e-9. Raises if
    ``rounds`` don't suffice.
    """
    graph = written(graph.select("src", "dst", F.round(F.col("weight") * 1e9).cast("long").alias("weight")))
    labels = written(graph.select(F.col("src").alias("cell_id")).union(graph.select("dst")).distinct().withColumn("label", F.col("cell_id")))
    before = labels
    for i in range(rounds):
        seen = graph.join(labels.withColumnRenamed("cell_id", "dst"), "dst").groupBy("src", "label").agg(F.sum("weight").alias("w"))
        best = seen.groupBy("src").agg(F.min(F.struct((-F.col("w")).alias("w"), "label")).alias("b")).select(F.col("src").alias("cell_id"), F.col("b.label").alias("to"))
        now = written(labels.join(best, "cell_id", "left").select("cell_id", "label", F.coalesce("to", "label").alias("to")))
        discard(before)
        before = now
        restless = now.where("`to` <> label")
        if restless.isEmpty():
            return now.select("cell_id", "label")
        if i < settle:
            turn = F.pmod(F.xxhash64("cell_id"), F.lit(2)) == i % 2
            labels = now.select("cell_id", F.when(turn, F.col("to")).otherwise(F.col("label")).alias("label"))
        else:
            rank = F.struct(F.xxhash64("cell_id", F.lit(i)), "cell_id")
            ends = [restless.select(F.col("cell_id").alias(c), rank.alias(f"r_{c}")) for c in ("src", "dst")]
            stay = graph.join(ends[0], "src").join(ends[1], "dst").where("r_src < r_dst").select(F.col("src").alias("cell_id")).distinct()
            goes = restless.join(stay, "cell_id", "left_anti").select("cell_id", F.lit(True).alias("goes"))
            labels = now.join(goes, "cell_id", "left").select("cell_id", F.when(F.col("goes"), F.col("to")).otherwise(F.col("label")).alias("label"))
    raise RuntimeError(f"labels didn't settle in {rounds} rounds")


def majority_labels(obs: DataFrame, cluster: str, label: str, out: str = "majority") -> DataFrame:
    """``obs`` with each cluster's most frequent label, ties to the smaller."""
    n = obs.where(F.col(label).isNotNull()).groupBy(cluster, label).agg(F.count("*").alias("n"))
    best = n.groupBy(cluster).agg(F.min(F.struct((-F.col("n")).alias("n"), label)).alias("b")).select(cluster, F.col(f"b.{label}").alias(out))
    return obs.join(best, cluster, "left")


def recluster(obs: DataFrame, vectors: DataFrame, cluster: str, k: int = 15, out: str = "recluster", resolution: float = 1.0) -> DataFrame:
    """``obs`` with ``<cluster>_<i>`` labels from Leiden communities inside each cluster, the largest first: one fuzzy graph that
    links each cell to its nearest of the same cluster, with a resolution that doesn't depend on the other clusters."""
    inside = vectors.join(obs.select("cell_id", cluster), "cell_id")
    graph = written(neighbour_graph(inside, k, within=cluster).join(obs.select(F.col("cell_id").alias("src"), cluster), "src"))
    total = graph.groupBy(cluster).agg(F.sum("weight").alias("t"))
    # every cluster's graph weighs the same, and the resolution is that of one: as if each were clustered alone
    alone = graph.join(total, cluster).select("src", "dst", (F.col("weight") / F.col("t")).alias("weight"))
    found = leiden(alone, resolution * total.count())
    named = inside.select("cell_id", cluster).join(found, "cell_id", "left").withColumn("label", F.coalesce("label", "cell_id"))
    sizes = named.groupBy(cluster, "label").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("n"), "label")) - 1
    names = sizes.withColumn(out, F.concat_ws("_", cluster, place.cast("string"))).drop("n")
    return obs.join(named.join(names, [cluster, "label"]).select("cell_id", out), "cell_id", "left")


def diffuse(graph: DataFrame, steps: int = 1, min_k: int | None = None, max_steps: int = 26) -> DataFrame:
    """``src, dst, weight``: the graph's row-normalised matrix raised to a power, without the diagonal.

    With ``min_k`` powers are summed until every row has that many entries, at most ``max_steps``.
    """
    w = F.sum("weight").over(Window.partitionBy("src"))
    base = written(graph.select("src", "dst", (F.col("weight") / w).alias("weight")))
    now, total = base, base
    for _ in range((max_steps if min_k else steps) - 1):
        if min_k:
            least = total.where("src <> dst").groupBy("src").agg(F.count("*").alias("n")).agg(F.min("n")).first()[0]
            if least is None or least >= min_k:
                break
        nxt = base.select(F.col("src").alias("dst"), F.col("dst").alias("to"), F.col("weight").alias("w2"))
        now = written(now.join(nxt, "dst").groupBy("src", "to").agg(F.sum(F.col("weight") * F.col("w2")).alias("weight")).withColumnRenamed("to", "dst"))
        total = written(total.union(now).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))) if min_k else now
    return total.where("src <> dst")


def diffusion_neighbours(graph: DataFrame, k: int) -> DataFrame:
    """``src, dst, weight, place``: the ``k`` strongest entries of each row of the diffused graph."""
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.desc(F.round("weight", 9)), "dst"))
    return diffuse(graph, min_k=k).withColumn("place", place).where(F.col("place") <= k)


def smooth(values: DataFrame, graph: DataFrame) -> DataFrame:
    """``cell_id, gene_id, value`` averaged over spatial neighbours with the graph's weights (self-loops included there)."""
    total = graph.groupBy("src").agg(F.sum("weight").alias("t"))
    j = values.join(graph, values["cell_id"] == graph["dst"]).groupBy("src", "gene_id").agg(F.sum(F.col("weight") * F.col("value")).alias("s"))
    return j.join(total, "src").select(F.col("src").alias("cell_id"), "gene_id", (F.col("s") / F.col("t")).alias("value"))


def spatial_graph(spots: DataFrame, bandwidth: float = 100, cutoff: float = 0.1, slide: str | None = None) -> DataFrame:
    """``src, dst, weight`` of spots ``(cell_id, x, y)``: Gaussian kernel, weights under the cutoff left out, self-loops kept.

    Spots meet in grid cells as wide as the kernel's reach, and in the eight around them, by a sorted join: to Spark's
    statistics the nine copies of a spot are one row, so it would broadcast tables that the driver can't hold.
    """
    reach = float(bandwidth * np.sqrt(-2 * np.log(cutoff)))
    keys = [slide] if slide else []
    a = spots.select("cell_id", "x", "y", *keys, F.floor(F.col("x") / reach).alias("gx"), F.floor(F.col("y") / reach).alias("gy"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = a.withColumn("s", F.explode(steps)).select(F.col("cell_id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"), *keys, (F.col("gx") + F.col("s.i")).alias("gx"), (F.col("gy") + F.col("s.j")).alias("gy"))
    d2 = (F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2
    j = a.join(b.hint("merge"), [*keys, "gx", "gy"]).withColumn("weight", F.exp(-d2 / (2 * bandwidth * bandwidth)))
    return j.where((F.col("weight") >= cutoff) | (F.col("cell_id") == F.col("dst"))).select(F.col("cell_id").alias("src"), "dst", "weight")


def dense_vectors(exp: Experiment, genes: list[str], layer: str | None = None) -> DataFrame:
    """``cell_id, vec`` over a bounded list of genes, zeros included. The genes' places are joined as a small table."""
    at = exp.obs.sparkSession.createDataFrame([(g, i) for i, g in enumerate(genes)], "gene_id string, i int")
    rows = exp.layer(layer).join(F.broadcast(at), "gene_id")  # a row per gene of the list is broadcast
    v = rows.groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "value"))).alias("m"))
    out = exp.obs.select("cell_id").join(v, "cell_id", "left")
    return out.select("cell_id", F.transform(F.sequence(F.lit(0), F.lit(len(genes) - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("vec"))


def doublet_neighbours(exp: Experiment, *, batch_key: str | None = None, layer: str | None = None, rate: float = 0.06, k: int = 15, n_genes: int = 200) -> DataFrame:
    """See :func:`quantell.operators.quality.doublet_scores`; distances are over the ``n_genes`` genes with the largest totals."""
    per = F.collect_list(F.struct("gene_id", F.col("value").cast("double").alias("value"))).alias("e")
    own = written(exp.layer(layer).where("value <> 0").groupBy("cell_id").agg(per))  # once: all that follows is a row per cell
    top = own.select(F.explode("e").alias("e")).groupBy("e.gene_id").agg(F.sum("e.value").alias("t")).orderBy(F.desc("t"), "gene_id").limit(n_genes).collect()
    genes = sorted(r.gene_id for r in top)
    keys = [batch_key] if batch_key else []
    kind = dict(exp.obs.dtypes)["cell_id"]
    # partners: the next cell in hash order within a batch's part
    at = F.transform("e", lambda s: F.struct((F.array_position(F.array(*map(F.lit, genes)).cast("array<string>"), s["gene_id"]) - 1).cast("int").alias("at"), s["value"].alias("x")))
    v = exp.obs.select("cell_id", *keys).join(own, "cell_id", "left").withColumn("e", F.filter(F.coalesce(at, F.array().cast("array<struct<at:int,x:double>>")), lambda s: s["at"] >= 0))
    v = v.withColumn("h", F.xxhash64("cell_id", F.lit(7))).withColumn("n", F.pmod(F.xxhash64("cell_id", F.lit(11)), F.lit(64)))
    v = written(v.withColumn("o", F.lead("e").over(Window.partitionBy(*keys, "n").orderBy("h", "cell_id"))).select(F.col("cell_id").cast("string").alias("cell_id"), "e", "o"))
    discard(own)
    pair = F.concat("e", "o")
    real = v.select("cell_id", F.col("e.at").alias("at"), F.col("e.x").alias("x"), F.lit(True).alias("asked"))
    sim = v.where("o IS NOT NULL").select(F.concat(F.lit("sim-"), "cell_id").alias("cell_id"), pair["at"].alias("at"), pair["x"].alias("x"), F.lit(False).alias("asked"))
    near = near_lists(real, real.union(sim), k, rows=Counts(max(1, len(genes))))
    share = F.aggregate("dst", F.lit(0.0), lambda a, x: a + x.startswith("sim-").cast("double")) / F.size("dst")
    score = written(near.where(F.size("dst") > 0).select("src", share.alias("doublet_score")))
    cut = score.agg(F.expr(f"percentile(doublet_score, {1 - rate})").alias("cut"))
    cls = F.when((F.col("doublet_score") > F.col("cut")) & (F.col("doublet_score") > 0.5), "doublet").otherwise("singlet")
    return score.join(F.broadcast(cut)).select(F.col("src").cast(kind).alias("cell_id"), "doublet_score", cls.alias("doublet_class"))  # one row is broadcast


class Lists:
    """Centres of an inverted list index and the size of its vectors."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        d = (x**2).sum(1)[:, None] + (self.centres**2).sum(1)[None] - 2 * x @ self.centres.T
        n = min(n, len(self.centres))
        top = np.argpartition(d, n - 1, axis=1)[:, :n]
        return np.take_along_axis(top, np.argsort(np.take_along_axis(d, top, 1), axis=1, kind="stable"), 1)


def fit_lists(base: DataFrame, n_lists: int = 256, sample_rows: int = 50_000, rounds: int = 8, seed: int = 0) -> Lists:
    """k-means centres, fitted on at most about ``sample_rows`` rows, a hash sample; every row is indexed by :func:`listed`."""
    dim = _dim(base)
    n = base.count()
    cut = int(min(1.0, sample_rows / max(n, 1)) * (1 << 30))
    sample = base.where(F.col("vec").isNotNull() & (F.pmod(F.xxhash64("cell_id", F.lit(seed)), F.lit(1 << 30)) <= cut)).select("cell_id", F.col("vec").cast("array<double>").alias("vec")).toArrow()
    ids = np.argsort(np.array(sample.column("cell_id").to_pylist()), kind="stable")
    x = matrix(sample.column("vec"), dim, np.float64)[ids]
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(n_lists, len(x)), replace=False)] if len(x) else np.zeros((1, dim))
    for _ in range(rounds if len(x) else 0):
        code = Lists(centres).nearest(x, 1)[:, 0]
        for k in np.unique(code):
            centres[k] = x[code == k].mean(0)
    return Lists(centres)


def listed(base: DataFrame, index: Lists, probes: int = 1) -> DataFrame:
    """``cell_id, vec, list`` of every row in its nearest lists."""
    shared = base.sparkSession.sparkContext.broadcast(index)  # n_lists centres
    dim = index.centres.shape[1]
    kind = dict(base.dtypes)["cell_id"]

    def place(batches):  # noqa: ANN001, ANN202
        for b in batches:
            near = shared.value.nearest(matrix(b.column(1), dim, np.float64), probes)
            at = np.repeat(np.arange(len(near)), near.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(near.ravel().astype(np.int32))], ["cell_id", "vec", "list"])

    rows = base.where(F.col("vec").isNotNull()).select("cell_id", F.col("vec").cast("array<double>").alias("vec"))
    return rows.mapInArrow(place, f"cell_id {kind}, vec array<double>, list int")


def search_lists(queries: DataFrame, base: DataFrame, index: Lists, k: int = 15, probes: int = 8, include_self: bool = False, part_rows: int = 100_000) -> DataFrame:
    """``src, dst, dist, place``: the ``k`` nearest rows of ``base`` (see :func:`listed`) among the lists nearest to each query.

    Approximate: rows of lists that aren't probed are missed. Lists of more than ``part_rows`` rows are divided by a
    hash and searched in parts, so a list that holds a third of all rows is no task of its own.
    """
    dim = index.centres.shape[1]
    kind = dict(queries.dtypes)["cell_id"]
    parts = base.groupBy("list").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))
    b = base.join(parts, "list").withColumn("part", F.pmod(F.xxhash64("cell_id"), F.col("parts")).cast("int")).withColumn("side", F.lit(1))
    q = listed(queries, index, probes).join(parts, "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("side", F.lit(0))
    cols = ["list", "part", "side", "cell_id", "vec"]

    def near(t: pa.Table) -> pa.Table:
        side, ids, x = t.column("side").to_numpy(), t.column("cell_id").to_numpy(), matrix(t.column("vec"), dim, np.float64)
        a, c = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        c = c[np.argsort(ids[c], kind="stable")]
        out: list[list[np.ndarray]] = [[], [], []]
        for i in range(0, len(a) if len(c) else 0, 512):
            rows = a[i : i + 512]
            d2 = (x[rows] ** 2).sum(1)[:, None] + (x[c] ** 2).sum(1)[None] - 2 * x[rows] @ x[c].T
            d = np.round(np.sqrt(np.maximum(d2, 0)), DIGITS)
            if not include_self:
                d[ids[rows][:, None] == ids[c][None]] = np.inf
            top = np.argsort(d, axis=1, kind="stable")[:, :k]
            dist = np.take_along_axis(d, top, 1)
            ok = np.isfinite(dist)
            for o, v in zip(out, (np.repeat(ids[rows], top.shape[1]).reshape(top.shape)[ok], ids[c][top][ok], dist[ok]), strict=True):
                o.append(v)
        s, t2, d = (np.concatenate(o) if o else np.array([]) for o in out)
        key = t.schema.field("cell_id").type
        return pa.table({"src": pa.array(s).cast(key), "dst": pa.array(t2).cast(key), "dist": pa.array(d, pa.float64())})

    found = q.select(*cols).union(b.select(*cols)).groupBy("list", "part").applyInArrow(near, f"src {kind}, dst {kind}, dist double")
    place = F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))
    return found.withColumn("place", place).where(F.col("place") <= k)
