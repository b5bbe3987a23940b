"""Problem 3: a sample of target proportions over two margins, by controlled rounding and exact random-key quotas."""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantell.llm.latest import latest_rows
from quantell.llm.stable import RANGE, key_hash
from quantell.plans.shared import written

#: Strata of a target table at most; it is held by the driver.
MOST_STRATA = 100_000
#: Buckets of the random key: where a quota ends inside a bucket, only that bucket's rows are ranked.
BUCKETS = 1 << 14


class _Flow:
    """Maximum flow by blocking flows in layers (public: Dinic 1970); capacities are integers.

    In a table's network every cell has capacity 1, so the number of layers grows with the root of the number of rows
    and columns at most, and a layer takes time in proportion to the cells.
    """

    def __init__(self, n: int):
        self.next: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.cap: list[int] = []

    def edge(self, u: int, v: int, cap: int) -> int:
        for a, b, c in ((u, v, cap), (v, u, 0)):
            self.next[a].append(len(self.to))
            self.to.append(b)
            self.cap.append(c)
        return len(self.to) - 2

    def _layers(self, s: int) -> list[int]:
        depth = [-1] * len(self.next)
        depth[s] = 0
        todo = deque([s])
        while todo:
            u = todo.popleft()
            for e in self.next[u]:
                if self.cap[e] > 0 and depth[self.to[e]] < 0:
                    depth[self.to[e]] = depth[u] + 1
                    todo.append(self.to[e])
        return depth

    def run(self, s: int, t: int) -> int:
        total = 0
        while (depth := self._layers(s))[t] >= 0:
            tried = [0] * len(self.next)  # edges of a node that lead nowhere in this layer, or are full
            path: list[int] = []
            u = s
            while True:
                if u == t:
                    least = min(self.cap[e] for e in path)
                    for e in path:
                        self.cap[e] -= least
                        self.cap[e ^ 1] += least
                    total += least
                    full = next(i for i, e in enumerate(path) if not self.cap[e])
                    u = self.to[path[full] ^ 1]
                    del path[full:]
                    continue
                edges = self.next[u]
                while tried[u] < len(edges):
                    e = edges[tried[u]]
                    if self.cap[e] > 0 and depth[self.to[e]] == depth[u] + 1:
                        break
                    tried[u] += 1
                if tried[u] < len(edges):
                    path.append(edges[tried[u]])
                    u = self.to[path[-1]]
                elif not path:
                    break
                else:
                    u = self.to[path.pop() ^ 1]
                    tried[u] += 1
        return total


def controlled_rounding(table: dict[tuple[str, str], float]) -> dict[tuple[str, str], int]:
    """Integers, each the floor or the ceiling of its cell, whose row sums, column sums and total are those of the
    fractional table, rounded to a neighbouring integer each.

    The fractional parts are a feasible flow rows → cells → columns with bounds at the floors and ceilings of the
    margins, so an integral one exists (public: Bacharach 1966, Cox 1987). Lower bounds are met by the usual
    reduction to a maximum flow. Cells are taken in their sorted order, so the result is always the same.
    """
    cells = sorted(table)
    fix = {c: math.floor(table[c] + 1e-9) for c in cells}
    part = {c: max(0.0, table[c] - fix[c]) for c in cells}
    rows: dict[str, float] = {}
    cols: dict[str, float] = {}
    for a, b in cells:
        rows[a], cols[b] = rows.get(a, 0.0) + part[a, b], cols.get(b, 0.0) + part[a, b]
    s, t, src, snk = 0, 1, 2, 3
    node = {("r", a): 4 + i for i, a in enumerate(rows)} | {("c", b): 4 + len(rows) + i for i, b in enumerate(cols)}
    g = _Flow(4 + len(node))
    need = [0] * (4 + len(node))

    def bounded(u: int, v: int, x: float) -> None:
        lo, hi = math.floor(x + 1e-9), math.ceil(x - 1e-9)
        g.edge(u, v, hi - lo)
        need[v] += lo
        need[u] -= lo

    for a, x in rows.items():
        bounded(s, node["r", a], x)
    for b, x in cols.items():
        bounded(node["c", b], t, x)
    bounded(t, s, sum(part.values()))
    edges = {c: g.edge(node["r", c[0]], node["c", c[1]], 1) for c in cells if part[c] > 1e-9}
    for v, d in enumerate(need):
        if d > 0:
            g.edge(src, v, d)
        elif d < 0:
            g.edge(v, snk, -d)
    g.run(src, snk)
    return {c: fix[c] + (1 - g.cap[edges[c]] if c in edges else 0) for c in cells}


def quotas(targets: dict[tuple[str, str], tuple[float, int]], available: dict[tuple[str, str], int], size: int) -> dict[tuple[str, str], dict]:
    """What to draw from each stratum: as near to ``share * size`` as availability and the minima let it be.

    Strata are held at their minimum (or at all they have) where their share of what is left gives them less, and at
    what they have where it gives them more; the rest follow their shares. The fractional table is then rounded by
    :func:`controlled_rounding`.
    """
    least = {c: min(m, available.get(c, 0)) for c, (_, m) in targets.items()}
    held: dict[tuple[str, str], float] = {}
    free = dict.fromkeys(targets)
    while free:
        left, weight = max(0.0, size - sum(held.values())), sum(targets[c][0] for c in free)
        want = {c: left * targets[c][0] / weight if weight > 0 else 0.0 for c in free}
        over = [c for c in free if want[c] > available.get(c, 0)]
        under = [c for c in free if want[c] < least[c]]
        excess = sum(want[c] - available.get(c, 0) for c in over) - sum(least[c] - want[c] for c in under)
        fixed = over if over and (excess >= 0 or not under) else under
        if not fixed:
            held |= want
            break
        for c in fixed:
            held[c] = float(available.get(c, 0) if fixed is over else least[c])
            del free[c]
    whole = controlled_rounding(held)
    return {
        c: {"available": available.get(c, 0), "wanted": share * size, "least": m, "quota": min(whole[c], available.get(c, 0))}
        for c, (share, m) in targets.items()
    }


def quota_sample(
    df: DataFrame, targets: DataFrame, key: str, at: str, row: Column, col: Column, target_row: Column, target_col: Column,
    share: str = "target_share", least: str = "min_cells", fraction: float = 0.2, salt: str = "quota",
) -> tuple[DataFrame, DataFrame]:
    """The sample ``(key, row, col)`` and the plan ``(row, col, available, wanted, least, quota, target_share)``.

    A key's stratum is that of its latest row; usable keys are those whose stratum ``targets`` lists. Of them
    ``fraction`` is drawn, the shares as near to their targets as possible (see :func:`quotas`); of each stratum
    exactly its quota with the least random keys, hashes of the key. Target rows with a null part or share are left out,
    repeated strata add up; a null minimum is 0. Rows with a null key are left out. Without usable keys the sample is empty.
    What the drawn keys reach is told by :func:`reached`.

    Quotas are cut at a bucket of the random key, from counts per stratum and bucket; only the bucket in which a quota
    ends is ranked, so a stratum of any size is drawn from without gathering it.
    """
    spark = df.sparkSession
    t = targets.select(target_row.alias("r"), target_col.alias("c"), F.col(share).cast("double").alias("s"), F.coalesce(F.col(least).cast("long"), F.lit(0)).alias("m"))
    t = t.where("r IS NOT NULL AND c IS NOT NULL AND s IS NOT NULL").groupBy("r", "c").agg(F.sum("s").alias("s"), F.sum("m").alias("m"))
    listed = t.limit(MOST_STRATA + 1).collect()
    if len(listed) > MOST_STRATA:
        raise ValueError(f"more than {MOST_STRATA} strata")
    wanted = {(x.r, x.c): (x.s, x.m) for x in listed}
    last = latest_rows(df, key, at, r=row, c=col)
    strata = spark.createDataFrame([(r, c) for r, c in wanted], "r string, c string")
    h = key_hash(F.col("k"), salt)
    usable = last.select(F.col(key).alias("k"), "r", "c").join(F.broadcast(strata), ["r", "c"])  # at most MOST_STRATA rows
    usable = written(usable.select("k", "r", "c", h.alias("h"), (h / (RANGE // BUCKETS)).cast("int").alias("b")))
    counts = usable.groupBy("r", "c", "b").agg(F.count("*").alias("n"))
    sums = counts.groupBy("r", "c").agg(F.sum("n").alias("n")).collect()  # a row per stratum
    available = {(x.r, x.c): x.n for x in sums}
    n = sum(available.values())
    plan = quotas(wanted, available, math.floor(fraction * n + 1e-9))
    exact = {c: s * fraction * n for c, (s, _) in wanted.items()}
    report = spark.createDataFrame(
        [(r, c, p["available"], exact[r, c], p["least"], p["quota"], wanted[r, c][0]) for (r, c), p in plan.items()],
        "r string, c string, available long, wanted double, least long, quota long, target_share double",
    )
    need = F.broadcast(report.select("r", "c", "quota"))  # at most MOST_STRATA rows
    before = F.sum("n").over(Window.partitionBy("r", "c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    cuts = counts.withColumn("before", F.coalesce(before, F.lit(0))).join(need, ["r", "c"]).where("before < quota")
    cuts = cuts.select("r", "c", "b", (F.col("quota") - F.col("before")).alias("take"), (F.col("before") + F.col("n") <= F.col("quota")).alias("all"))
    met = usable.join(cuts, ["r", "c", "b"])
    place = F.row_number().over(Window.partitionBy("r", "c", "b").orderBy("h", "k"))
    ends = met.where("NOT all").withColumn("place", place).where("place <= take")
    return met.where("all").select(F.col("k").alias(key), "r", "c").union(ends.select(F.col("k").alias(key), "r", "c")), report


def reached(sample: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan with what was drawn: ``drawn``, its ``share`` of all drawn, ``short`` and ``pressed``.

    ``short`` marks strata in which less was drawn than the greater of their minimum and their target, and which have no
    more usable keys than that. ``pressed`` marks those that do have them but were left below their target, by a whole key or
    more, because the minima of others take up the sample.
    """
    drawn = sample.groupBy("r", "c").agg(F.count("*").alias("drawn"))
    rows = plan.join(drawn, ["r", "c"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    total = rows.agg(F.sum("drawn").alias("total"))
    need = F.greatest(F.col("least").cast("double"), F.col("wanted"))
    rows = rows.join(F.broadcast(total))  # one row is broadcast
    short = (F.col("drawn") < need) & (F.col("available") < need)
    pressed = (F.col("drawn") < F.floor("wanted")) & (F.col("available") >= need)
    share = F.coalesce(F.col("drawn") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0))
    return rows.select("r", "c", "available", "wanted", "least", "quota", "drawn", share.alias("share"), "target_share", short.alias("short"), pressed.alias("pressed"))
