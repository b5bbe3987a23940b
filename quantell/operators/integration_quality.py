"""How well batches were integrated: connectivity, silhouettes, kBET, explained variance."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantell.experiment import InputError
from quantell.functions.special import chi2_sf
from quantell.functions.vectors import matrix
from quantell.operators.components import connected_components
from quantell.operators.expression import div
from quantell.operators.neighbours import _dim, diffusion_neighbours, knn
from quantell.operators.reduction import pcr_comparison


def connectivity_by_label(graph: DataFrame, obs: DataFrame, label: str) -> DataFrame:
    """``label, size, largest``: the largest component of each label's own part of the graph."""
    lab = obs.select("cell_id", F.col(label).alias("label")).where("label IS NOT NULL")
    a, b = lab.withColumnsRenamed({"cell_id": "src", "label": "l1"}), lab.withColumnsRenamed({"cell_id": "dst", "label": "l2"})
    inside = graph.join(a, "src").join(b, "dst").where("l1 = l2").select("src", "dst")
    root = connected_components(inside).withColumnRenamed("node", "cell_id")
    parts = lab.join(root, "cell_id", "left").groupBy("label", F.coalesce("root", "cell_id").alias("root")).agg(F.count("*").alias("n"))
    return parts.groupBy("label").agg(F.sum("n").alias("size"), F.max("n").alias("largest"))


def graph_connectivity(graph: DataFrame, obs: DataFrame, label: str) -> DataFrame:
    """``score``: mean over labels of the largest component's share, to 3 digits."""
    return connectivity_by_label(graph, obs, label).agg(F.round(F.avg(F.col("largest") / F.col("size")), 3).alias("score"))


def silhouettes(vectors: DataFrame, obs: DataFrame, cluster: str, within: str | None = None, tile: int = 2048) -> DataFrame:
    """``cell_id, cluster, within, a, b, silhouette`` of every cell, within each value of ``within``; 0 for a cluster of one cell.

    Exact: pairs of tiles yield sums of distances per cell and cluster, so what is shuffled is cells × tiles × clusters.
    """
    dim = _dim(vectors)
    keys = [F.col(within).alias("w")] if within else [F.lit("").alias("w")]
    data = vectors.join(obs.select("cell_id", F.col(cluster).cast("string").alias("c"), *keys), "cell_id").where("c IS NOT NULL AND w IS NOT NULL")
    n = data.count()
    tiles = max(1, -(-n // tile))
    t = data.select(F.pmod(F.xxhash64("cell_id"), F.lit(tiles)).alias("t"), "cell_id", F.col("vec").cast("array<double>").alias("vec"), "c", F.col("w").cast("string").alias("w"))
    all_ = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    rows = t.withColumn("u", all_).withColumn("side", F.lit(0)).select("t", "u", "side", "cell_id", "vec", "c", "w")
    cols = t.withColumnRenamed("t", "u").withColumn("t", all_).withColumn("side", F.lit(1)).select("t", "u", "side", "cell_id", "vec", "c", "w")
    kind = dict(vectors.dtypes)["cell_id"]

    def sums(tb: pa.Table) -> pa.Table:
        side = tb.column("side").to_numpy()
        x = matrix(tb.column("vec"), dim, np.float64)
        ids, c, w = tb.column("cell_id"), np.array(tb.column("c").to_pylist(), object), np.array(tb.column("w").to_pylist(), object)
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        key = pa.concat_arrays(ids.chunks).to_numpy(zero_copy_only=False)
        at, other, total = [], [], []
        for g in sorted(set(w[a]) & set(w[b])):
            ra, rb = a[w[a] == g], b[w[b] == g]
            names, code = np.unique(c[rb].astype(str), return_inverse=True)
            d2 = (x[ra] ** 2).sum(1)[:, None] + (x[rb] ** 2).sum(1)[None] - 2 * x[ra] @ x[rb].T
            d = np.sqrt(np.maximum(d2, 0))
            d[key[ra][:, None] == key[rb][None]] = 0.0
            at.append(np.repeat(ra, len(names)))
            other.append(np.tile(names, len(ra)))
            total.append((d @ np.eye(len(names))[code]).ravel())
        rows_ = np.concatenate(at) if at else np.zeros(0, np.int64)
        kept = pa.array(rows_, pa.int64())
        return pa.table({
            "cell_id": ids.take(kept), "c": tb.column("c").take(kept), "w": tb.column("w").take(kept), "o": pa.array(np.concatenate(other) if other else [], pa.string()),
            "s": pa.array(np.concatenate(total) if total else [], pa.float64()),
        })

    per = rows.union(cols).groupBy("t", "u").applyInArrow(sums, f"cell_id {kind}, c string, w string, o string, s double")
    per = per.groupBy("cell_id", "c", "w", "o").agg(F.sum("s").alias("s"))
    sizes = data.select(F.col("w").cast("string").alias("w"), F.col("c").alias("o")).groupBy("w", "o").agg(F.count("*").alias("n"))
    own = F.col("o") == F.col("c")
    m = per.join(sizes, ["w", "o"]).groupBy("cell_id", "c", "w").agg(
        F.max(F.when(own, div(F.col("s"), F.col("n") - 1))).alias("a"), F.max(F.when(own, F.col("n"))).alias("n"), F.min(F.when(~own, F.col("s") / F.col("n"))).alias("b"),
    )
    s = F.when(F.col("n") == 1, F.lit(0.0)).otherwise(F.coalesce(div(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return m.select("cell_id", F.col("c").alias("cluster"), F.col("w").alias("within"), "a", "b", F.when(F.col("b").isNotNull(), s).alias("silhouette"))


def silhouette_batch(vectors: DataFrame, obs: DataFrame, batch_key: str, annotation_key: str, scale: bool = True) -> DataFrame:
    """``label, score``: per label the mean of the batches' absolute silhouettes, or of one less them; labels of one batch,
    or with a batch per cell, are left out."""
    ok = obs.groupBy(annotation_key).agg(F.count_distinct(batch_key).alias("k"), F.count("*").alias("n")).where("k > 1 AND k < n")
    cells = obs.join(ok.select(annotation_key), annotation_key, "left_semi")
    s = silhouettes(vectors, cells, batch_key, annotation_key)
    v = F.abs("silhouette")
    return s.groupBy(F.col("within").alias("label")).agg(F.avg(1 - v if scale else v).alias("score"))


def silhouette_label(vectors: DataFrame, obs: DataFrame, label: str, scale: bool = True) -> DataFrame:
    """``score``: the mean silhouette of labels, brought to [0, 1] if scaled."""
    m = F.avg("silhouette")
    return silhouettes(vectors, obs, label).agg(((m + 1) / 2 if scale else m).alias("score"))


def kbet(graph: DataFrame, obs: DataFrame, batch_key: str, annotation_key: str, scale: bool = True, alpha: float = 0.05) -> DataFrame:
    """``label, n, k0, score`` of labels with at least 10 cells and more than one batch: the share of neighbourhoods whose batch
    mix a χ² test rejects, or one less it.

    Neighbourhoods of ``k0`` cells (a quarter of the mean batch, 10 to 70) come from the diffused graph within the label.
    A label whose components of at least 3 ``k0`` cells hold under three quarters of its cells counts as all rejected.
    """
    lab = obs.select("cell_id", F.col(annotation_key).alias("label"), F.col(batch_key).alias("batch")).where("label IS NOT NULL AND batch IS NOT NULL")
    per = lab.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("batch").alias("k")).where("n >= 10 AND k > 1")
    k0 = F.least(F.lit(70), F.greatest(F.lit(10), F.floor(F.col("n") / F.col("k") / 4)))
    per = per.withColumn("k0", k0.cast("int"))
    lab = lab.join(per, "label")
    ends = lab.select("cell_id", "label")
    inside = graph.join(ends.withColumnsRenamed({"cell_id": "src", "label": "l1"}), "src").join(ends.withColumnsRenamed({"cell_id": "dst", "label": "l2"}), "dst").where("l1 = l2").select("src", "dst", "weight")
    root = connected_components(inside).withColumnRenamed("node", "cell_id")
    lab = lab.join(root, "cell_id", "left").withColumn("root", F.coalesce("root", "cell_id"))
    size = lab.groupBy("label", "root").agg(F.count("*").alias("in_part"))
    lab = lab.join(size, ["label", "root"]).withColumn("usable", F.col("in_part") >= 3 * F.col("k0"))
    near = diffusion_neighbours(inside, 70)
    use = lab.where("usable").select(F.col("cell_id").alias("src"), "label", "k0")
    seen = near.join(use, "src").where("place <= k0").join(lab.select(F.col("cell_id").alias("dst"), "batch"), "dst")
    got = seen.groupBy("src", "label", "batch").agg(F.count("*").alias("o"))
    freq = lab.groupBy("label", "batch").agg(F.count("*").alias("nb"))
    total = got.groupBy("src").agg(F.sum("o").alias("m"))
    grid = total.join(use, "src").join(freq, "label").join(per.select("label", "n"), "label").join(got, ["src", "label", "batch"], "left")
    e = F.col("m") * F.col("nb") / F.col("n")
    chi = grid.groupBy("src", "label").agg(F.sum((F.coalesce("o", F.lit(0)) - e) * (F.coalesce("o", F.lit(0)) - e) / e).alias("x"), (F.count("*") - 1).cast("double").alias("df"))
    rej = chi.withColumn("p", chi2_sf("x", "df")).groupBy("label").agg(F.avg((F.col("p") < alpha).cast("double")).alias("rejected"))
    held = lab.groupBy("label").agg(F.avg(F.col("usable").cast("double")).alias("held"))
    out = per.join(held, "label").join(rej, "label", "left")
    bad = F.when(F.col("held") < 0.75, F.lit(1.0)).otherwise(F.coalesce("rejected", F.lit(1.0)))
    return out.select("label", "n", "k0", (1 - bad if scale else bad).alias("score"))


METRICS = ("graph_connectivity", "kbet", "silhouette_batch", "pcr")


def eval_integration(
    before: DataFrame, reps: Mapping[str, DataFrame], graph: DataFrame, obs: DataFrame, batch_key: str, annotation_key: str, metrics: tuple[str, ...] = METRICS, scale: bool = True, k: int = 15,
) -> DataFrame:
    """``metric, embedding, value`` of every embedding; kBET on each embedding's own neighbours."""
    unknown = set(metrics) - set(METRICS)
    if unknown:
        raise InputError(f"unknown metrics: {sorted(unknown)}")
    out: list[tuple[str, str, float]] = []
    for name, v in reps.items():
        if "graph_connectivity" in metrics:
            out.append(("graph_connectivity", name, graph_connectivity(graph, obs, annotation_key).first()[0]))
        if "kbet" in metrics:
            near = knn(v, None, k).select("src", "dst", F.lit(1.0).alias("weight"))
            sym = near.union(near.select("dst", "src", "weight")).distinct()
            out.append(("kbet", name, kbet(sym, obs, batch_key, annotation_key, scale).agg(F.avg("score")).first()[0]))
        if "silhouette_batch" in metrics:
            out.append(("silhouette_batch", name, silhouette_batch(v, obs, batch_key, annotation_key, scale).agg(F.avg("score")).first()[0]))
        if "pcr" in metrics:
            out.append(("pcr", name, pcr_comparison(before, v, obs, batch_key, scale=scale)))
    return obs.sparkSession.createDataFrame(out, "metric string, embedding string, value double")


