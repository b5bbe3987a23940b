"""Values and grouped summaries of expression, zeros included.

Denominators are numbers of cells from ``obs``, never numbers of stored values.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantell.experiment import Experiment, InputError, as_list

#: Added to both sides of a fold change.
PSEUDO = 1e-9


def div(a: Column, b: Column) -> Column:
    """Quotient, null where the divisor is 0."""
    return a / F.nullif(b, F.lit(0))


def expr(exp: Experiment, *, features: Sequence[str] | None, groups: Any = None, out_format: str = "long", layer: str | None = None) -> DataFrame:
    """Values of the features in every cell. Long: ``cell_id, groups…, genes, expr``; wide: a column per feature.

    Zeros are filled in from the grid of cells and features, so the cost is that of the result. Wide tables of all
    genes have a column for each.
    """
    groups = as_list(groups)
    exp.require(groups)
    names = exp.genes(features)
    values = exp.layer(layer).join(names.select("gene_id"), "gene_id", "left_semi")
    if out_format == "wide":
        listed = as_list(features) if features is not None else [r.gene_id for r in names.orderBy("gene_id").collect()]
        wide = values.groupBy("cell_id").pivot("gene_id", listed).agg(F.sum("value"))
        return exp.obs.select("cell_id", *groups).join(wide, "cell_id", "left").fillna(0.0, subset=listed)
    if out_format != "long":
        raise InputError("out_format is long or wide")
    cells = exp.obs.select("cell_id", *groups).crossJoin(names.select("gene_id"))  # the result's own size
    out = cells.join(values, ["cell_id", "gene_id"], "left")
    return out.select("cell_id", *groups, F.col("gene_id").alias("genes"), F.coalesce("value", F.lit(0.0)).alias("expr"))


def group_stats(exp: Experiment, keys: Sequence[str], features: Sequence[str] | None = None, layer: str | None = None, logcounts: bool = False, cutoff: float = 0.0) -> DataFrame:
    """``keys…, gene_id, n_cells, total, squares, nnz, above, total_above`` for every group and gene.

    With ``logcounts`` sums are of ``expm1(value)``; ``nnz`` counts stored values, ``above`` values greater than
    ``cutoff``, implicit zeros included where the cutoff is negative, and ``total_above`` is their sum.
    """
    keys = list(keys)
    exp.require(keys)
    genes = exp.genes(features)
    values = exp.layer(layer)
    if features is not None:
        values = values.where(F.col("gene_id").isin(as_list(features)))
    v = F.expm1("value") if logcounts else F.col("value")
    over = F.col("value") > cutoff
    sums = (
        values.join(exp.obs.select("cell_id", *keys), "cell_id")
        .groupBy(*keys, "gene_id")
        .agg(
            F.sum(v).alias("total"), F.sum(v * v).alias("squares"), F.count("value").alias("nnz"), F.count(F.when(over, 1)).alias("above"),
            F.sum(F.when(over, v)).alias("total_above"),
        )
    )
    sizes = exp.obs.groupBy(*keys).agg(F.count("*").alias("n_cells"))
    safe = [sizes[k].eqNullSafe(sums[k]) for k in keys]
    grid = sizes.crossJoin(genes)  # a row per group and gene: the result's own size
    on = (grid["gene_id"] == sums["gene_id"])
    for c in safe:
        on = on & c
    out = grid.join(sums, on, "left").select(*[sizes[k] for k in keys], genes["gene_id"], "n_cells", "total", "squares", "nnz", "above", "total_above")
    out = out.fillna(0, subset=["total", "squares", "nnz", "above", "total_above"])
    if cutoff < 0:
        out = out.withColumn("above", F.col("above") + F.col("n_cells") - F.col("nnz"))
    return out


def mean_expr(
    exp: Experiment, *, group_by: Any, features: Sequence[str] | None = None, out_format: str = "long", layer: str | None = None, logcounts: bool = True, logmean: bool = True,
) -> DataFrame:
    """Mean of every gene in every group, over all cells. Log counts are averaged as counts; ``logmean`` takes the log of that mean.

    Long: ``gene, keys…, expr``; wide: genes × groups, the names of several keys joined by ``_``.
    """
    keys = as_list(group_by)
    mean = F.col("total") / F.col("n_cells")
    if logcounts and logmean:
        mean = F.log1p(mean)
    out = group_stats(exp, keys, features, layer, logcounts).select(F.col("gene_id").alias("gene"), *keys, mean.alias("expr"))
    if out_format == "long":
        return out
    return wide(out, "gene", keys, "expr")


def wide(df: DataFrame, row: str, keys: Sequence[str], value: str, prefix: str = "") -> DataFrame:
    """Long to wide: a column per group. The number of columns is that of the groups."""
    named = df.withColumn("__g", F.concat(F.lit(prefix), F.concat_ws("_", *keys)))
    return named.groupBy(row).pivot("__g").agg(F.first(value))


def log2fc(exp: Experiment, *, group_by: str, reference: str, groups: Any = None, features: Sequence[str] | None = None, layer: str | None = None, out_format: str = "wide") -> DataFrame:
    """Log2 fold change of each group's mean over the reference's; wide: ``genes, log2fc_<group>…``; long: ``genes, group, log2fc``."""
    means = group_stats(exp, [group_by], features, layer, True).select("gene_id", group_by, (F.col("total") / F.col("n_cells")).alias("m"))
    ref = means.where(F.col(group_by) == reference).select("gene_id", F.col("m").alias("r"))
    rest = means.where(F.col(group_by) != reference)
    if groups is not None:
        rest = rest.where(F.col(group_by).isin(as_list(groups)))
    fc = F.log2((F.col("m") + PSEUDO) / (F.col("r") + PSEUDO))
    out = rest.join(ref, "gene_id").select(F.col("gene_id").alias("genes"), F.col(group_by).alias("group"), fc.alias("log2fc"))
    return out if out_format == "long" else wide(out, "genes", ["group"], "log2fc", "log2fc_")


def pcts_cells(exp: Experiment, *, group_by: Any, features: Sequence[str] | None = None, min_expr: float = 0.0, out_format: str = "wide") -> DataFrame:
    """Share of each group's cells with a value above ``min_expr``, to 4 digits, halves to even."""
    keys = as_list(group_by)
    stats = group_stats(exp, keys, features, None, False, min_expr)
    out = stats.select(F.col("gene_id").alias("genes"), *keys, F.bround(F.col("above") / F.col("n_cells"), 4).alias("pct"))
    return out if out_format == "long" else wide(out, "genes", keys, "pct")


def cell_hash(cell: Column, seed: int = 0) -> Column:
    """A number that orders cells at random, from the cell's id and a seed."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), cell.cast("string")).cast("binary")), 1, 12), 16, 10).cast("long")


def _in_group(cells: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """Cells numbered from 0 in random order within their group, with the group's size.

    A group of any size is spread over buckets of the hash; numbers run on from bucket to bucket.
    """
    rows = cells.withColumn("__h", cell_hash(F.col("cell_id"), seed)).withColumn("__b", F.shiftright("__h", 38).cast("int"))
    counts = rows.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*keys)
    counts = counts.withColumn("__before", F.sum("__n").over(w.orderBy("__b")) - F.col("__n")).withColumn("n_group", F.sum("__n").over(w)).drop("__n")
    own = F.row_number().over(Window.partitionBy(*keys, "__b").orderBy("__h", "cell_id")) - 1
    numbered = rows.withColumn("__own", own).join(counts, [*keys, "__b"])
    return numbered.withColumn("place", F.col("__before") + F.col("__own")).drop("__h", "__b", "__own", "__before")


def pseudobulk(
    exp: Experiment, *, batch_key: str, cluster_key: str, min_cells: int = 10, approach: str = "sum", technical_replicates: int = 1, min_counts: float = 10,
    layer: str | None = None, seed: int = 0, keep_metadata: Any = None,
) -> DataFrame:
    """``cluster, batch, n_cells, gene, expr`` (and the metadata) summed or averaged over the cells of each cluster and batch.

    Groups under ``min_cells`` are left out. With replicates each group is cut at random into nearly equal parts, the
    first ones larger, named ``<batch>_<i>``. Then genes whose total over what is left isn't above ``min_counts`` go.
    """
    keys = [cluster_key, batch_key]
    meta = as_list(keep_metadata)
    exp.require([*keys, *meta])
    cells = exp.obs.select("cell_id", *keys, *meta).where(F.col(cluster_key).isNotNull() & F.col(batch_key).isNotNull())
    numbered = _in_group(cells, keys, seed).where(F.col("n_group") >= min_cells)
    r, n, p = F.lit(technical_replicates), F.col("n_group"), F.col("place")
    big, size = n % r, F.floor(n / r)  # `big` parts of size + 1 come first
    part = F.when(p < big * (size + 1), F.floor(p / (size + 1))).otherwise(big + F.floor((p - big * (size + 1)) / F.greatest(size, F.lit(1))))
    name = F.concat_ws("_", batch_key, part.cast("string")) if technical_replicates > 1 else F.col(batch_key).cast("string")
    cells = numbered.withColumn("__batch", name).drop(batch_key).withColumnRenamed("__batch", batch_key)
    sub = Experiment(cells.select("cell_id", *keys), exp.var, {"X": exp.layer(layer)})
    value = F.col("total") if approach == "sum" else F.col("total") / F.col("n_cells")
    out = group_stats(sub, keys).select(*keys, "n_cells", F.col("gene_id").alias("gene"), value.alias("expr"))
    total = out.groupBy("gene").agg(F.sum("expr").alias("t")).where(F.col("t") > min_counts)
    out = out.join(total.select("gene"), "gene", "left_semi").select(*keys, "n_cells", "gene", "expr")
    if meta:
        first = cells.groupBy(*keys).agg(*[F.min(c).alias(c) for c in meta])
        out = out.join(first, keys)
    return out


def metacell_members(exp: Experiment, *, batch_key: str, annotation_key: str, size: int = 10, min_cells: int = 50, seed: int = 0) -> DataFrame:
    """``cell_id, batch, annotation, metacell`` of the cells that belong to a full block of ``size``; others are left out.

    Metacells are numbered over all groups in order of annotation, batch and block; numbers come from counts per group.
    """
    keys = [annotation_key, batch_key]
    cells = exp.obs.select("cell_id", *keys).where(F.col(annotation_key).isNotNull() & F.col(batch_key).isNotNull())
    numbered = _in_group(cells, keys, seed).where(F.col("n_group") >= min_cells)
    counts = cells.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= min_cells).withColumn("blocks", F.floor(F.col("n") / size))
    start = F.sum("blocks").over(Window.orderBy(*keys)) - F.col("blocks")  # a row per group
    starts = counts.select(*keys, start.alias("start"))
    block = F.floor(F.col("place") / size)
    whole = numbered.withColumn("block", block).where((F.col("block") + 1) * size <= F.col("n_group"))
    return whole.join(starts, keys).select("cell_id", *keys, F.concat(F.lit("Metacell-"), (F.col("start") + F.col("block")).cast("string")).alias("metacell"))


def metacells(
    exp: Experiment, *, batch_key: str, annotation_key: str, size: int = 10, min_cells: int = 50, layer: str | None = "counts", agg_fx: str = "sum", seed: int = 0,
) -> DataFrame:
    """``metacell, batch, annotation, gene, expr``: sum, mean, var, median or count_nonzero of each gene over a metacell's cells."""
    members = metacell_members(exp, batch_key=batch_key, annotation_key=annotation_key, size=size, min_cells=min_cells, seed=seed)
    keys = ["metacell", batch_key, annotation_key]
    sub = Experiment(members, exp.var, {"X": exp.layer(layer)})
    if agg_fx == "median":
        stats = group_stats(sub, keys)
        held = exp.layer(layer).join(members, "cell_id").groupBy(*keys, "gene_id").agg(F.collect_list("value").alias("vs"))  # at most `size` values
        filled = F.array_sort(F.concat(F.coalesce("vs", F.array().cast("array<double>")), F.array_repeat(F.lit(0.0), (F.col("n_cells") - F.col("nnz")).cast("int"))))
        j = stats.join(held, [*keys, "gene_id"], "left").withColumn("a", filled)
        lo, hi = F.floor((F.size("a") + 1) / 2).cast("int"), F.floor((F.size("a") + 2) / 2).cast("int")
        return j.select(*keys, F.col("gene_id").alias("gene"), ((F.element_at("a", lo) + F.element_at("a", hi)) / 2).alias("expr"))
    n = F.col("n_cells")
    fx = {
        "sum": F.col("total"),
        "mean": F.col("total") / n,
        "var": div(F.col("squares") - F.col("total") * F.col("total") / n, n - 1),
        "count_nonzero": F.col("nnz").cast("double"),
    }
    if agg_fx not in fx:
        raise InputError(f"agg_fx is one of median, {', '.join(fx)}")
    return group_stats(sub, keys).select(*keys, F.col("gene_id").alias("gene"), fx[agg_fx].alias("expr"))


def matrix_view(
    exp: Experiment, *, keys: Any, features: Sequence[str] | None = None, layer: str | None = None, logcounts: bool = True, cutoff: float = 0.0, only_expressing: bool = False,
) -> DataFrame:
    """``gene, keys…, expr, pct`` of every group: (log) mean, optionally over cells above the cutoff only, and the share of such cells."""
    keys = as_list(keys)
    s = group_stats(exp, keys, features, layer, logcounts, cutoff)
    mean = F.coalesce(div(F.col("total_above"), F.col("above")), F.lit(0.0)) if only_expressing else F.col("total") / F.col("n_cells")
    return s.select(F.col("gene_id").alias("gene"), *keys, (F.log1p(mean) if logcounts else mean).alias("expr"), (F.col("above") / F.col("n_cells")).alias("pct"))


def logsem(exp: Experiment, *, keys: Any, features: Sequence[str] | None = None, layer: str | None = None) -> DataFrame:
    """``gene, keys…, n_cells, logmean, logsem``; the error of the mean in count space, 0 for a single cell."""
    keys = as_list(keys)
    s = group_stats(exp, keys, features, layer, True)
    n, t = F.col("n_cells"), F.col("total")
    var = F.greatest(div(F.col("squares") - t * t / n, n - 1), F.lit(0.0))
    sem = F.when(n > 1, F.sqrt(var / n)).otherwise(F.lit(0.0))
    return s.select(F.col("gene_id").alias("gene"), *keys, "n_cells", F.log1p(t / n).alias("logmean"), F.log1p(sem).alias("logsem"))


def colour_cap(exp: Experiment, *, features: Sequence[str], share: float = 0.992, group: str | None = None, layer: str | None = None) -> DataFrame:
    """``gene, cap``: the exact percentile of each gene, zeros included, averaged over the groups if there is one."""
    keys = [group] if group else []
    values = expr(exp, features=features, groups=keys, layer=layer)
    per = values.groupBy("genes", *keys).agg(F.expr(f"percentile(expr, {share})").alias("cap"))
    return per.groupBy(F.col("genes").alias("gene")).agg(F.avg("cap").alias("cap"))


def centroids(vectors: DataFrame, labels: DataFrame, label: str, axes: int = 2) -> DataFrame:
    """``label, c0, c1…``: the median of each label's first coordinates."""
    joined = vectors.join(labels.select("cell_id", label), "cell_id")
    return joined.groupBy(label).agg(*[F.expr(f"percentile(CAST(vec[{i}] AS DOUBLE), 0.5)").alias(f"c{i}") for i in range(axes)])
