"""Quality metrics, filters and normalisation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantell.experiment import Experiment, InputError, as_list, require_counts
from quantell.operators.expression import div
from quantell.plans.shared import settled

#: Default gene families by lower-case prefix.
PATTERNS: Mapping[str, Any] = {"mt": "mt-", "ribo": ("rbs", "rpl")}


def flag_genes(var: DataFrame, patterns: Mapping[str, Any] = PATTERNS, regex: bool = False) -> DataFrame:
    """``var`` with a flag per family: names that start, without regard to case, with one of its prefixes (or match)."""
    name = F.lower("gene_id")
    out = var
    for family, wanted in patterns.items():
        hit = F.lit(False)
        for p in as_list(wanted):
            hit = hit | (name.rlike(p.lower()) if regex else name.startswith(p.lower()))
        out = out.withColumn(family, hit)
    return out


def cell_metrics(exp: Experiment, patterns: Mapping[str, Any] = PATTERNS, layer: str | None = None, regex: bool = False) -> DataFrame:
    """``obs`` with genes seen, total counts, their logs, and per family total, log and percentage of each cell."""
    flags = flag_genes(exp.var.select("gene_id"), patterns, regex)
    per = exp.layer(layer).join(flags, "gene_id").groupBy("cell_id").agg(
        F.count(F.when(F.col("value") != 0, 1)).alias("n_genes_by_counts"), F.sum("value").alias("total_counts"),
        *[F.sum(F.when(F.col(f), F.col("value")).otherwise(0.0)).alias(f"total_counts_{f}") for f in patterns],
    )
    names = ["n_genes_by_counts", "total_counts", *[f"total_counts_{f}" for f in patterns]]
    out = exp.obs.drop(*names).join(per, "cell_id", "left").fillna(0, subset=names)
    out = out.withColumns({f"log1p_{c}": F.log1p(c) for c in names})
    return out.withColumns({f"pct_counts_{f}": F.coalesce(100 * div(F.col(f"total_counts_{f}"), F.col("total_counts")), F.lit(0.0)) for f in patterns})


def gene_metrics(exp: Experiment, layer: str | None = None) -> DataFrame:
    """``var`` with cells seen in, mean and total counts, and the percentage of cells without the gene."""
    n = exp.obs.agg(F.count("*").alias("n"))
    per = exp.layer(layer).groupBy("gene_id").agg(F.count(F.when(F.col("value") != 0, 1)).alias("n_cells_by_counts"), F.sum("value").alias("total_counts"))
    out = exp.var.join(per, "gene_id", "left").fillna(0, subset=["n_cells_by_counts", "total_counts"]).join(F.broadcast(n))  # one row is broadcast
    out = out.withColumn("mean_counts", div(F.col("total_counts"), F.col("n"))).withColumn("pct_dropout_by_counts", 100 * (1 - div(F.col("n_cells_by_counts"), F.col("n"))))
    return out.withColumns({"log1p_mean_counts": F.log1p("mean_counts"), "log1p_total_counts": F.log1p("total_counts")}).drop("n")


def quantile_bounds(obs: DataFrame, low: float | None, high: float | None, col: str = "total_counts") -> tuple[float | None, float | None]:
    """Exact percentiles (0 to 100, linear) as bounds; 0 and None give none."""
    wanted = [q / 100 for q in (low, high) if q]
    if not wanted:
        return None, None
    got = obs.agg(F.expr(f"percentile({col}, array({', '.join(map(str, wanted))}))")).first()[0] or []
    it = iter(got)
    return (next(it, None) if low else None), (next(it, None) if high else None)


def filter_quantiles(obs: DataFrame, low: float | None = None, high: float | None = None, col: str = "total_counts") -> DataFrame:
    """Cells strictly between the percentiles of the unfiltered column."""
    lo, hi = quantile_bounds(obs, low, high, col)
    if lo is not None:
        obs = obs.where(F.col(col) > lo)
    if hi is not None:
        obs = obs.where(F.col(col) < hi)
    return obs


def filter_cells_genes(
    exp: Experiment, *, min_genes_in_cell: int = 300, min_cells_with_genes: int = 5, cut_mt: float = 5, min_counts: float | None = None, max_counts: float | None = None,
    min_genes: int | None = None, max_genes: int | None = None, low_quantile: float | None = None, high_quantile: float | None = None, patterns: Mapping[str, Any] = PATTERNS,
    mt_family: str = "mt", layer: str | None = None, doublet_col: str | None = None, batch_key: str | None = None,
) -> Experiment:
    """Cells with enough genes, then genes in enough cells, then cells by mitochondrial share, counts, genes and percentiles.

    Bounds on counts and genes are inclusive, the mitochondrial one and percentiles are strict; percentiles are those of
    the cells left by all other bounds. At most one kind of lower and one kind of upper bound on counts may be given.
    With a batch each is treated as if it were alone: a gene too rare in one of them loses its values there only, and
    percentiles are the batch's own.
    """
    if min_counts is not None and low_quantile or max_counts is not None and high_quantile:
        raise InputError("give counts or quantiles as a bound, not both")
    exp = exp.settled(layer, *exp.layers)
    m = settled(cell_metrics(exp, patterns, layer))
    exp = replace(exp, obs=m).keep(cells=m.where(F.col("n_genes_by_counts") >= min_genes_in_cell))
    seen = exp.layer(layer).where("value <> 0")
    if batch_key:
        owner = exp.obs.select("cell_id", F.col(batch_key).alias("__batch"))
        often = seen.join(owner, "cell_id").groupBy("__batch", "gene_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_cells_with_genes).drop("n")
        layers = {k: v.join(owner, "cell_id").join(often, ["__batch", "gene_id"], "left_semi").drop("__batch") for k, v in exp.layers.items()}
        exp = replace(exp, layers=layers, var=exp.var.join(often.select("gene_id").distinct(), "gene_id", "left_semi"))
    else:
        exp = exp.keep(genes=seen.groupBy("gene_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_cells_with_genes))
    obs = exp.obs
    if f"pct_counts_{mt_family}" in obs.columns:
        obs = obs.where(F.col(f"pct_counts_{mt_family}") < cut_mt)
    for col, lo, hi in (("total_counts", min_counts, max_counts), ("n_genes_by_counts", min_genes, max_genes)):
        if lo is not None:
            obs = obs.where(F.col(col) >= lo)
        if hi is not None:
            obs = obs.where(F.col(col) <= hi)
    if batch_key and (low_quantile or high_quantile):
        bounds = obs.groupBy(batch_key).agg(F.expr(f"percentile(total_counts, array({(low_quantile or 0) / 100}, {(high_quantile or 100) / 100}))").alias("__q"))
        obs = obs.join(bounds, batch_key)
        if low_quantile:
            obs = obs.where(F.col("total_counts") > F.col("__q")[0])
        if high_quantile:
            obs = obs.where(F.col("total_counts") < F.col("__q")[1])
        obs = obs.drop("__q")
    else:
        obs = filter_quantiles(obs, low_quantile, high_quantile)
    if doublet_col:
        obs = obs.where(F.col(doublet_col) == "singlet")
    obs = settled(obs)
    return replace(exp, obs=obs).keep(cells=obs)


def history(steps: Sequence[tuple[str, Experiment, str]]) -> DataFrame:
    """``QC_Step, nCells, nFeatures, Comments`` of an experiment after each step."""
    out = None
    for i, (name, exp, comment) in enumerate(steps):
        row = exp.obs.agg(F.count("*").alias("nCells")).crossJoin(exp.var.agg(F.count("*").alias("nFeatures")))  # one row each
        row = row.select(F.lit(i).alias("n"), F.lit(name).alias("QC_Step"), "nCells", "nFeatures", F.lit(comment).alias("Comments"))
        out = row if out is None else out.union(row)
    return out.drop("n")


def qc_medians(obs: DataFrame, cols: Sequence[str], by: str | None = None) -> DataFrame:
    """Medians rounded down, as violin labels show them."""
    keys = [by] if by else []
    return obs.groupBy(*keys).agg(*[F.floor(F.expr(f"percentile({c}, 0.5)")).alias(c) for c in cols])


def normalise(exp: Experiment, *, target_sum: float = 1e4, log_data: bool = True, layer: str | None = None, check: bool = False) -> DataFrame:
    """The layer with every cell scaled to ``target_sum``, then log1p. Zeros stay zeros, cells without counts stay empty."""
    if check:
        require_counts(exp, layer)
    values = exp.layer(layer)
    total = F.sum("value").over(Window.partitionBy("cell_id"))
    scaled = div(F.col("value") * target_sum, total)
    return values.withColumn("__v", F.log1p(scaled) if log_data else scaled).select("cell_id", "gene_id", F.col("__v").alias("value")).where("value <> 0")


def log_normalize(exp: Experiment, *, target_sum: float = 1e4, log_data: bool = True, layer: str | None = None) -> Experiment:
    """The experiment with ``counts`` kept, and ``X`` and ``logcounts`` normalised."""
    out = normalise(exp, target_sum=target_sum, log_data=log_data, layer=layer)
    name = "logcounts" if log_data else "norm_counts"
    return exp.with_layer("counts", exp.layer(layer)).with_layer(name, out).with_layer("X", out)


def sqrt_normalise(exp: Experiment, layer: str | None = None) -> DataFrame:
    """Square roots of counts scaled to the median total."""
    totals = exp.layer(layer).groupBy("cell_id").agg(F.sum("value").alias("t"))
    median = totals.agg(F.expr("percentile(t, 0.5)").alias("m"))
    out = exp.layer(layer).join(totals, "cell_id").join(F.broadcast(median))  # one row is broadcast
    return out.select("cell_id", "gene_id", F.sqrt(F.col("value") / F.col("t") * F.col("m")).alias("value"))


def pearson_residuals(exp: Experiment, *, batch_key: str | None = None, theta: float = 100, layer: str | None = None) -> DataFrame:
    """``cell_id, gene_id, value`` of every cell and gene: residuals of a negative binomial null model, clipped at √cells.

    Runs within each batch where one is named. The result is dense, so its size is cells × genes: that of the result.
    """
    keys = [batch_key] if batch_key else []
    values = exp.layer(layer).join(exp.obs.select("cell_id", *keys), "cell_id")
    rows = values.groupBy("cell_id").agg(F.sum("value").alias("row"))
    cols = values.groupBy(*keys, "gene_id").agg(F.sum("value").alias("col"))
    totals = cols.groupBy(*keys).agg(F.sum("col").alias("all"))
    n = exp.obs.groupBy(*keys).agg(F.count("*").alias("n"))
    cells = exp.obs.select("cell_id", *keys).join(rows, "cell_id", "left").fillna(0.0, subset=["row"])
    if keys:
        grid = cells.join(n.join(totals, keys), keys).join(cols, keys)
    else:
        grid = cells.crossJoin(F.broadcast(n.crossJoin(totals))).crossJoin(cols)  # cells × genes: the result's size
    grid = grid.join(values.select("cell_id", "gene_id", "value"), ["cell_id", "gene_id"], "left")
    mu = div(F.col("row") * F.col("col"), F.col("all"))
    r = F.coalesce(div(F.coalesce("value", F.lit(0.0)) - mu, F.sqrt(mu + mu * mu / theta)), F.lit(0.0))
    clip = F.sqrt("n")
    return grid.select("cell_id", *keys, "gene_id", F.greatest(F.least(r, clip), -clip).alias("value"))


def barcode_ranks(exp: Experiment, layer: str | None = None) -> DataFrame:
    """``total_counts, rank, n_cells``: the curve of totals from high to low, a point per total: the rank of its last cell."""
    totals = exp.layer(layer).groupBy("cell_id").agg(F.sum("value").alias("total_counts")).groupBy("total_counts").agg(F.count("*").alias("n_cells"))
    part = F.floor(F.log2("total_counts") * 16).cast("int")
    totals = totals.where("total_counts > 0").withColumn("b", part)
    sums = totals.groupBy("b").agg(F.sum("n_cells").alias("bn"))
    before = sums.select("b", (F.sum("bn").over(Window.orderBy(F.desc("b"))) - F.col("bn")).alias("before"))  # a row per bucket
    inside = F.sum("n_cells").over(Window.partitionBy("b").orderBy(F.desc("total_counts")))
    return totals.withColumn("own", inside).join(before, "b").select("total_counts", (F.col("before") + F.col("own")).alias("rank"), "n_cells")


def highly_variable(exp: Experiment, *, n_top: int = 2000, bins: int = 20, batch_key: str | None = None, layer: str | None = None) -> DataFrame:
    """``gene_id, means, dispersions, dispersions_norm, highly_variable`` from log values, dispersions compared within bins of the mean.

    With a batch the normalised dispersion is averaged over batches, after counting in how many a gene is among the top.
    """
    from quantell.operators.expression import group_stats

    keys = [batch_key] if batch_key else []
    s = group_stats(exp, keys or ["__all"], None, layer, True) if keys else group_stats(replace(exp, obs=exp.obs.withColumn("__all", F.lit(0))), ["__all"], None, layer, True)
    keys = keys or ["__all"]
    n, t = F.col("n_cells"), F.col("total")
    mean = t / n
    var = F.greatest(div(F.col("squares") - t * mean, n - 1), F.lit(0.0))
    d = s.select(*keys, "gene_id", F.log1p(mean).alias("means"), F.when((var > 0) & (mean > 0), F.log(div(var, mean))).alias("dispersions"))
    w = Window.partitionBy(*keys)
    lo, hi = F.min("means").over(w), F.max("means").over(w)
    b = F.least(F.floor(F.coalesce(div(F.col("means") - lo, hi - lo), F.lit(0.0)) * bins), F.lit(bins - 1))
    d = d.withColumn("bin", b)
    wb = Window.partitionBy(*keys, "bin")
    sd, m, k = F.stddev_samp("dispersions").over(wb), F.avg("dispersions").over(wb), F.count("dispersions").over(wb)
    norm = F.when(k < 2, F.lit(1.0)).otherwise(div(F.col("dispersions") - m, sd))
    d = d.withColumn("dispersions_norm", norm)
    place = F.row_number().over(w.orderBy(F.desc_nulls_last("dispersions_norm"), "gene_id"))
    d = d.withColumn("top", (place <= n_top).cast("int"))
    g = d.groupBy("gene_id").agg(F.avg("means").alias("means"), F.avg("dispersions").alias("dispersions"), F.avg("dispersions_norm").alias("dispersions_norm"), F.sum("top").alias("n_batches"))
    place = F.row_number().over(Window.orderBy(F.desc("n_batches"), F.desc_nulls_last("dispersions_norm"), "gene_id"))  # a row per gene
    return g.withColumn("highly_variable", place <= n_top)


def doublet_scores(exp: Experiment, *, batch_key: str | None = None, layer: str | None = None, rate: float = 0.06, **knn_args: Any) -> DataFrame:
    """``cell_id, doublet_score, doublet_class`` by simulated doublets: sums of random pairs of a batch join the cells, and
    a cell's score is the share of simulated ones among its nearest neighbours in log-normalised space."""
    from quantell.operators.neighbours import doublet_neighbours

    return doublet_neighbours(exp, batch_key=batch_key, layer=layer, rate=rate, **knn_args)


def quality_control(exp: Experiment, *, batch_key: str | None = None, n_reads: float = 1e4, log_data: bool = True, **bounds: Any) -> tuple[Experiment, DataFrame]:
    """The whole pipeline on raw counts: filters, history, normalisation; one plan for all batches, each filtered as if alone."""
    kept = filter_cells_genes(exp, batch_key=batch_key, **bounds)
    return log_normalize(kept, target_sum=n_reads, log_data=log_data), history([("Input", exp, ""), ("Filtered", kept, str(bounds))])
