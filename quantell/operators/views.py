"""The data behind plots: what is drawn, without drawing."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantell.experiment import Experiment, InputError, as_list
from quantell.operators.expression import div, expr, logsem, matrix_view, mean_expr

#: Limits of a volcano plot.
PVAL_LIMIT, LFC_LIMITS = 2e-10, (-6.0, 6.0)


def scaled(df: DataFrame, value: str, within: Sequence[str], how: str, out: str | None = None) -> DataFrame:
    """``value`` as z-scores (over n) or brought to [0, 1], within the columns ``within``; what can't be scaled is 0."""
    w = Window.partitionBy(*within)
    v = F.col(value)
    if how == "zscore":
        sd = F.stddev_pop(v).over(w)
        s = div(v - F.avg(v).over(w), F.when(sd > 1e-12, sd))
    elif how == "minmax":
        lo, hi = F.min(v).over(w), F.max(v).over(w)
        s = div(v - lo, hi - lo)
    else:
        raise InputError("how is zscore or minmax")
    return df.withColumn(out or value, F.coalesce(s, F.lit(0.0)))


def dotplot(
    exp: Experiment, *, x_axis: str, features: Sequence[str] | None, y_axis: str | None = None, layer: str | None = None, logcounts: bool = True, cutoff: float = 0.0,
    mean_only_expressed: bool = False, standard_scale: str | None = None, z_score: str | None = None,
) -> DataFrame:
    """``gene, x (, y), expr, pct``: colour and size of the dots of one or two axes.

    ``standard_scale`` is ``group`` (min-max over a group's genes) or ``var`` (over a gene's groups); ``z_score`` is ``x``
    or ``y`` (within each x, or each y, of a gene). Groups that don't occur together are 0.
    """
    keys = [x_axis] + ([y_axis] if y_axis else [])
    v = matrix_view(exp, keys=keys, features=features, layer=layer, logcounts=logcounts, cutoff=cutoff, only_expressing=mean_only_expressed)
    if y_axis:
        grid = exp.obs.select(x_axis).distinct().crossJoin(exp.obs.select(y_axis).distinct()).crossJoin(exp.genes(features).withColumnRenamed("gene_id", "gene"))  # the plot's grid
        v = grid.join(v, ["gene", *keys], "left").fillna(0.0, subset=["expr", "pct"])
        if z_score:
            v = scaled(v, "expr", ["gene", x_axis if z_score == "x" else y_axis], "zscore")
    elif standard_scale:
        v = scaled(v, "expr", keys if standard_scale == "group" else ["gene"], "minmax")
    return v.select("gene", *keys, "expr", "pct")


def heatmap(exp: Experiment, *, keys: Any, features: Sequence[str] | None = None, layer: str | None = None, logcounts: bool = True, z_score: str | None = None) -> DataFrame:
    """``gene, keys…, expr``: means, as z-scores over a gene's groups (``var``) or a group's genes (``group``)."""
    keys = as_list(keys)
    m = mean_expr(exp, group_by=keys, features=features, layer=layer, logcounts=logcounts)
    return scaled(m, "expr", ["gene"] if z_score == "var" else keys, "zscore") if z_score else m


def heatmap_order(df: DataFrame, row: str, col: str, value: str, method: str = "complete", most: int = 5000) -> list:
    """Rows of a heatmap in dendrogram order; the matrix, groups × features of a plot, is held by the driver."""

    from quantell.operators.ora import leaf_order, linkage

    wide = df.groupBy(row).pivot(col).agg(F.first(value)).orderBy(row).limit(most + 1).toPandas()
    if len(wide) > most:
        raise InputError(f"more than {most} rows")
    x = wide.drop(columns=[row]).fillna(0.0).to_numpy(float)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    return [wide[row].iloc[i] for i in leaf_order(len(x), linkage(d, method))]


def heatmap_foldchange(exp: Experiment, *, group_by: str, condition_key: str, reference: str, features: Sequence[str] | None = None, layer: str | None = None) -> DataFrame:
    """``genes, group, condition, log2fc`` of every condition over the reference inside each group, in one plan."""
    from quantell.operators.expression import PSEUDO, group_stats

    s = group_stats(exp, [group_by, condition_key], features, layer, True)
    m = s.select("gene_id", F.col(group_by).alias("g"), F.col(condition_key).alias("c"), (F.col("total") / F.col("n_cells")).alias("m"))
    ref = m.where(F.col("c") == reference).select("gene_id", "g", F.col("m").alias("r"))
    fc = F.log2((F.col("m") + PSEUDO) / (F.col("r") + PSEUDO))
    return m.where(F.col("c") != reference).join(ref, ["gene_id", "g"]).select(F.col("gene_id").alias("genes"), F.col("g").alias("group"), F.col("c").alias("condition"), fc.alias("log2fc"))


def volcano(df: DataFrame, *, gene: str = "GeneName", lfc: str = "log2fc", pval: str = "padj", lfc_cut: float = 0.25, pval_cut: float = 0.05, clean: bool = True, topn: int = 10) -> DataFrame:
    """``gene, log2fc, padj, y, class, label``: points with clamped values, their class and whether they are labelled, the ``topn`` farthest of ``Up`` and of ``Down``, ties by gene and copies alike.

    Classes by strict bounds: ``NS``, ``LFC`` only, ``P`` only, ``Up`` and ``Down``. ``clean`` drops p of 1 and clamped points.
    """
    lo, hi = LFC_LIMITS
    p, f = F.greatest(F.col(pval), F.lit(PVAL_LIMIT)), F.greatest(F.least(F.col(lfc), F.lit(hi)), F.lit(lo))
    out = df.select(F.col(gene).alias("gene"), f.alias("log2fc"), p.alias("padj"))
    if clean:
        out = out.where((F.col("padj") < 1) & (F.col("padj") > PVAL_LIMIT) & (F.col("log2fc") > lo) & (F.col("log2fc") < hi))
    sig, big = F.col("padj") < pval_cut, F.abs("log2fc") > lfc_cut
    cls = F.when(sig & big & (F.col("log2fc") > 0), "Up").when(sig & big, "Down").when(sig, "P").when(big, "LFC").otherwise("NS")
    out = out.withColumns({"y": -F.log10("padj"), "class": cls})
    far = F.struct((-F.abs("log2fc")).alias("f"), "gene")
    last = None  # the place of the last labelled point of both classes: two rows are broadcast
    for c in ("Up", "Down"):
        top = out.where(F.col("class") == c).select(far.alias("far")).orderBy("far").limit(topn).agg(F.max("far").alias("last")).withColumn("class", F.lit(c))
        last = top if last is None else last.union(top)
    return out.join(F.broadcast(last), "class", "left").withColumn("label", F.coalesce(far <= F.col("last"), F.lit(False))).select(*out.columns, "label")


def correlation(exp: Experiment, *, group_by: str = "batch", method: str = "pearson", layer: str | None = None) -> DataFrame:
    """``a, b, r`` between the mean profiles of all pairs of groups."""
    m = mean_expr(exp, group_by=group_by, layer=layer).select("gene", F.col(group_by).alias("g"), "expr")
    if method == "spearman":
        w = Window.partitionBy("g")
        c = F.count("*").over(Window.partitionBy("g", "v"))
        m = m.withColumn("v", F.round("expr", 9)).withColumn("expr", F.rank().over(w.orderBy("v")) + (c - 1) / 2).select("gene", "g", "expr")
    a, b = m.select("gene", F.col("g").alias("a"), F.col("expr").alias("x")), m.select("gene", F.col("g").alias("b"), F.col("expr").alias("y"))
    j = a.join(b, "gene")
    if method in ("pearson", "spearman"):
        return j.groupBy("a", "b").agg(F.corr("x", "y").alias("r"))
    if method != "kendall":
        raise InputError("method is pearson, spearman or kendall")
    j = j.withColumns({"x": F.round("x", 9), "y": F.round("y", 9)})
    p, q = j.select("a", "b", F.col("gene").alias("g1"), F.col("x").alias("x1"), F.col("y").alias("y1")), j.select("a", "b", F.col("gene").alias("g2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    pairs = p.join(q, ["a", "b"]).where("g1 < g2")
    dx, dy = F.signum(F.col("x1") - F.col("x2")), F.signum(F.col("y1") - F.col("y2"))
    t = pairs.groupBy("a", "b").agg(F.sum(dx * dy).alias("s"), F.sum(dx * dx).alias("tx"), F.sum(dy * dy).alias("ty"))
    return t.select("a", "b", div(F.col("s"), F.sqrt(F.col("tx") * F.col("ty"))).alias("r"))


def cell_composition(obs: DataFrame, *, annot_key: str, condition_key: str, batch_key: str) -> DataFrame:
    """``condition, annotation, mean_prop, sd_prop, n_batches``: proportions per batch, zeros included, averaged per condition."""
    n = obs.groupBy(F.col(batch_key).alias("batch"), F.col(condition_key).alias("condition"), F.col(annot_key).alias("annotation")).agg(F.count("*").alias("n"))
    total = n.groupBy("batch", "condition").agg(F.sum("n").alias("total"))
    grid = total.crossJoin(n.select("annotation").distinct())  # batches × annotations: the table of proportions
    p = grid.join(n, ["batch", "condition", "annotation"], "left").withColumn("p", F.coalesce("n", F.lit(0)) / F.col("total"))
    return p.groupBy("condition", "annotation").agg(F.avg("p").alias("mean_prop"), F.stddev_samp("p").alias("sd_prop"), F.count("*").alias("n_batches"))


def composition_test(obs: DataFrame, *, annot_key: str, condition_key: str, batch_key: str, transform: str = "logit") -> DataFrame:
    """``annotation, statistic, df1, df2, pval``: analysis of variance of transformed proportions of batches between conditions."""
    from quantell.operators.testing import anova

    n = obs.groupBy(F.col(batch_key).alias("batch"), F.col(condition_key).alias("condition"), F.col(annot_key).alias("annotation")).agg(F.count("*").alias("n"))
    total = n.groupBy("batch", "condition").agg(F.sum("n").alias("total"))
    grid = total.crossJoin(n.select("annotation").distinct())
    c = F.coalesce("n", F.lit(0))
    p = (c + 0.5) / (F.col("total") + 1) if transform == "logit" else c / F.col("total")
    v = F.log(p / (1 - p)) if transform == "logit" else F.asin(F.sqrt(p))
    rows = grid.join(n, ["batch", "condition", "annotation"], "left").withColumn("v", v)
    return anova(rows, "v", "condition", ["annotation"])


def split_bar(df: DataFrame, *, term: str, split: str, cond: str, pos_cond: str, topn: int = 10, log10_transform: bool = True) -> DataFrame:
    """``term, condition, value, place``: the first ``topn`` terms of each side, p-like values as −log10, signed by condition."""
    v = -F.log10(F.greatest(F.col(split), F.lit(1e-300))) if log10_transform else F.col(split)
    name = F.concat(F.upper(F.substring(term, 1, 1)), F.lower(F.expr(f"substring(`{term}`, 2)")))
    side = df.select(name.alias("term"), F.col(cond).alias("condition"), F.when(F.col(cond) == pos_cond, v).otherwise(-v).alias("value"))
    place = F.row_number().over(Window.partitionBy(F.col("condition") == pos_cond).orderBy(F.desc(F.abs("value")), "term"))
    return side.withColumn("place", place).where(F.col("place") <= topn)


def box_stats(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """``by…, n, q1, median, q3, low, high``: exact quartiles, and whiskers at the last values within 1.5 times their range."""
    by = list(by)
    q = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(value).alias("n"), F.expr(f"percentile({value}, array(0.25, 0.5, 0.75))").alias("q"))
    q = q.select(*by, "n", *[F.col("q")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))])
    r = 1.5 * (F.col("q3") - F.col("q1"))
    inside = df.join(q, by).where((F.col(value) >= F.col("q1") - r) & (F.col(value) <= F.col("q3") + r))
    return q.join(inside.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high")), by)


def barplot(exp: Experiment, *, x_axis: str, feature: str, batch_key: str | None = None, hue: str | None = None, layer: str | None = None, estimator: str = "logmean") -> DataFrame:
    """``x (, hue) (, batch), expr``: bars, or with a batch the points over them; estimators logmean, mean, median."""
    keys = [k for k in (x_axis, hue, batch_key) if k]
    if feature in exp.obs.columns:
        values = exp.obs.select(*keys, F.col(feature).cast("double").alias("expr"))
        agg = F.avg("expr") if estimator != "median" else F.expr("percentile(expr, 0.5)")
        return values.groupBy(*keys).agg(agg.alias("expr"))
    if estimator == "median":
        return expr(exp, features=[feature], groups=keys, layer=layer).groupBy(*keys).agg(F.expr("percentile(expr, 0.5)").alias("expr"))
    m = mean_expr(exp, group_by=keys, features=[feature], layer=layer, logcounts=estimator in ("logmean", "expm1mean"), logmean=estimator == "logmean")
    return m.select(*keys, "expr")


def lineplot(exp: Experiment, *, x_axis: str, features: Sequence[str], hue: str | None = None, layer: str | None = None) -> DataFrame:
    """``gene, x (, hue), logmean, logsem``."""
    return logsem(exp, keys=[x_axis] + ([hue] if hue else []), features=features, layer=layer)


def _kernel(u: Column) -> Column:
    return F.exp(-u * u / 2)


def kde_1d(df: DataFrame, value: str, by: str, points: int = 500, bw_adjust: float = 0.5, ridge_height: float | None = None) -> DataFrame:
    """``by, x, density``: Gaussian kernels with Scott's width on an even grid from the least to the greatest value of all.

    Values that occur more than once weigh as often, so the join with the grid is distinct values × points.
    """
    v = df.where(F.col(value).isNotNull()).select(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).groupBy("g", "v").agg(F.count("*").cast("double").alias("w"))
    n = F.sum("w")
    m = F.sum(F.col("w") * F.col("v"))
    s = v.groupBy("g").agg(n.alias("n"), div(F.sum(F.col("w") * F.col("v") * F.col("v")) - m * m / n, n - 1).alias("var"))
    s = s.withColumn("h", F.pow(F.col("n"), F.lit(-0.2)) * bw_adjust * F.greatest(F.sqrt(F.greatest("var", F.lit(0.0))), F.lit(1e-5)))
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    grid = ends.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / (points - 1))).alias("x"))
    d = v.join(s, "g").crossJoin(F.broadcast(grid))  # `points` rows are broadcast
    k = F.sum(F.col("w") * _kernel((F.col("x") - F.col("v")) / F.col("h")) / (F.col("n") * F.col("h") * 2.5066282746310002))
    out = d.groupBy("g", "x").agg(k.alias("density"))
    if ridge_height:
        out = out.withColumn("density", F.col("density") / F.max("density").over(Window.partitionBy("g")) * ridge_height)
    return out.withColumnRenamed("g", by)


def density_2d(points: DataFrame, *, x: str, y: str, weight: str | None = None, by: str | None = None, gridsize: int = 50, bw_adjust: float = 0.5) -> DataFrame:
    """``(by,) gx, gy, x, y, density``: weighted two-dimensional Gaussian kernels with Scott's width per axis."""
    p = points.select(F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), (F.col(by) if by else F.lit("")).alias("g"))
    p = p.where("px IS NOT NULL AND py IS NOT NULL AND w > 0")
    w = F.sum("w")
    # moments around the middle of all points, so that squares don't cancel
    s = p.crossJoin(F.broadcast(p.agg(F.avg("px").alias("mx"), F.avg("py").alias("my")))).groupBy("g").agg(  # one row is broadcast
        w.alias("n"), (w * w / F.sum(F.col("w") * F.col("w"))).alias("neff"),
        *[(F.sum(F.col("w") * d * d) / w - (F.sum(F.col("w") * d) / w) ** 2).alias(f"v{c}") for c, d in (("px", F.col("px") - F.col("mx")), ("py", F.col("py") - F.col("my")))],
    )
    h = lambda c: F.pow("neff", F.lit(-1 / 6)) * bw_adjust * F.sqrt(F.greatest(F.col(c) * F.col("neff") / F.greatest(F.col("neff") - 1, F.lit(1.0)), F.lit(1e-10)))
    s = s.select("g", "n", h("vpx").alias("hx"), h("vpy").alias("hy"))
    ends = p.agg(*[f(c).alias(f"{n}{c}") for c in ("px", "py") for n, f in (("lo", F.min), ("hi", F.max))])
    rows = p.join(s, "g").crossJoin(F.broadcast(ends)).select("g", "px", "py", "w", "n", "hx", "hy", "lopx", "hipx", "lopy", "hipy")  # one row is broadcast
    kind = dict(rows.dtypes)["g"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A point's kernel is a product over both axes, so those of a batch sum up in one product of matrices."""
        held: dict[object, np.ndarray] = {}
        for b in batches:
            px, py, weight, n, hx, hy, *bounds = (b.column(i).to_numpy() for i in range(1, 11))
            names = b.column(0).dictionary_encode()
            code, at = names.indices.to_numpy(zero_copy_only=False), np.arange(gridsize) / max(gridsize - 1, 1)
            for k, name in enumerate(names.dictionary.to_pylist()):
                r = np.flatnonzero(code == k)
                one, two = (np.exp(-(((lo[r][:, None] + (hi - lo)[r][:, None] * at - x[r][:, None]) / width[r][:, None]) ** 2) / 2) for lo, hi, x, width in ((bounds[0], bounds[1], px, hx), (bounds[2], bounds[3], py, hy)))
                held[name] = held.get(name, 0) + one.T @ (two * (weight / (n * hx * hy * 6.283185307179586))[r][:, None])
        for name, m in held.items():
            gx, gy = np.indices(m.shape)
            yield pa.RecordBatch.from_arrays([pa.array([name] * m.size), pa.array(gx.ravel().astype(np.int32)), pa.array(gy.ravel().astype(np.int32)), pa.array(m.ravel())], ["g", "gx", "gy", "d"])

    at = lambda c, g: F.col(f"lo{c}") + (F.col(f"hi{c}") - F.col(f"lo{c}")) * F.col(g) / max(gridsize - 1, 1)
    out = rows.where("g IS NOT NULL").mapInArrow(sums, f"g {kind}, gx int, gy int, d double").groupBy("g", "gx", "gy").agg(F.sum("d").alias("density"))
    out = out.crossJoin(F.broadcast(ends)).select("g", "gx", "gy", at("px", "gx").alias("x"), at("py", "gy").alias("y"), "density")
    return out.withColumnRenamed("g", by) if by else out.drop("g")


def embedding(exp: Experiment, *, basis: str, color: str, layer: str | None = None, share: float = 0.992) -> DataFrame:
    """``cell_id, x, y, color, cap``: points with a gene's value or a metadata column, and the shared cap of the colour scale."""
    v = exp.obsm[basis].select("cell_id", F.col("vec")[0].cast("double").alias("x"), F.col("vec")[1].cast("double").alias("y"))
    if color in exp.obs.columns:
        return v.join(exp.obs.select("cell_id", F.col(color).alias("color")), "cell_id").withColumn("cap", F.lit(None).cast("double"))
    values = expr(exp, features=[color], layer=layer).select("cell_id", F.col("expr").alias("color"))
    cap = values.agg(F.expr(f"percentile(color, {share})").alias("cap"))
    return v.join(values, "cell_id").join(F.broadcast(cap))  # one row is broadcast


