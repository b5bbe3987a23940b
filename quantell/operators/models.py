"""Tests that fit a model per gene: logistic scores, hurdle model, negative binomial models of pseudobulks, consensus.

Cells are reduced to sums per gene and group in one aggregation; only those, a few rows per gene, reach Python.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantell.experiment import Experiment, InputError, as_list
from quantell.functions.special import f_sf_array, gamma_q, norm_sf_array
from quantell.operators.expression import div, mean_expr, pcts_cells, pseudobulk
from quantell.operators.expression import log2fc as fold_changes
from quantell.operators.neighbours import dense_vectors
from quantell.operators.testing import adjust, rank_genes_groups, with_two_sample_t
from quantell.plans.shared import written

#: Genes of a group that one task of a pseudobulk test fits.
GENES_AT_ONCE = 256


def logreg_scores(exp: Experiment, groupby: str, groups: Any = None, layer: str | None = None, c: float = 1.0, max_iter: int = 100) -> DataFrame:
    """``group, gene, score``: coefficients of a ridge logistic regression of the groups on all genes.

    Of two groups the first one's only. The penalty equals ``C = c`` of the usual scaled loss. The matrix of
    coefficients, groups × genes, is what the driver holds.
    """
    genes = [r.gene_id for r in exp.var.select("gene_id").orderBy("gene_id").collect()]
    obs = exp.obs.where(F.col(groupby).isNotNull())
    if groups is not None:
        obs = obs.where(F.col(groupby).isin(as_list(groups)))
    names = [r[0] for r in obs.select(groupby).distinct().orderBy(groupby).collect()]
    if len(names) < 2:
        raise InputError("two groups are needed")
    code = F.create_map(*[x for i, g in enumerate(names) for x in (F.lit(g), F.lit(float(i)))])
    data = dense_vectors(exp, genes, layer).join(obs.select("cell_id", groupby), "cell_id").select(array_to_vector(F.col("vec").cast("array<double>")).alias("features"), code[F.col(groupby)].alias("label"))
    n = obs.count()
    fit = LogisticRegression(regParam=1.0 / (n * c), elasticNetParam=0.0, standardization=False, maxIter=max_iter).fit(data)
    m = fit.coefficientMatrix.toArray()
    rows = [(names[0], g, float(-m[0, j])) for j, g in enumerate(genes)] if len(names) == 2 else [(k, g, float(m[i, j])) for i, k in enumerate(names) for j, g in enumerate(genes)]
    return exp.obs.sparkSession.createDataFrame(rows, "group string, gene string, score double")


def _irls(x: np.ndarray, y: np.ndarray, m: np.ndarray) -> float:
    """Log-likelihood of a logistic fit of ``y`` successes among ``m`` per row of the design, slightly penalised."""
    b = np.zeros(x.shape[1])
    for _ in range(50):
        eta = np.clip(x @ b, -30, 30)
        p = 1 / (1 + np.exp(-eta))
        w = np.maximum(m * p * (1 - p), 1e-10)
        step = np.linalg.solve(x.T @ (w[:, None] * x) + 1e-6 * np.eye(x.shape[1]), x.T @ (y - m * p) - 1e-6 * b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ b, -30, 30))), 1e-12, 1 - 1e-12)
    return float((y * np.log(p) + (m - y) * np.log1p(-p)).sum())


def _gaussian(x: np.ndarray, n: np.ndarray, s: np.ndarray, q: float) -> float:
    """−2 log-likelihood, up to a constant, of a weighted fit of the means ``s / n``; q: the sum of squares."""
    mean = s / np.maximum(n, 1e-300)
    w = np.sqrt(n)
    b = np.linalg.lstsq(w[:, None] * x, w * mean, rcond=None)[0]
    rss = max(q - 2 * float(s @ (x @ b)) + float(n @ (x @ b) ** 2), 1e-12)
    return float(n.sum() * np.log(rss / max(n.sum(), 1e-300)))


def hurdle_test(exp: Experiment, *, cond_key: str, reference: str, disease: str, covariates: Sequence[str] = (), layer: str | None = None) -> DataFrame:
    """``GeneName, pvals, padj, log2fc, pts_group, pts_ref``: likelihood ratio of the condition in a hurdle model.

    One part models whether a gene is seen (logistic), the other its log value where it is (Gaussian); the statistic is
    the sum of both, χ² with two degrees of freedom, or one where too few cells see the gene. Covariates are
    categories. All that is fitted are counts and sums per gene, condition and covariates.
    """
    keys = [cond_key, *covariates]
    sub = Experiment(exp.obs.where(F.col(cond_key).isin([reference, disease])), exp.var, {"X": exp.layer(layer)})
    from quantell.operators.expression import group_stats

    g = group_stats(sub, keys).select("gene_id", *keys, "n_cells", "total", "squares", "nnz")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        rest = pd.get_dummies(pdf[list(covariates)].astype(str), drop_first=True).to_numpy(float) if covariates else np.zeros((len(pdf), 0))
        base = np.hstack([np.ones((len(pdf), 1)), rest])
        full = np.hstack([base, (pdf[cond_key] == disease).to_numpy(float)[:, None]])
        m, k, s = (pdf[c].to_numpy(float) for c in ("n_cells", "nnz", "total"))
        lr, df = 0.0, 0
        if 0 < k.sum() < m.sum():
            lr, df = lr + max(0.0, 2 * (_irls(full, k, m) - _irls(base, k, m))), df + 1
        seen = k > 0
        cond = pdf[cond_key].to_numpy()[seen]
        if k.sum() > full.shape[1] + 1 and len(set(cond)) == 2:
            q = float(pdf["squares"].sum())
            lr, df = lr + max(0.0, _gaussian(base[seen], k[seen], s[seen], q) - _gaussian(full[seen], k[seen], s[seen], q)), df + 1
        p = float(gamma_q(np.array([df / 2]), np.array([lr / 2]))[0]) if df else 1.0
        return pd.DataFrame({"GeneName": [pdf["gene_id"].iloc[0]], "statistic": [lr], "pvals": [p]})

    out = adjust(g.groupBy("gene_id").applyInPandas(fit, "GeneName string, statistic double, pvals double"), "pvals")
    fc = fold_changes(sub, group_by=cond_key, reference=reference, out_format="long").select(F.col("genes").alias("GeneName"), "log2fc")
    pts = pcts_cells(sub, group_by=cond_key, out_format="long")
    side = [pts.where(F.col(cond_key) == c).select(F.col("genes").alias("GeneName"), F.col("pct").alias(n)) for c, n in ((disease, "pts_group"), (reference, "pts_ref"))]
    return out.join(fc, "GeneName").join(side[0], "GeneName").join(side[1], "GeneName")


def size_factors(bulk: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``keys…, sample, size``: medians of ratios to the geometric mean, over genes seen in all samples; if none is, of totals.

    ``bulk`` is (keys…, sample, gene, expr).
    """
    keys = list(keys)
    g = bulk.groupBy(*keys, "gene").agg(F.avg(F.log("expr")).alias("m"), F.min("expr").alias("least")).where("least > 0")
    med = bulk.join(g, [*keys, "gene"]).groupBy(*keys, "sample").agg(F.exp(F.expr("percentile(ln(expr) - m, 0.5)")).alias("ratio"))
    total = bulk.groupBy(*keys, "sample").agg(F.sum("expr").alias("t"))
    mean = total.groupBy(*keys).agg(F.exp(F.avg(F.log("t"))).alias("gm")) if keys else total.agg(F.exp(F.avg(F.log("t"))).alias("gm"))
    j = total.join(mean, keys) if keys else total.join(F.broadcast(mean))  # one row is broadcast
    return j.join(med, [*keys, "sample"], "left").select(*keys, "sample", F.coalesce("ratio", div(F.col("t"), F.col("gm"))).alias("size"))


def _nb_fit(x: np.ndarray, y: np.ndarray, off: np.ndarray, a: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, their covariance and means of a negative binomial regression with log link and dispersion ``a``."""
    b = np.zeros(x.shape[1])
    b[0] = np.log(max(float((y / np.exp(off)).mean()), 1e-4))
    for _ in range(60):
        mu = np.exp(np.clip(x @ b + off, -30, 30))
        w = mu / (1 + a * mu)
        info = x.T @ (w[:, None] * x) + 1e-6 * np.eye(x.shape[1])
        step = np.linalg.solve(info, x.T @ ((y - mu) / (1 + a * mu)))
        b = b + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    mu = np.exp(np.clip(x @ b + off, -30, 30))
    w = mu / (1 + a * mu)
    return b, np.linalg.inv(x.T @ (w[:, None] * x) + 1e-6 * np.eye(x.shape[1])), mu


def _dispersion(y: np.ndarray, mu: np.ndarray, p: int) -> float:
    """Moment estimate of the dispersion, so that Pearson's statistic equals its degrees of freedom."""
    lo, hi = 1e-8, 10.0
    gap = lambda a: float(((y - mu) ** 2 / (mu + a * mu * mu)).sum()) - (len(y) - p)
    if gap(lo) <= 0:
        return lo
    for _ in range(60):
        mid = np.sqrt(lo * hi)
        lo, hi = (mid, hi) if gap(mid) > 0 else (lo, mid)
    return float(np.sqrt(lo * hi))


def _deviance(y: np.ndarray, mu: np.ndarray, a: float) -> float:
    t = np.where(y > 0, y * np.log(np.maximum(y, 1e-300) / mu), 0)
    return float(2 * (t - (y + 1 / a) * np.log((1 + a * y) / (1 + a * mu))).sum())


def pseudobulk_test(
    exp: Experiment, *, ctrl_cond: str, disease_cond: str, cluster_key: str, method: str = "deseq2", batch_key: str = "batch", condition_key: str = "condition", layer: str | None = "counts",
    min_cells: int = 50, approach: str = "sum", technical_replicates: int = 1, min_counts: float = 10, seed: int = 0,
) -> DataFrame:
    """``GeneName, baseMean, log2FoldChange, lfcSE, stat, pvalue, padj, group`` of every gene and cluster.

    Negative binomial regression of pseudobulks on the condition: ``deseq2`` gives Wald statistics with dispersions
    shrunk towards the trend over all genes of the cluster, ``edger`` quasi-likelihood F statistics. Clusters without
    two samples of each condition are left out. A sample is a batch within a condition.
    """
    if method not in ("deseq2", "edger"):
        raise InputError("method is deseq2 or edger")
    obs = exp.obs.where(F.col(condition_key).isin([ctrl_cond, disease_cond]))
    named = obs.withColumn("__sample", F.concat_ws("\u001f", batch_key, condition_key))
    sub = Experiment(named, exp.var, {"X": exp.layer(layer)})
    b = pseudobulk(sub, batch_key="__sample", cluster_key=cluster_key, min_cells=min_cells, approach=approach, technical_replicates=technical_replicates, min_counts=min_counts, seed=seed)
    cond = F.regexp_replace(F.element_at(F.split("__sample", "\u001f"), -1), "_\\d+$", "") if technical_replicates > 1 else F.element_at(F.split("__sample", "\u001f"), -1)
    bulk = b.select(F.col(cluster_key).alias("group"), F.col("__sample").alias("sample"), "gene", "expr", cond.alias("cond"))
    bulk = written(bulk)
    sizes = size_factors(bulk, ["group"])
    sides = bulk.select("group", "sample", "cond").distinct().groupBy("group").agg(F.count_if(F.col("cond") == disease_cond).alias("nd"), F.count_if(F.col("cond") == ctrl_cond).alias("nc"))
    sides = sides.where("nd >= 2 AND nc >= 2").select("group", (F.col("nd") + F.col("nc")).alias("samples"))
    parts = max(1, exp.var.count() // GENES_AT_ONCE)
    ready = bulk.join(sizes, ["group", "sample"]).join(sides, "group").withColumn("part", F.pmod(F.xxhash64("gene"), F.lit(parts)))
    ready = written(ready.select("group", "part", "gene", "sample", "samples", "expr", "size", (F.col("cond") == disease_cond).cast("double").alias("d")))

    def each(pdf: pd.DataFrame):  # noqa: ANN202
        """Counts, design and offsets of every gene; pseudobulks without counts of a gene are rows too."""
        for gene, g in pdf.sort_values(["gene", "sample"]).groupby("gene"):
            d = g["d"].to_numpy(float)
            yield gene, np.round(g["expr"].to_numpy(float)), np.column_stack([np.ones(len(d)), d]), np.log(g["size"].to_numpy(float)), g

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(pdf["group"].iloc[0], gene, float((y / np.exp(off)).mean()), _dispersion(y, _nb_fit(x, y, off, 0.1)[2], 2), int(g["samples"].iloc[0])) for gene, y, x, off, g in each(pdf)]
        return pd.DataFrame(rows, columns=["group", "gene", "base", "raw", "samples"])

    raw = written(ready.groupBy("group", "part").applyInPandas(spread, "group string, gene string, base double, raw double, samples long"))
    use = written(_shrunk(raw))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for gene, y, x, off, g in each(pdf):
            a, base = float(g["trend" if method == "edger" else "shrunk"].iloc[0]), float(g["base"].iloc[0])
            beta, cov, mu = _nb_fit(x, y, off, a)
            se = float(np.sqrt(cov[1, 1]))
            if method == "deseq2":
                stat = float(beta[1] / se)
                p = float(2 * norm_sf_array(np.array([abs(stat)]))[0])
            else:
                dev1, dev0 = _deviance(y, mu, a), _deviance(y, _nb_fit(x[:, :1], y, off, a)[2], a)
                stat = max(0.0, dev0 - dev1) / max(dev1 / (len(y) - 2), 1.0)
                p = float(f_sf_array(np.array([stat]), np.array([1.0]), np.array([len(y) - 2.0]))[0])
            rows.append((gene, base, float(beta[1] / np.log(2)), se / np.log(2), stat, p, pdf["group"].iloc[0]))
        return pd.DataFrame(rows, columns=["GeneName", "baseMean", "log2FoldChange", "lfcSE", "stat", "pvalue", "group"])

    fitted = ready.drop("samples").join(use, ["group", "gene"])
    out = fitted.groupBy("group", "part").applyInPandas(fit, "GeneName string, baseMean double, log2FoldChange double, lfcSE double, stat double, pvalue double, group string")
    return adjust(out, "pvalue", ["group"])


def _shrunk(raw: DataFrame) -> DataFrame:
    """``(group, gene, base, trend, shrunk)``: dispersions and their trend ``c0 + c1 / mean`` over all genes of a group.

    The trend is a least squares line over the genes that vary more than counting does, from moments; a group with less
    than three of them has its median dispersion. Each gene's dispersion is moved towards the trend by how far the
    genes scatter around it.
    """
    big = (F.col("raw") > 1e-7) & (F.col("base") > 0)
    inv, r = F.when(big, 1 / F.col("base")), F.when(big, F.col("raw"))
    line = raw.groupBy("group").agg(
        F.count(r).alias("k"), F.coalesce(F.covar_pop(inv, r) / F.nullif(F.var_pop(inv), F.lit(0.0)), F.lit(0.0)).alias("c1"), F.avg(inv).alias("mx"), F.avg(r).alias("my"),
        F.expr("percentile(raw, 0.5)").alias("mid"),
    )
    curve = F.col("my") - F.col("c1") * F.col("mx") + F.col("c1") / F.greatest(F.col("base"), F.lit(1e-8))
    trend = F.greatest(F.when(F.col("k") >= 3, curve).otherwise(F.col("mid")), F.lit(1e-4))
    rows = raw.join(line, "group").withColumn("trend", trend)
    gap = rows.groupBy("group").agg(F.var_pop(F.when(big, F.log("raw") - F.log("trend"))).alias("gap"))
    noise = F.lit(2.0) / F.greatest(F.col("samples") - 2, F.lit(1))
    prior = F.greatest(F.when(F.col("k") >= 3, F.col("gap")).otherwise(F.lit(1.0)) - noise, F.lit(0.25))
    shrunk = F.exp((F.log(F.greatest("raw", F.lit(1e-8))) / noise + F.log("trend") / prior) / (1 / noise + 1 / prior))
    return rows.join(gap, "group").select("group", "gene", "base", "trend", shrunk.alias("shrunk"))


def filter_by_expr(bulk: DataFrame, group: str, min_count: float = 10, min_total: float = 15) -> DataFrame:
    """``gene`` of pseudobulks ``(sample, <group>, gene, expr)`` with enough counts in enough samples: counts per million above
    ``min_count`` at the median library size in as many samples as the smallest group has (in part beyond 10), and
    ``min_total`` counts in all (public: the rule of edgeR's filterByExpr)."""
    lib = bulk.groupBy("sample", group).agg(F.sum("expr").alias("lib"))
    least = lib.groupBy(group).agg(F.count("*").cast("double").alias("n")).agg(F.min("n").alias("n"))
    need = F.when(F.col("n") > 10, 10 + (F.col("n") - 10) * 0.7).otherwise(F.col("n"))
    rule = lib.agg(F.expr("percentile(lib, 0.5)").alias("m")).crossJoin(least).select((F.lit(float(min_count)) / F.col("m") * 1e6).alias("cpm"), need.alias("need"))
    j = bulk.join(lib.select("sample", "lib"), "sample").join(F.broadcast(rule))  # one row is broadcast
    per = j.groupBy("gene", "need").agg(F.count(F.when(F.col("expr") / F.col("lib") * 1e6 >= F.col("cpm"), 1)).alias("k"), F.sum("expr").alias("t"))
    return per.where((F.col("k") >= F.col("need") - 1e-14) & (F.col("t") >= min_total)).select("gene")


def cluster_ttest(bulk: DataFrame, *, ctrl: str, disease: str, equal_var: bool = True) -> DataFrame:
    """``group, GeneName, statistic, pvals, padj, log2fc`` of log-normalised pseudobulks ``(group, sample, cond, gene, expr)``."""
    total = bulk.groupBy("group", "sample").agg(F.sum("expr").alias("t"))
    v = bulk.join(total, ["group", "sample"]).withColumn("v", F.log1p(div(F.col("expr") * 1e4, F.col("t"))))
    s = v.groupBy("group", "gene", "cond").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.var_samp("v").alias("var"))
    side = [s.where(F.col("cond") == c).select("group", "gene", *[F.col(k).alias(f"{k}{i}") for k in ("n", "mean", "var")]) for i, c in ((1, disease), (2, ctrl))]
    t = with_two_sample_t(side[0].join(side[1], ["group", "gene"]).where("n1 > 1 AND n2 > 1"), equal_var)
    fc = F.log2((F.expm1("mean1") + 1e-9) / (F.expm1("mean2") + 1e-9))
    return adjust(t.select("group", F.col("gene").alias("GeneName"), "statistic", F.col("pval").alias("pvals"), fc.alias("log2fc")), "pvals", ["group"])


def consensus(
    exp: Experiment, *, ctrl_cond: str, disease_cond: str, cluster_key: str, batch_key: str = "batch", condition_key: str = "condition", count_layer: str = "counts",
    min_cells: int = 50, min_counts: float = 10, test: str = "wilcoxon", test_pseudobulk: str = "deseq2", pval_cutoff: float = 0.05,
) -> DataFrame:
    """Tests of cells and of pseudobulks side by side, for every cluster and gene; 18 columns.

    Genes or clusters that the pseudobulk test left out stand with fold change and statistic 0 and p 1. Significance is
    ``Yes`` or ``No``, strict, in ``sc_signicant``, ``psc_signicant`` (spelled as users of such tables know them) and
    ``consensus_significant``; then the mean expression per condition.
    """
    names = {"log2FoldChange": f"log2fc_{test_pseudobulk}", "stat": f"stat_{test_pseudobulk}", "pvalue": f"pval_{test_pseudobulk}", "padj": f"padj_{test_pseudobulk}"}
    exp = exp.settled(None, count_layer)  # read by both tests and the means
    sub = Experiment(exp.obs.where(F.col(condition_key).isin([ctrl_cond, disease_cond])), exp.var, exp.layers)
    sc = rank_genes_groups(sub, condition_key, by=cluster_key, reference=ctrl_cond, method=test)
    sc = sc.withColumnsRenamed({"gene": "GeneName", "score": "statistic", "pval": "pvals", "pts": "pts_group", "pts_rest": "pts_ref"})
    pb = pseudobulk_test(
        sub, ctrl_cond=ctrl_cond, disease_cond=disease_cond, cluster_key=cluster_key, method=test_pseudobulk, batch_key=batch_key, condition_key=condition_key, layer=count_layer,
        min_cells=min_cells, min_counts=min_counts,
    )
    pb = pb.select("GeneName", F.col("group").alias(cluster_key), *[F.col(c).alias(n) for c, n in names.items()])
    out = sc.join(pb, ["GeneName", cluster_key], "left")
    fill: dict[str, float] = {n: 1.0 if c in ("pvalue", "padj") else 0.0 for c, n in names.items()}
    out = out.fillna(fill)
    yes: Callable = lambda c: F.when(F.col(c) < pval_cutoff, "Yes").otherwise("No")
    out = out.withColumns({"sc_signicant": yes("padj"), "psc_signicant": yes(names["padj"])})
    out = out.withColumn("consensus_significant", F.when((F.col("sc_signicant") == "Yes") & (F.col("psc_signicant") == "Yes"), "Yes").otherwise("No"))
    means = mean_expr(sub, group_by=[condition_key, cluster_key]).groupBy(F.col("gene").alias("GeneName"), cluster_key)
    means = means.agg(*[F.max(F.when(F.col(condition_key) == c, F.col("expr"))).alias(f"MeanExpr_{c}") for c in (ctrl_cond, disease_cond)])
    return out.join(means, ["GeneName", cluster_key])


class DGEAnalysis:
    """All tests of one experiment; each run keeps its result under the test's name in ``results``."""

    SINGLE_CELL = ("wilcoxon", "ttest", "ttest_overestim_var", "logreg", "mast")
    PSEUDOBULK = ("EdgeR", "DESeq2", "cluster_ttest")

    def __init__(self, exp: Experiment, *, groupby: str, batch_key: str = "batch", cluster_key: str | None = None, is_pseudobulk: bool = False):
        exp.require([groupby, batch_key, *([cluster_key] if cluster_key else [])])
        self.exp, self.groupby, self.batch_key, self.cluster_key, self.is_pseudobulk = exp, groupby, batch_key, cluster_key, is_pseudobulk
        self.results: dict[str, DataFrame] = {}

    def find_methods(self) -> dict[str, tuple[str, ...]]:
        return {"pseudobulk": self.PSEUDOBULK, "single-cell": self.SINGLE_CELL}

    def run(self, method: str, *, reference: str = "rest", disease: str | None = None, **args: Any) -> DataFrame:
        if method not in self.SINGLE_CELL + self.PSEUDOBULK:
            raise InputError(f"method is one of {self.SINGLE_CELL + self.PSEUDOBULK}")
        if self.is_pseudobulk and method in self.SINGLE_CELL:
            raise InputError(f"{method} tests cells")
        e = self.exp
        if method == "logreg":
            out = logreg_scores(e, self.groupby, **args)
        elif method == "mast":
            out = hurdle_test(e, cond_key=self.groupby, reference=reference, disease=disease, **args)
        elif method in self.SINGLE_CELL:
            how = {"wilcoxon": "wilcoxon", "ttest": "t-test", "ttest_overestim_var": "t-test_overestim_var"}[method]
            out = rank_genes_groups(e, self.groupby, by=self.cluster_key, reference=reference, method=how, **args)
        else:
            obs = e.obs if self.cluster_key else e.obs.withColumn("__all", F.lit("all"))
            sub = Experiment(obs, e.var, e.layers)
            key = self.cluster_key or "__all"
            if method == "cluster_ttest":
                both = [reference, disease]
                named = Experiment(obs.where(F.col(self.groupby).isin(both)).withColumn("__s", F.concat_ws("\u001f", self.batch_key, self.groupby)), e.var, {"X": e.layer(args.pop("layer", "counts"))})
                b = pseudobulk(named, batch_key="__s", cluster_key=key, **args)
                b = b.select(F.col(key).alias("group"), F.col("__s").alias("sample"), F.element_at(F.split("__s", "\u001f"), -1).alias("cond"), "gene", "expr")
                out = cluster_ttest(b, ctrl=reference, disease=disease)
            else:
                out = pseudobulk_test(sub, ctrl_cond=reference, disease_cond=disease, cluster_key=key, method="edger" if method == "EdgeR" else "deseq2", batch_key=self.batch_key, condition_key=self.groupby, **args)
        self.results[method] = out
        return out

    def get_dge(self, method: str) -> DataFrame:
        return self.results[method]


