"""P-values that plots show: a control against other groups, for genes or metadata columns, per hue category."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantell.experiment import Experiment, InputError
from quantell.functions.special import norm_sf_array
from quantell.operators.testing import anova, kruskal, mann_whitney, rank_genes_groups, with_two_sample_t

#: Values of a group that Shapiro and Wilk's test is defined for.
MOST_VALUES = 5000


def _inverse_normal(p: np.ndarray) -> np.ndarray:
    """Normal quantiles by bisection."""
    lo, hi = np.full(len(p), -10.0), np.full(len(p), 10.0)
    for _ in range(80):
        mid = (lo + hi) / 2
        below = 1 - norm_sf_array(mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


def shapiro(values: np.ndarray) -> tuple[float, float]:
    """W and its p-value by Royston's public approximation (1995), for 3 to 5000 values."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return 1.0, 1.0
    m = _inverse_normal((np.arange(1, n + 1) - 0.375) / (n + 0.25))
    c = m / np.sqrt(m @ m)
    u = 1 / np.sqrt(n)
    a = np.empty(n)
    if n == 3:
        a[:] = [-np.sqrt(0.5), 0, np.sqrt(0.5)]
    else:
        # Royston's polynomials.
        an = c[-1] + np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0], u)
        if n > 5:
            an1 = c[-2] + np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0], u)
            phi = (m @ m - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * an**2 - 2 * an1**2)
            a[2:-2] = m[2:-2] / np.sqrt(phi)
            a[[-2, 1]] = an1, -an1
        else:
            phi = (m @ m - 2 * m[-1] ** 2) / (1 - 2 * an**2)
            a[1:-1] = m[1:-1] / np.sqrt(phi)
        a[[-1, 0]] = an, -an
    w = min(float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum()), 1.0)
    if n == 3:
        return w, max(0.0, float(6 / np.pi * (np.arcsin(np.sqrt(w)) - np.arcsin(np.sqrt(0.75)))))
    # Royston's normalising transforms.
    if n <= 11:
        g = -2.273 + 0.459 * n
        y = -np.log(g - np.log1p(-w)) if g > np.log1p(-w) else 10.0
        mu = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n)
        sd = np.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        y, v = np.log1p(-w), np.log(n)
        mu = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], v)
        sd = np.exp(np.polyval([0.0030302, -0.082676, -0.4803], v))
    return w, float(norm_sf_array(np.array([(y - mu) / sd]))[0])


def normality(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """``by…, n, w, pval`` of Shapiro and Wilk's test; for groups of more than ``MOST_VALUES``, for which it isn't
    defined, ``w`` is null and the p-value that of Jarque and Bera's, from the skewness and kurtosis of all values."""
    by = list(by)
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"))
    n = rows.groupBy(*by).agg(F.count("*").alias("n"), F.skewness("__v").alias("__s"), F.kurtosis("__v").alias("__k"))
    small = rows.join(n.where(F.col("n") <= MOST_VALUES).select(*by), by)
    kinds = ", ".join(f"`{c}` {k}" for c, k in df.select(*by).dtypes)

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        w, p = shapiro(pdf["__v"].to_numpy())
        return pdf[by].iloc[:1].assign(w=w, pval=p)

    got = small.groupBy(*by).applyInPandas(test, f"{kinds}, w double, pval double")
    large = F.exp(-F.col("n") / 12 * (F.col("__s") ** 2 + F.col("__k") ** 2 / 4))  # chi-squared with two degrees of freedom
    out = n.join(got, by, "left").withColumn("pval", F.when(F.col("n") > MOST_VALUES, F.coalesce(large, F.lit(0.0))).otherwise(F.col("pval")))
    return out.select(*by, "n", "w", "pval")


def compare_groups(df: DataFrame, *, value: str, group: str, ctrl: str, groups: Sequence[str], test: str = "wilcoxon", category: str | None = None) -> DataFrame:
    """``(category,) group, statistic, pval``: the control against each group by t-test, anova, wilcoxon or kruskal.

    ``auto`` takes the t-test where no group of the pair departs from a normal distribution, else wilcoxon.
    """
    if test not in ("t-test", "anova", "wilcoxon", "kruskal", "auto"):
        raise InputError("test is t-test, anova, wilcoxon, kruskal or auto")
    by = [category] if category else []
    out = None
    for g in groups:
        pair = df.where(F.col(group).isin([ctrl, g]))
        parts = {}
        if test in ("t-test", "auto"):
            s = pair.groupBy(*by).agg(*[f(F.when(F.col(group) == c, F.col(value).cast("double"))).alias(f"{n}{i}") for i, c in ((1, ctrl), (2, g)) for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))])
            parts["t-test"] = with_two_sample_t(s).select(*by, "statistic", "pval")
        if test == "anova":
            parts["anova"] = anova(pair, value, group, by).select(*by, "statistic", "pval")
        if test in ("wilcoxon", "auto"):
            parts["wilcoxon"] = mann_whitney(pair, value, group, ctrl, g, by).select(*by, "statistic", "pval")
        if test == "kruskal":
            parts["kruskal"] = kruskal(pair, value, group, by).select(*by, "statistic", "pval")
        if test == "auto":
            bad = normality(pair, value, [*by, group]).groupBy(*by).agg(F.min(F.coalesce("pval", F.lit(0.0))).alias("least"))
            t, w = parts["t-test"].withColumnsRenamed({"statistic": "s1", "pval": "p1"}), parts["wilcoxon"].withColumnsRenamed({"statistic": "s2", "pval": "p2"})
            j = t.join(w, by).join(bad, by) if by else t.crossJoin(w).crossJoin(bad)
            one = j.select(*by, *[F.when(F.col("least") > 0.05, F.col(f"{c}1")).otherwise(F.col(f"{c}2")).alias(n) for c, n in (("s", "statistic"), ("p", "pval"))])
        else:
            one = parts[test]
        one = one.select(*by, F.lit(g).alias("group"), "statistic", F.coalesce("pval", F.lit(1.0)).alias("pval"))
        out = one if out is None else out.union(one)
    return out


def feature_pvalues(exp: Experiment, *, feature: str, cond_key: str, ctrl: str, groups: Sequence[str], category: str | None = None, test: str = "wilcoxon", corr_method: str = "benjamini-hochberg") -> DataFrame:
    """``(category,) group, pval``: of a gene the adjusted p-value among all genes, of a metadata column the plain one."""
    by = [category] if category else []
    if feature in exp.obs.columns:
        return compare_groups(exp.obs, value=feature, group=cond_key, ctrl=ctrl, groups=groups, category=category).select(*by, "group", "pval")
    r = rank_genes_groups(exp, cond_key, by=by, groups=list(groups), reference=ctrl, method=test, corr_method=corr_method)
    return r.where(F.col("gene") == feature).select(*by, "group", F.col("padj").alias("pval"))
