"""Two-sample tests of every gene between groups of cells, and corrections for many tests.

Ranks never need a gene's values in one task: values are counted first, running counts are taken per bucket of the
value's logarithm, and ranks within a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantell.experiment import Experiment, InputError, as_list, compare
from quantell.functions.special import chi2_sf, f_sf, norm_two_sided, t_two_sided
from quantell.operators.expression import PSEUDO, div, group_stats
from quantell.plans.shared import settled

#: Buckets per doubling of a value.
FINE = 64
#: Digits at which values count as tied.
TIE_DIGITS = 9
METHODS = ("wilcoxon", "t-test", "t-test_overestim_var")


def value_bucket(v: Column) -> Column:
    """A whole number that never falls as the double ``v`` grows: ``FINE`` buckets per doubling of its size."""
    size = F.floor(F.log2(F.abs(v)) * FINE) + FINE * 1200  # doubles go down to 2 to the -1074
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("int")


def _share_bucket(p: Column) -> Column:
    """As :func:`value_bucket`, for values in [0, 1] most of which aren't small: 4096 buckets of one width above 1/64."""
    return F.when(p >= 1 / 64, F.floor(p * 4096) + FINE * 1200).otherwise(value_bucket(p)).cast("int")


def adjust(df: DataFrame, pval: str, keys: Sequence[str] = (), method: str = "benjamini-hochberg", out: str = "padj") -> DataFrame:
    """Adjusted p-values within each group of ``keys``; a missing p-value, NaN included, stays missing and isn't counted.

    Equal p-values are counted first. Ranks are running counts, over buckets of p and then inside them, and so are the
    least values from above, so no group is gathered in one task; the results are joined to the rows by group and p.
    """
    keys = list(keys)
    if method not in ("benjamini-hochberg", "bonferroni"):
        raise InputError("method is benjamini-hochberg or bonferroni")
    names = {k: f"__k{i}" for i, k in enumerate(keys)}
    ks = list(names.values())
    p = F.when(~F.isnan(pval), F.col(pval).cast("double"))
    rows = settled(df).withColumn("__p", p)
    counts = rows.where("__p IS NOT NULL").groupBy(*[F.col(k).alias(n) for k, n in names.items()], F.col("__p").alias("__v")).agg(F.count("*").alias("__c"))
    counts = counts.withColumn("__b", _share_bucket(F.col("__v")))
    buckets = counts.groupBy(*ks, "__b").agg(F.sum("__c").alias("__n"))
    over = Window.partitionBy(*ks)
    buckets = buckets.select(*ks, "__b", (F.sum("__n").over(over.orderBy("__b")) - F.col("__n")).alias("__before"), F.sum("__n").over(over).alias("__m"))

    def same(a: DataFrame, b: DataFrame, cols: Sequence[tuple[str, str]], how: str = "inner") -> DataFrame:
        on = F.lit(True)
        for x, y in cols:
            on = on & a[x].eqNullSafe(b[y])
        return a.join(b, on, how)

    def beside(a: DataFrame, b: DataFrame) -> DataFrame:
        right = b.withColumnsRenamed({k: f"{k}r" for k in [*ks, "__b"]})
        return same(a, right, [(k, f"{k}r") for k in [*ks, "__b"]]).drop(*[f"{k}r" for k in [*ks, "__b"]])

    counts = beside(counts, buckets)
    inside = Window.partitionBy(*ks, "__b")
    if method == "bonferroni":
        adjusted = counts.withColumn("__q", F.least(F.col("__v") * F.col("__m"), F.lit(1.0)))
    else:
        rank = F.col("__before") + F.sum("__c").over(inside.orderBy("__v"))  # rows up to and with ties
        raw = counts.withColumn("__q", F.col("__v") * F.col("__m") / rank)
        later = raw.groupBy(*ks, "__b").agg(F.min("__q").alias("__least"))
        later = later.withColumn("__later", F.min("__least").over(over.orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1))).drop("__least")
        own = F.min("__q").over(inside.orderBy(F.desc("__v")).rowsBetween(Window.unboundedPreceding, 0))
        adjusted = beside(raw, later).withColumn("__q", F.least(own, F.coalesce("__later", F.lit(1.0)), F.lit(1.0)))
    adjusted = adjusted.select(*ks, "__v", F.col("__q").alias("__out"))
    found = same(rows, adjusted, [*names.items(), ("__p", "__v")], "left") if ks else rows.join(adjusted, rows["__p"] == adjusted["__v"], "left")
    return found.withColumn(out, F.when(F.col("__p").isNotNull(), F.col("__out"))).drop(*ks, "__p", "__v", "__out")


def check_groups(exp: Experiment, groupby: str, groups: Any = "all", reference: str = "rest") -> list[str]:
    """The groups to test, in order; raises if one of them or the reference is missing or has fewer than two cells."""
    sizes = {r[0]: r["n"] for r in exp.obs.where(F.col(groupby).isNotNull()).groupBy(groupby).agg(F.count("*").alias("n")).collect()}
    if isinstance(groups, (str, int)) and groups != "all":
        raise InputError("groups is all or a list")
    wanted = sorted(sizes) if groups == "all" or groups is None else as_list(groups)
    if reference != "rest" and reference not in sizes:
        raise InputError(f"no group {reference} to refer to")
    used = [*wanted, *([reference] if reference != "rest" and reference not in wanted else [])]
    small = [g for g in used if sizes.get(g, 0) < 2]
    if small:
        raise InputError(f"groups with fewer than two cells: {small}")
    return [g for g in wanted if g != reference]


def two_sample_stats(exp: Experiment, groupby: str, by: Sequence[str] = (), reference: str = "rest", layer: str | None = None, logcounts: bool = True) -> DataFrame:
    """``by…, group, gene, n1, n2, mean1, mean2, var1, var2, pts1, pts2, log2fc`` of each group against the rest or one group.

    With ``logcounts`` means are logs of mean counts while variances stay in count space, as published tools do.
    """
    by = list(by)
    s = group_stats(exp, [*by, groupby], None, layer, logcounts).withColumnRenamed(groupby, "group")
    if reference == "rest":
        w = Window.partitionBy(*by, "gene_id")
        other = {c: F.sum(c).over(w) - F.col(c) for c in ("n_cells", "total", "squares", "nnz")}
        pairs = s.select(*by, "group", "gene_id", "n_cells", "total", "squares", "nnz", *[v.alias(f"o_{c}") for c, v in other.items()])
    else:
        ref = s.where(F.col("group") == reference).select(*by, "gene_id", *[F.col(c).alias(f"o_{c}") for c in ("n_cells", "total", "squares", "nnz")])
        pairs = s.where(F.col("group") != reference).join(ref, [*by, "gene_id"])
    cols = []
    for i, p in (("1", ""), ("2", "o_")):
        n, t, q = (F.col(p + c) for c in ("n_cells", "total", "squares"))
        mean = div(t, n)
        cols += [n.alias(f"n{i}"), (F.log1p(mean) if logcounts else mean).alias(f"mean{i}"), F.greatest(div(q - t * mean, n - 1), F.lit(0.0)).alias(f"var{i}"), div(F.col(p + "nnz"), n).alias(f"pts{i}"), mean.alias(f"__m{i}")]
    out = pairs.select(*by, "group", F.col("gene_id").alias("gene"), *cols)
    if logcounts:
        fc = F.log2((F.col("__m1") + PSEUDO) / (F.col("__m2") + PSEUDO))
    else:
        fc = F.log2((F.expm1("mean1") + PSEUDO) / (F.expm1("mean2") + PSEUDO))
    return out.withColumn("log2fc", fc).drop("__m1", "__m2")


def with_t(stats: DataFrame, overestimate: bool = False) -> DataFrame:
    """Adds Welch's ``score``, ``df`` and ``pval``; ``overestimate`` takes the group's size for the other's. NaN: 0, and p 1."""
    n1, n2 = F.col("n1"), F.col("n1") if overestimate else F.col("n2")
    a, b = F.col("var1") / F.nullif(n1, F.lit(0)), F.col("var2") / F.nullif(n2, F.lit(0))
    se = F.sqrt(a + b)
    df = div((a + b) * (a + b), div(a * a, n1 - 1) + div(b * b, n2 - 1))
    score = F.coalesce(div(F.col("mean1") - F.col("mean2"), se), F.lit(0.0))
    out = stats.withColumns({"score": score, "df": df})
    return out.withColumn("pval", F.coalesce(F.nanvl(t_two_sided("score", "df"), F.lit(1.0)), F.lit(1.0)))


def rank_sums(exp: Experiment, groupby: str, by: Sequence[str] = (), reference: str = "rest", layer: str | None = None) -> DataFrame:
    """``by…, group, gene, n1, n2, rank_sum, ties`` with mid-ranks over the group and those it is compared with.

    ``ties`` is the sum of t³ − t over tied values. Needs values of at least 0: all zeros, stored or not, come first.
    """
    by = list(by)
    keys = [*by, "gene_id"]
    obs = exp.obs.select("cell_id", *by, F.col(groupby).alias("group"))
    rows = exp.layer(layer).where("value <> 0").join(obs, "cell_id")
    counts = rows.groupBy(*keys, "group", F.round("value", TIE_DIGITS).alias("v")).agg(F.count("*").cast("double").alias("n"))
    sizes = obs.groupBy(*by, "group").agg(F.count("*").cast("double").alias("n_cells"))
    if reference == "rest":
        counts = counts.withColumn("comparison", F.lit(""))
        total = sizes.groupBy(*by).agg(F.sum("n_cells").alias("n_all"))
        comparisons = sizes.where(F.col("group").isNotNull()).join(total, by) if by else sizes.where(F.col("group").isNotNull()).crossJoin(total)
    else:
        # the reference's counts, already a row per value, take part in every comparison
        others = F.col("group") != reference
        names = sizes.where(others).select(*by, F.col("group").alias("comparison"))
        ref = counts.where(F.col("group") == reference)
        ref = ref.join(names, by) if by else ref.crossJoin(names)
        counts = counts.where(others).withColumn("comparison", F.col("group")).unionByName(ref)
        size_ref = sizes.where(F.col("group") == reference).select(*by, F.col("n_cells").alias("n_ref"))
        both = sizes.where(others).join(size_ref, by) if by else sizes.where(others).crossJoin(size_ref)
        comparisons = both.withColumn("n_all", F.col("n_cells") + F.col("n_ref")).drop("n_ref")
    keys = [*keys, "comparison"]
    counts = counts.withColumn("b", F.floor(F.log2("v") * FINE).cast("int"))
    buckets = counts.groupBy(*keys, "b").agg(F.sum("n").alias("bn"))
    wb = Window.partitionBy(*keys)
    buckets = buckets.select(*keys, "b", (F.sum("bn").over(wb.orderBy("b")) - F.col("bn")).alias("before"), F.sum("bn").over(wb).alias("nz"))
    inside = Window.partitionBy(*keys, "b")
    c = F.sum("n").over(inside.partitionBy(*keys, "b", "v"))
    ranked = counts.withColumn("c", c).withColumn("upto", F.sum("n").over(inside.orderBy("v"))).join(buckets, [*keys, "b"])
    mid = F.col("before") + F.col("upto") - F.col("c") + (F.col("c") + 1) / 2
    share = F.col("n") / F.col("c") * (F.col("c") * F.col("c") * F.col("c") - F.col("c"))  # each tie once over its rows
    ranked = ranked.withColumn("mid", mid).withColumn("tie", share)
    mine = ranked.where(F.col("group").isNotNull()).groupBy(*keys, "group").agg(F.sum(F.col("n") * F.col("mid")).alias("above"), F.sum("n").alias("nz1"))
    whole = ranked.groupBy(*keys).agg(F.sum("tie").alias("tie"), F.max("nz").alias("nz"))
    grid = comparisons.crossJoin(exp.genes()).withColumn("comparison", F.lit("") if reference == "rest" else F.col("group"))
    out = grid.join(mine, [*keys, "group"], "left").join(whole, keys, "left").fillna(0.0, subset=["above", "nz1", "tie", "nz"])
    n0 = F.col("n_all") - F.col("nz")
    rank_sum = (F.col("n_cells") - F.col("nz1")) * (n0 + 1) / 2 + F.col("above") + F.col("nz1") * n0
    ties = F.col("tie") + n0 * n0 * n0 - n0
    return out.select(*by, "group", F.col("gene_id").alias("gene"), F.col("n_cells").alias("n1"), (F.col("n_all") - F.col("n_cells")).alias("n2"), rank_sum.alias("rank_sum"), ties.alias("ties"))


def with_z(ranks: DataFrame, tie_correct: bool = True) -> DataFrame:
    """Adds ``score``, the normal approximation of the rank sum without continuity correction, and its two-sided ``pval``."""
    n, m = F.col("n1"), F.col("n2")
    all_ = n + m
    t = F.when(all_ < 2, F.lit(1.0)).otherwise(1 - div(F.col("ties"), all_ * all_ * all_ - all_)) if tie_correct else F.lit(1.0)
    sd = F.sqrt(t * n * m * (all_ + 1) / 12)
    out = ranks.withColumn("score", F.coalesce(div(F.col("rank_sum") - n * (all_ + 1) / 2, sd), F.lit(0.0)))
    return out.withColumn("pval", F.coalesce(norm_two_sided("score"), F.lit(1.0)))


def rank_genes_groups(
    exp: Experiment, groupby: str, *, by: Any = None, groups: Any = "all", reference: str = "rest", method: str = "wilcoxon", corr_method: str = "benjamini-hochberg",
    tie_correct: bool = True, layer: str | None = None, logcounts: bool = True, n_genes: int | None = None, rankby_abs: bool = False, check: bool = True,
) -> DataFrame:
    """``by…, group, gene, score, pval, padj, log2fc, pts, pts_rest``: every gene of each group against the rest or one group.

    ``by`` runs the test inside each value of those columns, in one job; subsets in which a group or the other side has
    fewer than two cells give no rows there. P-values are adjusted over all genes before the first ``n_genes`` are
    taken, by score or its size, ties by gene.
    """
    by = as_list(by)
    exp.require([*by, groupby])
    if method not in METHODS:
        raise InputError(f"method is one of {METHODS}")
    wanted = None
    if not by and check:
        wanted = check_groups(exp, groupby, groups, reference)
    elif groups not in ("all", None):
        wanted = as_list(groups)
    exp = exp.settled(layer)
    stats = two_sample_stats(exp, groupby, by, reference, layer, logcounts)
    if method == "wilcoxon":
        z = with_z(rank_sums(exp, groupby, by, reference, layer), tie_correct).select(*by, "group", "gene", "score", "pval")
        out = stats.join(z, [*by, "group", "gene"])
    else:
        out = with_t(stats, method == "t-test_overestim_var")
    out = out.where("n1 >= 2 AND n2 >= 2 AND group IS NOT NULL")
    if wanted is not None:
        out = out.where(F.col("group").isin(wanted))
    out = adjust(out, "pval", [*by, "group"], corr_method)
    out = out.select(*by, "group", "gene", "score", "pval", "padj", "log2fc", F.col("pts1").alias("pts"), F.col("pts2").alias("pts_rest"))
    if n_genes is not None:
        key = F.abs("score") if rankby_abs else F.col("score")
        out = out.withColumn("__r", F.row_number().over(Window.partitionBy(*by, "group").orderBy(key.desc(), "gene"))).where(F.col("__r") <= n_genes).drop("__r")
    return out


def dge_results(ranked: DataFrame, *, min_log2fc: float | None = None, max_log2fc: float | None = None, padj_cutoff: float | None = None) -> DataFrame:
    """A ranking under the names of result tables, filtered; bounds are inclusive."""
    out = ranked.withColumnsRenamed({"gene": "GeneName", "score": "statistic", "pval": "pvals", "pts": "pts_group", "pts_rest": "pts_ref"})
    for c, bound, how in (("log2fc", min_log2fc, ">="), ("log2fc", max_log2fc, "<="), ("padj", padj_cutoff, "<=")):
        if bound is not None:
            out = out.where(compare(F.col(c), how, bound))
    return out


def up_and_down(df: DataFrame, *, pval: str = "padj", lfc: str = "log2fc", pval_cutoff: float = 0.05, log2fc_cutoff: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """Genes that are higher, and genes that are lower; bounds are strict."""
    sig = F.col(pval) < pval_cutoff
    return df.where(sig & (F.col(lfc) > log2fc_cutoff)), df.where(sig & (F.col(lfc) < -log2fc_cutoff))


def filter_rank_genes(ranked: DataFrame, *, min_in_group_fraction: float = 0.25, min_fold_change: float = 1.0, max_out_group_fraction: float = 0.5, compare_abs: bool = False) -> DataFrame:
    """The ranking with ``gene`` null where a gene fails; rows stay. Bounds are strict."""
    lfc = F.abs("log2fc") if compare_abs else F.col("log2fc")
    ok = (F.col("pts") > min_in_group_fraction) & (F.col("pts_rest") < max_out_group_fraction) & (lfc > min_fold_change)
    return ranked.withColumn("gene", F.when(ok, F.col("gene")))


def batch_means(exp: Experiment, keys: Sequence[str], layer: str | None = None) -> DataFrame:
    """``keys…, gene, m``: log means per group, the observations of tests over batches."""
    s = group_stats(exp, keys, None, layer, True)
    return s.select(*keys, F.col("gene_id").alias("gene"), F.log1p(F.col("total") / F.col("n_cells")).alias("m"))


def with_two_sample_t(df: DataFrame, equal_var: bool = True) -> DataFrame:
    """Adds ``statistic, df, pval`` from ``n1, mean1, var1, n2, mean2, var2``; what can't be computed is 0 and p 1."""
    n1, n2, v1, v2 = F.col("n1"), F.col("n2"), F.col("var1"), F.col("var2")
    if equal_var:
        df_ = (n1 + n2 - 2).cast("double")
        pooled = div((n1 - 1) * F.coalesce(v1, F.lit(0.0)) + (n2 - 1) * F.coalesce(v2, F.lit(0.0)), n1 + n2 - 2)
        se = F.sqrt(pooled * (1 / n1 + 1 / n2))
    else:
        a, b = v1 / n1, v2 / n2
        df_ = div((a + b) * (a + b), div(a * a, n1 - 1) + div(b * b, n2 - 1))
        se = F.sqrt(a + b)
    t = F.coalesce(div(F.col("mean1") - F.col("mean2"), F.when(se > 1e-12, se)), F.lit(0.0))
    out = df.withColumns({"statistic": t, "df": df_})
    p = F.coalesce(F.nanvl(t_two_sided("statistic", F.coalesce("df", F.lit(1.0))), F.lit(1.0)), F.lit(1.0))
    return out.withColumn("pval", F.when(F.col("statistic") == 0, F.lit(1.0)).otherwise(p))


def grouped_ttest(
    exp: Experiment, *, annot_key: str = "annotation", cond_key: str = "condition", batch_key: str = "batch", reference: str = "rest", groups: Any = None, equal_var: bool = True,
    layer: str | None = None,
) -> DataFrame:
    """``gene, statistic, pval, condition, annotation``: t-tests over batch means within each annotation, without adjustment.

    With ``rest`` all pairs of conditions a, b with a before b, named ``a-Vs-b``; else the reference against each.
    """
    means = batch_means(exp, [annot_key, cond_key, batch_key], layer)
    s = means.groupBy(annot_key, cond_key, "gene").agg(F.count("m").alias("n"), F.avg("m").alias("mean"), F.var_samp("m").alias("var"))
    a = s.select(annot_key, "gene", F.col(cond_key).alias("c1"), *[F.col(c).alias(f"{c}1") for c in ("n", "mean", "var")])
    b = s.select(annot_key, "gene", F.col(cond_key).alias("c2"), *[F.col(c).alias(f"{c}2") for c in ("n", "mean", "var")])
    pairs = a.join(b, [annot_key, "gene"]).where("c1 < c2" if reference == "rest" else (F.col("c1") == reference) & (F.col("c2") != reference))
    if groups is not None:
        pairs = pairs.where(F.col("c2").isin(as_list(groups)))
    out = with_two_sample_t(pairs.withColumns({"var1": F.nanvl("var1", F.lit(None)), "var2": F.nanvl("var2", F.lit(None))}), equal_var)
    name = F.concat_ws("-Vs-", "c1", "c2") if reference == "rest" else F.col("c2")
    return out.select("gene", "statistic", "pval", name.alias("condition"), F.col(annot_key).alias("annotation"))


def anova(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """``by…, statistic, df1, df2, pval``: one-way analysis of variance from counts, means and variances of the groups."""
    by = list(by)
    v = F.col(value).cast("double")
    g = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(*by, group).agg(F.count(value).alias("n"), F.avg(v).alias("m"), (F.var_pop(v) * F.count(value)).alias("w"))
    over = Window.partitionBy(*by)  # a row per group
    g = g.withColumn("mean", F.sum(F.col("n") * F.col("m")).over(over) / F.sum("n").over(over))
    t = g.groupBy(*by).agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum(F.col("n") * (F.col("m") - F.col("mean")) ** 2).alias("b"))
    f = div(div(F.col("b"), F.col("k") - 1), div(F.col("w"), F.col("n") - F.col("k")))
    out = t.select(*by, f.alias("statistic"), (F.col("k") - 1).alias("df1"), (F.col("n") - F.col("k")).alias("df2"))
    return out.withColumn("pval", f_sf("statistic", F.col("df1").cast("double"), F.col("df2").cast("double")))


def observed_ranks(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """``by…, group, n, r, t``: rows, sum of mid-ranks within ``by``, and the sum of ties² − 1, of each group.

    As in :func:`rank_sums` values are counted first and ranked inside buckets, so no category is ranked in one task.
    """
    by = list(by)
    rows = df.select(*by, group, (F.col(value).cast("double") + 0.0).alias("__v")).where(F.col("__v").isNotNull() & F.col(group).isNotNull())
    own = rows.groupBy(*by, group, "__v").agg(F.count("*").cast("double").alias("n"))
    values = own.groupBy(*by, "__v").agg(F.sum("n").alias("c")).withColumn("b", value_bucket(F.col("__v")))
    buckets = values.groupBy(*by, "b").agg(F.sum("c").alias("bn"))
    buckets = buckets.select(*by, "b", (F.sum("bn").over(Window.partitionBy(*by).orderBy("b")) - F.col("bn")).alias("before"))
    upto = F.sum("c").over(Window.partitionBy(*by, "b").orderBy("__v"))
    ranked = values.withColumn("upto", upto).join(buckets, [*by, "b"]).select(*by, "__v", "c", (F.col("before") + F.col("upto") - (F.col("c") - 1) / 2).alias("mid"))
    j = own.join(ranked, [*by, "__v"])
    return j.groupBy(*by, group).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mid")).alias("r"), F.sum(F.col("n") * (F.col("c") * F.col("c") - 1)).alias("t"))


def kruskal(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """``by…, statistic, df, pval``: Kruskal-Wallis H with tie correction."""
    by = list(by)
    g = observed_ranks(df, value, group, by)
    t = g.groupBy(*by).agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.sum("t").alias("t"))
    n = F.col("n")
    h = div(12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1), 1 - div(F.col("t"), n * n * n - n))
    return t.select(*by, h.alias("statistic"), (F.col("k") - 1).alias("df")).withColumn("pval", chi2_sf("statistic", F.col("df").cast("double")))


def mann_whitney(df: DataFrame, value: str, group: str, ctrl: str, other: str, by: Sequence[str] = ()) -> DataFrame:
    """``by…, statistic, z, pval``: U of ``ctrl`` against ``other``, with tie and continuity correction."""
    by = list(by)
    one = F.col(group) == ctrl
    t = observed_ranks(df.where(F.col(group).isin([ctrl, other])), value, group, by).groupBy(*by).agg(
        F.coalesce(F.sum(F.when(one, F.col("n"))), F.lit(0.0)).alias("n1"), F.coalesce(F.sum(F.when(~one, F.col("n"))), F.lit(0.0)).alias("n2"),
        F.sum(F.when(one, F.col("r"))).alias("r"), F.sum("t").alias("t"),
    )
    n1, n2 = F.col("n1"), F.col("n2")
    n, u = n1 + n2, F.col("r") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - div(F.col("t"), n * (n - 1))))
    far = F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5
    z = div(far, F.when(sd > 0, sd))
    p = F.least(norm_two_sided(F.greatest(F.coalesce("z", F.lit(0.0)), F.lit(0.0))), F.lit(1.0))
    return t.select(*by, u.alias("statistic"), F.greatest(z, F.lit(0.0)).alias("z")).withColumn("pval", p)


def significance_grid(ranked: DataFrame, grid: DataFrame, on: Sequence[str], pval_cutoff: float = 0.05, log2fc_cutoff: float = 0.0) -> DataFrame:
    """The grid of a matrix plot with ``padj`` (1 where nothing was significant) and ``star``."""
    kept = ranked.where((F.col("padj") < pval_cutoff) & (F.col("log2fc") > log2fc_cutoff)).select(*on, "padj")
    out = grid.join(kept, list(on), "left").withColumn("padj", F.coalesce("padj", F.lit(1.0)))
    return out.withColumn("star", F.when(F.col("padj") < pval_cutoff, F.lit("*")).otherwise(F.lit("")))


