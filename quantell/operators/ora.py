"""Networks of gene sets: overlaps, similarity graph, clusters and representatives."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantell.experiment import InputError
from quantell.functions.special import hypergeom_sf
from quantell.operators.communities import leiden
from quantell.operators.components import connected_components
from quantell.operators.expression import div

#: Terms that hierarchical clustering, which needs all pairs at once, may hold on the driver.
MOST_TERMS = 5000
SIMILARITIES = ("overlap", "jaccard", "kappa")


def parse_genes(df: DataFrame, term: str, genes: str) -> DataFrame:
    """``term, gene``, once each: lists parted by ``;``, else by ``,``, else by white space."""
    g = F.col(genes)
    sep = F.when(F.contains(g, F.lit(";")), F.split(g, ";")).when(F.contains(g, F.lit(",")), F.split(g, ",")).otherwise(F.split(F.trim(g), r"\s+"))
    return df.select(F.col(term).alias("term"), F.explode(F.array_distinct(F.transform(sep, lambda x: F.trim(x)))).alias("gene")).where("gene <> ''").distinct()


def similarities(members: DataFrame, how: str = "overlap", all_pairs: bool = True) -> DataFrame:
    """``a, b, s`` of terms a before b; ``members`` are (term, gene).

    Shared genes are counted by a join on the gene. With ``all_pairs`` terms that share none are filled in, as the full
    matrix asks; without only pairs that share a gene come out, which is all that a graph above a threshold needs.
    """
    if how not in SIMILARITIES:
        raise InputError(f"how is one of {SIMILARITIES}")
    members = members.select("term", "gene").distinct()
    sizes = members.groupBy("term").agg(F.count("*").cast("double").alias("n"))
    a, b = members.withColumnRenamed("term", "a"), members.withColumnRenamed("term", "b")
    both = a.join(b, "gene").where("a < b").groupBy("a", "b").agg(F.count("*").cast("double").alias("k"))
    na, nb = sizes.withColumnsRenamed({"term": "a", "n": "na"}), sizes.withColumnsRenamed({"term": "b", "n": "nb"})
    pairs = na.join(nb, F.col("a") < F.col("b")) if all_pairs else both.select("a", "b").join(na, "a").join(nb, "b")
    grid = pairs.join(both, ["a", "b"], "left").withColumn("k", F.coalesce("k", F.lit(0.0)))  # a row per pair: the result's size
    k, x, y = F.col("k"), F.col("na"), F.col("nb")
    if how == "overlap":
        s = F.coalesce(div(k, F.least(x, y)), F.lit(0.0))
    elif how == "jaccard":
        s = F.coalesce(div(k, x + y - k), F.lit(0.0))
    else:
        u = members.agg(F.count_distinct("gene").cast("double").alias("u"))
        grid = grid.join(F.broadcast(u))  # one row is broadcast
        n = F.col("u")
        po = (k + n - x - y + k) / n
        pe = (x * y + (n - x) * (n - y)) / (n * n)
        s = F.when(pe == 1, F.lit(1.0)).otherwise((po - pe) / F.nullif(1 - pe, F.lit(0.0)))
    return grid.select("a", "b", s.alias("s"))


def similarity_graph(sims: DataFrame, k: int = 5, threshold: float = 0.3) -> DataFrame:
    """``a, b, s`` with a before b: of each term its ``k`` most similar ones at or above the threshold, ties to the later term."""
    kept = sims.where(F.col("s") >= threshold)
    both = kept.select("a", "b", "s").union(kept.select("b", "a", "s"))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc(F.round("s", 12)), F.desc("b")))
    near = both.withColumn("place", place).where(F.col("place") <= k)
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s").distinct()


def drop_small(graph: DataFrame, terms: DataFrame, least: int = 3) -> DataFrame:
    """``term, component`` of the components of at least ``least`` terms."""
    root = connected_components(graph, "a", "b").withColumnRenamed("node", "term")
    c = terms.select("term").distinct().join(root, "term", "left").withColumn("component", F.coalesce("root", "term"))
    big = c.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return c.join(big.select("component"), "component", "left_semi").select("term", "component")


def linkage(dist: np.ndarray, method: str = "complete") -> list[tuple[int, int, float]]:
    """Merges of hierarchical clustering (complete, single or average), nearest first; ties to the earlier pair."""
    n = len(dist)
    d = dist.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, name, merges = np.ones(n), list(range(n)), []
    alive = np.ones(n, bool)
    for step in range(n - 1):
        i, j = divmod(int(np.argmin(d)), n)
        i, j = min(i, j), max(i, j)
        merges.append((name[i], name[j], float(d[i, j])))
        if method == "complete":
            row = np.maximum(d[i], d[j])
        elif method == "single":
            row = np.minimum(d[i], d[j])
        elif method == "average":
            row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        else:
            raise InputError("method is complete, single or average")
        size[i] += size[j]
        alive[j] = False
        row[~alive] = np.inf
        row[i] = np.inf
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        name[i] = n + step
    return merges


def cut_tree(n: int, merges: Sequence[tuple[int, int, float]], threshold: float) -> list[int]:
    """Cluster numbers from 1, in order of first members, of merges up to the threshold."""
    parent = list(range(2 * n))
    for step, (a, b, d) in enumerate(merges):
        if d <= threshold:
            parent[a] = parent[b] = n + step
    roots = []
    for i in range(n):
        while parent[i] != i:
            i = parent[i]
        roots.append(i)
    order = {r: k for k, r in enumerate(dict.fromkeys(roots), 1)}
    return [order[r] for r in roots]


def leaf_order(n: int, merges: Sequence[tuple[int, int, float]]) -> list[int]:
    """Leaves from left to right, as a dendrogram draws them."""
    kids = {n + i: (a, b) for i, (a, b, _) in enumerate(merges)}
    out, todo = [], [n + len(merges) - 1] if merges else list(range(n))
    while todo:
        x = todo.pop()
        if x < n:
            out.append(x)
        else:
            todo += [kids[x][1], kids[x][0]]
    return out


def cluster_terms(sims: DataFrame, terms: DataFrame, algorithm: str = "hierarchical", method: str = "complete", threshold: float = 0.7, graph: DataFrame | None = None, resolution: float = 1.0) -> DataFrame:
    """``term, cluster``: by hierarchical clustering of ``1 - s`` (up to ``MOST_TERMS`` terms), or components, label propagation or
    Leiden communities (of ``resolution``) of the graph."""
    if algorithm == "hierarchical":
        names = [r.term for r in terms.select("term").distinct().orderBy("term").limit(MOST_TERMS + 1).collect()]
        if len(names) > MOST_TERMS:
            raise InputError(f"more than {MOST_TERMS} terms; use components")
        at = {t: i for i, t in enumerate(names)}
        d = np.ones((len(names), len(names)))
        for r in sims.where("s > 0").toLocalIterator():
            d[at[r.a], at[r.b]] = d[at[r.b], at[r.a]] = 1 - r.s
        found = cut_tree(len(names), linkage(d, method), threshold)
        kind = dict(terms.dtypes)["term"]
        return terms.sparkSession.createDataFrame(list(zip(names, found, strict=True)), f"term {kind}, cluster int")
    if graph is None:
        raise InputError("this algorithm needs the graph")
    if algorithm == "components":
        return drop_small(graph, terms, 1).withColumnRenamed("component", "cluster")
    if algorithm in ("propagation", "leiden"):
        from quantell.operators.neighbours import spread_labels

        both = graph.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("s").alias("weight"))
        both = both.union(both.select("dst", "src", "weight"))
        lab = (leiden(both, resolution) if algorithm == "leiden" else spread_labels(both)).withColumnRenamed("cell_id", "term")
        return terms.select("term").distinct().join(lab, "term", "left").select("term", F.coalesce("label", "term").alias("cluster"))
    raise InputError("algorithm is hierarchical, components, propagation or leiden")


def representatives(clusters: DataFrame, graph: DataFrame, pvals: DataFrame, how: str = "pval", most: int | None = None) -> DataFrame:
    """``cluster, term, padj, degree``: per cluster the term with the least p-value, the largest weighted degree, or the largest
    sum of degree and −log10 p; ties to the first term. Then the ``most`` of least p-value."""
    deg = graph.select("a", "s").union(graph.select("b", "s")).groupBy("a").agg(F.sum("s").alias("degree")).withColumnRenamed("a", "term")
    j = clusters.join(pvals.select("term", "padj"), "term").join(deg, "term", "left").fillna(0.0, subset=["degree"])
    key: dict[str, Column] = {"pval": F.col("padj"), "degree": -F.round("degree", 9), "hybrid": -F.round(F.col("degree") - F.log10(F.greatest("padj", F.lit(1e-300))), 9)}
    if how not in key:
        raise InputError(f"how is one of {sorted(key)}")
    best = j.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(key[how], "term"))).where("r = 1").drop("r")
    out = best.select("cluster", "term", "padj", "degree")
    return out.orderBy("padj", "term").limit(most) if most else out


def enrichment(genes: DataFrame, sets: DataFrame, universe: int | None = None) -> DataFrame:
    """``term, k, n_set, n_genes, universe, pval``: hypergeometric over-representation of ``genes`` (gene) in ``sets`` (term, gene)."""
    sets = sets.select("term", "gene").distinct()
    mine = genes.select("gene").distinct()
    if universe is None:
        universe = sets.select("gene").union(mine).distinct().count()
    sizes = sets.groupBy("term").agg(F.count("*").cast("double").alias("n_set"))
    hits = sets.join(mine, "gene").groupBy("term").agg(F.count("*").cast("double").alias("k"))
    n = mine.agg(F.count("*").cast("double").alias("n_genes"))
    out = sizes.join(hits, "term").join(F.broadcast(n)).withColumn("universe", F.lit(float(universe)))  # one row is broadcast
    return out.withColumn("pval", hypergeom_sf("k", "universe", "n_set", "n_genes"))


def go_analysis(df: DataFrame, sets: DataFrame, *, gene_key: str, pval_key: str, log2fc_key: str, pval_cutoff: float = 0.05, log2fc_cutoff: float = 0.25) -> DataFrame:
    """Enrichment of the genes that are higher (``enriched``) and lower (``depleted``) in local gene sets, adjusted within each state."""
    from quantell.operators.testing import adjust, up_and_down

    up, down = up_and_down(df, pval=pval_key, lfc=log2fc_key, pval_cutoff=pval_cutoff, log2fc_cutoff=log2fc_cutoff)
    out = None
    for state, part in (("enriched", up), ("depleted", down)):
        one = enrichment(part.select(F.col(gene_key).alias("gene")), sets).withColumn("state", F.lit(state))
        out = one if out is None else out.union(one)
    return adjust(out, "pval", ["state"])
