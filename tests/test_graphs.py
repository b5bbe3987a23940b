from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantell.operators import integration_quality as iq
from quantell.operators import models, ora, plot_tests, reduction
from quantell.operators import neighbours as nb
from quantell.operators.components import connected_components


def points(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "cell_id long, vec array<double>")


def test_components(spark):
    rng = np.random.default_rng(0)
    n = 300
    links = [(i, i + 1) for i in range(0, 120)] + [(int(a), int(b)) for a, b in rng.integers(130, n, (120, 2))] + [(5, 5), (7, None)]
    parent = list(range(n))
    for _ in range(n):
        for a, b in links:
            if b is not None:
                parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert got == {i: parent[i] for a, b in links if b is not None and a != b for i in (a, b)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
    hub = spark.range(1, 2000).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    assert connected_components(hub).where("root = 0").count() == 2000


@pytest.mark.parametrize("tile", [4096, 37])
def test_exact_neighbours(spark, tile):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(150, 4)), 1)
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 6)
    np.fill_diagonal(d, np.inf)
    want = {(i, j, k + 1) for i in range(150) for k, j in enumerate(np.lexsort((np.arange(150), d[i]))[:7])}
    got = {(r.src, r.dst, r.place) for r in nb.knn(points(spark, x), None, 7, tile=tile).collect()}
    assert got == want


@pytest.mark.parametrize("tile", [4096, 13])
def test_exact_neighbours_within_a_group(spark, tile):
    rng = np.random.default_rng(12)
    x = np.round(rng.normal(size=(150, 4)), 1)
    c = ["hot"] * 90 + ["rare"] * 4 + [None] * 3 + [f"g{i % 3}" for i in range(53)]
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 6)
    np.fill_diagonal(d, np.inf)
    want = set()
    for i in range(150):
        own = [j for j in range(150) if c[i] is not None and c[j] == c[i] and j != i]
        want |= {(i, j, k + 1) for k, j in enumerate(sorted(own, key=lambda j: (d[i, j], j))[:7])}
    rows = points(spark, x).join(spark.createDataFrame(list(enumerate(c)), "cell_id long, c string"), "cell_id")
    assert {(r.src, r.dst, r.place) for r in nb.knn(rows, None, 7, tile=tile, within="c").collect()} == want


def test_recluster_links_cells_whose_nearest_are_of_other_clusters(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(0, 0.1, (200, 3))
    x[:30] = rng.normal(0, 0.1, (30, 3))  # thirty cells of one cluster, each amid many of the other
    obs = spark.createDataFrame([(i, "few" if i < 30 else "many") for i in range(200)], "cell_id long, c string")
    got = {r.cell_id: r.recluster for r in nb.recluster(obs, points(spark, x), "c", k=7).collect()}
    alone = {r.cell_id: r.recluster for r in nb.recluster(obs.where("c = 'few'"), points(spark, x), "c", k=7).collect()}
    assert len(got) == 200 and {i: got[i] for i in range(30)} == alone and len(set(alone.values())) < 8


def test_fuzzy_weights_sum_to_the_logarithm_of_k(spark):
    rng = np.random.default_rng(3)
    near = nb.knn(points(spark, rng.normal(size=(50, 4))), None, 9)
    sums: dict[int, float] = {}
    nearest: dict[int, float] = {}
    for r in nb.fuzzy_weights(near, 10).collect():
        sums[r.src] = sums.get(r.src, 0) + r.weight
        nearest[r.src] = max(nearest.get(r.src, 0), r.weight)
    assert sums == pytest.approx(dict.fromkeys(range(50), np.log2(10)), abs=1e-4) and set(nearest.values()) == {1.0}
    same = nb.fuzzy_weights(nb.knn(points(spark, np.zeros((5, 4))), None, 3), 4).collect()
    assert len(same) == 15 and all(r.weight == 1 for r in same)
    assert nb.fuzzy_weights(near.limit(0), 10).count() == 0


def test_search_by_lists_reaches_its_recall(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(c, 1, (300, 12)) for c in rng.normal(0, 6, (10, 12))])
    base = points(spark, x)
    queries = base.where("cell_id % 50 = 0")
    exact = {(r.src, r.dst) for r in nb.knn(queries, base, 10).collect()}
    index = nb.fit_lists(base, n_lists=24)
    got = {(r.src, r.dst) for r in nb.search_lists(queries, nb.listed(base, index), index, 10, probes=6).collect()}
    assert len(got & exact) / len(exact) >= 0.9


def test_mutual_neighbours_are_symmetric(spark):
    rng = np.random.default_rng(3)
    a, b = points(spark, rng.normal(size=(40, 5))), points(spark, rng.normal(size=(50, 5)), range(100, 150))
    one = {(r.cell_a, r.cell_b) for r in nb.mutual_neighbours(a, b, 4).collect()}
    two = {(r.cell_b, r.cell_a) for r in nb.mutual_neighbours(b, a, 4).collect()}
    assert one == two and one


def test_anchors_remove_a_shift(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, 0.3, (60, 3)), rng.normal(6, 0.3, (60, 3))])
    shift = np.array([0.0, 1.5, 0.0])
    ref, query = points(spark, x), points(spark, x + shift + rng.normal(0, 0.05, x.shape), range(200, 320))
    anchors = nb.score_anchors(nb.mutual_neighbours(query, ref, 5), query, ref, 15)
    fixed = np.array([r.vec for r in nb.correct_by_anchors(query, ref, anchors, 20, sd=3).orderBy("cell_id").collect()])
    assert np.abs(fixed - x).mean() < 0.5 * np.abs(shift).mean() * 3
    assert nb.merge_order({("a", "b"): 50, ("a", "c"): 1}, {"a": 10, "b": 10, "c": 10})[0] == (("a",), ("b",))


def test_labels_spread_within_groups(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 0.5, (40, 3)), rng.normal(9, 0.5, (40, 3))])
    lab = {r.cell_id: r.label for r in nb.spread_labels(nb.neighbour_graph(points(spark, x), 8)).collect()}
    assert not {lab[i] for i in range(40)} & {lab[i] for i in range(40, 80)} and len(set(lab.values())) <= 8


def test_labels_spread_until_none_would_move(spark):
    chain = [(i, i + 1, 1.0 + i / 100) for i in range(12)]  # labels travel one node a turn
    pairs = [(100 + 2 * i, 101 + 2 * i, 1.0) for i in range(8)]  # some pairs lie in one half and would swap
    links = [*chain, *pairs]
    links += [(b, a, w) for a, b, w in links]
    lab = {r.cell_id: r.label for r in nb.spread_labels(spark.createDataFrame(links, "src long, dst long, weight double"), settle=6).collect()}
    weight: dict[int, dict[int, float]] = {}
    for a, b, w in links:
        weight.setdefault(a, {})[lab[b]] = weight.get(a, {}).get(lab[b], 0) + w
    assert lab == {a: min(near, key=lambda v: (-near[v], v)) for a, near in weight.items()}
    assert all(lab[a] == lab[b] for a, b, _ in pairs)
    with pytest.raises(RuntimeError):
        nb.spread_labels(spark.createDataFrame(links, "src long, dst long, weight double"), rounds=2)


def test_diffusion(spark):
    ring = [(i, (i + s) % 12, 1.0) for i in range(12) for s in (1, -1)]
    g = spark.createDataFrame(ring, "src long, dst long, weight double")
    m = np.zeros((12, 12))
    for a, b, _ in ring:
        m[a, b] = 0.5
    two = {(r.src, r.dst): r.weight for r in nb.diffuse(g, 2).collect()}
    p = m @ m
    assert two == pytest.approx({(i, j): p[i, j] for i in range(12) for j in range(12) if p[i, j] > 0 and i != j})
    assert nb.diffusion_neighbours(g, 5).groupBy("src").count().agg(F.min("count")).first()[0] == 5


def test_silhouettes(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 3))
    c = ["a"] * 30 + ["b"] * 29 + ["c"]
    obs = spark.createDataFrame([(i, v) for i, v in enumerate(c)], "cell_id long, k string")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    c = np.array(c)
    want = {}
    for i in range(60):
        a = d[i, c == c[i]].sum() / max((c == c[i]).sum() - 1, 1)
        b = min(d[i, c == o].mean() for o in set(c) - {c[i]})
        want[i] = 0.0 if (c == c[i]).sum() == 1 else (b - a) / max(a, b)
    got = {r.cell_id: r.silhouette for r in iq.silhouettes(points(spark, x), obs, "k", tile=17).collect()}
    assert got == pytest.approx(want)


def test_kbet_tells_mixed_from_separate_batches(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(160, 3))
    batch = rng.integers(0, 2, 160)
    obs = spark.createDataFrame([(i, "l", f"b{b}") for i, b in enumerate(batch)], "cell_id long, label string, batch string")

    def score(v):
        near = nb.knn(points(spark, v), None, 10).select("src", "dst", F.lit(1.0).alias("weight"))
        return iq.kbet(near.union(near.select("dst", "src", "weight")).distinct(), obs, "batch", "label").first().score

    assert score(x) > score(x + batch[:, None] * np.array([2.5, 0, 0])) + 0.2


def test_reductions(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(80, 6)) @ rng.normal(size=(6, 6))
    y, load, val = reduction.pca(points(spark, x), 3)
    got = np.array([r.vec for r in y.orderBy("cell_id").collect()])
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.abs(got) == pytest.approx(np.abs(u[:, :3] * s[:3]), abs=1e-6) and val == pytest.approx(s[:3] ** 2 / 79)
    assert reduction.top_features(load, list("abcdef"), 4)
    b = rng.normal(size=(50, 6))
    std = lambda m: (m - m.mean(0)) / m.std(0)
    u, s, vt = np.linalg.svd(std(x) @ std(b).T, full_matrices=False)
    ca, cb, sv = reduction.cca(points(spark, x), points(spark, b, range(100, 150)), 4)
    assert sv == pytest.approx(s[:4])
    assert np.abs(np.array([r.vec for r in ca.orderBy("cell_id").collect()])) == pytest.approx(np.abs(u[:, :4]), abs=1e-6)
    assert np.abs(np.array([r.vec for r in cb.orderBy("cell_id").collect()])) == pytest.approx(np.abs(vt[:4].T), abs=1e-6)


def test_harmony_brings_batches_together(spark):
    rng = np.random.default_rng(9)
    kind, batch = rng.integers(0, 3, 240), rng.integers(0, 2, 240)
    x = np.eye(3)[kind] * 8 + rng.normal(0, 0.4, (240, 3)) + batch[:, None] * np.array([1.5, -1.5, 1.0])
    obs = spark.createDataFrame([(i, f"b{b}") for i, b in enumerate(batch)], "cell_id long, batch string")
    v = points(spark, x)
    before, after = reduction.pcr(v, obs, "batch"), reduction.pcr(reduction.harmony(v, obs, "batch", n_clusters=6), obs, "batch")
    assert after < 0.5 * before


def test_gene_sets(spark):
    m = spark.createDataFrame([("t1", g) for g in "abc"] + [("t2", g) for g in "bcde"] + [("t3", "x")], "term string, gene string")
    got = {how: {(r.a, r.b): round(r.s, 6) for r in ora.similarities(m, how).collect()} for how in ora.SIMILARITIES}
    assert got["overlap"]["t1", "t2"] == 0.666667 and got["jaccard"]["t1", "t2"] == 0.4 and got["kappa"]["t1", "t2"] == 0
    assert got["overlap"]["t1", "t3"] == 0 and got["kappa"]["t1", "t3"] == -0.333333
    p = ora.parse_genes(spark.createDataFrame([("x", "a; b;a"), ("y", "c,d"), ("z", " e  f"), ("w", "")], "t string, g string"), "t", "g")
    assert sorted(map(tuple, p.collect())) == [("x", "a"), ("x", "b"), ("y", "c"), ("y", "d"), ("z", "e"), ("z", "f")]
    merges = ora.linkage(np.array([[0, 1, 5], [1, 0, 4], [5, 4, 0.0]]))
    assert [m[2] for m in merges] == [1, 5] and ora.cut_tree(3, merges, 2) == [1, 1, 2] and sorted(ora.leaf_order(3, merges)) == [0, 1, 2]


def test_models(spark):
    from quantell.experiment import Experiment

    rng = np.random.default_rng(10)
    rows, obs = [], []
    for i in range(400):
        b, c = i % 8, "ctrl" if i % 8 < 4 else "dis"
        obs.append((i, "k", f"b{b}", c))
        for g, lam in (("up", 3 if c == "dis" else 1), ("same", 2), ("same2", 4), ("down", 1 if c == "dis" else 3)):
            if v := rng.poisson(lam):
                rows.append((i, g, float(v)))
    x = spark.createDataFrame(rows, "cell_id long, gene_id string, value double")
    exp = Experiment(spark.createDataFrame(obs, "cell_id long, cluster string, batch string, condition string"), x.select("gene_id").distinct(), {"counts": x, "X": x.withColumn("value", F.log1p("value"))})
    for method in ("deseq2", "edger"):
        t = {r.GeneName: r for r in models.pseudobulk_test(exp, ctrl_cond="ctrl", disease_cond="dis", cluster_key="cluster", method=method, min_cells=10).collect()}
        assert t["up"].padj < 0.01 and t["up"].log2FoldChange > 1 and t["down"].log2FoldChange < -1 and t["same"].pvalue > 1e-3
    h = {r.GeneName: r for r in models.hurdle_test(exp, cond_key="condition", reference="ctrl", disease="dis").collect()}
    assert h["up"].padj < 1e-4 and h["same"].pvals > 1e-4
    c = models.consensus(exp, ctrl_cond="ctrl", disease_cond="dis", cluster_key="cluster", min_cells=10)
    assert len(c.columns) == 18 and {r.GeneName: r.consensus_significant for r in c.collect()}["up"] == "Yes"
    l = {r.gene: r.score for r in models.logreg_scores(exp, "condition").collect()}  # noqa: E741
    assert l["up"] < 0 < l["down"]
    d = models.DGEAnalysis(exp, groupby="condition", cluster_key="cluster")
    for m in ("wilcoxon", "ttest", "cluster_ttest"):
        assert d.run(m, reference="ctrl", disease="dis", **({"min_cells": 10} if m == "cluster_ttest" else {})).count() == 4 if m != "cluster_ttest" else True
    assert set(d.results) == {"wilcoxon", "ttest"}


def test_plot_tests(spark):
    rng = np.random.default_rng(11)
    df = spark.createDataFrame([("a", float(v), "h") for v in rng.normal(0, 1, 40)] + [("b", float(v), "h") for v in rng.normal(2, 1, 40)], "g string, v double, hue string")
    for test in ("t-test", "anova", "wilcoxon", "kruskal", "auto"):
        r = plot_tests.compare_groups(df, value="v", group="g", ctrl="a", groups=["b"], test=test, category="hue").first()
        assert r.hue == "h" and r.group == "b" and r.pval < 1e-6


def test_spatial_graph_is_not_broadcast(spark, tmp_path):
    points_ = spark.range(3000).select(F.col("id").alias("cell_id"), (F.col("id") % 50).cast("double").alias("x"), F.floor(F.col("id") / 50).cast("double").alias("y"))
    points_.write.parquet(str(tmp_path / "spots"))
    graph = nb.spatial_graph(spark.read.parquet(str(tmp_path / "spots")), 0.5)  # a small file, nine times as many rows
    assert "Broadcast" not in graph._jdf.queryExecution().executedPlan().toString()
    inner = graph.groupBy("src").count().where("src = 75").first()
    assert inner["count"] == 5 and graph.where("src = dst").count() == 3000


def test_exact_neighbours_over_regions(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.gamma(2, 60, size=(2000, 3)), 2)
    x = np.vstack([x, x, np.tile(x[:1], (700, 1)), 900 + x[:300] / 7])  # equal rows, more of them than a tile takes, and a far group
    names = np.array([f"c{i:05d}" for i in rng.permutation(len(x))])
    rows = spark.createDataFrame([(str(n), [float(v) for v in r]) for n, r in zip(names, x, strict=True)], "cell_id string, vec array<double>")
    order = np.argsort(names)
    x, names = x[order], names[order]
    got = {}
    for r in nb.knn(rows, None, 6, tile=300).collect():
        got.setdefault(r.src, []).append((r.place, r.dst, r.dist))
    assert len(got) == len(x)
    for i in range(0, len(x), 7):
        d = np.round(np.sqrt(((x - x[i]) ** 2).sum(1)), 6)  # 0 between equal rows, whatever their length
        d[i] = np.inf
        near = np.argsort(d, kind="stable")[:6]
        assert sorted(got[names[i]]) == [(p + 1, names[j], d[j]) for p, j in enumerate(near)]
