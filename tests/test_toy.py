"""Six cells of two groups and three genes, worked by hand; cell 4 holds only zeros."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from quantell.experiment import Experiment, InputError, concat, matrix_state, require_counts, select_slide, subset, subset_df, transfer_labels
from quantell.operators import expression as e
from quantell.operators import quality, testing, views

COUNTS = {1: (4, 0, 1), 2: (0, 2, 1), 3: (2, 2, 1), 4: (0, 0, 0), 5: (6, 0, 1), 6: (0, 8, 1)}


@pytest.fixture(scope="module")
def toy(spark):
    obs = spark.createDataFrame([(i, "A" if i < 4 else "B", f"s{i % 2}") for i in COUNTS], "cell_id long, grp string, batch string")
    var = spark.createDataFrame([("g1",), ("g2",), ("g3",)], "gene_id string")
    x = spark.createDataFrame([(i, f"g{j + 1}", float(v)) for i, r in COUNTS.items() for j, v in enumerate(r) if v], "cell_id long, gene_id string, value double")
    exp = Experiment(obs, var, {"counts": x, "X": x.withColumn("value", F.log1p("value"))})
    return exp


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_means_shares_and_fold_changes(toy):
    m = by(e.mean_expr(toy, group_by="grp"), "gene", "grp")
    assert [round(m[g, c].expr, 6) for g in ("g1", "g2", "g3") for c in "AB"] == [1.098612, 1.098612, 0.847298, 1.299283, 0.693147, 0.510826]
    assert by(e.pcts_cells(toy, group_by="grp"), "genes")[("g1",)].asDict() == {"genes": "g1", "A": 0.6667, "B": 0.3333}
    fc = by(e.log2fc(toy, group_by="grp", reference="A"), "genes")
    assert [round(fc[(g,)]["log2fc_B"], 6) + 0.0 for g in ("g1", "g2", "g3")] == [0.0, 1.0, -0.584962]
    below = by(e.pcts_cells(toy, group_by="grp", min_expr=-1, out_format="long"), "genes", "grp")
    assert all(r.pct == 1 for r in below.values())


def test_expr_counts_zeros(toy):
    assert e.expr(toy, features=["g1", "g2"], layer="counts").count() == 12
    w = by(e.expr(toy, features=["g1", "g2"], out_format="wide", layer="counts"), "cell_id")
    assert (w[(4,)].g1, w[(6,)].g2) == (0.0, 8.0)
    with pytest.raises(InputError):
        e.expr(toy, features=[])


def test_statistics(toy):
    s = by(testing.two_sample_stats(toy, "grp"), "group", "gene")
    assert [round(s["A", g].var1, 4) for g in ("g1", "g2", "g3")] == [4, 1.3333, 0] and [round(s["B", g].var1, 4) for g in ("g1", "g2", "g3")] == [12, 21.3333, 0.3333]
    t = by(testing.with_t(testing.two_sample_stats(toy, "grp")), "group", "gene")
    assert t["B", "g2"].score == pytest.approx(0.164434, abs=1e-6) and t["B", "g2"].df == pytest.approx(2.249027, abs=1e-6)
    assert t["B", "g3"].score == pytest.approx(-0.546965, abs=1e-6) and t["B", "g1"].pval == pytest.approx(1.0)


@pytest.mark.parametrize("reference", ["rest", "A"])
def test_wilcoxon(toy, reference):
    r = by(testing.rank_sums(toy, "grp", reference=reference, layer="counts"), "group", "gene")
    assert [r["B", g].rank_sum for g in ("g1", "g2", "g3")] == [10, 10, 9]
    z = by(testing.rank_genes_groups(toy, "grp", reference=reference, layer="counts", logcounts=False), "group", "gene")
    assert [round(z["B", g].score, 6) for g in ("g1", "g2", "g3")] == [-0.231869, -0.235702, -1.0]
    assert [round(z["B", g].pval, 6) for g in ("g1", "g2", "g3")] == [0.816639, 0.813664, 0.317311]
    assert all(round(z["B", g].padj, 6) == 0.816639 for g in ("g1", "g2", "g3"))
    b = by(testing.rank_genes_groups(toy, "grp", reference=reference, layer="counts", logcounts=False, corr_method="bonferroni"), "group", "gene")
    assert b["B", "g3"].padj == pytest.approx(0.951932, abs=1e-6)


def test_groups_of_one_cell_and_unknown_references_raise(toy):
    one = subset(toy, obs_key="cell_id", obs_groups=[1, 2, 3, 4])
    with pytest.raises(InputError):
        testing.rank_genes_groups(one, "grp")
    with pytest.raises(InputError):
        testing.rank_genes_groups(toy, "grp", reference="C")
    assert testing.rank_genes_groups(one, "grp", by="batch", reference="A").count() == 0


def test_adjustment(spark):
    df = spark.createDataFrame([("a", p) for p in (0.01, 0.04, 0.03, 0.20)] + [("b", 0.5), ("b", None)], "g string, p double")
    got = {(r.g, r.p): r.padj for r in testing.adjust(df, "p", ["g"]).collect()}
    assert [round(got["a", p], 6) for p in (0.01, 0.04, 0.03, 0.20)] == [0.04, 0.053333, 0.053333, 0.2]
    assert got["b", 0.5] == 0.5 and got["b", None] is None


def test_normalise_and_quality(toy):
    x = by(quality.normalise(toy, target_sum=10, layer="counts"), "cell_id", "gene_id")
    assert (round(x[1, "g1"].value, 6), round(x[1, "g3"].value, 6)) == (2.197225, 1.098612) and not any(k[0] == 4 for k in x)
    m = by(quality.cell_metrics(toy, {"one": "G1"}, "counts"), "cell_id")
    assert [m[(i,)].total_counts for i in COUNTS] == [5, 3, 5, 0, 7, 9] and m[(4,)].pct_counts_one == 0
    assert quality.quantile_bounds(quality.cell_metrics(toy, {}, "counts"), 5, 95) == (0.75, 8.5)
    assert quality.quantile_bounds(toy.obs, 0, None) == (None, None)
    kept = quality.filter_cells_genes(toy, min_genes_in_cell=2, min_cells_with_genes=3, patterns={}, layer="counts", max_counts=7)
    assert sorted(r.cell_id for r in kept.obs.collect()) == [1, 2, 3, 5] and kept.layer("counts").count() == 9
    with pytest.raises(InputError):
        quality.filter_cells_genes(toy, min_counts=1, low_quantile=5)


def test_pseudobulk_and_metacells(toy):
    p = by(e.pseudobulk(toy, batch_key="batch", cluster_key="grp", min_cells=1, min_counts=5, layer="counts"), "grp", "batch", "gene")
    assert {k[2] for k in p} == {"g1", "g2"} and sum(r.expr for r in p.values()) == 24
    r = e.pseudobulk(toy, batch_key="batch", cluster_key="grp", min_cells=2, min_counts=0, layer="counts", technical_replicates=2)
    assert {x.batch for x in r.collect()} <= {"s0_0", "s0_1", "s1_0", "s1_1"}
    for fx in ("sum", "mean", "var", "median", "count_nonzero"):
        got = e.metacells(toy, batch_key="batch", annotation_key="grp", size=2, min_cells=2, agg_fx=fx)
        assert got.count() == 6, "two groups have two cells"
    assert e.metacell_members(toy, batch_key="batch", annotation_key="grp", size=2, min_cells=3).count() == 0


def test_views(toy):
    d = by(views.dotplot(toy, x_axis="grp", features=None, mean_only_expressed=True), "gene", "grp")
    assert d["g1", "B"].expr == pytest.approx(math.log1p(6)) and d["g1", "B"].pct == pytest.approx(1 / 3)
    z = by(views.heatmap(toy, keys="grp", z_score="var"), "gene", "grp")
    assert z["g1", "A"].expr == 0 and z["g2", "A"].expr == pytest.approx(-1)
    two = views.dotplot(toy, x_axis="grp", y_axis="batch", features=["g1"])
    assert two.count() == 4
    v = views.volcano(testing.dge_results(testing.rank_genes_groups(toy, "grp", layer="counts", logcounts=False)), clean=False)
    assert set(r["class"] for r in v.collect()) <= {"NS", "LFC", "P", "Up", "Down"}
    assert views.heatmap_order(views.heatmap(toy, keys="grp"), "gene", "grp", "expr")[0] in ("g1", "g2", "g3")


def test_subsets(toy, spark):
    assert subset(toy, obs_key="grp", obs_groups="B").layer("counts").count() == 4
    assert subset(toy, obs_key="cell_id", obs_groups=3, comparison=">").obs.count() == 3
    with pytest.raises(InputError):
        subset(toy, obs_key="none", obs_groups="B")
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "x int, y string")
    assert [r.x for r in subset_df(df, col="y", col_groups="a", comparison="exclude").collect()] == [2, 3]
    assert [r.x for r in subset_df(df, col=["x", "y"], col_groups=[2, ["a", "b"]], comparison=[">=", "include"]).collect()] == [3]
    with pytest.raises(InputError):
        subset_df(df, col=["x", "y"], col_groups=[1], comparison="include")
    t = transfer_labels(toy.obs, spark.createDataFrame([(1, "new")], "cell_id long, l string"), "grp", "l", ["A"])
    assert {r.cell_id: r.grp for r in t.collect()} == {1: "new", 2: None, 3: None, 4: "B", 5: "B", 6: "B"}
    assert select_slide(toy, "s0", "batch").obs.count() == 3


def test_containers(toy):
    s = toy.swap("counts")
    assert s.layer().agg(F.sum("value")).first()[0] == 29 and "X_before" in s.layers
    c = concat({"a": toy, "b": toy})
    assert c.obs.count() == 12 and c.var.count() == 3 and c.layer("counts").where("cell_id = '1-a'").count() == 2
    assert matrix_state(toy, "counts").first().n_values == 12 - 1
    require_counts(toy, "counts")
    require_counts(toy, "X", inverse=True)
    with pytest.raises(InputError):
        require_counts(toy, "X")
    with pytest.raises(InputError):
        toy.layer("none")
