from __future__ import annotations

import gzip
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import quantell.operators.communities as communities
import quantell.operators.neighbours as neighbours
from quantell.experiment import Experiment, InputError
from quantell.operators.neighbours import areas
from quantell.operators.quality import doublet_scores, filter_cells_genes, highly_variable
from quantell.operators.reduction import pcr
from quantell.plans.pipelines import importer, integrate
from quantell.plans.shared import written


def folder(path, seed, cells=60, genes=12):
    path.mkdir()
    rng = np.random.default_rng(seed)
    m = rng.poisson(np.where(np.arange(genes)[:, None] % 3 == np.arange(cells)[None] % 3, 6, 0.5))
    i, j = np.nonzero(m)
    files = {
        "matrix.mtx": ["%%MatrixMarket matrix coordinate integer general", f"{genes} {cells} {len(i)}", *[f"{a + 1} {b + 1} {m[a, b]}" for a, b in zip(i, j, strict=True)]],
        "barcodes.tsv": [f"BC{b}" for b in range(cells)],
        "features.tsv": [f"E{g}\t{'mt-' if g == 0 else ''}G{g}\tGene Expression" for g in range(genes)],
    }
    for name, lines in files.items():
        with gzip.open(path / f"{name}.gz", "wt") as f:
            f.write("\n".join(lines) + "\n")
    return m


def test_importer(spark, tmp_path):
    m = {n: folder(tmp_path / n, s) for n, s in (("a", 1), ("b", 2))}
    exp, hist = importer(spark, {n: str(tmp_path / n) for n in m}, metadata={"condition": {"a": "healthy", "b": "disease"}}, min_genes_in_cell=2, min_cells_with_genes=5, cut_mt=60)
    h = hist.collect()
    assert [r.QC_Step for r in h] == ["Input", "Filtered"] and h[0].nCells == 120
    keep = {n: x[:, ((x > 0).sum(0) >= 2)] for n, x in m.items()}
    want = 0
    for x in keep.values():
        mt = x[0] / x.sum(0) * 100
        want += int((mt < 60).sum())
    assert h[1].nCells == want == exp.obs.count()
    assert {r.condition for r in exp.obs.select("condition").distinct().collect()} == {"healthy", "disease"}
    back = exp.layer("logcounts").groupBy("cell_id").agg(F.sum(F.expm1("value")).alias("s"))
    assert back.where(F.abs(F.col("s") - 1e4) > 1e-6).count() == 0
    with pytest.raises(InputError):
        importer(spark, {})


def test_batches_are_filtered_alone(spark):
    rows = [(i, "often", 1.0) for i in range(20)] + [(i, "rare", 1.0) for i in (0, 1, 2, 10)]
    obs = spark.createDataFrame([(i, "a" if i < 10 else "b") for i in range(20)], "cell_id long, batch string")
    x = spark.createDataFrame(rows, "cell_id long, gene_id string, value double")
    exp = Experiment(obs, x.select("gene_id").distinct(), {"X": x})
    out = filter_cells_genes(exp, min_genes_in_cell=1, min_cells_with_genes=3, patterns={}, batch_key="batch")
    assert {r.cell_id for r in out.layer().where("gene_id = 'rare'").collect()} == {0, 1, 2} and out.var.count() == 2


@pytest.fixture(scope="module")
def two_batches(spark):
    rng = np.random.default_rng(3)
    kind, batch = rng.integers(0, 3, 180), np.arange(180) % 2
    lam = np.where(np.arange(30)[None] % 3 == kind[:, None], 9.0, 1.0) * np.where((np.arange(30)[None] % 2 == 0) & (batch[:, None] == 1), 1.8, 1.0)
    m = rng.poisson(lam)
    x = spark.createDataFrame([(int(i), f"g{j:02d}", float(np.log1p(m[i, j]))) for i, j in zip(*np.nonzero(m), strict=True)], "cell_id long, gene_id string, value double")
    obs = spark.createDataFrame([(i, f"k{k}", f"b{b}") for i, (k, b) in enumerate(zip(kind, batch, strict=True))], "cell_id long, kind string, batch string")
    return Experiment(obs, x.select("gene_id").distinct(), {"X": x, "counts": x.withColumn("value", F.round(F.expm1("value")))})


@pytest.mark.parametrize("method", ["harmony", "anchors"])
def test_integration(spark, two_batches, method):
    out = integrate(two_batches, batch_key="batch", method=method, n_top=30, n_components=8, k=10)
    assert out.obs.where("cluster IS NULL").count() == 0
    before, after = (pcr(out.obsm[k], out.obs, "batch", 8) for k in ("X_pca", f"X_{method}"))
    assert after < before
    assert pcr(out.obsm[f"X_{method}"], out.obs, "kind", 8) > 0.2
    with pytest.raises(InputError):
        integrate(two_batches, batch_key="batch", method="none")


def test_integration_settles_in_blocks(spark, two_batches, monkeypatch):
    """Links of more than a task are settled in blocks of areas, not in rounds over all links."""

    def no_rounds(*_):
        raise AssertionError("a level went to rounds over tables")

    monkeypatch.setattr(communities, "TASK_LINKS", 1200)
    monkeypatch.setattr(communities, "_Level", no_rounds)
    out = integrate(two_batches, batch_key="batch", n_top=30, n_components=8, k=10)
    assert out.obsp["connectivities"].count() > 1200
    assert out.obs.where("cluster IS NULL").count() == 0
    best = out.obs.groupBy("cluster", "kind").count().groupBy("cluster").agg(F.max("count").alias("n")).agg(F.sum("n")).first()[0]
    assert best > 160, "clusters are of one kind"


def test_areas(spark):
    rows = [(i, [float(i % 50), float(i % 7)]) for i in range(2000)] + [(-1, None)]
    a = {r.cell_id: r.area for r in areas(spark.createDataFrame(rows, "cell_id long, vec array<double>"), 300).collect()}
    assert set(a) == set(range(2000)) and len(set(a.values())) > 4
    by = [[i % 50 for i in a if a[i] == n] for n in range(max(a.values()) + 1)]
    assert all(len(x) <= 350 and max(x) < min(y) for x, y in zip(by, by[1:]) if x and y)


def test_variable_genes_and_doublets(spark, two_batches):
    h = highly_variable(two_batches, n_top=5, batch_key="batch")
    assert h.where("highly_variable").count() == 5 and h.count() == 30
    d = doublet_scores(two_batches, layer="counts", rate=0.1)
    assert d.count() == 180 and {r.doublet_class for r in d.select("doublet_class").distinct().collect()} <= {"singlet", "doublet"}
    assert d.where("doublet_score < 0 OR doublet_score > 1").count() == 0


def test_written_tables_leave_no_shuffled_files(spark):
    store = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {n for n in (str(f.getName()) for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.getAllFiles())) if n.startswith("shuffle_")}
    before = held()
    t = written(spark.range(5000).withColumn("g", F.col("id") % 7).groupBy("g").agg(F.count("*").alias("n")))
    for _ in range(50):  # files are deleted beside the driver's work
        if not held() - before:
            break
        time.sleep(0.2)
    assert not held() - before and t.count() == 7


def test_doublet_scores_over_regions(spark, two_batches, monkeypatch):
    at_once = {r.cell_id: r.doublet_score for r in doublet_scores(two_batches, layer="counts").collect()}
    search = neighbours.near_lists
    monkeypatch.setattr(neighbours, "near_lists", lambda *a, **b: search(*a, **b, tile=40))
    assert {r.cell_id: r.doublet_score for r in doublet_scores(two_batches, layer="counts").collect()} == at_once and len(at_once) == 180
    # as they were when all pairs were compared, from dense vectors
    genes = sorted(r.gene_id for r in two_batches.layer("counts").select("gene_id").distinct().collect())
    v = {r.cell_id: np.array(r.vec) for r in neighbours.dense_vectors(two_batches, genes, "counts").collect()}
    turn = spark.createDataFrame([(c,) for c in v], two_batches.obs.select("cell_id").schema).select("cell_id", F.xxhash64("cell_id", F.lit(7)).alias("h"), F.pmod(F.xxhash64("cell_id", F.lit(11)), F.lit(64)).alias("n")).orderBy("n", "h", "cell_id").collect()
    rows = {str(c): x for c, x in v.items()} | {f"sim-{a.cell_id}": v[a.cell_id] + v[b.cell_id] for a, b in zip(turn, turn[1:]) if a.n == b.n}
    ids = sorted(rows)
    x = np.array([np.log1p(rows[i] * 1e4 / max(rows[i].sum(), 1e-300)) for i in ids])
    for c, score in at_once.items():
        d = np.round(np.sqrt(((x - x[ids.index(str(c))]) ** 2).sum(1)), 6)
        d[ids.index(str(c))] = np.inf
        assert score == pytest.approx(np.mean([ids[j].startswith("sim-") for j in np.argsort(d, kind="stable")[:15]]))
