from __future__ import annotations

import gzip
import json
import pickle
import sys
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantell.experiment import Experiment, InputError
from quantell.functions.markers import heart_labels, heart_markers
from quantell.sources import files
from quantell.streaming.windows import windowed_stats


def test_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Unnamed: 0,x,\nr1,1,9\nr2,,9\n")
    df = files.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["index", "x"] and df.count() == 2
    df.write.parquet(str(tmp_path / "p"))
    assert files.read_parquet(spark, str(tmp_path / "p")).columns == ["index", "x"]


def mtx(path, lines, gz=True):
    text = "%%MatrixMarket matrix coordinate integer general\n%note\n" + "\n".join(lines) + "\n"
    with gzip.open(path, "wt") if gz else open(path, "w") as f:
        f.write(text)


def test_matrix_market(spark, tmp_path):
    mtx(tmp_path / "m.mtx", ["2 3 3", "1 1 5", "2 3 3", "1 2 7"], gz=False)
    assert sorted(map(tuple, files.read_mtx(spark, str(tmp_path / "m.mtx")).collect())) == [(1, 1, 5.0), (1, 2, 7.0), (2, 3, 3.0)]


def folder(path, gz=True):
    mtx(path / ("matrix.mtx.gz" if gz else "matrix.mtx"), ["3 2 3", "1 1 5", "3 2 2", "2 1 1"], gz)
    for name, lines in (("barcodes.tsv", ["AAA-1", "CCC-1"]), ("features.tsv", ["E1\tCd4\tGene Expression", "E2\tCd4\tGene Expression", "E3\tRpl11\tGene Expression"])):
        with gzip.open(path / f"{name}.gz", "wt") as f:
            f.write("\n".join(lines) + "\n")


def test_10x_folder_and_visium(spark, tmp_path):
    folder(tmp_path)
    exp = files.read_10x_mtx(spark, str(tmp_path))
    assert sorted(map(tuple, exp.layer().collect())) == [("AAA-1", "Cd4", 5.0), ("AAA-1", "Cd4-1", 1.0), ("CCC-1", "Rpl11", 2.0)]
    (tmp_path / "spatial").mkdir()
    (tmp_path / "spatial/tissue_positions.csv").write_text("barcode,in_tissue,array_row,array_col,pxl_row,pxl_col\nAAA-1,1,0,2,10.5,20.5\n")
    (tmp_path / "spatial/scalefactors_json.json").write_text(json.dumps({"spot": 1.5}, indent=1))
    v = files.read_visium(spark, str(tmp_path), counts_file="matrix.mtx.gz", library_id="s")
    assert {r.cell_id: r.vec for r in v.obsm["spatial"].collect()} == {"AAA-1": [20.5, 10.5], "CCC-1": [None, None]}
    assert v.obs.count() == 2 and v.uns["spatial"]["s"]["scalefactors"] == {"spot": 1.5}
    with pytest.raises(InputError):
        files.read_counts(spark, str(tmp_path), "x.loom")
    with pytest.raises(ModuleNotFoundError):
        files.read_counts(spark, str(tmp_path), "x.h5")


def test_excel(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>gene</t></si><si><t>p</t></si><si><t>Cd4</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="C2"><v>0.5</v></c></row><row><c r="A3" t="inlineStr"><is><t>B</t></is></c></row></sheetData></worksheet>')
    df = files.read_excel(spark, str(tmp_path / "a.xlsx"))
    assert df.columns == ["gene", "p"] and sorted(map(tuple, df.collect())) == [("B", None), ("Cd4", 0.5)]


def test_bundle_round_trip(spark, tmp_path):
    folder(tmp_path)
    exp = files.read_10x_mtx(spark, str(tmp_path))
    exp = Experiment(exp.obs, exp.var, {**exp.layers, "counts": exp.layer()}, {"X_pca": exp.obs.withColumn("vec", F.array(F.lit(1.0)))})
    files.write_bundle(exp, str(tmp_path / "b"))
    back = files.read_bundle(spark, str(tmp_path / "b"))
    assert sorted(back.layers) == ["X", "counts"] and list(back.obsm) == ["X_pca"] and not back.obsp
    assert sorted(map(tuple, back.layer().collect())) == sorted(map(tuple, exp.layer().collect()))
    t = spark.createDataFrame([("g", "a", 0.01, 1.0), ("h", "a", 0.01, -1.0), ("i", "b", 0.5, 2.0)], "GeneName string, group string, padj double, log2fc double")
    files.write_dge(t, str(tmp_path / "d"), group="group")
    assert [spark.read.parquet(str(tmp_path / f"d/{n}")).count() for n in ("AllGenes", "UpregGenes", "DownregGenes")] == [3, 1, 1]


def test_markers(spark):
    m = heart_markers(spark)
    assert m.select("cell_type").distinct().count() == 20 and len(heart_labels()) == 30
    some = heart_markers(spark, "human", spark.createDataFrame([("NRG1",), ("ptprc",)], "gene_id string"))
    assert sorted(map(tuple, some.collect())) == [("EndoEC", "NRG1"), ("ImmuneCells", "PTPRC"), ("T_cells", "PTPRC")]
    with pytest.raises(InputError):
        heart_markers(spark, "fish")


def test_stream_equals_table(spark, tmp_path):
    df = spark.range(400).select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 7).alias("ts"), (F.col("id") % 3).cast("string").alias("k"), F.col("id").cast("double").alias("v"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windowed_stats(stream, at="ts", keys=["k"], value="v").writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    want = sorted(map(tuple, windowed_stats(df, at="ts", keys=["k"], value="v").collect()))
    assert sorted(map(tuple, spark.table("w").collect())) == want


FAKE = """
import pickle


class Group(dict):
    def __init__(self, items=(), attrs=None):
        super().__init__(items)
        self.attrs = attrs or {}

    def __getitem__(self, path):
        node = self
        for part in path.split("/"):
            node = dict.__getitem__(node, part)
        return node


def File(path, mode):
    with open(path, "rb") as f:
        return pickle.load(f)
"""


@pytest.fixture
def stored(spark, tmp_path, monkeypatch):
    """A module in place of the HDF5 package, whose files are pickled groups; tasks import it too."""
    (tmp_path / "h5py.py").write_text(FAKE)
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "h5py.py"))
    import h5py

    monkeypatch.setattr(files, "ROWS_AT_ONCE", 3)
    yield h5py.Group, lambda root, name: (tmp_path / name).write_bytes(pickle.dumps(root)) and str(tmp_path / name)
    monkeypatch.delitem(sys.modules, "h5py")


def compressed(x):
    rows = [np.flatnonzero(r) for r in x]
    return {"indptr": np.concatenate([[0], np.cumsum([len(r) for r in rows])]), "indices": np.concatenate(rows), "data": np.concatenate([r[i] for r, i in zip(x, rows, strict=True)])}


@pytest.mark.parametrize("kind", ["csr_matrix", "csc_matrix", "array"])
def test_stored_matrices_are_read_in_ranges(spark, stored, kind):
    group, save = stored
    x = np.random.default_rng(1).poisson(0.6, (8, 5)).astype(float)
    cells, genes = [f"c{i}".encode() for i in range(8)], [f"g{i}".encode() for i in range(5)]
    matrix = x if kind == "array" else group(compressed(x if kind == "csr_matrix" else x.T), {"encoding-type": kind})
    batch = group({"categories": np.array([b"one", b"two"]), "codes": np.array([0, 1, -1, 0, 1, 1, 0, 0])})
    obs = group({"name": np.array(cells), "n": np.arange(8), "batch": batch}, {"_index": "name", "column-order": ["n", "batch"]})
    root = group({"X": matrix, "obs": obs, "var": group({"_index": np.array(genes)}, {"_index": "_index"}), "obsm": group({"X_pca": x[:, :2]}), "layers": group({"twice": 2 * x})})
    exp = files.read_h5ad(spark, save(root, "a.h5ad"))
    want = {(f"c{i}", f"g{j}", x[i, j]) for i, j in zip(*np.nonzero(x), strict=True)}
    assert {tuple(r) for r in exp.layer().collect()} == want
    assert {tuple(r) for r in exp.layer("twice").collect()} == {(c, g, 2 * v) for c, g, v in want}
    assert [tuple(r) for r in exp.obs.orderBy("cell_id").collect()] == [(f"c{i}", i, [None, "one", "two"][c + 1]) for i, c in enumerate(batch["codes"])]
    assert {r.cell_id: r.vec for r in exp.obsm["X_pca"].collect()} == {f"c{i}": list(x[i, :2]) for i in range(8)}
    assert sorted(r.gene_id for r in exp.var.collect()) == [f"g{j}" for j in range(5)]


def test_tenx_files(spark, stored, tmp_path):
    group, save = stored
    x = np.random.default_rng(2).poisson(0.8, (7, 4)).astype(float)
    features = group({"id": np.array([b"E0", b"E1", b"E2", b"E3"]), "name": np.array([b"A", b"B", b"C", b"D"]), "feature_type": np.array([b"Gene Expression"] * 4)})
    save(group({"matrix": group({**compressed(x), "barcodes": np.array([f"b{i}".encode() for i in range(7)]), "features": features})}), "counts.h5")
    exp = files.read_counts(spark, str(tmp_path), "counts.h5")
    assert {tuple(r) for r in exp.layer().collect()} == {(f"b{i}", "ABCD"[j], x[i, j]) for i, j in zip(*np.nonzero(x), strict=True)}
    assert exp.obs.count() == 7 and {r.ensembl_id for r in exp.var.collect()} == {"E0", "E1", "E2", "E3"}


def test_missing_packages_are_named(spark):
    with pytest.raises(ModuleNotFoundError, match="zarr"):
        files.read_zarr(spark, "/tmp/none.zarr")
