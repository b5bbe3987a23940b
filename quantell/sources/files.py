"""Readers and writers: tables, MatrixMarket and 10x folders, spatial folders, bundles of an experiment."""

from __future__ import annotations

import importlib
import re
import zipfile
from collections.abc import Callable, Iterator, Mapping
from io import BytesIO
from typing import Any
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quantell.experiment import Experiment, InputError
from quantell.operators.testing import up_and_down

#: Values fixed by file formats.
INDEX_COLUMNS = ("Unnamed: 0", "__index_level_0__")
XLSX = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
POSITIONS = ("in_tissue", "array_row", "array_col", "pxl_col", "pxl_row")


def tidy(df: DataFrame) -> DataFrame:
    """Index columns named ``index``, columns without a name left out."""
    for c in INDEX_COLUMNS:
        if c in df.columns:
            df = df.withColumnRenamed(c, "index")
    return df.drop(*[c for c in df.columns if c == "" or re.fullmatch(r"_c\d+", c)])


def read_csv(spark: SparkSession, path: str, *, delimiter: str = ",", schema: str | None = None) -> DataFrame:
    """A table with a header; a schema spares the pass that finds the types."""
    reader = spark.read.option("header", True).option("sep", delimiter)
    return tidy(reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return tidy(spark.read.parquet(path))


def _cell_column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def read_excel(spark: SparkSession, path: str, *, sheet_name: str = "Sheet 1") -> DataFrame:
    """A sheet of a workbook, its first row the header; the only sheet of a workbook whatever its name.

    A workbook is one small file of at most about a million rows, read by the driver.
    """
    r = spark.read.format("binaryFile").load(path).select("content").first()
    with zipfile.ZipFile(BytesIO(bytes(r.content))) as z:
        links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = {s.get("name"): links[s.get(LINK)] for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{XLSX}sheet")}
        if len(sheets) == 1:
            sheet_name = next(iter(sheets))
        if sheet_name not in sheets:
            raise InputError(f"no sheet {sheet_name}; there are {sorted(sheets)}")
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{XLSX}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{XLSX}si")]
        target = sheets[sheet_name].lstrip("/")
        table: list[dict[int, Any]] = []
        for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{XLSX}row"):
            cells: dict[int, Any] = {}
            for k, c in enumerate(row.iter(f"{XLSX}c")):
                at = _cell_column(c.get("r")) if c.get("r") else k
                v, kind = c.find(f"{XLSX}v"), c.get("t")
                if kind == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{XLSX}t"))
                elif v is not None and v.text is not None:
                    cells[at] = shared[int(v.text)] if kind == "s" else v.text if kind in ("str", "e") else v.text == "1" if kind == "b" else float(v.text)
            table.append(cells)
    if not table:
        return spark.createDataFrame([], "index string")
    width = max(max(r, default=-1) for r in table) + 1
    names = [str(table[0].get(i, "")) for i in range(width)]
    body = [[r.get(i) for i in range(width)] for r in table[1:]]
    kinds = []
    for i in range(width):
        seen = {type(r[i]) for r in body if r[i] is not None}
        kinds.append("double" if seen == {float} else "boolean" if seen == {bool} else "string")
    body = [[v if v is None or k != "string" else str(v) for v, k in zip(r, kinds, strict=True)] for r in body]
    keep = [i for i, n in enumerate(names) if n != ""]
    return tidy(spark.createDataFrame([tuple(r[i] for i in keep) for r in body], ", ".join(f"`{names[i]}` {kinds[i]}" for i in keep)))


def read_mtx(spark: SparkSession, path: str) -> DataFrame:
    """``i, j, value`` of a coordinate MatrixMarket file, 1-based as in the file; lines are read in parallel where it isn't gzipped.

    The header and the line of sizes, the first that isn't a comment, are told apart without an order of lines: the
    sizes bound both indices and are the only line equal to the maximum in both places beside the number of entries.
    """
    lines = spark.read.text(path).where("value NOT LIKE '\\%%' AND trim(value) <> ''")
    p = F.split(F.trim("value"), r"\s+")
    parts = lines.select(p[0].cast("long").alias("i"), p[1].cast("long").alias("j"), F.coalesce(F.try_element_at(p, F.lit(3)).cast("double"), F.lit(1.0)).alias("value"))
    head = spark.read.text(path).where("value NOT LIKE '\\%%' AND trim(value) <> ''").limit(1).first()
    if head is None:
        return parts
    rows, cols, n = (int(v) for v in head.value.split()[:3])
    sizes = (F.col("i") == rows) & (F.col("j") == cols) & (F.col("value") == float(n))
    same = parts.where(sizes).count()
    if same == 1:
        return parts.where(~sizes)
    # an entry equals the line of sizes: keep all but one of them
    return parts.where(~sizes).union(parts.where(sizes).limit(same - 1))


def _numbered(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The first column of a file, numbered from 1 in the order of its lines."""
    df = spark.read.text(path)
    rows = df.select(F.split("value", "\t")[0].alias(name)).rdd.zipWithIndex().map(lambda r: (r[1] + 1, r[0][0]))
    return spark.createDataFrame(rows, f"n long, {name} string")


def _find(spark: SparkSession, folder: str, *names: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path
    for n in names:
        p = path(f"{folder}/{n}")
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return f"{folder}/{n}"
    raise InputError(f"none of {names} in {folder}")


def read_10x_mtx(spark: SparkSession, folder: str) -> Experiment:
    """A 10x folder: matrix of features × barcodes with their names, plain or gzipped. Repeated gene names get ``-1``, ``-2``…"""
    m = read_mtx(spark, _find(spark, folder, "matrix.mtx.gz", "matrix.mtx"))
    bars = _numbered(spark, _find(spark, folder, "barcodes.tsv.gz", "barcodes.tsv"), "cell_id")
    path = _find(spark, folder, "features.tsv.gz", "features.tsv", "genes.tsv.gz", "genes.tsv")
    rows = spark.read.text(path).rdd.zipWithIndex().map(lambda r: (r[1] + 1, *((r[0][0].split("\t") + ["", "", ""])[:3])))
    feats = spark.createDataFrame(rows, "n long, gene_code string, name string, feature_type string")
    feats = make_unique(feats.withColumn("name", F.when(F.col("name") == "", F.col("gene_code")).otherwise(F.col("name"))), "name", "n")
    x = m.join(feats.select(F.col("n").alias("i"), F.col("name").alias("gene_id")), "i").join(bars.withColumnRenamed("n", "j"), "j")
    return Experiment(bars.select("cell_id"), feats.select(F.col("name").alias("gene_id"), "gene_code", "feature_type"), {"X": x.where("value <> 0").select("cell_id", "gene_id", "value")})


def make_unique(df: DataFrame, name: str, order: str) -> DataFrame:
    """Repeated names get ``-1``, ``-2``… in order, the first stays."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    return df.withColumn("__k", k).withColumn(name, F.when(F.col("__k") > 0, F.concat_ws("-", name, F.col("__k").cast("string"))).otherwise(F.col(name))).drop("__k")


def read_counts_csv(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """``cell_id, gene_id, value`` of a dense table: a row per cell, its first column the barcode, a column per gene."""
    df = spark.read.option("header", True).option("sep", delimiter).csv(path)
    key, *genes = df.columns
    long = df.select(F.col(f"`{key}`").alias("cell_id"), F.explode(F.array(*[F.struct(F.lit(g).alias("gene_id"), F.col(f"`{g}`").cast("double").alias("value")) for g in genes])).alias("e"))
    return long.select("cell_id", "e.gene_id", "e.value").where("value <> 0")


def read_counts(spark: SparkSession, path: str, counts_file: str) -> Experiment:
    """Counts by the suffix of the file: csv and txt tables or MatrixMarket folders; 10x HDF5 files need ``h5py``."""
    if counts_file.endswith((".mtx", ".mtx.gz")):
        return read_10x_mtx(spark, path)
    if counts_file.endswith((".csv", ".txt")):
        x = read_counts_csv(spark, f"{path}/{counts_file}", "," if counts_file.endswith(".csv") else "\t")
        return Experiment(x.select("cell_id").distinct(), x.select("gene_id").distinct(), {"X": x})
    if counts_file.endswith(".h5"):
        return read_10x_h5(spark, f"{path}/{counts_file}")
    raise InputError(f"can't read {counts_file}")


#: Cells (or genes, of a matrix stored by genes) that a task reads from an HDF5 or zarr matrix at a time.
ROWS_AT_ONCE = 10_000


def _opened(path: str) -> Any:
    """The root group of an HDF5 file or a zarr folder; their packages are imported where it is read."""
    name = "zarr" if path.rstrip("/").endswith(".zarr") else "h5py"
    try:
        package = importlib.import_module(name)
    except ImportError as e:
        raise ModuleNotFoundError(f"reading {path} needs the package {name}; or convert it to a bundle (write_bundle)") from e
    return package.open(path, mode="r") if name == "zarr" else package.File(path, "r")


def _texts(values: Any) -> list:
    return [v.decode() if isinstance(v, bytes) else v for v in np.asarray(values).tolist()]


def _index(group: Any) -> Any:
    """The array of row names of a stored table."""
    return group[_texts([group.attrs.get("_index", "_index")])[0]]


def _column(stored: Any, a: int, b: int) -> list:
    """Rows a to b of a stored column; categories are looked up, a code below 0 is missing."""
    if hasattr(stored, "keys"):
        names = _texts(stored["categories"][:])
        return [names[c] if c >= 0 else None for c in np.asarray(stored["codes"][a:b]).tolist()]
    return _texts(stored[a:b])


def _table_rows(root: Any, name: str, key: str, a: int, b: int) -> pd.DataFrame:
    group = root[name]
    index = _texts([group.attrs.get("_index", "_index")])[0]
    cols = [c for c in _texts(group.attrs.get("column-order", [k for k in group.keys() if k != index]))]
    return pd.DataFrame({key: list(map(str, _column(group[index], a, b))), **{c: _column(group[c], a, b) for c in cols}})


def _nonzeros(matrix: Any, kind: str, names: tuple[Any, Any], a: int, b: int) -> pd.DataFrame:
    """``cell_id, gene_id, value`` of rows a to b of a stored matrix: cells, or genes where it is stored by genes."""
    if kind == "dense":
        block = np.asarray(matrix[a:b], float)
        major, minor = np.nonzero(block)
        value = block[major, minor]
    else:
        ends = np.asarray(matrix["indptr"][a : b + 1]).astype(np.int64)
        minor, value = np.asarray(matrix["indices"][ends[0] : ends[-1]]), np.asarray(matrix["data"][ends[0] : ends[-1]], float)
        major = np.repeat(np.arange(b - a), np.diff(ends))
    own, other = names if kind != "genes" else names[::-1]
    first, second = np.array(list(map(str, _texts(own[a:b]))), object)[major], np.array(list(map(str, _texts(other[:]))), object)[minor]
    cell, gene = (first, second) if kind != "genes" else (second, first)
    keep = (value != 0) & ~np.isnan(value)
    return pd.DataFrame({"cell_id": cell[keep], "gene_id": gene[keep], "value": value[keep]})


def _in_ranges(spark: SparkSession, n: int, read: Callable[[int, int], pd.DataFrame], schema: str) -> DataFrame:
    """``read`` of every range of ``ROWS_AT_ONCE`` of n rows, each range in a task of its own."""
    parts = max(1, -(-n // ROWS_AT_ONCE))

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in f["id"]:
                yield read(int(i) * ROWS_AT_ONCE, min(n, (int(i) + 1) * ROWS_AT_ONCE))

    return spark.range(parts, numPartitions=parts).mapInPandas(each, schema)


def read_h5ad(spark: SparkSession, path: str) -> Experiment:
    """An ``.h5ad`` file or a ``.zarr`` folder of the same layout, where ``h5py`` or ``zarr`` is installed and all tasks see the path.

    Tasks read ranges of the matrix, whether it is dense or sparse, by cells or by genes, and of both tables; the driver
    reads shapes and a first row only. ``layers`` and embeddings are read as the matrix is, columns keep their names.
    """
    root = _opened(path)
    n = {name: _index(root[name]).shape[0] for name in ("obs", "var")}

    def table(name: str, key: str) -> DataFrame:
        head = _table_rows(root, name, key, 0, min(1, n[name]))
        schema = spark.createDataFrame(head).schema if len(head) else StructType([StructField(c, StringType()) for c in head])
        types = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in schema)
        return _in_ranges(spark, n[name], lambda a, b: _table_rows(_opened(path), name, key, a, b), types)

    def matrix(at: str) -> DataFrame:
        sparse = hasattr(root[at], "keys")  # a group of arrays; a dense matrix is one array
        how = {"csr_matrix": "cells", "csc_matrix": "genes"}[_texts([root[at].attrs["encoding-type"]])[0]] if sparse else "dense"

        def read(a: int, b: int) -> pd.DataFrame:
            own = _opened(path)
            return _nonzeros(own[at], how, (_index(own["obs"]), _index(own["var"])), a, b)

        return _in_ranges(spark, n["var" if how == "genes" else "obs"], read, "cell_id string, gene_id string, value double")

    layers = {"X": matrix("X")} | {k: matrix(f"layers/{k}") for k in (root["layers"].keys() if "layers" in root else ())}

    def vectors(at: str) -> DataFrame:
        def read(a: int, b: int) -> pd.DataFrame:
            own = _opened(path)
            return pd.DataFrame({"cell_id": list(map(str, _texts(_index(own["obs"])[a:b]))), "vec": [list(map(float, r)) for r in np.asarray(own[at][a:b])]})

        return _in_ranges(spark, n["obs"], read, "cell_id string, vec array<double>")

    obsm = {k: vectors(f"obsm/{k}") for k in (root["obsm"].keys() if "obsm" in root else ()) if not hasattr(root[f"obsm/{k}"], "keys")}
    return Experiment(table("obs", "cell_id"), table("var", "gene_id"), layers, obsm)


read_zarr = read_h5ad


def read_10x_h5(spark: SparkSession, path: str) -> Experiment:
    """Counts of a 10x ``.h5`` file, where ``h5py`` is installed: barcodes × features, stored by barcodes; tasks read ranges."""
    group = _opened(path)["matrix"]
    n, genes = group["barcodes"].shape[0], group["features/id"].shape[0]

    def values(a: int, b: int) -> pd.DataFrame:
        own = _opened(path)["matrix"]
        return _nonzeros(own, "cells", (own["barcodes"], own["features/name"]), a, b)

    obs = _in_ranges(spark, n, lambda a, b: pd.DataFrame({"cell_id": _texts(_opened(path)["matrix/barcodes"][a:b])}), "cell_id string")
    cols = {"gene_id": "name", "ensembl_id": "id", "feature_type": "feature_type"}
    var = _in_ranges(spark, genes, lambda a, b: pd.DataFrame({c: _texts(_opened(path)[f"matrix/features/{k}"][a:b]) for c, k in cols.items()}), ", ".join(f"{c} string" for c in cols))
    return Experiment(obs, var, {"X": _in_ranges(spark, n, values, "cell_id string, gene_id string, value double")})


def read_visium(spark: SparkSession, path: str, *, counts_file: str, library_id: str | None = None) -> Experiment:
    """A spatial folder: counts, tissue positions joined by barcode (those without one stay), scale factors; images are left alone."""
    exp = read_counts(spark, path, counts_file)
    where = _find(spark, f"{path}/spatial", "tissue_positions.csv", "tissue_positions_list.csv")
    names = ["cell_id", *POSITIONS]
    raw = spark.read.csv(where).toDF(*names).where("cell_id <> 'barcode'")
    pos = raw.select("cell_id", *[F.col(c).cast("int").alias(c) for c in POSITIONS[:3]], *[F.col(c).cast("double").alias(c) for c in POSITIONS[3:]])
    obs = exp.obs.join(pos.drop("pxl_row", "pxl_col"), "cell_id", "left")
    vec = exp.obs.join(pos, "cell_id", "left").select("cell_id", F.array("pxl_row", "pxl_col").alias("vec"))
    factors = spark.read.text(_find(spark, f"{path}/spatial", "scalefactors_json.json"), wholetext=True).select(F.from_json("value", "map<string,double>").alias("m")).first().m
    return Experiment(obs, exp.var, exp.layers, {"spatial": vec}, {}, {"spatial": {library_id or "library": {"scalefactors": factors}}})


def write_bundle(exp: Experiment, path: str, mode: str = "errorifexists") -> None:
    """An experiment as a folder of Parquet tables; matrices are sorted by gene within files, so reads of few genes skip most."""
    exp.obs.write.mode(mode).parquet(f"{path}/obs")
    exp.var.write.mode(mode).parquet(f"{path}/var")
    for kind, tables in (("layers", exp.layers), ("obsm", exp.obsm), ("obsp", exp.obsp)):
        for name, df in tables.items():
            (df.sortWithinPartitions("gene_id") if kind == "layers" else df).write.mode(mode).parquet(f"{path}/{kind}/{name}")


def read_bundle(spark: SparkSession, path: str) -> Experiment:
    """What :func:`write_bundle` wrote."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path

    def tables(kind: str) -> Mapping[str, DataFrame]:
        p = hpath(f"{path}/{kind}")
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return {}
        return {s.getPath().getName(): spark.read.parquet(s.getPath().toString()) for s in fs.listStatus(p) if s.isDirectory()}

    return Experiment(spark.read.parquet(f"{path}/obs"), spark.read.parquet(f"{path}/var"), tables("layers"), tables("obsm"), tables("obsp"))


def write_dge(results: DataFrame, path: str, *, group: str | None = None, pval_cutoff: float = 0.05, log2fc_cutoff: float = 0.25, mode: str = "errorifexists") -> None:
    """A result table and its higher and lower genes, as ``AllGenes``, ``UpregGenes`` and ``DownregGenes``, by group if one is named."""
    up, down = up_and_down(results, pval_cutoff=pval_cutoff, log2fc_cutoff=log2fc_cutoff)
    for name, df in (("AllGenes", results), ("UpregGenes", up), ("DownregGenes", down)):
        w = df.write.mode(mode)
        (w.partitionBy(group) if group and name != "AllGenes" else w).parquet(f"{path}/{name}")


def adopt_foreign_names(exp: Experiment, batch_key: str = "batch") -> Experiment:
    """The names that converted R objects carry brought to ours: graphs snn and nn, ``orig.ident``, layer ``data``; X is the log layer."""
    graphs = {{"snn": "connectivities", "nn": "distances"}.get(k, k): v for k, v in exp.obsp.items()}
    layers = {{"data": "logcounts"}.get(k, k): v for k, v in exp.layers.items()}
    x = layers.get("logcounts", layers.get("counts"))
    return Experiment(exp.obs.withColumnRenamed("orig.ident", batch_key), exp.var, {**layers, **({"X": x} if x is not None else {})}, exp.obsm, graphs, exp.uns)
