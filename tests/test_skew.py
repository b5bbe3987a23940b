from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from quantell.functions.labels import clean_label, clean_source
from quantell.operators.skew import cell_summaries, heavy_keys, salted_aggregate

SCHEMA = "annotation string, batch string, total_counts double, pct_counts_mt double, n_genes_by_counts long, k0 string, salt int, n int"


def row(a, b, t=1.0, p=2.0, n=3):
    return (a, b, t, p, n, "x", 9, 9)


def test_labels(spark):
    odd = [" T-cells", "t__cells\t", "T  cells", "\tNaN ", "nan", "", "  ", None, "-_ -", "A-b_c"]
    df = spark.createDataFrame([(x,) for x in odd], "x string")
    got = [r[0] for r in df.select(clean_label(F.col("x"))).collect()]
    assert got == ["t_cells"] * 3 + [None] * 5 + ["_", "a_b_c"]
    assert [r[0] for r in df.select(clean_source(F.col("x"))).collect()][:1] == ["t-cells"]


def test_summaries_of_dominant_and_small_keys(spark):
    nan, inf = float("nan"), float("inf")
    data = [row("A", "b", float(i % 10)) for i in range(900)] + [row("a ", "B")] * 40 + [row("C", f"x{i}") for i in range(60)]
    data += [row("D", "d", nan), row("D", "d", inf), row("D", "d", -1.0), row("D", "d", None, 101.0, None), row(None, "b"), row("nan", None)]
    got = {(r.annotation, r.batch): r for r in cell_summaries(spark.createDataFrame(data, SCHEMA).repartition(5), salts=4).collect()}
    assert {k for k, r in got.items() if r.dominant} == {("a", "b")}
    a = got["a", "b"]
    assert a.n_rows == 940 and a.total_counts_valid == 940 and abs(a.total_counts_mean - (90 * 45 + 40) / 940) < 1e-4
    d = got["d", "d"]
    assert d.n_rows == 4 and d.total_counts_valid == 0 and d.total_counts_mean is None and d.pct_counts_mt_valid == 3 and d.n_genes_valid == 3
    assert got["c", "x1"].total_counts_sd is None
    assert got[None, "b"].n_rows == 1 and not got[None, "b"].dominant
    assert sum(r.n_rows for r in got.values()) == len(data)


def test_salting_changes_nothing(spark):
    data = [row("hot", None, float(i)) for i in range(500)] + [row(f"k{i % 40}", "z", float(i)) for i in range(200)] + [row("hot", None, None)]
    df = spark.createDataFrame(data, SCHEMA)
    keys, values = {"a": F.col("annotation"), "b": F.col("batch")}, {"v": F.col("total_counts")}
    salted = sorted(map(tuple, salted_aggregate(df, keys, values, salts=16, heavy_share=0.05).collect()), key=str)
    plain = sorted(map(tuple, salted_aggregate(df, keys, values, salts=1, heavy_share=2.0).collect()), key=str)
    assert salted == plain
    count = Counter(r[0] for r in data)
    assert {r[0]: r[2] for r in salted} == dict(count)


def test_heavy_keys_are_bounded_and_exact(spark):
    df = spark.createDataFrame([row(str(i % 20), "b") for i in range(200)], SCHEMA)
    assert heavy_keys(df, [F.col("annotation")], 0.05).count() == 20
    assert heavy_keys(df, [F.col("annotation")], 0.0501).count() == 0
    assert heavy_keys(df.limit(0), [F.col("annotation")], 0.05).count() == 0
    assert cell_summaries(df.limit(0)).count() == 0
