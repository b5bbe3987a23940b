from __future__ import annotations

import random

from pyspark.sql import functions as F

import quantell.llm.topn as topn
from quantell.llm.topn import top_n

SCHEMA = "groups string, genename string, padj double, log2fc double, g string, s0 string, place int, bound int"


def brute(data, n):
    best: dict = {}
    for g, i, p, l, *_ in data:
        if None in (g, i, p, l) or any(x != x or abs(x) == float("inf") for x in (p, l)):
            continue
        key = (p + 0.0, -abs(l))
        best.setdefault(g, {})
        best[g][i] = min(best[g].get(i, key), key)
    return sorted((g, i, k + 1) for g, items in best.items() for k, (i, _) in enumerate(sorted(items.items(), key=lambda x: (x[1], x[0].encode()))[:n]))


def run(spark, data, n=5, parts=4):
    df = spark.createDataFrame(data, SCHEMA).repartition(parts)
    out = top_n(df, F.col("groups"), F.col("genename"), [F.col("padj"), -F.abs("log2fc")], n)
    return sorted((r.group, r.item, r.place) for r in out.collect())


def data(n, seed=1):
    r = random.Random(seed)
    names = ["", "é", "Z", "a", "z-1", "ß", *[f"G{i}" for i in range(40)]]
    return [(r.choice(["hot", "hot", f"g{r.randrange(60)}", None]), r.choice([*names, None]), r.choice([0.0, -0.0, 1e-300, 0.05, 0.5, None, float("nan"), float("inf")]), r.choice([1.0, -1.0, 2.5, 0.0, None, float("-inf")]), "x", "y", 1, 0) for _ in range(n)]


def test_against_brute_force(spark):
    d = data(4000)
    assert run(spark, d) == brute(d, 5)
    assert run(spark, d, 1, 1) == brute(d, 1)
    assert run(spark, d, 100, 3) == brute(d, 100)


def test_partitions_reduced_while_read(spark, monkeypatch):
    d = data(3000, 2)
    monkeypatch.setattr(topn, "HELD_ROWS", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        assert run(spark, d, 3, 2) == brute(d, 3)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_copies_and_empty(spark):
    d = [("g", "a", 0.1, 1.0, "", "", 0, 0)] * 7 + [("g", "b", 0.1, -1.0, "", "", 0, 0)]
    assert run(spark, d, 5) == [("g", "a", 1), ("g", "b", 2)]
    assert run(spark, [], 5) == []
