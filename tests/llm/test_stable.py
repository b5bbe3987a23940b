from __future__ import annotations

from pyspark.sql import functions as F

from quantell.llm.stable import RANGE, raise_thresholds, stable_sample

SCHEMA = "cell_id long, batch string, annotation string, loaded_at timestamp_ntz, hash string, k int"


def sample(df, **args):
    return stable_sample(df, "cell_id", "loaded_at", [F.col("batch"), F.col("annotation")], **({"rate": 0.2, "floor": 2} | args))


def data(at, n=600):
    return [(i, "b1" if i % 10 else "b2", "rare" if i % 97 == 0 else None if i % 7 == 0 else "big", at(i % 30), "x", 0) for i in range(n)]


def test_same_for_order_partitions_and_copies(spark, at, rows):
    d = data(at)
    a = rows(sample(spark.createDataFrame(d, SCHEMA)))
    assert a == rows(sample(spark.createDataFrame(d[::-1] + d[:50], SCHEMA).repartition(5)))
    assert 60 < len(a) < 260


def test_rows_that_arrive_later_remove_nothing(spark, at):
    d = data(at)
    before = {r.cell_id for r in sample(spark.createDataFrame(d, SCHEMA)).collect()}
    # new cells, and chosen cells again with other labels
    later = [(i, "b1", "rare", at(40), "x", 0) for i in range(300, 1500)] + [(i, "b9", None, at(41), "x", 0) for i in range(0, 300)]
    after = {r.cell_id for r in sample(spark.createDataFrame(d + later, SCHEMA)).collect()}
    assert before <= after and len(after) > len(before)


def test_small_strata_are_present_and_rates_hold(spark, at):
    got = sample(spark.createDataFrame(data(at, 3000), SCHEMA)).collect()
    strata = {r.stratum for r in got}
    assert len(strata) == 6
    big = [r for r in got if r.stratum == "b1\u001fbig"]
    n = sum(1 for r in data(at, 3000) if r[1] == "b1" and r[2] == "big")
    assert abs(len(big) / n - 0.2) < 0.05
    assert all(r.hash < r.threshold or r.by_floor for r in got)


def test_thresholds_are_only_raised(spark, at):
    df = spark.createDataFrame(data(at), SCHEMA)
    a = spark.createDataFrame([("b1\u001fbig", RANGE // 2), (None, 5)], "stratum string, threshold long")
    b = spark.createDataFrame([("b1\u001fbig", 1), ("b2\u001fbig", 7)], "stratum string, threshold long")
    t = raise_thresholds(a, b)
    assert {r.stratum: r.threshold for r in t.collect()} == {"b1\u001fbig": RANGE // 2, "b2\u001fbig": 7}
    plain, more = {r.cell_id for r in sample(df).collect()}, {r.cell_id for r in sample(df, thresholds=t).collect()}
    assert plain < more


def test_nulls_and_empty(spark, at):
    d = [(None, "b", "a", at(1), "", 0), (1, None, None, at(1), "", 0), (2, "b", "a", None, "", 0), (2, "b", "a", at(3), "", 0)]
    assert {r.cell_id for r in sample(spark.createDataFrame(d, SCHEMA), rate=1.0).collect()} == {1, 2}
    assert {r.cell_id for r in sample(spark.createDataFrame(d, SCHEMA), rate=0.0).collect()} == {1, 2}
    assert sample(spark.createDataFrame([], SCHEMA)).count() == 0
