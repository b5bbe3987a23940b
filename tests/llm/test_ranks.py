from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import quantell.llm.ranks as ranks
from quantell.llm.ranks import ask, compress, merge, merge_summaries, of_values, percentiles, rank_error, rank_summaries

numbers = st.lists(st.one_of(st.floats(-50, 50), st.sampled_from([0.0, 1.0, 2.0])), max_size=300)


@settings(max_examples=80, deadline=None)
@given(st.lists(numbers, min_size=1, max_size=8), st.sampled_from([0.0, 0.01, 0.05, 0.2]))
def test_answers_stay_within_the_tracked_and_the_permitted_error(parts, error):
    n, s = 0, of_values(np.zeros(0))
    for i, p in enumerate(parts, 1):
        s = merge(s, compress(of_values(np.array(p, float)), math.floor(error / 2 * len(p))))
        n += len(p)
        s = compress(s, math.floor(error / 2 * (1 + i / len(parts)) * n))
    all_ = np.sort(np.concatenate([np.array(p, float) for p in parts]))
    if not n:
        assert not len(s[0])
        return
    rank = np.arange(1, n + 1)
    v = s[0][ask(s, n, rank)]
    first, last = np.searchsorted(all_, v, "left") + 1, np.searchsorted(all_, v, "right")
    off = np.maximum(np.maximum(first - rank, rank - last), 0)
    assert off.max() <= rank_error(s, n) <= math.floor(error * n)


def test_error_and_size_are_bounded_over_many_merges():
    rng = np.random.default_rng(1)
    s, n, error = of_values(np.zeros(0)), 0, 0.005
    for _ in range(16):
        t, m = of_values(np.zeros(0)), 0
        for _ in range(16):
            x = rng.lognormal(size=2000)
            t, m = merge(t, compress(of_values(x), int(error / 2 * 2000))), m + 2000
        s, n = merge(s, compress(t, int(error * 0.75 * m))), n + m
    s = compress(s, int(error * n))
    assert rank_error(s, n) <= error * n
    assert len(s[0]) <= 8 / error


SCHEMA = "batch string, x double, y double, key string, n int"


def summed(spark, data, error=0.01, parts=5):
    return rank_summaries(spark.createDataFrame(data, SCHEMA).repartition(parts), F.col("batch"), {"x": F.col("x"), "y": F.col("y")}, error)


def test_percentiles_per_group(spark, monkeypatch):
    monkeypatch.setattr(ranks, "PART_TUPLES", 50)
    monkeypatch.setattr(ranks, "FAN_IN", 2)
    rng = np.random.default_rng(2)
    data = [(f"b{i % 3}" if i % 50 else "small", float(rng.exponential(9)), float(i % 7), "k", 1) for i in range(6000)]
    got = {(r.key, r.metric): r for r in percentiles(merge_summaries(summed(spark, data, 0.005), 0.005), {"median": 0.5, "p95": 0.95}).collect()}
    for key in ("b0", "b1", "b2", "small"):
        for metric, at in (("x", 1), ("y", 2)):
            v = np.sort([r[at] for r in data if r[0] == key])
            r = got[key, metric]
            assert r.n == len(v) and r.err <= 0.005 * len(v)
            for q, name in ((0.5, "median"), (0.95, "p95")):
                lo, hi = np.searchsorted(v, r[name], "left"), np.searchsorted(v, r[name], "right")
                assert lo - r.err - 2 <= q * (len(v) - 1) <= hi + r.err + 2
    small = np.array([r[1] for r in data if r[0] == "small"])
    assert got["small", "x"].err == 0 and got["small", "x"].p95 == pytest.approx(np.percentile(small, 95))


def test_loads_of_separate_days_merge(spark):
    a = [("b", float(i), 0.0, "", 0) for i in range(1000)]
    b = [("b", float(i), 0.0, "", 0) for i in range(1000, 3000)]
    day1, day2 = merge_summaries(summed(spark, a), 0.01), merge_summaries(summed(spark, b), 0.01)
    r = percentiles(merge_summaries(day1.union(day2), 0.01), {"median": 0.5}).where("metric = 'x'").first()
    assert r.n == 3000 and r.err <= 30 and abs(r["median"] - 1499.5) <= r.err + 1
    with pytest.raises(Exception, match="error above"):
        merge_summaries(day1.union(day2), 0.0001).collect()


def test_dirt_and_empty(spark):
    nan, inf = float("nan"), float("inf")
    d = [(None, 1.0, 1.0, "", 0), ("b", None, nan, "", 0), ("b", inf, 2.0, "", 0), ("b", -inf, 2.0, "", 0), ("c", None, None, "", 0)]
    got = percentiles(merge_summaries(summed(spark, d)), {"median": 0.5}).collect()
    assert [(r.key, r.metric, r.n, r["median"]) for r in got] == [("b", "y", 2, 2.0)]
    assert percentiles(merge_summaries(summed(spark, [])), {"median": 0.5}).count() == 0
