from __future__ import annotations

import math
import random
import time
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quantell.functions.labels import clean_label
from quantell.llm.quota import controlled_rounding, quota_sample, quotas, reached

CELLS = "cell_id long, annotation string, condition string, loaded_at timestamp_ntz, k int, short string"
TARGETS = "annotation string, condition string, target_share double, min_cells long"


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.tuples(st.sampled_from("abcde"), st.sampled_from("xyz")), st.floats(0, 50), min_size=1))
def test_rounding_preserves_both_margins(table):
    got = controlled_rounding(table)
    near = lambda whole, part: math.floor(part - 1e-6) <= whole <= math.ceil(part + 1e-6)
    assert all(near(got[c], table[c]) for c in table)
    for side in (0, 1):
        for v in {c[side] for c in table}:
            assert near(sum(got[c] for c in table if c[side] == v), sum(table[c] for c in table if c[side] == v))
    assert near(sum(got.values()), sum(table.values()))


def test_quotas_keep_minima_and_give_what_is_short_to_others():
    targets = {("a", "x"): (0.5, 1), ("a", "y"): (0.3, 1), ("b", "x"): (0.19, 1), ("b", "y"): (0.01, 5)}
    plan = quotas(targets, {("a", "x"): 20, ("a", "y"): 500, ("b", "x"): 500, ("b", "y"): 9}, 100)
    assert plan["a", "x"]["quota"] == 20
    assert plan["b", "y"]["quota"] == 5
    assert sum(p["quota"] for p in plan.values()) == 100
    assert quotas(targets, {}, 0)["a", "x"]["quota"] == 0


def draw(spark, cells, targets, **args):
    a, c = clean_label(F.col("annotation")), clean_label(F.col("condition"))
    sample, plan = quota_sample(spark.createDataFrame(cells, CELLS), spark.createDataFrame(targets, TARGETS), "cell_id", "loaded_at", a, c, a, c, **args)
    return sample, reached(sample, plan)


def cells(at, n=1000):
    return [(i, " T-cells" if i % 3 else "B_cells", "Disease" if i % 4 else "healthy", at(i % 9), 1, "") for i in range(n)]


TARGET_ROWS = [("t_cells", "disease", 0.5, 5), ("T_cells", "healthy", 0.2, 5), ("B_cells", "disease", 0.2, 5), ("B_cells", "healthy", 0.1, 200), ("pDC", "healthy", 0.0, 1)]


def test_exact_quotas_and_report(spark, at):
    sample, report = draw(spark, cells(at), TARGET_ROWS)
    got = Counter((r.r, r.c) for r in sample.collect())
    plan = {(r.r, r.c): r for r in report.collect()}
    assert {k: n for k, n in got.items()} == {k: r.quota for k, r in plan.items() if r.quota}
    assert sum(got.values()) == 200
    assert plan["b_cells", "healthy"].short and plan["pdc", "healthy"].short and not plan["t_cells", "disease"].short
    assert all(r.drawn == r.quota and abs(r.share - r.quota / 200) < 1e-12 for r in plan.values())
    assert plan["t_cells", "disease"].pressed and not plan["b_cells", "healthy"].pressed, "a minimum of 200 takes up the sample"
    again, _ = draw(spark, cells(at)[::-1], TARGET_ROWS)
    assert sorted(r.cell_id for r in again.collect()) == sorted(r.cell_id for r in sample.collect())
    assert sample.select("cell_id").distinct().count() == 200


def test_latest_row_decides(spark, at):
    d = cells(at, 100) + [(i, "other", "healthy", at(20), 1, "") for i in range(50)]
    sample, report = draw(spark, d, TARGET_ROWS)
    assert all(r.cell_id >= 50 for r in sample.collect())
    assert sum(r.available for r in report.collect()) == 50


def test_nulls_ties_and_empty(spark, at):
    d = [(None, "T_cells", "disease", at(1), 1, ""), (1, None, "disease", at(1), 1, ""), (2, "nan", "", at(1), 1, ""), (3, "T_cells", "disease", None, 1, ""), (4, "T_cells", "disease", at(1), 1, ""), (4, "T_cells", "disease", at(1), 1, "")]
    sample, report = draw(spark, d, [*TARGET_ROWS, (None, "x", 0.5, 1), ("T-cells", "DISEASE", 0.5, None)], fraction=1.0)
    assert {r.cell_id for r in sample.collect()} <= {3, 4}
    assert {(r.r, r.c): r.target_share for r in report.collect()}["t_cells", "disease"] == 1.0
    sample, report = draw(spark, [], TARGET_ROWS)
    assert sample.count() == 0 and all(r.short == (r.least > 0) for r in report.collect())
    sample, report = draw(spark, d, [])
    assert sample.count() == 0 and report.count() == 0


def test_rounding_of_many_strata():
    """A table of 40,000 cells is rounded in seconds, margins kept."""
    rng = random.Random(1)
    table = {(f"r{i}", f"c{j}"): rng.random() * 3 for i in range(200) for j in range(200)}
    start = time.monotonic()
    got = controlled_rounding(table)
    assert time.monotonic() - start < 60
    for i in range(200):
        row = sum(table[f"r{i}", f"c{j}"] for j in range(200))
        assert math.floor(row) <= sum(got[f"r{i}", f"c{j}"] for j in range(200)) <= math.ceil(row)
