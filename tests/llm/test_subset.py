from __future__ import annotations

import numpy as np
import pytest

import quantell.llm.subset as subset
from quantell.llm.subset import pivoted, varied_subset


def table(spark, ids, x, extra=()):
    data = [(int(i), [float(v) for v in r], "run", 1) for i, r in zip(ids, x, strict=True)]
    return spark.createDataFrame([*data, *extra], "cell_id long, x_scvi array<float>, label string, pick int")


def labels(spark, ids):
    return spark.createDataFrame([(int(i), "rare" if k == 7 else "big" if k % 3 else None) for k, i in enumerate(ids)], "cell_id long, annotation string")


def test_pivots_are_independent_and_ordered():
    rng = np.random.default_rng(0)
    rows = np.vstack([rng.normal(size=(5, 20)), np.zeros((1, 20))])
    rows = np.vstack([rows, rows[:3], rows[0] + rows[1]]).astype(np.float32)
    picked, gains = pivoted(rows.copy(), 9)
    assert len(picked) == 5
    assert np.linalg.matrix_rank(rows[picked]) == 5
    assert gains[0] == pytest.approx(np.linalg.norm(rows, axis=1).max(), rel=1e-5)
    assert gains == sorted(gains, reverse=True)


def test_covers_labels_and_regions_without_crowding(spark, crowd):
    ids, x = crowd
    got = varied_subset(table(spark, ids, x), labels(spark, ids), 60, per_round=16).collect()
    assert len(got) == 60 and len({r.cell_id for r in got}) == 60
    assert [r.pick for r in got] == list(range(1, 61))
    assert {"rare", "big"} <= {r.label for r in got}
    at = {int(i): k for k, i in enumerate(ids)}
    chosen = [at[r.cell_id] for r in got]
    assert sum(k < 300 for k in chosen) <= 6, "the crowded group doesn't dominate"
    far = lambda c: np.linalg.norm(x[:, None] - x[None, c], axis=2).min(1).mean()
    random = np.mean([far(np.random.default_rng(s).choice(len(x), 60, replace=False)) for s in range(5)])
    assert far(chosen) < random


def test_more_rows_than_one_set_of_features_tells_apart(spark, crowd):
    ids, x = crowd
    got = varied_subset(table(spark, ids, x), labels(spark, ids), 330, n_features=400).collect()
    assert len({r.cell_id for r in got}) == 330
    few = varied_subset(table(spark, ids, x), labels(spark, ids), 330).collect()
    assert len({r.cell_id for r in few}) == 330


def test_fewer_features_than_rows_and_many_labels(spark):
    """All distinct rows come out, however few features the caller names, and every one of many labels."""
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(300, 30)), rng.normal(size=(1, 30)) + 1e-5 * rng.normal(size=(20, 30))]).astype(np.float32)
    ids = np.arange(len(x))
    got = varied_subset(table(spark, ids, x), labels(spark, ids[:0]), 320, n_features=128).collect()
    assert {r.cell_id for r in got} == set(range(320))
    many = spark.createDataFrame([(int(i), f"l{i % 200}") for i in ids], "cell_id long, annotation string")
    assert len({r.label for r in varied_subset(table(spark, ids, x), many, 200).collect()}) == 200


def test_leaves_are_read_from_one_table(spark, crowd, monkeypatch):
    ids, x = crowd
    monkeypatch.setattr(subset, "LEAF_ROWS", 100)
    got = varied_subset(table(spark, ids, x), labels(spark, ids), 40, per_round=10).collect()
    assert len({r.cell_id for r in got}) == 40 and {"rare", "big"} <= {r.label for r in got}


def test_same_for_any_order_and_partitioning(spark, crowd):
    ids, x = crowd
    a = varied_subset(table(spark, ids, x), labels(spark, ids), 30).collect()
    b = varied_subset(table(spark, ids[::-1], x[::-1]).repartition(7), labels(spark, ids).repartition(3), 30).collect()
    assert a == b


def test_dirt_and_small_tables(spark, crowd):
    ids, x = crowd
    nan, inf = float("nan"), float("inf")
    good = [float(v) for v in x[0]]
    dirt = [(None, good, "", 0), (1, None, "", 0), (2, good[:29], "", 0), (3, [nan] * 30, None, 0), (4, [inf, *good[1:]], "", 0), (5, [0.0] * 30, "", 0), (6, [None, *good[1:]], "", 0), (int(ids[0]), good, "", 0)]
    got = varied_subset(table(spark, ids[:5], x[:5], dirt), labels(spark, ids), 50).collect()
    assert {r.cell_id for r in got} <= {int(i) for i in ids[:5]}
    copies = varied_subset(table(spark, ids[:4], np.repeat(x[:1], 4, axis=0)), labels(spark, ids[:0]), 4).collect()
    assert len(copies) == 1
    empty = varied_subset(table(spark, [], []), labels(spark, []), 5)
    assert empty.columns == ["cell_id", "label", "pick", "gain"] and empty.count() == 0
    with pytest.raises(ValueError):
        varied_subset(table(spark, ids[:9], x[:9]), labels(spark, ids), 3, max_labels=1)
