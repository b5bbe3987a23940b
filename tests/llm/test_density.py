from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import quantell.llm.density as density
from quantell.llm.blocks import fit_tree
from quantell.llm.density import _cover, density_clusters, describe_clusters

SCHEMA = "cell_id long, x_scvi array<float>, lead long, cluster string"


def table(spark, ids, x, extra=()):
    return spark.createDataFrame([(int(i), [float(v) for v in r], 0, "") for i, r in zip(ids, x, strict=True)] + list(extra), SCHEMA)


def brute(ids, x, cutoff):
    x = x.astype(float)
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= cutoff
    label = np.array(ids).copy()
    while True:
        new = np.array([label[near[i]].min() for i in range(len(label))])
        if (new == label).all():
            return dict(zip(map(int, ids), map(int, label), strict=True))
        label = new


def clusters(spark, ids, x, cutoff=1.5, extra=(), dim=30):
    return density_clusters(table(spark, ids, x, extra), "cell_id", "x_scvi", cutoff, dim)


def test_clusters_equal_linking_all_pairs(spark, crowd):
    ids, x = crowd
    got = {r.id: r.cluster for r in clusters(spark, ids, x).collect()}
    assert got == brute(ids, x, 1.5)
    assert len(set(got.values())) < len(got) / 2


def test_blocks_and_facing_balls(spark, monkeypatch):
    """Uniform points in few dimensions: chains, balls that touch by their members only, many leaves."""
    rng = np.random.default_rng(8)
    x = rng.uniform(0, 26, (900, 3)).astype(np.float32)
    ids = rng.permutation(9000)[:900]
    monkeypatch.setattr(density, "fit_tree", lambda *a: fit_tree(*a, leaf_rows=40))
    facing = []
    real = density._facing
    monkeypatch.setattr(density, "_facing", lambda *a: facing.append(1) or real(*a))
    for cutoff, meet, face in ((1.2, 32768, 4096), (1.7, 32768, 4096), (1.7, 25, 2)):
        monkeypatch.setattr(density, "MEET_ROWS", meet)  # leaves divided into parts
        monkeypatch.setattr(density, "FACE_ROWS", face)  # and balls
        got = {r.id: r.cluster for r in clusters(spark, ids, x, cutoff, dim=3).collect()}
        assert got == brute(ids, x, cutoff)
    assert facing


def test_balls_hold_alike_rows():
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 3, (1500, 4)).astype(np.float32)
    lead = _cover(x, 0.6)
    assert (np.linalg.norm(x - x[lead], axis=1) <= 0.6).all() and (lead[lead] == lead).all()


def test_pointers_lead_to_denser_records(spark, crowd):
    ids, x = crowd
    rows = clusters(spark, ids, x).collect()
    dense = {r.lead: r.density for r in rows}
    by = {r.id: r for r in rows}
    assert all(dense[by[r.peak].lead] >= r.density for r in rows)
    hot = by[int(ids[0])]
    assert hot.density >= 290


def test_peaks_follow_the_densities(spark, crowd, monkeypatch):
    """Other densities choose other peaks, which lead the same clusters."""
    ids, x = crowd
    rows = clusters(spark, ids, x).collect()
    real = density._densities
    monkeypatch.setattr(density, "_densities", lambda *a: real(*a).withColumn("w", F.pmod(F.hash("id"), F.lit(1000)).cast("long")))
    other = {r.id: r for r in clusters(spark, ids, x).collect()}
    assert any(other[r.id].peak != r.peak for r in rows)
    assert all(other[r.id].cluster == r.cluster for r in rows)


def test_labels_come_by_pointers(spark, crowd, monkeypatch):
    """Where no pointer is followed, every ball is a cluster of its own."""
    ids, x = crowd
    real = density.follow
    monkeypatch.setattr(density, "follow", lambda p: real(p.limit(0)))
    rows = clusters(spark, ids, x).collect()
    least = {}
    for r in rows:
        least[r.lead] = min(least.get(r.lead, r.id), r.id)
    assert all(r.peak == r.lead and r.cluster == least[r.lead] for r in rows)
    assert {r.id: r.cluster for r in rows} != brute(ids, x, 1.5)


def test_delta_is_the_distance_to_the_nearest_denser_lead(spark, crowd):
    ids, x = crowd
    rows = clusters(spark, ids, x).collect()
    at = {int(i): v.astype(float) for i, v in zip(ids, x, strict=True)}
    leads = {r.id: r for r in rows if r.id == r.lead}
    for r in leads.values():
        ds = [float(np.linalg.norm(at[r.id] - at[q.id])) for q in leads.values() if (q.density, -q.id) > (r.density, -r.id)]
        near = min(ds, default=np.inf)
        assert r.delta == pytest.approx(near) if near <= 1.5 * density.HORIZON else r.delta is None
        assert (r.peak == r.id) == (near > 1.5)


def test_one_huge_vector(spark, crowd):
    """Rounding doesn't grow with a vector far from all others."""
    ids, x = crowd
    far = np.vstack([x, np.full((1, 30), 1e6, np.float32), x[:300] + np.float32(4096)]).astype(np.float32)
    more = np.concatenate([ids, [9000], np.arange(10_000, 10_300)])
    got = {r.id: r.cluster for r in clusters(spark, more, far).collect()}
    assert got == brute(more, far, 1.5)


def test_touching_peaks_climb(spark):
    """A star whose leaves are denser than its centre, and a chain, end in the densest; ties go to the smaller id."""
    rows = [(0, 1, i, 10 + i) for i in range(1, 6)] + [(20 + i, 50 - i, 21 + i, 49 - i) for i in range(8)] + [(40, 7, 41, 7)]
    got = {r.id: (r.peak, r.rho) for r in density.climb(spark.createDataFrame(rows, "a long, ra long, b long, rb long")).collect()}
    assert got == {i: (5, 15) for i in range(5)} | {21 + i: (20, 50) for i in range(8)} | {41: (40, 7)}


def test_dirt_copies_and_empty(spark, crowd):
    ids, x = crowd
    nan, inf = float("nan"), float("inf")
    good = [float(v) for v in x[0]]
    bad = [(None, good, 0, ""), (1, None, 0, ""), (2, good[:9], 0, ""), (3, [nan] * 30, 0, ""), (4, [-inf, *good[1:]], 0, ""), (5, [0.0] * 30, 0, ""), (6, [None, *good[1:]], 0, "")]
    got = {r.id: r.cluster for r in clusters(spark, ids, x, extra=[*bad, (int(ids[0]), good, 0, "")]).collect()}
    assert got == brute(ids, x, 1.5)
    same = {r.cluster for r in clusters(spark, ids[:50], np.repeat(x[:1], 50, axis=0)).collect()}
    assert same == {int(min(ids[:50]))}
    empty = clusters(spark, [], [])
    assert empty.count() == 0 and empty.columns == ["id", "cluster", "lead", "peak", "density", "delta", "dist"]
    assert clusters(spark, ids[:1], x[:1]).collect()[0].cluster == ids[0]


def test_description(spark, crowd):
    ids, x = crowd
    members = clusters(spark, ids, x)
    labels = spark.createDataFrame([(int(i), "a" if k % 3 else None) for k, i in enumerate(ids)], "cell_id long, annotation string")
    got = {r.lead_cell: r for r in describe_clusters(members, labels, "cell_id", "annotation").collect()}
    want = brute(ids, x, 1.5)
    sizes = {c: list(want.values()).count(c) for c in set(want.values())}
    assert {c: r.size for c, r in got.items()} == {c: n for c, n in sizes.items() if n > 1}
    hot = got[want[int(ids[0])]]
    assert hot.main_label == "a" and len(hot.typical_cells) == 3 and hot.main_share == pytest.approx(200 / 300, abs=0.01)
    assert all(want[c] == hot.lead_cell for c in hot.typical_cells)
    assert describe_clusters(members.where(F.lit(False)), labels, "cell_id", "annotation").count() == 0
