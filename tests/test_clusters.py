"""Clusters of clouds over blocks, against plain versions that look at every pair."""

import itertools

import numpy as np
import pytest

from rangeforge.operators import clusters as c
from rangeforge.operators.links import linked_roots


def plain_clusters(rows, linked):
    """{(bag, id): (least id, size)} by looking at every pair of a bag."""
    root = {(r[0], r[1]): r[1] for r in rows}

    def top(bag, x):
        while root[bag, x] != x:
            x = root[bag, x]
        return x

    for a, b in itertools.combinations(rows, 2):
        if a[0] == b[0] and linked(np.array(a[2:5]), np.array(b[2:5])):
            x, y = sorted((top(a[0], a[1]), top(b[0], b[1])))
            root[a[0], y] = x
    tops = [(r[0], top(r[0], r[1])) for r in rows]
    return {(r[0], r[1]): (t[1], tops.count(t)) for r, t in zip(rows, tops, strict=True)}


def cloud():
    draw = np.random.default_rng(3)
    at = np.concatenate([draw.uniform(-6, 6, (150, 3)), np.cumsum(draw.uniform(-0.25, 0.25, (120, 3)), axis=0), np.linspace([-5, -5, 0], [5, 5, 0], 60), np.full((20, 3), 1.5)])
    return [(int(b), i, *map(float, p)) for i, p in enumerate(at) for b in ([i % 2] if i % 7 else [0, 1])]


@pytest.mark.parametrize("side", [3, 8])
def test_eps(spark, side):
    rows = cloud()
    schema = "bag long, id long, x double, y double, z double, size long, root long"
    points = spark.createDataFrame([(*r, 1, 1) for r in rows] + [(0, 9000, None, 1.0, 1.0, 1, 1), (0, None, 1.5, 1.5, 1.5, 1, 1)], schema)
    got = {(r.bag, r.id): (r.cluster, r.size) for r in c.eps_clusters(points, ["bag"], ["x", "y", "z"], "id", 0.6, side=side).collect()}
    want = plain_clusters(rows, lambda a, b: ((a - b) ** 2).sum() <= 0.36)
    assert got == {k: v for k, v in want.items() if v[1] >= 3} and max(v[1] for v in got.values()) > 50


def test_eps_compat(spark):
    rows = cloud()
    points = spark.createDataFrame(rows, "bag long, id long, x double, y double, z double")
    offsets = set(c.HALF_26) - {(0, 0, 1), (1, 1, -1)}

    def linked(a, b):
        step = tuple((np.floor(b / 0.6) - np.floor(a / 0.6)).astype(int).tolist())
        return (step in offsets or tuple(-x for x in step) in offsets) and ((a - b) ** 2).sum() <= 0.36

    got = {(r.bag, r.id): (r.cluster, r.size) for r in c.eps_clusters(points, ["bag"], ["x", "y", "z"], "id", 0.6, compat=True, side=2).collect()}
    assert got == {k: v for k, v in plain_clusters(rows, linked).items() if v[1] >= 3}


@pytest.mark.parametrize("side", [2, 8])
def test_cells(spark, side):
    rows = cloud()
    points = spark.createDataFrame(rows, "bag long, id long, x double, y double, z double")
    got = {(r.bag, r.id): r.cluster for r in c.cell_clusters(points, ["bag"], ["x", "y", "z"], "id", 0.5, side=side).collect()}
    assert got == {k: v[0] for k, v in plain_clusters(rows, lambda a, b: np.abs(np.floor(a / 0.5) - np.floor(b / 0.5)).max() <= 1).items()}
    assert c.cell_clusters(points.limit(0), ["bag"], ["x", "y", "z"], "id", 0.5).count() == 0
    assert c.eps_clusters(points.limit(0), ["bag"], ["x", "y", "z"], "id", 0.5).count() == 0


def test_linked_roots(spark):
    """A long chain, a star and a ring of each key have one root each; nothing links over keys."""
    pairs = [(k, i, i + 1) for k in (1, 2) for i in range(400)] + [(k, 1000, 1000 + i) for k in (1, 2) for i in range(1, 60)] + [(1, 2000 + i, 2000 + (i + 1) % 9) for i in range(9)] + [(1, 5, 5)]
    got = linked_roots(spark.createDataFrame(pairs, "k long, u long, v long"), ["k"]).collect()
    groups = {}
    for r in got:
        groups.setdefault((r.k, r.root), set()).add(r.node)
    assert sorted((k[0], min(v), len(v)) for k, v in groups.items()) == [(1, 0, 401), (1, 1000, 60), (1, 2000, 9), (2, 0, 401), (2, 1000, 60)]
    assert all(root in nodes for (_, root), nodes in groups.items())
    assert linked_roots(spark.createDataFrame([], "k long, u long, v long"), ["k"]).count() == 0


def plain_labels(xyz, eps):
    near = ((xyz[:, None] - xyz[None]) ** 2).sum(axis=2) <= eps * eps
    return c.join_pairs(len(xyz), *np.nonzero(near))


def test_labels_of_dense_clouds():
    """Clouds with far more near pairs than points: the labels are those of all pairs."""
    draw = np.random.default_rng(8)
    ball = lambda at, n, r: at + draw.normal(size=(n, 3)) * r
    for k in range(60):
        steps = [ball(np.array(at), int(draw.integers(1, 120)), draw.uniform(0.01, 0.2)) for at in draw.uniform(-1.5, 1.5, (12, 3))]
        xyz = np.round(np.concatenate(steps), int(draw.integers(1, 4)))
        for eps in (0.1, 0.3):
            assert (c.eps_labels(xyz, eps) == plain_labels(xyz, eps)).all()
    flat = draw.uniform(0, 2, (300, 2))
    assert (c.eps_labels(flat, 0.08) == plain_labels(flat, 0.08)).all()
    # Two dense walls just beyond eps, and one pair of points that joins them.
    wall = np.stack([np.zeros(2000), *draw.uniform(0, 0.5, (2, 2000))], axis=1)
    apart = np.concatenate([wall, wall[:, [0, 2, 1]] + [0.3001, 0, 0]])
    assert len(np.unique(c.eps_labels(apart, 0.3))) == 2
    assert len(np.unique(c.eps_labels(np.concatenate([apart, [[0.15, 0.25, 0.25]]]), 0.3))) == 1


def test_labels_memory():
    """20,000 points within reach of one another have 200 million links; none is held."""
    import tracemalloc

    xyz = np.random.default_rng(1).uniform(0, 0.25, (20_000, 3))
    tracemalloc.start()
    label = c.eps_labels(xyz, 0.3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (label == 0).all() and peak < 100 << 20
