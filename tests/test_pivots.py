"""The pivot index against all pairs in numpy: many blocks, crowded ones, ties, other clouds, odd coordinates."""

import numpy as np
import pytest

from sheetwise.operators import neighbors, pivots


def cloud(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "i bigint, x array<double>").repartition(3)


def squares(a, b):
    return np.round(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2), pivots.DIGITS)


def plain(a, b, k, itself):
    out = set()
    for i, row in enumerate(squares(a, b)):
        order = [j for j in np.lexsort((np.arange(len(b)), row)) if itself or i != j][:k]
        out |= {(i, int(j), r + 1) for r, j in enumerate(order)}
    return out


def data(kind):
    r = np.random.default_rng(4)
    if kind == "plane":
        return r.uniform(size=(400, 2))
    if kind == "grid":  # nothing but ties
        return np.stack(np.meshgrid(np.arange(18.0), np.arange(18.0)), axis=-1).reshape(-1, 2)
    if kind == "copies":  # a third of all points in one place
        return np.concatenate([np.full((130, 3), 0.25), r.normal(size=(260, 3))])
    return r.normal(size=(300, 20))


@pytest.mark.parametrize("kind", ["plane", "grid", "copies", "wide"])
def test_nearest_and_radius(spark, kind):
    x = data(kind)
    df = cloud(spark, x)
    index = pivots.build(df, "x", block=25, crowded=40)
    assert index.sizes.sum() == len(x) and index.blocks > 8
    assert {(r.i, r.j, r.rank) for r in pivots.knn(df, "x", 6, index=index).collect()} == plain(x, x, 6, False)
    assert {(r.i, r.j, r.rank) for r in pivots.knn(df, "x", 3, itself=True, index=index).collect()} == plain(x, x, 3, True)
    limit = {"plane": 0.1, "grid": 1.0, "copies": 0.3, "wide": 4.5}[kind]
    near = squares(x, x) <= limit**2
    got = [(r.i, r.j) for r in pivots.radius(df, "x", limit, index=index).collect()]
    assert len(got) == len(set(got)) and set(got) == {(int(i), int(j)) for i, j in zip(*np.nonzero(near)) if i != j}


def test_another_cloud(spark):
    r = np.random.default_rng(8)
    a, b = r.normal(size=(90, 3)), r.normal(size=(200, 3)) * 2
    index = pivots.build(cloud(spark, b), "x", block=20)
    assert {(q.i, q.j, q.rank) for q in pivots.knn(cloud(spark, b), "x", 4, cloud(spark, a), index=index).collect()} == plain(a, b, 4, True)
    near = {(int(i), int(j)) for i, j in zip(*np.nonzero(squares(a, b) <= 1.0))}
    assert {(q.i, q.j) for q in pivots.radius(cloud(spark, b), "x", 1.0, cloud(spark, a), index=index).collect()} == near


def test_blocks_are_skipped_where_bounds_help(spark):
    x = np.random.default_rng(2).uniform(size=(1500, 2))
    df = cloud(spark, x)
    assert pivots.share(df, "x", 5, pivots.build(df, "x", block=30)) < 0.2


def test_odd_points(spark):
    rows = [(0, [0.0, 0.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 0.0]), (4, [0.5, 0.0]), (None, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "i bigint, x array<double>")
    assert {(r.i, r.j) for r in pivots.knn(df, "x", 3).collect()} == {(0, 4), (4, 0)}
    assert pivots.knn(df.limit(0), "x", 3).count() == 0 and pivots.radius(df.limit(0), "x", 1.0).count() == 0
    flat = df.selectExpr("i", "x[0] as x0", "x[1] as x1")
    assert neighbors.radius_edges(flat, ["x0", "x1"], 0.0).count() == 0
    assert neighbors.nearest_in(flat, flat.limit(0), ["x0", "x1"]).count() == 0


def test_many_blocks_with_many_queries(spark, monkeypatch):
    """More than 32 blocks whose queries go to several tasks each."""
    x = data("wide")
    df = cloud(spark, x)
    index = pivots.build(df, "x", block=7)
    assert index.blocks > 32
    monkeypatch.setattr(pivots, "QUERIES", 8)
    assert {(r.i, r.j, r.rank) for r in pivots.knn(df, "x", 4, index=index).collect()} == plain(x, x, 4, False)
    got = {(r.i, r.j) for r in pivots.radius(df, "x", 4.5, index=index).collect()}
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(squares(x, x) <= 4.5**2)) if i != j}


@pytest.mark.parametrize("itself", [False, True])
def test_radius_where_points_share_places(spark, monkeypatch, itself):
    """Pairs of places leave the tasks, not pairs of points; one place is several rows, one has a single point."""
    r = np.random.default_rng(3)
    x = np.repeat(r.uniform(size=(60, 2)), r.integers(1, 12, size=60), axis=0)
    x = np.concatenate([x, np.full((50, 2), 0.5), [[0.5, 0.55]]])[r.permutation(len(x) + 51)]
    monkeypatch.setattr(pivots, "COPIES", 16)
    monkeypatch.setattr(pivots, "LEAST", 10)
    schemas, real = [], pivots._tasks
    monkeypatch.setattr(pivots, "_tasks", lambda q, p, run, schema, *a: schemas.append(schema) or real(q, p, run, schema, *a))
    got = [(q.i, q.j, q.d2) for q in pivots.radius(cloud(spark, x), "x", 0.1, itself=itself, digits=6).collect()]
    assert len(schemas) == 1 and "ids array<bigint>" in schemas[0]
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    near = {(int(i), int(j)): d[i, j] for i, j in zip(*np.nonzero(d <= 0.1**2)) if itself or i != j}
    assert len(got) == len(near) and {g[:2] for g in got} == set(near)
    assert all(abs(v - near[i, j]) < 5.1e-7 and round(v, 6) == v for i, j, v in got)
