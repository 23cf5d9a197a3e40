"""Mean subspaces, branches and parameters by segment against plain numpy."""

import numpy as np

from sheetwise.operators import subspaces


def test_mean_subspaces(spark):
    r = np.random.default_rng(1)
    frames = [np.linalg.qr(r.normal(size=(4, 2)))[0] for _ in range(60)]
    rows = [(i % 3, f.ravel().tolist()) for i, f in enumerate(frames)] + [(0, None), (1, [0.0] * 8), (2, [float("nan")] * 8)]
    got = {q.g: q for q in subspaces.mean_subspaces(spark.createDataFrame(rows, "g int, u array<double>").repartition(3), "g", "u", 2).collect()}
    for g in range(3):
        mean = np.mean([f @ f.T for f in frames[g::3]], axis=0)
        values, basis = np.linalg.eigh(mean)
        assert got[g].n == 20 and got[g].rank == 2 and np.allclose(got[g]["values"], values[::-1])
        mine = np.reshape(got[g].basis, (2, 4))
        assert np.allclose(mine.T @ mine, basis[:, -2:] @ basis[:, -2:].T)
    assert subspaces.mean_subspaces(spark.createDataFrame([], "g string, u array<double>"), "g", "u").count() == 0


def test_branches_of_a_cross(spark):
    t = np.linspace(-1, 1, 41)
    rows = [(k, float(v), 0.0, [1.0, 0.0]) for k, v in enumerate(t)] + [(k + 41, 0.0, float(v), [0.0, 2.0]) for k, v in enumerate(t)]
    got = subspaces.split_branches(spark.createDataFrame(rows, "i bigint, x0 double, x1 double, u array<double>"), ["x0", "x1"], "u", k=6).collect()
    twice = {q.origin for q in got if q.branch == 1}
    assert len({q.i for q in got}) == len(got) == 82 + len(twice) and {20, 61} <= twice
    far = {k for k, x, y, _ in rows if max(abs(x), abs(y)) > 0.5}
    assert not far & twice
    for q in got:
        if q.origin in far:
            assert np.allclose(np.abs(q.u), np.abs(np.sign(rows[q.origin][3])))
    pairs = {o: [np.array(q.u) for q in got if q.origin == o] for o in twice}
    assert all(abs(a @ b) < 1e-9 for a, b in pairs.values())


def test_segment_parameters(spark):
    # two strips of a plane, long in x, one close above the other; a few points of noise
    r = np.random.default_rng(2)
    rows = []
    for s in range(2):
        for a in range(24):
            for b in range(3):
                rows.append((len(rows), s, a + 0.1 * r.uniform(), b + 0.1 * r.uniform(), 0.05 * s))
    rows += [(900 + k, -1, 0.0, 0.0, 0.0) for k in range(20)] + [(990, 7, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame([(*q, 0.0, 0.0, 1.0) for q in rows], "i bigint, s bigint, x0 double, x1 double, x2 double, n0 double, n1 double, n2 double")
    for most in (1500, 10):
        got = {q.i: q for q in subspaces.segment_parameters(df, ["x0", "x1", "x2"], ["n0", "n1", "n2"], "s", 6, most).collect()}
        assert set(got) == {q[0] for q in rows[:144]}
        for s in range(2):
            mine = [q for q in rows if q[1] == s]
            u = np.array([got[q[0]].u for q in mine])
            assert abs(u.min() + 0.5) < 1e-9 and abs(u.max() - 0.5) < 1e-9
            assert abs(np.corrcoef(u, [q[2] for q in mine])[0, 1]) > 0.95


def test_large_segments_are_solved_in_the_order_of_places(spark, monkeypatch):
    """Ids at random: without an order almost all of a segment would meet in one dense matrix."""
    r = np.random.default_rng(5)
    t = np.linspace(0, 1, 240)
    rows = [(int(i), float(a), float(b), 0.0, 0.0, 0.0, 1.0, 1) for i, a, b in zip(r.permutation(240), t, r.uniform(size=240) * 0.05)]
    points = spark.createDataFrame(rows, "i bigint, x0 double, x1 double, x2 double, n0 double, n1 double, n2 double, s bigint")
    orders, real = [], subspaces.spectrum
    monkeypatch.setattr(subspaces, "spectrum", lambda *a, order=None, **b: orders.append(order) or real(*a, order=order, **b))
    got = {q.i: q.u for q in subspaces.segment_parameters(points, ["x0", "x1", "x2"], ["n0", "n1", "n2"], "s", k=8, most=100).collect()}
    assert len(orders) == 1 and {q.i for q in orders[0].collect()} == set(range(240))
    along = np.corrcoef([x[1] for x in rows], [got[x[0]] for x in rows])[0, 1]
    assert abs(along) > 0.9


def test_segments_of_some_thousand_points_stay_in_one_task(spark, monkeypatch):
    """Against dense numpy, and without a distributed spectrum for each segment."""
    r = np.random.default_rng(9)
    t = np.sort(r.uniform(size=1700))
    rows = [(int(i), float(a), float(b), 0.0, 0.0, 0.0, 1.0, 1) for i, a, b in zip(r.permutation(1700), t, r.uniform(size=1700) * 0.1)]
    points = spark.createDataFrame(rows, "i bigint, x0 double, x1 double, x2 double, n0 double, n1 double, n2 double, s bigint")
    monkeypatch.setattr(subspaces, "spectrum", None)
    laps, real = [], subspaces.kernels.laplacian
    monkeypatch.setattr(subspaces.kernels, "laplacian", lambda *a: laps.append(real(*a)) or laps[-1])
    got = {q.i: (q.u, q.v) for q in subspaces.segment_parameters(points, ["x0", "x1", "x2"], ["n0", "n1", "n2"], "s", k=8).collect()}
    a = np.zeros((1700, 1700))
    for q in laps[0].collect():
        a[q.i, q.j] = q.v
    y = np.linalg.eigh(a)[1][:, 1:3]
    y = (y - y.min(axis=0)) / (y.max(axis=0) - y.min(axis=0)) - 0.5
    mine = np.array([got[i] for i in range(1700)])
    for c in range(2):
        assert min(abs(mine[:, c] - y[:, c]).max(), abs(mine[:, c] + y[:, c]).max()) < 1e-6
