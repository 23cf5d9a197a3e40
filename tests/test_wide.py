"""Wide vectors without structure: blocks stand together, and bounds drop what is farther inside of a task."""

import numpy as np

from sheetwise.operators import hierarchy, pivots


def _cloud(spark, seed, n, dim, copies=0):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    x = np.concatenate([x, np.repeat(x[:1], copies, axis=0)])
    return x, spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "i bigint, x array<double>")


def test_bounds_leave_out_farther_rows():
    x = np.random.default_rng(1).normal(size=(300, 8))
    ids = np.arange(300)
    d = np.round(((x[:20, None] - x) ** 2).sum(axis=2), 9)
    most = np.sort(d, axis=1)[:, 3]
    at, to, found = pivots.nearest(ids[:20], x[:20], ids, x, 10, True, most)
    assert sorted(zip(at.tolist(), to.tolist())) == sorted(zip(*(v.tolist() for v in np.nonzero(d <= most[:, None]))))


def test_blocks_stand_together_for_wide_vectors(spark, monkeypatch):
    asked = []
    met = pivots._met
    monkeypatch.setattr(pivots, "_met", lambda index, queries, work, together=1, most=None: asked.append((together, queries)) or met(index, queries, work, together, most))
    x, points = _cloud(spark, 2, 400, 24, copies=30)
    index = pivots.build(points, "x", block=16)
    got = {(r.i, r.j): r["rank"] for r in pivots.knn(points, "x", 5, index=index).collect()}
    d = np.round(((x[:, None] - x) ** 2).sum(axis=2), 9)
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)): r + 1 for i in range(len(x)) for r, j in enumerate(np.lexsort((np.arange(len(x)), d[i]))[:5])}
    assert got == want
    together, queries = asked[-1]
    # each query goes to a place of WIDE blocks once, not to each of them
    assert together == pivots.WIDE and queries.count() <= len(x) * -(-index.blocks // pivots.WIDE)


def test_tree_of_wide_vectors(spark, monkeypatch):
    x, points = _cloud(spark, 3, 300, 16, copies=5)
    monkeypatch.setattr(hierarchy, "LIST", 4)
    asked = []
    monkeypatch.setattr(pivots, "together", lambda blocks, queries, sent, f=pivots.together: asked.append(f(blocks, queries, sent)) or asked[-1])
    tree = hierarchy.spanning_tree(points, "x", 4, pivots.build(points, "x", block=16)).collect()
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, 3]
    reach = np.round(np.maximum(d, np.maximum(core[:, None], core)), 9)
    edges = sorted((reach[a, b], a, b) for a in range(len(x)) for b in range(a + 1, len(x)))
    top = list(range(len(x)))

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    want = set()
    for _, a, b in edges:
        if root(a) != root(b):
            top[root(a)] = root(b)
            want.add((a, b))
    assert {(r.a, r.b) for r in tree} == want
    assert pivots.WIDE in asked[1:]


def test_few_queries_meet_a_crowded_block_at_once(spark, monkeypatch):
    monkeypatch.setattr(pivots, "PAIRS", 1000)
    most = []
    tasks = pivots._tasks
    monkeypatch.setattr(pivots, "_tasks", lambda q, p, run, schema, limit=None: most.append(limit) or tasks(q, p, run, schema, limit))
    x, points = _cloud(spark, 4, 50, 2, copies=150)
    index = pivots.build(points, "x")
    got = {(r.i, r.j) for r in pivots.radius(points, "x", 0.5, index=index).collect()}
    d = ((x[:, None] - x) ** 2).sum(axis=2)
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= 0.25)) if i != j}
    assert (most[0] * index.sizes <= 1000).all()
