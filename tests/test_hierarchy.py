"""Hierarchical clustering against a plain version: Prim's tree over all pairs and recursive condensing."""

import numpy as np

from sheetwise.operators import hierarchy, pivots


def plain_tree(x, samples):
    n = len(x)
    d = np.round(np.sqrt(np.round(((x[:, None] - x[None]) ** 2).sum(axis=2), 12)), 9)
    core = np.sort(d, axis=1)[:, samples - 1]
    m = np.round(np.maximum(d, np.maximum(core[:, None], core[None])), 9)
    inside, out = {0}, []
    while len(inside) < n:
        out.append(min((m[i, j], min(i, j), max(i, j)) for i in inside for j in range(n) if j not in inside))
        inside |= {out[-1][1], out[-1][2]}
    return out


def plain_labels(tree, n, least):
    """Clusters by splitting: remove the longest edge of each part, again and again."""

    def split(nodes, edges):
        w, a, b = max(edges)
        rest, side, todo = [e for e in edges if e != (w, a, b)], {a}, [a]
        while todo:
            v = todo.pop()
            for _, p, q in rest:
                for s, t in ((p, q), (q, p)):
                    if s == v and t not in side:
                        side.add(t)
                        todo.append(t)
        parts = [side, nodes - side]
        return w, [(p, [e for e in rest if e[1] in p]) for p in parts]

    def grow(nodes, edges, born):
        """(stability, clusters chosen below or this one) of a cluster."""
        stable, here = 0.0, nodes
        while edges:
            w, parts = split(here, edges)
            now = 1 / max(w, 1e-12)
            large = [p for p in parts if len(p[0]) >= least]
            if len(large) == 2:
                stable += (now - born) * len(here)
                below = [grow(*p, now) for p in parts]
                total = sum(s for s, _ in below)
                return (stable, [nodes]) if stable >= total else (total, [c for _, cs in below for c in cs])
            stable += (now - born) * sum(len(p[0]) for p in parts if len(p[0]) < least)
            if not large:
                break
            here, edges = large[0]
        return stable, [nodes]

    nodes, edges = set(range(n)), tree
    while True:  # the root is no cluster: lesser parts drop out until it splits
        if not edges:
            return [-1] * n
        w, parts = split(nodes, edges)
        large = [p for p in parts if len(p[0]) >= least]
        if len(large) == 2:
            found = [c for p in parts for c in grow(*p, 1 / max(w, 1e-12))[1]]
            break
        if not large:
            return [-1] * n
        nodes, edges = large[0]
    out = [-1] * n
    for c in found:
        for i in c:
            out[i] = min(c)
    return out


def test_tree_and_labels(spark):
    r = np.random.default_rng(6)
    centres = r.normal(size=(5, 4)) * 4
    x = np.concatenate([c + r.normal(size=(24, 4)) * s for c, s in zip(centres, (0.2, 0.3, 0.5, 0.2, 1.0))] + [r.normal(size=(20, 4)) * 6, np.tile(centres[0], (6, 1))])
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(900, None), (901, [float("nan")] * 4)], "i bigint, x array<double>")
    tree = plain_tree(x, 4)
    index = pivots.build(df, "x", block=30, crowded=60)
    got = sorted((round(e.length, 9), e.a, e.b) for e in hierarchy.spanning_tree(df, "x", 4, index).collect())
    assert len(got) == len(x) - 1 and np.allclose([e[0] for e in got], [e[0] for e in sorted(tree)])
    assert len(set(e[1:] for e in got) - set(e[1:] for e in tree)) <= 1  # rounding may swap a tie
    labels = {q.i: q.label for q in hierarchy.hdbscan(df, "x", 8, 4, index).collect()}
    assert labels.pop(900) == labels.pop(901) == -1
    assert [labels[i] for i in range(len(x))] == plain_labels(got, len(x), 8)
    assert len(set(labels.values())) > 4


def test_small_and_empty(spark):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(4)], "i bigint, x array<double>")
    assert {q.label for q in hierarchy.hdbscan(df, "x", 5).collect()} == {-1}
    assert hierarchy.hdbscan(df.limit(0), "x", 5).count() == 0
    assert hierarchy.hdbscan(df.limit(1), "x", 5).count() == 1


def test_copies_look_once_and_not_everywhere(spark, monkeypatch):
    r = np.random.default_rng(8)
    places = np.round(r.normal(size=(60, 2)), 2)
    x = np.repeat(places, 20, axis=0)[r.permutation(1200)]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "i bigint, x array<double>")
    asked, looked = [], hierarchy._asked

    def counted(index, asking, rows, *more):
        asked.append((rows.select("c").distinct().count(), rows.count(), asking.count()))
        return looked(index, asking, rows, *more)

    monkeypatch.setattr(hierarchy, "_asked", counted)
    got = sorted((e.length, e.a, e.b) for e in hierarchy.spanning_tree(df, "x", 8, pivots.build(df, "x", block=100)).collect())
    # Kruskal over all pairs, in order of length and both ids
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    a, b = np.triu_indices(len(x), 1)
    top, plain = list(range(len(x))), []

    def root(v):
        while top[v] != v:
            top[v] = v = top[top[v]]
        return v

    for k in np.lexsort((b, a, np.round(d[a, b], 9))).tolist():
        p, q = root(int(a[k])), root(int(b[k]))
        if p != q:
            top[p] = q
            plain.append((round(float(d[a[k], b[k]]), 9), int(a[k]), int(b[k])))
    assert [e[1:] for e in got] == [e[1:] for e in plain] and np.allclose([e[0] for e in got], [e[0] for e in plain], atol=2e-9)
    assert all(rows <= 60 for parts, rows, _ in asked if parts <= 60) and asked[-1][0] <= 60
