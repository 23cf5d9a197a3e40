"""Whitening against plain numpy on the whole table, and the rows that its docstring defines."""

import math

import numpy as np

from sheetwise.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component int, v string"


def table(spark, vectors, ids=None):
    rows = [(i, v, 0, -1, -1, "x") for i, v in zip(ids or range(len(vectors)), vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def run(spark, vectors, ids=None):
    df = table(spark, vectors, ids)
    return whitening.whiten(df, whitening.fit(df)).collect()


def test_against_numpy(spark):
    r = np.random.default_rng(1)
    data = (r.normal(size=(300, 12)) @ r.normal(size=(12, 12)) / 5).astype(np.float32).tolist()
    odd = [None, [None] + [1.0] * 11, [math.nan] * 12, [math.inf] + [0.0] * 11, [], [1.0] * 5]
    vectors = data + odd + data[:40]
    ids = list(range(len(data))) + [900 + k for k in range(len(odd))] + [None] * 20 + list(range(20))
    got = run(spark, vectors, ids)
    fitted = [(i, v) for i, v in zip(ids, vectors) if v and len(v) == 12 and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in fitted], dtype=object)
    n, s = len(x), x.sum(axis=0)
    y = ((n * x - s) / n).astype(float)
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    white = y @ u[:, :8] / np.sqrt(e[:8])
    assert len(got) == 8 * n and all(q.n == n and q.identity_error < 1e-9 for q in got)
    for q in got:
        assert math.isclose(q.explained, e[q.component - 1] / e.sum(), rel_tol=1e-9)
    for k in range(8):
        mine = sorted([(repr(q.vec_id), q.deviation, q.whitened) for q in got if q.component == k + 1])
        want = sorted([(repr(i), int(((n * a - s) ** 2).sum()), w) for (i, _), a, w in zip(fitted, x, white[:, k])])
        assert [m[:2] for m in mine] == [w[:2] for w in want]
        sign = np.sign(sum(m[2] * w[2] for m, w in zip(mine, want)))
        assert all(abs(m[2] - sign * w[2]) < 1e-8 for m, w in zip(mine, want))


def test_few_rows_few_dimensions_and_none(spark):
    assert run(spark, []) == [] and run(spark, [None, []]) == []
    (a, b) = sorted(run(spark, [[0.5, -1.0]]), key=lambda q: q.component)
    assert (a.n, a.deviation, a.whitened, a.explained, a.identity_error) == (1, 0, None, None, None) and b.component == 2
    same = run(spark, [[1.0, 2.0, 3.0]] * 5)
    assert len(same) == 15 and all(q.whitened is None and q.deviation == 0 for q in same)
    flat = run(spark, [[float(k), 2.0, float(k)] for k in range(6)])
    one = [q for q in flat if q.component == 1]
    assert all(abs(abs(q.whitened) - abs(q.vec_id - 2.5) / math.sqrt(35 / 12)) < 1e-9 and math.isclose(q.explained, 1) for q in one)
    assert all(q.whitened is None for q in flat if q.component > 1) and one[0].identity_error < 1e-9


def test_long_numbers_stay_exact(spark):
    vectors = [[1e9, 0.0], [-1e9, 1.0], [2e9, 5.0], [3e38, -3e38]]
    got = {q.vec_id: q for q in run(spark, vectors[:3]) if q.component == 1}
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors[:3]]
    s = [sum(v) for v in zip(*x)]
    for k, v in enumerate(x):
        want = sum((3 * a - t) ** 2 for a, t in zip(v, s))
        assert got[k].deviation == (want if want < 2**63 else None)
    assert all(q.deviation is None and math.isfinite(q.whitened) for q in run(spark, vectors) if q.component == 1)
