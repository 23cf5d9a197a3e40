"""Iterated lifts, row rewrites and splines against closed forms."""

import math

import numpy as np
from pyspark.sql import functions as F

from sheetwise.operators import geodesics, levels, reconstruct, rewrites
from sheetwise.sources import generators


def test_lifted_circle(spark):
    p = generators.curve_points(spark, "circle", 60).select("i", F.array("x0", "x1").alias("e"), F.array("u0", "u1").alias("u"))
    one, two = levels.iterate(p, 1, 2, k=6)[1:]
    r = levels.invariants(one, 1).agg(F.min("mean"), F.max("mean"), F.min("total"), F.max("total")).first()
    assert all(0.9 < v < 1.1 for v in r)
    assert len(two.first().e) == 42


def test_rewrites(spark):
    p = generators.curve_points(spark, "circle", 40)
    spun = rewrites.rotate(p.withColumn("x2", F.lit(0.0)), ["x0", "x1", "x2"], [0, 0, 1], math.pi / 2).where("i = 0").first()
    assert abs(spun.x0) < 1e-12 and abs(spun.x1 - 1) < 1e-12
    bad = spark.createDataFrame([(0, 1.0, 0.0, 2.0), (1, float("nan"), 1.0, 0.0), (2, 0.0, 0.0, 0.0), (3, None, 1.0, 0.0)], "i bigint, x0 double, n0 double, n1 double")
    assert [(r.i, r.n1) for r in rewrites.finite(bad, ["x0"], ["n0", "n1"]).collect()] == [(0, 1.0)]
    f = rewrites.flip(p, [["u0", "u1"], ["x0"]], 0.5, 3, coupled=True).join(p.selectExpr("i", "u0 as v0", "x0 as y0"), "i").where("v0 * y0 <> 0").selectExpr("u0 / v0 as a", "x0 / y0 as b").collect()
    assert all(r.a == r.b for r in f) and {r.a for r in f} == {1.0, -1.0}
    assert rewrites.jitter(p, ["x0"], 0.1).join(p.selectExpr("i", "x0 as y"), "i").where("abs(x0 - y) > 0.1").count() == 0
    assert rewrites.downsample(p, 7).count() == 7 and rewrites.closest(p, "t", 0.1).count() == 4
    d = rewrites.distance_fields(p, ["x0", "x1"], ["u0", "u1"], 0).where("i = 20").first()
    assert abs(d.euclid - 2) < 1e-9 and abs(d["product"] - 2) < 1e-9
    assert [r.bound for r in rewrites.level_bounds(p, "i", 2).orderBy("level").collect()] == [0.0, 19.5, 39.0]


def test_spline(spark):
    s = reconstruct.fit_spline(generators.curve_points(spark, "helix", 80), ["x0", "x1", "x2"])
    got = reconstruct.evaluate(spark, s, 200).collect()
    assert all(abs(r.x0**2 + r.x1**2 - 1) < 1e-2 for r in got) and abs(got[0].x2) < 1e-9


def test_long_spline(spark):
    """A curve with a kink at every point: the spline passes through all of them and ends at the last."""
    n, x = 5003, ["x0", "x1"]
    rows = [(i, float(i), float(i * i % 7)) for i in range(n)]
    points = spark.createDataFrame(rows, "i bigint, x0 double, x1 double")
    s = reconstruct.fit_spline(points, x)
    at = np.array([r.s for r in reconstruct.chord_length(points, x).orderBy("i").collect()])
    first, b = reconstruct.basis(s.knots, s.degree, at)
    got = sum(b[:, k, None] * s.controls[first + k] for k in range(s.degree + 1))
    assert len(s.controls) == n and np.abs(got - np.array([r[1:] for r in rows])).max() < 1e-6
    last = reconstruct.evaluate(spark, s, 2).where("i = 1").first()
    assert abs(last.x0 - (n - 1)) < 1e-6 and abs(last.x1 - (n - 1) ** 2 % 7) < 1e-6


def test_principal_curvatures_of_a_torus(spark):
    """Around the tube 1 everywhere, around the axis cos a / (2 + cos a), the first one along the tube."""
    import pytest

    k = np.arange(1600)
    a, b = 2 * np.pi * (k % 40) / 40, 2 * np.pi * (k // 40) / 40 + 0.05 * (k % 40)
    n = np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], axis=1)
    x = n + 2 * np.stack([np.cos(b), np.sin(b), 0 * b], axis=1)
    names = ["x0", "x1", "x2", "n0", "n1", "n2"]
    points = spark.createDataFrame([(i, *map(float, p), *map(float, q)) for i, (p, q) in enumerate(zip(x, n))], "i bigint, " + ", ".join(f"{c} double" for c in names))
    base = geodesics.from_normals(points, names[:3], names[3:]).rows
    got = {r.i: r for r in levels.principal_curvatures(base, levels.lift(base, 2, 12)).collect()}
    gauss = np.cos(a) / (2 + np.cos(a))
    assert np.corrcoef([got[i].gauss for i in k], gauss)[0, 1] > 0.97
    sizes = np.array([np.abs(got[i].principal) for i in k])
    assert np.median(np.abs(sizes.max(axis=1) - 1)) < 0.1
    along = np.stack([-np.sin(a) * np.cos(b), -np.sin(a) * np.sin(b), np.cos(a)], axis=1)
    steep = [np.reshape(got[i].directions, (2, 3))[np.abs(got[i].principal).argmax()] for i in k]
    assert np.median(np.abs((np.array(steep) * along).sum(axis=1))) > 0.98
    line = generators.curve_points(spark, "helix", 40).select("i", F.array("x0", "x1", "x2").alias("e"), F.array("u0", "u1", "u2").alias("u"))
    with pytest.raises(Exception, match="hypersurface"):
        levels.principal_curvatures(line, levels.lift(line, 1, 5)).collect()


def test_regress_of_many_points():
    """Points by an axis in front come out as one by one, those whose neighbours are all copies too."""
    rng = np.random.default_rng(4)
    t, c, w = rng.normal(size=(6, 9, 2)), rng.normal(size=(6, 9, 3, 2)), rng.uniform(size=(6, 9))
    t[2] = 0
    many = levels.regress(t, c, w, 0.1)
    assert many.shape == (6, 3, 2, 2) and not many[2].any()
    for k in range(6):
        assert np.allclose(many[k], levels.regress(t[k], c[k], w[k], 0.1), atol=1e-12)
        s = np.einsum("n,na,nb->ab", w[k], t[k], t[k])
        s = s + (0.1 * np.trace(s) / 2 or 1e-12) * np.eye(2)
        r = np.einsum("n,na,npb->pab", w[k], t[k], c[k])
        assert all(np.allclose(s @ b + b @ s, m + m.T, atol=1e-9) for b, m in zip(many[k], r))
