"""Silhouettes, blades and implicit surfaces."""

import math

import numpy as np
from pyspark.sql import functions as F

from sheetwise.operators import frames, implicit, mesh
from sheetwise.sources import generators


def test_silhouette_of_a_sphere(spark):
    p = generators.surface_points(spark, "sphere", 16, 9).withColumns({"iu": F.floor(F.col("i") / 9), "iv": F.col("i") % 9})
    s = mesh.image_plane(mesh.silhouette(p, (0.0, 0.0, 1.0)), (0.0, 0.0, 1.0)).collect()
    assert len(s) >= 16 and all(abs(r.x2) < 0.2 for r in s)
    assert all(abs(r.p**2 + r.q**2 - r.x0**2 - r.x1**2) < 1e-9 for r in s)


def test_blades():
    assert frames.perm_sign((1, 0, 2)) == -1 and frames.perm_sign((1, 2, 0)) == 1
    assert frames.hodge_pairs(3, 2) == {(0, 1): ((2,), 1), (0, 2): ((1,), -1), (1, 2): ((0,), 1)}
    assert set(frames.blade(["1", "0", "0"], ["0", "1", "0"])) == {(0, 1), (0, 2), (1, 2)}


def test_implicit_circle(spark):
    p = generators.curve_points(spark, "circle", 200).withColumns({"n0": F.col("x0"), "n1": F.col("x1")})
    field = implicit.fit(p, ["x0", "x1"], ["n0", "n1"])
    near = p.withColumns({"x0": F.col("x0") * 1.1, "x1": F.col("x1") * 1.1})
    r = implicit.project(near, ["x0", "x1"], field).collect()
    assert max(q.residual for q in r) < 0.01
    assert all(abs((q.x0**2 + q.x1**2) ** 0.5 - 1) < 0.1 for q in r)


def test_training_on_all_rows(spark):
    p = spark.range(600).selectExpr("id as i", f"cos(id * {2 * math.pi / 600}) as x0", f"sin(id * {2 * math.pi / 600}) as x1").selectExpr("i", "x0", "x1", "x0 as n0", "x1 as n1")
    field = implicit.fit(p, ["x0", "x1"], ["n0", "n1"], epochs=900, sample=None, rounds=6)
    ring = np.array([(math.cos(t), math.sin(t)) for t in np.linspace(0, 6, 50)])
    assert np.abs(field.value(ring)).max() < 0.1
