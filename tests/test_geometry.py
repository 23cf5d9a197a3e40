"""Results against closed forms, and the edge cases of neighbour joins and files."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetwise.operators import calculus, cluster, heat, kernels, lift, mesh, neighbors, solvers
from sheetwise.sources import generators, mesh_files

X2, X3, N3 = ["x0", "x1"], ["x0", "x1", "x2"], ["n0", "n1", "n2"]


def cloud(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "i bigint, x0 double, x1 double")


def test_circle_curvature_and_distance(spark):
    p = generators.curve_points(spark, "circle", 120)
    k = lift.lift_curve(p, X2, ["u0", "u1"], 8).agg(F.min(F.abs("kappa")), F.max(F.abs("kappa"))).first()
    assert 0.9 < k[0] <= k[1] < 1.1
    w = kernels.symmetrize(kernels.weigh(neighbors.knn_edges(p, X2, 4)))
    d = {r.i: r.distance for r in heat.heat_distance(w, p, X2, 0, 1).collect()}
    assert d[0] == 0 and abs(d[60] / d[30] - 2) < 0.2
    assert all(abs(d[i] - d[120 - i]) < 0.05 * d[60] for i in range(1, 60))


def test_sphere_curvature(spark):
    p = generators.surface_points(spark, "sphere", 40, 40, "random")
    r = lift.surface_curvature(p, X3, N3, 20).agg(F.median("gauss"), F.median("mean_abs")).first()
    assert abs(r[0] - 0.25) < 0.125 and abs(r[1] - 0.5) < 0.25


@pytest.mark.parametrize("rows,k", [([], 3), ([(0, 0)], 3), ([(0, 0), (1, 0)], 5), ([(0, 0)] * 6 + [(9, 9)], 2), ([(i % 7, i // 7) for i in range(49)], 4)])
def test_knn_edges(spark, rows, k):
    got = sorted((r.i, r.j) for r in neighbors.knn_edges(cloud(spark, rows), X2, k).collect())
    want = []
    for i, a in enumerate(rows):
        near = sorted((round((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2, 9), j) for j, b in enumerate(rows) if j != i)
        want += [(i, j) for _, j in near[:k]]
    assert got == sorted(want)


def test_radius_edges(spark):
    p = cloud(spark, [(0, 0), (1, 0), (3, 0), (-1, 0)])
    assert sorted((r.i, r.j) for r in neighbors.radius_edges(p, X2, 1.0).collect()) == [(0, 1), (0, 3), (1, 0), (3, 0)]
    assert neighbors.radius_edges(p, X2, 0.0).count() == 0
    assert neighbors.chamfer(p, p, X2).first()[0] == 0
    assert neighbors.chamfer(p, p.limit(0), X2).first()[0] == math.inf


def test_zero_bandwidth_falls_back(spark):
    e = spark.createDataFrame([(0, 1, 0.0), (1, 0, 0.0), (2, 3, 4.0)], "i bigint, j bigint, d2 double")
    assert {r.i: r.h for r in kernels.local_bandwidths(e).collect()} == {0: 2.0, 1: 2.0, 2: 2.0}


def test_solvers_agree(spark):
    n = 12
    rows = [(i, i, 3.0) for i in range(n)] + [(i, j, -1.0) for i in range(n) for j in (i - 1, i + 1) if 0 <= j < n]
    a = spark.createDataFrame(rows, "i bigint, j bigint, v double")
    b = spark.createDataFrame([(i, float(i % 3)) for i in range(n)], "i bigint, value double")
    x, y = ({r.i: r.value for r in f(a, b).collect()} for f in (solvers.pcg, solvers.solve))
    assert all(abs(x[i] - y[i]) < 1e-6 for i in range(n))


def test_dbscan_and_spectral(spark):
    p = cloud(spark, [(k * 0.1, 0) for k in range(10)] + [(k * 0.1, 9) for k in range(10)] + [(50, 50)])
    label = {r.i: r.label for r in cluster.dbscan(p, X2, 0.25, 3).collect()}
    assert label[20] == -1 and {label[i] for i in range(10)} == {0} and {label[i] for i in range(10, 20)} == {10}
    assert cluster.eigengap([0.0, 0.01, 0.9, 1.0]) == 2


def test_pca_of_a_line(spark):
    p = spark.range(30).selectExpr("id as i", "cast(id as double) as x0", "2.0 * id as x1").withColumn("x1", F.col("x1").cast("double"))
    r = calculus.local_pca(neighbors.knn_edges(p, X2, 4), p, X2).first()
    assert abs(r["values"][0]) < 1e-9 and abs(abs(r["largest"][1] / r["largest"][0]) - 2) < 1e-6


CUBE = "v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nv 0 0 1\nv 1 0 1\nv 1 1 1\nv 0 1 1\nf 1 4 3 2\nf 5 6 7 8\nf 1 2 6 5\nf 2 3 7 6\nf 3 4 8 7\nf -5 -8 -4 -1\n"


def test_mesh_files(spark, tmp_path):
    (tmp_path / "cube.obj").write_text(CUBE)
    t = mesh_files.read_triangles(spark, f"file://{tmp_path}/cube.obj")
    g = mesh.face_geometry(t).collect()
    assert len(g) == 12 and abs(sum(r.area for r in g) - 6) < 1e-9
    corners = np.array([[[r[f"{v}{k}"] for k in range(3)] for v in "abc"] for r in t.orderBy("face_id").collect()])
    (tmp_path / "cube.stl").write_bytes(mesh_files.stl_bytes(corners))
    again = mesh_files.read_triangles(spark, f"file://{tmp_path}/cube.stl").orderBy("face_id").collect()
    assert [r.a0 for r in again] == [c[0][0] for c in corners]
    s = mesh.sample_faces(t, 240).collect()
    assert sorted(r.i for r in s) == list(range(240))
    assert all(any(abs(r[f"p{k}"] - e) < 1e-9 for k in range(3) for e in (0, 1)) for r in s)


def test_point_files(spark, tmp_path):
    np.savez(tmp_path / "c.npz", points=np.arange(6.0).reshape(2, 3), normals=np.eye(3)[:2])
    r = mesh_files.read_npz(spark, f"file://{tmp_path}/c.npz").orderBy("i").collect()
    assert (r[1].x2, r[1].n1, r[0].u0) == (5.0, 1.0, None)
    p = spark.createDataFrame([(0, 0.5, 1.0, 2.0), (1, 3.0, 4.0, 5.0)], "i bigint, x0 double, x1 double, x2 double")
    mesh_files.write_ply(p, f"file://{tmp_path}/ply")
    back = mesh_files.read_ply(spark, f"file://{tmp_path}/ply/part*.txt").orderBy("i").collect()
    assert [(x.x0, x.x1, x.x2) for x in back] == [(0.5, 1.0, 2.0), (3.0, 4.0, 5.0)]
    (tmp_path / "t.ts").write_text("GOCAD\nVRTX 1 0 0 0\nPVRTX 2 1 0 0 7\nVRTX 3 0 1 0\nTRGL 1 2 3\n")
    v, f = mesh_files.read_tsurf(spark, f"file://{tmp_path}/t.ts")
    assert mesh.face_geometry(mesh.soup(v, f)).first().area == 0.5


def test_large_spectrum(spark):
    """Three weakly tied groups of 700 points, each a ring with random chords, against the dense spectrum."""
    import numpy as np
    import pytest

    r, n = np.random.default_rng(3), 2100
    group = np.arange(n) // 700
    a = np.zeros((n, n))
    for _ in range(4):
        to = np.concatenate([r.permutation(700) + 700 * g for g in range(3)])
        a[np.arange(n), to] = 1
    for k in range(4):
        a[700 * (k % 3) + k, (700 * (k % 3 + 1) + k) % n] = 1
    a = np.maximum(a, a.T)
    np.fill_diagonal(a, 0)
    d = a.sum(axis=1)
    a = np.eye(n) - a / np.sqrt(np.outer(d, d))
    i, j = np.nonzero(a)
    edges = spark.createDataFrame([(int(x), int(y), float(a[x, y])) for x, y in zip(i, j)], "i bigint, j bigint, v double")
    w, q = np.linalg.eigh(a)
    y, values = solvers.bottom_spectrum(edges, 3)
    got = np.array([x.y for x in sorted(y.collect())])
    assert np.abs(np.array(values) - w[:3]).max() < 1e-9
    assert np.linalg.norm(q[:, :3] @ (q[:, :3].T @ got) - got) < 1e-5 and np.abs(got.T @ got - np.eye(3)).max() < 1e-9
    with pytest.raises(RuntimeError):
        solvers.bottom_spectrum(edges, 3, rounds=1)
