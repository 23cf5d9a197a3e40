"""Blocked nearest neighbours and grid joins against plain numpy, sharp edges and mesh readers on small inputs."""

import numpy as np
import pytest

from sheetwise.operators import mesh, neighbors
from sheetwise.sources import mesh_files


def plain(points, k):
    out = set()
    for i, x in enumerate(points):
        d = np.round(((points - x) ** 2).sum(axis=1), neighbors.DIGITS)
        d[i] = np.inf
        out |= {(i, int(j)) for j in np.lexsort((np.arange(len(d)), d))[:k] if np.isfinite(d[j])}
    return out


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_vectors_in_blocks(spark, shift):
    """Far from the origin a product cancels, and repeated points tie: both must come out as measured by differences."""
    rng = np.random.default_rng(7)
    points = np.concatenate([rng.normal(size=(60, 6)), np.ones((12, 6))]) + shift
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(points)], "i bigint, x array<double>")
    for block in (4096, 16):
        got = neighbors.knn_vectors(df, "x", 5, block).collect()
        assert {(r.i, r.j) for r in got} == plain(points, 5)
    assert neighbors.knn_vectors(df.limit(0), "x", 5).count() == 0
    assert neighbors.knn_vectors(df.where("i < 3"), "x", 5).count() == 6


def test_vectors_without_a_distance(spark):
    rows = [(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [float("nan"), 0.0]), (3, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "i bigint, x array<double>")
    assert {(r.i, r.j) for r in neighbors.knn_vectors(df, "x", 2).collect()} == {(0, 1), (1, 0)}


def test_grid_in_three_dimensions_with_an_outlier(spark):
    points = np.concatenate([np.random.default_rng(3).uniform(size=(80, 3)), [[40.0, -40.0, 0.0]]])
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(points)], "i bigint, x0 double, x1 double, x2 double")
    assert {(r.i, r.j) for r in neighbors.knn_edges(df, ["x0", "x1", "x2"], 4).collect()} == plain(points, 4)


def test_sharp_edges(spark):
    faces = spark.createDataFrame([(0, 0, 1, 2), (1, 1, 0, 3), (2, 1, 2, 4)], "face_id bigint, a bigint, b bigint, c bigint")
    normals = spark.createDataFrame([(0, 0.0, 0.0, 1.0), (1, 0.0, 1.0, 0.0), (2, 0.0, 0.6, 0.8)], "face_id bigint, n0 double, n1 double, n2 double")
    sharp = lambda tol: {(r.u, r.v) for r in mesh.sharp_edges(faces, normals, tol).collect()}
    assert sharp(30.0) == {(0, 1)}
    assert sharp(60.0) == {(0, 1), (1, 2)}  # 0.8 < sin 60
    assert sharp(0.0) == set()


def test_stl_words_in_any_case_and_binary_that_is_text():
    text = b"SOLID x\nFACET NORMAL 0 0 1\nOUTER LOOP\nVERTEX 0 0 0\nVERTEX 1 0 0\nVertex 0 1 0\nENDLOOP\nENDFACET\nENDSOLID\n"
    corners, normals = mesh_files.parse_stl(text)
    assert corners.shape == (1, 3, 3) and normals.tolist() == [[0.0, 0.0, 1.0]]
    corners, _ = mesh_files.parse_stl(b"# no such word first\n" + text.lower())
    assert corners.shape == (1, 3, 3)
    with pytest.raises(ValueError):
        mesh_files.parse_stl(b"solid nothing")


def test_obj_faces_before_vertices_and_normals_of_all_or_none():
    v = b"v 0 0 0\nv 1 0 0\nv 0 1 0\nv 1 1 0\nvn 0 0 2\n"
    corners, normals = mesh_files.parse_obj(b"f 1//1 2//1 4//1 3//1\n" + v)
    assert corners.shape == (2, 3, 3) and normals.tolist() == [[0.0, 0.0, 1.0]] * 2
    corners, normals = mesh_files.parse_obj(v + b"f 1//1 2//1 3//1\nf -3 -2 -1\n")
    assert corners[1].tolist() == [[1, 0, 0], [0, 1, 0], [1, 1, 0]] and normals is None
