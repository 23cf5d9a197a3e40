"""Meshes put together, directions with noise, soft partitions, source numbers and folders of meshes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetwise.operators import heat, mesh, rewrites, selections
from sheetwise.sources import cloud_files

TRIANGLE = "v 0 0 {z}\nv 1 0 {z}\nv 0 1 {z}\nf 1 2 3\n"


def test_merge_meshes(spark):
    v = spark.createDataFrame([(0, 0.0), (2, 1.0), (5, 2.0)], "vertex_id bigint, x0 double")
    f = spark.createDataFrame([(1, 0, 2, 5)], "face_id bigint, a bigint, b bigint, c bigint")
    vertices, faces = mesh.merge_meshes([(v, f), (v.limit(0), f.limit(0)), (v, f)])
    assert sorted(r.vertex_id for r in vertices.collect()) == [0, 2, 5, 6, 8, 11]
    assert sorted(tuple(r) for r in faces.collect()) == [(1, 0, 2, 5), (3, 6, 8, 11)]


def test_direction_noise(spark):
    p = spark.range(500).selectExpr("id as i", "1.0D as u0", "0.0D as u1")
    made = rewrites.direction_noise(p, ["u0", "u1"], 0.1, 3)
    got = made.collect()
    assert all(abs(math.hypot(r.u0, r.u1) - 1) < 1e-12 for r in got) and 0.05 < np.std([r.u1 for r in got]) < 0.2
    assert got == rewrites.direction_noise(p, ["u0", "u1"], 0.1, 3).collect()
    loose = rewrites.direction_noise(p, ["u0", "u1"], 0.1, 3, renormalize=False).collect()
    assert any(abs(math.hypot(r.u0, r.u1) - 1) > 1e-3 for r in loose)


def test_soft_partition(spark):
    a = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 3.0)], "i bigint, distance double")
    share = {r.i: r.share for r in heat.soft_partition(a, a.select("i", (3 - F.col("distance")).alias("distance")), 0.5).collect()}
    assert all(abs(share[i] - 1 / (1 + math.exp((2 * d - 3) / 0.5))) < 1e-12 for i, d in ((0, 0.0), (1, 1.0), (2, 3.0)))


def test_source_numbers():
    assert selections.resolve_sources(-1, 5) == [4] and selections.resolve_sources([0, -5, 2], 5) == [0, 2]
    for bad in ([], 5, [-6]):
        with pytest.raises(ValueError):
            selections.resolve_sources(bad, 5)


def test_folders_of_meshes(spark, tmp_path):
    for folder, z in (("a", 1), ("b", 2)):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "m.obj").write_text(TRIANGLE.format(z=z))
    (tmp_path / "in" / "m.obj").write_text(TRIANGLE.format(z=3))
    (tmp_path / "in" / "bad.stl").write_text("solid nothing")
    (tmp_path / "out").mkdir()
    done = {r.path.rsplit("/in/", 1)[1]: (r.status, r.rows) for r in cloud_files.batch_convert(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", 20).collect()}
    assert {k: v for k, v in done.items() if k.endswith("obj")} == dict.fromkeys(["a/m.obj", "b/m.obj", "m.obj"], ("done", 20))
    assert done["bad.stl"][0].startswith("failed")
    found = sorted(r.path.rsplit("/", 1)[1] for r in cloud_files.find_clouds(spark, f"file://{tmp_path}/out").collect())
    assert found == ["a__m.obj.npz", "b__m.obj.npz", "m.obj.npz"]
    for name, z in (("a__m", 1), ("b__m", 2), ("m", 3)):
        points = np.load(tmp_path / "out" / f"{name}.obj.npz")["points"]
        assert points.shape == (20, 3) and np.allclose(points[:, 2], z)
