"""Meshes as tables: vertices (vertex_id, x0..x2), faces (face_id, a, b, c), triangle soups (face_id, corner coordinates)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sheetwise.functions import vectors as V

CORNERS = [f"{v}{k}" for v in "abc" for k in range(3)]


def soup(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(face_id, a0..a2, b0..b2, c0..c2) by three joins on vertex ids."""
    out = faces
    for v in "abc":
        out = out.join(vertices.select(F.col("vertex_id").alias(v), *[F.col(f"x{k}").alias(f"{v}{k}") for k in range(3)]), v)
    return out.select("face_id", *CORNERS)


def face_geometry(triangles: DataFrame, eps: float = 1e-12) -> DataFrame:
    """Triangles with area and unit normal n0..n2; degenerate ones are dropped."""
    a, b, c = (V.columns(v, 3) for v in "abc")
    m = V.cross(V.minus(b, a), V.minus(c, a))
    out = triangles.select("*", *[F.expr(t).alias(f"m{k}") for k, t in enumerate(m)]).withColumn("len", F.expr(V.norm(V.columns("m", 3))))
    return out.where(F.col("len") > eps).select("face_id", *CORNERS, (F.col("len") / 2).alias("area"), *[(F.col(f"m{k}") / F.col("len")).alias(f"n{k}") for k in range(3)])


def merge_vertices(points: DataFrame, tol: float) -> DataFrame:
    """(k0, k1, k2, n, x0..x2): points that round to the same cell, merged into their mean; rounding is half to even."""
    keys = [F.bround(F.col(f"x{k}") / tol, 0).cast("bigint").alias(f"k{k}") for k in range(3)]
    return points.select(*keys, "x0", "x1", "x2").groupBy("k0", "k1", "k2").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"x{k}").alias(f"x{k}") for k in range(3)])


def unique_vertices(points: DataFrame, tol: float) -> DataFrame:
    """(i, vertex): for each point the least id among those that round to its cell, which stands for them."""
    cells = points.select("i", *[F.rint(F.col(f"x{k}") / F.lit(tol)).cast("long").alias(f"k{k}") for k in range(3)])
    least = cells.groupBy("k0", "k1", "k2").agg(F.min("i").alias("vertex"))
    return cells.join(least, ["k0", "k1", "k2"]).select("i", "vertex")


def sample_faces(triangles: DataFrame, n: int) -> DataFrame:
    """(i, face_id, p0..p2, n0..n2): n points spread by area, the i-th at share (i + 1/2) / n of the running area.

    The running total is a window over faces; samples meet their face by a range join on
    whole sample numbers, exploded per face, so no pair of sample and face is tried in vain.
    """
    f = face_geometry(triangles)
    total = f.agg(F.sum("area").alias("total"))
    w = W.orderBy("face_id").rowsBetween(W.unboundedPreceding, 0)
    # the running area is one number a face, ordered by id
    run = f.withColumn("hi", F.sum("area").over(w)).crossJoin(F.broadcast(total))
    first = F.ceil((F.col("hi") - F.col("area")) / F.col("total") * n - 0.5)
    last = F.ceil(F.col("hi") / F.col("total") * n - 0.5) - 1
    each = run.withColumn("lo", first).withColumn("up", last).where("lo <= up and lo < %d" % n)
    each = each.withColumn("i", F.explode(F.sequence(F.col("lo"), F.least(F.col("up"), F.lit(n - 1)))))
    s, r = "sqrt(i * 0.6180339887498949 - floor(i * 0.6180339887498949))", "(i * 0.7548776662466927 - floor(i * 0.7548776662466927))"
    p = [F.expr(f"(1 - {s}) * a{k} + {s} * (1 - {r}) * b{k} + {s} * {r} * c{k}").alias(f"p{k}") for k in range(3)]
    return each.select("i", "face_id", *p, "n0", "n1", "n2")


def sharp_edges(faces: DataFrame, geometry: DataFrame, tolerance_deg: float = 30.0) -> DataFrame:
    """(u, v, n_faces): edges with two faces that meet at a right angle, or within the tolerance of one; normals of either sign count alike, a tolerance of 0 or less gives none."""
    sides = F.explode(F.array(*[F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))]))
    e = faces.select("face_id", sides.alias("e")).select("face_id", "e.u", "e.v").join(geometry.select("face_id", "n0", "n1", "n2"), "face_id")
    # one normal against the extremes: edges of a surface have few faces
    pair = e.alias("l").join(e.alias("r"), (F.col("l.u") == F.col("r.u")) & (F.col("l.v") == F.col("r.v")) & (F.col("l.face_id") < F.col("r.face_id")))
    cosine = F.abs(F.expr(V.dot(V.columns("n", 3, "l"), V.columns("n", 3, "r"))))
    from math import radians, sin

    hits = pair.where(cosine <= sin(radians(min(tolerance_deg, 90.0))) if tolerance_deg > 0 else F.lit(False)).select(F.col("l.u").alias("u"), F.col("l.v").alias("v")).distinct()
    return e.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n_faces")).join(hits, ["u", "v"])


def merge_meshes(meshes: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """One (vertices, faces) of several; ids are shifted past those before."""
    vertices = faces = None
    dv = df = 0
    for v, f in meshes:
        top_v, top_f = v.agg(F.max("vertex_id")).first()[0], f.agg(F.max("face_id")).first()[0]
        v = v.withColumn("vertex_id", F.col("vertex_id") + dv)
        f = f.withColumn("face_id", F.col("face_id") + df).withColumns({c: F.col(c) + dv for c in "abc"})
        vertices, faces = (v, f) if vertices is None else (vertices.unionByName(v), faces.unionByName(f))
        dv, df = dv + (-1 if top_v is None else top_v) + 1, df + (-1 if top_f is None else top_f) + 1
    return vertices, faces


def silhouette(grid: DataFrame, view: tuple[float, float, float]) -> DataFrame:
    """(iu, iv, axis, x0..x2): points on the edges of a grid (iu, iv, x0..x2, n0..n2) where the normal turns across the view.

    Neighbours in a row or column are adjacent rows of a window, so nothing is joined.
    """
    facing = " + ".join(f"n{k} * {float(c)!r}" for k, c in enumerate(view))
    g = grid.withColumn("f", F.expr(f"cast({facing} as double)"))
    out = None
    for axis, along, across in (("u", "iu", "iv"), ("v", "iv", "iu")):
        w = W.partitionBy(across).orderBy(along)
        nxt = g.select("iu", "iv", "x0", "x1", "x2", "f", F.lead(along).over(w).alias("_at"), F.lead("f").over(w).alias("_f"), *[F.lead(f"x{k}").over(w).alias(f"_x{k}") for k in range(3)])
        hit = nxt.where((F.col("_at") == F.col(along) + 1) & (F.col("f") * F.col("_f") < 0)).withColumn("s", F.col("f") / (F.col("f") - F.col("_f")))
        part = hit.select("iu", "iv", F.lit(axis).alias("axis"), *[(F.col(f"x{k}") + F.col("s") * (F.col(f"_x{k}") - F.col(f"x{k}"))).alias(f"x{k}") for k in range(3)])
        out = part if out is None else out.unionByName(part)
    return out


def image_plane(df: DataFrame, view: tuple[float, float, float]) -> DataFrame:
    """(.., p, q): coordinates in the plane across the view."""
    from math import sqrt

    n = sqrt(sum(c * c for c in view))
    v = [c / n for c in view]
    axis = min(range(3), key=lambda k: abs(v[k]))
    seed = [1.0 if k == axis else 0.0 for k in range(3)]
    e1 = [v[1] * seed[2] - v[2] * seed[1], v[2] * seed[0] - v[0] * seed[2], v[0] * seed[1] - v[1] * seed[0]]
    m = sqrt(sum(c * c for c in e1))
    e1 = [c / m for c in e1]
    e2 = [v[1] * e1[2] - v[2] * e1[1], v[2] * e1[0] - v[0] * e1[2], v[0] * e1[1] - v[1] * e1[0]]
    at = lambda e: sum((F.col(f"x{k}") * e[k] for k in range(3)), F.lit(0.0))
    return df.withColumns({"p": at(e1), "q": at(e2)})
