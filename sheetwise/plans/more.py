"""Queries over scenes, product metrics, curvature in closed form, selections and files, with the SQL of the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from math import pi

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.functions import vectors as V
from sheetwise.functions.symbolic import num
from sheetwise.operators import blowup, curvature, frames, kernels, mesh, neighbors, selections
from sheetwise.plans.lineage import shared_dir
from sheetwise.sources import cloud_files, mesh_files, scenes
from sheetwise.sources import generators as G
from sheetwise.sources.catalogue import curves, surfaces

Query = Callable[[SparkSession, str], DataFrame]
X2, U2, X3, N3 = V.columns("x", 2), V.columns("u", 2), V.columns("x", 3), V.columns("n", 3)
A2, B2 = [f"a.{c}" for c in X2], [f"b.{c}" for c in X2]
SMALL, TORUS, KLEIN = 60, (24, 12), (20, 16)


def _rounded(df: DataFrame, keep: list[str], values: list[str], digits: int = 6) -> DataFrame:
    return df.select(*[F.col(c).cast("bigint").alias(c) for c in keep], *[(F.round(c, digits) + F.lit(0.0)).alias(c) for c in values])


def _shown(cols: list[str], digits: int = 6) -> str:
    return ", ".join(V.shown(c, c, digits) for c in cols)


def _ids(n: int) -> str:
    return f"(SELECT range AS i FROM range({n})) ids"


def _knn(cloud: str, cols: list[str], k: int) -> str:
    d2 = V.dist2([f"a.{c}" for c in cols], [f"b.{c}" for c in cols])
    return f"SELECT i, j, round(d2, 9) AS d2, rank FROM (SELECT a.i, b.i AS j, {d2} AS d2, row_number() OVER (PARTITION BY a.i ORDER BY round({d2}, 9), b.i) AS rank FROM {cloud} a JOIN {cloud} b ON a.i <> b.i) WHERE rank <= {k}"


def _fig8(s: SparkSession, n: int = SMALL) -> DataFrame:
    return G.curve_points(s, "figure8", n)


def _torus(s: SparkSession) -> DataFrame:
    return G.surface_points(s, "torus", *TORUS)


FIG8 = G.curve_sql(curves()["figure8"], SMALL, ids=_ids(SMALL))
TORUS_SQL = G.surface_sql(surfaces()["torus"], *TORUS, ids=_ids(TORUS[0] * TORUS[1]))
KLEIN_SQL = G.surface_sql(surfaces()["klein_bottle"], *KLEIN, ids=_ids(KLEIN[0] * KLEIN[1]))
WEIGHTS = """
  m AS (SELECT coalesce(median(CASE WHEN d2 > 0 THEN sqrt(d2) END), 1) AS m FROM k),
  h AS (SELECT i, CASE WHEN max(d2) > 0 THEN sqrt(max(d2)) ELSE (SELECT m FROM m) END AS h FROM k GROUP BY i),
  w0 AS (SELECT k.i, k.j, exp(-k.d2 / (a.h * b.h)) AS w FROM k JOIN h a ON k.i = a.i JOIN h b ON k.j = b.i),
  w AS (SELECT i, j, max(w) AS w FROM (SELECT i, j, w FROM w0 UNION ALL SELECT j, i, w FROM w0) GROUP BY i, j),
  d AS (SELECT i, sum(w) AS deg FROM w GROUP BY i)"""
LAPLACIAN = f"SELECT i, j, {V.shown('sum(v)', 'v')} FROM (SELECT i, j, -w AS v FROM w UNION ALL SELECT i, i, deg FROM d) GROUP BY i, j"
NORMALIZED = f"SELECT i, j, {V.shown('sum(v)', 'v')} FROM (SELECT w.i, w.j, -w.w / sqrt(a.deg) / sqrt(b.deg) AS v FROM w JOIN d a ON w.i = a.i JOIN d b ON w.j = b.i UNION ALL SELECT i, i, 1 FROM d) GROUP BY i, j"


def _weights(edges: DataFrame) -> DataFrame:
    return kernels.symmetrize(kernels.weigh(edges.withColumn("d2", F.round("d2", 9))))


def _scenes(add) -> None:
    x2, x3 = [*X2, *U2], [*X3, *N3]
    for name, sql, n, keep, cols in (
        ("two_circles", scenes.two_circles_sql, 200, ["i", "label"], x2),
        ("two_sheets", lambda ids: scenes.two_sheets_sql(12, ids=ids), 288, ["i", "label"], x3),
        ("two_spheres", lambda ids: scenes.two_spheres_sql(12, ids=ids), 288, ["i", "label"], x3),
        ("sphere_cylinder", lambda ids: scenes.sphere_cylinder_sql(12, ids=ids), 288, ["i", "label"], x3),
        ("thin_tube", lambda ids: scenes.thin_tube_sql(16, 6, ids=ids), 288, ["i", "layer"], x3),
        ("area_weighted", lambda ids: scenes.area_weighted_sql(surfaces()["mobius_band_1"], 100, ids), 400, ["i"], x3),
    ):
        text = (lambda ids, sql=sql: sql(200, ids=ids)) if name == "two_circles" else sql
        add(f"scene_{name}", lambda s, d, text=text, n=n, keep=keep, cols=cols: _rounded(scenes.scene(s, text("{ids}"), n), keep, cols), f"SELECT {', '.join(keep)}, {_shown(cols)} FROM ({text(_ids(n))})")
    forest = scenes.forest_sql(2, 4, 5)
    add("scene_forest", lambda s, d: _rounded(s.sql(forest), ["i", "tree", "branch"], x2), f"SELECT i, tree, branch, {_shown(x2)} FROM ({forest})")
    grid = "(SELECT range AS i FROM range(1024)) grid"
    add("scene_area_uniform", lambda s, d: _rounded(scenes.area_uniform(s, "torus", 150, 600), ["i"], x3), f"SELECT i, {_shown(x3)} FROM ({scenes.area_uniform_sql(surfaces()['torus'], 150, grid, _ids(600))})")


def _metrics(add) -> None:
    cosine = V.dot(["a.u0", "a.u1"], ["b.u0", "b.u1"])
    d2 = V.dist2(A2, B2)
    chordal, geodesic = f"sqrt({d2} + 1.0 * greatest(1 - {cosine} * {cosine}, 0))", f"sqrt({d2} + 1.0 * pow(acos(least(1, abs({cosine}))), 2))"
    for metric, text in (("chordal", chordal), ("geodesic", geodesic)):
        add(f"distance_matrix_{metric}", lambda s, d, metric=metric: _rounded(blowup.distance_matrix(_fig8(s), X2, U2, 1.0, metric), ["i", "j"], ["d"], 5), f"WITH e AS ({FIG8}) SELECT a.i, b.i AS j, {V.shown(text, 'd', 5)} FROM e a, e b")
    add("edges_by_lifted_radius", lambda s, d: _rounded(blowup.edges_from_distances(blowup.distance_matrix(_fig8(s), X2, U2), radius=0.3017), ["i", "j"], ["d2"]), f"WITH e AS ({FIG8}) SELECT i, j, {V.shown('d * d', 'd2')} FROM (SELECT a.i, b.i AS j, {chordal} AS d FROM e a, e b WHERE a.i <> b.i) WHERE d <= 0.3017")
    add("edges_by_lifted_k", lambda s, d: _rounded(blowup.edges_from_distances(blowup.distance_matrix(_fig8(s), X2, U2, 1.0, "geodesic"), k=4), ["i", "j"], ["d2"], 5), f"WITH e AS ({FIG8}) SELECT i, j, {V.shown('d * d', 'd2', 5)} FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(d, 9), j) AS rank FROM (SELECT a.i, b.i AS j, {geodesic} AS d FROM e a, e b WHERE a.i <> b.i)) WHERE rank <= 4")
    add("cloud_laplacian_fig8", lambda s, d: _rounded(blowup.cloud_laplacian(_fig8(s), X2, 6), ["i", "j"], ["v"]), f"WITH e AS ({FIG8}), k AS ({_knn('e', X2, 6)}), {WEIGHTS} {LAPLACIAN}")
    add("cloud_laplacian_radius", lambda s, d: _rounded(blowup.cloud_laplacian(_fig8(s), X2, radius=0.2503, h="median", normalized=True), ["i", "j"], ["v"]),
        f"WITH e AS ({FIG8}), k AS (SELECT a.i, b.i AS j, round({d2}, 9) AS d2 FROM e a JOIN e b ON a.i <> b.i WHERE {d2} <= {num(0.2503**2)}), m AS (SELECT median(sqrt(d2)) AS h FROM k WHERE d2 > 0), w AS (SELECT i, j, exp(-d2 / (h * h)) AS w FROM k, m), d AS (SELECT i, sum(w) AS deg FROM w GROUP BY i) {NORMALIZED}")
    p = ", ".join(f"u{r} * u{c} * {num(0.5**0.5)} AS x{2 + 2 * r + c}" for r in range(2) for c in range(2))
    lifted = f"WITH e AS (SELECT *, {p} FROM ({FIG8})), k AS ({_knn('e', V.columns('x', 6), 6)})"
    add("lifted_laplacian_fig8", lambda s, d: _rounded(blowup.lifted_cloud_laplacian(_fig8(s), X2, U2, 6), ["i", "j"], ["v"]), f"{lifted}, {WEIGHTS} {LAPLACIAN}")
    add("lifted_laplacian_uniform", lambda s, d: _rounded(blowup.lifted_laplacian(_fig8(s), X2, U2, "uniform", 6), ["i", "j"], ["v"]), f"{lifted}, w AS (SELECT i, j, 1 AS w FROM (SELECT i, j FROM k UNION SELECT j, i FROM k)), d AS (SELECT i, sum(w) AS deg FROM w GROUP BY i) {NORMALIZED}")
    line = f"greatest(2 * (1 - {cosine} * {cosine}), 0)"
    own = f"p AS (SELECT k.i, k.j, {d2} AS p0, {line} AS p1 FROM k JOIN e a ON k.i = a.i JOIN e b ON k.j = b.i)"
    add("lifted_laplacian_product", lambda s, d: _rounded(blowup.lifted_laplacian(_fig8(s), X2, U2, "product", 6), ["i", "j"], ["v"], 5),
        f"{lifted}, {own}, h AS (SELECT i, sqrt(max(p0)) AS h0, sqrt(max(p1)) AS h1 FROM p GROUP BY i), w0 AS (SELECT p.i, p.j, exp(-p0 / (a.h0 * b.h0)) * exp(-p1 / (a.h1 * b.h1)) AS w FROM p JOIN h a ON p.i = a.i JOIN h b ON p.j = b.i), w AS (SELECT i, j, max(w) AS w FROM (SELECT i, j, w FROM w0 UNION ALL SELECT j, i, w FROM w0) GROUP BY i, j), d AS (SELECT i, sum(w) AS deg FROM w GROUP BY i) "
        + NORMALIZED.replace("'v'", "'v'").replace(", 6)", ", 5)"))
    add("bandwidths_fig8", lambda s, d: _rounded(blowup.bandwidths(neighbors.knn_edges(_fig8(s), X2, 6), _fig8(s), X2, U2), [], ["spatial", "projector", "embedded"]),
        f"WITH e AS ({FIG8}), k AS ({_knn('e', X2, 6)}), {own} SELECT {V.shown('median(sqrt(p0))', 'spatial')}, {V.shown('median(sqrt(p1))', 'projector')}, {V.shown('median(sqrt(p0 + 0.5 * p1))', 'embedded')} FROM p")
    add("dense_affinity_fig8", lambda s, d: _rounded(blowup.dense_affinity(_fig8(s), X2, 0.4), ["i", "j"], ["w"]), f"WITH e AS ({FIG8}) SELECT a.i, b.i AS j, {V.shown(f'CASE WHEN a.i = b.i THEN 0 ELSE exp(-{d2} / {num(0.16)}) END', 'w')} FROM e a, e b")
    gap = [f"least(abs(a.{c} - b.{c}), {num(2 * pi)} - abs(a.{c} - b.{c}))" for c in "uv"]
    add("self_intersection_distance_klein", lambda s, d: _rounded(blowup.self_intersection_distance(G.surface_points(s, "klein_bottle", *KLEIN), X3, ["u", "v"], 40), ["i"], ["distance"], 5),
        f"WITH e AS ({KLEIN_SQL}), k AS ({_knn('e', X3, 40)}) SELECT k.i, {V.shown('sqrt(min(k.d2))', 'distance', 5)} FROM k JOIN e a ON k.i = a.i JOIN e b ON k.j = b.i WHERE sqrt({V.dot(gap, gap)}) > {num(pi / 2)} GROUP BY k.i")
    add("intersection_scores_fig8", lambda s, d: _rounded(blowup.intersection_scores(_fig8(s), X2, U2, 6), ["i"], ["score"], 5),
        f"WITH e AS ({FIG8}), k AS ({_knn('e', X2, 6)}), m AS (SELECT i, avg(sqrt(d2)) AS m FROM k GROUP BY i), s AS (SELECT p.i, avg(sqrt({line})) AS d FROM k p JOIN k q ON p.i = q.i JOIN e a ON p.j = a.i JOIN e b ON q.j = b.i GROUP BY p.i) SELECT s.i, {V.shown('d / greatest(m, 1e-12)', 'score', 5)} FROM s JOIN m ON s.i = m.i")
    add("cross_sheet_bound_fig8", lambda s, d: _rounded(neighbors.pair_up(blowup.distance_matrix(_fig8(s), X2, U2).select("i", "j"), _fig8(s), U2).select("i", "j", blowup.cross_sheet_bound(F.expr(f"sqrt(greatest(2 * (1 - {V.dot(['a_u0', 'a_u1'], ['b_u0', 'b_u1'])} * {V.dot(['a_u0', 'a_u1'], ['b_u0', 'b_u1'])}), 0))"), 1.0, 2.0, 0.1).alias("bound")), ["i", "j"], ["bound"], 5),
        f"WITH e AS ({FIG8}) SELECT a.i, b.i AS j, {V.shown(f'sqrt(0.5) * greatest(0, sqrt({line}) - 0.2)', 'bound', 5)} FROM e a, e b")
    add("level0_fig8", lambda s, d: _rounded(blowup.level0(_fig8(s), X2, U2), ["i"], [*X2, *U2, "n0", "n1"]), f"SELECT i, {_shown([*X2, *U2])}, {V.shown('-u1', 'n0')}, {V.shown('u0', 'n1')} FROM ({FIG8})")


def _calculus(add) -> None:
    dx = V.minus(B2, A2)
    rows = f"r AS (SELECT w.i, w.w, {dx[0]} AS s, {dx[1]} AS r, b.x0 * b.x1 - a.x0 * a.x1 AS df FROM w JOIN e a ON w.i = a.i JOIN e b ON w.j = b.i)"
    fig8 = f"WITH e AS ({FIG8}), k AS ({_knn('e', X2, 8)}), {WEIGHTS}"

    def weighed(s: SparkSession) -> tuple[DataFrame, DataFrame]:
        points = _fig8(s).withColumn("f", F.col("x0") * F.col("x1"))
        return points, _weights(neighbors.knn_edges(points, X2, 8))

    add("ambient_gradient_fig8", lambda s, d: _rounded((lambda p, w: curvature.ambient_gradient(w, p, X2, "f", 0.01))(*weighed(s)), ["i"], ["g0", "g1"], 5),
        f"{fig8}, {rows}, g AS (SELECT i, sum(w*s*s) AS p, sum(w*s*r) AS q, sum(w*r*r) AS t, sum(w*df*s) AS y, sum(w*df*r) AS z FROM r GROUP BY i), o AS (SELECT *, greatest(0.01 * (p + t) / 2, 1e-12 * (SELECT median(p + t) FROM g WHERE p + t > 0) / 2) AS l FROM g) SELECT i, {V.shown('((t + l) * y - q * z) / ((p + l) * (t + l) - q * q)', 'g0', 5)}, {V.shown('((p + l) * z - q * y) / ((p + l) * (t + l) - q * q)', 'g1', 5)} FROM o")
    along = V.dot(dx, ["a.u0", "a.u1"])
    line = f"r AS (SELECT w.i, w.w, {along} AS t, b.u0 - a.u0 AS c FROM w JOIN e a ON w.i = a.i JOIN e b ON w.j = b.i), g AS (SELECT i, sum(w*t*t) AS s, sum(w*t*c) AS y FROM r GROUP BY i)"

    def slopes(s: SparkSession) -> DataFrame:
        p, w = weighed(s)
        both = neighbors.pair_up(w, p, [*X2, *U2])
        return both.select("i", "w", F.expr(V.dot(V.minus(["b_x0", "b_x1"], ["a_x0", "a_x1"]), ["a_u0", "a_u1"])).alias("t"), F.expr("b_u0 - a_u0").alias("c"))

    add("ridge_fit_fig8", lambda s, d: _rounded(blowup.ridge_fit(slopes(s), ["t"], ["c"], lam=0.05), ["i"], ["b0_0"], 5), f"{fig8}, {line} SELECT i, {V.shown('y / (s + greatest(0.05 * s, 1e-12 * s))', 'b0_0', 5)} FROM g")
    add("shape_gradient_fig8", lambda s, d: _rounded((lambda p, w: blowup.shape_gradient(w, p, X2, U2, "u0"))(*weighed(s)), ["i"], ["slope"], 5), f"{fig8}, {line} SELECT i, {V.shown('y / s', 'slope', 5)} FROM g")

    e, f = frames.frame_terms(N3)
    framed = f"e AS (SELECT *, {V.named(e, 'e')}, {V.named(f, 'f')} FROM ({TORUS_SQL}))"

    def torus(s: SparkSession) -> tuple[DataFrame, DataFrame]:
        p = _torus(s).select("*", *[F.expr(t).alias(f"{n}{k}") for n, ts in (("e", e), ("f", f)) for k, t in enumerate(ts)])
        return p, _weights(neighbors.knn_edges(p, X3, 8))

    E3, F3 = V.columns("e", 3), V.columns("f", 3)
    step = V.minus([f"b.{c}" for c in X3], [f"a.{c}" for c in X3])
    t0, t1 = (V.dot(step, [f"a.{c}" for c in cols]) for cols in (E3, F3))
    turn = V.minus([f"b.{c}" for c in N3], [f"a.{c}" for c in N3])
    rows3 = f"r AS (SELECT w.i, w.w, {t0} AS t0, {t1} AS t1, b.x2 - a.x2 AS c, {V.dot(turn, [f'a.{c}' for c in E3])} AS c0, {V.dot(turn, [f'a.{c}' for c in F3])} AS c1 FROM w JOIN e a ON w.i = a.i JOIN e b ON w.j = b.i WHERE w.i <> w.j)"
    sums = "g AS (SELECT i, sum(w*t0*t0) AS p, sum(w*t0*t1) AS q, sum(w*t1*t1) AS t, sum(w*t0*c) AS y, sum(w*t1*c) AS z, sum(w*t0*c0) AS y0, sum(w*t1*c0) AS z0, sum(w*t0*c1) AS y1, sum(w*t1*c1) AS z1 FROM r GROUP BY i), o AS (SELECT *, 1e-12 * (p + t) / 2 AS l FROM g), v AS (SELECT *, (p + l) * (t + l) - q * q AS det FROM o)"
    whole = f"WITH {framed}, k AS ({_knn('e', X3, 8)}), {WEIGHTS}, {rows3}, {sums}"
    b0, b1 = "((t + l) * y - q * z) / det", "((p + l) * z - q * y) / det"
    add("lifted_gradient_torus", lambda s, d: _rounded((lambda p, w: blowup.lifted_gradient(w, p, X3, E3, F3, "x2"))(*torus(s)), ["i"], ["g0", "g1", "g2"], 5), f"{whole} SELECT v.i, {', '.join(V.shown(f'{b0} * e.e{k} + {b1} * e.f{k}', f'g{k}', 5) for k in range(3))} FROM v JOIN e ON v.i = e.i")
    add("lifted_divergence_torus", lambda s, d: _rounded((lambda p, w: blowup.lifted_divergence(w, p, X3, E3, F3, N3))(*torus(s)), ["i"], ["div"], 5), f"{whole} SELECT i, {V.shown('((t + l) * y0 - q * z0) / det + ((p + l) * z1 - q * y1) / det', 'div', 5)} FROM v")

    quadric = curvature.quadric_terms()
    plain = f"WITH {framed}, k AS ({_knn('e', X3, 10)}), r AS (SELECT k.i, {t0} AS s, {t1} AS r, {V.dot(step, [f'a.{c}' for c in N3])} AS z FROM k JOIN e a ON k.i = a.i JOIN e b ON k.j = b.i), g AS (SELECT i, {', '.join(f'sum({t}) AS {k}' for k, t in curvature.MOMENTS.items())} FROM r GROUP BY i), o AS (SELECT i, {', '.join(f'{t} AS {k}' for k, t in quadric.items())} FROM g)"
    add("quadric_curvature_torus", lambda s, d: _rounded(curvature.quadric_curvature(neighbors.knn_edges(_torus(s), X3, 10), _torus(s), X3, N3), ["i"], ["mean", "gauss", "total"], 4), f"{plain} SELECT i, {V.shown('a + c', 'mean', 4)}, {V.shown('4 * a * c - b * b', 'gauss', 4)}, {V.shown('2 * sqrt(a * a + b * b / 2 + c * c)', 'total', 4)} FROM o")
    for name in ("torus", "sphere", "monkey_saddle", "whitney_umbrella"):
        surface = surfaces()[name]
        source = f"({G.surface_sql(surface, 17, 9, ids=_ids(153))}) q"
        text = curvature.surface_curvature_sql(surface, "{points}")
        add(f"curvature_of_{name}", lambda s, d, name=name, text=text: _rounded(s.sql(text, points=G.surface_points(s, name, 17, 9)), ["i"], ["gauss", "mean_abs", "total"], 5), f"SELECT i, {_shown(['gauss', 'mean_abs', 'total'], 5)} FROM ({curvature.surface_curvature_sql(surface, source)})")
    for name in ("figure8", "helix", "trefoil"):
        curve = curves()[name]
        kappa = curvature.curve_curvature(curve)
        add(f"curvature_of_{name}", lambda s, d, name=name, kappa=kappa: _rounded(G.curve_points(s, name, 100).withColumn("kappa", F.expr(kappa)), ["i"], ["kappa"], 5), f"SELECT i, {V.shown(kappa, 'kappa', 5)} FROM ({G.curve_sql(curve, 100, ids=_ids(100))})")


def _selections(add) -> None:
    part = lambda s, d: s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("i"), F.col("p_size").cast("double").alias("u"), F.col("p_retailprice").cast("double").alias("v"))
    part_sql = "SELECT p_partkey AS i, CAST(p_size AS DOUBLE) AS u, CAST(p_retailprice AS DOUBLE) AS v FROM part"
    order = f"(i + 7) * {num(0.6180339887498949)} - floor((i + 7) * {num(0.6180339887498949)})"
    add("flatten_grid", lambda s, d: _rounded(selections.flatten_grid(_torus(s).withColumns({"iu": F.floor(F.col("i") / 12), "iv": F.col("i") % 12}), 12), ["i"], X3), f"SELECT i, {_shown(X3)} FROM ({TORUS_SQL})")
    add("stride_part", lambda s, d: selections.stride(part(s, d), 7).select("i"), f"SELECT i FROM ({part_sql}) WHERE i % 7 = 0")
    add("remap_singular", lambda s, d: selections.remap(part(s, d).where("u > 20"), part(s, d).where("v > 990")), f"WITH e AS ({part_sql}), k AS (SELECT i, row_number() OVER (ORDER BY i) - 1 AS new FROM e WHERE u > 20) SELECT k.i AS old, new FROM k JOIN e ON k.i = e.i WHERE v > 990")
    add("pick_queries", lambda s, d: selections.pick_queries(part(s, d), part(s, d).where("v > 990"), 5, 7),
        f"WITH e AS ({part_sql}), f AS (SELECT i FROM e WHERE v > 990 ORDER BY {order}, i LIMIT 1), r AS (SELECT i FROM e WHERE i NOT IN (SELECT i FROM f) ORDER BY {order}, i LIMIT (5 - (SELECT count(*) FROM f))) SELECT i, true AS singular FROM f UNION ALL SELECT i, false FROM r")
    group = f"e AS (SELECT *, i % 2 AS g FROM ({FIG8}))"
    turned = "CASE WHEN a.u0 * b.u0 + a.u1 * b.u1 < 0 THEN -1 ELSE 1 END"
    add("smooth_tangents_fig8", lambda s, d: _rounded(selections.smooth_tangents(_fig8(s).withColumn("g", F.col("i") % 2), X2, U2, 0.3503, "g", 1), ["i"], U2),
        f"WITH {group}, m AS (SELECT a.i, avg({turned} * b.u0) AS m0, avg({turned} * b.u1) AS m1 FROM e a JOIN e b ON a.g = b.g AND {V.dist2(A2, B2)} <= {num(0.3503**2)} GROUP BY a.i) SELECT i, {V.shown('m0 / greatest(sqrt(m0*m0 + m1*m1), 1e-12)', 'u0')}, {V.shown('m1 / greatest(sqrt(m0*m0 + m1*m1), 1e-12)', 'u1')} FROM m")
    unit = "SELECT i, (u - min(u) OVER ()) / (max(u) OVER () - min(u) OVER ()) AS u, (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) AS v"
    add("checker_part", lambda s, d: selections.normalize_uv(part(s, d)).select("i", selections.checker(["u", "v"], 8).alias("colour")), f"SELECT i, CAST((least(floor(u * 8), 7) + least(floor(v * 8), 7)) % 2 AS BIGINT) AS colour FROM ({unit} FROM ({part_sql}))")
    add("normalized_part", lambda s, d: _rounded(selections.normalized(selections.normalized(part(s, d), "u"), "v", "zscore"), ["i"], ["u", "v"]), f"SELECT i, {V.shown('u / max(abs(u)) OVER ()', 'u')}, {V.shown('(v - avg(v) OVER ()) / stddev_pop(v) OVER ()', 'v')} FROM ({part_sql})")
    add("projector_entries_fig8", lambda s, d: _rounded(selections.projector_entries(_fig8(s), U2), ["i", "row", "col"], ["value"]), f"WITH e AS ({FIG8}) " + " UNION ALL ".join(f"SELECT i, CAST({r} AS BIGINT) AS row, CAST({c} AS BIGINT) AS col, {V.shown(f'u{r} * u{c}', 'value')} FROM e" for r in range(2) for c in range(2)))
    add("best_accuracy_part", lambda s, d: s.createDataFrame([(round(selections.best_accuracy(part(s, d).select((F.col("i") % 2).alias("a"), F.when(F.col("u") > 15, 1).otherwise(0).alias("b")), "a", "b"), 6),)], "accuracy double"), f"SELECT round(greatest(avg(CASE WHEN (i % 2 = 1) = (u > 15) THEN 1 ELSE 0 END), avg(CASE WHEN (i % 2 = 1) <> (u > 15) THEN 1 ELSE 0 END)), 6) AS accuracy FROM ({part_sql})")
    add("unique_vertices_torus", lambda s, d: mesh.unique_vertices(_torus(s), 0.5), f"WITH e AS ({TORUS_SQL}) SELECT i, min(i) OVER (PARTITION BY {', '.join(f'round_even(x{k} / {num(0.5)}, 0)' for k in range(3))}) AS vertex FROM e")


def _files(add) -> None:
    """Files that the query writes and reads back; what was written is told by closed forms."""

    def triangles(s: SparkSession, ending: str) -> DataFrame:
        at = f"{shared_dir(s)}/mesh-{uuid.uuid4().hex}"
        k = np.arange(20)
        corners = np.stack([np.stack([k, k * 0 + v, (k + v) % 3], axis=1) for v in range(3)], axis=1).astype(float)
        data = mesh_files.stl_bytes(corners) if ending == "stl" else ("\n".join([*(f"v {p[0]} {p[1]} {p[2]}" for t in corners for p in t), *(f"f {3 * n + 1} {3 * n + 2} {3 * n + 3}" for n in range(20))]) + "\n").encode()
        s.createDataFrame([(1,)], "x int").write.parquet(f"{at}/made")  # the folder, through Spark
        cloud_files._put(f"{at}/mesh.{ending}", data)
        return mesh_files.read_triangles(s, f"{at}/mesh.{ending}")

    cols = [f"{c}{k}" for c in "abc" for k in range(3)]
    sql = "SELECT " + ", ".join(f"CAST({('range', str(v), f'(range + {v}) % 3')[k]} AS DOUBLE) AS {c}{k}" for v, c in enumerate("abc") for k in range(3)) + " FROM range(20)"
    for ending in ("stl", "obj"):
        add(f"read_{ending}", lambda s, d, ending=ending: triangles(s, ending).select(*[(F.col(c).cast("double") + F.lit(0.0)).alias(c) for c in cols]), sql)

    def cloud(s: SparkSession) -> DataFrame:
        at = f"{shared_dir(s)}/cloud-{uuid.uuid4().hex}"
        s.createDataFrame([(1,)], "x int").write.parquet(f"{at}/made")
        cloud_files.save_cloud(_torus(s), f"{at}/torus.npz", X3, normals=N3)
        return mesh_files.read_npz(s, f"{at}/torus.npz")

    add("read_npz", lambda s, d: _rounded(cloud(s), ["i"], X3), f"SELECT row_number() OVER (ORDER BY i) - 1 AS i, {_shown(X3)} FROM ({TORUS_SQL})")


def more() -> dict[str, tuple[Query, str | None]]:
    out: dict[str, tuple[Query, str | None]] = {}

    def add(name: str, query: Query, sql: str | None = None) -> None:
        out[name] = (query, sql)

    for group in (_scenes, _metrics, _calculus, _selections, _files):
        group(add)
    return out
