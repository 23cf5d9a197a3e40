"""One-call operators on clouds with directions: product metrics, Laplacians, regressions and calculus in tangent frames.

A cloud has ids `i`, positions x and, for lines, unit directions u in scalar columns;
planes are given by two frame vectors e and f.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sheetwise.functions import vectors as V
from sheetwise.operators import frames, kernels
from sheetwise.operators.lift import projector
from sheetwise.operators.neighbors import DIGITS, knn_edges, knn_vectors, pair_up, radius_edges


def _ends(cols: Sequence[str]) -> tuple[list[str], list[str]]:
    return [f"a_{c}" for c in cols], [f"b_{c}" for c in cols]


def product_distance(x: Sequence[str], u: Sequence[str], alpha: float = 1.0, metric: str = "chordal") -> str:
    """SQL of the distance of two rows a_.. and b_..: position, and alpha times the squared distance of the lines."""
    if alpha < 0:
        raise ValueError("alpha must not be negative")
    (ax, bx), (au, bu) = _ends(x), _ends(u)
    cosine = V.dot(au, bu)
    if metric == "chordal":
        line = f"greatest(1 - {cosine} * {cosine}, 0)"
    elif metric == "geodesic":
        line = f"power({frames.angle(au, bu)}, 2)"
    else:
        raise ValueError(f"no metric {metric}")
    return f"sqrt({V.dist2(ax, bx)} + {float(alpha)!r} * {line})"


def distance_matrix(points: DataFrame, x: Sequence[str], u: Sequence[str], alpha: float = 1.0, metric: str = "chordal", other: DataFrame | None = None) -> DataFrame:
    """(i, j, d) for all pairs with another cloud, or with the cloud itself: dense by definition, for clouds whose square is wanted."""
    a, b = (df.select(F.col("i").alias(key), *[F.col(c).alias(f"{side}_{c}") for c in (*x, *u)]) for df, key, side in ((points, "i", "a"), (points if other is None else other, "j", "b")))
    return a.crossJoin(b).select("i", "j", F.expr(product_distance(x, u, alpha, metric)).alias("d"))


def edges_from_distances(distances: DataFrame, k: int | None = None, radius: float | None = None, include_self: bool = False) -> DataFrame:
    """(i, j, d2) of the finite distances up to the radius, or of the k nearest of each row; ties go to the smaller id."""
    if (k is None) == (radius is None):
        raise ValueError("either k or a radius")
    rows = distances.where("NOT isnan(d) AND d < double('infinity')").where("TRUE" if include_self else "i <> j")
    if radius is not None:
        rows = rows.where(F.col("d") <= radius)
    else:
        rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("i").orderBy(F.round("d", DIGITS), "j"))).where(F.col("rank") <= k)
    return rows.select("i", "j", (F.col("d") * F.col("d")).alias("d2"))


def cloud_laplacian(points: DataFrame, x: Sequence[str], k: int = 20, radius: float | None = None, h: str | float = "local", symmetrize: bool = True, include_self: bool = False, normalized: bool = False) -> DataFrame:
    """(i, j, v): the Laplacian of a cloud from its k nearest neighbours, or from all within a radius."""
    edges = radius_edges(points, x, radius, include_self=include_self) if radius is not None else knn_edges(points, x, k, include_self)
    return _laplacian(edges, h, symmetrize, normalized)


def _laplacian(edges: DataFrame, h: str | float, symmetrize: bool, normalized: bool) -> DataFrame:
    w = kernels.weigh(edges.withColumn("d2", F.round("d2", DIGITS)), h)
    return kernels.laplacian(kernels.symmetrize(w) if symmetrize else w, normalized)


def lifted_edges(points: DataFrame, x: Sequence[str], u: Sequence[str], k: int | None = 20, radius: float | None = None, alpha: float = 1.0, metric: str = "chordal") -> DataFrame:
    """(i, j, d2) in the product metric. Chordal distances are Euclidean in positions and scaled projectors; geodesic ones take the dense matrix."""
    if metric == "chordal" and radius is None:
        scale = (alpha / 2) ** 0.5
        vector = F.array(*[F.col(c) for c in x], *[F.expr(f"{scale!r} * {p}") for p in projector(u)])
        return knn_vectors(points.select("i", vector.alias("vector")), "vector", k).select("i", "j", "d2")
    return edges_from_distances(distance_matrix(points, x, u, alpha, metric), k if radius is None else None, radius)


def lifted_cloud_laplacian(points: DataFrame, x: Sequence[str], u: Sequence[str], k: int = 20, radius: float | None = None, h: str | float = "local", alpha: float = 1.0, metric: str = "chordal", symmetrize: bool = True, normalized: bool = False) -> DataFrame:
    """(i, j, v): the Laplacian of a cloud with line directions in the product metric."""
    return _laplacian(lifted_edges(points, x, u, k, radius, alpha, metric), h, symmetrize, normalized)


def lifted_laplacian(points: DataFrame, x: Sequence[str], u: Sequence[str], kernel: str = "product", k: int = 20, self_tuning: bool = True, sigma_x: float = 0.5, sigma_u: float = 0.5, alpha: float = 1.0, normalized: bool = True) -> DataFrame:
    """(i, j, v) by kernel: 'product' of a spatial and a projector Gaussian, 'uniform' weights, or 'lifted' distances."""
    if kernel == "lifted":
        return lifted_cloud_laplacian(points, x, u, k, alpha=alpha, normalized=normalized)
    edges = lifted_edges(points, x, u, k, alpha=alpha)
    if kernel == "uniform":
        return kernels.laplacian(kernels.uniform(edges), normalized)
    if kernel != "product":
        raise ValueError(f"no kernel {kernel}")
    p = [f"p{n}" for n in range(len(u) ** 2)]
    wide = points.select("i", *x, *[F.expr(t).alias(c) for t, c in zip(projector(u), p)])
    w = kernels.product(edges, wide, x, [p], None, None) if self_tuning else kernels.product(edges, wide, x, [p], sigma_x, sigma_u)
    return kernels.laplacian(w, normalized)


def bandwidths(edges: DataFrame, points: DataFrame, x: Sequence[str], u: Sequence[str], alpha: float = 1.0) -> DataFrame:
    """One row: median distances over the edges in position, between projectors (Frobenius), and in the embedding of both."""
    both = pair_up(edges.select("i", "j"), points, [*x, *u])
    (ax, bx), (au, bu) = _ends(x), _ends(u)
    line = f"greatest(2 * (1 - {V.dot(au, bu)} * {V.dot(au, bu)}), 0)"
    return both.agg(F.median(F.expr(f"sqrt({V.dist2(ax, bx)})")).alias("spatial"), F.median(F.expr(f"sqrt({line})")).alias("projector"), F.median(F.expr(f"sqrt({V.dist2(ax, bx)} + {alpha / 2!r} * {line})")).alias("embedded"))


def dense_affinity(points: DataFrame, x: Sequence[str], h: float) -> DataFrame:
    """(i, j, w): the Gaussian of every pair, 0 on the diagonal; dense by definition."""
    a, b = (points.select(F.col("i").alias(key), *[F.col(c).alias(f"{side}_{c}") for c in x]) for key, side in (("i", "a"), ("j", "b")))
    w = F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.exp(-F.expr(V.dist2(*_ends(x))) / F.lit(float(h) ** 2)))
    return a.crossJoin(b).select("i", "j", w.alias("w"))


def self_intersection_distance(points: DataFrame, x: Sequence[str], params: Sequence[str], k: int = 120, period: float = 6.283185307179586) -> DataFrame:
    """(i, distance): to the nearest of k neighbours that lies a quarter of the period away in the parameters; points without one are left out."""
    both = pair_up(knn_edges(points, x, k), points, params)
    gap = [f"least(abs(a_{p} - b_{p}), {period!r} - abs(a_{p} - b_{p}))" for p in params]
    return both.where(F.expr(f"sqrt({V.dot(gap, gap)}) > {period / 4!r}")).groupBy("i").agg(F.sqrt(F.min("d2")).alias("distance"))


def intersection_scores(points: DataFrame, x: Sequence[str], u: Sequence[str], k: int = 15) -> DataFrame:
    """(i, score): the mean projector distance among all pairs of a point's neighbours over their mean distance."""
    edges = knn_edges(points, x, k)
    near = edges.groupBy("i").agg(F.avg(F.sqrt("d2")).alias("m"))
    lines = points.select(F.col("i").alias("j"), *u)
    one, two = (edges.select("i", "j").join(lines, "j").select("i", *[F.col(c).alias(f"{side}_{c}") for c in u]) for side in "ab")
    au, bu = _ends(u)
    apart = F.expr(f"sqrt(greatest(2 * (1 - {V.dot(au, bu)} * {V.dot(au, bu)}), 0))")
    spread = one.join(two, "i").groupBy("i").agg(F.avg(apart).alias("d"))
    return spread.join(near, "i").select("i", (F.col("d") / F.greatest("m", F.lit(1e-12))).alias("score"))


def ridge_fit(rows: DataFrame, t: Sequence[str], c: Sequence[str], w: str = "w", lam: float = 0.0) -> DataFrame:
    """(i, b..): weighted ridge regression of each response c on one or two regressors t, row by row of i.

    The ridge is the larger of lam times the mean diagonal and 1e-12 of it (or 1e-12); a singular system gives zeros.
    Coefficients are named b<response>_<regressor>.
    """
    d = len(t)
    if d not in (1, 2):
        raise ValueError("one or two regressors")
    sums = [F.sum(F.expr(f"{w} * {t[p]} * {t[q]}")).alias(f"s{p}{q}") for p in range(d) for q in range(p, d)]
    sums += [F.sum(F.expr(f"{w} * {t[p]} * {y}")).alias(f"r{n}_{p}") for n, y in enumerate(c) for p in range(d)]
    g = rows.groupBy("i").agg(*sums)
    trace = " + ".join(f"s{p}{p}" for p in range(d))
    ridge = f"greatest({lam!r} * ({trace}) / {d}, CASE WHEN {trace} > 0 THEN 1e-12 * ({trace}) / {d} ELSE 1e-12 END)"
    return _solved(g, d, len(c), ridge)


def _solved(g: DataFrame, d: int, responses: int, ridge: str) -> DataFrame:
    g = g.withColumn("ridge", F.expr(ridge))
    if d == 1:
        return g.select("i", *[F.expr(f"CASE WHEN s00 + ridge = 0 THEN 0 ELSE r{n}_0 / (s00 + ridge) END").alias(f"b{n}_0") for n in range(responses)])
    g = g.withColumn("det", F.expr("(s00 + ridge) * (s11 + ridge) - s01 * s01"))
    out = []
    for n in range(responses):
        out += [F.expr(f"CASE WHEN det = 0 THEN 0 ELSE ((s11 + ridge) * r{n}_0 - s01 * r{n}_1) / det END").alias(f"b{n}_0"), F.expr(f"CASE WHEN det = 0 THEN 0 ELSE ((s00 + ridge) * r{n}_1 - s01 * r{n}_0) / det END").alias(f"b{n}_1")]
    return g.select("i", *out)


def level0(points: DataFrame, x: Sequence[str], u: Sequence[str]) -> DataFrame:
    """(i, x.., u.., n..): position, unit tangent and, in the plane, the normal to its left."""
    if len(u) != 2:
        raise ValueError("normals of lines are defined in the plane")
    return points.select("i", *x, *u, (-F.col(u[1])).alias("n0"), F.col(u[0]).alias("n1"))


def shape_gradient(edges: DataFrame, points: DataFrame, x: Sequence[str], u: Sequence[str], shape: str, lam: float = 0.0) -> DataFrame:
    """(i, slope): the change of a shape value along each point's tangent, by regression over its neighbours with weights w."""
    both = pair_up(edges.select("i", "j", "w"), points, [*x, *u, shape])
    (ax, bx), au = _ends(x), [f"a_{c}" for c in u]
    rows = both.select("i", "w", F.expr(V.dot(V.minus(bx, ax), au)).alias("t"), (F.col(f"b_{shape}") - F.col(f"a_{shape}")).alias("c"))
    g = rows.groupBy("i").agg(F.sum(F.expr("w * t * t")).alias("s00"), F.sum(F.expr("w * t * c")).alias("r0_0"))
    return _solved(g, 1, 1, f"{lam!r} * s00").select("i", F.col("b0_0").alias("slope"))


def _tangent_rows(weights: DataFrame, points: DataFrame, x: Sequence[str], e: Sequence[str], f: Sequence[str], more: Sequence[str]) -> DataFrame:
    """Edges with t0, t1: the step to the neighbour in the point's frame (e, f), and the columns `more` of both ends."""
    both = pair_up(weights.where("i <> j"), points, [*x, *e, *f, *more])
    ax, bx = _ends(x)
    step = V.minus(bx, ax)
    return both.withColumn("t0", F.expr(V.dot(step, [f"a_{c}" for c in e]))).withColumn("t1", F.expr(V.dot(step, [f"a_{c}" for c in f])))


def lifted_gradient(weights: DataFrame, points: DataFrame, x: Sequence[str], e: Sequence[str], f: Sequence[str], value: str, lam: float = 0.0) -> DataFrame:
    """(i, g0..): the weighted least-squares gradient of a value in the tangent plane of frame (e, f), as an ambient vector."""
    rows = _tangent_rows(weights, points, x, e, f, [value]).withColumn("c", F.col(f"b_{value}") - F.col(f"a_{value}"))
    b = ridge_fit(rows, ["t0", "t1"], ["c"], "w", lam).join(points.select("i", *e, *f), "i")
    return b.select("i", *[(F.col("b0_0") * F.col(p) + F.col("b0_1") * F.col(q)).alias(f"g{n}") for n, (p, q) in enumerate(zip(e, f))])


def lifted_divergence(weights: DataFrame, points: DataFrame, x: Sequence[str], e: Sequence[str], f: Sequence[str], field: Sequence[str], lam: float = 0.0) -> DataFrame:
    """(i, div): the trace of the weighted least-squares Jacobian of a field, both ends taken in the frame of i."""
    rows = _tangent_rows(weights, points, x, e, f, field)
    af, bf = _ends(field)
    change = V.minus(bf, af)
    rows = rows.withColumn("c0", F.expr(V.dot(change, [f"a_{c}" for c in e]))).withColumn("c1", F.expr(V.dot(change, [f"a_{c}" for c in f])))
    return ridge_fit(rows, ["t0", "t1"], ["c0", "c1"], "w", lam).select("i", (F.col("b0_0") + F.col("b1_1")).alias("div"))


def cross_sheet_bound(projector_distance: Column, alpha: float, curvature: float, reach: float) -> Column:
    """The least lifted distance of two points of different sheets whose projectors differ by so much near a crossing."""
    return F.lit((alpha / 2) ** 0.5) * F.greatest(F.lit(0.0), projector_distance - F.lit(curvature * reach))
