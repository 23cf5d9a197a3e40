"""Named queries over the driver's tables and the catalogue, each with the SQL that gives the same rows.

The SQL is written on its own terms, mostly as brute force over all pairs: it says
what a query means, while the Spark side says how to get there at scale.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.functions import vectors as V
from sheetwise.functions.symbolic import num
from sheetwise.operators import calculus, cluster, frames, heat, implicit, kernels, levels, lift, mesh, neighbors, reconstruct, rewrites
from sheetwise.plans.lineage import cut
from sheetwise.plans.more import more
from sheetwise.plans.tables import tables
from sheetwise.sources import generators as G
from sheetwise.sources.catalogue import curves, surfaces

Query = Callable[[SparkSession, str], DataFrame]
X2, U2, X3, N3 = V.columns("x", 2), V.columns("u", 2), V.columns("x", 3), V.columns("n", 3)
EMB = V.columns("x", 64)
FIG8, TORUS, CUBE = 240, (24, 12), (12, 5)


def _rounded(df: DataFrame, keep: list[str], values: list[str], digits: int = 6) -> DataFrame:
    return df.select(*[F.col(c).cast("bigint").alias(c) for c in keep], *[(F.round(c, digits) + F.lit(0.0)).alias(c) for c in values])


def _shown(cols: list[str], digits: int = 6) -> str:
    return ", ".join(V.shown(c, c, digits) for c in cols)


def _ids(n: int) -> str:
    return f"(SELECT range AS i FROM range({n})) ids"


# --- clouds: a Spark DataFrame and the SQL of the same rows


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("i"), F.col("embedding").alias("x"), F.col("label").cast("bigint").alias("label"))


EMB_SQL = "SELECT vec_id AS i, label, " + ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS x{k}" for k in range(64)) + " FROM embeddings"


def _fig8(spark: SparkSession, n: int = FIG8) -> DataFrame:
    return G.curve_points(spark, "figure8", n)


FIG8_SQL = G.curve_sql(curves()["figure8"], FIG8, ids=_ids(FIG8))


def _surface(name: str, nu: int, nv: int) -> tuple[Callable[[SparkSession], DataFrame], str]:
    return (lambda s: G.surface_points(s, name, nu, nv)), G.surface_sql(surfaces()[name], nu, nv, ids=_ids(nu * nv))


TORUS_DF, TORUS_SQL = _surface("torus", *TORUS)
CUBE_DF, CUBE_SQL = _surface("cube", *CUBE)


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("i"), (F.col("p_size") / 50.0).cast("double").alias("x0"), (F.col("p_retailprice") / 2000.0).alias("x1"))


PART_SQL = f"SELECT p_partkey AS i, CAST(p_size AS DOUBLE) / {num(50)} AS x0, p_retailprice / {num(2000)} AS x1 FROM part"


def knn_sql(cloud: str, cols: list[str], k: int) -> str:
    d2 = V.dist2([f"a.{c}" for c in cols], [f"b.{c}" for c in cols])
    return f"SELECT i, j, round(d2, 9) AS d2, rank FROM (SELECT a.i, b.i AS j, {d2} AS d2, row_number() OVER (PARTITION BY a.i ORDER BY round({d2}, 9), b.i) AS rank FROM {cloud} a JOIN {cloud} b ON a.i <> b.i) WHERE rank <= {k}"


LOCAL_SQL = """
  m AS (SELECT coalesce(median(CASE WHEN d2 > 0 THEN sqrt(d2) END), 1) AS m FROM k),
  h AS (SELECT i, CASE WHEN max(d2) > 0 THEN sqrt(max(d2)) ELSE (SELECT m FROM m) END AS h FROM k GROUP BY i),
  w0 AS (SELECT k.i, k.j, exp(-k.d2 / (a.h * b.h)) AS w FROM k JOIN h a ON k.i = a.i JOIN h b ON k.j = b.i),
  w AS (SELECT i, j, max(w) AS w FROM (SELECT i, j, w FROM w0 UNION ALL SELECT j, i, w FROM w0) GROUP BY i, j)"""


def _emb_edges(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    return cut(neighbors.knn_vectors(_embeddings(spark, d), "x", k))  # the affinities read the edges several times


def _emb_weights(spark: SparkSession, d: str) -> DataFrame:
    return kernels.symmetrize(kernels.weigh(_emb_edges(spark, d)))


EMB_W = f"WITH e AS ({EMB_SQL}), k AS ({knn_sql('e', EMB, 10)}), {LOCAL_SQL}"
FIG8_K = f"WITH e AS ({FIG8_SQL}), k AS ({knn_sql('e', X2, 8)})"
TORUS_K = f"WITH e AS ({TORUS_SQL}), k AS ({knn_sql('e', X3, 8)})"


def _fig8_weights(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    p = _fig8(spark)
    e = neighbors.knn_edges(p, X2, 8).withColumn("d2", F.round("d2", 9))
    return p, kernels.symmetrize(kernels.weigh(e))


def _torus_edges(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    p = TORUS_DF(spark)
    return p, neighbors.knn_edges(p, X3, 8).withColumn("d2", F.round("d2", 9))


# --- queries


def _catalogue() -> dict[str, tuple[Query, str | None]]:
    out: dict[str, tuple[Query, str | None]] = {}
    for name, c in curves().items():
        n = len(c.position)
        cols = ["t", *V.columns("x", n), *V.columns("u", n)]
        out[f"curve_{name}"] = (lambda s, d, name=name, cols=cols: _rounded(G.curve_points(s, name, 200), ["i"], cols), f"SELECT i, {_shown(cols)} FROM ({G.curve_sql(c, 200, ids=_ids(200))})")
    for name, f in surfaces().items():
        cols = ["u", "v", *X3, *N3]
        out[f"surface_{name}"] = (lambda s, d, name=name, cols=cols: _rounded(G.surface_points(s, name, 17, 9), ["i"], cols), f"SELECT i, {_shown(cols)} FROM ({G.surface_sql(f, 17, 9, ids=_ids(153))})")
    for kind in ("uniform", "random", "jittered", "chebyshev"):
        out[f"sampler_{kind}"] = (lambda s, d, kind=kind: _rounded(G.curve_points(s, "circle", 100, kind), ["i"], ["t"]), f"SELECT i, {_shown(['t'])} FROM ({G.curve_sql(curves()['circle'], 100, kind, ids=_ids(100))})")
    return out


def _relational() -> dict[str, tuple[Query, str | None]]:
    out: dict[str, tuple[Query, str | None]] = {}

    def add(name: str, query: Query, sql: str | None = None) -> None:
        out[name] = (query, sql)

    # neighbour joins
    add("knn_embeddings", lambda s, d: _rounded(_emb_edges(s, d), ["i", "j", "rank"], ["d2"]), f"WITH e AS ({EMB_SQL}) SELECT i, j, rank, {_shown(['d2'])} FROM ({knn_sql('e', EMB, 10)})")
    add("knn_grid_part", lambda s, d: _rounded(neighbors.knn_edges(_parts(s, d), X2, 5), ["i", "j", "rank"], ["d2"]), f"WITH e AS ({PART_SQL}) SELECT i, j, rank, {_shown(['d2'])} FROM ({knn_sql('e', X2, 5)})")
    d2 = V.dist2(["a.x0", "a.x1"], ["b.x0", "b.x1"])
    add("radius_grid_part", lambda s, d: neighbors.radius_edges(_parts(s, d), X2, 0.0151, digits=6), f"WITH e AS ({PART_SQL}) SELECT a.i, b.i AS j, {V.shown(d2, 'd2')} FROM e a JOIN e b ON a.i <> b.i AND {d2} <= {num(0.0151**2)}")
    add("nearest_to_centroid", lambda s, d: _parts(s, d).crossJoin(F.broadcast(_parts(s, d).agg(F.avg("x0").alias("c0"), F.avg("x1").alias("c1")))).agg(F.min(F.struct(F.round(F.expr("(x0-c0)*(x0-c0)+(x1-c1)*(x1-c1)"), 9).alias("d2"), "i")).alias("m")).select(F.col("m.i").alias("i")),
        f"WITH e AS ({PART_SQL}), c AS (SELECT avg(x0) AS c0, avg(x1) AS c1 FROM e) SELECT i FROM e, c ORDER BY round((x0-c0)*(x0-c0)+(x1-c1)*(x1-c1), 9), i LIMIT 1")
    add("chamfer_curves", lambda s, d: _rounded(neighbors.chamfer(G.curve_points(s, "circle", 100), _fig8(s), X2), [], ["chamfer"]),
        f"WITH a AS ({G.curve_sql(curves()['circle'], 100, ids=_ids(100))}), e AS ({FIG8_SQL}), p AS (SELECT a.i AS ai, e.i AS ei, sqrt({V.dist2(['a.x0', 'a.x1'], ['e.x0', 'e.x1'])}) AS d FROM a, e) SELECT {V.shown('(SELECT avg(m) FROM (SELECT min(d) AS m FROM p GROUP BY ai)) + (SELECT avg(m) FROM (SELECT min(d) AS m FROM p GROUP BY ei))', 'chamfer')}")
    cosine = V.dot(["a.u0", "a.u1"], ["b.u0", "b.u1"])
    add("self_intersections_fig8", lambda s, d: neighbors.self_intersections(_fig8(s), X2, U2),
        f"WITH e AS ({FIG8_SQL}), k AS ({knn_sql('e', X2, 5)}), hit AS (SELECT k.i, k.j FROM k JOIN e a ON k.i = a.i JOIN e b ON k.j = b.i WHERE abs(k.i - k.j) >= 10 AND abs({cosine}) <= {num(0.8660254037844387)}) SELECT i FROM hit UNION SELECT j FROM hit")
    n_cos = V.dot([f"a.{c}" for c in N3], [f"b.{c}" for c in N3])
    add("normal_singularities_cube", lambda s, d: neighbors.normal_singularities(CUBE_DF(s), X3, N3, 6),
        f"WITH e AS ({CUBE_SQL}), k AS ({knn_sql('e', X3, 6)}) SELECT k.i, bool_or(abs({n_cos}) < {num(0.7071067811865476)}) AS singular FROM k JOIN e a ON k.i = a.i JOIN e b ON k.j = b.i GROUP BY k.i")

    # affinities and Laplacians
    add("affinity_degree", lambda s, d: _rounded(kernels.degrees(_emb_weights(s, d)), ["i"], ["deg"]), f"{EMB_W} SELECT i, {V.shown('sum(w)', 'deg')} FROM w GROUP BY i")
    add("affinity_self_tuning", lambda s, d: _rounded(_emb_weights(s, d), ["i", "j"], ["w"]), f"{EMB_W} SELECT i, j, {V.shown('w', 'w')} FROM w")
    add("affinity_uniform", lambda s, d: _rounded(kernels.uniform(_emb_edges(s, d)), ["i", "j"], ["w"]), f"WITH e AS ({EMB_SQL}), k AS ({knn_sql('e', EMB, 10)}) SELECT i, j, {num(1)} AS w FROM (SELECT i, j FROM k UNION SELECT j, i FROM k)")
    add("affinity_median", lambda s, d: _rounded(kernels.symmetrize(kernels.weigh(_emb_edges(s, d), "median")), ["i", "j"], ["w"]),
        f"WITH e AS ({EMB_SQL}), k AS ({knn_sql('e', EMB, 10)}), m AS (SELECT median(sqrt(d2)) AS h FROM k WHERE d2 > 0), w AS (SELECT i, j, exp(-d2 / (h * h)) AS w FROM k, m) SELECT i, j, {V.shown('max(w)', 'w')} FROM (SELECT i, j, w FROM w UNION ALL SELECT j, i, w FROM w) GROUP BY i, j")
    add("bandwidth_local", lambda s, d: _rounded(kernels.local_bandwidths(_emb_edges(s, d)), ["i"], ["h"]), f"{EMB_W} SELECT i, {_shown(['h'])} FROM h")
    deg = "d AS (SELECT i, sum(w) AS deg FROM w GROUP BY i)"
    add("laplacian_unnormalized", lambda s, d: _rounded(kernels.laplacian(_emb_weights(s, d)), ["i", "j"], ["v"]), f"{EMB_W}, {deg} SELECT i, j, {V.shown('sum(v)', 'v')} FROM (SELECT i, j, -w AS v FROM w UNION ALL SELECT i, i, deg FROM d) GROUP BY i, j")
    add("laplacian_normalized", lambda s, d: _rounded(kernels.laplacian(_emb_weights(s, d), True), ["i", "j"], ["v"]),
        f"{EMB_W}, {deg} SELECT i, j, {V.shown('sum(v)', 'v')} FROM (SELECT w.i, w.j, -w.w / sqrt(a.deg) / sqrt(b.deg) AS v FROM w JOIN d a ON w.i = a.i JOIN d b ON w.j = b.i UNION ALL SELECT i, i, 1 FROM d) GROUP BY i, j")
    add("cross_label_fraction", lambda s, d: _rounded(kernels.cross_fraction(_emb_weights(s, d), _embeddings(s, d)), [], ["fraction"]),
        f"{EMB_W} SELECT {V.shown('sum(CASE WHEN a.label <> b.label THEN w ELSE 0 END) / sum(w)', 'fraction')} FROM w JOIN e a ON w.i = a.i JOIN e b ON w.j = b.i")
    px, pu = V.dist2(["a.x0", "a.x1"], ["b.x0", "b.x1"]), V.dist2(["a.u0", "a.u1"], ["b.u0", "b.u1"])
    add("affinity_product_fixed", lambda s, d: _rounded(kernels.product(neighbors.knn_edges(_fig8(s), X2, 8), _fig8(s), X2, [U2]), ["i", "j"], ["w"]),
        f"{FIG8_K}, w AS (SELECT k.i, k.j, exp(-{px} / {num(0.25)}) * exp(-{pu} / {num(0.25)}) AS w FROM k JOIN e a ON k.i = a.i JOIN e b ON k.j = b.i) SELECT i, j, {V.shown('max(w)', 'w')} FROM (SELECT i, j, w FROM w UNION ALL SELECT j, i, w FROM w) GROUP BY i, j")
    p_own = f"p AS (SELECT k.i, k.j, {px} AS p0, {pu} AS p1 FROM k JOIN e a ON k.i = a.i JOIN e b ON k.j = b.i), h AS (SELECT i, sqrt(max(p0)) AS h0, sqrt(max(p1)) AS h1 FROM p GROUP BY i)"
    add("affinity_product_self_tuning", lambda s, d: _rounded(kernels.product(neighbors.knn_edges(_fig8(s), X2, 8), _fig8(s), X2, [U2], None, None), ["i", "j"], ["w"]),
        f"{FIG8_K}, {p_own}, w AS (SELECT p.i, p.j, exp(-p0 / (a.h0 * b.h0)) * exp(-p1 / (a.h1 * b.h1)) AS w FROM p JOIN h a ON p.i = a.i JOIN h b ON p.j = b.i) SELECT i, j, {V.shown('max(w)', 'w')} FROM (SELECT i, j, w FROM w UNION ALL SELECT j, i, w FROM w) GROUP BY i, j")
    bx, bn = V.dist2([f"a.{c}" for c in X3], [f"b.{c}" for c in X3]), V.dist2([f"a.{c}" for c in N3], [f"b.{c}" for c in N3])
    add("laplacian_bilateral", lambda s, d: _rounded(kernels.degrees(kernels.bilateral(_torus_edges(s)[1], TORUS_DF(s), X3, N3)), ["i"], ["deg"]),
        f"{TORUS_K}, p AS (SELECT k.i, k.j, {bx} AS p0, {bn} AS p1 FROM k JOIN e a ON k.i = a.i JOIN e b ON k.j = b.i), m AS (SELECT median(CASE WHEN p0 > 0 THEN sqrt(p0) END) AS h0, median(CASE WHEN p1 > 0 THEN sqrt(p1) END) AS h1 FROM p), w AS (SELECT i, j, exp(-p0 / (h0 * h0) - p1 / (h1 * h1)) AS w FROM p, m) SELECT i, {V.shown('sum(w)', 'deg')} FROM (SELECT i, w / 2 AS w FROM w UNION ALL SELECT j, w / 2 FROM w) GROUP BY i")

    # lift and calculus
    ua, ub = ["a.u0", "a.u1"], ["b.u0", "b.u1"]
    q = [f"u{r} * u{c} * {num(0.5**0.5)} AS e{2 + 2 * r + c}" for r in range(2) for c in range(2)]
    along, dx = V.dot(ub, ua), V.minus(["b.x0", "b.x1"], ["a.x0", "a.x1"])
    add("curvature_fig8", lambda s, d: _rounded(lift.lift_curve(_fig8(s), X2, U2, 10), ["i"], ["kappa"], 5),
        f"WITH e AS (SELECT *, x0 AS e0, x1 AS e1, {', '.join(q)} FROM ({FIG8_SQL})), k AS ({knn_sql('e', V.columns('e', 6), 10)}), r AS (SELECT k.i, {V.dot(dx, ua)} AS t, {V.dot(['(-a.u1)', 'a.u0'], ub)} * {along} AS c, exp(-{V.dot(dx, dx)} / {num(0.25)} - 2 * greatest(1 - {along} * {along}, 0) / {num(0.25)}) AS w FROM k JOIN e a ON k.i = a.i JOIN e b ON k.j = b.i) SELECT i, {V.shown('sum(w * t * c) / (sum(w * t * t) * (1 + 1e-12))', 'kappa', 5)} FROM r GROUP BY i")
    add("curve_fit_fig8", lambda s, d: _rounded(calculus.curve_fit(neighbors.knn_edges(_fig8(s), X2, 8), _fig8(s), X2, U2), ["i"], ["kappa"], 5),
        f"{FIG8_K}, r AS (SELECT k.i, {V.dot(dx, ua)} AS s, {V.dot(dx, ['(-a.u1)', 'a.u0'])} AS z FROM k JOIN e a ON k.i = a.i JOIN e b ON k.j = b.i) SELECT i, {V.shown('2 * abs(sum(s * s * z) / sum(s * s * s * s))', 'kappa', 5)} FROM r GROUP BY i")
    add("surface_curvature_sphere", lambda s, d: lift.surface_curvature(G.surface_points(s, "sphere", 30, 16, "random"), X3, N3, 15), None)
    fw = f"{FIG8_K}, {LOCAL_SQL}"
    add("gradient_fig8", lambda s, d: _rounded(calculus.line_gradient(_fig8_weights(s)[1], _fig8(s), X2, U2, "x0"), ["i"], ["g0", "g1"]),
        f"{fw}, r AS (SELECT w.i, w.w, {V.dot(dx, ua)} AS s, b.x0 - a.x0 AS df FROM w JOIN e a ON w.i = a.i JOIN e b ON w.j = b.i), g AS (SELECT i, sum(w * s * df) / sum(w * s * s) AS m FROM r GROUP BY i) SELECT e.i, {V.shown('m * u0', 'g0')}, {V.shown('m * u1', 'g1')} FROM g JOIN e ON g.i = e.i")
    add("divergence_fig8", lambda s, d: _rounded(calculus.edge_divergence(_fig8_weights(s)[1], _fig8(s), X2, U2), ["i"], ["div"]),
        f"{fw} SELECT w.i, {V.shown('sum(w.w * ' + V.dot(['((a.u0 + b.u0) / 2)', '((a.u1 + b.u1) / 2)'], dx) + ')', 'div')} FROM w JOIN e a ON w.i = a.i JOIN e b ON w.j = b.i GROUP BY w.i")
    add("time_step_fig8", lambda s, d: _rounded(heat.time_step(_fig8_weights(s)[1], _fig8(s), X2), [], ["t"]), f"{fw} SELECT {V.shown('pow(avg(sqrt(' + V.dot(dx, dx) + ')), 2)', 't')} FROM w JOIN e a ON w.i = a.i JOIN e b ON w.j = b.i WHERE w.i <> w.j AND w.w > 0")
    add("mass_fig8", lambda s, d: _rounded(heat.mass(_fig8_weights(s)[1], _fig8(s), X2, 1), ["i"], ["m"]), f"{fw} SELECT w.i, {V.shown('2 * median(sqrt(' + V.dot(dx, dx) + ')) / count(*)', 'm')} FROM w JOIN e a ON w.i = a.i JOIN e b ON w.j = b.i GROUP BY w.i")
    add("heat_distance_circle", lambda s, d: _heat_circle(s), None)
    add("local_pca_torus", lambda s, d: _pca(s), None)

    # frames and subspaces
    e1, e2 = frames.frame_terms(N3)
    add("frames_torus", lambda s, d: _rounded(TORUS_DF(s).select("i", *[F.expr(t).alias(f"{p}{k}") for p, ts in (("e", e1), ("f", e2)) for k, t in enumerate(ts)]), ["i"], V.columns("e", 3) + V.columns("f", 3)),
        f"SELECT i, {', '.join(V.shown(t, f'{p}{k}') for p, ts in (('e', e1), ('f', e2)) for k, t in enumerate(ts))} FROM ({TORUS_SQL})")
    add("principal_angles_fig8", lambda s, d: _rounded(_fig8(s).alias("a").join(_fig8(s).alias("b"), F.col("b.i") == F.col("a.i") + 7).select(F.col("a.i").alias("i"), F.expr(frames.angle(ua, ub)).alias("angle"), F.expr(frames.chordal(f"{along} * {along}", 1)).alias("chordal")), ["i"], ["angle", "chordal"]),
        f"WITH e AS ({FIG8_SQL}) SELECT a.i, {V.shown(f'acos(least(1, abs({along})))', 'angle')}, {V.shown(f'sqrt(greatest(1 - {along} * {along}, 0))', 'chordal')} FROM e a JOIN e b ON b.i = a.i + 7")

    # clusters
    edge = "SELECT a.i, b.i AS j FROM e a JOIN e b ON a.i <> b.i AND " + d2 + f" <= {num(0.0151**2)}"
    add("components_part", lambda s, d: cluster.radius_components(_parts(s, d), X2, 0.0151),
        f"WITH RECURSIVE e AS ({PART_SQL}), l AS ({edge}), r AS (SELECT i, i AS root FROM e UNION SELECT l.j, r.root FROM r JOIN l ON l.i = r.i) SELECT i, min(root) AS root FROM r GROUP BY i")
    add("dbscan_part", lambda s, d: cluster.dbscan(_parts(s, d), X2, 0.0151, 5),
        f"WITH RECURSIVE e AS ({PART_SQL}), l AS ({edge}), c AS (SELECT i FROM l GROUP BY i HAVING count(*) >= 4), lc AS (SELECT l.i, l.j FROM l JOIN c ON l.i = c.i JOIN c d ON l.j = d.i), r AS (SELECT i, i AS root FROM c UNION SELECT lc.j, r.root FROM r JOIN lc ON lc.i = r.i), m AS (SELECT i, min(root) AS root FROM r GROUP BY i), b AS (SELECT l.i, min(m.root) AS root FROM l JOIN m ON l.j = m.i WHERE l.i NOT IN (SELECT i FROM c) GROUP BY l.i) SELECT e.i, coalesce(m.root, b.root, -1) AS label FROM e LEFT JOIN m ON e.i = m.i LEFT JOIN b ON e.i = b.i")
    add("spectral_two_rings", lambda s, d: _two_rings(s), None)

    # aggregates, windows, metrics
    add("error_metrics", lambda s, d: _rounded(calculus.metrics(s.read.parquet(f"{d}/lineitem.parquet"), "l_quantity", "l_discount"), [], ["corr", "rel_rmse", "med_abs"]),
        f"SELECT {V.shown('corr(l_quantity, l_discount)', 'corr')}, {V.shown('sqrt(avg((l_discount - l_quantity) * (l_discount - l_quantity))) / stddev_pop(l_quantity)', 'rel_rmse')}, {V.shown('median(abs(l_discount - l_quantity))', 'med_abs')} FROM lineitem")
    add("event_gaps", lambda s, d: s.sql("SELECT user_id, count(*) AS n, round(avg(gap), 3) + CAST(0 AS DOUBLE) AS gap FROM (SELECT user_id, CAST(unix_micros(CAST(ts AS TIMESTAMP)) - unix_micros(CAST(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS TIMESTAMP)) AS DOUBLE) / 1e6 AS gap FROM {e}) GROUP BY user_id", e=s.read.parquet(f"{d}/events.parquet")),
        "SELECT user_id, count(*) AS n, round(avg(gap), 3) + CAST(0 AS DOUBLE) AS gap FROM (SELECT user_id, CAST(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS DOUBLE) / 1e6 AS gap FROM events) GROUP BY user_id")

    # meshes: the cube's sampled corners as a triangle soup
    tri = f"SELECT i AS face_id, {', '.join(f'{v}{k}' for v in 'abc' for k in range(3))} FROM (SELECT e.i, " + ", ".join([f"e.x{k} AS a{k}" for k in range(3)] + [f"f.x{k} AS b{k}" for k in range(3)] + [f"g.x{k} AS c{k}" for k in range(3)]) + " FROM {t} e JOIN {t} f ON f.i = e.i + 1 JOIN {t} g ON g.i = e.i + 12)"

    def triangles(s: SparkSession) -> DataFrame:
        return s.sql(tri, t=TORUS_DF(s))

    a, b, c = (V.columns(v, 3) for v in "abc")
    m = V.cross(V.minus(b, a), V.minus(c, a))
    tri_sql = tri.replace("{t}", "e").replace("FROM e e", "FROM e")
    add("tri_area_normals", lambda s, d: _rounded(mesh.face_geometry(triangles(s)), ["face_id"], ["area", *N3]),
        f"WITH e AS ({TORUS_SQL}), t AS ({tri_sql}), m AS (SELECT face_id, {V.named(m, 'm')} FROM t), l AS (SELECT *, sqrt(m0*m0+m1*m1+m2*m2) AS len FROM m) SELECT face_id, {V.shown('len / 2', 'area')}, " + ", ".join(V.shown(f"m{k} / len", f"n{k}") for k in range(3)) + " FROM l WHERE len > 1e-12")
    add("vertex_merge", lambda s, d: _rounded(mesh.merge_vertices(TORUS_DF(s), 0.5), ["k0", "k1", "k2", "n"], X3),
        f"WITH e AS ({TORUS_SQL}) SELECT " + ", ".join(f"CAST(round_even(x{k} / {num(0.5)}, 0) AS BIGINT) AS k{k}" for k in range(3)) + f", count(*) AS n, {', '.join(V.shown(f'avg(x{k})', f'x{k}') for k in range(3))} FROM e GROUP BY 1, 2, 3")
    add("mesh_samples", lambda s, d: mesh.sample_faces(triangles(s), 500), None)
    return out


def _rewrites() -> dict[str, tuple[Query, str | None]]:
    out: dict[str, tuple[Query, str | None]] = {}

    def add(name: str, query: Query, sql: str | None = None) -> None:
        out[name] = (query, sql)

    line = "greatest(1 - pow(e.u0 * q.u0 + e.u1 * q.u1, 2), 0)"
    d2 = V.dist2(["e.x0", "e.x1"], ["q.x0", "q.x1"])
    add("distance_fields_fig8", lambda s, d: _rounded(rewrites.distance_fields(_fig8(s), X2, U2, 17), ["i"], ["euclid", "product"]),
        f"WITH e AS ({FIG8_SQL}) SELECT e.i, {V.shown(f'sqrt({d2})', 'euclid')}, {V.shown(f'sqrt({d2} + {line})', 'product')} FROM e, e q WHERE q.i = 17")
    add("closest_part", lambda s, d: rewrites.closest(_parts(s, d), "x1", 25).select("i"), f"WITH e AS ({PART_SQL}) SELECT i FROM e ORDER BY x1, i LIMIT 25")
    add("clamp_prices", lambda s, d: _rounded(rewrites.clamp(_parts(s, d), "x1", 5.0, False), ["i"], ["x1"]),
        f"WITH e AS ({PART_SQL}), b AS (SELECT quantile_cont(x1, 0.95) AS hi FROM e) SELECT i, {V.shown('greatest(0, least(hi, x1))', 'x1')} FROM e, b")
    add("rotate_torus", lambda s, d: _rounded(rewrites.rotate(TORUS_DF(s), X3, [0, 0, 1], 0.5), ["i"], X3),
        f"WITH e AS ({TORUS_SQL}) SELECT i, {V.shown(f'x0 * cos({num(0.5)}) - x1 * sin({num(0.5)})', 'x0')}, {V.shown(f'x0 * sin({num(0.5)}) + x1 * cos({num(0.5)})', 'x1')}, {V.shown('x2', 'x2')} FROM e")
    add("level_bounds_part", lambda s, d: _rounded(rewrites.level_bounds(_parts(s, d), "x1", 4), ["level"], ["bound"]),
        f"WITH e AS ({PART_SQL}) SELECT range AS level, {V.shown('(SELECT min(x1) FROM e) + ((SELECT max(x1) FROM e) - (SELECT min(x1) FROM e)) * range / 4', 'bound')} FROM range(5)")
    add("finite_torus", lambda s, d: _rounded(rewrites.finite(TORUS_DF(s), X3, N3), ["i"], N3), f"SELECT i, {_shown(N3)} FROM ({TORUS_SQL})")
    add("blades_torus", lambda s, d: _rounded(TORUS_DF(s).select("i", *[F.expr(t).alias(f"b{i}{j}") for (i, j), t in frames.blade(X3, N3).items()]), ["i"], ["b01", "b02", "b12"]),
        f"SELECT i, {V.shown('x0 * n1 - x1 * n0', 'b01')}, {V.shown('x0 * n2 - x2 * n0', 'b02')}, {V.shown('x1 * n2 - x2 * n1', 'b12')} FROM ({TORUS_SQL})")
    add("chord_length_helix", lambda s, d: _rounded(reconstruct.chord_length(G.curve_points(s, "helix", 200), X3), ["i"], ["s"]),
        f"WITH e AS ({G.curve_sql(curves()['helix'], 200, ids=_ids(200))}), k AS (SELECT i, coalesce(sqrt(pow(x0 - lag(x0) OVER w, 2) + pow(x1 - lag(x1) OVER w, 2) + pow(x2 - lag(x2) OVER w, 2)), 0) AS k FROM e WINDOW w AS (ORDER BY i)) SELECT i, {V.shown('sum(k) OVER (ORDER BY i) / (SELECT sum(k) FROM k)', 's')} FROM k")
    # steps without SQL: modifiers, iterated lifts, splines, networks
    add("point_noise", lambda s, d: rewrites.point_noise(TORUS_DF(s), X3, 0.01))
    add("flip_normals", lambda s, d: rewrites.flip(TORUS_DF(s), [N3]))
    add("silhouette_torus", lambda s, d: mesh.silhouette(TORUS_DF(s).withColumns({"iu": F.floor(F.col("i") / TORUS[1]), "iv": F.col("i") % TORUS[1]}), (0.0, 1.0, 1.0)))
    add("iterated_lift", lambda s, d: levels.invariants(levels.iterate(_fig8(s).select("i", F.array(*X2).alias("e"), F.array(*U2).alias("u")), 1, 2, 8)[2], 1))
    add("bspline_eval", lambda s, d: reconstruct.evaluate(s, reconstruct.fit_spline(G.curve_points(s, "helix", 120), X3), 400))
    add("implicit_projection", lambda s, d: _implicit(s))
    return out


def _implicit(spark: SparkSession) -> DataFrame:
    p = G.curve_points(spark, "circle", 200).withColumns({"n0": F.col("x0"), "n1": F.col("x1")})
    return implicit.project(rewrites.point_noise(p, X2, 0.05), X2, implicit.fit(p, X2, V.columns("n", 2), epochs=600))


def _heat_circle(spark: SparkSession) -> DataFrame:
    p = G.curve_points(spark, "circle", 120)
    e = neighbors.knn_edges(p, X2, 4)
    return _rounded(heat.heat_distance(kernels.symmetrize(kernels.weigh(e)), p, X2, 0, 1), ["i"], ["distance"])


def _pca(spark: SparkSession) -> DataFrame:
    p, e = _torus_edges(spark)
    return calculus.local_pca(e, p, X3)


def _two_rings(spark: SparkSession) -> DataFrame:
    one = G.curve_points(spark, "circle", 60)
    two = one.select((F.col("i") + 60).alias("i"), "t", (F.col("x0") * 3).alias("x0"), (F.col("x1") * 3).alias("x1"), "u0", "u1")
    w = kernels.symmetrize(kernels.weigh(neighbors.knn_edges(one.unionByName(two), X2, 4)))
    return cluster.spectral(kernels.laplacian(w, True), 2, 3)


@lru_cache(maxsize=1)
def _all() -> dict[str, tuple[Query, str | None]]:
    return _relational() | _rewrites() | _catalogue() | more() | tables()


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
