"""Curvature in closed form from symbolic shapes, and estimates from plain neighbourhoods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.functions import vectors as V
from sheetwise.operators import frames
from sheetwise.operators.neighbors import pair_up
from sheetwise.sources.catalogue import Curve, Surface


def curve_curvature(curve: Curve) -> str:
    """SQL over t of the curvature |x' x x''| / |x'|^3, through the Lagrange identity in any dimension."""
    first = curve.derivative()
    second = [d.diff("t") for d in first]
    a, b = [d.sql() for d in first], [d.sql() for d in second]
    area2 = f"greatest({V.dot(a, a)} * {V.dot(b, b)} - {V.dot(a, b)} * {V.dot(a, b)}, 0)"
    return f"sqrt({area2}) / power({V.dot(a, a)}, 1.5)"


def fundamental_forms(surface: Surface) -> dict[str, str]:
    """SQL over u and v of the coefficients E, F, G of the first and L, M, N of the second form."""
    du, dv = surface.derivative("u"), surface.derivative("v")
    a, b = [d.sql() for d in du], [d.sql() for d in dv]
    n = V.unit(V.cross(a, b))
    second = {"L": [d.diff("u") for d in du], "M": [d.diff("v") for d in du], "N": [d.diff("v") for d in dv]}
    return {"E": V.dot(a, a), "F": V.dot(a, b), "G": V.dot(b, b)} | {k: V.dot([d.sql() for d in ds], n) for k, ds in second.items()}


def surface_curvature_sql(surface: Surface, source: str) -> str:
    """SELECT of i, gauss, mean_abs and total (norm of the second form) over a table with i, u, v."""
    forms = ", ".join(f"{sql} AS c_{k}" for k, sql in fundamental_forms(surface).items())
    det = "(c_E * c_G - c_F * c_F)"
    raw = f"SELECT i, (c_L * c_N - c_M * c_M) / {det} AS gauss, (c_E * c_N - 2 * c_F * c_M + c_G * c_L) / (2 * {det}) AS mean FROM (SELECT i, {forms} FROM {source}) f WHERE {det} > 1e-12"
    return f"SELECT i, gauss, abs(mean) AS mean_abs, {total_from('mean', 'gauss')} AS total FROM ({raw}) k"


def total_from(mean: str, gauss: str) -> str:
    """The norm of the second form from mean and Gauss curvature."""
    return f"sqrt(greatest(4 * ({mean}) * ({mean}) - 2 * ({gauss}), 0))"


def mean_square_from(total: str, gauss: str) -> str:
    """The squared mean curvature from the norm of the second form and Gauss curvature."""
    return f"((({total}) * ({total}) + 2 * ({gauss})) / 4)"


#: The fit of z = a x^2 + b x y + c y^2: sums over neighbours, by Cramer's rule.
MOMENTS = {"m40": "s*s*s*s", "m31": "s*s*s*r", "m22": "s*s*r*r", "m13": "s*r*r*r", "m04": "r*r*r*r", "z20": "z*s*s", "z11": "z*s*r", "z02": "z*r*r"}


def _minor(rows: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = rows
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def quadric_terms() -> dict[str, str]:
    """SQL of the coefficients a, b, c over the sums of MOMENTS; 0 where the system is singular."""
    m, z = [["m40", "m31", "m22"], ["m31", "m22", "m13"], ["m22", "m13", "m04"]], ["z20", "z11", "z02"]
    det = _minor(m)
    return {name: f"(CASE WHEN abs({det}) < 1e-30 THEN 0 ELSE {_minor([[z[r] if q == k else m[r][q] for q in range(3)] for r in range(3)])} / {det} END)" for k, name in enumerate("abc")}


def quadric_curvature(edges: DataFrame, points: DataFrame, x: Sequence[str], n: Sequence[str]) -> DataFrame:
    """(i, mean, gauss, total) of the quadric over each tangent plane that fits its neighbours best."""
    both = pair_up(edges.select("i", "j"), points, [*x, *n])
    an = [f"a_{c}" for c in n]
    e, f = frames.frame_terms(an)
    step = V.minus([f"b_{c}" for c in x], [f"a_{c}" for c in x])
    rows = both.select("i", F.expr(V.dot(step, e)).alias("s"), F.expr(V.dot(step, f)).alias("r"), F.expr(V.dot(step, an)).alias("z"))
    g = rows.groupBy("i").agg(*[F.sum(F.expr(t)).alias(k) for k, t in MOMENTS.items()])
    fit = g.select("i", *[F.expr(t).alias(k) for k, t in quadric_terms().items()])
    return fit.select("i", F.expr("a + c").alias("mean"), F.expr("4 * a * c - b * b").alias("gauss"), F.expr("2 * sqrt(a * a + b * b / 2 + c * c)").alias("total"))


def ambient_gradient(weights: DataFrame, points: DataFrame, x: Sequence[str], value: str, lam: float = 0.0) -> DataFrame:
    """(i, g0, g1): the weighted least-squares gradient in the plane that the cloud lies in.

    The ridge is the larger of lam times the mean diagonal and 1e-12 of the median of all positive ones.
    """
    if len(x) != 2:
        raise ValueError("clouds in the plane")
    both = pair_up(weights.where("i <> j"), points, [*x, value])
    d = V.minus([f"b_{c}" for c in x], [f"a_{c}" for c in x])
    rows = both.select("i", "w", F.expr(d[0]).alias("s"), F.expr(d[1]).alias("r"), (F.col(f"b_{value}") - F.col(f"a_{value}")).alias("df"))
    g = rows.groupBy("i").agg(*[F.sum(F.expr(f"w * {t}")).alias(k) for k, t in (("p", "s * s"), ("q", "s * r"), ("t", "r * r"), ("y", "df * s"), ("z", "df * r"))])
    middle = g.agg(F.coalesce(F.median(F.when(F.expr("p + t > 0"), F.expr("p + t"))), F.lit(2.0)).alias("m"))
    g = g.crossJoin(F.broadcast(middle)).withColumn("ridge", F.expr(f"greatest({lam!r} * (p + t) / 2, 1e-12 * m / 2)"))  # one row of middle
    det = "((p + ridge) * (t + ridge) - q * q)"
    return g.select("i", F.expr(f"((t + ridge) * y - q * z) / {det}").alias("g0"), F.expr(f"((p + ridge) * z - q * y) / {det}").alias("g1"))
