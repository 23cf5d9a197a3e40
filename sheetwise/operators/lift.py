"""Lifting: curvature from the change of tangent planes among neighbours in the lifted metric.

A curve (d = 1) or a surface in space (d = 2) needs no matrix solver: the symmetric
ridge regression of plane changes on tangent steps has a closed form, a quotient for
d = 1 and a Lyapunov equation in the eigenbasis of a 2 x 2 matrix for d = 2.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.functions import vectors as V
from sheetwise.functions.symbolic import num
from sheetwise.operators.neighbors import knn_edges, pair_up


def projector(u: Sequence[str]) -> list[str]:
    """Entries of u uT, row by row."""
    return [f"(({a}) * ({b}))" for a in u for b in u]


def embedded(points: DataFrame, x: Sequence[str], p: Sequence[str], alpha: float = 1.0) -> DataFrame:
    """Adds e0..: position and scaled projector entries, the metric of the lift."""
    by = (alpha / 2) ** 0.5
    terms = [*x, *[f"({c}) * {num(by)}" for c in p]]
    return points.select("*", *[F.expr(t).alias(f"e{k}") for k, t in enumerate(terms)])


def lift_curve(points: DataFrame, x: Sequence[str], u: Sequence[str], k: int = 20, alpha: float = 1.0, sigma_x: float = 0.5, sigma_u: float = 0.5) -> DataFrame:
    """(i, kappa, w0.., ): signed curvature of a plane curve and its lifted unit tangent."""
    n = len(x)
    level = embedded(points.select("*", *[F.expr(t).alias(f"q{m}") for m, t in enumerate(projector(u))]), x, V.columns("q", n * n), alpha)
    dims = V.columns("e", n + n * n)
    # the grid join takes positions; lifted distances are never smaller, so it is run on the lifted columns themselves
    both = pair_up(_lifted_edges(level, dims, k), level, [*x, *u])
    dx = V.minus([f"b_{c}" for c in x], [f"a_{c}" for c in x])
    ua, ub = [f"a_{c}" for c in u], [f"b_{c}" for c in u]
    normal = [f"(-{ua[1]})", ua[0]]
    along = V.dot(ub, ua)
    step, turn = V.dot(dx, ua), f"({V.dot(normal, ub)} * {along})"
    plane = f"(2 * greatest(1 - {along} * {along}, 0))"
    w = f"exp(-{V.dot(dx, dx)} / {num(sigma_x**2)} - {plane} / {num(sigma_u**2)})"
    rows = both.select("i", F.expr(step).alias("t"), F.expr(turn).alias("c"), F.expr(w).alias("w"))
    return rows.groupBy("i").agg((F.sum(F.expr("w * t * c")) / (F.sum(F.expr("w * t * t")) * (1 + 1e-12))).alias("kappa"))


def _lifted_edges(level: DataFrame, dims: Sequence[str], k: int) -> DataFrame:
    from sheetwise.operators.neighbors import knn_vectors

    return knn_vectors(level.select("i", F.array(*dims).alias("x")), "x", k) if len(dims) > 3 else knn_edges(level, dims, k)


def surface_curvature(points: DataFrame, x: Sequence[str], n: Sequence[str], k: int = 25, alpha: float = 1.0, sigma_x: float = 0.5, sigma_u: float = 0.5) -> DataFrame:
    """(i, gauss, mean_abs, total): curvatures of an oriented surface in space from the lift's shape operator."""
    from sheetwise.operators.frames import frame_terms

    q = [f"({'1' if a == b else '0'} - {n[a]} * {n[b]})" for a in range(3) for b in range(3)]
    level = embedded(points.select("*", *[F.expr(t).alias(f"q{m}") for m, t in enumerate(q)]), x, V.columns("q", 9), alpha)
    both = pair_up(_lifted_edges(level, V.columns("e", 12), k), level, [*x, *n])
    na, nb = [f"a_{c}" for c in n], [f"b_{c}" for c in n]
    e1, e2 = frame_terms(na)
    dx = V.minus([f"b_{c}" for c in x], [f"a_{c}" for c in x])
    both = both.select("i", *[F.expr(t).alias(m) for m, t in zip("pqrs", (V.dot(dx, e1), V.dot(dx, e2), V.dot(nb, e1), V.dot(nb, e2)))], F.expr(V.dot(na, nb)).alias("c"), F.expr(V.dot(dx, dx)).alias("d2"))
    # the plane change in the normal direction: n.(P_j - P_i) e_a = -(n.n_j)(n_j.e_a)
    w = F.expr(f"exp(-d2 / {num(sigma_x**2)} - 2 * greatest(1 - c * c, 0) / {num(sigma_u**2)})")
    s = both.withColumn("w", w).groupBy("i").agg(
        *[F.sum(F.expr(f"w * {t}")).alias(m) for m, t in (("t11", "p * p"), ("t12", "p * q"), ("t22", "q * q"), ("r11", "-p * c * r"), ("r12", "-p * c * s"), ("r21", "-q * c * r"), ("r22", "-q * c * s"))]
    )
    # T = V diag(l, m) V^T; B_ab = sym(V^T R V)_ab / ((l_a + l_b) / 2)
    s = s.withColumn("th", F.expr("0.5 * atan2(2 * t12, t11 - t22)"))
    s = s.selectExpr("*", "cos(th) AS co", "sin(th) AS si").selectExpr("*", "t11*co*co + 2*t12*co*si + t22*si*si AS l", "t11*si*si - 2*t12*co*si + t22*co*co AS m")
    s = s.selectExpr(
        "i",
        "(r11*co*co + (r12+r21)*co*si + r22*si*si) / (l + 1e-12*(l+m)/2) AS b11",
        "(r11*si*si - (r12+r21)*co*si + r22*co*co) / (m + 1e-12*(l+m)/2) AS b22",
        "((r22-r11)*co*si + 0.5*(r12+r21)*(co*co - si*si)) / ((l+m)/2 * (1 + 1e-12)) AS b12",
    )
    return s.selectExpr("i", "b11*b22 - b12*b12 AS gauss", "abs(b11 + b22) / 2 AS mean_abs", "sqrt(b11*b11 + 2*b12*b12 + b22*b22) AS total")
