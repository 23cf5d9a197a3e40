"""Discrete calculus, local PCA, fits and accuracy metrics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.functions import vectors as V
from sheetwise.operators.neighbors import pair_up


def line_gradient(weights: DataFrame, points: DataFrame, x: Sequence[str], u: Sequence[str], f: str) -> DataFrame:
    """(i, g0..): weighted least-squares gradient of f along one tangent direction."""
    both = pair_up(weights, points, [*x, *u, f])
    step = V.dot(V.minus([f"b_{c}" for c in x], [f"a_{c}" for c in x]), [f"a_{c}" for c in u])
    rows = both.select("i", *[F.col(f"a_{c}").alias(c) for c in u], "w", F.expr(step).alias("s"), (F.col(f"b_{f}") - F.col(f"a_{f}")).alias("df"))
    slope = F.sum(F.expr("w * s * df")) / F.greatest(F.sum(F.expr("w * s * s")), F.lit(1e-30))
    return rows.groupBy("i").agg(slope.alias("slope"), *[F.first(c).alias(c) for c in u]).select("i", *[(F.col("slope") * F.col(c)).alias(f"g{k}") for k, c in enumerate(u)])


def edge_divergence(weights: DataFrame, points: DataFrame, x: Sequence[str], field: Sequence[str]) -> DataFrame:
    """(i, div): sum over neighbours of w (X_i + X_j) / 2 . (x_j - x_i)."""
    both = pair_up(weights, points, [*x, *field])
    mean = [f"(a_{c} + b_{c}) / 2" for c in field]
    term = V.dot(mean, V.minus([f"b_{c}" for c in x], [f"a_{c}" for c in x]))
    return both.groupBy("i").agg(F.sum(F.expr(f"w * {term}")).alias("div"))


def local_pca(edges: DataFrame, points: DataFrame, x: Sequence[str]) -> DataFrame:
    """(i, values, smallest, largest): eigenvalues ascending and outer eigenvectors of each neighbourhood's covariance, the point included."""
    n = len(x)
    pairs = edges.select("i", "j").unionByName(points.select("i", F.col("i").alias("j")))
    at = pairs.join(points.select(F.col("i").alias("j"), *x), "j")
    moments = at.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.covar_pop(F.col(a), F.col(b)) for a in x for b in x]).alias("cov"))

    def eig(batches):
        for pdf in batches:
            c = np.stack(pdf["cov"].to_numpy()).reshape(-1, n, n) if len(pdf) else np.zeros((0, n, n))
            w, v = np.linalg.eigh(c)
            yield pd.DataFrame({"i": pdf["i"], "values": list(w), "smallest": list(v[:, :, 0]), "largest": list(v[:, :, -1])})

    return moments.mapInPandas(eig, "i bigint, values array<double>, smallest array<double>, largest array<double>")


def curve_fit(edges: DataFrame, points: DataFrame, x: Sequence[str], u: Sequence[str]) -> DataFrame:
    """(i, kappa): curvature of the parabola through each point, along its tangent, that fits its neighbours."""
    both = pair_up(edges.select("i", "j"), points, [*x, *u])
    dx, ua = V.minus([f"b_{c}" for c in x], [f"a_{c}" for c in x]), [f"a_{c}" for c in u]
    s, z = V.dot(dx, ua), V.dot(dx, [f"(-{ua[1]})", ua[0]])
    rows = both.select("i", F.expr(s).alias("s"), F.expr(z).alias("z"))
    return rows.groupBy("i").agg((2 * F.abs(F.sum(F.expr("s * s * z")) / F.greatest(F.sum(F.expr("s * s * s * s")), F.lit(1e-30)))).alias("kappa"))


def metrics(rows: DataFrame, truth: str, estimate: str) -> DataFrame:
    """One row: correlation, RMSE over the deviation of the truth, median absolute error."""
    gap = F.col(estimate) - F.col(truth)
    return rows.agg(F.corr(truth, estimate).alias("corr"), (F.sqrt(F.avg(gap * gap)) / F.stddev_pop(truth)).alias("rel_rmse"), F.median(F.abs(gap)).alias("med_abs"))
