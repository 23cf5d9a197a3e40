"""Table-valued generators: parameter samplers, and clouds of points on catalogue shapes.

Every generator is `spark.range` plus column expressions, so it scales with the
number of partitions. Random samplers use low-discrepancy sequences, which any
engine reproduces.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.functions import vectors as V
from sheetwise.functions.symbolic import num
from sheetwise.sources.catalogue import Curve, Surface, curves, surfaces

#: Additive steps of the one- and two-dimensional sequences.
PHI, PLASTIC = 0.6180339887498949, 0.7548776662466927


def seq(step: float) -> str:
    return f"(i * {num(step)} - floor(i * {num(step)}))"


def parameter(kind: str, n: int, lo: float, hi: float, endpoint: bool = True, unit: str = "i") -> str:
    """SQL of the i-th parameter of a sampler over [lo, hi]."""
    lo, hi = float(lo), float(hi)
    if kind == "uniform":
        return f"({num(lo)} + {unit} * {num((hi - lo) / max(n - 1 if endpoint else n, 1))})"
    if kind == "random":
        return f"({num(lo)} + {num(hi - lo)} * {seq(PHI)})"
    if kind == "jittered":
        return f"({num(lo)} + {num((hi - lo) / n)} * ({unit} + {seq(PHI)}))"
    if kind == "chebyshev":  # ascending
        return f"({num((lo + hi) / 2)} - {num((hi - lo) / 2)} * cos((2 * {unit} + 1) * {num(pi / (2 * n))}))"
    raise ValueError(f"no sampler {kind}")


def curve_sql(curve: Curve, n: int, kind: str = "uniform", endpoint: bool = False, ids: str = "ids") -> str:
    """SELECT of i, t, x0.., u0.. (unit tangent) over a table `ids` of 0..n-1."""
    inner = f"SELECT i, {parameter(kind, n, *curve.domain, endpoint)} AS t FROM {ids}"
    tangent = V.unit([d.sql() for d in curve.derivative()])
    return f"SELECT i, t, {V.named([p.sql() for p in curve.position], 'x')}, {V.named(tangent, 'u')} FROM ({inner}) p"


def surface_sql(surface: Surface, nu: int, nv: int, kind: str = "uniform", ids: str = "ids") -> str:
    """SELECT of i, u, v, x0..x2, n0..n2 (unit normal) over a table `ids` of 0..nu*nv-1; rows without a normal are left out."""
    if kind == "random":
        us, vs = f"({num(surface.u[0])} + {num(surface.u[1] - surface.u[0])} * {seq(PHI)})", f"({num(surface.v[0])} + {num(surface.v[1] - surface.v[0])} * {seq(PLASTIC)})"
    else:
        us = parameter(kind, nu, *surface.u, endpoint=False, unit=f"floor(i / {num(nv)})")
        vs = parameter(kind, nv, *surface.v, unit=f"(i - {nv} * floor(i / {num(nv)}))")
    inner = f"SELECT i, {us} AS u, {vs} AS v FROM {ids}"
    normal = V.cross([d.sql() for d in surface.derivative("u")], [d.sql() for d in surface.derivative("v")])
    mapped = f"SELECT i, u, v, {V.named([p.sql() for p in surface.position], 'x')}, {V.named(normal, 'm')} FROM ({inner}) p"
    m = V.columns("m", 3)
    return f"SELECT i, u, v, x0, x1, x2, {V.named(V.unit(m), 'n')} FROM ({mapped}) q WHERE {V.norm(m)} > 1e-8"


def _ids(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"))


def curve_points(spark: SparkSession, name: str, n: int, kind: str = "uniform") -> DataFrame:
    return spark.sql(curve_sql(curves()[name], n, kind, ids="{ids}"), ids=_ids(spark, n))


def surface_points(spark: SparkSession, name: str, nu: int, nv: int, kind: str = "uniform") -> DataFrame:
    return spark.sql(surface_sql(surfaces()[name], nu, nv, kind, ids="{ids}"), ids=_ids(spark, nu * nv))
