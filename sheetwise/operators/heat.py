"""The heat method on weighted graphs of points: diffuse, normalise the gradient, integrate it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.functions import vectors as V
from sheetwise.operators.components import components
from sheetwise.operators.kernels import degrees, laplacian
from sheetwise.operators.neighbors import pair_up
from sheetwise.operators.solvers import solve


def time_step(weights: DataFrame, points: DataFrame, x: Sequence[str], scale: float = 1.0) -> DataFrame:
    """One row t: scale times the squared mean length of the edges with weight."""
    both = pair_up(weights.where("w > 0 and i <> j"), points, x)
    d = F.sqrt(F.expr(V.dist2([f"a_{c}" for c in x], [f"b_{c}" for c in x])))
    return both.agg((F.lit(float(scale)) * F.pow(F.avg(d), 2)).alias("t"))


def mass(weights: DataFrame, points: DataFrame, x: Sequence[str], dim: int) -> DataFrame:
    """(i, m): volume of the unit ball times median radius to the dim, over the degree; 0 becomes the median."""
    from math import gamma, pi

    ball = pi ** (dim / 2) / gamma(dim / 2 + 1)
    both = pair_up(weights.where("i <> j"), points, x)
    d = F.sqrt(F.expr(V.dist2([f"a_{c}" for c in x], [f"b_{c}" for c in x])))
    m = both.groupBy("i").agg((F.lit(ball) * F.pow(F.median(d), F.lit(float(dim))) / F.count(F.lit(1))).alias("m"))
    mid = m.agg(F.coalesce(F.median(F.when(F.col("m") > 0, F.col("m"))), F.lit(1.0)).alias("mid"))
    return m.crossJoin(F.broadcast(mid)).select("i", F.when(F.col("m") > 0, F.col("m")).otherwise(F.col("mid")).alias("m"))


def diffuse(weights: DataFrame, masses: DataFrame, source: int, t: float) -> DataFrame:
    """(i, value): one implicit step (M + t L) u = source."""
    lap = laplacian(weights).select("i", "j", (F.col("v") * t).alias("v"))
    system = lap.unionByName(masses.select("i", F.col("i").alias("j"), F.col("m").alias("v"))).groupBy("i", "j").agg(F.sum("v").alias("v"))
    return solve(system, masses.select("i", F.when(F.col("i") == source, 1.0).otherwise(0.0).alias("value")))


def heat_distance(weights: DataFrame, points: DataFrame, x: Sequence[str], source: int, dim: int, scale: float = 1.0) -> DataFrame:
    """(i, distance): geodesic distance from the source; points of other components get 0, as do values below it."""
    t = time_step(weights, points, x, scale).first().t
    u = diffuse(weights, mass(weights, points, x, dim), source, t)
    both = pair_up(weights.where("i <> j"), points.join(u, "i"), [*x, "value"])
    dx = V.minus([f"b_{c}" for c in x], [f"a_{c}" for c in x])
    rows = both.select("i", "w", (F.col("b_value") - F.col("a_value")).alias("du"), *[F.expr(c).alias(f"d{k}") for k, c in enumerate(dx)])
    n = len(x)
    g = rows.groupBy("i").agg(*[F.sum(F.expr(f"w * du * d{k}")).alias(f"r{k}") for k in range(n)])
    field = g.select("i", *[F.expr(f"-{r}").alias(f"f{k}") for k, r in enumerate(V.unit(V.columns("r", n), 1e-300))])
    ends = pair_up(weights.where("i <> j"), points.join(field, "i"), [*x, *V.columns("f", n)])
    along = V.dot([f"(a_f{k} + b_f{k}) / 2" for k in range(n)], V.minus([f"b_{c}" for c in x], [f"a_{c}" for c in x]))
    div = ends.groupBy("i").agg(F.sum(F.expr(f"w * {along}")).alias("value"))
    lap = laplacian(weights)
    part = components(weights.select("i", "j"), points.select("i"))
    own = part.where(F.col("i") == source).select("root")
    inside = part.join(own, "root", "left_semi").select("i")
    # the source row and column leave the system: its distance is 0 and what remains is definite
    free = inside.where(F.col("i") != source)
    system = lap.join(free, "i", "left_semi").join(free.select(F.col("i").alias("j")), "j", "left_semi")
    phi = solve(system, div.join(free, "i", "left_semi").select("i", (-F.col("value")).alias("value")))
    out = phi.unionByName(inside.where(F.col("i") == source).select("i", F.lit(0.0).alias("value")))
    return points.select("i").join(out, "i", "left").select("i", F.greatest("value", F.lit(0.0)).alias("distance"))


def soft_partition(a: DataFrame, b: DataFrame, width: float = 1.0) -> DataFrame:
    """(i, share): sigmoid of the difference of two distance fields."""
    both = a.withColumnRenamed("distance", "da").join(b.withColumnRenamed("distance", "db"), "i")
    return both.select("i", (1 / (1 + F.exp((F.col("da") - F.col("db")) / width))).alias("share"))


__all__ = ["degrees", "diffuse", "heat_distance", "mass", "soft_partition", "time_step"]
