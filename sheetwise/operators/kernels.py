"""Affinities and graph Laplacians as edge tables (i, j, w)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.functions import vectors as V
from sheetwise.operators.neighbors import pair_up
from sheetwise.plans.lineage import cut


def local_bandwidths(edges: DataFrame, d2: str = "d2") -> DataFrame:
    """(i, h): the largest neighbour distance; where that is 0, the median of all positive ones, or 1."""
    h = edges.groupBy("i").agg(F.sqrt(F.max(d2)).alias("h"))
    fallback = edges.agg(F.coalesce(F.median(F.when(F.col(d2) > 0, F.sqrt(d2))), F.lit(1.0)).alias("m"))
    return h.crossJoin(fallback).select("i", F.when(F.col("h") > 0, F.col("h")).otherwise(F.col("m")).alias("h"))  # one row of fallback


def median_bandwidth(edges: DataFrame, d2: str = "d2") -> DataFrame:
    return edges.agg(F.coalesce(F.median(F.when(F.col(d2) > 0, F.sqrt(d2))), F.lit(1.0)).alias("h"))


def weigh(edges: DataFrame, h: str | float = "local", d2: str = "d2") -> DataFrame:
    """(i, j, w) with w = exp(-d2 / (h_i h_j)), or one bandwidth: a number or 'median'."""
    if h == "local":
        hs = local_bandwidths(edges, d2)
        both = edges.join(hs.withColumnRenamed("h", "hi"), "i").join(hs.select(F.col("i").alias("j"), F.col("h").alias("hj")), "j", "left")
        # a point without neighbours of its own has no bandwidth; the other end's then counts
        return both.select("i", "j", F.exp(-F.col(d2) / (F.col("hi") * F.coalesce("hj", "hi"))).alias("w"))
    if h == "median":
        return edges.crossJoin(F.broadcast(median_bandwidth(edges, d2))).select("i", "j", F.exp(-F.col(d2) / (F.col("h") * F.col("h"))).alias("w"))
    if not float(h) > 0:
        raise ValueError("a bandwidth must be positive")
    return edges.select("i", "j", F.exp(-F.col(d2) / F.lit(float(h) ** 2)).alias("w"))


def symmetrize(weights: DataFrame, how: str = "max") -> DataFrame:
    """The larger ('max') or the mean ('mean') of w_ij and w_ji, an absent one being 0."""
    both = weights.unionAll(weights.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    return both.groupBy("i", "j").agg((F.max("w") if how == "max" else F.sum("w") / 2).alias("w"))


def uniform(edges: DataFrame) -> DataFrame:
    return symmetrize(edges.select("i", "j", F.lit(1.0).alias("w")))


def product(edges: DataFrame, points: DataFrame, x: Sequence[str], blocks: Sequence[Sequence[str]], sigma_x: float | None = 0.5, sigma_u: float | None = 0.5) -> DataFrame:
    """Spatial Gaussian times one Gaussian for each block of direction columns; None picks self-tuning bandwidths."""
    cols = [*x, *[c for b in blocks for c in b]]
    both = pair_up(edges.select("i", "j"), points, cols)
    parts = [F.expr(V.dist2([f"a_{c}" for c in b], [f"b_{c}" for c in b])) for b in (x, *blocks)]
    both = both.select("i", "j", *[p.alias(f"p{k}") for k, p in enumerate(parts)])
    w: Column = F.lit(1.0)
    for k in range(len(parts)):
        sigma = sigma_x if k == 0 else sigma_u
        if sigma is None:
            hs = local_bandwidths(both, f"p{k}")
            both = both.join(hs.withColumnRenamed("h", f"hi{k}"), "i").join(hs.select(F.col("i").alias("j"), F.col("h").alias(f"hj{k}")), "j")
            w = w * F.exp(-F.col(f"p{k}") / (F.col(f"hi{k}") * F.col(f"hj{k}")))
        else:
            w = w * F.exp(-F.col(f"p{k}") / F.lit(float(sigma) ** 2))
    return symmetrize(both.select("i", "j", w.alias("w")))


def bilateral(edges: DataFrame, points: DataFrame, x: Sequence[str], normals: Sequence[str]) -> DataFrame:
    """Spatial times normal Gaussian with median bandwidths, symmetrised by the mean."""
    both = pair_up(edges.select("i", "j"), points, [*x, *normals])
    both = cut(both.select("i", "j", *[F.expr(V.dist2([f"a_{c}" for c in b], [f"b_{c}" for c in b])).alias(n) for n, b in (("px", x), ("pn", normals))]))
    hx, hn = median_bandwidth(both, "px").withColumnRenamed("h", "hx"), median_bandwidth(both, "pn").withColumnRenamed("h", "hn")
    both = both.crossJoin(F.broadcast(hx)).crossJoin(F.broadcast(hn))  # one row each
    return symmetrize(both.select("i", "j", F.exp(-F.col("px") / (F.col("hx") * F.col("hx")) - F.col("pn") / (F.col("hn") * F.col("hn"))).alias("w")), "mean")


def degrees(weights: DataFrame) -> DataFrame:
    return weights.groupBy("i").agg(F.sum("w").alias("deg"))


def laplacian(weights: DataFrame, normalized: bool = False, eps: float = 1e-12) -> DataFrame:
    """(i, j, v): D - W, or I - D^-1/2 W D^-1/2 with 0 for vertices of degree up to eps."""
    deg = degrees(weights)
    if not normalized:
        return weights.groupBy("i", "j").agg(F.sum(-F.col("w")).alias("v")).unionByName(deg.select("i", F.col("i").alias("j"), F.col("deg").alias("v"))).groupBy("i", "j").agg(F.sum("v").alias("v"))
    inverse = F.when(F.col("deg") > eps, 1 / F.sqrt("deg")).otherwise(0.0)
    s = deg.select("i", inverse.alias("s"))
    both = weights.join(s.withColumnRenamed("s", "si"), "i").join(s.select(F.col("i").alias("j"), F.col("s").alias("sj")), "j")
    off = both.select("i", "j", (-F.col("w") * F.col("si") * F.col("sj")).alias("v"))
    return off.unionByName(deg.select("i", F.col("i").alias("j"), F.lit(1.0).alias("v"))).groupBy("i", "j").agg(F.sum("v").alias("v"))


def cross_fraction(weights: DataFrame, labels: DataFrame) -> DataFrame:
    """The share of weight between points of different labels."""
    both = weights.join(labels.select("i", F.col("label").alias("gi")), "i").join(labels.select(F.col("i").alias("j"), F.col("label").alias("gj")), "j")
    return both.agg((F.sum(F.when(F.col("gi") != F.col("gj"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("fraction"))
