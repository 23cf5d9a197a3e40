"""Curve reconstruction: B-splines through ordered points, evaluated in parallel."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows of the banded system that are eliminated together on the driver; its memory grows with the points, not their square.
BLOCK = 128


@dataclass(frozen=True)
class Spline:
    knots: np.ndarray
    controls: np.ndarray
    degree: int


def chord_length(points: DataFrame, x: Sequence[str]) -> DataFrame:
    """points with s in [0, 1]: length along the curve in the order of i, over the whole."""
    w = W.orderBy("i")  # a curve is one ordered sequence
    step = F.sqrt(sum((F.pow(F.col(c) - F.lag(c).over(w), 2) for c in x), F.lit(0.0)))
    run = points.withColumn("_d", F.coalesce(step, F.lit(0.0))).withColumn("_s", F.sum("_d").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return run.crossJoin(F.broadcast(run.agg(F.max("_s").alias("_all")))).withColumn("s", F.when(F.col("_all") > 0, F.col("_s") / F.col("_all")).otherwise(0.0)).drop("_d", "_s", "_all")


def basis(knots: np.ndarray, degree: int, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, values): the degree + 1 B-splines that can differ from 0 at each s, from number `first` on, by the recurrence over degrees."""
    n = len(knots) - degree - 1
    s = np.clip(s, knots[degree], knots[n])
    span = np.clip(np.searchsorted(knots, s, side="right") - 1, degree, n - 1)
    b = np.zeros((len(s), degree + 1))
    b[:, 0] = 1
    for p in range(1, degree + 1):
        carried = np.zeros(len(s))
        for k in range(p):
            right, left = knots[span + k + 1], knots[span + k + 1 - p]
            part = b[:, k] / (right - left)
            b[:, k] = carried + (right - s) * part
            carried = (s - left) * part
        b[:, p] = carried
    return span - degree, b


def collocate(knots: np.ndarray, degree: int, s: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The control points whose spline takes the values p at s.

    Row r of the system has entries within `degree` columns of r, so blocks of rows
    only meet their neighbours and are eliminated one after the other.
    """
    first, b = basis(knots, degree, s)
    n, m = len(s), max(BLOCK, degree)
    edges = [*range(0, n, m), n]
    upper, right = [], []
    for lo, hi in zip(edges, edges[1:]):
        before, after = max(lo - m, 0), min(hi + m, n)
        rows = np.zeros((hi - lo, after - before))
        np.put_along_axis(rows, first[lo:hi, None] - before + np.arange(degree + 1), b[lo:hi], axis=1)
        left, here, far = rows[:, : lo - before], rows[:, lo - before : hi - before], rows[:, hi - before :]
        value = p[lo:hi]
        if lo:
            here, value = here - left @ upper[-1][:, : hi - lo], value - left @ right[-1]
        solved = np.linalg.solve(here, np.concatenate([far, value], axis=1))
        upper.append(solved[:, : far.shape[1]])
        right.append(solved[:, far.shape[1] :])
    for k in range(len(right) - 2, -1, -1):
        right[k] = right[k] - upper[k] @ right[k + 1]
    return np.concatenate(right)


def fit_spline(points: DataFrame, x: Sequence[str], degree: int = 3) -> Spline:
    """The spline through all points in the order of i, knots at averaged chord lengths."""
    rows = chord_length(points, x).orderBy("i").select("s", *x).toPandas()
    rows = rows[~rows["s"].duplicated()]
    if len(rows) <= degree:
        raise ValueError("a spline needs more distinct points than its degree")
    s, p = rows["s"].to_numpy(), rows[list(x)].to_numpy()
    inner = sum(s[1 + k : len(s) - degree + k] for k in range(degree)) / degree
    knots = np.concatenate([np.full(degree + 1, s[0]), inner, np.full(degree + 1, s[-1])])
    return Spline(knots, collocate(knots, degree, s, p), degree)


def evaluate(spark: SparkSession, spline: Spline, n: int) -> DataFrame:
    """(i, s, x0..): n even parameters of the spline."""
    dims = spline.controls.shape[1]

    def run(batches):
        for pdf in batches:
            s = spline.knots[0] + pdf.id.to_numpy() / max(n - 1, 1) * (spline.knots[-1] - spline.knots[0])
            first, b = basis(spline.knots, spline.degree, s)
            at = sum(b[:, k, None] * spline.controls[first + k] for k in range(spline.degree + 1))
            yield pd.DataFrame({"i": pdf.id, "s": s, **{f"x{k}": at[:, k] for k in range(dims)}})

    return spark.range(n).mapInPandas(run, "i bigint, s double, " + ", ".join(f"x{k} double" for k in range(dims)))
