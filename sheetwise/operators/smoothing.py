"""Smoothed B-spline curves of many groups of rows at once, open or periodic.

A curve has `controls` control points over equal spans of its parameter's range. It
minimises the weighted squared distances to its rows plus `smoothing` times the squared
differences of neighbouring control points, taken `order` times. Tasks add up the banded
normal equations of the groups that they meet, so a group with any share of all rows
moves as one small table a task, and only controls * (degree + 1 + dims) numbers of a group meet.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.plans.lineage import cut

#: Up to so many groups, counted first, their ranges are broadcast.
GROUPS = 100_000


def basis(u: np.ndarray, degree: int) -> np.ndarray:
    """The degree + 1 weights of control points at places u in [0, 1] of a span."""
    out = np.ones((len(u), 1))
    for k in range(1, degree + 1):
        new = np.zeros((len(u), k + 1))
        for j in range(k + 1):
            if j:
                new[:, j] += (u + k - j) / k * out[:, j - 1]
            if j < k:
                new[:, j] += (1 - u + j) / k * out[:, j]
        out = new
    return out


def _spans(t: np.ndarray, lo: np.ndarray, hi: np.ndarray, controls: int, degree: int, periodic: bool) -> tuple[np.ndarray, np.ndarray]:
    """(control points, weights) of each parameter."""
    spans = controls if periodic else controls - degree
    wide = np.where(hi > lo, hi - lo, 1.0)
    at = np.clip((t - lo) / wide, 0, 1) * spans
    first = np.minimum(np.floor(at).astype(np.int64), spans - 1)
    which = first[:, None] + np.arange(degree + 1)
    return which % controls if periodic else which, basis(at - first, degree)


def penalty(controls: int, order: int, periodic: bool) -> np.ndarray:
    d = np.eye(controls)
    for _ in range(order):
        d = np.roll(d, -1, axis=0) - d if periodic else np.diff(d, axis=0)
    return d.T @ d


def fit_curves(rows: DataFrame, group: str, t: str, values: Sequence[str], controls: int = 24, degree: int = 3, smoothing: float = 1e-3, periodic: bool = False, weight: str | None = None, order: int = 2) -> DataFrame:
    """(group, lo, hi, n, controls array<double>): the curve of each group, control points one after the other.

    Rows with a null group, parameter or value, or a non-finite one, are left out. A group
    whose rows don't settle all control points without smoothing gets the shortest solution.
    """
    if controls < degree + 1 or degree < 0 or smoothing < 0:
        raise ValueError("at least degree + 1 control points and no negative smoothing")
    kind = rows.schema[group].dataType.simpleString()
    numbers = [t, *values, *([weight] if weight else [])]
    fine = " AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(CAST(`{c}` AS DOUBLE)) AND abs(CAST(`{c}` AS DOUBLE)) < double('infinity')" for c in numbers)
    used = rows.where(fine).where(F.col(group).isNotNull()).select(F.col(group).alias("g"), *[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(numbers)])
    ranges = cut(used.groupBy("g").agg(F.min("c0").alias("lo"), F.max("c0").alias("hi"), F.count(F.lit(1)).alias("n")))
    both = used.join(F.broadcast(ranges.drop("n")) if ranges.count() <= GROUPS else ranges.drop("n"), "g")
    m, band = len(values), degree + 1
    width = controls * band + controls * m

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns[1:]]
            which, w = _spans(cols[0], cols[-2], cols[-1], controls, degree, periodic)
            y, weights = np.stack(cols[1 : m + 1], axis=1), cols[m + 1] if weight else np.ones(b.num_rows)
            codes = b.column(0).dictionary_encode()
            names, of = codes.dictionary.to_pylist(), codes.indices.to_numpy()
            total = np.zeros((len(names), width))
            for p in range(band):
                for q in range(p, band):  # the product of a control point with the one q - p after it
                    np.add.at(total, (of, which[:, p] * band + q - p), weights * w[:, p] * w[:, q])
                for k in range(m):
                    np.add.at(total, (of, controls * band + which[:, p] * m + k), weights * w[:, p] * y[:, k])
            for name, part in zip(names, total):
                sums[name] = sums.get(name, 0.0) + part
            if len(sums) > 4096:
                yield flush(sums)
                sums = {}
        yield flush(sums)

    names_kind = used.limit(0).select("g").toArrow().schema.field("g").type

    def flush(sums: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), names_kind), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["g", "v"])

    parts = both.select("g", *[f"c{k}" for k in range(len(numbers))], "lo", "hi").mapInArrow(add, f"g {kind}, v binary")
    smooth = smoothing * penalty(controls, order, periodic)

    def solve(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v) for v in table["v"].to_pylist())
        bands, right = total[: controls * band].reshape(controls, band), total[controls * band :].reshape(controls, m)
        a = smooth.copy()
        for d in range(band):
            at = np.arange(controls)
            to = (at + d) % controls
            np.add.at(a, (at, to), bands[:, d])
            if d:
                np.add.at(a, (to, at), bands[:, d])
        x = np.linalg.lstsq(a, right, rcond=1e-13)[0]
        return pa.table({"g": table["g"].slice(0, 1), "controls": pa.array([x.ravel()], pa.list_(pa.float64()))})

    found = parts.groupBy("g").applyInArrow(solve, f"g {kind}, controls array<double>")
    return ranges.join(found, "g").select(F.col("g").alias(group), "lo", "hi", "n", "controls")


def curve_points(curves: DataFrame, group: str, values: Sequence[str], at: int = 50, controls: int = 24, degree: int = 3, periodic: bool = False) -> DataFrame:
    """(group, k, t, values..): each curve at `at` equal steps of its range, both ends included (the end of a period is left out)."""
    kind, m = curves.schema[group].dataType.simpleString(), len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = np.arange(at) / (at if periodic else max(at - 1, 1))
        for b in batches:
            for r in range(b.num_rows):
                lo, hi = b.column(1)[r].as_py(), b.column(2)[r].as_py()
                t = lo + share * (hi - lo)
                which, w = _spans(t, np.full(at, lo), np.full(at, hi), controls, degree, periodic)
                y = np.einsum("ap,apm->am", w, np.array(b.column(3)[r].as_py()).reshape(controls, m)[which])
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[r].as_py()] * at, b.column(0).type), pa.array(np.arange(at)), pa.array(t), *[pa.array(y[:, k]) for k in range(m)]], [group, "k", "t", *values])

    return curves.select(group, "lo", "hi", "controls").mapInArrow(run, f"`{group}` {kind}, k bigint, t double, " + ", ".join(f"`{v}` double" for v in values))
