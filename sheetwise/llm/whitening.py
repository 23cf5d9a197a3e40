"""Embedding whitening by a two-pass covariance.

Entries become whole numbers x = floor(1024 c) + 100000. The first pass sums them
exactly; the second one centres each row by the sums, as n x - S in whole numbers, and
adds up the outer products of the centred rows, block by block as a matrix product. Each
task returns one matrix, and a tree merges them. LAPACK's symmetric solver takes the
covariance apart on the driver, where everything is dims x dims, and the projection onto
the first components, COMPONENTS x dims, goes to all tasks. A third pass measures the
covariance of the whitened rows themselves.

Defined results: rows whose vector is null or holds null or non-finite entries are
dropped. Vectors shorter than the longest lack entries and are dropped, too. floor(1024 c)
stops at plus and minus 2^62. Every row left, repeated ones
and those with a null id included, is in the fit and in the result; with fewer than
COMPONENTS dimensions there are as many components as dimensions. A component without
variance (an eigenvalue below the rounding error of the largest: few or equal rows) has
null in `whitened`, and identity_error covers the other components (null without any);
without any variance `explained` is null. A deviation beyond the range of a long is null.
Equal eigenvalues leave their components open up to a rotation. The sign of a component
makes its largest entry positive. Other columns are ignored, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

COMPONENTS = 8
SCALE, OFFSET = 1024.0, 100_000
#: Whole numbers stop here, so that they stay longs with the offset.
MOST = 2.0**62
#: Rows centred and multiplied at once.
BLOCK = 4096
_LONG = 2**63 - 1


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, x as longs) of the usable vectors of a list column, for each length on its own, a block at a time."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)  # null entries become NaN
    start, size = offsets[:-1].astype(np.int64), np.diff(offsets)
    there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (size > 0))
    for length in np.unique(size[there]).tolist():
        alike = there[size[there] == length]
        for lo in range(0, len(alike), BLOCK):
            rows = alike[lo : lo + BLOCK]
            c = values[start[rows][:, None] + np.arange(length)]
            fine = np.isfinite(c).all(axis=1)
            yield rows[fine], np.clip(np.floor(SCALE * c[fine]), -MOST, MOST).astype(np.int64) + OFFSET


def _fits(bound: int) -> bool:
    return bound < 1 << 62


def _sum(x: np.ndarray) -> list[int]:
    """Exact sums of the columns."""
    most = int(np.abs(x.astype(np.float64)).max(initial=0)) + 1
    return [int(v) for v in (x if _fits(most * max(1, len(x))) else x.astype(object)).sum(axis=0)]


@dataclass
class Fit:
    """n fitted rows with the sums of their x; directions: a row for each component, unit length, by falling eigenvalue."""

    n: int
    sums: list[int]
    directions: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def solid(self) -> np.ndarray:
        """The components with a variance above rounding."""
        return self.eigenvalues > self.trace * len(self.sums) * np.finfo(float).eps

    def whiten(self, centred: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.solid, centred @ self.directions.T / np.sqrt(np.maximum(self.eigenvalues, 0)), np.nan)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: longs, or Python's numbers where longs could overflow."""
    most = int(np.abs(x.astype(np.float64)).max(initial=0)) + 1
    if _fits(n * most + max(map(abs, sums))):
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _squares(d: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, exact; None beyond a long."""
    most = max(int(abs(v)) for v in (d.min(initial=0), d.max(initial=0)))
    total = (d * d if _fits(most * most * d.shape[1]) else d.astype(object) ** 2).sum(axis=1)
    return [int(v) if v <= _LONG else None for v in total]


def _merged(parts: DataFrame, zero, add, depth: int = 2):
    """The rows of parts, one for each task at most, merged along a tree of tasks."""
    return parts.rdd.treeAggregate(zero, add, lambda a, b: add(a, b) if a is not None and b is not None else a if b is None else b, depth)


def _prepared(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """(number, exact sums of x) of the longest usable vectors of rows (id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, list[int]]] = {}
        for b in batches:
            for _, x in _matrices(b.column(1)):
                if len(x) and x.shape[1] >= max(found, default=0):
                    n, s = found.get(x.shape[1], (0, [0] * x.shape[1]))
                    found = {x.shape[1]: (n + len(x), [p + q for p, q in zip(s, _sum(x))])}
        for n, s in found.values():
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[str(v) for v in s]], pa.list_(pa.string()))], ["n", "s"])

    def add(a, row):
        b = (row[0], [int(v) for v in row[1]])
        if a is None or len(b[1]) > len(a[1]):
            return b
        return a if len(b[1]) < len(a[1]) else (a[0] + b[0], [p + q for p, q in zip(a[1], b[1])])

    return _merged(rows.select("id", "v").mapInArrow(run, "n bigint, s array<string>"), None, add) or (0, [])


def _outer(rows: DataFrame, n: int, s: list[int], project=None) -> tuple[np.ndarray, np.ndarray]:
    """(sums of the columns, sums of their outer products) over the centred rows, or over what project makes of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = second = None
        for b in batches:
            for _, x in _matrices(b.column(1)):
                if len(x) and x.shape[1] == len(s):
                    y = _deviations(x, n, s).astype(np.float64) / n
                    y = project(y) if project else y
                    one, two = y.sum(axis=0), y.T @ y
                    first, second = (one, two) if first is None else (first + one, second + two)
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([z.tobytes()], pa.binary()) for z in (first, second)], ["first", "second"])

    def add(a, row):
        b = tuple(np.frombuffer(z) if isinstance(z, (bytes, bytearray)) else z for z in row)
        return b if a is None else (a[0] + b[0], a[1] + b[1])

    first, second = _merged(rows.select("id", "v").mapInArrow(run, "first binary, second binary"), None, add)
    return first, second.reshape(len(first), -1)


def fit(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> Fit | None:
    """The whitening of the vectors, None if there are none. dims x dims numbers come to the driver and no more."""
    rows = _prepared(df, id_col, vec_col)
    n, s = sums(rows)
    if not n:
        return None
    _, second = _outer(rows, n, s)
    covariance = second / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    directions = vectors[:, order].T
    directions = directions * np.sign(directions[np.arange(len(order)), np.abs(directions).argmax(axis=1)])[:, None]
    made = Fit(n, s, directions, values[order], float(np.trace(covariance)))
    if (k := made.solid).any():
        first, second = _outer(rows, n, s, lambda y: made.whiten(y)[:, k])
        # the rows are centred up to rounding; what is left of their mean is taken off
        made.identity_error = float(np.abs(second / n - np.outer(first, first) / n / n - np.eye(int(k.sum()))).max())
    return made


def whiten(df: DataFrame, made: Fit | None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component."""
    rows = _prepared(df, id_col, vec_col)
    names = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    kind = f"id {rows.schema['id'].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    shared = df.sparkSession.sparkContext.broadcast(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = shared.value
        for b in batches:
            for at, x in _matrices(b.column(1)) if made else ():
                if len(x) and x.shape[1] == len(made.sums):
                    d, k = _deviations(x, made.n, made.sums), len(made.eigenvalues)
                    white = made.whiten(d.astype(np.float64) / made.n).ravel()
                    explained = [v / made.trace if made.trace > 0 else None for v in made.eigenvalues.tolist()]
                    times, cells = np.repeat(np.arange(len(x)), k), len(x) * k
                    columns = [
                        b.column(0).take(pa.array(at[times])),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(cells, made.n, np.int64)),
                        pa.array(_squares(d), pa.int64()).take(pa.array(times)),
                        pa.array(white, from_pandas=True),
                        pa.array(explained * len(x), pa.float64()),
                        pa.array([made.identity_error] * cells, pa.float64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["id", *names])

    return rows.mapInArrow(run, kind).withColumnRenamed("id", id_col)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whiten(vectors, fit(vectors))
