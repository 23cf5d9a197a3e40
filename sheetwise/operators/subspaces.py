"""Subspaces of groups of rows: mean projectors, branches that share a point, parameters by segment."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.operators import direct, kernels
from sheetwise.operators.neighbors import knn_edges
from sheetwise.operators.solvers import held_spectrum, spectrum
from sheetwise.plans.lineage import cut

#: Points up to which a segment is solved as a dense matrix, and up to which it is solved in one task at all.
DENSE, WHOLE = 1500, 1 << 16


def mean_subspaces(rows: DataFrame, group: str, frame: str, d: int = 1) -> DataFrame:
    """(group, rank, values, basis, n): the mean of each group's projectors onto frames, taken apart.

    frame: D * d entries, row-major, d orthonormal columns (for lines any nonzero vector, which is scaled).
    A task adds up the projectors that it meets, so only one matrix for each group and
    task is moved; equal or nearly equal values leave their basis open up to a rotation.
    rank is the trace, rounded; basis holds the rank leading eigenvectors one after the
    other, each with a positive largest entry. Null, non-finite and zero frames are left out.
    """
    # groups are numbers or taken as text
    kind = "bigint" if rows.schema[group].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint") else "string"
    given = rows.select(F.col(group).alias("g"), F.transform(F.col(frame), lambda v: v.cast("double")).alias("u")).where("u is not null")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for b in batches:
            for g, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if None in u or not u or not np.isfinite(u).all():
                    continue
                u = np.reshape(u, (-1, d))
                size = np.linalg.norm(u, axis=0)
                if (size > 0).all():
                    u = u / size
                    n, p = sums.get((g, len(u)), (0, 0.0))
                    sums[g, len(u)] = n + 1, p + u @ u.T
        yield pa.RecordBatch.from_pylist([{"g": g, "n": n, "p": p.tobytes()} for (g, _), (n, p) in sums.items()], pa.schema([("g", pa.int64() if kind == "bigint" else pa.string()), ("n", pa.int64()), ("p", pa.binary())]))

    parts = given.withColumn("g", F.col("g").cast(kind)).mapInArrow(add, f"g {kind}, n bigint, p binary")

    def apart(t: pa.Table) -> pa.Table:
        n = sum(t["n"].to_pylist())
        mean = sum(np.frombuffer(p) for p in t["p"].to_pylist())
        side = int(len(mean) ** 0.5)
        values, basis = np.linalg.eigh(mean.reshape(side, side) / n)
        values, basis = values[::-1], basis[:, ::-1]
        rank = max(1, round(float(values.sum())))
        best = basis[:, :rank] * np.sign(basis[np.abs(basis[:, :rank]).argmax(axis=0), np.arange(rank)])
        return pa.table({"g": t["g"].slice(0, 1), "rank": [rank], "values": [values.tolist()], "basis": [best.T.ravel().tolist()], "n": [n]})

    out = parts.groupBy("g").applyInArrow(apart, f"g {kind}, rank bigint, values array<double>, basis array<double>, n bigint")
    return out.withColumnRenamed("g", group)


def split_branches(points: DataFrame, x: Sequence[str], frame: str, d: int = 1, k: int = 20, threshold: float = 0.3) -> DataFrame:
    """Points (i, origin, x.., frame, branch) where a point near which lines of two directions meet stands twice.

    The projectors of a point's k nearest and its own are added up; when the second
    eigenvalue exceeds `threshold` times the first, the row keeps the first eigenvector
    as its frame and a second row gets the other. Ids stay in the order of `origin`:
    i = 2 * origin + branch, so a graph over origins carries over by a join.
    """
    if d != 1:
        raise ValueError("branches of lines only")
    near = knn_edges(points, x, k).select("i", "j").unionByName(points.select("i", F.col("i").alias("j")))
    lines = near.join(points.select(F.col("i").alias("j"), F.transform(F.col(frame), lambda v: v.cast("double")).alias("u")), "j")
    sums = lines.groupBy("i").agg(F.collect_list("u").alias("us"))  # k + 1 of them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, us in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                u = np.array(us)
                u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
                values, basis = np.linalg.eigh(u.T @ u)
                one, two = basis[:, -1], basis[:, -2]
                out.append((i, one.tolist(), two.tolist() if values[-2] > threshold * values[-1] else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())))], ["i", "one", "two"])

    found = sums.mapInArrow(run, "i bigint, one array<double>, two array<double>").join(points.select("i", *x), "i")
    both = F.array(F.struct(F.lit(0).alias("branch"), F.col("one").alias("u")), F.struct(F.lit(1).alias("branch"), F.col("two").alias("u")))
    rows = found.select("i", *x, F.explode(both).alias("r")).where("r.u is not null")
    return rows.select((F.col("i") * 2 + F.col("r.branch")).alias("i"), F.col("i").alias("origin"), *x, F.col("r.u").alias(frame), F.col("r.branch").alias("branch"))


def segment_parameters(points: DataFrame, x: Sequence[str], normals: Sequence[str], label: str, k: int = 10, most: int = WHOLE) -> DataFrame:
    """(i, u, v): two spectral parameters of each segment, from -0.5 to 0.5; segments below max(8, k + 1) points and noise (negative labels) are left out.

    Neighbours are taken within segments: the graph is built once over positions in which
    segments lie apart. Segments of up to `most` points are solved in one grouped pass, one
    at a time in a task: small ones densely, others with a sparse factor. Larger ones go to
    `solvers.spectrum` one by one.
    The parameters are the second and third eigenvectors of the normalised bilateral
    Laplacian, so their signs, and for symmetric segments a rotation, are open; the entry
    of largest size is positive. A constant parameter becomes 0.
    """
    sizes = points.where(F.col(label) >= 0).groupBy(label).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") >= max(8, k + 1))
    rows = cut(points.join(sizes, label))
    box = rows.agg(*[(F.max(c) - F.min(c)).alias(c) for c in x]).first()
    far = 4 * max([float(box[c] or 0.0) for c in x] + [1.0])
    # one more coordinate keeps segments farther apart than any two points of one
    rank = {r[label]: n for n, r in enumerate(sizes.orderBy(label).select(label).collect())}
    apart = points.sparkSession.createDataFrame([(int(v), float(n) * far) for v, n in rank.items()] or [(-1, 0.0)], f"{label} bigint, _apart double")
    placed = cut(rows.join(F.broadcast(apart), label))
    edges = cut(knn_edges(placed, [*x, "_apart"], k))
    weights = cut(kernels.bilateral(edges, placed, list(x), list(normals)))
    # ids say nothing about places: without an order a factor's uppermost node would hold most of a segment
    order = cut(direct.curve_order(placed, x))
    lap = cut(kernels.laplacian(weights, True).join(placed.select("i", label, "_size").join(order, "i"), "i"))

    def solve(t: pa.Table) -> pa.Table:
        i, j, v, key = (t[c].to_numpy() for c in ("i", "j", "v", "key"))
        ids, first, i = np.unique(i, return_index=True, return_inverse=True)
        j = np.searchsorted(ids, j)
        if len(ids) > DENSE:
            y = held_spectrum(i, j, v, key[first], 3)[1]
        else:
            a = np.zeros((len(ids), len(ids)))
            np.add.at(a, (i, j), v)
            y = np.linalg.eigh(a)[1]
        return pa.table({"i": ids, "y": pa.array(y[:, 1:3].tolist(), pa.list_(pa.float64()))})

    made = lap.where(F.col("_size") <= most).select(label, "i", "j", "v", "key").groupBy(label).applyInArrow(solve, "i bigint, y array<double>")
    for r in sizes.where(F.col("_size") > most).collect():  # each with its own solution
        y, _ = spectrum(lap.where(F.col(label) == r[label]).select("i", "j", "v"), 2, drop_first=True, order=order)
        made = made.unionByName(y)
    both = cut(made.join(placed.select("i", label), "i").select("i", label, F.col("y")[0].alias("u"), F.col("y")[1].alias("v")))
    bounds = both.groupBy(label).agg(*[f(c).alias(f"{n}_{c}") for c in "uv" for n, f in (("lo", F.min), ("hi", F.max))])

    def scaled(c: str):
        lo, hi = F.col(f"lo_{c}"), F.col(f"hi_{c}")
        side = F.when(hi >= -lo, F.lit(1.0)).otherwise(F.lit(-1.0))  # the larger end is positive
        return F.when(hi - lo > 1e-12, side * ((F.col(c) - lo) / (hi - lo) - 0.5)).otherwise(0.0).alias(c)

    return both.join(bounds, label).select("i", scaled("u"), scaled("v"))
