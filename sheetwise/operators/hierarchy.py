"""Hierarchical density clustering: a spanning tree of mutual reachability and the clusters that last longest in it.

The mutual reachability of two points is the largest of their distance and both core
distances; a core distance reaches the samples-th point, the point itself included. The
tree grows in Boruvka rounds over the pivot index: lists of nearest neighbours propose
each component's shortest way out, and only points whose list cannot rule out a shorter
one look further, at blocks within that way's length that hold another component; of the
points of one place in one component the least id looks for all. Edges are ordered by
length (rounded to DIGITS) and both ids, so the tree is unique.

The rounds run on all points in parallel and halve the components at least. Condensing
needs the tree's edges in order of length: one task reads them, three numbers a point and
no coordinates, and refuses more than EDGES of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.operators import pivots
from sheetwise.operators.components import components
from sheetwise.operators.pivots import DIGITS, _exact, _far, _matrix
from sheetwise.plans.lineage import cut

#: Most edges that the one condensing task takes: 100 million points.
EDGES = 100_000_000
#: Neighbours of each point that are kept over all rounds, at least.
LIST = 16


def _shortest(here, own, core, comp, ids, rows, cores, comps):
    """(components, lengths, low ids, high ids) of the shortest way out of each query's component into these rows, one for each component."""
    names, group = np.unique(comp, return_inverse=True)
    least, out = np.full(len(names), np.inf), []
    step = max(1, pivots.HELD // max(1, len(rows)))
    for lo in range(0, len(own), step):
        at = slice(lo, lo + step)
        near, off = _far(own[at], rows)
        np.maximum(near, np.maximum(core[at, None], cores[None]), out=near)
        near[comp[at, None] == comps[None]] = np.inf
        np.minimum.at(least, group[at], near.min(axis=1))
        bound = least[group[at]] + 2 * off.max() + 10.0**-DIGITS
        p, q = np.nonzero((near <= bound[:, None]) & np.isfinite(near))
        p += lo
        length = np.round(np.maximum(np.sqrt(_exact(own[p], rows[q])), np.maximum(core[p], cores[q])), DIGITS)
        out.append(_first(group[p], length, np.minimum(here[p], ids[q]), np.maximum(here[p], ids[q])))
    found = _first(*(np.concatenate(c) for c in zip(*out))) if out else [np.zeros(0, np.int64)] * 4
    return names[found[0]], *found[1:]


def _first(group, length, low, high):
    """The least (length, low, high) of each group."""
    order = np.lexsort((high, low, length, group))
    order = order[np.diff(group[order], prepend=-1) != 0]
    return group[order], length[order], low[order], high[order]


def spanning_tree(points: DataFrame, vector: str, samples: int = 5, index: pivots.Index | None = None) -> DataFrame:
    """(a, b, length): the least spanning tree of mutual reachability, a < b; n - 1 edges for n usable points."""
    spark = points.sparkSession
    index = index or pivots.build(points, vector)
    if index is None:
        return spark.createDataFrame([], "a bigint, b bigint, length double")
    k = max(samples, LIST)
    near = cut(pivots.knn(points, vector, k, index=index))
    # the samples-th point with the point itself is the (samples - 1)-th other one
    cores = near.where(F.col("rank") == samples - 1).select("i", F.round(F.sqrt("d2"), DIGITS).alias("core")) if samples > 1 else near.select("i", F.lit(0.0).alias("core")).distinct()
    reach = near.groupBy("i").agg(F.when(F.count(F.lit(1)) >= k, F.sqrt(F.max("d2"))).otherwise(float("inf")).alias("reach"))
    # points with too few others have no core distance: they are as far as the farthest they know
    far = near.groupBy("i").agg(F.round(F.sqrt(F.max("d2")), DIGITS).alias("far"))
    nodes = cut(index.points.join(cores, "i", "left").join(reach, "i", "left").join(far, "i", "left").select("b", "i", "x", F.coalesce("core", "far", F.lit(0.0)).alias("core"), F.coalesce("reach", F.lit(float("inf"))).alias("reach")))
    side = nodes.select("i", "core")
    listed = near.select("i", "j", F.sqrt("d2").alias("d")).join(side, "i").join(side.select(F.col("i").alias("j"), F.col("core").alias("other")), "j")
    listed = cut(listed.select("i", "j", F.round(F.greatest("d", "core", "other"), DIGITS).alias("length")))
    labels, tree = cut(nodes.select("i", F.col("i").alias("c"))), None
    while labels.select("c").distinct().count() > 1:
        ends = cut(listed.join(labels, "i").join(labels.select(F.col("i").alias("j"), F.col("c").alias("e")), "j").where("c <> e").select("i", "j", "length", "c"))
        listed = ends.drop("c")  # what joined once stays joined
        way = F.struct("length", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
        proposed = ends.groupBy("c").agg(F.min(way).alias("way"))
        rows = nodes.join(labels, "i").join(proposed, "c", "left").select("b", "i", "x", "core", "c", "reach", F.coalesce("way.length", F.lit(float("inf"))).alias("most"))
        # of one place's points in one component only the least id counts: it gives the first of equal ways, asking and asked
        rows = cut(rows.groupBy("b", "x", "core", "c").agg(F.min("i").alias("i"), F.min("reach").alias("reach"), F.min("most").alias("most")).select("b", "i", "x", "core", "c", "reach", "most"))
        # a point outside the list is at least as far as its last entry
        asking = rows.where(F.greatest("reach", "core") <= F.col("most") + 10.0**-DIGITS) if k < index.sizes.sum() - 1 else rows.limit(0)
        held = {r.b: r for r in rows.groupBy("b").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.max("core").alias("core")).collect()}  # a row for each block
        only = np.array([held[b].low if b in held and held[b].low == held[b].high else -(2**63) for b in range(index.blocks)])
        found = _asked(index, asking, rows, only, np.array([held[b].core if b in held else np.inf for b in range(index.blocks)]))
        best = found.select("c", F.struct("length", "a", "b").alias("way")).unionByName(proposed).groupBy("c").agg(F.min("way").alias("way"))
        best = cut(best.select("way.*").distinct())
        tree = best if tree is None else tree.unionByName(best)
        joined = best.join(labels.select(F.col("i").alias("a"), F.col("c").alias("p")), "a").join(labels.select(F.col("i").alias("b"), F.col("c").alias("q")), "b")
        root = components(joined.select(F.col("p").alias("i"), F.col("q").alias("j"))).select(F.col("i").alias("c"), "root")
        labels = cut(labels.join(root, "c", "left").select("i", F.coalesce("root", "c").alias("c")))
    return tree.select("a", "b", "length") if tree is not None else spark.createDataFrame([], "a bigint, b bigint, length double")


def _asked(index: pivots.Index, asking: DataFrame, rows: DataFrame, only: np.ndarray, widest: np.ndarray) -> DataFrame:
    """(c, length, a, b): ways that the asking points find in blocks near enough and not all of their own component.

    only: the one component that a block holds, if so; widest: its largest core distance.
    A block that holds another component has a point no farther than its far side, which
    bounds the way of a component whose lists propose none. Where points ask many blocks,
    some stand together and take a point once, as in the neighbour joins.
    """
    centres, radii = index.centres, index.radii

    def send(batches: Iterator[pa.RecordBatch], wide: int = 0) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, core, comp, most = _matrix(batch.column(1)), *(batch.column(c).to_numpy() for c in (2, 3, 4))
            for lo in range(0, len(x), pivots.BLOCK):
                hi = lo + pivots.BLOCK
                far, off = _far(x[lo:hi], centres)
                other = only[None] != comp[lo:hi, None]
                upto = np.where(other, np.maximum(far + radii + 2 * off[:, None], widest), np.inf).min(axis=1)
                upto = np.minimum(most[lo:hi], np.maximum(upto, core[lo:hi]))
                meets = (far - radii - 2 * off[:, None] <= upto[:, None] + 10.0**-DIGITS) & other
                if not wide:
                    yield pa.RecordBatch.from_arrays([pa.array([min(hi, len(x)) - lo]), pa.array([int(meets.sum())])], ["asking", "n"])
                    continue
                at, to = np.nonzero(pivots.joint(meets, wide))
                yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), *(batch.column(c).take(pa.array(at + lo)) for c in range(4))], ["b", "i", "x", "core", "c"])

    asking = cut(asking.select("i", "x", "core", "c", "most"))
    total = asking.mapInArrow(send, "asking bigint, n bigint").agg(F.sum("asking").alias("asking"), F.sum("n").alias("n")).first()
    wide = pivots.together(index.blocks, total.asking or 0, total.n or 0)
    sent = cut(asking.mapInArrow(lambda batches: send(batches, wide), "b int, i bigint, x array<double>, core double, c bigint"))
    parts = {r.b: -(-r.n // pivots.QUERIES) for r in sent.groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each block
    spark = rows.sparkSession
    copies = F.broadcast(spark.createDataFrame(list(parts.items()) or [(-1, 1)], "b int, copies int"))
    left = sent.join(copies, "b").select("b", F.pmod(F.xxhash64("i"), F.col("copies")).cast("int").alias("s"), "i", "x", "core", "c")
    right = rows.withColumn("b", (F.col("b") / wide).cast("int")).join(copies, "b").select("b", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("s"), "i", "x", "core", "c")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        sides = [[t["i"].to_numpy(), _matrix(t["x"]), t["core"].to_numpy(), t["c"].to_numpy()] for t in (a, b)]
        out = _shortest(*sides[0], *sides[1]) if a.num_rows and b.num_rows else [[]] * 4
        return pa.table({n: pa.array(out[k], kind) for k, (n, kind) in enumerate((("c", pa.int64()), ("length", pa.float64()), ("a", pa.int64()), ("b", pa.int64())))})

    return left.groupBy("b", "s").cogroup(right.groupBy("b", "s")).applyInArrow(run, "c bigint, length double, a bigint, b bigint")


def condense(a: np.ndarray, b: np.ndarray, length: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, labels) from a spanning tree: the clusters of largest stability, named by their least id; -1 for noise.

    Joining in order of length gives a binary tree. From its root down, a part of `least`
    points or more that parts into two such parts ends as a cluster and starts two; lesser
    parts drop out. A cluster's stability sums over its points how much longer (in
    1 / length) they stay than it has been there. The root is no cluster.
    """
    ids = np.unique(np.concatenate([a, b]))
    n = len(ids)
    order = np.lexsort((b, a, length))
    pairs = np.stack([np.searchsorted(ids, a), np.searchsorted(ids, b)], axis=1)[order].tolist()
    rate = (1 / np.maximum(length[order], 1e-12)).tolist()
    top, size = list(range(2 * n - 1)), [1] * n + [0] * (n - 1)
    kids: list[tuple[int, int]] = []
    for k, (p, q) in enumerate(pairs):
        while top[p] != p:
            top[p], p = top[top[p]], top[p]
        while top[q] != q:
            top[q], q = top[top[q]], top[q]
        top[p] = top[q] = n + k
        size[n + k] = size[p] + size[q]
        kids.append((p, q))

    def leaves(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            v = todo.pop()
            if v < n:
                out.append(v)
            else:
                todo += kids[v - n]
        return out

    # clusters: parent, rate at birth, stability, the points that drop out of each
    parent, born, stable, dropped = [-1], [0.0], [0.0], [[]]
    todo = [(2 * n - 2, 0)]
    while todo:
        node, c = todo.pop()
        if node < n:
            dropped[c].append(node)
            continue
        p, q = kids[node - n]
        now = rate[node - n]
        if size[p] >= least and size[q] >= least:
            stable[c] += (now - born[c]) * size[node]
            for part in (p, q):
                parent.append(c)
                born.append(now)
                stable.append(0.0)
                dropped.append([])
                todo.append((part, len(parent) - 1))
            continue
        for part, other in ((p, q), (q, p)):
            if size[part] < least:
                stable[c] += (now - born[c]) * size[part]
                dropped[c] += leaves(part)
            else:
                todo.append((part, c))
    chosen, best = [False] * len(parent), stable[:]
    below = [0.0] * len(parent)
    for c in range(len(parent) - 1, 0, -1):  # children come after their parents
        chosen[c] = stable[c] >= below[c]
        best[c] = max(stable[c], below[c])
        below[parent[c]] += best[c]
    label = np.full(n, -1, np.int64)
    at = [-1] * len(parent)
    for c in range(1, len(parent)):
        at[c] = at[parent[c]] if at[parent[c]] >= 0 else c if chosen[c] else -1
    for c in range(1, len(parent)):
        if at[c] >= 0 and dropped[c]:
            label[dropped[c]] = at[c]
    for c in set(label[label >= 0].tolist()):
        mine = label == c
        label[mine] = -2 - int(np.flatnonzero(mine)[0])
    return ids, np.where(label < -1, ids[np.maximum(-2 - label, 0)], -1)


def hdbscan(points: DataFrame, vector: str, least: int = 5, samples: int | None = None, index: pivots.Index | None = None) -> DataFrame:
    """(i, label) of every point: the least id of its cluster, -1 for noise and for points with an unusable coordinate."""
    if least < 2:
        raise ValueError("a cluster has two points or more")
    tree = cut(spanning_tree(points, vector, samples or least, index))
    if (n := tree.count()) > EDGES:
        raise ValueError(f"{n} edges are too many to condense in one task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if parts:
            ids, label = condense(*(np.concatenate(c) for c in zip(*parts)), least)
            for lo in range(0, len(ids), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + (1 << 16)]), pa.array(label[lo : lo + (1 << 16)])], ["i", "label"])

    found = tree.coalesce(1).mapInArrow(run, "i bigint, label bigint")
    return points.select(F.col("i").cast("bigint").alias("i")).join(found, "i", "left").select("i", F.coalesce("label", F.lit(-1)).alias("label"))
