"""An exact metric index: k nearest and radius joins that skip what the triangle inequality rules out.

Points are dealt to the nearest of up to PIVOTS pivots, so a block is a pivot and the
radius that its points need. A block with many points is cut further by ranges of ids,
which is what breaks ties. Every point first meets its own block; its k-th distance
there bounds what it still has to see: a block whose pivot lies farther away than that
distance and the block's radius together cannot hold a nearer point. Only the blocks
left meet the point, again cut so that a task gets a bounded number of queries.

The driver keeps a row for each block (at most PIVOTS + PARTS of them) and nothing else.
In the plane or in space a point meets a few blocks; wide vectors without structure meet
most of them, as no bound can help there (`share` measures it). Then WIDE blocks form one
that takes a query once, and the bound still drops what is farther inside of a task.

Distances are measured by differences; matrix products only propose. Ties go to the
smaller id after rounding squared distances to DIGITS digits. Points with a null or
non-finite coordinate have no neighbours and are nobody's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sheetwise.plans.lineage import cut

DIGITS = 9
#: Most pivots, and most further parts of crowded blocks: the size of what goes to every task.
PIVOTS, PARTS = 2048, 2048
#: Points of a block that are aimed at, points from which a block is cut, and queries that one task compares with a block.
BLOCK, CROWDED, QUERIES = 1024, 4096, 8192
#: Blocks that stand together where queries meet more than a WIDEST-th of all.
WIDE, WIDEST = 16, 4
#: Pairs that one task of a radius join may find.
PAIRS = 1 << 22
#: Distances held at once.
HELD = 1 << 21
#: For radius joins: most points of one place in a row, points met at the same place on average from which rows are places, points of a block then, least tasks.
COPIES, SHARED, LEAST, TASKS = 256, 4, 64, 96


@dataclass
class Index:
    """Blocks of points: (b, i, x), with their centres, radii and least ids."""

    points: DataFrame
    centres: np.ndarray
    radii: np.ndarray
    least: np.ndarray
    sizes: np.ndarray
    pivots: np.ndarray

    @property
    def blocks(self) -> int:
        return len(self.radii)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def _far(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of all rows of a and b by products, and how far their squares can be off for each row of a."""
    squares, off = _squares(a, b)
    return np.sqrt(squares, out=squares), np.sqrt(off)


def _squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by products, and how far those of each row of a can be off."""
    left, right = (a**2).sum(axis=1), (b**2).sum(axis=1)
    off = 8 * (a.shape[1] + 4) * np.finfo(float).eps * (left + right.max(initial=0.0))
    out = a @ (-2 * b.T)
    out += left[:, None]
    out += right
    return np.maximum(out, 0, out=out), off


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows of a and b, coordinate by coordinate."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        step = b[:, k] - a[:, k]
        total += step * step
    return total


def nearest(here: np.ndarray, own: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, itself: bool, most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of own, row of rows, squared distance) of the k nearest of each row of own, a slice at a time; most bounds the squares of each."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, HELD // max(1, len(rows)))
    for lo in range(0, len(own), step):
        a, me = own[lo : lo + step], here[lo : lo + step]
        near, off = _squares(a, rows)
        if not itself:
            near[me[:, None] == ids] = np.inf
        off = 2 * off + 2 * 10.0**-DIGITS
        worst = np.full(len(a), np.finfo(float).max) if most is None else np.minimum(most[lo : lo + step], np.finfo(float).max)
        if k < len(ids):
            many = np.flatnonzero(np.count_nonzero(near <= (worst + off)[:, None], axis=1) > k)
            worst[many] = np.minimum(worst[many], np.partition(near[many], k - 1, axis=1)[:, k - 1])
        at, to = np.nonzero(near <= (worst + off)[:, None])
        d = np.concatenate([_exact(a[at[s : s + HELD]], rows[to[s : s + HELD]]) for s in range(0, len(at), HELD)]) if len(at) else np.zeros(0)
        order = np.lexsort((ids[to], np.round(d, DIGITS), at))
        at, to, d = at[order], to[order], d[order]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        best = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at)))) < k
        out.append((at[best] + lo, to[best], d[best]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def within(here: np.ndarray, own: np.ndarray, ids: np.ndarray, rows: np.ndarray, radius: float, itself: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same for all rows within the radius, slice by slice."""
    step = max(1, HELD // max(1, len(rows)))
    for lo in range(0, len(own), step):
        a = own[lo : lo + step]
        near, off = _far(a, rows)
        at, to = np.nonzero(near <= (np.sqrt(radius**2 + 2 * off**2) + off)[:, None])
        d = _exact(a[at], rows[to])
        keep = d <= radius * radius
        if not itself:
            keep &= here[lo + at] != ids[to]
        yield lo + at[keep], to[keep], d[keep]


def _usable(points: DataFrame, vector: str) -> DataFrame:
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return points.select(F.col("i").cast("bigint").alias("i"), x.alias("x")).where(F.col("x").isNotNull() & fine & F.col("i").isNotNull())


def build(points: DataFrame, vector: str, block: int = BLOCK, crowded: int = CROWDED) -> Index | None:
    """The index of points (i, vector); None without points. Pivots are the points of least hash."""
    rows = cut(_usable(points, vector))
    n = rows.count()
    if not n:
        return None
    wanted = min(max(1, -(-n // block)), PIVOTS)
    chosen = rows.orderBy(F.xxhash64("i"), "i").limit(wanted).toArrow()
    pivots = np.unique(_matrix(chosen["x"]), axis=0)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1))
            at = np.concatenate([np.argmin(_far(x[lo : lo + BLOCK], pivots)[0], axis=1) for lo in range(0, len(x), BLOCK)]) if len(x) else np.zeros(0, np.int64)
            far = np.sqrt(_exact(x, pivots[at])) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), b.column(0), b.column(1), pa.array(far)], ["p", "i", "x", "far"])

    dealt = cut(rows.mapInArrow(deal, "p bigint, i bigint, x array<double>, far double"))
    counts = {r.p: r.n for r in dealt.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each pivot
    large = sorted(p for p, size in counts.items() if size > crowded)
    parts = min(PARTS // max(1, len(large)), -(-max(counts.values()) // crowded)) if large else 1
    if parts > 1:
        steps = [k / parts for k in range(1, parts)]
        edges = dealt.where(F.col("p").isin(large)).groupBy("p").agg(F.percentile_approx("i", steps, 10 * parts + 100).alias("edges"))
        dealt = dealt.join(F.broadcast(edges), "p", "left").withColumn("s", F.coalesce(F.size(F.filter("edges", lambda e: e < F.col("i"))), F.lit(0))).drop("edges")
        dealt = dealt.withColumn("s", F.greatest("s", F.lit(0)))
    else:
        dealt = dealt.withColumn("s", F.lit(0))
    stats = sorted(dealt.groupBy("p", "s").agg(F.max("far").alias("radius"), F.min("i").alias("least"), F.count(F.lit(1)).alias("n")).collect(), key=lambda r: (r.p, r.s))
    names = F.create_map(*[v for k, r in enumerate(stats) for v in (F.lit(r.p * PARTS + r.s), F.lit(k))])
    if len(stats) > 64:  # a large literal map is slow to plan; the same rows as a small table
        table = points.sparkSession.createDataFrame([(int(r.p), int(r.s), k) for k, r in enumerate(stats)], "p bigint, s int, b int")
        blocks = dealt.join(F.broadcast(table), ["p", "s"]).select("b", "i", "x")
    else:
        blocks = dealt.select(names[F.col("p") * PARTS + F.col("s")].alias("b"), "i", "x")
    at = [r.p for r in stats]
    return Index(cut(blocks), pivots[at], np.array([r.radius for r in stats]), np.array([r.least for r in stats]), np.array([r.n for r in stats]), pivots)


def _sent(index: Index, rows: DataFrame, own: bool, together: int = 1, count: bool = False) -> DataFrame:
    """(b, i, x, ..) for each query (b, i, x, tau, last, ..) and block that it has to meet; its own block (b) only if own.

    Of so many blocks that stand together one number is named if one of them counts, its own one always.
    With count only (n): how many rows there would be, by parts of the queries.
    """
    centres, radii, least = index.centres, index.radii, index.least
    more = rows.columns[5:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, home = _matrix(batch.column(2)), batch.column(0).to_numpy()
            tau, last = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            for lo in range(0, len(x), BLOCK):
                hi = lo + BLOCK
                far, off = _far(x[lo:hi], centres)
                low = np.maximum(far - radii - 2 * off[:, None], 0)
                half = 10.0**-DIGITS / 2  # what rounding can add to a squared distance
                meets = low**2 < tau[lo:hi, None] - half / 2
                # as far as the last one found, a block counts only if it has a smaller id
                meets |= (low**2 <= tau[lo:hi, None] + 2 * half) & (least < last[lo:hi, None])
                if not own or together > 1:
                    meets[np.arange(len(meets)), home[lo:hi]] = own
                if count:
                    yield pa.RecordBatch.from_arrays([pa.array([int(meets.sum())])], ["n"])
                    continue
                at, to = np.nonzero(joint(meets, together))
                kept = [1, 2, *range(5, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), *(batch.column(k).take(pa.array(at + lo)) for k in kept)], ["b", "i", "x", *more])

    return rows.mapInArrow(run, "n bigint" if count else ", ".join(["b int", "i bigint", "x array<double>", *(f"{c} {rows.schema[c].dataType.simpleString()}" for c in more)]))


def joint(meets: np.ndarray, together: int) -> np.ndarray:
    """Whether a query meets one of each so many blocks."""
    if together == 1:
        return meets
    return np.pad(meets, ((0, 0), (0, -meets.shape[1] % together))).reshape(len(meets), -1, together).any(axis=2)


def _tasks(queries: DataFrame, points: DataFrame, run, schema: str, most: np.ndarray | None = None, parts: int = 0) -> DataFrame:
    """run(queries, points) for each block's points (b, i, x, ..) and the queries sent to it, QUERIES or so at a time, or as many as most says for each block.

    parts: so many partitions, which Spark doesn't merge by their size.
    """
    queries = cut(queries)
    counts = queries.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    limit = lambda b: QUERIES if most is None else max(1, min(QUERIES, int(most[b])))
    times = {r.b: -(-r.n // limit(r.b)) for r in counts.collect() if r.n > limit(r.b)}  # at most a row for each block
    left, right, copies = queries, points, F.lit(1)
    if len(times) > 32:
        # a table for each side: one table's column on both sides of the cogroup is ambiguous
        table = lambda: F.broadcast(queries.sparkSession.createDataFrame(list(times.items()), "b int, copies int"))
        left, right = queries.join(table(), "b", "left"), points.join(table(), "b", "left")
        copies = F.coalesce("copies", F.lit(1))
    else:
        for b, n in times.items():
            copies = F.when(F.col("b") == b, n).otherwise(copies)
    left = left.withColumn("s", F.pmod(F.xxhash64("i"), copies).cast("int")).drop("copies")
    right = right.withColumn("s", F.explode(F.sequence(F.lit(0), copies - 1))).drop("copies")
    if parts:
        left, right = left.repartition(parts, "b", "s"), right.repartition(parts, "b", "s")
    return left.groupBy("b", "s").cogroup(right.groupBy("b", "s")).applyInArrow(run, schema)


def _met(index: Index, queries: DataFrame, work, together: int = 1, most: np.ndarray | None = None) -> DataFrame:
    """(i, j, d2) from work(here, own, ids, rows, ..) for each block, or so many together, and the queries (b, i, x, ..) sent to it."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        here, ids = a["i"].to_numpy(), b["i"].to_numpy()
        more = [a[c].to_numpy() for c in a.column_names if c not in ("b", "s", "i", "x")]
        found = work(here, _matrix(a["x"]), ids, _matrix(b["x"]), *more) if len(here) and len(ids) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"i": pa.array(here[found[0]]), "j": pa.array(ids[found[1]]), "d2": pa.array(found[2])})

    points = index.points if together == 1 else index.points.withColumn("b", (F.col("b") / together).cast("int"))
    return _tasks(queries, points, run, "i bigint, j bigint, d2 double", most)


def near_sums(index: Index, queries: DataFrame, points: DataFrame, limit: float, work, schema: str) -> DataFrame:
    """What work(queries, points, at, to, state) sums up over all pairs within the limit, with no pair ever leaving its task.

    queries and points are rows of the index with more columns (b, i, x, ..); work gets
    both as tables and the places of near pairs, a slice of queries at a time, and
    returns a table of the schema; state is a dict that lasts for the task.
    """
    limit = float(limit)
    bounded = queries.select("b", "i", "x", F.lit(limit**2).alias("tau"), F.lit(2**63 - 1).alias("last"), *queries.columns[3:])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out, state = [], {}
        if a.num_rows and b.num_rows:
            for at, to, _ in within(a["i"].to_numpy(), _matrix(a["x"]), b["i"].to_numpy(), _matrix(b["x"]), limit, True):
                out.append(work(a, b, at, to, state))
        return pa.concat_tables(out) if out else work(a.slice(0, 0), b.slice(0, 0), np.zeros(0, np.int64), np.zeros(0, np.int64), state)

    return _tasks(_sent(index, bounded, True), points, run, schema)


def _homed(index: Index, queries: DataFrame) -> DataFrame:
    """Queries (i, x) with the block of the nearest pivot; of a crowded one, its first part."""
    first = {}
    for k, c in enumerate(map(tuple, index.centres)):
        first.setdefault(c, k)
    places = np.array(sorted(first.values()))
    centres = index.centres[places]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1))
            at = np.concatenate([places[np.argmin(_far(x[lo : lo + BLOCK], centres)[0], axis=1)] for lo in range(0, len(x), BLOCK)]) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), b.column(0), b.column(1)], ["b", "i", "x"])

    return queries.mapInArrow(run, "b int, i bigint, x array<double>")


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("i").orderBy(F.round("d2", DIGITS), "j")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _bounded(index: Index, asked: DataFrame, k: int, itself: bool):
    """The k nearest in the own block, the queries with what bounds them, and what measures them."""
    work = lambda here, own, ids, rows, most=None: nearest(here, own, ids, rows, k, itself, most)
    first = cut(_met(index, asked, work))
    # the worst of k found so far, and its id; a query with fewer has no bound yet
    worst = first.groupBy("i").agg(F.max(F.struct(F.round("d2", DIGITS).alias("d2"), "j")).alias("w"), F.count(F.lit(1)).alias("n"))
    full = F.col("n") >= k
    bounded = asked.join(worst, "i", "left").select("b", "i", "x", F.when(full, F.col("w.d2")).otherwise(float("inf")).alias("tau"), F.when(full, F.col("w.j")).otherwise(2**63 - 1).alias("last"))
    return first, bounded.withColumn("most", F.col("tau")), work


def together(blocks: int, queries: int, sent: int) -> int:
    """How many blocks stand together, from the number of queries and of what they would be sent to."""
    return WIDE if blocks > 1 and sent * WIDEST > queries * blocks else 1


def knn(points: DataFrame, vector: str, k: int, queries: DataFrame | None = None, itself: bool = False, index: Index | None = None) -> DataFrame:
    """(i, j, d2, rank): the k nearest points j of each query i, the cloud itself by default."""
    index = index or build(points, vector)
    if index is None or k < 1:
        return points.sparkSession.createDataFrame([], "i bigint, j bigint, d2 double, rank int")
    asked = index.points if queries is None else cut(_homed(index, _usable(queries, vector)))
    first, bounded, work = _bounded(index, asked, k, itself or queries is not None)
    if index.blocks == 1:
        return ranked(first, k)
    bounded = cut(bounded)
    sent = _sent(index, bounded, False, count=True).agg(F.sum("n")).first()[0] or 0
    if (wide := together(index.blocks, bounded.count(), sent)) > 1:  # what stands together holds the own block too
        return ranked(_met(index, _sent(index, bounded, True, wide), work, wide), k)
    return ranked(first.unionByName(_met(index, _sent(index, bounded, False), work)), k)


def radius(points: DataFrame, vector: str, limit: float, queries: DataFrame | None = None, itself: bool = False, index: Index | None = None, digits: int | None = None) -> DataFrame:
    """(i, j, d2) of all points j within the limit of each query i; d2 rounded to so many digits if given."""
    shown = F.col("d2") if digits is None else F.round("d2", digits) + F.lit(0.0)
    if index is None and queries is None and limit >= 0:
        points, vector = cut(_usable(points, vector)), "x"
        places = cut(points.groupBy("x").agg(F.count(F.lit(1)).alias("n")))
        n, met = places.agg(F.sum("n"), F.sum(F.col("n") * F.col("n"))).first()
        if n and met >= SHARED * n:
            return _radius_of_places(points, places, float(limit), itself, shown)
    index = index or build(points, vector)
    if index is None or limit < 0:
        return points.sparkSession.createDataFrame([], "i bigint, j bigint, d2 double")
    asked = index.points if queries is None else _homed(index, _usable(queries, vector))
    bounded, limit, itself = asked.select("b", "i", "x", F.lit(float(limit) ** 2).alias("tau"), F.lit(2**63 - 1).alias("last")), float(limit), itself or queries is not None

    def work(here, own, ids, rows):
        return tuple(np.concatenate(x) for x in zip(*within(here, own, ids, rows, limit, itself)))

    # a result is one table: few queries meet a block that may be near to all of them
    return _met(index, _sent(index, bounded, True), work, most=PAIRS // np.maximum(index.sizes, 1)).withColumn("d2", shown)


def _radius_of_places(points: DataFrame, places: DataFrame, limit: float, itself: bool, shown: Column) -> DataFrame:
    """radius() for points (i, x) many of which share their place (x, n): places are compared, and their pairs of points made from lists of ids where they are used.

    A place of more than COPIES points is several rows at one place.
    """
    share = F.pmod(F.xxhash64("i"), F.ceil(F.col("n") / COPIES)).alias("share")
    rows = points.join(places, "x").select("x", "i", share).groupBy("x", "share").agg(F.min("i").alias("i"), F.collect_list("i").alias("ids"))
    rows = cut(rows.select("i", "x", "ids"))
    index = build(rows, "x", LEAST, 4 * LEAST)
    listed = cut(index.points.join(rows.select("i", "ids"), "i").select("b", "i", "x", "ids"))
    weights = np.ones(index.blocks)
    for r in listed.groupBy("b").agg(F.sum(F.size("ids")).alias("n")).collect():  # a row for each block
        weights[r.b] = r.n
    bounded = listed.select("b", "i", "x", F.lit(limit**2).alias("tau"), F.lit(2**63 - 1).alias("last"), "ids")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out = [schema.empty_table()]
        if a.num_rows and b.num_rows:
            here, there = (t["ids"].combine_chunks() for t in (a, b))
            for at, to, d in within(a["i"].to_numpy(), _matrix(a["x"]), b["i"].to_numpy(), _matrix(b["x"]), limit, True):
                out.append(pa.table({"d2": d, "ids": here.take(pa.array(at)), "js": there.take(pa.array(to))}).cast(schema))
        return pa.concat_tables(out)

    schema = pa.schema([("d2", pa.float64()), ("ids", pa.list_(pa.int64())), ("js", pa.list_(pa.int64()))])
    parts = max(TASKS, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = _tasks(_sent(index, bounded, True), listed, run, "d2 double, ids array<bigint>, js array<bigint>", PAIRS // np.maximum(weights, 1), parts)
    # Spark holds what it makes of one row: at most COPIES squared pairs
    out = met.select(shown.alias("d2"), "ids", "js").select("d2", F.explode("ids").alias("i"), "js").select("i", F.explode("js").alias("j"), "d2")
    return out if itself else out.where("i <> j")


def share(points: DataFrame, vector: str, k: int, index: Index | None = None) -> float:
    """The share of all ordered pairs that knn() measures."""
    index = index or build(points, vector)
    if index is None:
        return 0.0
    _, bounded, _ = _bounded(index, index.points, k, False)
    met = {r.b: r.n for r in _sent(index, bounded, False).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each block
    sizes = [int(n) for n in index.sizes]
    return sum(n * (n + met.get(b, 0)) for b, n in enumerate(sizes)) / sum(sizes) ** 2
