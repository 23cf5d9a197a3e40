"""Choosing, renumbering and relabelling rows of a cloud."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sheetwise.functions import vectors as V
from sheetwise.operators.neighbors import pair_up, radius_edges
from sheetwise.operators.rewrites import point_noise


def flatten_grid(grid: DataFrame, nv: int, iu: str = "iu", iv: str = "iv") -> DataFrame:
    """Rows of a grid as a list: i = iu * nv + iv takes the place of both numbers."""
    rest = [c for c in grid.columns if c not in (iu, iv, "i")]
    return grid.select((F.col(iu) * nv + F.col(iv)).cast("bigint").alias("i"), *rest)


def stride(points: DataFrame, step: int) -> DataFrame:
    """Every step-th row by id."""
    if step < 1:
        raise ValueError("a step of 1 or more")
    return points.where(F.pmod(F.col("i"), F.lit(step)) == 0)


def remap(kept: DataFrame, marked: DataFrame) -> DataFrame:
    """(old, new): the marked ids (i) that were kept, and their places among the kept ones in the order of ids.

    Places come from counts of ranges of ids, so no window runs over all rows at once.
    """
    span = kept.agg(F.min("i").alias("lo"), F.max("i").alias("hi")).first()
    if span.lo is None:
        return kept.select(F.col("i").alias("old"), F.col("i").alias("new")).limit(0)
    width = max((span.hi - span.lo + 1) // 4096, 1)
    part = F.floor((F.col("i") - span.lo) / width).cast("long")
    counts = kept.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # 4097 rows at most
    before = counts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    local = kept.select("i", part.alias("part")).withColumn("at", F.row_number().over(W.partitionBy("part").orderBy("i")) - 1)
    places = local.join(F.broadcast(before), "part").select(F.col("i").alias("old"), (F.col("at") + F.col("before")).cast("bigint").alias("new"))
    return places.join(marked.select(F.col("i").alias("old")).distinct(), "old", "left_semi")


def _order(seed: int) -> Column:
    """A number in [0, 1) by id that every engine computes alike."""
    return F.expr(f"(i + {seed}) * 0.6180339887498949 - floor((i + {seed}) * 0.6180339887498949)")


def pick_queries(points: DataFrame, singular: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(i, singular): n points, the first of them singular if there is any, the others distinct from it."""
    first = singular.select("i").distinct().join(points.select("i"), "i", "left_semi").orderBy(_order(seed), "i").limit(1)
    rest = points.select("i").distinct().join(first, "i", "left_anti").orderBy(_order(seed), "i").limit(n)
    both = first.select("i", F.lit(True).alias("singular")).unionByName(rest.select("i", F.lit(False).alias("singular")))
    return both.orderBy(F.desc("singular"), _order(seed), "i").limit(n)


def resolve_sources(sources: int | Sequence[int], n: int) -> list[int]:
    """Source numbers in 0..n-1, negative ones counted from the end; at least one, each once, in their order."""
    each = [sources] if isinstance(sources, int) else list(sources)
    out = [int(s) + n if s < 0 else int(s) for s in each]
    if not out or any(not 0 <= s < n for s in out):
        raise ValueError(f"sources must lie in -{n}..{n - 1}, at least one")
    return list(dict.fromkeys(out))


def noise_variants(points: DataFrame, x: Sequence[str], shares: Sequence[float], seed: int = 0) -> DataFrame:
    """The cloud once for each share, with `share` and normal noise of that share of the bounding box's diagonal."""
    box = points.agg(*[(F.max(c) - F.min(c)).alias(c) for c in x]).first()
    diagonal = sum(float(box[c] or 0.0) ** 2 for c in x) ** 0.5
    out = None
    for n, share in enumerate(shares):
        one = point_noise(points, x, share * diagonal, seed + n).withColumn("share", F.lit(float(share)))
        out = one if out is None else out.unionByName(one)
    return out


def smooth_tangents(points: DataFrame, x: Sequence[str], u: Sequence[str], radius: float, group: str, iterations: int = 3) -> DataFrame:
    """The cloud with tangents averaged over the points of their group within the radius, turned to their own side first."""
    edges = radius_edges(points, x, radius, include_self=True).select("i", "j")
    for _ in range(iterations):
        both = pair_up(edges, points, [*u, group]).where(F.col(f"a_{group}") == F.col(f"b_{group}"))
        sign = F.expr(f"CASE WHEN {V.dot([f'a_{c}' for c in u], [f'b_{c}' for c in u])} < 0 THEN -1 ELSE 1 END")
        mean = both.groupBy("i").agg(*[F.avg(sign * F.col(f"b_{c}")).alias(f"m_{c}") for c in u])
        unit = V.unit([f"m_{c}" for c in u])
        points = points.join(mean, "i").select(*[F.expr(unit[u.index(c)]).alias(c) if c in u else F.col(c) for c in points.columns])
    return points


def normalize_uv(points: DataFrame, uv: Sequence[str] = ("u", "v")) -> DataFrame:
    """Parameters moved to [0, 1] by their least and largest values; a constant one becomes 0."""
    box = points.agg(*[f(c).alias(f"{n}_{c}") for c in uv for n, f in (("lo", F.min), ("hi", F.max))])
    each = {c: F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), (F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}"))).otherwise(0.0) for c in uv}
    return points.crossJoin(F.broadcast(box)).withColumns(each).select(*points.columns)  # one row of bounds


def checker(uv: Sequence[str], squares: int) -> Column:
    """0 or 1: the colour of a checkerboard over normalised parameters."""
    each = [F.least(F.floor(F.col(c) * squares), F.lit(squares - 1)) for c in uv]
    return F.pmod(sum(each[1:], each[0]), F.lit(2)).cast("bigint")


def normalized(values: DataFrame, col: str, how: str = "maxabs") -> DataFrame:
    """A column over its largest absolute value ('maxabs'), or less its mean over its deviation ('zscore'); constants become 0."""
    if how == "none":
        return values
    if how == "maxabs":
        s, out = values.agg(F.max(F.abs(F.col(col))).alias("_s")), F.col(col) / F.col("_s")
    elif how == "zscore":
        s, out = values.agg(F.avg(col).alias("_m"), F.stddev_pop(col).alias("_s")), (F.col(col) - F.col("_m")) / F.col("_s")
    else:
        raise ValueError(f"no way {how}")
    return values.crossJoin(F.broadcast(s)).withColumn(col, F.when(F.col("_s") > 0, out).otherwise(0.0)).select(*values.columns)  # one row


def projector_entries(points: DataFrame, u: Sequence[str]) -> DataFrame:
    """(i, row, col, value) of the projectors on line directions."""
    each = [F.struct(F.lit(r).cast("bigint").alias("row"), F.lit(c).cast("bigint").alias("col"), (F.col(a) * F.col(b)).alias("value")) for r, a in enumerate(u) for c, b in enumerate(u)]
    return points.select("i", F.explode(F.array(*each)).alias("e")).select("i", "e.row", "e.col", "e.value")


def best_accuracy(rows: DataFrame, truth: str, label: str, most: int = 7) -> float:
    """The share of rows whose label is the truth under the best renaming of labels; from counts of pairs, a row a pair."""
    counts = {(r[0], r[1]): r[2] for r in rows.groupBy(truth, label).count().collect()}
    truths, labels = sorted({a for a, _ in counts}, key=repr), sorted({b for _, b in counts}, key=repr)
    if max(len(truths), len(labels)) > most:
        raise ValueError(f"more than {most} classes")
    wide = truths + [None] * max(0, len(labels) - len(truths))
    best = max((sum(counts.get((a, b), 0) for a, b in zip(p, labels)) for p in permutations(wide, len(labels))), default=0)
    return best / max(sum(counts.values()), 1)


def alignment(pairs: DataFrame, a: Sequence[str], b: Sequence[str]) -> DataFrame:
    """One row: the mean absolute cosine of two unit vectors a row."""
    return pairs.agg(F.avg(F.abs(F.expr(V.dot(a, b)))).alias("alignment"))
