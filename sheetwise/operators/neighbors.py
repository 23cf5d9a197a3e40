"""Neighbour joins over point clouds: k nearest, radius, cross-cloud, over the pivot index of `pivots`.

A cloud is a DataFrame with an id `i` and coordinates in scalar columns or, for vectors
of any width, in an array. Ties are broken by id after rounding squared distances to 9
digits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.functions import vectors as V
from sheetwise.operators import pivots
from sheetwise.operators.pivots import DIGITS


def _vector(points: DataFrame, cols: Sequence[str]) -> DataFrame:
    return points.select("i", F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))


def radius_edges(points: DataFrame, cols: Sequence[str], radius: float, queries: DataFrame | None = None, include_self: bool = False, digits: int | None = None) -> DataFrame:
    """(i, j, d2) for all pairs within the radius (empty for radius <= 0); queries default to the cloud itself; d2 rounded to so many digits if given."""
    limit = radius if radius > 0 else -1.0
    return pivots.radius(_vector(points, cols), "x", limit, None if queries is None else _vector(queries, cols), include_self, digits=digits)


def nearest_in(queries: DataFrame, points: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(i, j, d2): the nearest point of another cloud for each query; none if that cloud is empty."""
    return pivots.knn(_vector(points, cols), "x", 1, _vector(queries, cols)).select("i", "j", "d2")


def knn_edges(points: DataFrame, cols: Sequence[str], k: int, include_self: bool = False) -> DataFrame:
    """(i, j, d2, rank): the k nearest of each point, itself excluded by id."""
    return pivots.knn(_vector(points, cols), "x", k, itself=include_self)


def knn_vectors(points: DataFrame, vector: str, k: int, block: int = pivots.BLOCK) -> DataFrame:
    """(i, j, d2, rank) for array columns of any width; squared distances are rounded."""
    index = pivots.build(points, vector, block)
    return pivots.knn(points, vector, k, index=index).withColumn("d2", F.round("d2", DIGITS))


def chamfer(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row `chamfer`: mean distance to the nearest point of the other cloud, both ways summed; infinite if one is empty."""

    def nearest(x: DataFrame, y: DataFrame) -> DataFrame:
        return nearest_in(x, y, cols).agg(F.avg(F.sqrt("d2")).alias("m"))

    return nearest(a, b).unionAll(nearest(b, a)).agg(F.when(F.count("m") == 2, F.sum("m")).otherwise(F.lit(float("inf"))).alias("chamfer"))


def pair_up(edges: DataFrame, points: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Edges with the columns of both ends as a_.. and b_.."""
    cols = list(dict.fromkeys(cols))
    a = points.select("i", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = points.select(F.col("i").alias("j"), *[F.col(c).alias(f"b_{c}") for c in cols])
    return edges.join(a, "i").join(b, "j")


def self_intersections(points: DataFrame, cols: Sequence[str], tangents: Sequence[str], k: int = 5, separation: int = 10, cosine: float = 0.8660254037844387) -> DataFrame:
    """(i): points that have a near neighbour far along the curve with a different direction; both ends count."""
    both = pair_up(knn_edges(points, cols, k), points, tangents)
    angle = F.abs(F.expr(V.dot([f"a_{c}" for c in tangents], [f"b_{c}" for c in tangents])))
    hit = both.where((F.abs(F.col("i") - F.col("j")) >= separation) & (angle <= cosine))
    return hit.select("i").unionAll(hit.select(F.col("j").alias("i"))).distinct()


def normal_singularities(points: DataFrame, cols: Sequence[str], normals: Sequence[str], k: int = 20, cosine: float = 0.7071067811865476) -> DataFrame:
    """(i, singular): whether a neighbour's normal departs by more than the angle, whatever its sign."""
    both = pair_up(knn_edges(points, cols, k), points, normals)
    angle = F.abs(F.expr(V.dot([f"a_{c}" for c in normals], [f"b_{c}" for c in normals])))
    return both.groupBy("i").agg(F.bool_or(angle < cosine).alias("singular"))
