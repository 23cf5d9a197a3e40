"""Row rewrites of clouds: filters, rotations, noise, orientation flips, distance fields, levels and colours."""

from __future__ import annotations

from collections.abc import Sequence
from math import cos, sin, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sheetwise.functions import vectors as V


def finite(df: DataFrame, cols: Sequence[str], vector: Sequence[str], eps: float = 1e-8) -> DataFrame:
    """Rows with finite coordinates and a vector longer than eps, which is normalised."""
    ok = F.lit(True)
    for c in [*cols, *vector]:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    out = df.where(ok).where(F.expr(V.norm(vector)) > eps)
    return out.withColumns({c: F.expr(t) for c, t in zip(vector, V.unit(vector))})


def rotate(df: DataFrame, cols: Sequence[str], axis: Sequence[float], angle: float) -> DataFrame:
    """Rotation of three columns about an axis."""
    n = sqrt(sum(a * a for a in axis))
    x, y, z = (a / n for a in axis)
    c, s = cos(angle), sin(angle)
    m = [[c + x * x * (1 - c), x * y * (1 - c) - z * s, x * z * (1 - c) + y * s], [y * x * (1 - c) + z * s, c + y * y * (1 - c), y * z * (1 - c) - x * s], [z * x * (1 - c) - y * s, z * y * (1 - c) + x * s, c + z * z * (1 - c)]]
    return df.withColumns({cols[r]: sum((F.col(cols[k]) * m[r][k] for k in range(3)), F.lit(0.0)) for r in range(3)})


def _uniform(seed: int, salt: int, key: str = "i") -> Column:
    """A number in (0, 1) that depends on the row's id only, so that a repeated task draws the same."""
    return (F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit(salt)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _normal(seed: int, salt: int) -> Column:
    return F.sqrt(-2 * F.log(_uniform(seed, 2 * salt))) * F.cos(2 * 3.141592653589793 * _uniform(seed, 2 * salt + 1))


def point_noise(df: DataFrame, cols: Sequence[str], sigma: float, seed: int = 0) -> DataFrame:
    return df.withColumns({c: F.col(c) + sigma * _normal(seed, k) for k, c in enumerate(cols)})


def jitter(df: DataFrame, cols: Sequence[str], most: float, seed: int = 0) -> DataFrame:
    return df.withColumns({c: F.col(c) + most * (2 * _uniform(seed, k) - 1) for k, c in enumerate(cols)})


def direction_noise(df: DataFrame, vector: Sequence[str], sigma: float, seed: int = 0, renormalize: bool = True) -> DataFrame:
    out = point_noise(df, vector, sigma, seed)
    return out.withColumns({c: F.expr(t) for c, t in zip(vector, V.unit(vector))}) if renormalize else out


def flip(df: DataFrame, vectors: Sequence[Sequence[str]], probability: float = 0.5, seed: int = 0, coupled: bool = False) -> DataFrame:
    """Random signs for each vector, one sign for all if coupled."""
    out = df
    for k, v in enumerate(vectors):
        sign = F.when(_uniform(seed, 0 if coupled else k) < probability, -1.0).otherwise(1.0)
        out = out.withColumns({c: F.col(c) * sign for c in v})
    return out


def downsample(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows picked by a hash of their ids; all rows if there are fewer."""
    return df.withColumn("_o", F.xxhash64("i", F.lit(seed))).orderBy("_o", "i").limit(n).drop("_o")


def clamp(df: DataFrame, col: str, pct: float = 5.0, symmetric: bool = True) -> DataFrame:
    """col limited to its percentiles: both tails' larger bound if symmetric, else 0 to the upper one."""
    edges = df.agg(F.percentile(col, pct / 100).alias("_lo"), F.percentile(col, 1 - pct / 100).alias("_hi"))
    both = df.crossJoin(F.broadcast(edges))  # one row
    bound = F.greatest(F.abs("_lo"), F.abs("_hi"))
    value = F.greatest(-bound, F.least(bound, F.col(col))) if symmetric else F.greatest(F.lit(0.0), F.least(F.col("_hi"), F.col(col)))
    return both.withColumn(col, value).drop("_lo", "_hi")


def distance_fields(df: DataFrame, x: Sequence[str], u: Sequence[str], query: int, alpha: float = 1.0) -> DataFrame:
    """(i, euclid, product): distances to one point in position, and in position and line direction together."""
    one = df.where(F.col("i") == query).select(*[F.col(c).alias(f"q_{c}") for c in (*x, *u)])
    both = df.crossJoin(F.broadcast(one))  # one row
    d2 = V.dist2(x, [f"q_{c}" for c in x])
    line = f"greatest(1 - pow({V.dot(u, [f'q_{c}' for c in u])}, 2), 0)"
    return both.select("i", F.sqrt(F.expr(d2)).alias("euclid"), F.sqrt(F.expr(f"{d2} + {alpha!r} * {line}")).alias("product"))


def closest(df: DataFrame, col: str, k: int | float) -> DataFrame:
    """The k nearest rows by a distance column; a fraction counts of all rows, rounded up."""
    if isinstance(k, float):
        from math import ceil

        k = ceil(k * df.count())
    return df.orderBy(col, "i").limit(int(k))


def level_bounds(df: DataFrame, col: str, levels: int, quantile: bool = False) -> DataFrame:
    """(level, bound): strictly increasing bounds of levels, evenly spaced or by quantiles."""
    shares = [k / levels for k in range(levels + 1)]
    if quantile:
        got = df.agg(F.percentile(col, F.array(*[F.lit(s) for s in shares])).alias("b"))
    else:
        got = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).select(F.array(*[F.col("lo") + (F.col("hi") - F.col("lo")) * s for s in shares]).alias("b"))
    rows = got.select(F.posexplode("b").alias("level", "bound"))
    # a bound that does not exceed the one before is moved by a hair for each repetition
    w = W.orderBy("level")
    return rows.withColumn("same", F.row_number().over(W.partitionBy("bound").orderBy("level")) - 1).select("level", (F.col("bound") + F.col("same") * 1e-12).alias("bound")).withColumn("level", F.row_number().over(w) - 1)


def heat_colour(df: DataFrame, col: str) -> DataFrame:
    """(i, shade): log scale of six decades below the maximum, in [0, 1]."""
    top = df.agg(F.max(col).alias("_top"))
    both = df.crossJoin(F.broadcast(top))  # one row
    return both.select("i", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.log10(F.greatest(F.col(col), F.lit(1e-300)) / F.col("_top")) + 6) / 6)).alias("shade"))
