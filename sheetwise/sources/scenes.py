"""Scenes of several sheets, and samplers by area, as SELECTs over a table `ids` of 0..n-1.

Random choices use low-discrepancy sequences of the row number, so every engine and
every repeated task draws the same.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, SparkSession

from sheetwise.functions import vectors as V
from sheetwise.functions.symbolic import num
from sheetwise.sources.catalogue import Surface, surfaces
from sheetwise.sources.generators import PHI, PLASTIC, seq

#: The third additive step, for choices beside the two of a parameter pair.
THIRD = 0.5698402909980532


def _grid(n: int, unit: str, lo: float, hi: float, endpoint: bool = True) -> str:
    return f"({num(lo)} + ({unit}) * {num((hi - lo) / max(n - 1 if endpoint else n, 1))})"


def two_circles_sql(n: int, apart: float = 0.5, ids: str = "ids") -> str:
    """i, label, x0, x1, u0, u1: unit circles about (-apart, 0) and (apart, 0), half of the points on each."""
    inner = f"SELECT i, CAST(CASE WHEN 2 * i < {n} THEN 0 ELSE 1 END AS BIGINT) AS label, {num(4 * pi / n)} * i AS a FROM {ids}"
    return f"SELECT i, label, cos(a) + {num(apart)} * (2 * label - 1) AS x0, sin(a) AS x1, -sin(a) AS u0, cos(a) AS u1 FROM ({inner}) p"


def two_sheets_sql(n: int, height: float = 0.3, ids: str = "ids") -> str:
    """i, label, x0..x2, n0..n2: the graphs of a product of sines over the xy and over the yz plane, n by n points each."""
    inner = f"SELECT i, CAST(floor(i / {num(n * n)}) AS BIGINT) AS label, {_grid(n, f'floor(i / {num(n)}) % {n}', -1, 1)} AS u, {_grid(n, f'i % {n}', -1, 1)} AS v FROM {ids}"
    mapped = f"SELECT i, label, u, v, {num(height)} * sin({num(pi)} * u) * sin({num(pi)} * v) AS z, {num(-height * pi)} * cos({num(pi)} * u) * sin({num(pi)} * v) AS gu, {num(-height * pi)} * sin({num(pi)} * u) * cos({num(pi)} * v) AS gv FROM ({inner}) p"
    length = "sqrt(1 + gu * gu + gv * gv)"
    first, second = ("u", "v", "z", f"gu / {length}", f"gv / {length}", f"1 / {length}"), ("z", "u", "v", f"1 / {length}", f"gu / {length}", f"gv / {length}")
    cols = [*V.columns("x", 3), *V.columns("n", 3)]
    return f"SELECT i, label, {', '.join(f'CASE WHEN label = 0 THEN {a} ELSE {b} END AS {c}' for a, b, c in zip(first, second, cols))} FROM ({mapped}) q"


def two_spheres_sql(n: int, half: float = 0.6, radius: float = 1.0, ids: str = "ids") -> str:
    """i, label, x0..x2, n0..n2: spheres about (-half, 0, 0) and (half, 0, 0), n by n points each."""
    inner = f"SELECT i, CAST(floor(i / {num(n * n)}) AS BIGINT) AS label, {_grid(n, f'floor(i / {num(n)}) % {n}', 0, 2 * pi, False)} AS a, {_grid(n, f'i % {n}', 0, pi)} AS p FROM {ids}"
    normal = f"SELECT i, label, sin(p) * cos(a) AS n0, sin(p) * sin(a) AS n1, cos(p) AS n2 FROM ({inner}) g"
    return f"SELECT i, label, {num(half)} * (2 * label - 1) + {num(radius)} * n0 AS x0, {num(radius)} * n1 AS x1, {num(radius)} * n2 AS x2, n0, n1, n2 FROM ({normal}) q"


def sphere_cylinder_sql(n: int, ids: str = "ids") -> str:
    """i, label, x0..x2, n0..n2: the unit sphere and the cylinder of radius 1/2 that touches its axis, n by n points each."""
    inner = f"SELECT i, CAST(floor(i / {num(n * n)}) AS BIGINT) AS label, {_grid(n, f'i % {n}', 0, 2 * pi, False)} AS a, floor(i / {num(n)}) % {n} AS r FROM {ids}"
    polar = f"SELECT i, label, a, {_grid(n, 'r', 0, pi)} AS p, {_grid(n, 'r', -1, 1)} AS h FROM ({inner}) g"
    sphere = ("sin(p) * cos(a)", "sin(p) * sin(a)", "cos(p)") * 2
    tube = ("0.5 + 0.5 * cos(a)", "0.5 * sin(a)", "h", "cos(a)", "sin(a)", "CAST(0 AS DOUBLE)")
    cols = [*V.columns("x", 3), *V.columns("n", 3)]
    return f"SELECT i, label, {', '.join(f'CASE WHEN label = 0 THEN {a} ELSE {b} END AS {c}' for a, b, c in zip(sphere, tube, cols))} FROM ({polar}) q"


def thin_tube_sql(n_theta: int, n_z: int, layers: int = 3, radius: float = 0.5, height: float = 2.0, thickness: float = 0.02, noise: float = 0.005, ids: str = "ids") -> str:
    """i, layer, x0..x2, n0..n2: a cylinder in layers; normals of those inside the radius point inwards."""
    each = n_theta * n_z
    inner = f"SELECT i, CAST(floor(i / {num(each)}) AS BIGINT) AS layer, {_grid(n_theta, f'i % {n_theta}', 0, 2 * pi, False)} + {num(noise)} * (2 * {seq(PHI)} - 1) AS a, {_grid(n_z, f'floor(i / {num(n_theta)}) % {n_z}', 0, height)} + {num(noise)} * (2 * {seq(PLASTIC)} - 1) AS z FROM {ids}"
    ring = f"SELECT *, {_grid(layers, 'layer', radius - thickness / 2, radius + thickness / 2)} AS r FROM ({inner}) g"
    sign = f"(CASE WHEN r >= {num(radius - 1e-12)} THEN 1 ELSE -1 END)"
    return f"SELECT i, layer, r * cos(a) AS x0, r * sin(a) AS x1, z AS x2, {sign} * cos(a) AS n0, {sign} * sin(a) AS n1, CAST(0 AS DOUBLE) AS n2 FROM ({ring}) q"


def forest_sql(trees: int, depth: int, per_branch: int, spread: float = 0.5, shrink: float = 0.7, apart: float = 3.0) -> str:
    """i, tree, branch, x0, x1, u0, u1: points along the branches of binary trees; branch b has the children 2 b and 2 b + 1."""
    half = num(spread)
    return f"""WITH RECURSIVE b(tree, branch, depth, x, y, a, len) AS (
  SELECT CAST(id AS BIGINT), CAST(1 AS BIGINT), 0, {num(apart)} * id, {num(0)}, {num(pi / 2)}, {num(1)} FROM (VALUES {', '.join(f'({k})' for k in range(trees))}) t(id)
  UNION ALL SELECT tree, 2 * branch + s, depth + 1, x + len * cos(a), y + len * sin(a), a + {half} * (2 * s - 1), len * {num(shrink)} FROM b CROSS JOIN (VALUES (0), (1)) q(s) WHERE depth < {depth - 1})
SELECT (tree * {2**depth} + branch) * {per_branch} + k AS i, tree, branch, x + len * cos(a) * k / {num(per_branch)} AS x0, y + len * sin(a) * k / {num(per_branch)} AS x1, cos(a) AS u0, sin(a) AS u1
FROM b CROSS JOIN (VALUES {', '.join(f'({k})' for k in range(per_branch))}) s(k)"""


def _area(surface: Surface) -> str:
    """The area element of a surface as SQL over u and v."""
    return V.norm(V.cross([d.sql() for d in surface.derivative("u")], [d.sql() for d in surface.derivative("v")]))


def _mapped(surface: Surface, source: str) -> str:
    normal = V.unit(V.cross([d.sql() for d in surface.derivative("u")], [d.sql() for d in surface.derivative("v")]))
    return f"SELECT i, u, v, {V.named([p.sql() for p in surface.position], 'x')}, {V.named(normal, 'n')} FROM ({source}) m"


def _spread(surface: Surface, ids: str) -> str:
    us, vs = (f"({num(a)} + {num(b - a)} * {seq(step)})" for (a, b), step in ((surface.u, PHI), (surface.v, PLASTIC)))
    return f"SELECT i, {seq(THIRD)} AS r, {us} AS u, {vs} AS v FROM {ids}"


def area_uniform_sql(surface: Surface, n: int, grid: str, ids: str = "ids") -> str:
    """i, u, v, x.., n..: the first n candidates of `ids` that a rejection by the area element keeps.

    `grid` is a table of 0..1023: the largest element on a 32 by 32 grid, and a twentieth more, bounds the element.
    """
    (u0, u1), (v0, v1) = surface.u, surface.v
    nodes = f"SELECT {_grid(32, f'floor(i / {num(32)})', u0, u1)} AS u, {_grid(32, 'i % 32', v0, v1)} AS v FROM {grid}"
    top = f"SELECT 1.05 * max({_area(surface)}) AS top FROM ({nodes}) g"
    kept = f"SELECT i, u, v FROM ({_spread(surface, ids)}) c CROSS JOIN ({top}) t WHERE r * top < {_area(surface)} ORDER BY i LIMIT {n}"
    return _mapped(surface, kept)


def area_weighted_sql(surface: Surface, n: int, ids: str = "ids") -> str:
    """i, u, v, x.., n..: n rows of `ids` without replacement, drawn with probabilities by area (the n least -ln r / area)."""
    kept = f"SELECT i, u, v FROM ({_spread(surface, ids)}) c WHERE r > 0 AND {_area(surface)} > 1e-12 ORDER BY round(-ln(r) / {_area(surface)}, 9), i LIMIT {n}"
    return _mapped(surface, kept)


def scene(spark: SparkSession, sql: str, n: int) -> DataFrame:
    """The rows of one of the SELECTs above, written with ids={ids}."""
    from pyspark.sql import functions as F

    ids = spark.range(n).select(F.col("id").alias("i"))
    return spark.sql(sql, ids=ids)


def area_uniform(spark: SparkSession, name: str, n: int, candidates: int | None = None) -> DataFrame:
    """n points of a catalogue surface, uniform by area; candidates are doubled until enough are kept, an error after 4096 n."""
    from pyspark.sql import functions as F

    tried = candidates or 4 * n
    grid = spark.range(1024).select(F.col("id").alias("i"))
    while True:
        ids = spark.range(tried).select(F.col("id").alias("i"))
        out = spark.sql(area_uniform_sql(surfaces()[name], n, "{grid}", "{ids}"), grid=grid, ids=ids)
        if out.count() >= n:
            return out
        if tried > 4096 * n:
            raise RuntimeError(f"fewer than {n} points in {tried} candidates")
        tried *= 2
