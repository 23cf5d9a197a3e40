"""Analytic curves and surfaces, as symbolic position maps.

Tangents, frames and normals follow by differentiation. Piecewise shapes select a
piece by the integer part of their first parameter; that part is the sheet label.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import pi

from sheetwise.functions.symbolic import ONE, ZERO, Expr, Var, cases, cos, lift, sin, sqrt

t, u, v = Var("t"), Var("u"), Var("v")


@dataclass(frozen=True)
class Curve:
    position: tuple[Expr, ...]
    domain: tuple[float, float]

    def derivative(self) -> list[Expr]:
        return [lift(p).diff("t") for p in self.position]


@dataclass(frozen=True)
class Surface:
    position: tuple[Expr, ...]
    u: tuple[float, float]
    v: tuple[float, float]
    where: str = "TRUE"

    def derivative(self, by: str) -> list[Expr]:
        return [lift(p).diff(by) for p in self.position]


def polyline(vertices: list[tuple[float, ...]]) -> Curve:
    """A closed polygon, one edge for each unit of t."""
    n, out = len(vertices), []
    for k in range(len(vertices[0])):
        edge = [(f"t < {i + 1}", vertices[i][k] + (t - i) * (vertices[(i + 1) % n][k] - vertices[i][k])) for i in range(n)]
        out.append(cases(*edge[:-1], rest=edge[-1][1]))
    return Curve(tuple(out), (0.0, float(n)))


def pieces(*parts: tuple[Expr, ...], by: str = "t") -> tuple[Expr, ...]:
    """Component-wise choice of a part by floor(by)."""
    out = []
    for comp in zip(*parts, strict=True):
        out.append(cases(*[(f"{by} < {k + 1}", c) for k, c in enumerate(comp[:-1])], rest=comp[-1]))
    return tuple(out)


def ring(n: int, order: list[int] | None = None, z: float = 0.0) -> list[tuple[float, float, float]]:
    from math import cos as c
    from math import sin as s

    at = [(c(2 * pi * k / n + pi / 2), s(2 * pi * k / n + pi / 2), z) for k in range(n)]
    return [at[k] for k in order] if order else at


def curves() -> dict[str, Curve]:
    w, x0 = t - 1, -2.0
    tau = 2 * pi
    half = 3**0.5
    return {
        "circle": Curve((cos(t), sin(t)), (0, tau)),
        "tangent_circles": Curve(pieces((cos(tau * t) - 1, sin(tau * t)), (1 - cos(tau * w), sin(tau * w))), (0, 2)),
        "tangent_circle_line": Curve(pieces((cos(tau * t), sin(tau * t) + 1), (x0 + 4 * w, ZERO)), (0, 2)),
        "tangent_sine_line": Curve(pieces((tau * t, sin(tau * t)), (tau * w, ONE)), (0, 2)),
        "tangent_parabola_line": Curve(pieces((3 * t - 1.5, (3 * t - 1.5) * (3 * t - 1.5)), (3 * w - 1.5, ZERO)), (0, 2)),
        "figure8": Curve((sin(t), sin(t) * cos(t)), (0, tau)),
        "lissajous": Curve((sin(3 * t + pi / 2), sin(2 * t)), (0, tau)),
        "square": polyline([(-1, -1), (1, -1), (1, 1), (-1, 1)]),
        "triangle": polyline([(-1, -half / 3), (1, -half / 3), (0, 2 * half / 3)]),
        "helix": Curve((cos(t), sin(t), 0.25 * t), (0, 4 * pi)),
        "trefoil": Curve((sin(t) + 2 * sin(2 * t), cos(t) - 2 * cos(2 * t), -sin(3 * t)), (0, tau)),
        "mobius_border": Curve(((3 + cos(1.5 * t)) * cos(t), (3 + cos(1.5 * t)) * sin(t), sin(1.5 * t)), (0, 4 * pi)),
        "space_lissajous": Curve((sin(3 * t + pi / 2), sin(2 * t), sin(5 * t)), (0, tau)),
        "figure8_space": Curve((sin(t), sin(t) * cos(t), 0.5 * sin(2 * t)), (0, tau)),
        "square_loop": polyline([(-1, -1, 0), (1, -1, 0), (1, 1, 0), (-1, 1, 0)]),
        "triangle_loop": polyline([(-1, -half / 3, 0), (1, -half / 3, 0), (0, 2 * half / 3, 0)]),
        "cross_curve": polyline([(-1, -1, 0), (1, 1, 0), (1, -1, 0), (-1, 1, 0)]),
        "pentagram": polyline(ring(5, [0, 2, 4, 1, 3])),
    }


def _band(k: int, r: float = 2.0) -> tuple[Expr, ...]:
    return (r + v * cos(k * u / 2)) * cos(u), (r + v * cos(k * u / 2)) * sin(u), v * sin(k * u / 2)


def _boy(m: int, c0: float = 2.0, c1: float = 0.5, c2: float = 0.5, r: float = 4.0) -> tuple[Expr, ...]:
    """A rotating figure of two harmonics, tilted by 45 degrees."""
    base, swing = c0 + c1 * sin(2 * m * v - pi / 3), c2 * sin(m * v - pi / 6)
    a, b = base + swing, base - swing
    length = sqrt(a * a + b * b)
    x, z = (a * a - b * b) / length + a * cos(u) - b * sin(u), length + a * cos(u) + b * sin(u)
    tilt = pi / 8 * sin(m * v)
    return r * (x * cos(v) - z * sin(tilt) * sin(v)), r * (x * sin(v) + z * sin(tilt) * cos(v)), r * z * cos(tilt)


def _etruscan(a=4.0, b=2.0, c=2.0, e=3.0, g=12.0) -> tuple[Expr, ...]:
    """A tube of varying width around a Lissajous loop."""
    dx, dy, width = a * (cos(u) - cos(c * u)), -g * sin(u), b * sin(u) + e
    flat = sqrt(dx * dx + dy * dy)
    return a * sin(u) - b * sin(c * u) - dy * width * cos(v) / flat, g * cos(u) + dx * width * cos(v) / flat, width * sin(v)


def _jeener(s: float, k: float) -> tuple[Expr, ...]:
    w, h = (s + 1) / 4 * cos((s + 1) * u + pi / k) + 2**0.5, (s - 1) / 2
    return s * cos(u) + cos(s * u) - w * sin(h * u) * cos(v), s * sin(u) - sin(s * u) - w * cos(h * u) * cos(v), w * sin(v)


def _banchoff(m: int, a: float = 2.0, b: float = 1.0) -> tuple[Expr, ...]:
    far = a + b * cos(u) * cos(m * v / 2) - b / 2 * sin(2 * u) * sin(m * v / 2)
    return far * cos(v), far * sin(v), b * cos(u) * sin(m * v / 2) + b / 2 * sin(2 * u) * cos(m * v / 2)


def surfaces() -> dict[str, Surface]:
    tau, w = 2 * pi, u - 1
    full = dict(u=(0.0, tau), v=(0.0, tau))
    sheets = dict(u=(0.0, 2.0), v=(0.0, 1.0))
    a, b, x = 3 * u - 1.5, 3 * v - 1.5, 3 * w - 1.5
    p, q = 2 * u - 1, 2 * v - 1
    faces = []
    for k in range(6):
        s, r = (1.0 if k % 2 else -1.0), 2 * (u - k) - 1
        faces.append({0: (lift(s), r, q), 1: (r, lift(s), q), 2: (r, q, lift(s))}[k // 2])
    corner = [(1, 1, 1), (1, -1, -1), (-1, 1, -1), (-1, -1, 1)]
    sides = []
    for k, (i, j, m) in enumerate([(0, 1, 2), (0, 3, 1), (0, 2, 3), (1, 3, 2)]):
        # the unit square folded onto the triangle
        f, g = cases((f"u - {k} + v > 1", 1 - (u - k)), rest=u - k), cases((f"u - {k} + v > 1", 1 - v), rest=v)
        sides.append(tuple(corner[i][d] + f * (corner[j][d] - corner[i][d]) + g * (corner[m][d] - corner[i][d]) for d in range(3)))
    cap = sqrt(1 - 0.64 * ((2 * u - 1) * (2 * u - 1) + q * q) / 2)
    rad = 0.8 * sqrt(v)
    out = {
        "whitney_umbrella": Surface((u * v, u, v * v), (-2, 2), (-1.5, 1.5)),
        "monkey_saddle": Surface((u, v, 0.25 * (u * u * u - 3 * u * v * v)), (-1.5, 1.5), (-1.5, 1.5)),
        "klein_bottle": Surface(((2 + cos(u / 2) * sin(v) - sin(u / 2) * sin(2 * v)) * cos(u), (2 + cos(u / 2) * sin(v) - sin(u / 2) * sin(2 * v)) * sin(u), sin(u / 2) * sin(v) + cos(u / 2) * sin(2 * v)), **full),
        "torus": Surface(((2 + cos(v)) * cos(u), (2 + cos(v)) * sin(u), sin(v)), **full),
        "cone": Surface((u * cos(v), u * sin(v), u), (-1, 1), (0, tau)),
        "plane_cross": Surface(pieces((p, q, ZERO), (2 * w - 1, ZERO, q), by="u"), **sheets),
        "cylinders_tangent": Surface(pieces((a, sin(v - 0.5), cos(v - 0.5) - 1), (sin(v - 0.5), x, 1 - cos(v - 0.5)), by="u"), **sheets),
        "plane_paraboloid": Surface(pieces((a, b, ZERO), (x, b, 0.25 * (x * x + b * b)), by="u"), **sheets),
        "paraboloids": Surface(pieces((a, b, 0.25 * a * a), (x, b, x * x), by="u"), **sheets),
        "hemisphere_paraboloid": Surface(pieces((0.8 * p, 0.8 * q, 1 - cap), (0.8 * (2 * w - 1), 0.8 * q, 0.32 * ((2 * w - 1) * (2 * w - 1) + q * q)), by="u"), **sheets),
        "nested_bowls": Surface(pieces((rad * cos(tau * u), rad * sin(tau * u), 0.3 * rad * rad), (rad * cos(tau * w), rad * sin(tau * w), 0.6 * rad * rad), by="u"), (0, 2), (0.01, 1)),
        "tangent_spheres": Surface(pieces((cos(tau * u) * sin(pi * v) - 1, sin(tau * u) * sin(pi * v), cos(pi * v)), (cos(tau * w) * sin(pi * v) + 1, sin(tau * w) * sin(pi * v), cos(pi * v)), by="u"), (0, 2), (0.05, 0.95)),
        "cube": Surface(pieces(*faces, by="u"), (0, 6), (0, 1)),
        "tetrahedron": Surface(pieces(*sides, by="u"), (0, 4), (0, 1)),
        "mobius_band_1": Surface(_band(1), (0, tau), (-0.5, 0.5)),
        "mobius_band_3": Surface(_band(3), (0, tau), (-0.5, 0.5)),
        "steiner_crosscap": Surface((0.5 * cos(u) * sin(2 * v), 0.5 * sin(u) * sin(2 * v), 0.5 * (cos(v) * cos(v) - cos(u) * cos(u) * sin(v) * sin(v))), (0, tau), (0, pi / 2)),
        "steiner_roman": Surface((0.5 * sin(2 * u) * sin(v) * sin(v), 0.5 * sin(u) * sin(2 * v), 0.5 * cos(u) * sin(2 * v)), (0, pi), (0, pi)),
        "busser_decic": Surface((cos(u) * cos(v), sin(u) * cos(v), sin(2 * v) * cos(1.5 * u)), **full),
        "boy": Surface(_boy(3), (0, tau), (0, pi)),
        "boy_5": Surface(_boy(5), (0, tau), (0, pi)),
        "etruscan_venus": Surface(_etruscan(), (0.05, pi), (0, tau)),
        "jeener_bonan": Surface(_jeener(2, 4), **full),
        "jeener_bonan_2cc": Surface(_jeener(0, 2), **full),
        "busser_nonorientable": Surface((0.5 * cos(u) * cos(v), 0.5 * sin(u) * cos(v), 0.5 * sin(v) - cos(u) * cos(u) * sin(v / 2) * sin(v / 2) * sin(v / 2)), (0, tau), (0, tau)),
        "petit_russian_hat": Surface(((1 + sin(v)) * cos(u), 2 * sin(u) * sin(v), sin(2 * v)), **full),
        "banchoff_klein": Surface(_banchoff(1), **full),
        "banchoff_klein_3": Surface(_banchoff(3), **full),
        "sphere": Surface((2 * sin(v) * cos(u), 2 * sin(v) * sin(u), 2 * cos(v)), (0, tau), (0.3, pi - 0.3)),
    }
    return out
