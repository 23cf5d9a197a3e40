"""Tangent frames and distances between subspaces, as SQL terms over scalar columns."""

from __future__ import annotations

from collections.abc import Sequence

from sheetwise.functions import vectors as V


def frame_terms(n: Sequence[str]) -> tuple[list[str], list[str]]:
    """Two orthonormal vectors across a unit normal; the seed is the axis of its smallest component."""
    a = [f"abs({c})" for c in n]
    first = f"({a[0]} <= {a[1]} AND {a[0]} <= {a[2]})"
    seed = [f"(CASE WHEN {first} THEN 1.0 ELSE 0.0 END)", f"(CASE WHEN NOT {first} AND {a[1]} <= {a[2]} THEN 1.0 ELSE 0.0 END)", f"(CASE WHEN {first} OR {a[1]} <= {a[2]} THEN 0.0 ELSE 1.0 END)"]
    e1 = V.unit(V.cross(n, seed))
    return e1, V.cross(n, e1)


def chordal(cosines2: str, d: int) -> str:
    """Chordal distance of two d-planes from the sum of squared cosines."""
    return f"sqrt(greatest({d} - ({cosines2}), 0))"


def angle(a: Sequence[str], b: Sequence[str]) -> str:
    """The principal angle of two lines."""
    return f"acos(least(1.0, abs({V.dot(a, b)})))"


def inverse2(a: str, b: str, c: str, floor: float = 1e-30) -> list[str]:
    """The inverse of [[a, b], [b, c]], its determinant kept away from 0."""
    det = f"greatest(({a}) * ({c}) - ({b}) * ({b}), {floor!r})"
    return [f"(({c}) / {det})", f"(-({b}) / {det})", f"(({a}) / {det})"]


def ambient_dims(n: int, levels: int) -> list[int]:
    """Widths of the successive lifts of an n-dimensional cloud."""
    out = [n]
    for _ in range(levels):
        out.append(out[-1] + out[-1] ** 2)
    return out


def perm_sign(order: Sequence[int]) -> int:
    """1 for an even order of 0..n-1, -1 for an odd one."""
    out, left = 1, list(order)
    for k in range(len(left)):
        while left[k] != k:
            j = left[k]
            left[k], left[j] = left[j], left[k]
            out = -out
    return out


def blade(u: Sequence[str], v: Sequence[str]) -> dict[tuple[int, int], str]:
    """Pluecker coordinates of the plane of two vectors: all 2 x 2 minors, by the pair of rows."""
    n = len(u)
    return {(i, j): f"(({u[i]}) * ({v[j]}) - ({u[j]}) * ({v[i]}))" for i in range(n) for j in range(i + 1, n)}


def hodge_pairs(n: int, d: int) -> dict[tuple[int, ...], tuple[tuple[int, ...], int]]:
    """For each choice of d of n axes, the other axes and the sign of both together as an order."""
    from itertools import combinations

    out = {}
    for own in combinations(range(n), d):
        rest = tuple(k for k in range(n) if k not in own)
        out[own] = (rest, perm_sign(own + rest))
    return out
