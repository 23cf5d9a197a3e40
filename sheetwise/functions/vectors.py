"""SQL text for small vectors held in scalar columns; every function takes and returns lists of SQL terms."""

from __future__ import annotations

from collections.abc import Sequence


def columns(prefix: str, n: int, table: str = "") -> list[str]:
    return [f"{table + '.' if table else ''}{prefix}{k}" for k in range(n)]


def dot(a: Sequence[str], b: Sequence[str]) -> str:
    return "(" + " + ".join(f"({x}) * ({y})" for x, y in zip(a, b, strict=True)) + ")"


def minus(a: Sequence[str], b: Sequence[str]) -> list[str]:
    return [f"(({x}) - ({y}))" for x, y in zip(a, b, strict=True)]


def dist2(a: Sequence[str], b: Sequence[str]) -> str:
    d = minus(a, b)
    return dot(d, d)


def norm(a: Sequence[str]) -> str:
    return f"sqrt({dot(a, a)})"


def scale(a: Sequence[str], by: str) -> list[str]:
    return [f"(({x}) * ({by}))" for x in a]


def unit(a: Sequence[str], eps: float = 1e-12) -> list[str]:
    return [f"(({x}) / greatest({norm(a)}, {eps!r}))" for x in a]


def cross(a: Sequence[str], b: Sequence[str]) -> list[str]:
    return [f"(({a[i]}) * ({b[j]}) - ({a[j]}) * ({b[i]}))" for i, j in ((1, 2), (2, 0), (0, 1))]


def named(terms: Sequence[str], prefix: str) -> str:
    return ", ".join(f"{t} AS {prefix}{k}" for k, t in enumerate(terms))


def shown(expr: str, name: str, digits: int = 6) -> str:
    """A rounded output column without negative zeros, equal in every engine."""
    return f"round({expr}, {digits}) + CAST(0 AS DOUBLE) AS {name}"
