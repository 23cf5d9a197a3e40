"""Small symbolic expressions: written once, differentiated, and rendered as SQL text.

The text uses only functions that Spark SQL and ANSI engines share, so a curve or a
surface is a set of column expressions that whole-stage code generation compiles.
"""

from __future__ import annotations

from dataclasses import dataclass


def num(x: float) -> str:
    """A literal that every engine reads as the same double."""
    return f"{float(x):.17e}"


class Expr:
    def __add__(self, o):
        o = lift(o)
        if self == ZERO:
            return o
        return self if o == ZERO else Op("+", self, o)

    def __radd__(self, o):
        return lift(o) + self

    def __neg__(self):
        return lift(-1) * self

    def __sub__(self, o):
        return self + (-lift(o))

    def __rsub__(self, o):
        return lift(o) + (-self)

    def __mul__(self, o):
        o = lift(o)
        if ZERO in (self, o):
            return ZERO
        if self == ONE:
            return o
        return self if o == ONE else Op("*", self, o)

    def __rmul__(self, o):
        return lift(o) * self

    def __truediv__(self, o):
        o = lift(o)
        return ZERO if self == ZERO else Op("/", self, o)

    def __rtruediv__(self, o):
        return lift(o) / self


@dataclass(frozen=True, eq=True)
class Num(Expr):
    value: float

    def sql(self):
        return num(self.value)

    def diff(self, x):
        return ZERO


@dataclass(frozen=True, eq=True)
class Var(Expr):
    name: str

    def sql(self):
        return self.name

    def diff(self, x):
        return ONE if x == self.name else ZERO


@dataclass(frozen=True, eq=True)
class Op(Expr):
    op: str
    a: Expr
    b: Expr

    def sql(self):
        return f"({self.a.sql()} {self.op} {self.b.sql()})"

    def diff(self, x):
        a, b = self.a.diff(x), self.b.diff(x)
        if self.op == "+":
            return a + b
        if self.op == "*":
            return a * self.b + self.a * b
        return a / self.b - self.a * b / (self.b * self.b)


@dataclass(frozen=True, eq=True)
class Fn(Expr):
    name: str
    a: Expr

    def sql(self):
        return f"{self.name}({self.a.sql()})"

    def diff(self, x):
        inner = self.a.diff(x)
        if inner == ZERO:
            return ZERO
        outer = {"sin": lambda: cos(self.a), "cos": lambda: -sin(self.a), "sqrt": lambda: 0.5 / self, "exp": lambda: self}[self.name]()
        return outer * inner


@dataclass(frozen=True, eq=True)
class Cases(Expr):
    """The first branch whose SQL condition holds; conditions are not differentiated."""

    branches: tuple[tuple[str, Expr], ...]
    rest: Expr

    def sql(self):
        return "CASE " + " ".join(f"WHEN {c} THEN {e.sql()}" for c, e in self.branches) + f" ELSE {self.rest.sql()} END"

    def diff(self, x):
        return Cases(tuple((c, e.diff(x)) for c, e in self.branches), self.rest.diff(x))


ZERO, ONE = Num(0.0), Num(1.0)


def lift(x) -> Expr:
    return x if isinstance(x, Expr) else Num(float(x))


def sin(x):
    return Fn("sin", lift(x))


def cos(x):
    return Fn("cos", lift(x))


def sqrt(x):
    return Fn("sqrt", lift(x))


def exp(x):
    return Fn("exp", lift(x))


def cases(*branches, rest) -> Expr:
    return Cases(tuple((c, lift(e)) for c, e in branches), lift(rest))
