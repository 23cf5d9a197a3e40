"""Implicit surfaces: a small network whose zero set runs through oriented points.

Training happens on the driver over a bounded sample, or in all tasks over all rows;
evaluating and projecting points onto the zero set is one Arrow pass over any number of
rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.plans.lineage import cut

#: Points used for training on the driver unless told otherwise.
SAMPLE = 20_000


def _silu(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """SiLU, its first and its second derivative."""
    s = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    d = s + z * s * (1 - s)
    return z * s, d, s * (1 - s) * (2 + z * (1 - 2 * s))


@dataclass
class Field:
    """f(x) = w . silu(A x + b) + c, and its gradient."""

    a: np.ndarray
    b: np.ndarray
    w: np.ndarray
    c: float

    def value(self, x: np.ndarray) -> np.ndarray:
        return _silu(x @ self.a.T + self.b)[0] @ self.w + self.c

    def gradient(self, x: np.ndarray) -> np.ndarray:
        return (_silu(x @ self.a.T + self.b)[1] * self.w) @ self.a


def _start(d: int, hidden: int, r: np.random.Generator) -> list[np.ndarray]:
    return [r.normal(size=(hidden, d)) * 2 / d**0.5, r.normal(size=hidden), r.normal(size=hidden) / hidden**0.5, np.zeros(1)]


def _trained(p: list[np.ndarray], at: np.ndarray, normal: np.ndarray, lo: np.ndarray, hi: np.ndarray, r: np.random.Generator, steps: int, done: int, epochs: int, rate: float, align: float, screen: float) -> list[np.ndarray]:
    """The parameters after some steps of Adam, of which `done` of `epochs` lie behind."""
    d = at.shape[1]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    for step in range(1, steps + 1):
        k = r.integers(0, len(at), min(256, len(at)))
        px, pn = at[k], normal[k]
        y, d1, d2 = _silu(px @ p[0].T + p[1])
        f, g = y @ p[2] + p[3], (d1 * p[2]) @ p[0]
        size = len(k)
        ef, eg = 2 * f / size, 2 * align * (g - pn) / size
        back = eg @ p[0].T  # (size, hidden): how the gradient's error reaches d1 * w
        dz = ef[:, None] * d1 * p[2] + back * d2 * p[2]
        grads = [dz.T @ px + (d1 * p[2]).T @ eg, dz.sum(axis=0), y.T @ ef + (d1 * back).sum(axis=0), np.array([ef.sum()])]
        off = r.uniform(lo, hi, (128, d))
        y, d1, _ = _silu(off @ p[0].T + p[1])
        f = y @ p[2] + p[3]
        ef = -screen * np.sign(f) * 20 * np.exp(-20 * np.abs(f)) / len(off)
        dz = ef[:, None] * d1 * p[2]
        for q, more in zip(grads, (dz.T @ off, dz.sum(axis=0), y.T @ ef, np.array([ef.sum()]))):
            q += more
        length = np.sqrt(sum((q**2).sum() for q in grads))
        scale = min(1.0, 1.0 / max(length, 1e-12))
        now = rate * (0.01 + 0.99 * (1 + np.cos(np.pi * (done + step) / epochs)) / 2)
        for k, q in enumerate(grads):
            q = q * scale
            m[k], v[k] = 0.9 * m[k] + 0.1 * q, 0.999 * v[k] + 0.001 * q * q
            p[k] = p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return p


def fit(points: DataFrame, x: list[str], n: list[str], hidden: int = 64, epochs: int = 1500, rate: float = 0.02, align: float = 0.5, screen: float = 0.05, seed: int = 0, sample: int | None = SAMPLE, rounds: int = 12) -> Field:
    """Adam on: f = 0 on the points, its gradient along their normals, and f away from 0 off the surface.

    Up to `sample` points, picked by a hash of their ids, train on the driver. With
    sample=None all rows take part: in each of `rounds` rounds every task trains the
    shared network on its own rows, a batch of them at a time, and the driver averages
    what comes back by numbers of rows. Rows with a null coordinate are left out.
    """
    d = len(x)
    used = points.select("i", *x, *n).dropna()
    rest = (epochs, rate, align, screen)
    if sample is not None:
        got = used.orderBy(F.xxhash64("i"), "i").limit(sample).select(*x, *n).toPandas().to_numpy()
        r = np.random.default_rng(seed)
        p = _start(d, hidden, r)
        at, normal = got[:, :d], got[:, d:]
        p = _trained(p, at, normal, at.min(axis=0) - 0.5, at.max(axis=0) + 0.5, r, epochs, 0, *rest)
        return Field(p[0], p[1], p[2], float(p[3][0]))
    box = used.agg(*[f(c).alias(f"{w}_{c}") for c in x for w, f in (("lo", F.min), ("hi", F.max))]).first()
    lo, hi = np.array([box[f"lo_{c}"] for c in x]) - 0.5, np.array([box[f"hi_{c}"] for c in x]) + 0.5
    p, each = _start(d, hidden, np.random.default_rng(seed)), -(-epochs // rounds)
    # dealt by a hash, so that each task sees the whole surface
    dealt = cut(used.repartition(F.xxhash64("i")).select(*x, *n))
    for turn in range(rounds):

        def run(batches, p=p, turn=turn):
            q, rows, r = p, 0, np.random.default_rng((seed, turn))
            whole = [pdf.to_numpy() for pdf in batches]
            total = max(sum(map(len, whole)), 1)
            for part in whole:
                if len(part):
                    steps = max(1, round(each * len(part) / total))
                    q = _trained(q, part[:, :d], part[:, d:], lo, hi, r, steps, turn * each, *rest)
                    rows += len(part)
            if rows:
                yield pd.DataFrame({"n": [rows], "p": [np.concatenate([v.ravel() for v in q]).tobytes()]})

        back = [(r.n, np.frombuffer(r.p)) for r in dealt.mapInPandas(run, "n bigint, p binary").collect()]  # a network a task
        flat = sum(n * v for n, v in back) / sum(n for n, _ in back)
        ends = np.cumsum([v.size for v in p])
        p = [v.reshape(w.shape) for v, w in zip(np.split(flat, ends[:-1]), p)]
    return Field(p[0], p[1], p[2], float(p[3][0]))


def project(points: DataFrame, x: list[str], field: Field, steps: int = 30, rate: float = 0.5) -> DataFrame:
    """(i, x.., residual): points moved onto the zero set by damped Newton steps."""

    def run(batches):
        for pdf in batches:
            at = pdf[x].to_numpy(float)
            for _ in range(steps):
                g = field.gradient(at)
                at = at - rate * (field.value(at) / ((g * g).sum(axis=1) + 1e-6))[:, None] * g
            yield pd.DataFrame({"i": pdf["i"], **{c: at[:, k] for k, c in enumerate(x)}, "residual": np.abs(field.value(at))})

    return points.select("i", *x).mapInPandas(run, "i bigint, " + ", ".join(f"{c} double" for c in x) + ", residual double")
