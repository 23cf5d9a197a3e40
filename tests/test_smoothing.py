"""Smoothed curves against dense least squares, open and periodic, with a group that holds most rows."""

import numpy as np
import pytest

from sheetwise.operators import smoothing


def design(t, lo, hi, controls, degree, periodic):
    """B-spline values by the textbook recursion over all knots."""
    spans = controls if periodic else controls - degree
    knots = np.arange(-degree, spans + degree + 1.0)
    x = np.clip((t - lo) / ((hi - lo) or 1), 0, 1) * spans
    x = np.where(x == spans, np.nextafter(spans, 0), x)
    b = ((knots[:-1] <= x[:, None]) & (x[:, None] < knots[1:])).astype(float)
    for k in range(1, degree + 1):
        b = (x[:, None] - knots[: -k - 1]) / k * b[:, :-1] + (knots[k + 1 :] - x[:, None]) / k * b[:, 1:]
    out = np.zeros((len(t), controls))
    for j in range(b.shape[1]):
        out[:, j % controls] += b[:, j]
    return out


@pytest.mark.parametrize("periodic,degree", [(False, 3), (True, 3), (False, 2)])
def test_against_least_squares(spark, periodic, degree):
    r = np.random.default_rng(5)
    rows = []
    for g, n in (("a", 400), ("b", 40), ("c", 5), ("d", 1)):
        t = np.sort(r.uniform(0, 10, n))
        rows += [(g, float(v), float(np.cos(v)), float(np.sin(v) + 0.1 * r.normal()), 1.0 + k % 3, -1.0) for k, v in enumerate(t)]
    odd = [("a", None, 1.0, 1.0, 1.0, 0.0), (None, 1.0, 1.0, 1.0, 1.0, 0.0), ("b", float("nan"), 1.0, 1.0, 1.0, 0.0), ("b", 1.0, None, 1.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows + odd, "g string, s double, p double, q double, w double, lo double").repartition(3)
    found = smoothing.fit_curves(df, "g", "s", ["p", "q"], 12, degree, 0.05, periodic, "w")
    got = {x.g: x for x in found.collect()}
    assert {g: x.n for g, x in got.items()} == {"a": 400, "b": 40, "c": 5, "d": 1}
    points = {}
    for x in smoothing.curve_points(found, "g", ["p", "q"], 20, 12, degree, periodic).collect():
        points.setdefault(x.g, []).append((x.k, x.t, x.p, x.q))
    for g in "abc":
        mine = np.array([x[1:5] for x in rows if x[0] == g])
        lo, hi = mine[:, 0].min(), mine[:, 0].max()
        b = design(mine[:, 0], lo, hi, 12, degree, periodic) * np.sqrt(mine[:, 3:])
        d = np.eye(12)
        for _ in range(2):
            d = np.roll(d, -1, axis=0) - d if periodic else np.diff(d, axis=0)
        x = np.linalg.lstsq(np.concatenate([b, np.sqrt(0.05) * d]), np.concatenate([mine[:, 1:3] * np.sqrt(mine[:, 3:]), np.zeros((len(d), 2))]), rcond=None)[0]
        assert np.allclose(np.reshape(got[g].controls, (12, 2)), x, atol=1e-6)
        at = np.array(sorted(points[g]))
        assert np.allclose(at[:, 2:], design(at[:, 1], lo, hi, 12, degree, periodic) @ x, atol=1e-6)
    assert len(got["d"].controls) == 24 and np.isfinite(got["d"].controls).all()
    assert smoothing.fit_curves(df.limit(0), "g", "s", ["p"]).count() == 0
    with pytest.raises(ValueError):
        smoothing.fit_curves(df, "g", "s", ["p"], 3)
