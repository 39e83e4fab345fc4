"""Shapes of single polygons in numpy, and their application to columns of points by Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = "array<struct<x:double,y:double>>"


def hull(p: np.ndarray) -> np.ndarray:
    """Counter-clockwise convex hull, without points on its edges."""
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    out: list[np.ndarray] = []
    for side in (p, p[::-1]):
        chain: list[np.ndarray] = []
        for q in side:
            while len(chain) > 1 and cross(chain[-2], chain[-1], q) <= 0:
                chain.pop()
            chain.append(q)
        out += chain[:-1]
    return np.array(out)


def rectangle(p: np.ndarray) -> tuple[float, float]:
    """Sides (short, long) of the smallest rectangle in any direction; one of its sides lies on a side of the hull."""
    h = hull(p)
    if len(h) < 3:
        return 0.0, float(np.hypot(*(h[-1] - h[0]))) if len(h) else 0.0
    best = (np.inf, 0.0, 0.0)
    for d in np.roll(h, -1, axis=0) - h:
        u = d / np.hypot(*d)
        a, b = np.ptp(h @ u), np.ptp(h @ np.array([-u[1], u[0]]))
        best = min(best, (a * b, min(a, b), max(a, b)))
    return float(best[1]), float(best[2])


def simplified(p: np.ndarray, tolerance: float) -> np.ndarray:
    """Of a line the points that keep it within the tolerance (Douglas-Peucker); with 0, those not on a straight way."""
    keep, todo = np.zeros(len(p), bool), [(0, len(p) - 1)]
    keep[[0, -1]] = True
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d = p[b] - p[a]
        n = np.hypot(*d)
        q = p[a + 1 : b] - p[a]
        away = np.abs(q[:, 0] * d[1] - q[:, 1] * d[0]) / n if n else np.hypot(q[:, 0], q[:, 1])
        i = int(np.argmax(away))
        if away[i] > max(tolerance, 1e-12):
            keep[a + 1 + i] = True
            todo += [(a, a + 1 + i), (a + 1 + i, b)]
    return p[keep]


def inner_point(p: np.ndarray) -> np.ndarray:
    """A point of a ring's inside: the middle of the longest stretch at a height between the vertices about half way up."""
    ys = np.unique(p[:, 1])
    if len(ys) < 2:
        return p.mean(axis=0)
    k = min(max(int(np.searchsorted(ys, (ys[0] + ys[-1]) / 2)), 1), len(ys) - 1)
    y = (ys[k - 1] + ys[k]) / 2
    q = np.roll(p, -1, axis=0)
    hit = (p[:, 1] > y) != (q[:, 1] > y)
    x = np.sort(p[hit, 0] + (q[hit, 0] - p[hit, 0]) * (y - p[hit, 1]) / (q[hit, 1] - p[hit, 1]))
    i = int(np.argmax(x[1::2] - x[::2]))
    return np.array([(x[2 * i] + x[2 * i + 1]) / 2, y])


def crosses_itself(p: np.ndarray) -> bool:
    """Whether two sides of a ring that aren't neighbours meet."""
    q, n = np.roll(p, -1, axis=0), len(p)
    side = lambda a, b, c: np.sign((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
    for i in range(n):
        for j in range(i + 2, n - (i == 0)):
            if side(p[i], q[i], p[j]) != side(p[i], q[i], q[j]) and side(p[j], q[j], p[i]) != side(p[j], q[j], q[i]):
                return True
    return False


def _array(points) -> np.ndarray:
    return np.array([(a["x"], a["y"]) for a in points], float).reshape(-1, 2)


def _rows(p: np.ndarray) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in p]


def on_points(kernel: Callable[[np.ndarray], np.ndarray], points: Column) -> Column:
    """A column of points to another by a kernel; null stays null."""

    @F.pandas_udf(POINTS)
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda p: None if p is None else _rows(kernel(_array(p))))

    return run(points)


def measure(kernel: Callable[[np.ndarray], float], points: Column) -> Column:
    """A number of each column of points by a kernel."""

    @F.pandas_udf("double")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda p: None if p is None else float(kernel(_array(p))))

    return run(points)
