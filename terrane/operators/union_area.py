"""The area of a union of polygons, by slabs: between neighbouring vertex heights and crossings, edges are straight and don't cross."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def union_area(rings: list[np.ndarray]) -> float:
    """Of simple rings (n by 2), the inside of any counts. Holes are rings of their own only in ``area``-style subtraction."""
    if not rings:
        return 0.0
    origin = rings[0][0].copy()
    edges, owner = [], []
    for k, r in enumerate(rings):
        r = np.asarray(r, float) - origin
        e = np.concatenate([r, np.roll(r, -1, axis=0)], axis=1)
        e = e[e[:, 1] != e[:, 3]]
        edges.append(np.where((e[:, 1] > e[:, 3])[:, None], e[:, [2, 3, 0, 1]], e))
        owner += [k] * len(e)
    e, owner = np.concatenate(edges), np.array(owner)
    cuts = [e[:, 1], e[:, 3]]
    for i in range(len(e) - 1):  # crossings of edges that share some height
        f = e[i + 1 :]
        f = f[(f[:, 1] < e[i, 3]) & (f[:, 3] > e[i, 1])]
        s, t = (e[i, 2] - e[i, 0]) / (e[i, 3] - e[i, 1]), (f[:, 2] - f[:, 0]) / (f[:, 3] - f[:, 1])
        skew = s != t
        y = ((f[:, 0] - t * f[:, 1]) - (e[i, 0] - s * e[i, 1]))[skew] / (s - t[skew])
        cuts.append(y[(y > np.maximum(f[skew, 1], e[i, 1])) & (y < np.minimum(f[skew, 3], e[i, 3]))])
    ys = np.unique(np.concatenate(cuts))
    total = 0.0
    for lo, hi in zip(ys[:-1], ys[1:], strict=True):
        inside = (e[:, 1] <= lo) & (e[:, 3] >= hi)
        f, own, mid = e[inside], owner[inside], (lo + hi) / 2
        x = f[:, 0] + (f[:, 2] - f[:, 0]) * (mid - f[:, 1]) / (f[:, 3] - f[:, 1])
        order = np.lexsort((x, own))
        spans = sorted(zip(x[order][::2], x[order][1::2], strict=True))  # by ring, edges enter and leave in turn
        end, width = -np.inf, 0.0
        for a, b in spans:
            width += max(0.0, b - max(a, end))
            end = max(end, b)
        total += width * (hi - lo)  # exact: the width is linear in the height
    return float(total)


def union_areas(rings: DataFrame, group: str, ring: str) -> DataFrame:
    """The union's area for each group; ``ring`` holds arrays of (x, y) structs. A group is one block's polygons."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        shapes = [np.array([(p["x"], p["y"]) for p in r]) for r in rows[ring]]
        return pd.DataFrame({group: [rows[group].iloc[0]], "area": [union_area([s for s in shapes if len(s) >= 3])]})

    return rings.select(group, ring).groupBy(group).applyInPandas(solve, f"{group} {dict(rings.dtypes)[group]}, area double")


def shared_areas(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs without the rings a and b, with shared and apart: the area that two rings have in common and what of the first is outside the second.

    Rings need not be convex. Each edge and the ground below it make a trapezoid, counted by its direction; what two rings have in common
    is the sum over their edges of what two trapezoids have. Pairs of rings of the same sizes are worked out together.
    """
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    def solve(batches):
        for batch in batches:
            rest = batch.drop_columns([a, b])
            shared, apart = common_areas(batch.column(a), batch.column(b))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(shared, pa.float64()), pa.array(apart, pa.float64())], names=[*rest.schema.names, "shared", "apart"])

    kind = T.StructType([*(f for f in pairs.schema.fields if f.name not in (a, b)), T.StructField("shared", T.DoubleType()), T.StructField("apart", T.DoubleType())])
    return pairs.select(*(F.col(c) for c in pairs.columns)).mapInArrow(solve, kind)


def _corners(rings: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each ring begins, how many corners it has, and the corners of all."""
    flat = rings.flatten()
    size = np.nan_to_num(pc.list_value_length(rings).to_numpy(zero_copy_only=False)).astype(np.int64)
    xy = np.stack([flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y")]) if len(flat) else np.zeros((2, 0))
    return np.cumsum(size) - size, size, xy


def common_areas(a: pa.ListArray, b: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Of each two rings the area in common and the first's area without it."""
    (at, n, p), (bt, m, q) = _corners(a), _corners(b)
    shared, apart = np.zeros(len(n)), np.zeros(len(n))
    for size in np.unique(n * (1 << 20) + m):
        k, l = divmod(int(size), 1 << 20)  # noqa: E741
        for rows in np.array_split(np.flatnonzero((n == k) & (m == l)), 1 + np.count_nonzero((n == k) & (m == l)) // 4096):
            if k < 3 or not len(rows):
                continue
            r = p[:, at[rows] + np.arange(k)[:, None]]
            origin = r[:, :1].copy()
            r = r - origin
            one = _signed(r)
            if l >= 3:
                s = q[:, bt[rows] + np.arange(l)[:, None]] - origin
                shared[rows] = np.clip(_under_both(r, s) * np.sign(one) * np.sign(_signed(s)), 0, None)
            apart[rows] = np.abs(one) - shared[rows]
    return shared, apart


def _signed(r: np.ndarray) -> np.ndarray:
    """The area of each ring, positive if it runs clockwise; corners run along the second axis of (x, y), corner, ring."""
    x, y = r
    return ((np.roll(x, -1, axis=0) - x) * (np.roll(y, -1, axis=0) + y)).sum(axis=0) / 2


def _under_both(r: np.ndarray, s: np.ndarray) -> np.ndarray:
    ground = np.minimum(r[1].min(axis=0), s[1].min(axis=0))
    edges = []
    for x, y in (r, s):
        u, v = np.roll(x, -1, axis=0), np.roll(y, -1, axis=0)
        slope = np.divide(v - y, u - x, out=np.zeros(x.shape), where=u != x)
        edges.append((np.minimum(x, u), np.maximum(x, u), x, y - ground, slope, np.sign(u - x)))
    total = np.zeros(r.shape[2])
    first, second = (list(zip(*e, strict=True)) for e in edges)
    for lo, hi, x, y, slope, way in first:
        if not way.any():  # upright in all rings: nothing is below it
            continue
        for lo2, hi2, x2, y2, slope2, way2 in second:
            if not way2.any():
                continue
            left, right = np.maximum(lo, lo2), np.minimum(hi, hi2)
            f0, f1 = y + slope * (left - x), y + slope * (right - x)
            d0, d1 = f0 - y2 - slope2 * (left - x2), f1 - y2 - slope2 * (right - x2)
            # The lower of two lines: one of them, less what it is above the other.
            high = np.maximum(d0, d1)
            across = d0 * d1 < 0
            above = np.where(across, high * high / (2 * np.where(across, np.abs(d0 - d1), 1.0)), np.maximum(d0 + d1, 0.0) / 2)
            total += np.where(right > left, way * way2 * (right - left) * ((f0 + f1) / 2 - above), 0.0)
    return total
