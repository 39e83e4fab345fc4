"""One-to-one matching, suppression of overlaps and linking of row segments: candidates by joins, choices by ordered folds in a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions import geometry as G


def box_iou(a: str, b: str):
    """Of two boxes given by column prefixes."""
    c = F.col
    shared = G.overlap(c(f"{a}x0"), c(f"{a}x1"), c(f"{b}x0"), c(f"{b}x1")) * G.overlap(c(f"{a}y0"), c(f"{a}y1"), c(f"{b}y0"), c(f"{b}y1"))
    size = lambda p: (c(f"{p}x1") - c(f"{p}x0")) * (c(f"{p}y1") - c(f"{p}y0"))
    return shared / (size(a) + size(b) - shared + 1e-12)


def assignment(weight: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns with the largest sum of weights (shortest augmenting paths with potentials, O(n^3))."""
    n, m = weight.shape
    if n > m:
        return sorted((r, c) for c, r in assignment(weight.T))
    cost = -weight
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], column = i, 0
        slack, back, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while match[column]:
            used[column] = True
            row = match[column]
            free = np.flatnonzero(~used[1:]) + 1
            reduced = cost[row - 1, free - 1] - u[row] - v[free]
            better = reduced < slack[free]
            slack[free[better]], back[free[better]] = reduced[better], column
            nearest = free[np.argmin(slack[free])]
            step = slack[nearest]
            u[match[used]] += step
            v[used] -= step
            slack[free] -= step
            column = nearest
        while column:
            match[column] = match[back[column]]
            column = back[column]
    return sorted((int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j])


def connected(a: np.ndarray, b: np.ndarray, n: int, m: int) -> np.ndarray:
    """For each pair of one of n and one of m objects the number of the set that the pairs connect."""
    up = np.arange(n + m)

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, j in zip(a.tolist(), (b + n).tolist(), strict=True):
        p, q = root(i), root(j)
        up[max(p, q)] = min(p, q)
    return np.array([root(i) for i in a.tolist()], np.int64)


def match_one_to_one(candidates: DataFrame, group: str, left: str, right: str, weight: str, least: float) -> DataFrame:
    """The pairs of each group that maximise the sum of weights; of these, those of ``least`` or more. A group is a tile's objects.

    Each set of objects that candidates connect is solved apart, so that a table of weights is as large as what touches, not as a tile.
    """

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        ls, l_at = np.unique(rows[left], return_inverse=True)
        rs, r_at = np.unique(rows[right], return_inverse=True)
        value, of = rows[weight].to_numpy(float), connected(l_at, r_at, len(ls), len(rs))
        order = np.argsort(of, kind="stable")
        found: list[tuple[int, int, float]] = []
        for part in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
            li, lk = np.unique(l_at[part], return_inverse=True)
            ri, rk = np.unique(r_at[part], return_inverse=True)
            w = np.zeros((len(li), len(ri)))
            w[lk, rk] = value[part]
            found += [(li[i], ri[j], w[i, j]) for i, j in assignment(w) if w[i, j] >= least and w[i, j] > 0]
        return pd.DataFrame({group: [rows[group].iloc[0]] * len(found), left: [ls[i] for i, _, _ in found], right: [rs[j] for _, j, _ in found], weight: [w for _, _, w in found]})

    types = dict(candidates.dtypes)
    return candidates.select(group, left, right, weight).groupBy(group).applyInPandas(solve, f"{group} {types[group]}, {left} {types[left]}, {right} {types[right]}, {weight} double")


def suppress(boxes: DataFrame, group: str, key: str, score: str, overlap: float, inside: float = 0.8) -> DataFrame:
    """Greedy suppression: by falling score, a box stays unless a kept one overlaps it by IoU or holds this share of the smaller."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([score, key], ascending=[False, True], kind="stable")
        b = rows[["x0", "y0", "x1", "y1"]].to_numpy(float)
        area = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
        kept: list[int] = []
        for i in range(len(b)):
            k = b[kept]
            shared = np.clip(np.minimum(k[:, 2], b[i, 2]) - np.maximum(k[:, 0], b[i, 0]), 0, None) * np.clip(np.minimum(k[:, 3], b[i, 3]) - np.maximum(k[:, 1], b[i, 1]), 0, None)
            if not kept or not ((shared / (area[kept] + area[i] - shared + 1e-12) >= overlap) | (shared / np.maximum(np.minimum(area[kept], area[i]), 1e-12) >= inside)).any():
                kept.append(i)
        return rows.iloc[kept][[group, key, score]]

    types = dict(boxes.dtypes)
    return boxes.select(group, key, score, *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1"))).groupBy(group).applyInPandas(fold, f"{group} {types[group]}, {key} {types[key]}, {score} {types[score]}")


def keep_disjoint(pieces: DataFrame, group: str, key: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Longest first, a piece stays unless it overlaps a kept one of its group."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(_l=rows[hi] - rows[lo]).sort_values(["_l", key], ascending=[False, True], kind="stable")
        kept: list[tuple] = []
        for i, (a, b) in enumerate(zip(rows[lo], rows[hi], strict=True)):
            if all(b <= x or y <= a for x, y, _ in kept):
                kept.append((a, b, i))
        return rows.iloc[[i for _, _, i in kept]].drop(columns="_l")

    kept = pieces.select(group, key, lo, hi)
    return kept.groupBy(group).applyInPandas(fold, kept.schema)


def link_greedily(candidates: DataFrame, group: str, cost: str = "cost") -> DataFrame:
    """By rising cost, joins segment ends (a, a_end) and (b, b_end): each end once, and never a ring. Links of each group."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([cost, "a", "b"], kind="stable")
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        used, kept = set(), []
        for i, (a, e, b, f) in enumerate(zip(rows.a, rows.a_end, rows.b, rows.b_end, strict=True)):
            if (a, e) not in used and (b, f) not in used and root(a) != root(b):
                used |= {(a, e), (b, f)}
                up[root(a)] = root(b)
                kept.append(i)
        return rows.iloc[kept]

    kept = candidates.select(group, "a", "a_end", "b", "b_end", cost)
    return kept.groupBy(group).applyInPandas(fold, kept.schema)


def macro_f1(pairs: DataFrame, truth: str, guess: str) -> DataFrame:
    """Accuracy and F1 averaged over the classes that the truth has; a missing guess is wrong."""
    cells = pairs.groupBy(truth, guess).agg(F.count(F.lit(1)).alias("n"))
    known = cells.groupBy(F.col(truth).alias("_c")).agg(F.sum("n").alias("_t"), F.sum(F.when(F.col(truth).eqNullSafe(F.col(guess)), F.col("n")).otherwise(0)).alias("_tp"))
    guessed = cells.where(F.col(guess).isNotNull()).groupBy(F.col(guess).alias("_c")).agg(F.sum("n").alias("_p"))
    per = known.join(guessed, "_c", "left").withColumn("_f1", 2 * F.col("_tp") / (F.col("_t") + F.coalesce("_p", F.lit(0))))
    return per.agg((F.sum("_tp") / F.sum("_t")).alias("accuracy"), F.avg("_f1").alias("macro_f1"))
