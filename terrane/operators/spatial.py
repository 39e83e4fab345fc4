"""Spatial joins as equi joins on grid cells with an exact predicate behind them; no plan here needs a nested loop."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that a group's points are dealt in; distances worked out at once; pairs of a cell worked out at once, and rings at once.
SHARES, BLOCK, PIECE, RINGS = 16, 1 << 18, 1 << 15, 16


def cells(df: DataFrame, size: float, x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
    """One row for each grid cell that a box touches: cx and cy beside the row, and the box's own first cell as _fx, _fy."""
    at = lambda c: F.floor(c / size)
    out = df.withColumn("_fx", at(x0)).withColumn("_fy", at(y0)).withColumn("_lx", at(x1)).withColumn("_ly", at(y1))
    return out.withColumn("cx", F.explode(F.sequence("_fx", "_lx"))).withColumn("cy", F.explode(F.sequence("_fy", "_ly"))).drop("_lx", "_ly")


def _meet(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both sides that share a cell, dealt by cell over all cores.

    Cells make far more rows than a table's size on disk tells of, so that neither a broadcast nor fewer, larger tasks would do.
    """
    n = 8 * a.sparkSession.sparkContext.defaultParallelism
    return a.repartition(n, "cx", "cy").join(b.repartition(n, "cx", "cy").hint("merge"), ["cx", "cy"])


def _by_cell(a: DataFrame, b: DataFrame, kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What a kernel makes of the rows of both sides of each cell, dealt by cell over all cores; pairs are never rows."""
    n = 8 * a.sparkSession.sparkContext.defaultParallelism
    dealt = lambda df: df.where("cx IS NOT NULL AND cy IS NOT NULL").repartition(n, "cx", "cy").groupBy("cx", "cy")
    return dealt(a).cogroup(dealt(b)).applyInArrow(kernel, schema)


def box_join(left: DataFrame, right: DataFrame, size: float, lbox: tuple[str, str, str, str], rbox: tuple[str, str, str, str]) -> DataFrame:
    """Pairs of rows whose boxes touch, each once: it is kept in the first cell that both have. Column names must differ."""
    a = cells(left, size, *map(F.col, lbox)).withColumnsRenamed({"_fx": "_ax", "_fy": "_ay"})
    b = cells(right, size, *map(F.col, rbox)).withColumnsRenamed({"_fx": "_bx", "_fy": "_by"})
    touch = (F.col(lbox[0]) <= F.col(rbox[2])) & (F.col(rbox[0]) <= F.col(lbox[2])) & (F.col(lbox[1]) <= F.col(rbox[3])) & (F.col(rbox[1]) <= F.col(lbox[3]))
    once = (F.col("cx") == F.greatest("_ax", "_bx")) & (F.col("cy") == F.greatest("_ay", "_by"))
    return _meet(a, b).where(once & touch).drop("cx", "cy", "_ax", "_ay", "_bx", "_by")


def distance_join(left: DataFrame, right: DataFrame, reach: float, lpoint: tuple[str, str], rbox: tuple[str, str, str, str], distance: Column, size: float | None = None) -> DataFrame:
    """Pairs of a point and a shape within ``reach``, with dist. The point is in one cell, the shape's box in those it reaches.

    ``size`` is that of the cells, the reach itself if not given; for shapes that are larger, about theirs.
    """
    size = size or reach
    a = left.withColumn("cx", F.floor(F.col(lpoint[0]) / size)).withColumn("cy", F.floor(F.col(lpoint[1]) / size))
    x0, y0, x1, y1 = map(F.col, rbox)
    b = cells(right, size, x0 - reach, y0 - reach, x1 + reach, y1 + reach).drop("_fx", "_fy")
    # The box is looked at first, as the distance costs more.
    px, py = F.col(lpoint[0]), F.col(lpoint[1])
    near = _meet(a, b).where((px >= x0 - reach) & (px <= x1 + reach) & (py >= y0 - reach) & (py <= y1 + reach))
    return near.withColumn("dist", distance).where(F.col("dist") <= reach).drop("cx", "cy")


def nearest_within(left: DataFrame, right: DataFrame, reach: float, lkey: str, lpoint: tuple[str, str], rkey: str, rbox: tuple[str, str, str, str], distance: Column, size: float | None = None) -> DataFrame:
    """For each point that has any shape within reach the nearest one, the smaller key of equals: lkey, rkey, dist."""
    pairs = distance_join(left, right, reach, lpoint, rbox, distance, size)
    return pairs.groupBy(lkey).agg(F.min(F.struct(F.col("dist"), F.col(rkey))).alias("_best")).select(lkey, F.col(f"_best.{rkey}").alias(rkey), "_best.dist")


def _edges(xs: pa.ChunkedArray, ys: pa.ChunkedArray) -> list[np.ndarray]:
    """Edges of rings as ax, ay, ex, ey, one ring a row; shorter rings are filled up with their first vertex. Last, which edges are real."""
    size = xs.combine_chunks().value_lengths().to_numpy()[:, None]
    start, i = np.cumsum(size)[:, None] - size, np.arange(size.max())
    flat = [c.combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in (xs, ys)]
    real = i < size
    a, e = start + np.where(real, i, 0), start + np.where(real, (i + 1) % size, 0)
    return [c[at] for at in (a, e) for c in flat] + [real]


def _ring_distances(x: np.ndarray, y: np.ndarray, ax: np.ndarray, ay: np.ndarray, ex: np.ndarray, ey: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Distances of points (rows) from rings (columns), 0 inside; step by step as in geometry.ring_distance."""
    x, y = x[:, None], y[:, None]
    least, inside = np.full((len(x), len(ax)), np.inf), np.zeros((len(x), len(ax)), bool)
    for i in range(ax.shape[1]):
        px, py, dx, dy = x - ax[:, i], y - ay[:, i], ex[:, i] - ax[:, i], ey[:, i] - ay[:, i]
        n = dx * dx + dy * dy
        with np.errstate(divide="ignore", invalid="ignore"):
            inside ^= ((ay[:, i] > y) != (ey[:, i] > y)) & (x < dx * py / dy + ax[:, i])
            t = np.where(n == 0, 0.0, np.minimum(np.maximum((px * dx + py * dy) / n, 0.0), 1.0))
        px, py = px - t * dx, py - t * dy
        least = np.fmin(least, np.where(real[:, i], px * px + py * py, np.inf))
    return np.where(inside, 0.0, np.sqrt(least))


def nearest_ring(points: DataFrame, rings: DataFrame, reach: float, key: str, point: tuple[str, str], ring_key: str, ring: str, box: tuple[str, str, str, str], size: float) -> DataFrame:
    """For each point with any ring within reach the nearest one, 0 away inside, the smaller key of equals: key, ring_key, dist.

    The point is in one cell, the ring's box in those that it reaches; one task holds a cell. Its rings are met in order of their keys, a
    few at a time, and a point is done with the first that is 0 away, so that many rings over a point don't make more work. Rows without
    a key, a place or vertices are left out.
    """
    types = dict(points.dtypes) | dict(rings.dtypes)
    a = points.select(key, *(F.col(c).cast("double").alias(n) for c, n in zip(point, ("_px", "_py"), strict=True))).dropna()
    a = a.withColumn("cx", F.floor(F.col("_px") / size)).withColumn("cy", F.floor(F.col("_py") / size))
    x0, y0, x1, y1 = map(F.col, box)
    b = cells(rings.where(F.col(ring_key).isNotNull() & (F.size(ring) > 0)), size, x0 - reach, y0 - reach, x1 + reach, y1 + reach)
    b = b.select("cx", "cy", ring_key, F.col(ring)["x"].alias("_x"), F.col(ring)["y"].alias("_y"), *((c.cast("double") + pad).alias(n) for c, pad, n in zip((x0, y0, x1, y1), (-reach, -reach, reach, reach), ("_x0", "_y0", "_x1", "_y1"), strict=True)))

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        best, at = np.full(len(left), np.inf), np.zeros(len(left), np.int64)
        x, y = (left[c].to_numpy() for c in ("_px", "_py"))
        if len(right):
            right = right.sort_by(ring_key)
            edges = _edges(right["_x"], right["_y"])
            x0, y0, x1, y1 = (right[c].to_numpy() for c in ("_x0", "_y0", "_x1", "_y1"))
        i, left_over = 0, np.arange(len(left))
        while i < len(right) and len(left_over):
            u, v, some = x[left_over], y[left_over], slice(i, i + max(1, min(RINGS, BLOCK // len(left_over))))
            near = (u[:, None] >= x0[some]) & (u[:, None] <= x1[some]) & (v[:, None] >= y0[some]) & (v[:, None] <= y1[some])
            d = np.where(near, _ring_distances(u, v, *(e[some] for e in edges)), np.inf)
            k = d.argmin(axis=1)  # the first of equals, by key
            least = d[np.arange(len(k)), k]
            nearer = least < best[left_over]
            best[left_over[nearer]], at[left_over[nearer]] = least[nearer], i + k[nearer]
            left_over, i = left_over[best[left_over] > 0], some.stop
        ok = np.flatnonzero(best <= reach)
        return pa.table({key: left[key].take(pa.array(ok)), ring_key: right[ring_key].take(pa.array(at[ok])), "dist": pa.array(best[ok], pa.float64())})

    found = _by_cell(a, b, nearest, f"{key} {types[key]}, {ring_key} {types[ring_key]}, dist double")
    return found.groupBy(key).agg(F.min(F.struct("dist", ring_key)).alias("_best")).select(key, f"_best.{ring_key}", "_best.dist")


def _clipped(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Lengths of segments (ax, ay, ex, ey; columns) inside boxes (x0, y0, x1, y1; rows), step by step as in geometry.clip_share."""
    ax, ay, ex, ey = a
    x0, y0, x1, y1 = (c[:, None] for c in b)
    begin, end, length = 0.0, 1.0, np.sqrt((ax - ex) * (ax - ex) + (ay - ey) * (ay - ey))
    for at, d, low, high in ((ax, ex - ax, x0, x1), (ay, ey - ay, y0, y1)):
        p, q, still = low - at, high - at, d == 0
        # Where a direction has no extent, the segment is inside the slab or misses it.
        missed = still & ((p > 0) | (q < 0)) if still.any() else None
        with np.errstate(divide="ignore", invalid="ignore"):
            p /= d
            q /= d
        enter, leave = np.minimum(p, q), np.maximum(p, q)
        if missed is not None:
            enter[:, still], leave[:, still] = 0.0, 1.0
            enter[missed] = np.inf
        begin, end = np.maximum(begin, enter), np.minimum(end, leave)
    return np.maximum(end - begin, 0.0) * length


def clipped_length(lines: DataFrame, boxes: DataFrame, size: float, line: tuple[str, str, str, str], key: str, box: tuple[str, str, str, str]) -> DataFrame:
    """For each box that segments (from x, y to x, y) run through: key, how many do, and their length inside as ``length``.

    Both are in all cells that they touch and meet in the first that both have; one task holds a cell and adds up each box's lengths.
    """
    ax, ay, ex, ey = (F.col(c).cast("double").alias(n) for c, n in zip(line, ("_ax", "_ay", "_ex", "_ey"), strict=True))
    a = cells(lines.select(ax, ay, ex, ey), size, F.least("_ax", "_ex"), F.least("_ay", "_ey"), F.greatest("_ax", "_ex"), F.greatest("_ay", "_ey")).dropna()
    b = boxes.select(key, *(F.col(c).cast("double").alias(n) for c, n in zip(box, ("_x0", "_y0", "_x1", "_y1"), strict=True)))
    b = cells(b, size, *map(F.col, ("_x0", "_y0", "_x1", "_y1")))

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = ([t[c].to_numpy() for c in names] for t, names in ((left, ("_ax", "_ay", "_ex", "_ey")), (right, ("_x0", "_y0", "_x1", "_y1"))))
        first = [[t[f].to_numpy() == t[c].to_numpy() for f, c in (("_fx", "cx"), ("_fy", "cy"))] for t in (left, right)]
        n, length = np.zeros(len(right), np.int64), np.zeros(len(right))
        for fx in (False, True):
            for fy in (False, True):
                # In either direction one of the two has its first cell here.
                rows = np.flatnonzero((first[1][0] == fx) & (first[1][1] == fy))
                cols = np.flatnonzero((first[0][0] | fx) & (first[0][1] | fy))
                width = max(1, min(len(cols), PIECE // 8))
                for i in range(0, len(cols), width):
                    some = [c[cols[i : i + width]] for c in a]
                    for j in range(0, len(rows), PIECE // width):
                        to = rows[j : j + PIECE // width]
                        inside = _clipped(some, [c[to] for c in b])
                        n[to] += np.count_nonzero(inside, axis=1)
                        length[to] += inside.sum(axis=1)
        met = pa.array(np.flatnonzero(n))
        return pa.table({key: right[key].take(met), "n": pa.array(n[met]), "length": pa.array(length[met])})

    found = _by_cell(a, b, add_up, f"{key} {dict(boxes.dtypes)[key]}, n long, length double")
    return found.groupBy(key).agg(F.sum("n").alias("n"), F.sum("length").alias("length"))


def best_overlap(pairs: DataFrame, lkey: str, rkey: str, amount: str) -> DataFrame:
    """For each left key the right key with the largest amount, the smaller key of equals."""
    best = F.max(F.struct(F.col(amount), (-F.col(rkey)).alias("_k"))).alias("_best")
    return pairs.groupBy(lkey).agg(best).select(lkey, (-F.col("_best._k")).alias(rkey), F.col(f"_best.{amount}").alias(amount))


def next_on_axis(pieces: DataFrame, axis: str, key: str, reach: float, size: float = 8.0) -> DataFrame:
    """Pairs of pieces (axis, key, lo, hi) where the second begins up to ``reach`` behind the first, with no other's middle in between.

    The second's columns get the prefix b_. As a piece's middle is never behind its end nor before its beginning, the nearest middle
    behind an end bounds what may follow it; the bound is found by one pass along the axis, and ends meet beginnings in bins below it.
    """
    names = [c for c in pieces.columns if c != axis]
    ends = pieces.where("lo <= hi").select(axis, F.col("hi").alias("_at"), F.lit(1).alias("_end"), F.lit(None).cast("double").alias("_mid"), F.struct(*names).alias("_p"))
    middle = ((F.col("lo") + F.col("hi")) / 2).cast("double")
    middles = pieces.where("lo <= hi").select(axis, middle.alias("_at"), F.lit(0).alias("_end"), middle.alias("_mid"), F.struct(*(F.lit(None).cast(t).alias(c) for c, t in pieces.dtypes if c != axis)).alias("_p"))
    behind = Window.partitionBy(axis).orderBy(F.desc("_at"), F.desc("_end")).rowsBetween(Window.unboundedPreceding, 0)
    bounded = ends.unionByName(middles).withColumn("_next", F.min("_mid").over(behind)).where("_end = 1").select(axis, "_p.*", F.least(F.col("_p.hi") + reach, F.col("_next")).alias("_last"))
    left = bounded.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("hi") / size), F.floor(F.col("_last") / size))))
    right = pieces.where("lo <= hi").select(axis, *(F.col(c).alias(f"b_{c}") for c in names)).withColumn("_bin", F.floor(F.col("b_lo") / size))
    n = 8 * pieces.sparkSession.sparkContext.defaultParallelism
    met = left.repartition(n, axis, "_bin").join(right.repartition(n, axis, "_bin").hint("merge"), [axis, "_bin"])
    return met.where((F.col("b_lo") >= F.col("hi")) & (F.col("b_lo") <= F.col("_last")) & (F.col(key) != F.col(f"b_{key}"))).drop("_bin", "_last")


def cells_of_centres(points: DataFrame, centres: DataFrame, group: str, key: str, point: tuple[str, str], centre_key: str, centre: tuple[str, str]) -> DataFrame:
    """Each point's nearest centre of its group, the smaller key of equals: group, key, centre_key and dist.

    A group's points are dealt over several tasks, each of which gets all centres of the group; no pair is written down.
    """
    n = 8 * points.sparkSession.sparkContext.defaultParallelism
    p = points.select(group, key, *(F.col(c).cast("double").alias(a) for c, a in zip(point, ("_px", "_py"), strict=True))).where(F.col(group).isNotNull() & F.col("_px").isNotNull() & F.col("_py").isNotNull())
    c = centres.select(group, centre_key, *(F.col(x).cast("double").alias(a) for x, a in zip(centre, ("_cx", "_cy"), strict=True))).where(F.col("_cx").isNotNull() & F.col("_cy").isNotNull())
    p = p.withColumn("_share", F.pmod(F.xxhash64(key), F.lit(SHARES)).cast("int"))
    c = c.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    types = dict(points.dtypes) | dict(centres.dtypes)

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by(centre_key) if len(right) else right
        keys = right[centre_key].combine_chunks()
        x, y = (left[a].to_numpy() for a in ("_px", "_py"))
        cx, cy = (right[a].to_numpy() for a in ("_cx", "_cy"))
        at, dist = np.zeros(len(x) if len(cx) else 0, np.int64), np.zeros(len(x) if len(cx) else 0)
        step = max(1, BLOCK // max(1, len(cx)))
        for i in range(0, len(at), step):
            d = np.sqrt((x[i : i + step, None] - cx) ** 2 + (y[i : i + step, None] - cy) ** 2)
            at[i : i + step] = k = d.argmin(axis=1)  # the first of equals, by key
            dist[i : i + step] = d[np.arange(len(k)), k]
        return pa.table({group: left[group][: len(at)], key: left[key][: len(at)], centre_key: keys.take(pa.array(at)), "dist": pa.array(dist, pa.float64())})

    both = p.repartition(n, group, "_share").groupBy(group, "_share").cogroup(c.repartition(n, group, "_share").groupBy(group, "_share"))
    found = both.applyInArrow(nearest, f"{group} {types[group]}, {key} {types[key]}, {centre_key} {types[centre_key]}, dist double")
    return found.groupBy(group, key).agg(F.min(F.struct("dist", centre_key)).alias("_best")).select(group, key, f"_best.{centre_key}", "_best.dist")


#: Fixed values of linking: degrees between pieces, and between those that touch; metres that touch; metres between pieces; off the line.
TURN, TOUCH_TURN, TOUCH, GAP_LO, GAP_HI, OFF, OFF_SHARE = 6.0, 12.0, 1.5, -2.0, 60.0, 0.5, 0.02


def link_candidates(pieces: DataFrame) -> DataFrame:
    """Pairs (a, b) of row pieces of different tiles where b begins behind the end of a: gap along a's direction, off beside it.

    pieces: seg, tile, ax, ay (begin), bx, by (end) and angle in degrees. A beginning meets, in small grid cells, the ends whose box of
    what lies ahead of them holds it: the box runs along the piece, so that it is as narrow as the rule.
    """
    ux, uy, wide = F.cos(F.radians("angle")), F.sin(F.radians("angle")), OFF + OFF_SHARE * GAP_HI + 1e-6
    end = pieces.select(F.col("seg").alias("a"), F.col("tile").alias("_ta"), F.col("angle").alias("_u"), F.col("bx").alias("_ex"), F.col("by").alias("_ey"), ux.alias("_ux"), uy.alias("_uy"))
    reach = lambda e, u, pick, pad: (pick(F.col(e) + GAP_LO * F.col(u), F.col(e) + GAP_HI * F.col(u)) + pad)
    end = end.withColumns({"_l0": reach("_ex", "_ux", F.least, -wide), "_l1": reach("_ey", "_uy", F.least, -wide), "_l2": reach("_ex", "_ux", F.greatest, wide), "_l3": reach("_ey", "_uy", F.greatest, wide)})
    begin = pieces.select(F.col("seg").alias("b"), F.col("tile").alias("_tb"), F.col("angle").alias("_v"), F.col("ax").alias("_sx"), F.col("ay").alias("_sy"))
    pairs = box_join(end, begin, 4.0, ("_l0", "_l1", "_l2", "_l3"), ("_sx", "_sy", "_sx", "_sy")).where("_ta <> _tb")
    dx, dy = F.col("_sx") - F.col("_ex"), F.col("_sy") - F.col("_ey")
    turn = F.pmod(F.abs(F.col("_u") - F.col("_v")), F.lit(180.0))
    found = pairs.withColumns({"gap": dx * F.col("_ux") + dy * F.col("_uy"), "off": F.abs(dy * F.col("_ux") - dx * F.col("_uy"))})
    least = F.least(turn, 180.0 - turn)
    ok = F.col("gap").between(GAP_LO, GAP_HI) & (F.col("off") <= OFF + OFF_SHARE * F.greatest(F.col("gap"), F.lit(0.0))) & (least <= F.when(dx * dx + dy * dy < TOUCH * TOUCH, TOUCH_TURN).otherwise(TURN))
    return found.where(ok).select("a", "b", "gap", "off")
