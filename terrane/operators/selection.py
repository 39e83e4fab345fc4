"""Which targets, objects, candidates and rows are kept: chained rules as filters, and rules about groups as windows over the group."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import geometry as G
from terrane.operators import spatial


@dataclass(frozen=True)
class WasteRules:
    """Sizes in square metres and metres, solidity, aspect, contrast, distance from a row axis, and what a model's box may be."""

    min_m2: float = 0.05
    max_m2: float = 4.0
    solidity: float = 0.6
    aspect: float = 3.5
    contrast: float = 55.0
    axis_dist: float = 0.5
    min_side: float = 0.1
    max_side: float = 10.0


def targets(items: DataFrame, types: list[str], min_gap: float = 0.0) -> DataFrame:
    """Items (type, reachable, gap_m) of the types asked for, unless known to be out of reach; short gaps go, waste stays whatever its gap."""
    wanted = F.col("type").isin(types) & F.coalesce("reachable", F.lit(True))
    return items.where(wanted & ((F.col("type") == "waste") | (F.coalesce("gap_m", F.lit(0.0)) >= min_gap)))


def split_by(rows: DataFrame, small: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that count, and those below the threshold, which are listed apart; a null condition counts."""
    below = F.coalesce(small, F.lit(False))
    return rows.where(~below), rows.where(below)


def garden_rule(objects: DataFrame, block: str, row: str, least_rows: int = 3, least_objects: int = 2, passes: int = 3) -> DataFrame:
    """Objects of blocks with enough rows and of rows with enough objects; what goes may leave others short, so up to ``passes`` times."""
    for _ in range(passes):
        rows = objects.groupBy(row).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least_objects).select(row)
        objects = objects.join(rows, row, "left_semi")
        blocks = objects.select(block, row).distinct().groupBy(block).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least_rows).select(block)
        objects = objects.join(blocks, block, "left_semi")
    return objects


def inside_share(objects: DataFrame, zones: DataFrame, key: str, box: tuple[str, str, str, str], zone: tuple[str, str, str, str], size: float) -> DataFrame:
    """key and the share of each object's box that zones cover, of those that any does; zones don't overlap."""
    x0, y0, x1, y1 = map(F.col, box)
    u0, v0, u1, v1 = map(F.col, zone)
    met = spatial.box_join(objects.select(key, *box), zones.select(*zone), size, box, zone)
    shared = G.overlap(x0, x1, u0, u1) * G.overlap(y0, y1, v0, v1) / ((x1 - x0) * (y1 - y0))
    return met.groupBy(key).agg(F.sum(shared).alias("inside"))


def drop_forbidden(objects: DataFrame, shares: DataFrame, tile: str, key: str, is_row: Column, most: float = 0.5, least_rows: int = 3) -> DataFrame:
    """Objects that lie mostly outside forbidden zones; a tile that a zone touched and that is left with too few rows is dropped whole."""
    seen = objects.join(shares, key, "left").withColumn("_touched", F.max(F.col("inside").isNotNull()).over(Window.partitionBy(tile)))
    kept = seen.where(F.coalesce("inside", F.lit(0.0)) <= most)
    rows = F.sum(F.when(is_row, 1).otherwise(0)).over(Window.partitionBy(tile))
    return kept.withColumn("_rows", rows).where(~F.col("_touched") | (F.col("_rows") >= least_rows)).drop("_rows", "_touched", "inside")


def waste_score(rules: WasteRules) -> Column:
    """Contrast and solidity against their thresholds, capped; odd sizes count less, and dark blobs, the more so if they are long."""
    size = F.when(F.col("area_m2").between(0.1, 2.0), 1.0).otherwise(0.7)
    kind = F.when(F.col("kind") != "dark", 1.0).when(F.col("aspect") < 1.6, 0.8).otherwise(0.4)
    return F.least(F.col("contrast") / rules.contrast, F.lit(2.0)) * F.least(F.col("solidity") / rules.solidity, F.lit(1.5)) * size * kind


def waste_candidates(blobs: DataFrame, rules: WasteRules = WasteRules()) -> DataFrame:
    """Blobs (kind, area_m2, solidity, aspect, contrast, axis_m, forbidden, near_block, on_passage) that may be waste, with their score."""
    size = F.col("area_m2").between(rules.min_m2, rules.max_m2)
    shape = (F.col("solidity") >= rules.solidity) & (F.col("aspect") <= rules.aspect)
    place = (F.coalesce("axis_m", F.lit(1e9)) >= rules.axis_dist) & ~F.col("forbidden") & F.col("near_block") & ~(F.col("on_passage") & (F.col("kind") == "white"))
    return blobs.where(size & shape & (F.col("contrast") >= rules.contrast) & place).withColumn("score", waste_score(rules))


def model_boxes(boxes: DataFrame, least_score: float, rules: WasteRules = WasteRules()) -> DataFrame:
    """A model's boxes (score, x0 to y1 in metres, forbidden) with enough score and a longer side in the band."""
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return boxes.where((F.col("score") >= least_score) & side.between(rules.min_side, rules.max_side) & ~F.col("forbidden"))


def window_votes(pieces: DataFrame, tile: str, window: str, offset: str, weight: str, near: float) -> DataFrame:
    """Pieces of one row, found by overlapping windows, made one: tile, no, offset (weighted mean) and windows (different ones).

    Pieces follow one another sideways; where the next one is farther than ``near``, another row begins.
    """
    order = Window.partitionBy(tile).orderBy(offset, window)
    new = F.when(F.col(offset) - F.lag(offset).over(order) <= near, 0).otherwise(1)
    grouped = pieces.withColumn("_new", new).withColumn("no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    mean = F.sum(F.col(offset) * F.col(weight)) / F.sum(weight)
    return grouped.groupBy(tile, "no").agg(mean.alias("offset"), F.countDistinct(window).alias("windows"))


def consensus(rows: DataFrame, tile: str, least: int = 2, strong: int = 3) -> DataFrame:
    """Rows that ``least`` windows found, of tiles where ``strong`` windows found one."""
    kept = rows.where(F.col("windows") >= least)
    return kept.withColumn("_most", F.max("windows").over(Window.partitionBy(tile))).where(F.col("_most") >= strong).drop("_most")


def grow_from_strong(rows: DataFrame, tile: str, offset: str, strong: Column, reach: float) -> DataFrame:
    """Rows from which neighbours, none farther than ``reach`` from the next, lead to a strong one.

    Along one axis the closure of nearness is a stretch without a wider gap, so that no loop is needed.
    """
    order = Window.partitionBy(tile).orderBy(offset, "no")
    new = F.when(F.col(offset) - F.lag(offset).over(order) <= reach, 0).otherwise(1)
    chained = rows.withColumn("_new", new).withColumn("_chain", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return chained.withColumn("_any", F.max(strong).over(Window.partitionBy(tile, "_chain"))).where("_any").drop("_new", "_chain", "_any")


def row_support(samples: DataFrame, tile: str, length: str = "length", on: str = "on_row", mid: str = "mid_row", least: float = 1.3, apart: float = 0.08, floor: float = 0.02) -> DataFrame:
    """Of each tile how much greener rows are than what lies between them, by length, the share of rows that aren't enough, worst first."""
    ratio = F.col(on) / F.greatest(F.col(mid), F.lit(floor))
    weak = (ratio < least) | (F.col(on) - F.col(mid) < apart)
    w = F.col(length)
    sums = samples.groupBy(tile).agg(F.count(F.lit(1)).alias("n_rows"), (F.sum(F.col(on) * w) / F.sum(w)).alias("on_mean"), (F.sum(F.col(mid) * w) / F.sum(w)).alias("mid_mean"), F.avg(F.when(weak, 1.0).otherwise(0.0)).alias("weak_share"), F.sum(w).alias("length_m"))
    return sums.withColumn("support", F.col("on_mean") / F.greatest(F.col("mid_mean"), F.lit(floor))).orderBy("support", tile)


def vine_rows(rows: DataFrame, tile: str, key: str, offset: str, ok: Column, reach: float, least: int, tree: Column) -> DataFrame:
    """Rows of tiles with a vineyard: a stretch of ``least`` good rows, none farther than ``reach`` from the next. There all rows stay but clear trees."""
    order = Window.partitionBy(tile).orderBy(offset, key)
    good = F.coalesce(ok, F.lit(False))
    marked = rows.withColumn("_ok", good)
    new = F.when(F.col("_ok") & F.lag("_ok", 1, False).over(order) & (F.col(offset) - F.lag(offset).over(order) <= reach), 0).otherwise(1)
    marked = marked.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.sum(F.when(F.col("_ok"), 1).otherwise(0)).over(Window.partitionBy(tile, "_run"))
    any_run = F.max("_size").over(Window.partitionBy(tile)) >= least
    return marked.withColumn("_size", size).withColumn("_any", any_run).where(F.col("_any") & ~F.coalesce(tree, F.lit(False))).drop("_ok", "_new", "_run", "_size", "_any")


def strips_between(rows: DataFrame, block: str, key: str, offset: str, lo: str, hi: str, period: float, half: float = 0.0, nearest: float = 0.6, farthest: float = 1.6, least: float = 1.0) -> DataFrame:
    """Strips between rows that are next to one another: block, the two rows, lo, hi, width and area; too near, too far or hardly side by side: none."""
    order = Window.partitionBy(block).orderBy(offset, key)
    after = lambda c: F.lead(c).over(order)
    pairs = rows.select(block, F.col(key).alias("row_a"), after(key).alias("row_b"), (after(offset) - F.col(offset)).alias("apart"), F.greatest(F.col(lo), after(lo)).alias("lo"), F.least(F.col(hi), after(hi)).alias("hi"))
    met = pairs.where(F.col("apart").between(nearest * period, farthest * period) & (F.col("hi") - F.col("lo") >= least))
    width = F.col("apart") - 2 * half
    return met.select(block, "row_a", "row_b", "lo", "hi", width.alias("width"), (width * (F.col("hi") - F.col("lo"))).alias("area"))


def unexplained(rows: DataFrame, shares: DataFrame, key: str, most: float = 0.2) -> DataFrame:
    """Rows of which known ones explain at most this share."""
    return rows.join(shares, key, "left").where(F.coalesce("inside", F.lit(0.0)) <= most).drop("inside")


def ranked_visits(stops: DataFrame, group: str, order: str, key: str) -> DataFrame:
    """Stops with their rank on the route; an order of 0 or none isn't one, and their rank is null."""
    on_route = F.coalesce(F.col(order) > 0, F.lit(False))
    rank = F.row_number().over(Window.partitionBy(group, on_route).orderBy(order, key))
    return stops.withColumn("rank", F.when(on_route, rank))


def by_area(boxes: DataFrame, group: str, key: str, overlap: float = 0.3) -> DataFrame:
    """Largest first, a box stays unless a kept one of its group overlaps it by this IoU: group and key."""
    from terrane.operators import matching

    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return matching.suppress(boxes.withColumn("_area", area), group, key, "_area", overlap, inside=2.0).drop("_area")


def merge_anchors(members: DataFrame, group: str, reach: float) -> DataFrame:
    """Anchors taken together: group, anchor and the anchor that stands for it.

    members: group, anchor, ax, ay (where one stands), x, y (a target). The anchor with most targets takes over others nearby all of whose
    targets are in its reach, with a margin of 0.3 m; an ordered fold over one group's anchors.
    """
    import numpy as np
    import pandas as pd

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        held = {a: r[["x", "y"]].to_numpy(float) for a, r in rows.groupby("anchor")}
        place = rows.groupby("anchor")[["ax", "ay"]].first()
        place = dict(zip(place.index, place.to_numpy(float), strict=True))
        stands = {a: a for a in held}
        for a in sorted(held, key=lambda a: (-len(held[a]), a)):
            if stands[a] != a:
                continue
            for b in sorted(held):
                if b != a and stands[b] == b and np.hypot(*(place[b] - place[a])) < 2 * reach and np.hypot(*(held[b] - place[a]).T).max() <= reach - 0.3:
                    stands[b], held[a] = a, np.concatenate([held[a], held[b]])
        while any(stands[stands[a]] != stands[a] for a in stands):
            stands = {a: stands[s] for a, s in stands.items()}
        return pd.DataFrame({group: rows[group].iloc[0], "anchor": list(stands), "stands": list(stands.values())})

    kept = members.select(group, "anchor", *(F.col(c).cast("double").alias(c) for c in ("ax", "ay", "x", "y")))
    kind = dict(kept.dtypes)
    return kept.groupBy(group).applyInPandas(fold, f"{group} {kind[group]}, anchor {kind['anchor']}, stands {kind['anchor']}")
