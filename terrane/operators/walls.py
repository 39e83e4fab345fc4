"""What a walker can't cross: rows as walls, with the ways between their pieces closed, and the grid's steps over them cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import geometry as G
from terrane.operators import spatial

#: Fixed values. Metres: gaps in a row that are bridged and how far off its line; ends of rows that meet, at a tile's edge too; extension of open ends.
BRIDGE, BRIDGE_OFF, SEAM, EDGE_SEAM, SEAM_OFF, EXTEND = 15.0, 1.0, 2.0, 20.0, 1.2, 5.0
#: Ends face one another below this cosine.
FACING = -0.98


def bridges(pieces: DataFrame) -> DataFrame:
    """Segments between consecutive pieces of a row (row_id, ax, ay, bx, by): row_id and a segment for each short, straight gap."""
    span = F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2)
    longest = F.max_by(F.struct(((F.col("bx") - F.col("ax")) / span).alias("ux"), ((F.col("by") - F.col("ay")) / span).alias("uy")), span).over(Window.partitionBy("row_id"))
    u = pieces.withColumn("_u", longest)
    at = lambda x, y: F.col(x) * F.col("_u.ux") + F.col(y) * F.col("_u.uy")
    turned = at("bx", "by") < at("ax", "ay")
    ends = {c: F.when(turned, F.col(o)).otherwise(F.col(c)) for c, o in (("ax", "bx"), ("ay", "by"), ("bx", "ax"), ("by", "ay"))}
    o = u.select("row_id", "_u", *(v.alias(k) for k, v in ends.items()))
    w = Window.partitionBy("row_id").orderBy(at("ax", "ay"), "ax", "ay")
    o = o.withColumn("nx", F.lead("ax").over(w)).withColumn("ny", F.lead("ay").over(w))
    along = (F.col("nx") - F.col("bx")) * F.col("_u.ux") + (F.col("ny") - F.col("by")) * F.col("_u.uy")
    off = F.abs((F.col("ny") - F.col("by")) * F.col("_u.ux") - (F.col("nx") - F.col("bx")) * F.col("_u.uy"))
    return o.where((along > 0) & (along <= BRIDGE) & (off <= BRIDGE_OFF)).select("row_id", F.col("bx").alias("ax"), F.col("by").alias("ay"), F.col("nx").alias("bx"), F.col("ny").alias("by"))


def seams(ends: DataFrame) -> DataFrame:
    """Pairs of row ends that meet: ends has end_id, row_id, x, y, ux, uy (outwards) and at_edge. Each pair once, of different rows.

    They face one another and lie ahead of one another (or touch), near one line; they are close, or farther apart and one is at an edge.
    """
    other = ends.select(*(F.col(c).alias(f"o_{c}") for c in ends.columns))
    d = F.sqrt((F.col("x") - F.col("o_x")) ** 2 + (F.col("y") - F.col("o_y")) ** 2)
    pairs = spatial.distance_join(ends, other, EDGE_SEAM, ("x", "y"), ("o_x", "o_y", "o_x", "o_y"), d).where("row_id <> o_row_id AND end_id < o_end_id")
    off = F.abs((F.col("o_y") - F.col("y")) * F.col("ux") - (F.col("o_x") - F.col("x")) * F.col("uy"))
    facing = F.col("ux") * F.col("o_ux") + F.col("uy") * F.col("o_uy") < FACING
    ahead = (F.col("o_x") - F.col("x")) * F.col("ux") + (F.col("o_y") - F.col("y")) * F.col("uy") > -1e-9
    return pairs.where(facing & ahead & (off <= SEAM_OFF) & ((F.col("dist") <= SEAM) | F.col("at_edge") | F.col("o_at_edge"))).select("end_id", F.col("o_end_id").alias("other_id"), "dist")


def extensions(ends: DataFrame, joined: DataFrame, bridged: DataFrame | None = None) -> DataFrame:
    """Open ends at a tile's edge drawn out: end_id and a segment. Ends that a seam or a bridge (as from ``bridges``) starts or ends at aren't open."""
    met = joined.select("end_id").union(joined.select(F.col("other_id").alias("end_id"))).distinct()
    open_ends = ends.where("at_edge").join(met, "end_id", "left_anti")
    if bridged is not None:
        taken = bridged.select("row_id", F.col("ax").alias("x"), F.col("ay").alias("y")).union(bridged.select("row_id", "bx", "by"))
        open_ends = open_ends.join(taken, ["row_id", "x", "y"], "left_anti")
    return open_ends.select("end_id", F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("x") + EXTEND * F.col("ux")).alias("bx"), (F.col("y") + EXTEND * F.col("uy")).alias("by"))


def _apart(p: Column, q: Column, a: Column, b: Column) -> Column:
    side = lambda u, v, w: F.signum((v["x"] - u["x"]) * (w["y"] - u["y"]) - (v["y"] - u["y"]) * (w["x"] - u["x"]))
    return (side(p, q, a) == side(p, q, b)) | (side(a, b, p) == side(a, b, q))


def cut_steps(steps: DataFrame, walls: DataFrame, size: float = 10.0) -> DataFrame:
    """Steps (step_id, px, py, qx, qy) that cross no wall (ax, ay, bx, by)."""
    both = lambda df, x, y, u, v, k: df.select("*", F.least(x, u).alias(f"{k}0"), F.least(y, v).alias(f"{k}1"), F.greatest(x, u).alias(f"{k}2"), F.greatest(y, v).alias(f"{k}3"))
    s, w = both(steps, "px", "py", "qx", "qy", "_s"), both(walls, "ax", "ay", "bx", "by", "_w")
    met = spatial.box_join(s, w, size, ("_s0", "_s1", "_s2", "_s3"), ("_w0", "_w1", "_w2", "_w3"))
    crossed = met.where(~_apart(G.point("px", "py"), G.point("qx", "qy"), G.point("ax", "ay"), G.point("bx", "by"))).select("step_id").distinct()
    return steps.join(crossed, "step_id", "left_anti")


def anchors(targets: DataFrame, cells: DataFrame, reach: float, cheap: float = 2.5, penalty: float = 5.0) -> DataFrame:
    """For each target (target_id, x, y) the nearest open cell (cell_id, cx_m, cy_m, cost); dear cells count as farther away."""
    d = F.sqrt((F.col("x") - F.col("cx_m")) ** 2 + (F.col("y") - F.col("cy_m")) ** 2)
    near = spatial.distance_join(targets, cells, reach, ("x", "y"), ("cx_m", "cy_m", "cx_m", "cy_m"), d)
    price = F.col("dist") + F.when(F.col("cost") > cheap, penalty).otherwise(0.0)
    return near.groupBy("target_id").agg(F.min_by("cell_id", F.struct(price, F.col("cell_id"))).alias("cell_id"))


def crossings(route: DataFrame, axes: DataFrame, passages: DataFrame | None = None, size: float = 50.0, same: float = 0.01) -> DataFrame:
    """Crossings of a route's legs (leg, px, py, qx, qy) with row axes (row_id, ax, ay, bx, by): row_id, leg, x and y.

    Two legs that follow one another and meet on an axis cross it once, at their common point; where they cross it at different places,
    twice. Crossings inside a passage's box (x0, y0, x1, y1) don't count.
    """
    both = lambda df, x, y, u, v, k: df.select("*", F.least(x, u).alias(f"{k}0"), F.least(y, v).alias(f"{k}1"), F.greatest(x, u).alias(f"{k}2"), F.greatest(y, v).alias(f"{k}3"))
    met = spatial.box_join(both(route, "px", "py", "qx", "qy", "_s"), both(axes, "ax", "ay", "bx", "by", "_w"), size, ("_s0", "_s1", "_s2", "_s3"), ("_w0", "_w1", "_w2", "_w3"))
    side = lambda x, y: (F.col("bx") - F.col("ax")) * (F.col(y) - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col(x) - F.col("ax"))
    t = F.coalesce(F.try_divide(side("px", "py"), side("px", "py") - side("qx", "qy")), F.lit(0.0))
    # A leg crosses an axis if its ends aren't on one side of it and the place, as reported, lies on the axis: along its longer extent.
    place = lambda p, q: F.col(p) + t * (F.col(q) - F.col(p))
    on = lambda v, a, b: v.between(F.least(a, b), F.greatest(a, b))
    level = F.abs(F.col("bx") - F.col("ax")) >= F.abs(F.col("by") - F.col("ay"))
    met = met.where(F.signum(side("px", "py")) != F.signum(side("qx", "qy"))).where(F.when(level, on(place("px", "qx"), "ax", "bx")).otherwise(on(place("py", "qy"), "ay", "by")))
    hits = met.select("row_id", "leg", place("px", "qx").alias("x"), place("py", "qy").alias("y"), (side("px", "py") == 0).alias("_meets"))
    if passages is not None:
        boxes = passages.select(*(F.col(c).alias(f"_p{c}") for c in ("x0", "y0", "x1", "y1")))
        points = hits.withColumns({"_hx": F.col("x"), "_hy": F.col("y")})
        inside = spatial.box_join(points, boxes, size, ("x", "y", "_hx", "_hy"), ("_px0", "_py0", "_px1", "_py1")).select("row_id", "leg", "x", "y").distinct()
        hits = hits.join(inside, ["row_id", "leg", "x", "y"], "left_anti")
    before = Window.partitionBy("row_id").orderBy("leg", "x", "y")
    # Near one another isn't enough: legs at a sharp angle may cross an axis twice beside their common point.
    near = F.hypot(F.col("x") - F.lag("x").over(before), F.col("y") - F.lag("y").over(before)) <= same
    again = (F.col("leg") - F.lag("leg").over(before) == 1) & near & F.col("_meets")
    return hits.withColumn("_again", F.coalesce(again, F.lit(False))).where("NOT _again").select("row_id", "leg", "x", "y")
