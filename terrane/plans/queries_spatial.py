"""Queries on geometry, spatial joins, linear referencing, linking and matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import geometry as G
from terrane.functions import scalars as S
from terrane.operators import compliance, matching, spatial, union_area
from terrane.plans.survey import table

ORACLE: dict[str, str] = {}


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return c.select("c_custkey", (F.col("c_custkey") * 7919 % 1000).cast("double").alias("x"), (F.col("c_custkey") * 104729 % 997).cast("double").alias("y"))


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return s.select("s_suppkey", "s_nationkey", (F.col("s_suppkey") * 6151 % 1000).cast("double").alias("sx"), (F.col("s_suppkey") * 3571 % 997).cast("double").alias("sy"))


_PTS = "pt AS (SELECT c_custkey, CAST(c_custkey * 7919 % 1000 AS DOUBLE) AS x, CAST(c_custkey * 104729 % 997 AS DOUBLE) AS y FROM customer), site AS (SELECT s_suppkey, s_nationkey, CAST(s_suppkey * 6151 % 1000 AS DOUBLE) AS sx, CAST(s_suppkey * 3571 % 997 AS DOUBLE) AS sy FROM supplier)"
_DIST = "sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy))"


def _distance():
    return F.sqrt((F.col("x") - F.col("sx")) * (F.col("x") - F.col("sx")) + (F.col("y") - F.col("sy")) * (F.col("y") - F.col("sy")))


def q13_median_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spacing of each nation: the median of its sites' distances to their nearest neighbour within 300, else the median of all."""
    sites = _sites(spark, sf_dir)
    near = sites.withColumnsRenamed({"s_suppkey": "o_key", "s_nationkey": "o_nation", "sx": "x", "sy": "y"})
    pairs = spatial.distance_join(near, sites, 300.0, ("x", "y"), ("sx", "sy", "sx", "sy"), _distance()).where("o_nation = s_nationkey AND o_key <> s_suppkey")
    least = pairs.groupBy("o_nation", "o_key").agg(F.min("dist").alias("d"))
    spacing = least.groupBy(F.col("o_nation").alias("n_nationkey")).agg(F.percentile("d", 0.5).alias("spacing"), F.count(F.lit(1)).alias("_n")).where("_n >= 3").drop("_n")
    out = compliance.with_default(table(spark, sf_dir, "nation").select("n_nationkey"), spacing, "n_nationkey", "spacing")
    return out.select("n_nationkey", F.round("spacing", 4).alias("spacing"), "spacing_measured")


ORACLE["q13_median_spacing"] = f"""WITH {_PTS}, d AS (SELECT a.s_nationkey AS n, a.s_suppkey, min(sqrt((a.sx - b.sx) * (a.sx - b.sx) + (a.sy - b.sy) * (a.sy - b.sy))) AS d FROM site a JOIN site b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey GROUP BY 1, 2 HAVING d <= 300),
m AS (SELECT n, median(d) AS spacing FROM d GROUP BY n HAVING count(*) >= 3) SELECT n_nationkey, round(coalesce(spacing, (SELECT median(spacing) FROM m)), 4) AS spacing, spacing IS NOT NULL AS spacing_measured FROM nation LEFT JOIN m ON n = n_nationkey"""


def q14_nearest_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spatial.nearest_within(_points(spark, sf_dir), _sites(spark, sf_dir), 60.0, "c_custkey", ("x", "y"), "s_suppkey", ("sx", "sy", "sx", "sy"), _distance())
    return found.select("c_custkey", "s_suppkey", F.round("dist", 4).alias("dist"))


ORACLE["q14_nearest_within"] = f"""WITH {_PTS}, j AS (SELECT c_custkey, s_suppkey, {_DIST} AS d FROM pt, site WHERE {_DIST} <= 60), r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY d, s_suppkey) AS r FROM j) SELECT c_custkey, s_suppkey, round(d, 4) AS dist FROM r WHERE r = 1"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-sided rings about every site."""
    s = _sites(spark, sf_dir)
    r = 15.0 + F.col("s_suppkey") % 30
    p = G.line(G.point(F.col("sx") - r, F.col("sy") - r), G.point(F.col("sx") + r, F.col("sy") - r), G.point(F.col("sx") + r, F.col("sy")), G.point(F.col("sx"), F.col("sy") + r), G.point(F.col("sx") - r, F.col("sy")))
    return s.select("s_suppkey", "sx", "sy", r.alias("r"), p.alias("ring"), *(e.alias(n) for n, e in (("bx0", F.col("sx") - r), ("by0", F.col("sy") - r), ("bx1", F.col("sx") + r), ("by1", F.col("sy") + r))))


_EDGES = """blk AS (SELECT *, 15.0 + s_suppkey % 30 AS r FROM site), edge AS (SELECT s_suppkey, sx + r * u.a AS ax, sy + r * u.b AS ay, sx + r * u.c AS ex, sy + r * u.d AS ey FROM blk, (VALUES (-1, -1, 1, -1), (1, -1, 1, 0), (1, 0, 0, 1), (0, 1, -1, 0), (-1, 0, -1, -1)) AS u(a, b, c, d)),
near AS (SELECT c_custkey, x, y, e.*, greatest(0, least(1, ((x - ax) * (ex - ax) + (y - ay) * (ey - ay)) / ((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay)))) AS t FROM pt JOIN blk b ON abs(x - b.sx) <= b.r + 10 AND abs(y - b.sy) <= b.r + 10 JOIN edge e ON e.s_suppkey = b.s_suppkey),
dist AS (SELECT c_custkey, s_suppkey, CASE WHEN sum(CASE WHEN (ay > y) <> (ey > y) AND x < (ex - ax) * (y - ay) / (ey - ay) + ax THEN 1 ELSE 0 END) % 2 = 1 THEN 0 ELSE min(sqrt((x - ax - t * (ex - ax)) * (x - ax - t * (ex - ax)) + (y - ay - t * (ey - ay)) * (y - ay - t * (ey - ay)))) END AS d FROM near GROUP BY c_custkey, s_suppkey)"""


def q15_pip_else_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block that holds a point, else the nearest within 10, else none; the smaller key of equals."""
    found = spatial.nearest_ring(_points(spark, sf_dir), _blocks(spark, sf_dir), 10.0, "c_custkey", ("x", "y"), "s_suppkey", "ring", ("bx0", "by0", "bx1", "by1"), 50.0)
    return found.select("c_custkey", "s_suppkey", (F.col("dist") == 0).alias("inside"), F.round("dist", 4).alias("dist"))


ORACLE["q15_pip_else_nearest"] = f"""WITH {_PTS}, {_EDGES}, r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY d, s_suppkey) AS r FROM dist WHERE d <= 10) SELECT c_custkey, s_suppkey, d = 0 AS inside, round(d, 4) AS dist FROM r WHERE r = 1"""


def _strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    return p.select("c_custkey", F.col("x").alias("tx0"), F.col("y").alias("ty0"), (F.col("x") + 20 + F.col("c_custkey") % 40).alias("tx1"), (F.col("y") + 2 + F.col("c_custkey") % 3).alias("ty1"))


_BOXES = "strip AS (SELECT c_custkey, x AS tx0, y AS ty0, x + 20 + c_custkey % 40 AS tx1, y + 2 + c_custkey % 3 AS ty1 FROM pt), box AS (SELECT s_suppkey, sx - 15.0 - s_suppkey % 30 AS bx0, sy - 15.0 - s_suppkey % 30 AS by0, sx + 15.0 + s_suppkey % 30 AS bx1, sy + 15.0 + s_suppkey % 30 AS by1 FROM site), met AS (SELECT c_custkey, s_suppkey, greatest(least(tx1, bx1) - greatest(tx0, bx0), 0) * greatest(least(ty1, by1) - greatest(ty0, by0), 0) AS shared FROM strip JOIN box ON tx0 <= bx1 AND bx0 <= tx1 AND ty0 <= by1 AND by0 <= ty1)"


def _met(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spatial.box_join(_strips(spark, sf_dir), _blocks(spark, sf_dir).select("s_suppkey", "bx0", "by0", "bx1", "by1"), 50.0, ("tx0", "ty0", "tx1", "ty1"), ("bx0", "by0", "bx1", "by1"))
    shared = G.overlap(F.col("tx0"), F.col("tx1"), F.col("bx0"), F.col("bx1")) * G.overlap(F.col("ty0"), F.col("ty1"), F.col("by0"), F.col("by1"))
    return pairs.select("c_custkey", "s_suppkey", shared.alias("shared"))


def q16_max_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = spatial.best_overlap(_met(spark, sf_dir).where("shared > 0"), "c_custkey", "s_suppkey", "shared")
    return best.select("c_custkey", "s_suppkey", F.round("shared", 4).alias("shared"))


ORACLE["q16_max_overlap"] = f"WITH {_PTS}, {_BOXES}, r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY shared DESC, s_suppkey) AS r FROM met WHERE shared > 0) SELECT c_custkey, s_suppkey, round(shared, 4) AS shared FROM r WHERE r = 1"


def q17_spatial_join_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each block the strips that it shares more than 1 with, the area, and the four largest."""
    pairs = _met(spark, sf_dir).where("shared > 1")
    out = pairs.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("strips"), F.round(F.sum("shared"), 3).alias("shared"), F.slice(F.array_sort(F.collect_list(F.struct((-F.col("shared")).alias("a"), F.col("c_custkey").alias("k")))), 1, 4).alias("_top"))
    return out.select("s_suppkey", "strips", "shared", F.array_join(F.transform("_top", lambda t: t["k"].cast("string")), " ").alias("largest"))


ORACLE["q17_spatial_join_area"] = f"WITH {_PTS}, {_BOXES}, r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY shared DESC, c_custkey) AS r FROM met WHERE shared > 1) SELECT s_suppkey, count(*) AS strips, round(sum(shared), 3) AS shared, string_agg(CASE WHEN r <= 4 THEN CAST(c_custkey AS VARCHAR) END, ' ' ORDER BY r) AS largest FROM r GROUP BY s_suppkey"


def q18_convex_clip_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diamonds against boxes: the area of the intersection by clipping."""
    p = _points(spark, sf_dir)
    r = 5.0 + F.col("c_custkey") % 20
    diamond = G.line(G.point(F.lit(0.0), -r), G.point(r, F.lit(0.0)), G.point(F.lit(0.0), r), G.point(-r, F.lit(0.0)))
    h = 1.0 + F.col("c_custkey") % 17
    # A column of its own, so that it isn't worked out for each use; one small file would be one task.
    clipped = p.repartition("c_custkey").select("c_custkey", G.convex_intersection(diamond, G.box(-h, -h, h, h)).alias("ring"))
    return clipped.select("c_custkey", F.round(F.when(F.size("ring") < 3, 0.0).otherwise(G.area(F.col("ring"))), 4).alias("shared"))


# A diamond of radius r less the four corners that stick out of a square of half width h.
ORACLE["q18_convex_clip_area"] = f"WITH {_PTS}, g AS (SELECT c_custkey, 5.0 + c_custkey % 20 AS r, 1.0 + c_custkey % 17 AS h FROM pt) SELECT c_custkey, round(CAST(CASE WHEN h >= r THEN 2 * r * r WHEN r >= 2 * h THEN 4 * h * h ELSE 2 * r * r - 4 * (r - h) * (r - h) END AS DOUBLE), 4) AS shared FROM g"


def q19_polygon_area_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _blocks(spark, sf_dir)
    return b.select("s_suppkey", F.round(G.area(F.col("ring")), 4).alias("area"), F.round(G.centroid(F.col("ring"))["x"], 4).alias("cx"), F.round(G.centroid(F.col("ring"))["y"], 4).alias("cy"), F.round(G.length(F.concat("ring", F.slice("ring", 1, 1))), 4).alias("perimeter"), G.bounds(F.col("ring"))["x0"].alias("x0"), G.bounds(F.col("ring"))["y1"].alias("y1"))


ORACLE["q19_polygon_area_centroid"] = f"""WITH {_PTS}, {_EDGES}, c AS (SELECT e.s_suppkey, b.sx, b.sy, b.r, ax - b.sx AS ax, ay - b.sy AS ay, ex - b.sx AS ex, ey - b.sy AS ey FROM edge e JOIN blk b ON b.s_suppkey = e.s_suppkey),
g AS (SELECT s_suppkey, any_value(sx) AS sx, any_value(sy) AS sy, any_value(r) AS r, sum(ax * ey - ex * ay) / 2 AS a, sum((ax + ex) * (ax * ey - ex * ay)) AS mx, sum((ay + ey) * (ax * ey - ex * ay)) AS my, sum(sqrt((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay))) AS p FROM c GROUP BY s_suppkey)
SELECT s_suppkey, round(CAST(abs(a) AS DOUBLE), 4) AS area, round(CAST(sx + mx / (6 * a) AS DOUBLE), 4) AS cx, round(CAST(sy + my / (6 * a) AS DOUBLE), 4) AS cy, round(CAST(p AS DOUBLE), 4) AS perimeter, CAST(sx - r AS DOUBLE) AS x0, CAST(sy + r AS DOUBLE) AS y1 FROM g"""


def q20_line_clip_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slanted rows clipped by the blocks' boxes: length inside, by block."""
    p = _points(spark, sf_dir)
    rows = p.select("c_custkey", "x", "y", (F.col("x") + 50 + F.col("c_custkey") % 11).alias("ex"), (F.col("y") + 5 + F.col("c_custkey") % 23).alias("ey"))
    blocks = _blocks(spark, sf_dir).select("s_suppkey", "bx0", "by0", "bx1", "by1")
    found = spatial.clipped_length(rows, blocks, 50.0, ("x", "y", "ex", "ey"), "s_suppkey", ("bx0", "by0", "bx1", "by1"))
    return found.select("s_suppkey", F.col("n").alias("n_rows"), F.round("length", 3).alias("length_m"))


ORACLE["q20_line_clip_length"] = f"""WITH {_PTS}, {_BOXES}, l AS (SELECT c_custkey, x, y, CAST(50 + c_custkey % 11 AS DOUBLE) AS dx, CAST(5 + c_custkey % 23 AS DOUBLE) AS dy FROM pt),
k AS (SELECT s_suppkey, dx, dy, greatest(0, (bx0 - x) / dx, (by0 - y) / dy) AS t0, least(1, (bx1 - x) / dx, (by1 - y) / dy) AS t1 FROM l JOIN box ON x <= bx1 AND bx0 <= x + dx AND y <= by1 AND by0 <= y + dy)
SELECT s_suppkey, count(*) AS n_rows, round(sum((t1 - t0) * sqrt(dx * dx + dy * dy)), 3) AS length_m FROM k WHERE t1 > t0 GROUP BY s_suppkey"""


def q21_linear_referencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where points lie along a polyline of three points, how far off it, and the point that far along."""
    p = _points(spark, sf_dir)
    route = G.line(*(G.point(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (500.0, 400.0), (1000.0, 300.0))))
    q = G.point("x", "y")
    return p.select("c_custkey", F.round(G.project(route, q), 3).alias("at"), F.round(G.line_distance(q, route), 3).alias("off"))


ORACLE["q21_linear_referencing"] = f"""WITH {_PTS}, s AS (SELECT * FROM (VALUES (1, 0.0, 0.0, 500.0, 400.0, 0.0), (2, 500.0, 400.0, 1000.0, 300.0, sqrt(410000.0))) AS s(i, ax, ay, ex, ey, run)),
f AS (SELECT c_custkey, i, run, ax, ay, ex, ey, x, y, greatest(0, least(1, ((x - ax) * (ex - ax) + (y - ay) * (ey - ay)) / ((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay)))) AS t FROM pt, s),
d AS (SELECT c_custkey, i, run + t * sqrt((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay)) AS a, sqrt((x - ax - t * (ex - ax)) * (x - ax - t * (ex - ax)) + (y - ay - t * (ey - ay)) * (y - ay - t * (ey - ay))) AS o FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY o, i) AS n FROM d) SELECT c_custkey, round(a, 3) AS at, round(o, 3) AS off FROM r WHERE n = 1""".replace(" AS at,", ' AS "at",')


def q22_link_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of row pieces of different tiles, one behind the other on nearly one axis, with no third piece in between."""
    p = _points(spark, sf_dir)
    seg = p.select("c_custkey", (F.floor(F.col("y") / 20)).alias("axis"), F.col("x").alias("lo"), (F.col("x") + 3 + F.col("c_custkey") % 25).alias("hi"), (F.col("c_custkey") % 5).alias("tile"))
    return spatial.next_on_axis(seg, "axis", "c_custkey", 60.0).where("b_tile <> tile").select(F.col("c_custkey").alias("a"), F.col("b_c_custkey").alias("b"), F.round(F.col("b_lo") - F.col("hi"), 3).alias("gap"))


ORACLE["q22_link_candidates"] = f"""WITH {_PTS}, s AS (SELECT c_custkey, floor(y / 20) AS axis, x AS lo, x + 3 + c_custkey % 25 AS hi, c_custkey % 5 AS tile FROM pt)
SELECT a.c_custkey AS a, b.c_custkey AS b, round(b.lo - a.hi, 3) AS gap FROM s a JOIN s b ON a.axis = b.axis AND a.tile <> b.tile AND b.lo - a.hi BETWEEN 0 AND 60
WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.axis = a.axis AND (t.lo + t.hi) / 2 > a.hi AND (t.lo + t.hi) / 2 < b.lo AND t.c_custkey NOT IN (a.c_custkey, b.c_custkey))"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes found and boxes expected, by tile, with their overlaps. Expected ones lie on a grid."""
    p = _points(spark, sf_dir)
    ref = p.select((F.col("c_custkey") % 10).alias("tile"), F.col("c_custkey").alias("ref"), (F.col("c_custkey") % 37 * 30).cast("double").alias("rx0"), (F.floor(F.col("c_custkey") / 370) * 30).cast("double").alias("ry0"))
    ref = ref.withColumn("rx1", F.col("rx0") + 20).withColumn("ry1", F.col("ry0") + 20)
    shift = F.col("ref") % 13
    found = ref.where("ref % 7 <> 3").select(F.col("tile").alias("p_tile"), (F.col("ref") + 1).alias("pred"), (F.col("rx0") + shift).alias("px0"), (F.col("ry0") + shift / 2).alias("py0"), (F.col("rx1") + shift).alias("px1"), (F.col("ry1") + shift / 2).alias("py1"))
    met = spatial.box_join(ref, found, 30.0, ("rx0", "ry0", "rx1", "ry1"), ("px0", "py0", "px1", "py1")).where("tile = p_tile")
    return met.withColumn("iou", matching.box_iou("r", "p")).where("iou > 0").select("tile", "pred", "ref", "iou")


def q24_iou_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one by the largest sum of overlaps, then hits, found and expected, with F1."""
    hits = matching.match_one_to_one(_pairs(spark, sf_dir), "tile", "pred", "ref", "iou", 0.5).groupBy("tile").agg(F.count(F.lit(1)).alias("hits"))
    c = table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 10).alias("tile")).agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.col("c_custkey") % 7 != 3).alias("found"))
    out = c.join(hits, "tile", "left").fillna(0)
    return out.select("tile", "hits", "found", "expected", F.round(S.f1(F.col("hits"), F.col("found"), F.col("expected")), 6).alias("f1"))


# Boxes of the same tile don't touch but for the pair that belongs together, so that the best assignment takes each pair.
ORACLE["q24_iou_matching"] = """WITH c AS (SELECT c_custkey % 10 AS tile, c_custkey % 7 <> 3 AS f, greatest(20 - c_custkey % 13, 0) * greatest(20 - c_custkey % 13 / 2, 0) AS s FROM customer),
g AS (SELECT tile, count(CASE WHEN f AND s / (800 - s + 1e-12) >= 0.5 THEN 1 END) AS hits, count(CASE WHEN f THEN 1 END) AS found, count(*) AS expected FROM c GROUP BY tile)
SELECT tile, hits, found, expected, round(CASE WHEN hits = 0 THEN 0 ELSE 2 * (hits / found) * (hits / expected) / (hits / found + hits / expected) END, 6) AS f1 FROM g"""


def q25_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that stay after greedy suppression (SQL has no ordered fold; tested against a plain loop)."""
    p = _points(spark, sf_dir)
    boxes = p.select((F.col("c_custkey") % 2).alias("tile"), "c_custkey", ((F.col("c_custkey") * 31 % 101) / 101).alias("score"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 60).alias("x1"), (F.col("y") + 60).alias("y1"))
    return matching.suppress(boxes, "tile", "c_custkey", "score", 0.3)


def q46_union_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of the union of each nation's boxes by slabs, beside the plain sum."""
    b = _blocks(spark, sf_dir)
    rings = b.join(_sites(spark, sf_dir).select("s_suppkey", "s_nationkey"), "s_suppkey").select("s_nationkey", G.box(F.col("bx0"), F.col("by0"), F.col("bx1"), F.col("by1")).alias("ring"))
    plain = rings.groupBy("s_nationkey").agg(F.round(F.sum(G.area(F.col("ring"))), 3).alias("plain_sum"))
    return union_area.union_areas(rings, "s_nationkey", "ring").join(plain, "s_nationkey").select("s_nationkey", F.round("area", 3).alias("area"), "plain_sum")


# On the unit grid, as all corners are whole numbers.
ORACLE["q46_union_area"] = f"""WITH {_PTS}, {_BOXES}, n AS (SELECT s_nationkey, box.* FROM box JOIN site USING (s_suppkey)),
cell AS (SELECT DISTINCT s_nationkey, u.x, v.y FROM n, LATERAL (SELECT unnest(range(CAST(bx0 AS BIGINT), CAST(bx1 AS BIGINT))) AS x) u, LATERAL (SELECT unnest(range(CAST(by0 AS BIGINT), CAST(by1 AS BIGINT))) AS y) v),
a AS (SELECT s_nationkey, CAST(count(*) AS DOUBLE) AS area FROM cell GROUP BY s_nationkey), s AS (SELECT s_nationkey, round(CAST(sum((bx1 - bx0) * (by1 - by0)) AS DOUBLE), 3) AS plain_sum FROM n GROUP BY s_nationkey) SELECT s_nationkey, area, plain_sum FROM a JOIN s USING (s_nationkey)"""

QUERIES = {k: f for k, f in globals().items() if k[0] == "q" and k[1:3].isdigit()}
