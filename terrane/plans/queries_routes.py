"""Queries on routes, the grid, reports as documents, quality checks and row ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.functions import geometry as G
from terrane.functions import scalars as S
from terrane.operators import graph, intervals, reports, routes, selection, spatial
from terrane.plans.queries_fields import _ZONES_SQL, _zones
from terrane.plans.queries_spatial import _PTS, _points, _sites, _strips
from terrane.plans.survey import MERGED, ROW_LENGTH, survey, table

ORACLE: dict[str, str] = {}


def _stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sites(spark, sf_dir).select(F.col("s_nationkey").cast("long").alias("route"), "s_suppkey", F.col("sx").alias("x"), F.col("sy").alias("y"))


_LEGS_SQL = "stop AS (SELECT CAST(s_nationkey AS BIGINT) AS route, s_suppkey, sx AS x, sy AS y FROM site), leg AS (SELECT * FROM (SELECT route, row_number() OVER w AS leg, x AS px, y AS py, lead(x) OVER w AS qx, lead(y) OVER w AS qy FROM stop WINDOW w AS (PARTITION BY route ORDER BY s_suppkey)) WHERE qx IS NOT NULL), leg_m AS (SELECT *, sqrt((qx - px) * (qx - px) + (qy - py) * (qy - py)) AS m FROM leg)"


def q72_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block report as one nested document for each status: a summary and the blocks, in order."""
    report = reports.block_report(survey(spark, sf_dir), ROW_LENGTH, 3.0)
    block = F.struct("vineyard_id", "n_rows", "disrupted_rows", "missing_vines")
    per = report.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("missing_vines").alias("m"), F.array_sort(F.collect_list(block)).alias("b"))
    doc = F.to_json(F.struct(F.struct(F.col("n").alias("blocks"), F.col("m").alias("missing_vines")).alias("summary"), F.col("b").alias("blocks")))
    return per.select("status", doc.alias("document"))


ORACLE["q72_report_json"] = f"""WITH {MERGED} SELECT status, '{{"summary":{{"blocks":' || count(*) || ',"missing_vines":' || CAST(sum(missing_vines) AS BIGINT) || '}},"blocks":[' || string_agg('{{"vineyard_id":' || vineyard_id || ',"n_rows":' || n_rows || ',"disrupted_rows":' || disrupted_rows || ',"missing_vines":' || missing_vines || '}}', ',' ORDER BY vineyard_id) || ']}}' AS document FROM report GROUP BY status"""


def q73_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality checks as lines of a report: what was measured, over how much, and its grade."""
    strips, zones = _strips(spark, sf_dir), _zones(spark, sf_dir)
    n = lambda df, ok: df.agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("good"))
    line = table(spark, sf_dir, "lineitem")
    repeated = line.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("k"))
    totals = line.select("l_orderkey").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(True).alias("known")), "l_orderkey", "left")
    shape = strips.withColumn("ratio", (F.col("tx1") - F.col("tx0")) / (F.col("ty1") - F.col("ty0")))
    inside = selection.inside_share(strips, zones, "c_custkey", ("tx0", "ty0", "tx1", "ty1"), ("zx0", "zy0", "zx1", "zy1"), 40.0)
    rows = [
        ("B2 vertices in the frame", n(strips, (F.col("tx0") >= 0) & (F.col("ty0") >= 0) & (F.col("tx1") <= 1040) & (F.col("ty1") <= 1000)), 0.99, 0.9),
        ("B4 little under forbidden boxes", n(strips.join(inside, "c_custkey", "left"), F.coalesce("inside", F.lit(0.0)) <= 0.25), 0.9, 0.5),
        ("C1 shape of strips", n(shape, F.col("ratio") <= 20), 0.95, 0.8),
        ("R2 no duplicates", n(repeated, F.col("k") == 1), 1.0, 0.999),
        ("R3 prefix of ids", n(table(spark, sf_dir, "part"), F.col("p_brand").startswith("Brand#")), 1.0, 0.9),
        ("M1 totals agree", n(totals, F.coalesce("known", F.lit(False))), 1.0, 0.99),
    ]
    out = None
    for name, df, ok, warn in rows:
        share = S.share(F.col("good"), F.col("n"))
        one = df.select(F.lit(name).alias("check_id"), "n", F.round(share, 4).alias("share"), S.grade(share, ok, warn).alias("grade"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("line", F.concat(F.lit("| "), F.col("check_id"), F.lit(" | "), F.col("grade"), F.lit(" | "), F.col("n").cast("string"), F.lit(" |")))


_CHECKS_SQL = (
    ("B2 vertices in the frame", "SELECT tx0 >= 0 AND ty0 >= 0 AND tx1 <= 1040 AND ty1 <= 1000 AS ok FROM strip", 0.99, 0.9),
    ("B4 little under forbidden boxes", "SELECT coalesce(inside, 0) <= 0.25 AS ok FROM strip LEFT JOIN share USING (c_custkey)", 0.9, 0.5),
    ("C1 shape of strips", "SELECT (tx1 - tx0) / (ty1 - ty0) <= 20 AS ok FROM strip", 0.95, 0.8),
    ("R2 no duplicates", "SELECT count(*) = 1 AS ok FROM lineitem GROUP BY l_orderkey, l_linenumber", 1.0, 0.999),
    ("R3 prefix of ids", "SELECT p_brand LIKE 'Brand#%' AS ok FROM part", 1.0, 0.9),
    ("M1 totals agree", "SELECT o_orderkey IS NOT NULL AS ok FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey", 1.0, 0.99),
)
ORACLE["q73_quality_report"] = f"WITH {_PTS}, {_ZONES_SQL}, a AS (" + " UNION ALL ".join(f"SELECT '{name}' AS check_id, count(*) AS n, count(CASE WHEN ok THEN 1 END) / count(*) AS s, {ok}::DOUBLE AS a, {warn}::DOUBLE AS w FROM ({sql})" for name, sql, ok, warn in _CHECKS_SQL) + ") SELECT check_id, n, round(s, 4) AS share, CASE WHEN s >= a THEN 'PASS' WHEN s >= w THEN 'WARN' ELSE 'FAIL' END AS grade, '| ' || check_id || ' | ' || CASE WHEN s >= a THEN 'PASS' WHEN s >= w THEN 'WARN' ELSE 'FAIL' END || ' | ' || n || ' |' AS line FROM a"


def q74_stage_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last figure of each stage from a log that is only appended to."""
    e = table(spark, sf_dir, "events")
    last = e.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.count(F.lit(1)).alias("runs"))
    return last.groupBy("user_id").agg(F.count(F.lit(1)).alias("stages"), F.sum("runs").alias("runs"), F.round(F.sum("value"), 3).alias("seconds"))


ORACLE["q74_stage_timings"] = "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events) SELECT user_id, count(*) AS stages, CAST(sum(n) AS BIGINT) AS runs, round(sum(value), 3) AS seconds FROM r WHERE r = 1 GROUP BY user_id"


def q75_label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's boxes that pass score and size, as lines of a label file: class, centre and size as shares of the tile, to eight decimals."""
    k = F.col("c_custkey")
    boxes = _points(spark, sf_dir).select((k % 40).alias("tile"), k.alias("box"), (k % 64 / 64).alias("score"), (k * 5 % 640).cast("double").alias("x0"), (k * 7 % 640).cast("double").alias("y0"), (k * 5 % 640 + k % 16).cast("double").alias("x1"), (k * 7 % 640 + k % 5).cast("double").alias("y1"), (k % 19 == 3).alias("forbidden"))
    kept = selection.model_boxes(boxes, 0.25)
    share = lambda c: F.format_string("%.8f", c / 640)
    line = F.concat_ws(" ", (F.col("box") % 3).cast("string"), share((F.col("x0") + F.col("x1")) / 2), share((F.col("y0") + F.col("y1")) / 2), share(F.col("x1") - F.col("x0")), share(F.col("y1") - F.col("y0")))
    return kept.select("tile", "box", line.alias("label"))


ORACLE["q75_label_lines"] = """WITH b AS (SELECT c_custkey AS k, CAST(c_custkey * 5 % 640 AS DOUBLE) AS x, CAST(c_custkey * 7 % 640 AS DOUBLE) AS y, CAST(c_custkey % 16 AS DOUBLE) AS w, CAST(c_custkey % 5 AS DOUBLE) AS h FROM customer)
SELECT k % 40 AS tile, k AS box, (k % 3) || ' ' || printf('%.8f', (x + w / 2) / 640) || ' ' || printf('%.8f', (y + h / 2) / 640) || ' ' || printf('%.8f', w / 640) || ' ' || printf('%.8f', h / 640) AS label FROM b WHERE k % 64 >= 16 AND greatest(w, h) BETWEEN 0.1 AND 10 AND k % 19 <> 3"""


def q76_grouped_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations from JSON texts, by image: how many, of which classes, and the sum of their areas."""
    k = F.col("p_partkey")
    text = F.to_json(F.struct(F.array(*(F.struct((k * 3 + i).alias("id"), (k % 11).alias("image_id"), (k % 4 + i).alias("category_id"), (F.col("p_size") * (i + 1)).alias("area")) for i in range(3))).alias("annotations")))
    docs = table(spark, sf_dir, "part").select(text.alias("text"))
    parsed = docs.select(F.from_json("text", "annotations array<struct<id:long,image_id:long,category_id:long,area:double>>").alias("j"))
    rows = parsed.select(F.inline("j.annotations"))
    return rows.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_set("category_id")), lambda c: c.cast("string")), ",").alias("classes"), F.sum("area").alias("area"), F.min("id").alias("first"))


ORACLE["q76_grouped_annotations"] = "WITH a AS (SELECT p_partkey * 3 + i AS id, p_partkey % 11 AS image_id, p_partkey % 4 + i AS c, p_size * (i + 1) AS area FROM part, range(3) r(i)) SELECT image_id, count(*) AS n, string_agg(DISTINCT CAST(c AS VARCHAR), ',' ORDER BY CAST(c AS VARCHAR)) AS classes, CAST(sum(area) AS DOUBLE) AS area, min(id) AS first FROM a GROUP BY image_id".replace("AS first", 'AS "first"')


def q77_levels_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three-level table as lines of text, read back with its types, the block level alone."""
    merged = intervals.merge(survey(spark, sf_dir), ["vineyard_id", "row_id"]).withColumn("length", F.col("hi") - F.col("lo"))
    lines = reports.rollup_levels(merged, "vineyard_id", "row_id", "length").select(F.to_csv(F.struct("level", "vineyard_id", "row_id", "length_m", "segments")).alias("line"))
    read = lines.select(F.from_csv("line", F.lit("level string, vineyard_id long, row_id long, length_m double, segments long")).alias("r")).select("r.*")
    return read.where("level = 'block'").select("vineyard_id", F.round("length_m", 2).alias("length_m"), "segments")


ORACLE["q77_levels_read_back"] = f"WITH {MERGED} SELECT vineyard_id, round(round(sum(hi - lo), 3), 2) AS length_m, count(*) AS segments FROM merged GROUP BY vineyard_id"


def q78_route_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's route through its sites: length against the declared one, crossings of rows, targets within 2 m, share outside."""
    lines = routes.legs(_stops(spark, sf_dir), "route", "s_suppkey", "s_suppkey")
    axes = _strips(spark, sf_dir).select(F.col("c_custkey").alias("row_id"), F.col("tx0").alias("ax"), (F.col("ty0") + 0.25).alias("ay"), F.col("tx1").alias("bx"), (F.col("ty0") + 0.25).alias("by"))
    declared = lines.groupBy("route").agg(F.sum("metres").alias("_m")).select("route", (F.col("_m") + F.col("route") % 3).alias("declared_m"))
    targets = _points(spark, sf_dir).withColumnRenamed("c_custkey", "target_id")
    allowed = _zones(spark, sf_dir).toDF("x0", "y0", "x1", "y1")
    out = routes.checked(lines, declared, axes, None, allowed, targets)
    return out.select("route", "n_legs", F.round("length_m", 2).alias("length_m"), "crossings", "visited", F.round("outside_share", 4).alias("outside_share"), "ok")


# Rows run level, so that a leg crosses one where its height is the row's; sites and rows don't share heights.
ORACLE["q78_route_checks"] = f"""WITH {_PTS}, {_ZONES_SQL}, {_LEGS_SQL}, x AS (SELECT route, count(*) AS crossings FROM leg_m JOIN strip ON (py < ty0 + 0.25) <> (qy < ty0 + 0.25) AND px + (ty0 + 0.25 - py) / (qy - py) * (qx - px) BETWEEN tx0 AND tx1 GROUP BY route),
d AS (SELECT route, c_custkey, x, y, px, py, qx, qy, greatest(0, least(1, ((x - px) * (qx - px) + (y - py) * (qy - py)) / (m * m))) AS t FROM leg_m JOIN pt ON x BETWEEN least(px, qx) - 2 AND greatest(px, qx) + 2 AND y BETWEEN least(py, qy) - 2 AND greatest(py, qy) + 2 WHERE m > 0),
v AS (SELECT route, count(DISTINCT c_custkey) AS visited FROM d WHERE (x - px - t * (qx - px)) * (x - px - t * (qx - px)) + (y - py - t * (qy - py)) * (y - py - t * (qy - py)) <= 4 GROUP BY route),
c AS (SELECT route, m, greatest(0, CASE WHEN qx = px THEN 0 ELSE least((zx0 - px) / (qx - px), (zx1 - px) / (qx - px)) END, CASE WHEN qy = py THEN 0 ELSE least((zy0 - py) / (qy - py), (zy1 - py) / (qy - py)) END) AS t0, least(1, CASE WHEN qx = px THEN 1 ELSE greatest((zx0 - px) / (qx - px), (zx1 - px) / (qx - px)) END, CASE WHEN qy = py THEN 1 ELSE greatest((zy0 - py) / (qy - py), (zy1 - py) / (qy - py)) END) AS t1
 FROM leg_m JOIN zone ON least(px, qx) <= zx1 AND zx0 <= greatest(px, qx) AND least(py, qy) <= zy1 AND zy0 <= greatest(py, qy)),
i AS (SELECT route, sum(CASE WHEN t1 > t0 THEN (t1 - t0) * m ELSE 0 END) AS inside FROM c GROUP BY route), l AS (SELECT route, sum(m) AS len, count(*) AS n FROM leg_m GROUP BY route)
SELECT l.route, n AS n_legs, round(len, 2) AS length_m, coalesce(crossings, 0) AS crossings, coalesce(visited, 0) AS visited, round(1 - coalesce(inside, 0) / len, 4) AS outside_share, l.route % 3 <= 1 AND 1 - coalesce(inside, 0) / len <= 0.02 AND coalesce(crossings, 0) = 0 AS ok FROM l LEFT JOIN x USING (route) LEFT JOIN v USING (route) LEFT JOIN i USING (route)"""


def q79_stop_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What leaving out each stop would save, for what a visit is worth; how many days each route takes."""
    priced = routes.savings(_stops(spark, sf_dir), "route", "s_suppkey", "s_suppkey", S.target_value(F.when(F.col("s_suppkey") % 4 == 0, "waste").otherwise("gap"), F.col("s_suppkey") % 9))
    length = routes.legs(_stops(spark, sf_dir), "route", "s_suppkey", "s_suppkey").groupBy("route").agg(F.sum("metres").alias("length_m"))
    days = routes.days_needed(length, 4.0, 0.25)
    return priced.join(days, "route").select("route", "s_suppkey", F.round("saved", 3).alias("saved"), F.round("saved_for_worth", 3).alias("saved_for_worth"), "days", F.round("minutes", 3).alias("minutes"))


ORACLE["q79_stop_savings"] = f"""WITH {_PTS}, {_LEGS_SQL}, n AS (SELECT *, lag(x) OVER w AS ax, lag(y) OVER w AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS by_ FROM stop WINDOW w AS (PARTITION BY route ORDER BY s_suppkey)), s AS (SELECT route, s_suppkey, coalesce(sqrt((x - ax) * (x - ax) + (y - ay) * (y - ay)) + sqrt((x - bx) * (x - bx) + (y - by_) * (y - by_)) - sqrt((ax - bx) * (ax - bx) + (ay - by_) * (ay - by_)), 0) AS gain, CASE WHEN s_suppkey % 4 = 0 THEN 10 WHEN s_suppkey % 9 >= 5 THEN 3 ELSE 1 END AS worth FROM n), z AS (SELECT *, CASE WHEN gain > 1e-9 THEN gain ELSE 0 END AS saved FROM s),
l AS (SELECT route, sum(m) AS len FROM leg_m GROUP BY route), d AS (SELECT *, CAST(least(greatest(ceil(len / 1000), 1), 8) AS INTEGER) AS days FROM l) SELECT route, s_suppkey, round(saved, 3) AS saved, round(saved / worth, 3) AS saved_for_worth, days, round(len / days / (4000 / 60.0::DOUBLE), 3) AS minutes FROM z JOIN d USING (route)"""


def q80_detours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Must-visit points put into the leg that they lengthen least."""
    extra = _points(spark, sf_dir).where("c_custkey % 10 = 0").join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("route")), "c_custkey").select("route", "c_custkey", F.col("x").alias("ex"), F.col("y").alias("ey"))
    return routes.detours(_stops(spark, sf_dir), extra, "route", "s_suppkey", "s_suppkey", "c_custkey").select("route", "c_custkey", "leg", F.round("added", 4).alias("added"))


ORACLE["q80_detours"] = f"""WITH {_PTS}, {_LEGS_SQL}, a AS (SELECT l.route, c_custkey, leg, round(sqrt((x - px) * (x - px) + (y - py) * (y - py)) + sqrt((qx - x) * (qx - x) + (qy - y) * (qy - y)) - m, 9) AS added FROM pt JOIN customer USING (c_custkey) JOIN leg_m l ON l.route = c_nationkey WHERE c_custkey % 10 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY added, leg) AS r FROM a) SELECT route, c_custkey, leg, round(added, 4) AS added FROM r WHERE r = 1"""


def q81_grid_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the walking grid under strips, what they cost (links, passages over them, forbidden boxes over all), by row of the grid."""
    strips = routes.raster_cells(_strips(spark, sf_dir), 2.0, "tx0", "ty0", "tx1", "ty1")
    core = routes.raster_cells(_sites(spark, sf_dir).select("sx", "sy", (F.col("sx") + 60).alias("ex"), (F.col("sy") + 6).alias("ey")), 2.0, "sx", "sy", "ex", "ey")
    blocked = routes.raster_cells(_zones(spark, sf_dir), 2.0, "zx0", "zy0", "zx1", "zy1")
    cells = routes.marked_cells(strip=strips, core=core, blocked=blocked).where("strip")
    cost = graph.cost_of(F.col("blocked"), F.col("core"), F.lit(True))
    return cells.groupBy("r").agg(F.count(F.lit(1)).alias("cells"), F.count(cost).alias("open_cells"), F.sum(cost).alias("cost"))


_RASTER = "(SELECT DISTINCT u.c, v.r FROM ({0}), LATERAL (SELECT unnest(range(CAST(ceil(a0 / 2 - 0.5) AS BIGINT), CAST(ceil(a1 / 2 - 0.5) AS BIGINT))) AS c) u, LATERAL (SELECT unnest(range(CAST(ceil(b0 / 2 - 0.5) AS BIGINT), CAST(ceil(b1 / 2 - 0.5) AS BIGINT))) AS r) v)"
ORACLE["q81_grid_costs"] = f"""WITH {_PTS}, {_ZONES_SQL}, s AS {_RASTER.format("SELECT tx0 AS a0, ty0 AS b0, tx1 AS a1, ty1 AS b1 FROM strip")}, k AS {_RASTER.format("SELECT sx AS a0, sy AS b0, sx + 60 AS a1, sy + 6 AS b1 FROM site")}, z AS {_RASTER.format("SELECT zx0 AS a0, zy0 AS b0, zx1 AS a1, zy1 AS b1 FROM zone")},
j AS (SELECT s.r, CASE WHEN z.r IS NOT NULL THEN NULL WHEN k.r IS NOT NULL THEN 1.0 ELSE 20.0 END AS cost FROM s LEFT JOIN k ON k.r = s.r AND k.c = s.c LEFT JOIN z ON z.r = s.r AND z.c = s.c) SELECT r, count(*) AS cells, count(cost) AS open_cells, CAST(sum(cost) AS DOUBLE) AS cost FROM j GROUP BY r"""


def q82_closed_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of sites' boxes with narrow gaps closed: grown and shrunk by two cells, by row of the grid."""
    boxes = _sites(spark, sf_dir).select("sx", "sy", (F.col("sx") + 30).alias("ex"), (F.col("sy") + 24).alias("ey"))
    cells = routes.raster_cells(boxes, 6.0, "sx", "sy", "ex", "ey").select("r", "c").distinct()
    return routes.closed(cells, 2).groupBy("r").agg(F.count(F.lit(1)).alias("cells"), F.min("c").alias("first"), F.max("c").alias("last"))


ORACLE["q82_closed_outline"] = f"""WITH {_PTS}, k AS (SELECT DISTINCT u.c, v.r FROM site, LATERAL (SELECT unnest(range(CAST(ceil(sx / 6 - 0.5) AS BIGINT), CAST(ceil((sx + 30) / 6 - 0.5) AS BIGINT))) AS c) u, LATERAL (SELECT unnest(range(CAST(ceil(sy / 6 - 0.5) AS BIGINT), CAST(ceil((sy + 24) / 6 - 0.5) AS BIGINT))) AS r) v),
o AS (SELECT a.i, b.i AS j FROM range(-2, 3) a(i), range(-2, 3) b(i)), d AS (SELECT DISTINCT r + i AS r, c + j AS c FROM k, o), e AS (SELECT r + i AS r, c + j AS c FROM d, o GROUP BY 1, 2 HAVING count(*) = 25) SELECT r, count(*) AS cells, min(c) AS "first", max(c) AS "last" FROM e GROUP BY r"""


def q83_row_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows cut to where plants are: samples along a row, smoothed; ends without plants and long empty stretches go, short pieces too."""
    samples = table(spark, sf_dir, "events").select(F.col("user_id").alias("row"), "event_id", "value")
    pieces = intervals.planted_pieces(samples, "row", "event_id", "value", 45.0, 2, 3, 4)
    return pieces.select("row", "piece", "n", "first", "last")


ORACLE["q83_row_ends"] = """WITH s AS (SELECT user_id AS rw, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) >= 45 AS good FROM events), g AS (SELECT rw, i, i - lag(i) OVER (PARTITION BY rw ORDER BY i) AS step FROM s WHERE good),
p AS (SELECT *, sum(CASE WHEN step <= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY rw ORDER BY i ROWS UNBOUNDED PRECEDING) AS piece FROM g), q AS (SELECT rw, piece, min(i) AS a, max(i) AS b FROM p GROUP BY rw, piece) SELECT rw AS "row", row_number() OVER (PARTITION BY rw ORDER BY a) AS piece, b - a + 1 AS n, a AS "first", b AS "last" FROM q WHERE b - a + 1 >= 4"""


def q84_link_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of row pieces that may be one row: nearly one direction, one behind the other, little off the line, of different tiles."""
    k = F.col("c_custkey")
    p = _points(spark, sf_dir)
    turn = (k % 9 - 4).cast("double")
    seg = p.select(k.alias("seg"), (k % 5).alias("tile"), F.col("x").alias("ax"), (F.col("y") / 8).alias("ay"), (F.col("x") + 12 * F.cos(F.radians(turn))).alias("bx"), (F.col("y") / 8 + 12 * F.sin(F.radians(turn))).alias("by"), turn.alias("angle"))
    found = spatial.link_candidates(seg)
    return found.select("a", "b", F.round("gap", 3).alias("gap"), F.round("off", 3).alias("off"))


ORACLE["q84_link_rules"] = f"""WITH {_PTS}, s AS (SELECT c_custkey AS k, c_custkey % 5 AS tile, x AS ax, y / 8 AS ay, CAST(c_custkey % 9 - 4 AS DOUBLE) AS angle, x + 12 * cos(radians(c_custkey % 9 - 4)) AS bx, y / 8 + 12 * sin(radians(c_custkey % 9 - 4)) AS by_ FROM pt),
j AS (SELECT a.k AS a, b.k AS b, a.angle AS t, abs(a.angle - b.angle) AS turn, (b.ax - a.bx) * cos(radians(a.angle)) + (b.ay - a.by_) * sin(radians(a.angle)) AS gap, abs((b.ay - a.by_) * cos(radians(a.angle)) - (b.ax - a.bx) * sin(radians(a.angle))) AS off, sqrt((b.ax - a.bx) * (b.ax - a.bx) + (b.ay - a.by_) * (b.ay - a.by_)) AS d FROM s a JOIN s b ON a.tile <> b.tile AND abs(b.ax - a.bx) <= 62 AND abs(b.ay - a.by_) <= 62)
SELECT a, b, round(gap, 3) AS gap, round(off, 3) AS off FROM j WHERE turn <= CASE WHEN d < 1.5 THEN 12 ELSE 6 END AND gap BETWEEN -2 AND 60 AND off <= 0.5 + 0.02 * greatest(gap, 0)"""

QUERIES = {k: f for k, f in globals().items() if k[0] == "q" and k[1:3].isdigit()}
