"""Queries on filters, chained rules, votes of windows, neighbouring rows, registers, parcels and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.functions import geometry as G
from terrane.functions import scalars as S
from terrane.operators import compliance, intervals, reports, selection, spatial, union_area, versions
from terrane.plans.queries_spatial import _BOXES, _PTS, _points, _sites, _strips
from terrane.plans.survey import CTE, MERGED, ROW_LENGTH, survey, table

ORACLE: dict[str, str] = {}


def q47_scalar_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capped shares, grades in both directions, cover classes, detected status and what a visit is worth."""
    p = table(spark, sf_dir, "part")
    size, key = F.col("p_size"), F.col("p_partkey")
    share, kind = size / 50, F.when(key % 7 == 0, "waste").otherwise("gap")
    return p.select(
        "p_partkey", F.round(S.capped_share(size, key % 40), 6).alias("capped"), S.grade(share, 0.8, 0.4).alias("up"), S.grade(share, 0.2, 0.6, False).alias("down"), S.cover_class(share).alias("cover"),
        S.detected_status(share, F.lit(5.0), F.lit(0.7), (key % 10) / 10).alias("detected"), S.target_value(kind, F.when(key % 3 > 0, size / 5)).alias("worth"),
    )


ORACLE["q47_scalar_rules"] = """WITH p AS (SELECT p_partkey, p_size, p_size / 50.0 AS s FROM part) SELECT p_partkey, round(CAST(CASE WHEN p_partkey % 40 = 0 THEN 0 ELSE least(p_size / CAST(p_partkey % 40 AS DOUBLE), 1) END AS DOUBLE), 6) AS capped, CASE WHEN p_size >= 40 THEN 'PASS' WHEN p_size >= 20 THEN 'WARN' ELSE 'FAIL' END AS up,
CASE WHEN p_size <= 10 THEN 'PASS' WHEN p_size <= 30 THEN 'WARN' ELSE 'FAIL' END AS down, CASE WHEN p_size * 4 < 50 THEN 'bare_soil' WHEN p_size * 4 > 150 THEN 'vegetation' ELSE 'mixed' END AS cover, CASE WHEN p_size < 25 THEN 'no_vines' WHEN p_partkey % 10 > 4 THEN 'abandoned' ELSE 'planted' END AS detected,
CAST(CASE WHEN p_partkey % 7 = 0 THEN 10 WHEN p_partkey % 3 > 0 AND p_size >= 25 THEN 3 ELSE 1 END AS DOUBLE) AS worth FROM p"""


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    kind = F.when(k % 5 == 0, "waste").when(k % 5 == 1, "entry").otherwise("gap")
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", kind.alias("type"), F.when(k % 3 == 0, k % 2 == 0).alias("reachable"), F.when(k % 4 > 0, (k * 13 % 97) / 10).alias("gap_m"))


_TARGETS_SQL = "t AS (SELECT c_custkey, c_nationkey, CASE c_custkey % 5 WHEN 0 THEN 'waste' WHEN 1 THEN 'entry' ELSE 'gap' END AS type, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 2 = 0 END AS reachable, CASE WHEN c_custkey % 4 > 0 THEN (c_custkey * 13 % 97) / 10.0::DOUBLE END AS gap_m FROM customer)"


def q48_target_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that are wanted and in reach, ranked in each nation: waste first, then by falling gap."""
    kept = selection.targets(_targets(spark, sf_dir), ["waste", "gap"], 3.0)
    order = Window.partitionBy("c_nationkey").orderBy(F.when(F.col("type") == "waste", 0).otherwise(1), F.desc_nulls_last("gap_m"), "c_custkey")
    return kept.select("c_nationkey", "c_custkey", "type", "gap_m", F.row_number().over(order).alias("place"))


ORACLE["q48_target_selection"] = f"WITH {_TARGETS_SQL} SELECT c_nationkey, c_custkey, type, gap_m, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN type = 'waste' THEN 0 ELSE 1 END, gap_m DESC NULLS LAST, c_custkey) AS place FROM t WHERE type IN ('waste', 'gap') AND coalesce(reachable, true) AND (type = 'waste' OR coalesce(gap_m, 0) >= 3)"


def q49_garden_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of three rows or more whose rows have two objects or more, after three passes."""
    objects = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws("-", F.col("l_suppkey") % 97, F.col("l_partkey") % 89).alias("block"), F.concat_ws("-", F.col("l_orderkey") % 211, F.col("l_partkey") % 53).alias("row"))
    kept = selection.garden_rule(objects, "block", "row", 5, 3)
    return kept.groupBy("block").agg(F.count(F.lit(1)).alias("objects"), F.countDistinct("row").alias("n_rows"))


_PASS = "r{n} AS (SELECT * FROM b{m} WHERE u IN (SELECT u FROM b{m} GROUP BY u HAVING count(*) >= 3)), b{n} AS (SELECT * FROM r{n} WHERE block IN (SELECT block FROM r{n} GROUP BY block HAVING count(DISTINCT u) >= 5))"
ORACLE["q49_garden_rule"] = f"WITH b0 AS (SELECT (l_suppkey % 97) || '-' || (l_partkey % 89) AS block, (l_orderkey % 211) || '-' || (l_partkey % 53) AS u FROM lineitem), {', '.join(_PASS.format(n=n, m=n - 1) for n in (1, 2, 3))} SELECT block, count(*) AS objects, count(DISTINCT u) AS n_rows FROM b3 GROUP BY block"


def _zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes on a grid, one a site, that don't overlap."""
    k = F.col("s_suppkey")
    x, y = (k % 25 * 40).cast("double"), (F.floor(k / 25) * 40).cast("double")
    return table(spark, sf_dir, "supplier").select(x.alias("zx0"), y.alias("zy0"), (x + 24).alias("zx1"), (y + 26).alias("zy1"))


_ZONES_SQL = """zone AS (SELECT s_suppkey % 25 * 40.0 AS zx0, s_suppkey // 25 * 40.0 AS zy0, s_suppkey % 25 * 40.0 + 24 AS zx1, s_suppkey // 25 * 40.0 + 26 AS zy1 FROM supplier),
strip AS (SELECT c_custkey, x AS tx0, y AS ty0, x + 20 + c_custkey % 40 AS tx1, y + 2 + c_custkey % 3 AS ty1 FROM pt),
share AS (SELECT c_custkey, sum(greatest(least(tx1, zx1) - greatest(tx0, zx0), 0) * greatest(least(ty1, zy1) - greatest(ty0, zy0), 0) / ((tx1 - tx0) * (ty1 - ty0))) AS inside FROM strip JOIN zone ON tx0 <= zx1 AND zx0 <= tx1 AND ty0 <= zy1 AND zy0 <= ty1 GROUP BY c_custkey)"""
_STRIP, _ZONE = ("tx0", "ty0", "tx1", "ty1"), ("zx0", "zy0", "zx1", "zy1")


def _inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.inside_share(_strips(spark, sf_dir), _zones(spark, sf_dir), "c_custkey", _STRIP, _ZONE, 40.0)


def q50_forbidden_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects mostly outside forbidden boxes; tiles that are left with fewer than three rows go whole."""
    objects = _strips(spark, sf_dir).withColumn("tile", F.floor(F.col("c_custkey") / 6))
    kept = selection.drop_forbidden(objects, _inside(spark, sf_dir), "tile", "c_custkey", F.col("c_custkey") % 5 < 3)
    return kept.groupBy("tile").agg(F.count(F.lit(1)).alias("objects"), F.sum("c_custkey").alias("keys"))


ORACLE["q50_forbidden_tiles"] = f"""WITH {_PTS}, {_ZONES_SQL}, o AS (SELECT c_custkey, c_custkey // 6 AS tile, inside, c_custkey % 5 < 3 AS is_row, max(CASE WHEN inside IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY c_custkey // 6) AS touched FROM strip LEFT JOIN share USING (c_custkey)),
k AS (SELECT *, sum(CASE WHEN is_row THEN 1 ELSE 0 END) OVER (PARTITION BY tile) AS n FROM o WHERE coalesce(inside, 0) <= 0.5) SELECT tile, count(*) AS objects, CAST(sum(c_custkey) AS BIGINT) AS keys FROM k WHERE touched = 0 OR n >= 3 GROUP BY tile"""


def q51_waste_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs that pass the chain of rules, with their score."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    blobs = table(spark, sf_dir, "lineitem").select(
        k.alias("blob"), n.alias("part"), F.when(k % 3 == 0, "dark").otherwise("white").alias("kind"), (F.col("l_quantity") / 10).alias("area_m2"), (0.4 + k % 64 / 100).alias("solidity"), (1 + F.col("l_partkey") % 32 / 8).alias("aspect"), (30 + F.col("l_suppkey") % 90).cast("double").alias("contrast"),
        F.when(n != 2, F.col("l_partkey") % 16 / 8).alias("axis_m"), (k % 11 == 4).alias("forbidden"), (k % 13 != 5).alias("near_block"), (n % 3 == 0).alias("on_passage"),
    )
    return selection.waste_candidates(blobs).select("blob", "part", "kind", F.round("score", 6).alias("score"))


ORACLE["q51_waste_candidates"] = """WITH b AS (SELECT l_orderkey AS blob, l_linenumber AS part, CASE WHEN l_orderkey % 3 = 0 THEN 'dark' ELSE 'white' END AS kind, l_quantity / 10 AS a, 0.4::DOUBLE + l_orderkey % 64 / 100::DOUBLE AS s, 1 + l_partkey % 32 / 8::DOUBLE AS aspect, 30 + l_suppkey % 90 AS c,
CASE WHEN l_linenumber <> 2 THEN l_partkey % 16 / 8::DOUBLE END AS axis, l_orderkey % 11 = 4 AS forb, l_orderkey % 13 <> 5 AS near, l_linenumber % 3 = 0 AS pas FROM lineitem)
SELECT blob, part, kind, round(least(c / 55::DOUBLE, 2) * least(s / 0.6::DOUBLE, 1.5) * CASE WHEN a BETWEEN 0.1 AND 2 THEN 1 ELSE 0.7 END * CASE WHEN kind <> 'dark' THEN 1 WHEN aspect < 1.6 THEN 0.8 ELSE 0.4 END, 6) AS score FROM b
WHERE a BETWEEN 0.05 AND 4 AND s >= 0.6::DOUBLE AND aspect <= 3.5 AND c >= 55 AND coalesce(axis, 1e9) >= 0.5 AND NOT forb AND near AND NOT (pas AND kind = 'white')"""


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.select((F.col("l_orderkey") % 499).alias("tile"), F.col("l_linenumber").alias("window"), (F.col("l_partkey") * 37 % 512 / 8).alias("off"), F.col("l_quantity").alias("len"), F.col("l_orderkey").alias("piece")).where("piece % 5 = 0")


_VOTES_SQL = """p AS (SELECT l_orderkey % 499 AS tile, l_linenumber AS win, l_partkey * 37 % 512 / 8::DOUBLE AS off, l_quantity AS len FROM lineitem WHERE l_orderkey % 5 = 0),
g AS (SELECT *, CASE WHEN off - lag(off) OVER (PARTITION BY tile ORDER BY off, win) <= 0.25 THEN 0 ELSE 1 END AS new FROM p), i AS (SELECT *, sum(new) OVER (PARTITION BY tile ORDER BY off, win ROWS UNBOUNDED PRECEDING) AS no FROM g),
v AS (SELECT tile, no, sum(off * len) / sum(len) AS off, count(DISTINCT win) AS windows FROM i GROUP BY tile, no), k AS (SELECT * FROM (SELECT *, max(windows) OVER (PARTITION BY tile) AS most FROM v WHERE windows >= 2) WHERE most >= 3)"""


def q52_window_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that two windows found or more, of tiles where three found one."""
    votes = selection.window_votes(_pieces(spark, sf_dir), "tile", "window", "off", "len", 0.25)
    return selection.consensus(votes, "tile").select("tile", F.round("offset", 4).alias("offset"), "windows")


ORACLE["q52_window_consensus"] = f"WITH {_VOTES_SQL} SELECT tile, round(off, 4) AS offset, windows FROM k".replace(" AS offset", ' AS "offset"')


def q53_weak_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of these, the rows that a chain of neighbours ties to one that three windows found."""
    rows = selection.consensus(selection.window_votes(_pieces(spark, sf_dir), "tile", "window", "off", "len", 0.25), "tile")
    kept = selection.grow_from_strong(rows, "tile", "offset", F.col("windows") >= 3, 2.6)
    return kept.groupBy("tile").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("windows").alias("votes"))


ORACLE["q53_weak_growth"] = f"""WITH {_VOTES_SQL}, c AS (SELECT *, CASE WHEN off - lag(off) OVER (PARTITION BY tile ORDER BY off, no) <= 2.6 THEN 0 ELSE 1 END AS nw FROM k), d AS (SELECT *, sum(nw) OVER (PARTITION BY tile ORDER BY off, no ROWS UNBOUNDED PRECEDING) AS chain FROM c),
e AS (SELECT *, max(windows) OVER (PARTITION BY tile, chain) AS best FROM d) SELECT tile, count(*) AS n_rows, CAST(sum(windows) AS BIGINT) AS votes FROM e WHERE best >= 3 GROUP BY tile"""


def q54_row_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How clearly rows stand out in each tile, worst first, with its place."""
    samples = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("tile"), F.col("l_quantity").alias("length"), (F.col("l_discount") * 8).alias("on_row"), (F.col("l_tax") * 5).alias("mid_row"))
    out = selection.row_support(samples, "tile")
    return out.select("tile", "n_rows", F.round("support", 4).alias("support"), F.round("weak_share", 4).alias("weak_share"), F.round("on_mean", 4).alias("on_mean"), F.round("length_m", 1).alias("length_m"))


ORACLE["q54_row_support"] = """WITH s AS (SELECT l_suppkey AS tile, l_quantity AS w, l_discount * 8 AS a, l_tax * 5 AS m FROM lineitem), g AS (SELECT tile, count(*) AS n_rows, sum(a * w) / sum(w) AS on_mean, sum(m * w) / sum(w) AS mid, avg(CASE WHEN a / greatest(m, 0.02) < 1.3 OR a - m < 0.08 THEN 1.0 ELSE 0.0 END) AS weak, sum(w) AS len FROM s GROUP BY tile)
SELECT tile, n_rows, round(on_mean / greatest(mid, 0.02), 4) AS support, round(CAST(weak AS DOUBLE), 4) AS weak_share, round(on_mean, 4) AS on_mean, round(len, 1) AS length_m FROM g"""


def q55_register_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each grower's last record, its variety looked up in a small dimension, and the state of the application."""
    records = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority", F.round("o_totalprice", 0).cast("long").alias("amount"))
    last = compliance.last_record(records, "o_custkey", "o_orderkey")
    varieties = spark.createDataFrame([("1-URGENT", 300), ("2-HIGH", 250), ("3-MEDIUM", 200), ("5-LOW", 100)], "o_orderpriority string, rate int")
    joined = table(spark, sf_dir, "customer").select("c_custkey").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").join(varieties, "o_orderpriority", "left")
    status = F.when(F.col("o_orderstatus") == "F", "noncompliant").when(F.col("o_orderstatus") == "P", "review").otherwise("compliant")
    eligible = F.when((F.col("o_orderstatus") == "O") & (F.col("c_custkey") % 4 > 0), F.col("amount") - F.col("c_custkey") % 2)
    state = S.application_state(status, eligible, F.col("amount"))
    check = F.when(F.col("amount").isNull(), "info").when(F.col("rate").isNull(), "warn").otherwise("pass")
    return joined.select("c_custkey", F.col("o_orderkey").alias("record"), check.alias("variety_check"), F.coalesce("rate", F.lit(0)).alias("rate"), state["stage"].alias("stage"), state["decision"].alias("decision"))


ORACLE["q55_register_chain"] = """WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1), v(p, rate) AS (VALUES ('1-URGENT', 300), ('2-HIGH', 250), ('3-MEDIUM', 200), ('5-LOW', 100)),
j AS (SELECT c_custkey, o_orderkey, o_orderstatus AS s, rate, CAST(round(o_totalprice, 0) AS BIGINT) AS amount, CASE WHEN o_orderstatus = 'O' AND c_custkey % 4 > 0 THEN CAST(round(o_totalprice, 0) AS BIGINT) - c_custkey % 2 END AS e FROM customer LEFT JOIN l ON o_custkey = c_custkey LEFT JOIN v ON p = o_orderpriority)
SELECT c_custkey, o_orderkey AS record, CASE WHEN amount IS NULL THEN 'info' WHEN rate IS NULL THEN 'warn' ELSE 'pass' END AS variety_check, coalesce(rate, 0) AS rate, CASE WHEN e < amount THEN 'decision' WHEN e IS NOT NULL THEN 'payment' WHEN s = 'F' THEN 'evaluation' WHEN s = 'P' THEN 'field check' ELSE 'administrative check' END AS stage,
CASE WHEN e < amount THEN 'compliant' WHEN e IS NOT NULL THEN 'approved' END AS decision FROM j"""


def q56_grower_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations, their growers and these growers' parcels: counts, sums and sorted lists, down a chain of 1:n joins."""
    parcels = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("parcels"), F.array_join(F.transform(F.array_sort(F.collect_set("o_orderstatus")), lambda s: s), "").alias("statuses"))
    growers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(parcels, "c_custkey", "left").fillna({"parcels": 0, "statuses": "-"})
    per = growers.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("growers"), F.sum("parcels").alias("parcels"), F.count_if(F.col("parcels") == 0).alias("without"), F.array_join(F.array_sort(F.collect_set("statuses")), " ").alias("kinds"))
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name").join(per, "n_nationkey", "left").fillna(0)


ORACLE["q56_grower_lists"] = """WITH p AS (SELECT o_custkey, count(*) AS parcels, string_agg(DISTINCT o_orderstatus, '' ORDER BY o_orderstatus) AS st FROM orders GROUP BY 1), g AS (SELECT c_custkey, c_nationkey, coalesce(parcels, 0) AS parcels, coalesce(st, '-') AS st FROM customer LEFT JOIN p ON o_custkey = c_custkey),
n AS (SELECT c_nationkey, count(*) AS growers, CAST(sum(parcels) AS BIGINT) AS parcels, count(CASE WHEN parcels = 0 THEN 1 END) AS without, string_agg(DISTINCT st, ' ' ORDER BY st) AS kinds FROM g GROUP BY 1)
SELECT n_nationkey, n_name, coalesce(growers, 0) AS growers, coalesce(parcels, 0) AS parcels, coalesce("without", 0) AS without, kinds FROM nation LEFT JOIN n ON c_nationkey = n_nationkey""".replace("AS without", 'AS "without"')


def q57_parcel_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each parcel (boxes on a grid): gaps that lie in it, strip area by cover class, and how many rows run 2 m or more in it."""
    zones = _zones(spark, sf_dir).withColumn("parcel", F.concat_ws("/", F.col("zx0").cast("int"), F.col("zy0").cast("int")))
    points = _points(spark, sf_dir).select("c_custkey", "x", "y", F.col("x").alias("x2"), F.col("y").alias("y2"))
    gaps = spatial.box_join(points, zones, 40.0, ("x", "y", "x2", "y2"), _ZONE).groupBy("parcel").agg(F.count(F.lit(1)).alias("gaps"), F.round(F.sum(F.col("c_custkey") % 10 / 4), 2).alias("gap_m"))
    met = spatial.box_join(_strips(spark, sf_dir), zones, 40.0, _STRIP, _ZONE)
    wide = G.overlap(F.col("tx0"), F.col("tx1"), F.col("zx0"), F.col("zx1"))
    shared = wide * G.overlap(F.col("ty0"), F.col("ty1"), F.col("zy0"), F.col("zy1"))
    of = lambda k: F.round(F.sum(F.when(F.col("c_custkey") % 3 == k, shared).otherwise(0.0)), 3)
    cover = met.groupBy("parcel").agg(of(0).alias("bare"), of(1).alias("mixed"), of(2).alias("green"), F.countDistinct(F.when((wide >= 2) & (shared > 0), F.col("c_custkey"))).alias("n_rows"))
    return zones.select("parcel").join(gaps, "parcel", "left").join(cover, "parcel", "left").fillna(0)


ORACLE["q57_parcel_measures"] = f"""WITH {_PTS}, {_ZONES_SQL}, z AS (SELECT *, CAST(zx0 AS INTEGER) || '/' || CAST(zy0 AS INTEGER) AS parcel FROM zone), g AS (SELECT parcel, count(*) AS gaps, round(sum(c_custkey % 10 / 4::DOUBLE), 2) AS gap_m FROM pt JOIN z ON x BETWEEN zx0 AND zx1 AND y BETWEEN zy0 AND zy1 GROUP BY parcel),
m AS (SELECT parcel, c_custkey, greatest(least(tx1, zx1) - greatest(tx0, zx0), 0) AS w, greatest(least(ty1, zy1) - greatest(ty0, zy0), 0) AS h FROM strip JOIN z ON tx0 <= zx1 AND zx0 <= tx1 AND ty0 <= zy1 AND zy0 <= ty1),
c AS (SELECT parcel, round(CAST(sum(CASE WHEN c_custkey % 3 = 0 THEN w * h ELSE 0 END) AS DOUBLE), 3) AS bare, round(CAST(sum(CASE WHEN c_custkey % 3 = 1 THEN w * h ELSE 0 END) AS DOUBLE), 3) AS mixed, round(CAST(sum(CASE WHEN c_custkey % 3 = 2 THEN w * h ELSE 0 END) AS DOUBLE), 3) AS green, count(DISTINCT CASE WHEN w >= 2 AND w * h > 0 THEN c_custkey END) AS n_rows FROM m GROUP BY parcel)
SELECT parcel, coalesce(gaps, 0) AS gaps, coalesce(gap_m, 0) AS gap_m, coalesce(bare, 0) AS bare, coalesce(mixed, 0) AS mixed, coalesce(green, 0) AS green, coalesce(n_rows, 0) AS n_rows FROM z LEFT JOIN g USING (parcel) LEFT JOIN c USING (parcel)"""


def q58_unexplained_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strips four fifths or more of which lie outside what is known."""
    return selection.unexplained(_strips(spark, sf_dir), _inside(spark, sf_dir), "c_custkey").select("c_custkey", "tx0", "ty0")


ORACLE["q58_unexplained_rows"] = f"WITH {_PTS}, {_ZONES_SQL} SELECT c_custkey, tx0, ty0 FROM strip LEFT JOIN share USING (c_custkey) WHERE coalesce(inside, 0) <= 0.2"


def q59_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register numbers that a block names but no parcel has, by block; cached results that are still valid and those to be made again."""
    named = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("block"), (F.col("l_partkey") * 3 % 2503).alias("number")).distinct()
    known = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("number")).distinct()
    missing = named.join(known, "number", "left_anti").groupBy("block").agg(F.count(F.lit(1)).alias("missing"))
    # A cached result holds as long as the digest of what it was made from does.
    digest = F.md5(F.concat_ws("|", "s_name", F.col("s_nationkey").cast("string")).cast("binary"))
    now = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("block"), digest.alias("key"))
    cache = now.where("block % 4 <> 1").select("block", F.when(F.col("block") % 7 == 0, "stale").otherwise(F.col("key")).alias("key"))
    kept = now.join(cache, ["block", "key"], "left_semi").select("block", F.lit(True).alias("cached"))
    out = now.join(missing, "block", "left").join(kept, "block", "left")
    return out.select("block", F.coalesce("missing", F.lit(0)).alias("missing"), (F.coalesce("missing", F.lit(0)) == 0).alias("contained"), F.coalesce("cached", F.lit(False)).alias("cached"))


ORACLE["q59_containment"] = """WITH m AS (SELECT l_suppkey AS block, count(DISTINCT l_partkey * 3 % 2503) AS missing FROM lineitem WHERE l_partkey * 3 % 2503 NOT IN (SELECT p_partkey FROM part) GROUP BY 1)
SELECT s_suppkey AS block, coalesce(missing, 0) AS missing, coalesce(missing, 0) = 0 AS contained, s_suppkey % 4 <> 1 AND s_suppkey % 7 <> 0 AS cached FROM supplier LEFT JOIN m ON block = s_suppkey"""


def q60_disrupted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each block the disrupted rows in order, and a summary of its layer: rows, pieces and the three longest."""
    merged = intervals.merge(survey(spark, sf_dir), ["vineyard_id", "row_id"])
    rows = reports.row_structure(survey(spark, sf_dir), ["vineyard_id", "row_id"], ROW_LENGTH)
    listed = rows.groupBy("vineyard_id").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("structure") == "disrupted", F.col("row_id")))), 1, 20), lambda r: r.cast("string")), " ").alias("disrupted"), F.count(F.lit(1)).alias("n_rows"))
    longest = F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.round(F.col("hi") - F.col("lo"), 3)).alias("l"), "row_id", "lo"))), 1, 3), lambda s: s["row_id"].cast("string")), " ")
    return listed.join(merged.groupBy("vineyard_id").agg(F.sum("n").alias("pieces"), longest.alias("longest")), "vineyard_id")


ORACLE["q60_disrupted_rows"] = f"""WITH {MERGED}, d AS (SELECT vineyard_id, row_id, longest_gap > 5.5 AS bad, row_number() OVER (PARTITION BY vineyard_id, longest_gap > 5.5 ORDER BY row_id) AS r FROM longest), l AS (SELECT vineyard_id, coalesce(string_agg(CASE WHEN bad AND r <= 20 THEN CAST(row_id AS VARCHAR) END, ' ' ORDER BY row_id), '') AS disrupted, count(*) AS n_rows FROM d GROUP BY 1),
t AS (SELECT *, row_number() OVER (PARTITION BY vineyard_id ORDER BY -round(hi - lo, 3), row_id, lo) AS r FROM merged), s AS (SELECT vineyard_id, CAST(sum(n) AS BIGINT) AS pieces, string_agg(CASE WHEN r <= 3 THEN CAST(row_id AS VARCHAR) END, ' ' ORDER BY r) AS longest FROM t GROUP BY 1) SELECT vineyard_id, disrupted, n_rows, pieces, longest FROM l JOIN s USING (vineyard_id)"""


def q61_pair_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two objects that belong together do so in both versions: share over the pairs of every k-th match, about 150 of them."""
    matched = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 5).alias("a"), F.when(F.col("p_partkey") % 9 == 0, F.col("p_size") % 3).otherwise(F.col("p_size") % 5).alias("b"))
    numbered = reports.every_kth(matched, "p_partkey", 150)
    return reports.pair_consistency(numbered, "p_partkey", "a", "b").select("pairs", F.round("consistent", 6).alias("consistent"))


ORACLE["q61_pair_consistency"] = """WITH m AS (SELECT p_partkey, p_size % 5 AS a, CASE WHEN p_partkey % 9 = 0 THEN p_size % 3 ELSE p_size % 5 END AS b, row_number() OVER (ORDER BY p_partkey) - 1 AS r, count(*) OVER () AS n FROM part), s AS (SELECT * FROM m WHERE r % greatest(1, n // 150) = 0)
SELECT count(*) AS pairs, round(avg(CASE WHEN (x.a = y.a) = (x.b = y.b) THEN 1.0 ELSE 0.0 END), 6) AS consistent FROM s x JOIN s y ON x.p_partkey < y.p_partkey"""


def q62_vine_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tiles that have three good ones side by side, clear trees left out."""
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 997).alias("tile"), F.col("o_orderkey").alias("row"), (F.col("o_orderkey") % 1024 / 4).alias("off"), (F.col("o_orderkey") % 7 > 2).alias("ok"), (F.col("o_orderkey") % 17 == 1).alias("tree"))
    return selection.vine_rows(rows, "tile", "row", "off", F.col("ok"), 12.0, 3, F.col("tree")).groupBy("tile").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("row").alias("keys"))


ORACLE["q62_vine_rows"] = """WITH r AS (SELECT o_custkey % 997 AS tile, o_orderkey AS k, o_orderkey % 1024 / 4::DOUBLE AS off, o_orderkey % 7 > 2 AS ok, o_orderkey % 17 = 1 AS tree FROM orders), n AS (SELECT *, CASE WHEN ok AND lag(ok) OVER w AND off - lag(off) OVER w <= 12 THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY tile ORDER BY off, k)),
i AS (SELECT *, sum(new) OVER (PARTITION BY tile ORDER BY off, k ROWS UNBOUNDED PRECEDING) AS run FROM n), s AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY tile, run) AS size FROM i), m AS (SELECT *, max(size) OVER (PARTITION BY tile) AS most FROM s) SELECT tile, count(*) AS n_rows, CAST(sum(k) AS BIGINT) AS keys FROM m WHERE most >= 3 AND NOT tree GROUP BY tile"""


def q63_strips_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strips between neighbouring rows of a block, with their area."""
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 61).alias("block"), F.col("p_partkey").alias("row"), (F.col("p_partkey") * 7 % 4096 / 16).alias("off"), (F.col("p_size") % 8).cast("double").alias("lo"), (F.col("p_size") % 8 + F.col("p_partkey") % 9).cast("double").alias("hi"))
    return selection.strips_between(rows, "block", "row", "off", "lo", "hi", 4.0, 0.25).select("block", "row_a", "row_b", F.round("width", 4).alias("width"), F.round("area", 4).alias("area"))


ORACLE["q63_strips_between"] = """WITH r AS (SELECT p_partkey % 61 AS block, p_partkey AS k, p_partkey * 7 % 4096 / 16::DOUBLE AS off, CAST(p_size % 8 AS DOUBLE) AS lo, CAST(p_size % 8 + p_partkey % 9 AS DOUBLE) AS hi FROM part), p AS (SELECT block, k AS row_a, lead(k) OVER w AS row_b, lead(off) OVER w - off AS d, greatest(lo, lead(lo) OVER w) AS lo, least(hi, lead(hi) OVER w) AS hi, lead(k) OVER w AS nx FROM r WINDOW w AS (PARTITION BY block ORDER BY off, k))
SELECT block, row_a, row_b, round(d - 0.5, 4) AS width, round((d - 0.5) * (hi - lo), 4) AS area FROM p WHERE nx IS NOT NULL AND d BETWEEN 0.6 * 4 AND 1.6 * 4 AND hi - lo >= 1"""


def q64_visit_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of visited stops by nation; the complement of covered stretches and the first three bad stops are queries of their own."""
    stops = _targets(spark, sf_dir).withColumn("ord", F.col("c_custkey") % 23)
    return selection.ranked_visits(stops, "c_nationkey", "ord", "c_custkey").select("c_nationkey", "c_custkey", "rank")


ORACLE["q64_visit_ranks"] = "SELECT c_nationkey, c_custkey, CASE WHEN c_custkey % 23 > 0 THEN row_number() OVER (PARTITION BY c_nationkey, c_custkey % 23 > 0 ORDER BY c_custkey % 23, c_custkey) END AS rank FROM customer"


def q65_interval_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What canopies leave of each row, in pieces above a metre."""
    out = intervals.complement(survey(spark, sf_dir), ["vineyard_id", "row_id"], F.lit(0.0), F.lit(ROW_LENGTH), 1.0)
    return out.groupBy("vineyard_id").agg(F.count(F.lit(1)).alias("pieces"), F.round(F.sum(F.col("hi") - F.col("lo")), 2).alias("length_m"))


ORACLE["q65_interval_complement"] = f"""WITH {MERGED}, c AS (SELECT vineyard_id, row_id, hi AS a, coalesce(next, 56.0) AS b FROM spaced UNION ALL SELECT vineyard_id, row_id, 0.0, min(lo) FROM merged GROUP BY vineyard_id, row_id) SELECT vineyard_id, count(*) AS pieces, round(sum(b - a), 2) AS length_m FROM c WHERE b - a > 1 GROUP BY vineyard_id"""


def q66_first_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a user's events are bad three times in a row for the first time."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return intervals.first_failure(events, ["user_id"], "event_id", F.col("value") < 40, 3)


ORACLE["q66_first_failure"] = "WITH c AS (SELECT user_id, event_id, sum(CASE WHEN value < 40 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM events) SELECT user_id, min(event_id) AS failed_at FROM c WHERE n = 3 GROUP BY user_id"


def q67_general_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strips against L-shaped blocks, which aren't convex: area in common and what is left of the strip."""
    s = _sites(spark, sf_dir)
    c = lambda dx, dy: G.point(F.col("sx") + dx, F.col("sy") + dy)
    shapes = s.select("s_suppkey", G.line(c(0, 0), c(40, 0), c(40, 12), c(15, 12), c(15, 45), c(0, 45)).alias("shape"), F.col("sx").alias("bx0"), F.col("sy").alias("by0"), (F.col("sx") + 40).alias("bx1"), (F.col("sy") + 45).alias("by1"))
    met = spatial.box_join(_strips(spark, sf_dir), shapes, 50.0, _STRIP, ("bx0", "by0", "bx1", "by1"))
    pairs = met.select("c_custkey", "s_suppkey", G.box(*map(F.col, _STRIP)).alias("strip"), "shape")
    found = union_area.shared_areas(pairs, "strip", "shape").where("shared > 1e-6")
    return found.select("c_custkey", "s_suppkey", F.round("shared", 4).alias("shared"), F.round("apart", 4).alias("apart"))


ORACLE["q67_general_intersection"] = f"""WITH {_PTS}, {_BOXES}, a AS (SELECT c_custkey, s_suppkey, tx0, ty0, tx1, ty1, greatest(least(tx1, sx + 40) - greatest(tx0, sx), 0) * greatest(least(ty1, sy + 12) - greatest(ty0, sy), 0) + greatest(least(tx1, sx + 15) - greatest(tx0, sx), 0) * greatest(least(ty1, sy + 45) - greatest(ty0, sy + 12), 0) AS shared FROM strip JOIN site ON tx0 <= sx + 40 AND sx <= tx1 AND ty0 <= sy + 45 AND sy <= ty1)
SELECT c_custkey, s_suppkey, round(CAST(shared AS DOUBLE), 4) AS shared, round(CAST((tx1 - tx0) * (ty1 - ty0) - shared AS DOUBLE), 4) AS apart FROM a WHERE shared > 1e-6"""


def q68_voronoi_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points by the nearest of their nation's centres, without a bound, and how many and how far each cell has."""
    points = _points(spark, sf_dir).join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    centres = _sites(spark, sf_dir).select(F.col("s_nationkey").alias("c_nationkey"), "s_suppkey", "sx", "sy")
    cells = spatial.cells_of_centres(points, centres, "c_nationkey", "c_custkey", ("x", "y"), "s_suppkey", ("sx", "sy"))
    return cells.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("points"), F.round(F.max("dist"), 4).alias("farthest"))


ORACLE["q68_voronoi_cells"] = f"""WITH {_PTS}, d AS (SELECT c_custkey, s_suppkey, sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)) AS d FROM pt JOIN customer USING (c_custkey) JOIN site ON s_nationkey = c_nationkey), r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY d, s_suppkey) AS r FROM d) SELECT s_suppkey, count(*) AS points, round(max(d), 4) AS farthest FROM r WHERE r = 1 GROUP BY s_suppkey"""


def q69_geometry_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions, unit vectors, affine maps, equality within a tolerance, points along a line, and the nearest point of one."""
    k = F.col("c_custkey")
    p = _points(spark, sf_dir)
    a, b = G.point("x", "y"), G.point(F.col("x") + 3 + k % 7, F.col("y") + 4)
    line = G.line(a, b)
    moved = G.affine(line, 0.0, -1.0, 1.0, 0.0, 5.0, 2.0)
    foot = G.nearest_point(line, G.point(F.col("x") + k % 11, F.col("y") + k % 5))
    return p.select(
        "c_custkey", F.round(G.angle_difference((k % 360).cast("double"), F.lit(170.0)), 4).alias("turn"), F.round(G.unit(a, b)["x"], 6).alias("ux"), F.round(moved[0]["x"], 4).alias("mx"), F.round(moved[1]["y"], 4).alias("my"),
        G.equal_within(line, G.line(a, G.point(F.col("x") + 3 + k % 7, F.col("y") + 4 + k % 3 / 4)), 0.3).alias("same"), F.round(G.interpolate(line, F.lit(0.25))["x"], 4).alias("qx"), F.round(foot["x"], 4).alias("fx"), F.round(foot["y"], 4).alias("fy"),
    )


ORACLE["q69_geometry_scalars"] = f"""WITH {_PTS}, v AS (SELECT *, CAST(3 + c_custkey % 7 AS DOUBLE) AS dx, CAST(c_custkey % 11 AS DOUBLE) AS gx, CAST(c_custkey % 5 AS DOUBLE) AS gy, abs(c_custkey % 360 - 170) % 180 AS t FROM pt), f AS (SELECT *, greatest(0, least(1, (gx * dx + gy * 4) / (dx * dx + 16))) AS s FROM v)
SELECT c_custkey, CAST(least(t, 180 - t) AS DOUBLE) AS turn, round(dx / sqrt(dx * dx + 16), 6) AS ux, round(5 - y, 4) AS mx, round(x + dx + 2, 4) AS my, c_custkey % 3 < 2 AS same, round(x + dx / 4, 4) AS qx, round(x + s * dx, 4) AS fx, round(y + s * 4, 4) AS fy FROM f"""


def q70_version_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length that one version of a row has and the other lacks, by block; pieces may stick out by half a metre."""
    rows = survey(spark, sf_dir)
    old = rows.where("seg % 5 <> 2").select("vineyard_id", "row_id", "lo", "hi")
    new = rows.where("seg % 7 <> 3").select("vineyard_id", "row_id", (F.col("lo") + F.col("row_id") % 3 * 0.4).alias("lo"), (F.col("hi") + F.col("row_id") % 3 * 0.4).alias("hi"))
    changed = versions.symmetric_difference(old, new, ["vineyard_id", "row_id"], 0.5)
    return changed.groupBy("vineyard_id").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("old_m"), 2).alias("old_m"), F.round(F.sum("new_m"), 2).alias("new_m"), F.round(F.sum("changed_m"), 2).alias("changed_m"))


def _merged_sql(name: str, source: str) -> str:
    return f"""{name}_a AS (SELECT *, max(hi) OVER (PARTITION BY row_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM ({source})), {name}_i AS (SELECT *, sum(CASE WHEN lo <= e THEN 0 ELSE 1 END) OVER (PARTITION BY row_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM {name}_a),
{name} AS (SELECT row_id, any_value(vineyard_id) AS vineyard_id, sum(b - a) AS m FROM (SELECT row_id, any_value(vineyard_id) AS vineyard_id, min(lo) AS a, max(hi) AS b FROM {name}_i GROUP BY row_id, island) GROUP BY row_id)"""


_OLD, _NEW = "SELECT row_id, vineyard_id, lo, hi FROM survey WHERE seg % 5 <> 2", "SELECT row_id, vineyard_id, lo + row_id % 3 * 0.4::DOUBLE AS lo, hi + row_id % 3 * 0.4::DOUBLE AS hi FROM survey WHERE seg % 7 <> 3"
_WIDE = "SELECT row_id, vineyard_id, lo - 0.5 AS lo, hi + 0.5 AS hi FROM ({})"
ORACLE["q70_version_lengths"] = f"""WITH {CTE}, {_merged_sql("o", _OLD)}, {_merged_sql("n", _NEW)}, {_merged_sql("wn", _WIDE.format(_NEW))}, {_merged_sql("wo", _WIDE.format(_OLD))}, {_merged_sql("g", f"{_OLD} UNION ALL {_WIDE.format(_NEW)}")}, {_merged_sql("c", f"{_NEW} UNION ALL {_WIDE.format(_OLD)}")},
j AS (SELECT coalesce(o.vineyard_id, n.vineyard_id) AS vineyard_id, coalesce(o.m, 0) AS om, coalesce(n.m, 0) AS nm, coalesce(g.m, 0) - coalesce(wn.m, 0) + coalesce(c.m, 0) - coalesce(wo.m, 0) AS d FROM o FULL JOIN n USING (row_id) LEFT JOIN g USING (row_id) LEFT JOIN wn USING (row_id) LEFT JOIN c USING (row_id) LEFT JOIN wo USING (row_id))
SELECT vineyard_id, count(*) AS n_rows, round(sum(om), 2) AS old_m, round(sum(nm), 2) AS new_m, round(sum(d), 2) AS changed_m FROM j GROUP BY vineyard_id"""


def q71_correction_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is to be done about each tile, in the order of the task and the frame."""
    k = F.col("p_partkey")
    tiles = table(spark, sf_dir, "part").select(k.alias("tile"), (k % 12).alias("n_old"), (k * 5 % 9).alias("n_new"), (k % 360).cast("double").alias("d_old"), (k * 3 % 360).cast("double").alias("d_new"), F.when(k % 4 == 0, (k * 7 % 360).cast("double")).alias("d_second"), (F.col("p_size") % 3).alias("task"))
    far = lambda c: G.angle_difference(F.col("d_old"), F.col(c)) > 10
    second = F.col("d_second").isNotNull()
    near_second = F.coalesce(~far("d_second"), F.lit(False))
    action = S.correction(F.col("n_old"), F.col("n_new"), far("d_new") & ~near_second, second, F.coalesce(far("d_second"), F.lit(False)), F.col("tile") % 13 == 0)
    place = F.row_number().over(Window.partitionBy("task").orderBy("tile"))
    return tiles.select("tile", "task", action.alias("action"), place.alias("frame"))


ORACLE["q71_correction_plan"] = """WITH t AS (SELECT p_partkey AS k, p_partkey % 12 AS a, p_partkey * 5 % 9 AS b, p_partkey % 360 AS d, abs(p_partkey % 360 - p_partkey * 3 % 360) % 180 AS m, CASE WHEN p_partkey % 4 = 0 THEN abs(p_partkey % 360 - p_partkey * 7 % 360) % 180 END AS s, p_size % 3 AS task FROM part), f AS (SELECT *, least(m, 180 - m) > 10 AS far, least(s, 180 - s) > 10 AS far2 FROM t)
SELECT k AS tile, task, CASE WHEN a > 0 AND b = 0 THEN CASE WHEN k % 13 = 0 THEN 'check' ELSE 'empty' END WHEN b > 0 AND a = 0 THEN 'add' WHEN a > 0 AND b > 0 THEN CASE WHEN far AND coalesce(far2, true) THEN 'redo' WHEN far2 THEN 'second' WHEN 2 * a >= 3 * b AND a - b >= 5 THEN 'clean' ELSE 'ok' END ELSE 'ok' END AS action, row_number() OVER (PARTITION BY task ORDER BY k) AS frame FROM f"""

QUERIES = {k: f for k, f in globals().items() if k[0] == "q" and k[1:3].isdigit()}
