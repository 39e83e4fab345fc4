"""Queries on intervals, roll-ups, reports, numbering and weighted statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.functions import scalars as S
from terrane.operators import intervals, reports
from terrane.plans.survey import MERGED, ROW_LENGTH, survey, table

KEYS = ["vineyard_id", "row_id"]
MIN_GAP = 3.0
ORACLE: dict[str, str] = {}


def q01_rollup_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = intervals.merge(survey(spark, sf_dir), KEYS).withColumn("length", F.col("hi") - F.col("lo"))
    return reports.rollup_levels(merged, *KEYS, "length")


ORACLE["q01_rollup_levels"] = f"""WITH {MERGED}
SELECT CASE grouping(vineyard_id, row_id) WHEN 3 THEN 'total' WHEN 1 THEN 'block' ELSE 'row' END AS level, coalesce(CAST(vineyard_id AS VARCHAR), '') AS vineyard_id, coalesce(CAST(row_id AS VARCHAR), '') AS row_id, round(sum(hi - lo), 3) AS length_m, count(*) AS segments, count(DISTINCT row_id) AS n_rows
FROM merged GROUP BY GROUPING SETS ((), (vineyard_id), (vineyard_id, row_id))"""


def q02_merged_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge(survey(spark, sf_dir), KEYS).select(*KEYS, F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), "n")


ORACLE["q02_merged_intervals"] = f"WITH {MERGED} SELECT vineyard_id, row_id, round(lo, 4) AS lo, round(hi, 4) AS hi, n FROM merged"


def q03_row_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intervals.gaps(survey(spark, sf_dir), KEYS, MIN_GAP)
    return found.select(*KEYS, *(F.round(c, 3).alias(c) for c in ("gap_lo", "gap_hi", "gap")))


ORACLE["q03_row_gaps"] = f"WITH {MERGED} SELECT vineyard_id, row_id, round(gap_lo, 3) AS gap_lo, round(gap_hi, 3) AS gap_hi, round(gap, 3) AS gap FROM gaps"


def q04_longest_gap_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.row_structure(survey(spark, sf_dir), KEYS, ROW_LENGTH)
    return found.select(*KEYS, F.round("longest_gap", 4).alias("longest_gap"), "structure", S.structure(F.col("longest_gap"), inclusive=True).alias("structure_continued"))


ORACLE["q04_longest_gap_structure"] = f"""WITH {MERGED} SELECT vineyard_id, row_id, round(longest_gap, 4) AS longest_gap, CASE WHEN longest_gap > 5.5 THEN 'disrupted' ELSE 'regular' END AS structure,
CASE WHEN longest_gap >= 5.5 THEN 'disrupted' ELSE 'regular' END AS structure_continued FROM longest"""


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.block_report(survey(spark, sf_dir), ROW_LENGTH, MIN_GAP)


def q05_block_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.ranked_report(_report(spark, sf_dir))


ORACLE["q05_block_report"] = f"""WITH {MERGED} SELECT *, row_number() OVER (ORDER BY CASE status WHEN 'red' THEN 0 WHEN 'yellow' THEN 1 ELSE 2 END, missing_vines DESC, vineyard_id) AS place FROM report"""


def q06_report_summary_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's sums, and how far they are from totals taken over the rows themselves."""
    summary = reports.report_summary(_report(spark, sf_dir))
    merged = intervals.merge(survey(spark, sf_dir), KEYS)
    whole = merged.agg(F.countDistinct("row_id").alias("_rows"), F.sum(F.col("hi") - F.col("lo")).alias("_length"), F.countDistinct("vineyard_id").alias("_blocks"))
    joined = summary.join(whole)  # one row each
    return joined.select(*summary.columns, (F.col("n_rows") - F.col("_rows")).alias("rows_off"), (F.col("blocks") - F.col("_blocks")).alias("blocks_off"), (F.abs(F.col("row_length_m") - F.col("_length")) < 1.0).alias("length_ok"))


ORACLE["q06_report_summary_reconcile"] = f"""WITH {MERGED},
summary AS (SELECT count(*) AS blocks, CAST(sum(n_rows) AS BIGINT) AS n_rows, round(sum(row_length_m), 1) AS row_length_m, CAST(sum(missing_vines) AS BIGINT) AS missing_vines, round(sum(gap_length_m), 1) AS gap_length_m,
 count(CASE WHEN status = 'red' THEN 1 END) AS n_red, count(CASE WHEN status = 'yellow' THEN 1 END) AS n_yellow, count(CASE WHEN status = 'green' THEN 1 END) AS n_green FROM report),
whole AS (SELECT count(DISTINCT row_id) AS r, sum(hi - lo) AS l, count(DISTINCT vineyard_id) AS b FROM merged)
SELECT summary.*, n_rows - r AS rows_off, blocks - b AS blocks_off, abs(row_length_m - l) < 1.0 AS length_ok FROM summary, whole"""


def q07_cover_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area-weighted shares of a class by group, and overall."""
    lines = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_returnflag", F.col("l_quantity").alias("area"))
    classes = ("A", "N", "R")
    sums = lines.groupBy("l_linenumber").pivot("l_returnflag", list(classes)).agg(F.sum("area"))
    whole = sum(F.coalesce(F.col(c), F.lit(0.0)) for c in classes)
    per = sums.select(F.col("l_linenumber").cast("string").alias("grp"), *(F.round(S.share(F.coalesce(F.col(c), F.lit(0.0)), whole), 4).alias(f"share_{c.lower()}") for c in classes), whole.alias("area"))
    total = per.agg(F.lit("TOTAL").alias("grp"), *(F.round(reports.weighted_mean(f"share_{c.lower()}", "area"), 4).alias(f"share_{c.lower()}") for c in classes), F.sum("area").alias("area"))
    return per.unionByName(total)


ORACLE["q07_cover_shares"] = """WITH s AS (SELECT CAST(l_linenumber AS VARCHAR) AS grp, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS a, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS n, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS r, sum(l_quantity) AS area FROM lineitem GROUP BY 1),
per AS (SELECT grp, round(a / area, 4) AS share_a, round(n / area, 4) AS share_n, round(r / area, 4) AS share_r, area FROM s)
SELECT * FROM per UNION ALL SELECT 'TOTAL', round(sum(share_a * area) / sum(area), 4), round(sum(share_n * area) / sum(area), 4), round(sum(share_r * area) / sum(area), 4), sum(area) FROM per"""


def q08_env_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walking kilometres by block: between consecutive stops of a block, there and back from the start, and a detour factor."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", (F.col("o_custkey") % 46).alias("vineyard_id"), (F.col("o_orderkey") % 977).cast("double").alias("x"), (F.col("o_custkey") % 983).cast("double").alias("y"))
    day = orders.withColumn("tour", F.year("o_orderdate"))
    w = Window.partitionBy("tour").orderBy("o_orderdate", "o_orderkey")
    step = F.sqrt((F.col("x") - F.lag("x").over(w)) * (F.col("x") - F.lag("x").over(w)) + (F.col("y") - F.lag("y").over(w)) * (F.col("y") - F.lag("y").over(w)))
    steps = day.withColumn("_in", F.when(F.lag("vineyard_id").over(w) == F.col("vineyard_id"), step).otherwise(0.0)).withColumn("_start", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")))
    out = steps.groupBy("vineyard_id").agg(F.sum("_in").alias("_in"), F.min("_start").alias("_near"), F.count(F.lit(1)).alias("stops"))
    return out.select("vineyard_id", "stops", F.round(F.col("_near"), 3).alias("nearest_m"), F.round(1.3 * (F.col("_in") + 2 * F.col("_near")) / 1000, 3).alias("block_km"))


ORACLE["q08_env_total"] = """WITH o AS (SELECT o_orderkey, o_orderdate, o_custkey % 46 AS vineyard_id, CAST(o_orderkey % 977 AS DOUBLE) AS x, CAST(o_custkey % 983 AS DOUBLE) AS y FROM orders),
s AS (SELECT *, lag(vineyard_id) OVER w AS pv, lag(x) OVER w AS px, lag(y) OVER w AS py FROM o WINDOW w AS (PARTITION BY year(o_orderdate) ORDER BY o_orderdate, o_orderkey)),
g AS (SELECT vineyard_id, sum(CASE WHEN pv = vineyard_id THEN sqrt((x - px) * (x - px) + (y - py) * (y - py)) ELSE 0 END) AS i, min(sqrt(x * x + y * y)) AS near, count(*) AS stops FROM s GROUP BY vineyard_id)
SELECT vineyard_id, stops, round(near, 3) AS nearest_m, round(1.3 * (i + 2 * near) / 1000, 3) AS block_km FROM g"""


def q12_visit_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each block the most valuable stop and the one nearest to the middle, two at most."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 46).alias("vineyard_id"), (F.col("o_orderkey") % 977).alias("x"), (F.col("o_custkey") % 983).alias("y"))
    away = (F.col("x") - 488) * (F.col("x") - 488) + (F.col("y") - 491) * (F.col("y") - 491)
    picked = reports.top_by_group(orders.withColumn("away", away), "vineyard_id", "o_totalprice", "away", "o_orderkey", 2)
    return picked.select("vineyard_id", "o_orderkey", "o_totalprice", "pick")


ORACLE["q12_visit_picks"] = """WITH o AS (SELECT o_orderkey, o_totalprice, o_custkey % 46 AS vineyard_id, (o_orderkey % 977 - 488) * (o_orderkey % 977 - 488) + (o_custkey % 983 - 491) * (o_custkey % 983 - 491) AS away FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY vineyard_id ORDER BY o_totalprice DESC, o_orderkey) AS v, row_number() OVER (PARTITION BY vineyard_id ORDER BY away, o_orderkey) AS d FROM o),
p AS (SELECT *, row_number() OVER (PARTITION BY vineyard_id ORDER BY o_orderkey) AS pick FROM r WHERE v = 1 OR d = 1) SELECT vineyard_id, o_orderkey, o_totalprice, pick FROM p WHERE pick <= 2"""


def q26_circular_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", (F.radians((F.col("l_partkey") % 180).cast("double"))).alias("angle"), F.col("l_quantity").alias("len"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.round(reports.circular_mean("angle", "len"), 6).alias("direction"))


ORACLE["q26_circular_mean"] = """SELECT l_returnflag, l_linestatus, round(atan2(sum(l_quantity * sin(2 * radians(l_partkey % 180))), sum(l_quantity * cos(2 * radians(l_partkey % 180)))) / 2, 6) AS direction FROM lineitem GROUP BY l_returnflag, l_linestatus"""


def q27_weighted_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_shipdate", "l_linenumber", "l_discount", "l_quantity")
    return lines.groupBy("l_linenumber").agg(F.round(reports.weighted_mean("l_discount", "l_quantity"), 8).alias("mean_discount"), *(F.round(F.percentile("l_quantity", p / 100), 6).alias(f"p{p}") for p in (50, 75, 90, 99)))


ORACLE["q27_weighted_stats"] = "SELECT l_linenumber, round(sum(l_discount * l_quantity) / sum(l_quantity), 8) AS mean_discount, " + ", ".join(f"round(quantile_cont(l_quantity, {p / 100}), 6) AS p{p}" for p in (50, 75, 90, 99)) + " FROM lineitem GROUP BY l_linenumber"


def q28_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks numbered from the north-west, rows within blocks, and items by type."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_suppkey") * 37 % 101).cast("double").alias("x"), (F.col("s_suppkey") * 53 % 997).cast("double").alias("y"), F.col("s_acctbal").alias("value"))
    blocks = reports.number_blocks(suppliers, "x", "y", "s_suppkey")
    rows = reports.number_rows(blocks, "s_nationkey", "y", "s_suppkey")
    items = reports.typed_ids(rows.withColumn("kind", F.when(F.col("value") >= 0, "A").otherwise("B")), "kind", [F.desc("value"), "s_suppkey"])
    return items.select("s_suppkey", "block_id", "row_label", "item_id")


ORACLE["q28_numbering"] = """WITH s AS (SELECT s_suppkey, s_nationkey, CAST(s_suppkey * 37 % 101 AS DOUBLE) AS x, CAST(s_suppkey * 53 % 997 AS DOUBLE) AS y, s_acctbal AS value, CASE WHEN s_acctbal >= 0 THEN 'A' ELSE 'B' END AS kind FROM supplier),
n AS (SELECT *, row_number() OVER (ORDER BY -round_even(y / 25, 0), x, s_suppkey) AS b, row_number() OVER (PARTITION BY s_nationkey ORDER BY y DESC, s_suppkey) AS r, row_number() OVER (PARTITION BY kind ORDER BY value DESC, s_suppkey) AS i, greatest(2, length(CAST(count(*) OVER () AS VARCHAR))) AS bw, greatest(2, length(CAST(count(*) OVER (PARTITION BY s_nationkey) AS VARCHAR))) AS rw FROM s)
SELECT s_suppkey, 'V' || lpad(CAST(b AS VARCHAR), CAST(bw AS INTEGER), '0') AS block_id, 'R' || lpad(CAST(r AS VARCHAR), CAST(rw AS INTEGER), '0') AS row_label, kind || lpad(CAST(i AS VARCHAR), CAST(greatest(2, length(CAST(i AS VARCHAR))) AS INTEGER), '0') AS item_id FROM n"""


def q37_tour_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block's stops along its route, cut into five days of equal length."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", (F.col("o_custkey") % 46).alias("vineyard_id"), (F.col("o_totalprice") / 1000).alias("leg"))
    w = Window.partitionBy("vineyard_id").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    along = orders.withColumn("at", F.round(F.sum("leg").over(w), 6)).withColumn("whole", F.max("at").over(Window.partitionBy("vineyard_id")))
    days = reports.route_buckets(along, "at", F.col("whole"), 5)
    return days.groupBy("vineyard_id", "day").agg(F.count(F.lit(1)).alias("stops"), F.round(F.sum("leg"), 5).alias("length"), F.round(S.minutes(F.sum("leg")), 4).alias("minutes"))


ORACLE["q37_tour_buckets"] = """WITH o AS (SELECT o_custkey % 46 AS vineyard_id, o_totalprice / 1000 AS leg, round(sum(o_totalprice / 1000) OVER (PARTITION BY o_custkey % 46 ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 6) AS at_ FROM orders),
m AS (SELECT *, max(at_) OVER (PARTITION BY vineyard_id) AS whole FROM o), d AS (SELECT *, CAST(least(floor(at_ / (whole / 5)), 4) AS INTEGER) + 1 AS day FROM m)
SELECT vineyard_id, day, count(*) AS stops, round(sum(leg), 5) AS length, round(sum(leg) / (4.0 * 1000 / 60), 4) AS minutes FROM d GROUP BY vineyard_id, day"""

QUERIES = {k: f for k, f in globals().items() if k[0] == "q" and k[1:3].isdigit()}
