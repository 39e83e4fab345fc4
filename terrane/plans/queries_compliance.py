"""Queries on bands, registers, checks, mismatches and dirty extracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import geometry as G
from terrane.functions import scalars as S
from terrane.operators import compliance, reports, spatial
from terrane.plans.survey import table
from terrane.sources import registry

ORACLE: dict[str, str] = {}
_BANDS = ", ".join(f"({a}.0, {b}.0, {c})" for a, b, c in compliance.BANDS)
_LEI = lambda x: "CASE " + " ".join(f"WHEN {x} BETWEEN {a} AND {b} THEN {c}" for a, b, c in compliance.BANDS) + f" ELSE {compliance.BANDS[0][2]} END"


def q09_density_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vines a hectare from two spacings, and the band that it falls into."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    nominal = S.density(1.5 + F.col("p_size") / 20, 1.0 + F.col("p_retailprice") % 7 / 10)
    rows = part.withColumn("density", F.round(nominal, 3))
    return rows.select("p_partkey", "density", S.band_of(F.col("density"), compliance.bands_array())["lei"].alias("lei"))


ORACLE["q09_density_band"] = f"""WITH d AS (SELECT p_partkey, round(10000 / ((1.5 + p_size / 20) * (1.0 + p_retailprice % 7 / 10)), 3) AS density FROM part)
SELECT p_partkey, density, coalesce((SELECT b.lei FROM (VALUES {_BANDS}) AS b(lo, hi, lei) WHERE density BETWEEN b.lo AND b.hi), {compliance.BANDS[0][2]}) AS lei FROM d"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as blocks of a register: what they ordered is measured, what their account says is declared."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    rows = customers.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    n = F.coalesce("n", F.lit(0))
    registered = F.col("c_custkey") % 17 != 5
    only = lambda c: F.when(registered, c)
    return rows.select(
        "c_custkey", registered.alias("registered"), F.round(n * 0.04, 3).alias("area_ha"), only(F.round(n * 0.04 * (0.8 + F.col("c_custkey") % 9 * 0.05), 3)).alias("declared_ha"),
        (2000 + F.col("c_custkey") % 13 * 250).cast("double").alias("density"), only((2000 + F.col("c_custkey") % 11 * 300).cast("double")).alias("declared_density"),
        (F.col("c_custkey") % 50 / 100).alias("gap_share"), (registered & (F.col("c_custkey") % 3 == 0)).alias("requested"),
    )


_BLOCKS_SQL = f"""o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey),
b AS (SELECT c_custkey, c_custkey % 17 <> 5 AS registered, round(coalesce(n, 0) * 0.04, 3) AS area_ha, CASE WHEN c_custkey % 17 <> 5 THEN round(coalesce(n, 0) * 0.04 * (0.8 + c_custkey % 9 * 0.05), 3) END AS declared_ha,
 CAST(2000 + c_custkey % 13 * 250 AS DOUBLE) AS density, CASE WHEN c_custkey % 17 <> 5 THEN CAST(2000 + c_custkey % 11 * 300 AS DOUBLE) END AS declared_density, c_custkey % 50 / 100 AS gap_share, c_custkey % 17 <> 5 AND c_custkey % 3 = 0 AS requested FROM customer LEFT JOIN o ON o_custkey = c_custkey),
k AS (SELECT *, CASE WHEN area_ha < 0.15 THEN 'info' WHEN NOT registered THEN 'fail' ELSE 'pass' END AS c_register,
 CASE WHEN NOT registered THEN NULL WHEN declared_ha IS NULL THEN 'info' WHEN abs(coalesce(declared_ha / nullif(area_ha, 0) - 1, 0)) <= 0.10 THEN 'pass' WHEN abs(coalesce(declared_ha / nullif(area_ha, 0) - 1, 0)) <= 0.20 THEN 'warn' ELSE 'fail' END AS c_area,
 CASE WHEN NOT registered THEN NULL WHEN declared_density IS NULL THEN 'info' WHEN {_LEI("density")} >= {_LEI("declared_density")} THEN 'pass' ELSE 'fail' END AS c_density,
 CASE WHEN gap_share <= 0.10 THEN 'pass' WHEN requested AND gap_share > 0.30 THEN 'fail' ELSE 'warn' END AS c_gaps FROM b),
t AS (SELECT *, CASE WHEN area_ha < 0.15 AND NOT registered THEN 'below_threshold' WHEN 'fail' IN (c_register, coalesce(c_area, ''), coalesce(c_density, ''), c_gaps) THEN 'noncompliant' WHEN 'warn' IN (c_register, coalesce(c_area, ''), coalesce(c_density, ''), c_gaps) THEN 'review' ELSE 'compliant' END AS status,
 CAST(round_even(round(CASE WHEN area_ha >= 0.5 THEN least(area_ha, coalesce(declared_ha, area_ha)) ELSE 0 END * ({_LEI("density * (1 - gap_share)")} + CASE WHEN c_custkey % 2 = 0 THEN 5000 ELSE 0 END), 2) / 100, 0) * 100 AS BIGINT) AS eligible_lei FROM k)"""


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = compliance.status(compliance.checks(_blocks(spark, sf_dir)))
    rate = S.band_of(F.col("density") * (1 - F.col("gap_share")), compliance.bands_array())["lei"]
    bonus = F.when(F.col("c_custkey") % 2 == 0, 5000).otherwise(0)
    return done.withColumn("eligible_lei", S.eligible_amount(F.col("area_ha"), F.coalesce("declared_ha", "area_ha"), rate, bonus, 0.5))


def q10_compliance_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long table of checks, one row each, beside the block's status, actions and amount."""
    rows = _checked(spark, sf_dir).select("c_custkey", "status", F.array_join("actions", "; ").alias("actions"), "eligible_lei", F.explode("checks").alias("c"))
    return rows.select("c_custkey", "status", "actions", "eligible_lei", F.col("c.id").alias("check_id"), F.col("c.status").alias("check_status"))


ORACLE["q10_compliance_checks"] = f"""WITH {_BLOCKS_SQL}, l AS (SELECT *, concat_ws('; ', CASE WHEN c_register = 'fail' THEN 'notify' END, CASE WHEN c_area IN ('fail', 'warn') OR c_density IN ('fail', 'warn') THEN 'measure' END, CASE WHEN c_gaps IN ('fail', 'warn') THEN 'replant' END) AS actions FROM t)
SELECT c_custkey, status, actions, eligible_lei, u.id AS check_id, u.s AS check_status FROM l, LATERAL (VALUES ('register', c_register), ('area', c_area), ('density', c_density), ('gaps', c_gaps)) AS u(id, s) WHERE u.s IS NOT NULL"""


def q11_compliance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compliance.summary(_checked(spark, sf_dir))


ORACLE["q11_compliance_summary"] = f"""WITH {_BLOCKS_SQL} SELECT count(*) AS blocks, {", ".join(f"count(CASE WHEN status = '{s}' THEN 1 END) AS n_{s}" for s in ("noncompliant", "review", "compliant", "below_threshold"))},
count(CASE WHEN registered THEN 1 END) AS registered, round(sum(CASE WHEN NOT registered AND area_ha >= 0.15 THEN area_ha ELSE 0 END), 2) AS unregistered_ha, CAST(sum(CASE WHEN requested THEN eligible_lei ELSE 0 END) AS BIGINT) AS eligible_lei FROM t"""


def q36_register_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks (suppliers) against parcels (all parts) as boxes; both kinds of mismatch, numbered by area."""
    at = lambda k, m, d: (F.col(k) * m % d).cast("double")
    supplier = table(spark, sf_dir, "supplier")
    bx, by = at("s_suppkey", 37, 409), at("s_suppkey", 91, 401)
    blocks = supplier.select(F.col("s_suppkey").alias("block"), bx.alias("bx0"), by.alias("by0"), (bx + 10 + F.col("s_suppkey") % 7).alias("bx1"), (by + 8 + F.col("s_suppkey") % 5).alias("by1"), (F.col("s_suppkey") % 6).alias("n_rows"))
    blocks = blocks.withColumn("block_area", (F.col("bx1") - F.col("bx0")) * (F.col("by1") - F.col("by0")))
    # Parcels lie on a grid, so that they don't overlap.
    part = table(spark, sf_dir, "part")
    px, py = (F.col("p_partkey") % 20 * 21).cast("double"), (F.floor(F.col("p_partkey") / 20) * 21).cast("double")
    parcels = part.select(F.col("p_partkey").alias("parcel"), px.alias("px0"), py.alias("py0"), (px + 20).alias("px1"), (py + 20).alias("py1"), (F.col("p_size") % 5 != 0).alias("planted"), (F.col("p_size") % 4 != 1).alias("authorised"))
    parcels = parcels.withColumn("parcel_area", F.lit(400.0))
    met = spatial.box_join(blocks, parcels, 25.0, ("bx0", "by0", "bx1", "by1"), ("px0", "py0", "px1", "py1"))
    shared = G.overlap(F.col("bx0"), F.col("bx1"), F.col("px0"), F.col("px1")) * G.overlap(F.col("by0"), F.col("by1"), F.col("py0"), F.col("py1"))
    pairs = met.select("block", "parcel", shared.alias("shared")).where("shared > 0")
    items = compliance.mismatches(blocks, parcels, pairs, 2, 90.0, 60.0, 0.4, 0.02)
    return reports.typed_ids(items, "kind", [F.desc("area"), "object"]).select("kind", "object", "area", "share_pct", "reason", "item_id")


ORACLE["q36_register_mismatch"] = """WITH b AS (SELECT s_suppkey AS block, CAST(s_suppkey * 37 % 409 AS DOUBLE) AS x0, CAST(s_suppkey * 91 % 401 AS DOUBLE) AS y0, CAST(s_suppkey * 37 % 409 + 10 + s_suppkey % 7 AS DOUBLE) AS x1, CAST(s_suppkey * 91 % 401 + 8 + s_suppkey % 5 AS DOUBLE) AS y1, s_suppkey % 6 AS n_rows FROM supplier),
p AS (SELECT p_partkey AS parcel, CAST(p_partkey % 20 * 21 AS DOUBLE) AS u0, CAST(p_partkey // 20 * 21 AS DOUBLE) AS v0, p_size % 5 <> 0 AS planted, p_size % 4 <> 1 AS authorised FROM part),
m AS (SELECT block, parcel, planted, authorised, greatest(least(x1, u0 + 20) - greatest(x0, u0), 0) * greatest(least(y1, v0 + 20) - greatest(y0, v0), 0) AS shared FROM b JOIN p ON x0 <= u0 + 20 AND u0 <= x1 AND y0 <= v0 + 20 AND v0 <= y1),
s AS (SELECT block, sum(CASE WHEN planted AND authorised THEN shared ELSE 0 END) AS valid, count(CASE WHEN NOT authorised THEN 1 END) AS un, count(CASE WHEN NOT planted THEN 1 END) AS other FROM m WHERE shared > 0 GROUP BY block),
a AS (SELECT 'A' AS kind, b.block AS object, greatest((x1 - x0) * (y1 - y0) - coalesce(valid, 0), 0) AS area, (x1 - x0) * (y1 - y0) AS whole, CASE WHEN un IS NULL THEN 'no parcel' WHEN un > 0 THEN 'unauthorised parcel' WHEN other > 0 THEN 'other status' ELSE 'partly covered' END AS reason FROM b LEFT JOIN s USING (block) WHERE n_rows >= 2 AND (x1 - x0) * (y1 - y0) >= 90),
c AS (SELECT p.parcel, coalesce(sum(shared), 0) AS covered FROM p LEFT JOIN m ON m.parcel = p.parcel WHERE p.planted GROUP BY p.parcel),
i AS (SELECT kind, object, round(area, 4) AS area, round(area / whole * 100, 1) AS share_pct, reason FROM a WHERE area >= 60 OR area / whole >= 0.4 UNION ALL SELECT 'B', parcel, 400.0, round(covered / 400 * 100, 1), 'not planted' FROM c WHERE covered / 400 < 0.02),
n AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY area DESC, object) AS r FROM i) SELECT kind, object, area, share_pct, reason, kind || lpad(CAST(r AS VARCHAR), CAST(greatest(2, length(CAST(r AS VARCHAR))) AS INTEGER), '0') AS item_id FROM n"""


def q40_csv_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as a careless export has them, cleaned as the reader of register extracts does."""
    part = table(spark, sf_dir, "part")
    dirty = part.select(
        F.when(F.col("p_partkey") % 11 == 0, "  ").otherwise(F.concat(F.lit(" v"), F.col("p_partkey").cast("string"), F.lit(" "))).alias("vineyard_id"), F.when(F.col("p_size") % 5 == 0, "").otherwise(F.lower("p_brand")).alias("variety"),
        F.replace(F.format_string("%.2f", "p_retailprice"), F.lit("."), F.lit(",")).alias("declared_area_ha"), F.when(F.col("p_size") > 45, "n/a").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(",7"))).alias("planting_year"), F.when(F.col("p_size") % 2 == 0, "DA").otherwise("nu").alias("demo"),
    )
    return registry.cleaned(dirty).select("vineyard_id", "variety", "rvv_code", F.round("declared_area_ha", 2).alias("declared_area_ha"), F.col("planting_year").cast("string").alias("planting_year"), "demo")


ORACLE["q40_csv_clean"] = """SELECT 'V' || p_partkey AS vineyard_id, CASE WHEN p_size % 5 = 0 THEN NULL ELSE lower(p_brand) END AS variety, '—' AS rvv_code, round(p_retailprice, 2) AS declared_area_ha, CASE WHEN p_size > 45 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS planting_year, p_size % 2 = 0 AS demo FROM part WHERE p_partkey % 11 <> 0"""

QUERIES = {k: f for k, f in globals().items() if k[0] == "q" and k[1:3].isdigit()}
