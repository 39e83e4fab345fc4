"""Declared against measured: density bands, checks of a register, worst status, eligible amounts and register mismatches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions import scalars as S

#: Density bands (vines a hectare, closed) with the amount paid a hectare; the first holds for what no band does.
BANDS = ((0, 2499, 40000), (2500, 3499, 55000), (3500, 4499, 70000), (4500, 99999, 85000))


def bands_array() -> Column:
    return F.array(*(F.struct(F.lit(float(a)).alias("min"), F.lit(float(b)).alias("max"), F.lit(c).alias("lei")) for a, b, c in BANDS))


def last_record(register: DataFrame, key: str, order: str) -> DataFrame:
    """Of records that share a key the last one."""
    rest = [c for c in register.columns if c != key]
    return register.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def with_default(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Left join of a measured value; the median of all where a key has none."""
    median = right.agg(F.percentile(value, 0.5).alias("_median"))
    return left.join(right, key, "left").join(F.broadcast(median)).withColumn(f"{value}_measured", F.col(value).isNotNull()).withColumn(value, F.coalesce(value, "_median")).drop("_median")  # one row


def checks(blocks: DataFrame) -> DataFrame:
    """Checks of each block as an array of (id, status), null where a check doesn't apply.

    blocks: registered, area_ha, declared_ha, density, declared_density, gap_share, requested.
    """
    deviation = F.col("declared_ha") / F.nullif(F.col("area_ha"), F.lit(0.0)) - 1
    band, declared_band = S.band_of(F.col("density"), bands_array()), S.band_of(F.col("declared_density"), bands_array())
    register = F.when(F.col("area_ha") < 0.15, "info").when(~F.col("registered"), "fail").otherwise("pass")
    area = F.when(F.col("declared_ha").isNull(), "info").otherwise(S.tolerance_class(F.coalesce(deviation, F.lit(0.0)), 0.10, 0.20))
    density = F.when(F.col("declared_density").isNull(), "info").when(band["lei"] >= declared_band["lei"], "pass").otherwise("fail")
    gaps = F.when(F.col("gap_share") <= 0.10, "pass").when(F.col("requested") & (F.col("gap_share") > 0.30), "fail").otherwise("warn")
    item = lambda name, status, when: F.when(when, F.struct(F.lit(name).alias("id"), status.alias("status")))
    every = F.array(item("register", register, F.lit(True)), item("area", area, F.col("registered")), item("density", density, F.col("registered")), item("gaps", gaps, F.lit(True)))
    return blocks.withColumn("checks", F.filter(every, lambda c: c.isNotNull()))


def status(checked: DataFrame) -> DataFrame:
    """The worst check, or below_threshold for small unregistered blocks, and the actions that follow."""
    has = lambda s: F.exists("checks", lambda c: c["status"] == s)
    named = lambda ids, of: F.exists("checks", lambda c: c["id"].isin(*ids) & c["status"].isin(*of))
    worst = F.when((F.col("area_ha") < 0.15) & ~F.col("registered"), "below_threshold").when(has("fail"), "noncompliant").when(has("warn"), "review").otherwise("compliant")
    actions = F.array(F.when(named(("register",), ("fail",)), "notify"), F.when(named(("area", "density"), ("fail", "warn")), "measure"), F.when(named(("gaps",), ("fail", "warn")), "replant"))
    return checked.withColumn("status", worst).withColumn("actions", F.filter(actions, lambda a: a.isNotNull()))


def summary(done: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("noncompliant", "review", "compliant", "below_threshold")]
    unregistered = F.round(F.sum(F.when(~F.col("registered") & (F.col("area_ha") >= 0.15), F.col("area_ha")).otherwise(0.0)), 2)
    return done.agg(F.count(F.lit(1)).alias("blocks"), *counts, F.count_if("registered").alias("registered"), unregistered.alias("unregistered_ha"), F.sum(F.when(F.col("requested"), F.col("eligible_lei")).otherwise(0)).alias("eligible_lei"))


def mismatches(blocks: DataFrame, parcels: DataFrame, pairs: DataFrame, min_rows: int, min_area: float, a_area: float, a_share: float, b_cover: float) -> DataFrame:
    """Planted but not covered by valid parcels (A), registered but hardly planted (B).

    blocks: block, n_rows, block_area; parcels: parcel, parcel_area, planted, authorised; pairs: block, parcel, shared (area).
    """
    known = pairs.join(parcels.select("parcel", "planted", "authorised"), "parcel")
    seen = known.groupBy("block").agg(F.sum(F.when(F.col("planted") & F.col("authorised"), F.col("shared")).otherwise(0.0)).alias("_valid"), F.count_if(~F.col("authorised")).alias("_unauthorised"), F.count_if(~F.col("planted")).alias("_other"))
    a = blocks.where((F.col("n_rows") >= min_rows) & (F.col("block_area") >= min_area)).join(seen, "block", "left").fillna(0.0, ["_valid"])
    open_area = F.greatest(F.col("block_area") - F.col("_valid"), F.lit(0.0))
    part = S.share(open_area, F.col("block_area"))
    reason = F.when(F.col("_unauthorised").isNull(), "no parcel").when(F.col("_unauthorised") > 0, "unauthorised parcel").when(F.col("_other") > 0, "other status").otherwise("partly covered")
    a = a.where((open_area >= a_area) | (part >= a_share)).select(F.lit("A").alias("kind"), F.col("block").alias("object"), F.round(open_area, 4).alias("area"), F.round(part * 100, 1).alias("share_pct"), reason.alias("reason"))
    covered = pairs.groupBy("parcel").agg(F.sum("shared").alias("_covered"))
    b = parcels.where("planted").join(covered, "parcel", "left").fillna(0.0, ["_covered"])
    cover = S.share(F.col("_covered"), F.col("parcel_area"))
    b = b.where(cover < b_cover).select(F.lit("B").alias("kind"), F.col("parcel").alias("object"), F.round("parcel_area", 4).alias("area"), F.round(cover * 100, 1).alias("share_pct"), F.lit("not planted").alias("reason"))
    return a.unionByName(b)
