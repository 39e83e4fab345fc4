"""Comparing, merging and checking versions of annotation sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators import intervals


def diff(old: DataFrame, new: DataFrame, key: str, count: str, amount: str, tolerance: float) -> DataFrame:
    """What changed for each key: added, removed, same (within the tolerance), moved, more or fewer."""
    a = old.select(key, F.col(count).alias("_n0"), F.col(amount).alias("_l0"))
    b = new.select(key, F.col(count).alias("_n1"), F.col(amount).alias("_l1"))
    action = (
        F.when(F.col("_n0").isNull(), "added").when(F.col("_n1").isNull(), "removed").when((F.col("_n0") == F.col("_n1")) & (F.abs(F.col("_l1") - F.col("_l0")) <= tolerance), "same")
        .when(F.col("_n0") == F.col("_n1"), "moved").when(F.col("_n1") > F.col("_n0"), "more").otherwise("fewer")
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return a.join(b, key, "full_outer").select(key, zero("_n0").alias("n_old"), zero("_n1").alias("n_new"), (zero("_l1") - zero("_l0")).alias("length_change"), action.alias("action"))


def keep_largest(rows: DataFrame, keys: list[str], size: str, order: str) -> DataFrame:
    """Of rows that share a key the largest, the first in order of equals."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(size), order))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r")


def replace_keys(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """``other`` in place of the rows whose keys it has."""
    return rows.join(other.select(key).distinct(), key, "left_anti").unionByName(other)


def violations(rows: DataFrame, key: str, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """object and violation, a row for each rule (a condition and what it means) that a row breaks."""
    broken = F.array(*(F.when(F.expr(rule), F.lit(what)) for rule, what in rules))
    return rows.select(F.col(key).cast("long").alias("object"), F.explode(F.filter(broken, lambda b: b.isNotNull())).alias("violation"))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def reconcile(a: DataFrame, b: DataFrame, value: str, share: float) -> DataFrame:
    """Whether two totals agree within a share of the second."""
    total = lambda df, name: df.agg(F.sum(value).alias(name))
    return total(a, "left_total").join(total(b, "right_total")).withColumn("ok", F.abs(F.col("left_total") - F.col("right_total")) <= share * F.greatest(F.abs("right_total"), F.lit(1e-9)))


def symmetric_difference(old: DataFrame, new: DataFrame, keys: list[str], tolerance: float = 0.0) -> DataFrame:
    """keys, old_m, new_m and changed_m: the length that one version has and the other lacks, by intervals (lo, hi) on an axis.

    What one has alone is the union less the other. Pieces may stick out by the tolerance at either end before they count.
    """
    total = lambda df, name: intervals.merge(df.select(*keys, "lo", "hi"), keys).groupBy(*keys).agg(F.sum(F.col("hi") - F.col("lo")).alias(name))
    wide = lambda df: df.select(*keys, (F.col("lo") - tolerance).alias("lo"), (F.col("hi") + tolerance).alias("hi"))
    out = total(old, "old_m").join(total(new, "new_m"), keys, "full_outer")
    for name, a, b in (("_gone", old, wide(new)), ("_come", new, wide(old))):
        out = out.join(total(a.select(*keys, "lo", "hi").unionByName(b), "_both"), keys, "left").join(total(b, "_other"), keys, "left")
        out = out.withColumn(name, F.coalesce("_both", F.lit(0.0)) - F.coalesce("_other", F.lit(0.0))).drop("_both", "_other")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return out.select(*keys, zero("old_m"), zero("new_m"), (F.col("_gone") + F.col("_come")).alias("changed_m"))
