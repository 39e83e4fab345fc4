"""Interval algebra and runs with window functions; each partition of the key is independent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(df: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Overlapping and touching intervals of a key joined; n counts what went into each."""
    order = Window.partitionBy(*keys).orderBy(lo, hi)
    before = F.max(hi).over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col(lo) <= F.col("_end"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = df.withColumn("_end", before).withColumn("_island", island)
    return marked.groupBy(*keys, "_island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.count(F.lit(1)).alias("n")).drop("_island")


def gaps(df: DataFrame, keys: list[str], least: float, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """What lies between the merged intervals of a key, from ``least`` on: gap_lo, gap_hi and gap."""
    order = Window.partitionBy(*keys).orderBy(lo)
    following = merge(df, keys, lo, hi).withColumn("gap_hi", F.lead(lo).over(order))
    return following.select(*keys, F.col(hi).alias("gap_lo"), "gap_hi", (F.col("gap_hi") - F.col(hi)).alias("gap")).where(F.col("gap") >= least)


def longest_gap(df: DataFrame, keys: list[str], begin: Column, end: Column, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """The longest stretch without an interval, the ends of the row included."""
    order = Window.partitionBy(*keys).orderBy(lo)
    m = merge(df, keys, lo, hi).withColumn("_gap", F.lead(lo).over(order) - F.col(hi))
    return m.groupBy(*keys).agg(F.greatest(F.coalesce(F.max("_gap"), F.lit(0.0)), F.min(lo) - begin, end - F.max(hi), F.lit(0.0)).alias("longest_gap"))


def complement(df: DataFrame, keys: list[str], begin: Column, end: Column, least: float = 0.0, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """The pieces of begin to end that no interval covers, longer than ``least``."""
    order = Window.partitionBy(*keys).orderBy(lo)
    m = merge(df, keys, lo, hi).withColumn("_next", F.coalesce(F.lead(lo).over(order), end)).withColumn("_first", F.row_number().over(order) == 1)
    after = F.struct(F.col(hi).alias("lo"), F.col("_next").alias("hi"))
    first = F.struct(begin.cast("double").alias("lo"), F.col(lo).alias("hi"))
    pieces = m.select(*keys, F.explode(F.when(F.col("_first"), F.array(first, after)).otherwise(F.array(after))).alias("p"))
    return pieces.select(*keys, "p.lo", "p.hi").where(F.col("hi") - F.col("lo") > least)


def runs(df: DataFrame, keys: list[str], order: list[str], flag: Column, least: int = 1) -> DataFrame:
    """Stretches of consecutive rows with the flag set: run (numbered from 1 in order), n, and the first row's and last row's order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("_on", F.coalesce(flag, F.lit(False))).withColumn("_i", F.row_number().over(w))
    marked = marked.withColumn("_new", F.when(F.col("_on") & ~F.coalesce(F.lag("_on").over(w), F.lit(False)), 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = marked.where("_on").groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("n"), *(F.min(c).alias(f"first_{c}") for c in order), *(F.max(c).alias(f"last_{c}") for c in order), F.min("_i").alias("start"))
    return found.where(F.col("n") >= least).withColumn("run", F.row_number().over(Window.partitionBy(*keys).orderBy("start"))).drop("_run", "start")


def first_failure(df: DataFrame, keys: list[str], order: str, bad: Column, after: int) -> DataFrame:
    """Where ``after`` bad rows in a row are complete for the first time, by key."""
    w = Window.partitionBy(*keys).orderBy(order)
    counted = df.withColumn("_bad", F.when(bad, 1).otherwise(0)).withColumn("_last", F.sum("_bad").over(w.rowsBetween(1 - after, 0)))
    return counted.where(F.col("_last") == after).groupBy(*keys).agg(F.min(order).alias("failed_at"))


def moving_mean(value: str, keys: list[str], order: list[str], before: int, after: int) -> Column:
    """Centred mean over rows, of as many as there are; nulls don't count."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-before, after)
    return F.sum(value).over(w) / F.count(value).over(w)


def planted_pieces(samples: DataFrame, row: str, order: str, value: str, least: float, half: int, bridge: int, shortest: int) -> DataFrame:
    """Where along a row plants stand: row, piece (from 1), n, first and last sample.

    Samples are smoothed over ``half`` on either side; those that reach ``least`` are planted. Empty stretches at the ends go, those
    inside that are not shorter than ``bridge`` samples cut the row, and pieces below ``shortest`` samples go.
    """
    w = Window.partitionBy(row).orderBy(order)
    marked = samples.select(row, F.row_number().over(w).alias("_i"), (moving_mean(value, [row], [order], half, half) >= least).alias("_good"))
    along = Window.partitionBy(row).orderBy("_i")
    good = marked.where("_good").withColumn("_new", F.when(F.col("_i") - F.lag("_i").over(along) <= bridge, 0).otherwise(1))
    grouped = good.withColumn("_piece", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = grouped.groupBy(row, "_piece").agg(F.min("_i").alias("first"), F.max("_i").alias("last")).withColumn("n", F.col("last") - F.col("first") + 1).where(F.col("n") >= shortest)
    return pieces.withColumn("piece", F.row_number().over(Window.partitionBy(row).orderBy("first"))).drop("_piece")
