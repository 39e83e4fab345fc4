"""Roll-ups and reports of rows, blocks and the whole survey."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import scalars as S
from terrane.operators import intervals


def rollup_levels(rows: DataFrame, block: str, row: str, amount: str) -> DataFrame:
    """total, block and row level in one result. ``rows`` holds a line for each part; keys are text, empty where they are summed over."""
    sets = rows.groupingSets([[], [F.col(block)], [F.col(block), F.col(row)]], F.col(block), F.col(row)).agg(
        F.grouping_id().alias("_level"), F.round(F.sum(amount), 3).alias("length_m"), F.count(F.lit(1)).alias("segments"), F.countDistinct(row).alias("n_rows")
    )
    level = F.when(F.col("_level") == 3, "total").when(F.col("_level") == 1, "block").otherwise("row")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return sets.select(level.alias("level"), name(block), name(row), "length_m", "segments", "n_rows")


def row_structure(canopies: DataFrame, keys: list[str], row_length: float) -> DataFrame:
    """longest_gap and structure of each row, ends included."""
    gap = intervals.longest_gap(canopies, keys, F.lit(0.0), F.lit(row_length))
    return gap.withColumn("structure", S.structure(F.col("longest_gap")))


def block_report(canopies: DataFrame, row_length: float, min_gap: float) -> DataFrame:
    """One line for each block: rows, disrupted ones, status, covered length, gaps and missing vines."""
    keys = ["vineyard_id", "row_id"]
    # Merged once; what follows an interval gives the gaps, the longest of them and the covered length at once.
    merged = intervals.merge(canopies, keys).withColumn("_gap", F.lead("lo").over(Window.partitionBy(*keys).orderBy("lo")) - F.col("hi"))
    long = F.col("_gap") >= min_gap
    longest = F.greatest(F.coalesce(F.max("_gap"), F.lit(0.0)), F.min("lo"), row_length - F.max("hi"), F.lit(0.0))
    rows = merged.groupBy(*keys).agg(F.sum(F.col("hi") - F.col("lo")).alias("_covered"), longest.alias("_longest"), F.count_if(long).alias("_gaps"), F.sum(F.when(long, F.col("_gap")).otherwise(0.0)).alias("_gap_m"))
    out = rows.groupBy("vineyard_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(S.structure(F.col("_longest")) == "disrupted").alias("disrupted_rows"), F.round(F.sum("_covered"), 3).alias("row_length_m"), F.sum("_gaps").alias("n_gaps"), F.round(F.sum("_gap_m"), 1).alias("gap_length_m")
    )
    part = S.share(F.col("disrupted_rows"), F.col("n_rows"))
    return out.select("vineyard_id", "n_rows", "disrupted_rows", F.round(part, 3).alias("disrupted_share"), S.block_status(part).alias("status"), "row_length_m", "n_gaps", "gap_length_m", S.missing_vines(F.col("gap_length_m")).alias("missing_vines"))


def ranked_report(report: DataFrame) -> DataFrame:
    """Worst status first, then most missing vines."""
    order = F.when(F.col("status") == "red", 0).when(F.col("status") == "yellow", 1).otherwise(2)
    return report.withColumn("place", F.row_number().over(Window.orderBy(order, F.desc("missing_vines"), "vineyard_id")))


def report_summary(report: DataFrame) -> DataFrame:
    """Sums over the blocks, of their rounded figures, and the number of blocks of each status, none left out."""
    statuses = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("red", "yellow", "green")]
    return report.agg(F.count(F.lit(1)).alias("blocks"), F.sum("n_rows").alias("n_rows"), F.round(F.sum("row_length_m"), 1).alias("row_length_m"), F.sum("missing_vines").alias("missing_vines"), F.round(F.sum("gap_length_m"), 1).alias("gap_length_m"), *statuses)


def number_blocks(blocks: DataFrame, x: str, y: str, key: str, band: float = 25.0) -> DataFrame:
    """Ids V01, V02 ... by bands from the north, and from the west within one. Numbering is by a total order over the block table."""
    n = F.row_number().over(Window.orderBy(-F.bround(F.col(y) / band, 0), F.col(x), F.col(key)))
    width = F.greatest(F.lit(2), F.length(F.count(F.lit(1)).over(Window.partitionBy()).cast("string")))
    label = F.lpad(F.col("block_no").cast("string"), F.col("_width"), F.lit("0"))
    return blocks.withColumn("block_no", n).withColumn("_width", width).withColumn("block_id", F.concat(F.lit("V"), label)).drop("_width")


def number_rows(rows: DataFrame, block: str, offset: str, key: str) -> DataFrame:
    """Rows of a block from the northern side: R01, R02 ..."""
    n = F.row_number().over(Window.partitionBy(block).orderBy(F.desc(offset), key))
    size = F.length(F.count(F.lit(1)).over(Window.partitionBy(block)).cast("string"))
    return rows.withColumn("row_no", n).withColumn("row_label", F.concat(F.lit("R"), F.lpad(n.cast("string"), F.greatest(F.lit(2), size), F.lit("0"))))


def typed_ids(items: DataFrame, kind: str, order: list) -> DataFrame:
    """Ids by type, in order: the type's letter and a number of two digits or more."""
    n = F.row_number().over(Window.partitionBy(kind).orderBy(*order))
    return items.withColumn("item_id", F.concat(F.col(kind), F.lpad(n.cast("string"), F.greatest(F.lit(2), F.length(n.cast("string"))), F.lit("0"))))


def circular_mean(angle: str, weight: str):
    """Weighted mean of directions in radians, modulo pi."""
    a, w = F.col(angle), F.col(weight)
    return F.atan2(F.sum(w * F.sin(2 * a)), F.sum(w * F.cos(2 * a))) / 2


def weighted_mean(value: str, weight: str):
    return F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight))


def route_buckets(stops: DataFrame, position: str, total, days: int) -> DataFrame:
    """Equal lengths of a route, one a day; the end belongs to the last."""
    return stops.withColumn("day", F.least(F.floor(F.col(position) / (total / days)), F.lit(days - 1)).cast("int") + 1)


def top_by_group(items: DataFrame, group: str, value: str, distance: str, key: str, most: int) -> DataFrame:
    """Of each group the item with the largest value and the one with the smallest distance, ``most`` at most, by key."""
    by_value, by_distance = (F.row_number().over(Window.partitionBy(group).orderBy(o, key)) for o in (F.desc(value), F.col(distance)))
    picked = items.withColumn("_v", by_value).withColumn("_d", by_distance).where("_v = 1 OR _d = 1")
    return picked.withColumn("pick", F.row_number().over(Window.partitionBy(group).orderBy(key))).where(F.col("pick") <= most).drop("_v", "_d")


def every_kth(rows: DataFrame, key: str, about: int) -> DataFrame:
    """Every k-th row by key, so that ``about`` or up to twice as many are left; places come from counts of key ranges, not one big sort."""
    n = rows.count()
    k = max(1, n // about)
    place = F.row_number().over(Window.partitionBy("_bin").orderBy(key))
    low, high = rows.agg(F.min(key), F.max(key)).first()
    width = max(1, ((high or 0) - (low or 0)) // 1000 + 1)
    binned = rows.withColumn("_bin", F.floor((F.col(key) - F.lit(low or 0)) / width))
    sizes = binned.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n"))  # a thousand rows
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return binned.withColumn("_r", place).join(F.broadcast(before), "_bin").where((F.col("_before") + F.col("_r") - 1) % k == 0).drop("_bin", "_r", "_before")


def pair_consistency(sample: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """pairs of a sample, and the share of them that are alike in both columns or in none. From group sizes, without making the pairs."""
    both = lambda n: (n * (n - 1) / 2).cast("long")
    counted = sample.groupBy(a, b).agg(F.count(F.lit(1)).alias("_n"))
    alike = lambda *c: counted.groupBy(*c).agg(F.sum("_n").alias("_m")).agg(F.coalesce(F.sum(both(F.col("_m"))), F.lit(0)).alias("p"))
    total = counted.agg(F.coalesce(both(F.sum("_n")), F.lit(0)).alias("pairs"))
    sums = total.join(alike(a).withColumnRenamed("p", "_a")).join(alike(b).withColumnRenamed("p", "_b")).join(alike(a, b).withColumnRenamed("p", "_ab"))  # one row each
    return sums.select("pairs", F.try_divide(F.col("pairs") - F.col("_a") - F.col("_b") + 2 * F.col("_ab"), F.col("pairs")).alias("consistent"))
