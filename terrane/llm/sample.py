"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def of_each(ids: DataFrame, label: str, sizes: list[tuple], n: int) -> DataFrame:
    """``label`` and doc_id of the n ids (all, where there are fewer) of each label in ``sizes`` that come first by hash.

    ``sizes`` are labels with their number of distinct ids, about. A bar on the hash leaves some 4 n ids of each label, so that what is
    ranked in one task doesn't grow with the label's rows. Repeated rows count once; null ids and labels are left out.
    """
    spark = ids.sparkSession
    bars = spark.createDataFrame([(name, min(2**63 - 1, 2**63 * (4 * n + 16) // max(1, size))) for name, size in sizes], f"{label} {dict(ids.dtypes)[label]}, _bar long")
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    low = ids.where("doc_id IS NOT NULL").join(F.broadcast(bars), label).where(place <= F.col("_bar")).select(label, "doc_id").distinct()
    rank = F.row_number().over(Window.partitionBy(label).orderBy(place, "doc_id"))
    return low.withColumn("_rank", rank).where(F.col("_rank") <= n).select(label, "doc_id")
