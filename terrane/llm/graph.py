"""Connected components of an edge table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.store import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node and root (the smallest node of its component) for each node of ``edges`` (two columns of numbers) but the roots themselves.

    Alternating stars: each node hands its larger neighbours to its smallest one, then its smaller ones, until every node points at its
    root. Minima are taken before the shuffle, so that a node with very many neighbours does no harm; each round is written down.
    """
    u, v = edges.columns
    pairs = edges.where(F.col(u) != F.col(v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    state, stars = None, scratch.save(pairs, "edges")
    while True:
        now = tuple(stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state, before = now, stars
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        stars = scratch.save(small.distinct(), "stars")
        scratch.drop(before)
