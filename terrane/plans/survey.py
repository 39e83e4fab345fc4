"""The survey as a view over orders and lineitem: an order is a row of plants, its lines are canopies along the row's axis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Length of every row in metres; number of blocks.
ROW_LENGTH, BLOCKS = 56.0, 46

#: The same in SQL: row_id, vineyard_id, seg, lo, hi.
CTE = """survey AS (SELECT o_orderkey AS row_id, o_custkey % 46 AS vineyard_id, l_linenumber AS seg, (l_linenumber - 1) * 8 + l_discount * 20 AS lo,
  (l_linenumber - 1) * 8 + l_discount * 20 + 0.5 + l_quantity / 10 AS hi FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""
MERGED = (
    CTE
    + """,
ahead AS (SELECT *, max(hi) OVER (PARTITION BY vineyard_id, row_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM survey),
islands AS (SELECT *, sum(CASE WHEN lo <= e THEN 0 ELSE 1 END) OVER (PARTITION BY vineyard_id, row_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM ahead),
merged AS (SELECT vineyard_id, row_id, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM islands GROUP BY vineyard_id, row_id, island),
spaced AS (SELECT *, lead(lo) OVER (PARTITION BY vineyard_id, row_id ORDER BY lo) AS next FROM merged),
gaps AS (SELECT vineyard_id, row_id, hi AS gap_lo, next AS gap_hi, next - hi AS gap FROM spaced WHERE next - hi >= 3),
longest AS (SELECT vineyard_id, row_id, greatest(coalesce(max(next - hi), 0), min(lo), 56.0 - max(hi), 0.0) AS longest_gap FROM spaced GROUP BY vineyard_id, row_id),
rows_of AS (SELECT vineyard_id, row_id, sum(hi - lo) AS covered, longest_gap FROM merged JOIN longest USING (vineyard_id, row_id) GROUP BY vineyard_id, row_id, longest_gap),
block AS (SELECT r.vineyard_id, count(*) AS n_rows, count(CASE WHEN longest_gap > 5.5 THEN 1 END) AS disrupted_rows, round(sum(covered), 3) AS row_length_m FROM rows_of r GROUP BY r.vineyard_id),
gap_sums AS (SELECT vineyard_id, count(*) AS n_gaps, round(sum(gap), 1) AS gap_length_m FROM gaps GROUP BY vineyard_id),
report AS (SELECT b.vineyard_id, n_rows, disrupted_rows, round(disrupted_rows * 1.0 / n_rows, 3) AS disrupted_share,
  CASE WHEN disrupted_rows * 1.0 / n_rows < 0.10 THEN 'green' WHEN disrupted_rows * 1.0 / n_rows <= 0.30 THEN 'yellow' ELSE 'red' END AS status,
  row_length_m, coalesce(n_gaps, 0) AS n_gaps, coalesce(gap_length_m, 0) AS gap_length_m, CAST(round_even(coalesce(gap_length_m, 0) / 1.2, 0) AS BIGINT) AS missing_vines
  FROM block b LEFT JOIN gap_sums g ON g.vineyard_id = b.vineyard_id)"""
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_quantity")
    lo = (F.col("l_linenumber") - 1) * 8 + F.col("l_discount") * 20
    return orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("row_id"), (F.col("o_custkey") % BLOCKS).alias("vineyard_id"), F.col("l_linenumber").alias("seg"), lo.alias("lo"), (lo + 0.5 + F.col("l_quantity") / 10).alias("hi")
    )
