"""Register extracts: CSV as offices export it, and the JSON of rules and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXTS = ("rvv_code", "exploatant", "variety", "igp", "aipa_measure")
NUMBERS = {"planting_year": "int", "declared_area_ha": "double", "declared_density": "int", "aipa_year": "int", "requested_lei": "int"}


def _number(c: Column, kind: str) -> Column:
    """Decimal commas; integers are cut, and what is no number is missing."""
    v = F.replace(c, F.lit(","), F.lit(".")).try_cast("double")
    return v if kind == "double" else F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)).cast(kind)


def cleaned(raw: DataFrame) -> DataFrame:
    """Trimmed headers and cells; rows without an id go; empty cells are null; code and owner are a dash where missing."""
    cells = raw.select(*[F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")).alias(c.strip().lstrip("﻿")) for c in raw.columns])
    have = lambda c: F.col(c) if c in cells.columns else F.lit(None).cast("string")
    out = cells.where(F.col("vineyard_id").isNotNull())
    columns = [F.upper("vineyard_id").alias("vineyard_id"), F.coalesce(F.lower(have("demo")).isin("1", "true", "da"), F.lit(False)).alias("demo")]
    columns += [F.coalesce(have(c), F.lit("—")).alias(c) if c in ("rvv_code", "exploatant") else have(c).alias(c) for c in TEXTS]
    columns += [_number(have(c), kind).alias(c) for c, kind in NUMBERS.items()]
    return out.select(*columns)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return cleaned(spark.read.option("header", True).option("encoding", "UTF-8").option("quote", '"').csv(path))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file of records; each must be marked as a demonstration."""
    rows = spark.read.option("multiLine", True).json(path).select(F.explode("records").alias("r")).select("r.*")
    return rows.where(F.assert_true(F.col("demo"), F.lit("records must carry demo: true")).isNull())


def read_criteria(spark: SparkSession, path: str) -> DataFrame:
    """The rules' parameters as one row."""
    return spark.read.option("multiLine", True).json(path)
