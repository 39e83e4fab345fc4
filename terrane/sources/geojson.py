"""GeoJSON layers, compact forms of them, and reports with a heading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import geometry as G

_POINTS = "array<struct<x:double,y:double>>"


def read(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features with the named properties (a schema string), geometry_type and points: of a point, a line, or a polygon's outer ring.

    rings holds the further rings and parts of a polygon. A missing property is null.
    """
    schema = f"features array<struct<properties:struct<{properties}>,geometry:struct<type:string,coordinates:string>>>"
    rows = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("features").alias("f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    pair = lambda c: F.transform(c, lambda p: G.point(p[0], p[1]))
    one = F.array(F.from_json(text, "array<double>"))
    polygon = F.when(kind == "Polygon", F.from_json(text, "array<array<array<double>>>")).when(kind == "MultiPolygon", F.flatten(F.from_json(text, "array<array<array<array<double>>>>")))
    rings = F.transform(polygon, lambda r: pair(F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(0)))))
    points = F.when(kind == "Point", pair(one)).when(kind == "LineString", pair(F.from_json(text, "array<array<double>>"))).otherwise(rings[0])
    return rows.select("f.properties.*", kind.alias("geometry_type"), points.cast(_POINTS).alias("points"), F.slice(rings, F.lit(2), F.greatest(F.size(rings), F.lit(0))).alias("rings"))


def feature(properties: list[Column], kind: str, points: Column) -> Column:
    """A feature as JSON; rings are closed."""
    pair = F.transform(points, lambda p: F.array(p["x"], p["y"]))
    shape = {"Point": pair[0], "LineString": pair, "Polygon": F.array(F.concat(pair, F.slice(pair, 1, 1)))}[kind]
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.struct(F.lit(kind).alias("type"), shape.alias("coordinates")).alias("geometry")))


def collection(features: DataFrame, column: str, order: str, epsg: int = 32635) -> DataFrame:
    """One row: the collection of all features of a layer, in order. For layers that a map shows, of bounded size."""
    head = f'{{"type":"FeatureCollection","crs":{{"type":"name","properties":{{"name":"urn:ogc:def:crs:EPSG::{epsg}"}}}},"features":['
    listed = F.array_sort(F.collect_list(F.struct(order, column)))
    return features.agg(F.concat(F.lit(head), F.array_join(F.transform(listed, lambda s: s[column]), ","), F.lit("]}")).alias("value"))


def compact(points: Column) -> Column:
    """Whole centimetres: the first point, then differences."""
    cm = F.transform(points, lambda p: F.array(F.round(p["x"] * 100).cast("long"), F.round(p["y"] * 100).cast("long")))
    return F.transform(cm, lambda p, i: F.when(i == 0, p).otherwise(F.array(p[0] - F.get(cm, i - 1)[0], p[1] - F.get(cm, i - 1)[1])))


def expand(deltas: Column) -> Column:
    """The points of a compact form, in metres: running sums."""
    start = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.array().cast(_POINTS).alias("out"))
    add = lambda s, d: F.struct((s["x"] + d[0]).alias("x"), (s["y"] + d[1]).alias("y"), F.concat(s["out"], F.array(G.point((s["x"] + d[0]) / 100, (s["y"] + d[1]) / 100))).alias("out"))
    return F.aggregate(deltas, start, add)["out"]


def csv_lines(report: DataFrame, columns: list[str], heading: list[str], order: list[str]) -> DataFrame:
    """A report's lines: headings after ``#``, the names, then rows in order; lists joined by ``; ``, nothing for null."""
    cell = lambda c, kind: F.array_join(F.col(c), "; ") if kind.startswith("array") else F.coalesce(F.col(c).cast("string"), F.lit(""))
    quoted = lambda v: F.when(v.rlike('[",\\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)
    rows = report.orderBy(*order).select(F.concat_ws(",", *(quoted(cell(c, dict(report.dtypes)[c])) for c in columns)).alias("value"))
    head = report.sparkSession.createDataFrame([(f"# {h}",) for h in heading] + [(",".join(columns),)], "value string")
    return head.coalesce(1).union(rows.coalesce(1))


def bins(sizes: DataFrame, name: str, size: str, most: int) -> DataFrame:
    """Files packed in order of name into parts of ``most`` bytes: name and part. A fold over one list of names and sizes."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("part"), F.array().cast("array<struct<name:string,part:int>>").alias("out"))

    def step(s: Column, f: Column) -> Column:
        new = (s["used"] > 0) & (s["used"] + f["size"] > most)
        part = F.when(new, s["part"] + 1).otherwise(s["part"])
        return F.struct(F.when(new, f["size"]).otherwise(s["used"] + f["size"]).alias("used"), part.alias("part"), F.concat(s["out"], F.array(F.struct(f["name"].alias("name"), part.alias("part")))).alias("out"))

    files = F.array_sort(F.collect_list(F.struct(F.col(name).alias("name"), F.col(size).cast("long").alias("size"))))
    return sizes.agg(F.aggregate(files, start, step)["out"].alias("o")).select(F.inline("o"))
