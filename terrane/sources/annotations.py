"""Annotation exports in CVAT's XML for images (1.1), read and written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.functions import geometry as G
from terrane.operators import versions

_ATTRIBUTE = "array<struct<_VALUE:string,_name:string>>"
_SHAPE = f"array<struct<_label:string,_points:string,attribute:{_ATTRIBUTE}>>"
_BOX = f"array<struct<_label:string,_xtl:double,_ytl:double,_xbr:double,_ybr:double,attribute:{_ATTRIBUTE}>>"
SCHEMA = f"_name string, polygon {_SHAPE}, polyline {_SHAPE}, box {_BOX}"

#: Each label's shape and attributes, and what an attribute may be (nothing named: any text).
LABELS = {"vineyard": ("polygon", ("vineyard_id",)), "interrow_area": ("polygon", ("vineyard_id", "interrow_cover")), "row": ("polyline", ("vineyard_id", "row_id", "row_structure")), "waste": ("box", ("vineyard_id",))}
ALLOWED = {"row_structure": ("regular", "disrupted", "unassessable"), "interrow_cover": ("bare_soil", "vegetation", "mixed", "unassessable")}


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each object: tile, type, label, points (boxes too, as rings), attrs and its place in the tile."""
    images = spark.read.format("xml").option("rowTag", "image").schema(SCHEMA).load(path)
    attrs = lambda a: F.map_from_entries(F.transform(F.coalesce(a, F.array().cast(_ATTRIBUTE)), lambda x: F.struct(x["_name"], F.coalesce(x["_VALUE"], F.lit("")))))
    parts = []
    for kind in ("polygon", "polyline", "box"):
        o = F.col("o")
        rows = images.select(F.col("_name").alias("tile"), F.posexplode(kind).alias("seq", "o"))
        points = G.box(o["_xtl"], o["_ytl"], o["_xbr"], o["_ybr"]) if kind == "box" else G.parse_points(o["_points"])
        parts.append(rows.select("tile", F.lit(kind).alias("type"), o["_label"].alias("label"), points.alias("points"), attrs(o["attribute"]).alias("attrs"), "seq"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def merge(exports: list[DataFrame]) -> DataFrame:
    """Of several exports, each tile from the one with most objects, the first of equals. Tiles go by their base name."""
    rows = None
    for i, e in enumerate(exports):
        e = e.withColumn("tile", F.element_at(F.split("tile", "/"), -1)).withColumn("source", F.lit(i))
        rows = e if rows is None else rows.unionByName(e)
    sizes = rows.groupBy("tile", "source").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(versions.keep_largest(sizes, ["tile"], "n", "source").select("tile", "source"), ["tile", "source"])


#: Fixed value: how far outside a tile a coordinate may be, in pixels. Only waste may be without a block.
SLACK, MAY_BE_EMPTY = 0.5, (("waste", "vineyard_id"),)


def violations(objects: DataFrame, width: float, height: float) -> DataFrame:
    """tile, seq, type and what is wrong: label, shape, attributes, empty or not allowed values, places outside the tile, too few points."""
    label, attrs = F.col("label"), F.col("attrs")
    known = F.create_map(*(F.lit(x) for k, v in LABELS.items() for x in (k, v[0])))
    names = F.create_map(*(x for k, v in LABELS.items() for x in (F.lit(k), F.array(*map(F.lit, v[1])))))
    outside = F.exists("points", lambda p: (p["x"] < -SLACK) | (p["y"] < -SLACK) | (p["x"] > width + SLACK) | (p["y"] > height + SLACK))
    least = F.when(F.col("type") == "polyline", 2).otherwise(3)
    bad_values = [F.when(attrs[k].isNotNull() & ~attrs[k].isin(*v), F.lit(f"{k} not allowed")) for k, v in ALLOWED.items()]
    optional = lambda k: label.isin(*(kind for kind, name in MAY_BE_EMPTY if name == k)) if any(name == k for _, name in MAY_BE_EMPTY) else F.lit(False)
    bad_values += [F.when((F.trim(attrs[k]) == "") & ~optional(k), F.lit(f"{k} empty")) for k in sorted({a for _, names in LABELS.values() for a in names})]
    found = F.array(
        F.when(known[label].isNull(), "unknown label"), F.when(known[label] != F.col("type"), "wrong shape"), F.when(F.size(F.array_except(names[label], F.map_keys(attrs))) > 0, "attribute missing"),
        F.when(F.size(F.array_except(F.map_keys(attrs), names[label])) > 0, "attribute unknown"), F.when(outside, "outside the tile"), F.when(F.size("points") < least, "too few points"), *bad_values,
    )
    return objects.select("tile", "type", "seq", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("violation"))


def to_xml(objects: DataFrame) -> DataFrame:
    """tile and the text of its image element, objects in order, coordinates to one decimal."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    number = lambda v: F.format_string("%.1f", v)
    attributes = F.array_join(F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat(F.lit('<attribute name="'), escaped(e["key"]), F.lit('">'), escaped(e["value"]), F.lit("</attribute>"))), "")
    places = F.when(
        F.col("type") == "box", F.concat(*(x for name, v in (("xtl", F.col("points")[0]["x"]), ("ytl", F.col("points")[0]["y"]), ("xbr", F.col("points")[2]["x"]), ("ybr", F.col("points")[2]["y"])) for x in (F.lit(f' {name}="'), number(v), F.lit('"')))),
    ).otherwise(F.concat(F.lit(' points="'), F.array_join(F.transform("points", lambda p: F.concat(number(p["x"]), F.lit(","), number(p["y"]))), ";"), F.lit('"')))
    element = F.concat(F.lit("<"), F.col("type"), F.lit(' label="'), escaped(F.col("label")), F.lit('"'), places, F.lit(">"), attributes, F.lit("</"), F.col("type"), F.lit(">"))
    kind = F.when(F.col("type") == "polygon", 0).when(F.col("type") == "polyline", 1).otherwise(2)
    images = objects.groupBy("tile").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(kind.alias("k"), "seq", element.alias("e")))), lambda s: s["e"]), "").alias("_o"))
    return images.select("tile", F.concat(F.lit('<image name="'), escaped(F.col("tile")), F.lit('">'), F.col("_o"), F.lit("</image>")).alias("xml"))


def write(objects: DataFrame, path: str, meta: str = "") -> None:
    """One document. A survey has some hundred tiles, which come in order through one task of text rows."""
    body = to_xml(objects).orderBy("tile").coalesce(1).select("xml")
    spark = objects.sparkSession
    edge = lambda s: spark.createDataFrame([(s,)], T.StructType([T.StructField("xml", T.StringType())]))
    edge("<annotations>" + meta).union(body).union(edge("</annotations>")).coalesce(1).write.text(path)


def to_metres(objects: DataFrame, tiles: DataFrame) -> DataFrame:
    """Pixel places (down from the upper left corner) to metres; tiles: tile, x0, y0, res. Few tiles, each small."""
    moved = F.transform("points", lambda p: G.point(F.col("x0") + p["x"] * F.col("res"), F.col("y0") - p["y"] * F.col("res")))
    return objects.join(tiles.select("tile", "x0", "y0", "res"), "tile").withColumn("points", moved).drop("x0", "y0", "res")


def layers(objects: DataFrame) -> dict[str, DataFrame]:
    """canopies, rows, interrows and waste, each with its columns, from objects in metres."""
    a, ring = F.col("attrs"), F.col("points")
    of = lambda label: objects.where(F.col("label") == label)
    return {
        "canopies": of("vineyard").select(a["vineyard_id"].alias("vineyard_id"), "tile", F.round(G.area(ring), 3).alias("area_m2"), "points"),
        "rows": of("row").select(a["vineyard_id"].alias("vineyard_id"), a["row_id"].alias("row_id"), a["row_structure"].alias("row_structure"), "tile", F.round(G.length(ring), 2).alias("length_m"), "points"),
        "interrows": of("interrow_area").select(a["vineyard_id"].alias("vineyard_id"), a["interrow_cover"].alias("interrow_cover"), "tile", F.round(G.area(ring), 3).alias("area_m2"), "points"),
        "waste": of("waste").select(a["vineyard_id"].alias("vineyard_id"), "tile", G.centroid(ring)["x"].alias("cx"), G.centroid(ring)["y"].alias("cy"), "points"),
    }
