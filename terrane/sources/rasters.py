"""Georeferenced TIFF tiles: headers and, where plainly stored, pixels."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
#: The TIFF tags that are read.
WIDTH, HEIGHT, COMPRESSION, STRIPS, SAMPLES, STRIP_BYTES, SCALE, TIE = 256, 257, 259, 273, 277, 279, 33550, 33922
CATALOGUE = "tile string, row int, col int, x0 double, y0 double, res double, width int, height int"


def tags(data: bytes) -> dict[int, tuple]:
    """The first directory's tags."""
    e = "<" if data[:2] == b"II" else ">"
    if data[:2] not in (b"II", b"MM") or struct.unpack(e + "H", data[2:4])[0] != 42:
        raise ValueError("no TIFF")
    at = struct.unpack(e + "I", data[4:8])[0]
    out = {}
    for i in range(struct.unpack(e + "H", data[at : at + 2])[0]):
        tag, kind, n = struct.unpack(e + "HHI", data[at + 2 + 12 * i : at + 10 + 12 * i])
        place = at + 10 + 12 * i
        if kind not in _CODE:
            continue
        if _SIZE[kind] * n > 4:
            place = struct.unpack(e + "I", data[place : place + 4])[0]
        out[tag] = struct.unpack(e + _CODE[kind] * n, data[place : place + _SIZE[kind] * n])
    return out


def pixels(data: bytes) -> np.ndarray:
    """Rows by columns by samples, of 8-bit strips that are stored plainly or deflated."""
    t = tags(data)
    kind = t.get(COMPRESSION, (1,))[0]
    if kind not in (1, 8, 32946):
        raise ValueError(f"compression {kind} needs a codec that isn't here")
    parts = [data[a : a + n] for a, n in zip(t[STRIPS], t[STRIP_BYTES], strict=True)]
    raw = b"".join(p if kind == 1 else zlib.decompress(p) for p in parts)
    return np.frombuffer(raw, np.uint8).reshape(t[HEIGHT][0], t[WIDTH][0], t.get(SAMPLES, (1,))[0])


def catalogue(spark: SparkSession, folder: str, pattern: str = r"r(\d{3})_c(\d{3})", strict: bool = True) -> DataFrame:
    """The tiles of a folder, by name: grid place from the name (an error without, or 0), corner and resolution from the header."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").load(folder)

    def header(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [tags(bytes(c)) for c in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "x0": [t[TIE][3] for t in found], "y0": [t[TIE][4] for t in found], "res": [t[SCALE][0] for t in found], "width": [t[WIDTH][0] for t in found], "height": [t[HEIGHT][0] for t in found]})

    rows = files.select("path", "content").mapInPandas(header, "path string, x0 double, y0 double, res double, width int, height int")
    name = F.element_at(F.split("path", "/"), -1)
    part = lambda i: F.regexp_extract(name, pattern, i)
    missing = F.raise_error(F.concat(F.lit("unexpected tile name: "), name)) if strict else F.lit(0)
    place = lambda i: F.when(part(i) != "", part(i).cast("int")).otherwise(missing.cast("int"))
    return rows.select(name.alias("tile"), place(1).alias("row"), place(2).alias("col"), "x0", "y0", "res", "width", "height")


def tile_at(points: DataFrame, tiles: DataFrame, x: str, y: str) -> DataFrame:
    """The tile under each point, half open: an equi join on the grid that the tiles share."""
    one = tiles.agg(F.min("x0").alias("_x"), F.max("y0").alias("_y"), F.first(F.col("res") * F.col("width")).alias("_w"), F.first(F.col("res") * F.col("height")).alias("_h"))
    grid = tiles.join(F.broadcast(one)).select("tile", F.round((F.col("x0") - F.col("_x")) / F.col("_w")).cast("long").alias("_i"), F.round((F.col("_y") - F.col("y0")) / F.col("_h")).cast("long").alias("_j"))
    placed = points.join(F.broadcast(one)).withColumn("_i", F.floor((F.col(x) - F.col("_x")) / F.col("_w"))).withColumn("_j", F.floor((F.col("_y") - F.col(y)) / F.col("_h")))
    return placed.join(grid, ["_i", "_j"]).drop("_i", "_j", "_x", "_y", "_w", "_h")
