"""Intervals, linking, sources, sinks and streams on inline cases."""

import struct

import pytest
from pyspark.sql import functions as F

from terrane.functions import geometry as G
from terrane.operators import intervals, matching, reports, versions
from terrane.sources import annotations, geojson, rasters, registry
from terrane.streaming import events


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_intervals(spark):
    df = frame(spark, [("a", 0.0, 2.0), ("a", 2.0, 3.0), ("a", 7.0, 8.0), ("b", 1.0, 2.0)], "k string, lo double, hi double")
    merged = {(r.k, r.lo, r.hi, r.n) for r in intervals.merge(df, ["k"]).collect()}
    assert merged == {("a", 0.0, 3.0, 2), ("a", 7.0, 8.0, 1), ("b", 1.0, 2.0, 1)}
    assert [(r.k, r.gap) for r in intervals.gaps(df, ["k"], 4.0).collect()] == [("a", 4.0)]
    assert {r.k: r.longest_gap for r in intervals.longest_gap(df, ["k"], F.lit(0.0), F.lit(20.0)).collect()} == {"a": 12.0, "b": 18.0}
    assert {(r.k, r.lo, r.hi) for r in intervals.complement(df, ["k"], F.lit(0.0), F.lit(10.0)).collect()} == {("a", 3.0, 7.0), ("a", 8.0, 10.0), ("b", 0.0, 1.0), ("b", 2.0, 10.0)}
    empty = df.where("false")
    assert intervals.merge(empty, ["k"]).count() == intervals.gaps(empty, ["k"], 1.0).count() == 0


def test_runs(spark):
    df = frame(spark, [("a", i, i not in (2, 3, 6)) for i in range(8)], "k string, i int, ok boolean")
    assert [(r.run, r.n, r.first_i) for r in intervals.runs(df, ["k"], ["i"], F.col("ok")).orderBy("run").collect()] == [(1, 2, 0), (2, 2, 4), (3, 1, 7)]
    assert [r.failed_at for r in intervals.first_failure(df, ["k"], "i", ~F.col("ok"), 2).collect()] == [3]


def test_linking_and_suppression(spark):
    c = frame(spark, [("g", 1, 1, 2, 0, 0.1), ("g", 1, 1, 3, 0, 0.2), ("g", 2, 1, 3, 0, 0.3), ("g", 3, 1, 1, 0, 0.4)], "g string, a int, a_end int, b int, b_end int, cost double")
    assert sorted((r.a, r.b) for r in matching.link_greedily(c, "g").collect()) == [(1, 2), (2, 3)]
    b = frame(spark, [("t", 1, 0.9, 0.0, 0.0, 10.0, 10.0), ("t", 2, 0.8, 1.0, 1.0, 10.0, 10.0), ("t", 3, 0.7, 20.0, 0.0, 30.0, 10.0)], "t string, k int, s double, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.k for r in matching.suppress(b, "t", "k", "s", 0.5).collect()) == [1, 3]
    p = frame(spark, [("t", 1, 0.0, 5.0), ("t", 2, 4.0, 20.0), ("t", 3, 21.0, 22.0)], "t string, k int, lo double, hi double")
    assert sorted(r.k for r in matching.keep_disjoint(p, "t", "k").collect()) == [2, 3]


def test_versions(spark):
    a = frame(spark, [(1, "x", 3), (1, "y", 5), (2, "z", 1)], "k int, v string, n int")
    assert sorted((r.k, r.v) for r in versions.keep_largest(a, ["k"], "n", "v").collect()) == [(1, "y"), (2, "z")]
    assert [r.k for r in versions.duplicates(a, ["k"]).collect()] == [1]
    assert sorted(r.v for r in versions.replace_keys(a, frame(spark, [(1, "w", 0)], "k int, v string, n int"), "k").collect()) == ["w", "z"]
    assert versions.reconcile(a, a, "n", 0.01).first()["ok"]


XML = """<annotations><image name="f/r001_c002.tif"><polygon label="vineyard" points="0.0,0.0;10.0,0.0;10.0,10.0"><attribute name="vineyard_id">V01</attribute></polygon>
<polyline label="row" points="0.0,5.0;20.0,5.0"><attribute name="vineyard_id">V01</attribute><attribute name="row_id">V01-R1 &amp; more</attribute><attribute name="row_structure">odd</attribute></polyline>
<box label="waste" xtl="1.0" ytl="2.0" xbr="3.0" ybr="4.0"><attribute name="vineyard_id"></attribute></box></image><image name="empty.tif"></image></annotations>"""


def test_annotations(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    objects = annotations.read(spark, str(tmp_path / "a.xml"))
    assert sorted(r.label for r in objects.collect()) == ["row", "vineyard", "waste"]
    assert [r.violation for r in annotations.violations(objects, 15.0, 15.0).where("type = 'polyline'").orderBy("violation").collect()] == ["outside the tile", "row_structure not allowed"]
    annotations.write(objects, str(tmp_path / "out"))
    again = annotations.read(spark, str(tmp_path / "out"))
    assert sorted(map(str, again.collect())) == sorted(map(str, objects.collect()))
    tiles = frame(spark, [("f/r001_c002.tif", 100.0, 200.0, 0.5)], "tile string, x0 double, y0 double, res double")
    layers = annotations.layers(annotations.to_metres(objects, tiles))
    assert layers["rows"].first()["length_m"] == 10.0 and layers["canopies"].first()["area_m2"] == 12.5
    assert annotations.merge([objects, objects.limit(1)]).count() == 3


def test_geojson(spark, tmp_path):
    p = tmp_path / "l.geojson"
    p.write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"id":"a","n":1},"geometry":{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,2],[0,0]]]}},{"type":"Feature","properties":{"id":"b"},"geometry":{"type":"LineString","coordinates":[[0,0],[3,4]]}},{"type":"Feature","properties":{"id":"c"},"geometry":{"type":"Point","coordinates":[1,2]}}]}')
    rows = geojson.read(spark, str(p), "id string, n int")
    got = {r.id: r for r in rows.select("id", "n", F.when(F.col("geometry_type") == "Polygon", G.area(F.col("points"))).otherwise(G.length(F.col("points"))).alias("v"), F.size("points").alias("k")).collect()}
    assert (got["a"].v, got["b"].v, got["c"].k, got["b"].n) == (4.0, 5.0, 1, None)
    text = geojson.collection(rows.where("id = 'a'").select("id", geojson.feature([F.col("id")], "Polygon", F.col("points")).alias("f")), "f", "id").first()["value"]
    (tmp_path / "again.geojson").write_text(text)
    assert geojson.read(spark, str(tmp_path / "again.geojson"), "id string").select(G.area(F.col("points")).alias("v")).first()["v"] == 4.0
    back = rows.select(geojson.expand(geojson.compact(F.col("points"))).alias("p"), "points").collect()
    assert all(r.p == r.points for r in back)
    lines = [r.value for r in geojson.csv_lines(frame(spark, [("x", [1, 2], None), ('q"', [3], 1)], "a string, b array<int>, c int"), ["a", "b", "c"], ["source: test"], ["a"]).collect()]
    assert lines == ["# source: test", "a,b,c", '"q""",3,1', "x,1; 2,"]
    packed = geojson.bins(frame(spark, [("a", 5), ("b", 6), ("c", 4), ("d", 20)], "n string, s long"), "n", "s", 10)
    assert [(r.name, r.part) for r in packed.collect()] == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]


def tiff(width, height):
    pixels = bytes(range(256))[: width * height * 3]
    entries = [(256, 3, 1, width), (257, 3, 1, height), (259, 3, 1, 1), (277, 3, 1, 3), (273, 4, 1, 8), (279, 4, 1, len(pixels))]
    at = 8 + len(pixels)
    extra = at + 2 + 12 * 8 + 4
    entries += [(33550, 12, 3, extra), (33922, 12, 6, extra + 24)]
    body = b"".join(struct.pack("<HHII", *e) if e[1] != 3 else struct.pack("<HHIHH", *e, 0) for e in entries)
    return struct.pack("<2sHI", b"II", 42, at) + pixels + struct.pack("<H", len(entries)) + body + struct.pack("<I", 0) + struct.pack("<9d", 0.025, 0.025, 0, 0, 0, 0, 500.0, 900.0, 0)


def test_tiles(spark, tmp_path):
    (tmp_path / "x_r003_c004.tif").write_bytes(tiff(5, 4))
    r = rasters.catalogue(spark, str(tmp_path)).first()
    assert (r.row, r.col, r.x0, r.y0, r.res, r.width, r.height) == (3, 4, 500.0, 900.0, 0.025, 5, 4)
    assert rasters.pixels(tiff(5, 4)).shape == (4, 5, 3)
    points = frame(spark, [(1, 500.06, 899.95), (2, 400.0, 900.0)], "id int, px double, py double")
    assert [p.id for p in rasters.tile_at(points, rasters.catalogue(spark, str(tmp_path)), "px", "py").collect()] == [1]
    (tmp_path / "odd.tif").write_bytes(tiff(5, 4))
    with pytest.raises(Exception, match="unexpected tile name"):
        rasters.catalogue(spark, str(tmp_path)).collect()


def test_registry(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text("﻿ vineyard_id ,variety,declared_area_ha,planting_year,demo\n v01 , Merlot ,\"1,5\",2004,da\n,x,1,2000,\nv02,,n/a,,\n", encoding="utf-8")
    rows = {r.vineyard_id: r for r in registry.read_csv(spark, str(p)).collect()}
    assert set(rows) == {"V01", "V02"}
    assert (rows["V01"].variety, rows["V01"].declared_area_ha, rows["V01"].planting_year, rows["V01"].demo) == ("Merlot", 1.5, 2004, True)
    assert (rows["V02"].variety, rows["V02"].declared_area_ha, rows["V02"].rvv_code, rows["V02"].demo) == (None, None, "—", False)


def test_numbering(spark):
    b = frame(spark, [(i, float(i % 3), float(i * 10)) for i in range(12)], "k int, x double, y double")
    ids = [r.block_id for r in reports.number_blocks(b, "x", "y", "k").orderBy("block_no").collect()]
    assert ids[0] == "V01" and ids[-1] == "V12"


def test_streams(spark, tmp_path):
    import datetime as dt

    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [(i, t(i * 20), 1, "view", 1.0) for i in range(6)] + [(5, t(100), 1, "view", 1.0)]
    frame(spark, rows, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    q = events.counts(events.once(events.stream(spark, str(tmp_path / "in"))), late=None).writeStream.format("memory").queryName("counted").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counted").columns == ["start", "event_type", "n", "value"]
