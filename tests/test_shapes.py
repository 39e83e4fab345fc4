import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.functions import geometry as G
from terrane.operators import shapes, walls


def test_kernels():
    p = np.array([(0, 0), (4, 0), (4, 2), (0, 2), (2, 1), (2, 0)], float)
    assert len(shapes.hull(p)) == 4
    turned = p @ np.array([[math.cos(0.5), math.sin(0.5)], [-math.sin(0.5), math.cos(0.5)]])
    assert shapes.rectangle(turned) == pytest.approx((2, 4))
    line = np.array([(0, 0), (1, 0.05), (2, 0), (3, 2), (4, 0)], float)
    assert len(shapes.simplified(line, 0.3)) == 4 and len(shapes.simplified(np.array([(0, 0), (1, 1), (2, 2.0)]), 0)) == 2
    u = np.array([(0, 0), (6, 0), (6, 6), (4, 6), (4, 2), (2, 2), (2, 6), (0, 6)], float)
    x, y = shapes.inner_point(u)
    assert 0 < y < 6 and (0 < x < 2 or 4 < x < 6 or y < 2)
    assert shapes.crosses_itself(np.array([(0, 0), (2, 2), (2, 0), (0, 2)], float)) and not shapes.crosses_itself(u)


def test_columns(spark):
    ring = G.line(*(G.point(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (4, 0), (4, 2), (0, 2))))
    a, b = G.split_parallel(ring, F.lit(0.0))
    r = spark.range(1).select(G.area(a).alias("a"), G.area(b).alias("b"), shapes.measure(lambda p: shapes.rectangle(p)[1], ring).alias("w"), shapes.on_points(shapes.hull, ring).alias("h"), G.utm(F.lit(27.0), F.lit(0.0), 35).alias("o"), G.utm(F.lit(30.0), F.lit(60.0), 35).alias("u")).first()
    assert (r.a, r.b, r.w, len(r.h)) == (4, 4, 4, 4)
    assert (r.o.x, r.o.y) == pytest.approx((500000, 0), abs=1e-6)
    # On the central meridian the northing is the scaled meridian arc; at 60 degrees 3 degrees east the easting is about 667 km.
    assert r.u.x == pytest.approx(667286, abs=30) and r.u.y == pytest.approx(6655205, abs=60)


def test_walls(spark):
    f = lambda rows, s: spark.createDataFrame(rows, s)
    pieces = f([("r", 0.0, 0.0, 20.0, 0.0), ("r", 45.0, 0.3, 30.0, 0.2), ("r", 80.0, 0.0, 90.0, 0.0)], "row_id string, ax double, ay double, bx double, by double")
    assert [(b.ax, b.bx) for b in walls.bridges(pieces).collect()] == [(20.0, 30.0)]
    ends = f([(1, "a", 19.8, 0.0, 1.0, 0.0, True), (2, "b", 31.0, 0.3, -1.0, 0.0, False), (3, "c", 19.7, 9.0, 1.0, 0.0, True), (4, "d", 19.7, 30.0, 1.0, 0.0, False)], "end_id int, row_id string, x double, y double, ux double, uy double, at_edge boolean")
    joined = walls.seams(ends)
    assert [(j.end_id, j.other_id) for j in joined.collect()] == [(1, 2)]
    assert [(e.end_id, e.bx) for e in walls.extensions(ends, joined).collect()] == [(3, 24.7)]
    bridged = f([("c", 19.7, 9.0, 22.0, 9.0)], "row_id string, ax double, ay double, bx double, by double")
    assert walls.extensions(ends, joined, bridged).count() == 0
    behind = f([(1, "a", 10.0, 0.0, 1.0, 0.0, True), (2, "b", 5.0, 0.0, -1.0, 0.0, True)], "end_id int, row_id string, x double, y double, ux double, uy double, at_edge boolean")
    assert walls.seams(behind).count() == 0
    steps = f([(1, 5.0, -1.0, 5.0, 1.0), (2, 5.0, 1.0, 5.0, 3.0)], "step_id int, px double, py double, qx double, qy double")
    assert [s.step_id for s in walls.cut_steps(steps, pieces.drop("row_id")).collect()] == [2]
    targets, cells = f([(7, 0.0, 0.0)], "target_id int, x double, y double"), f([(1, 1.0, 0.0, 20.0), (2, 3.0, 0.0, 1.0)], "cell_id int, cx_m double, cy_m double, cost double")
    assert walls.anchors(targets, cells, 10.0).first().cell_id == 2
    route = f([(1, 5.0, -3.0, 5.0, 0.0), (2, 5.0, 0.0, 5.0, 3.0), (5, 6.0, 3.0, 6.0, -3.0)], "leg int, px double, py double, qx double, qy double")
    assert sorted((c.row_id, c.leg) for c in walls.crossings(route, pieces).collect()) == [("r", 1), ("r", 5)]
    zigzag = f([(1, 5.0, -3.0, 6.0, 3.0), (2, 6.0, 3.0, 9.0, -3.0)], "leg int, px double, py double, qx double, qy double")
    assert walls.crossings(zigzag, pieces).count() == 2
    passage = f([(5.0, -1.0, 6.0, 1.0)], "x0 double, y0 double, x1 double, y1 double")
    assert [c.leg for c in walls.crossings(zigzag, pieces, passage).collect()] == [2]
