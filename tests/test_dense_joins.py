"""Joins of points with rings and of segments with boxes where many lie over each other, against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terrane import plans
from terrane.operators import spatial

SF = "/root/testdata/sf0.001"
RING = "ring array<struct<x:double,y:double>>"


def from_ring(x, y, ring):
    inside, least = False, math.inf
    for (ax, ay), (ex, ey) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (ay > y) != (ey > y) and x < (ex - ax) * (y - ay) / (ey - ay) + ax:
            inside = not inside
        n = (ex - ax) ** 2 + (ey - ay) ** 2
        t = min(max(((x - ax) * (ex - ax) + (y - ay) * (ey - ay)) / n, 0), 1) if n else 0
        least = min(least, math.hypot(x - ax - t * (ex - ax), y - ay - t * (ey - ay)))
    return 0 if inside else least


def inside_box(ax, ay, ex, ey, x0, y0, x1, y1):
    begin, end = 0, 1
    for a, e, low, high in ((ax, ex, x0, x1), (ay, ey, y0, y1)):
        if a == e:
            if not low <= a <= high:
                return 0
            continue
        s, t = sorted(((low - a) / (e - a), (high - a) / (e - a)))
        begin, end = max(begin, s), min(end, t)
    return max(end - begin, 0) * math.hypot(ex - ax, ey - ay)


@pytest.mark.parametrize("name", ["q15_pip_else_nearest", "q20_line_clip_length"])
def test_pairs_are_no_rows(spark, name):
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "CoGroup" in plan


def test_nearest_of_many_rings(spark):
    dice = random.Random(5)
    points = [(i, float(dice.randint(-60, 60)), float(dice.randint(-60, 60))) for i in range(300)] + [(300, None, 1.0), (None, 1.0, 1.0), (301, 500.0, 500.0)]
    rings = []
    for k in range(120):
        x, y, n = dice.randint(-50, 50), dice.randint(-50, 50), dice.randint(1, 7)
        rings.append((k, [(x + dice.randint(2, 15) * math.cos(6.28 * i / n), y + dice.randint(2, 15) * math.sin(6.28 * i / n)) for i in range(n)]))
    # The same ring under two keys, points on its edges, an empty ring and none.
    rings += [(k, [(-70.0, -70.0), (-40.0, -70.0), (-40.0, -40.0), (-70.0, -40.0)]) for k in (501, 500)] + [(600, []), (601, None)]
    boxed = spark.createDataFrame([(k, r, *(f(p[i] for p in r) if r else 0.0 for f in (min, max) for i in (0, 1))) for k, r in rings], f"k long, {RING}, x0 double, y0 double, x1 double, y1 double")
    found = spatial.nearest_ring(spark.createDataFrame(points, "p long, x double, y double"), boxed, 3.0, "p", ("x", "y"), "k", "ring", ("x0", "y0", "x1", "y1"), 25.0)
    got = {r.p: (r.k, r.dist) for r in found.collect()}
    expected = {p: min((from_ring(x, y, r), k) for k, r in rings if r) for p, x, y in points if p is not None and x is not None}
    expected = {p: (k, d) for p, (d, k) in expected.items() if d <= 3}
    assert {p: k for p, (k, _) in got.items()} == {p: k for p, (k, _) in expected.items()}
    assert all(got[p][1] == pytest.approx(d, abs=1e-9) for p, (_, d) in expected.items())
    assert any(d > 0 for _, d in got.values()) and any(d == 0 for _, d in got.values())


def test_lengths_in_many_boxes(spark):
    dice = random.Random(6)
    at = lambda: float(dice.randint(-80, 80))
    lines = [(at(), at(), at(), at()) for _ in range(200)]
    lines += [(x, y, x, e) for x, y, _, e in lines[:40]] + [(x, y, e, y) for x, y, e, _ in lines[:40]] + [(5.0, 5.0, 5.0, 5.0), (None, 1.0, 2.0, 3.0)]
    boxes = [(k, x, y, x + dice.randint(0, 70), y + dice.randint(0, 70)) for k, x, y in ((k, at(), at()) for k in range(60))] + [(99, None, 0.0, 1.0, 1.0), (100, 900.0, 900.0, 910.0, 910.0)]
    found = spatial.clipped_length(spark.createDataFrame(lines, "x double, y double, ex double, ey double"), spark.createDataFrame(boxes, "k long, x0 double, y0 double, x1 double, y1 double"), 20.0, ("x", "y", "ex", "ey"), "k", ("x0", "y0", "x1", "y1"))
    got = {r.k: (r.n, r.length) for r in found.collect()}
    for k, *box in boxes:
        lengths = [] if box[0] is None else [d for d in (inside_box(*line, *box) for line in lines if line[0] is not None) if d > 0]
        assert got.get(k, (0, 0)) == (len(lengths), pytest.approx(sum(lengths), abs=1e-6)), k
    assert found.where("k >= 99").count() == 0 and got


def test_nothing_to_meet(spark):
    points = spark.createDataFrame([(1, 2.0, 3.0)], "p long, x double, y double")
    rings = spark.createDataFrame([], f"k long, {RING}, x0 double, y0 double, x1 double, y1 double")
    box = ("x0", "y0", "x1", "y1")
    assert spatial.nearest_ring(points, rings, 3.0, "p", ("x", "y"), "k", "ring", box, 25.0).count() == 0
    lines = points.select("x", "y", F.col("x").alias("ex"), (F.col("y") + 1).alias("ey"))
    assert spatial.clipped_length(lines, rings.drop("ring"), 20.0, ("x", "y", "ex", "ey"), "k", box).count() == 0
