import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.functions import geometry as G
from terrane.functions import scalars as S
from terrane.operators import graph, matching, raster
from terrane.operators.union_area import union_area


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def ring(*points):
    return G.line(*(G.point(F.lit(float(x)), F.lit(float(y))) for x, y in points))


def test_area_far_from_the_origin(spark):
    far = [(600000 + x, 5200000 + y) for x, y in ((0, 0), (3, 0), (3, 2), (0, 2))]
    assert value(spark, G.area(ring(*far))) == 6.0
    c = value(spark, G.centroid(ring(*far)))
    assert (c["x"], c["y"]) == pytest.approx((600001.5, 5200001.0), abs=1e-6)


def test_contains_and_distance(spark):
    square = ring((0, 0), (10, 0), (10, 10), (0, 10))
    at = lambda x, y: value(spark, G.ring_distance(square, G.point(F.lit(float(x)), F.lit(float(y)))))
    assert at(5, 5) == 0 and at(13, 14) == 5 and at(5, -2) == 2


def test_clipping(spark):
    square, moved = ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((2, 2), (6, 2), (6, 6), (2, 6))
    assert value(spark, G.area(G.convex_intersection(square, moved))) == 4
    assert value(spark, F.size(G.convex_intersection(square, ring((8, 8), (9, 8), (9, 9))))) == 0


def test_lines(spark):
    route = ring((0, 0), (10, 0), (10, 10))
    assert value(spark, G.length(route)) == 20
    assert value(spark, G.project(route, G.point(F.lit(12.0), F.lit(4.0)))) == 14
    assert value(spark, G.share_within(ring((0, 0), (10, 0)), ring((0, 0.3), (5, 0.3)), 0.4, 0.05)) == pytest.approx(0.52, abs=0.02)
    assert value(spark, G.angle_difference(F.lit(178.0), F.lit(3.0))) == 5
    assert value(spark, G.equal_within(route, route, 0.0)) and not value(spark, G.equal_within(route, ring((0, 0), (1, 1)), 5.0))


@pytest.mark.parametrize(("share", "status"), [(0.0999, "green"), (0.10, "yellow"), (0.30, "yellow"), (0.3001, "red")])
def test_status_bounds(spark, share, status):
    assert value(spark, S.block_status(F.lit(share))) == status


@pytest.mark.parametrize(("deviation", "expected"), [(0.10, "pass"), (-0.20, "warn"), (0.21, "fail")])
def test_tolerance_bounds(spark, deviation, expected):
    assert value(spark, S.tolerance_class(F.lit(deviation), 0.10, 0.20)) == expected


def test_scores(spark):
    assert value(spark, S.f1(F.lit(0), F.lit(0), F.lit(0))) == 1.0
    assert value(spark, S.count_score(F.lit(3), F.lit(0), 0.5)) == 0.0
    assert value(spark, S.share(F.lit(3.0), F.lit(0.0))) == 0.0


def test_union_area():
    square = np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float)
    assert union_area([square, square + 2]) == pytest.approx(28)
    assert union_area([square, np.array([(0, 0), (4, 4), (8, 0)], float)]) == pytest.approx(16 + 16 - 8)
    assert union_area([]) == 0
    rng = np.random.default_rng(1)
    boxes = [np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], float) for x, y, w, h in rng.integers(1, 20, (12, 4))]
    cells = {(i, j) for b in boxes for i in range(int(b[0, 0]), int(b[1, 0])) for j in range(int(b[0, 1]), int(b[2, 1]))}
    assert union_area(boxes) == pytest.approx(len(cells))


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(3)
    for n, m in ((3, 3), (3, 5), (5, 2), (1, 1)):
        w = rng.random((n, m))
        best = max(sum(w[i, j] for i, j in zip(range(n), p, strict=False)) for p in permutations(range(m), min(n, m))) if n <= m else max(sum(w[i, j] for i, j in zip(p, range(m), strict=False)) for p in permutations(range(n), m))
        assert sum(w[i, j] for i, j in matching.assignment(w)) == pytest.approx(best)


def test_graph_kernels():
    g = graph.Csr(np.array([0, 1, 0]), np.array([1, 2, 2]), np.array([1.0, 1.0, 5.0]), 3)
    d, before = g.distances(0)
    assert d.tolist() == [0, 1, 2] and g.path(before, 2) == [0, 1, 2]
    assert math.isinf(g.distances(0, 1.5)[0][2])
    assert graph.pull(9, lambda i, j: True) == [0, 8]
    assert graph.pull(9, lambda i, j: j == i + 1) == list(range(9))
    assert graph.pull(9, lambda i, j: not i < 4 < j) == [0, 4, 8]
    items = {i: {s for s in range(6) if (i * 7 + s * 5) % 4 < 2} for i in range(30)}
    chosen = graph.cover(items)
    assert chosen.keys() == {i for i, s in items.items() if s} and all(s in items[i] for i, s in chosen.items())
    p = np.array([(0, 0), (0, 10), (10, 10), (10, 0), (5, 12)], float)
    d = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))
    order = graph.tour(d)
    from itertools import permutations

    length = lambda o: sum(d[a, b] for a, b in zip(o, [*o[1:], o[0]], strict=True))
    assert length(order) == pytest.approx(min(length([0, *r]) for r in permutations(range(1, 5))))
    assert graph.drop_to_budget(order, d, 1.0) == [0]
    assert set(graph.cover({1: {7, 8}, 2: {7}, 3: {8, 9}}).values()) <= {7, 8, 9}


def test_raster_kernels():
    mask = np.zeros((60, 80), bool)
    mask[10:20, 10:30] = mask[40:50, 50:60] = True
    mask[5, 5] = True
    assert raster.opened(mask, 3)[12, 15] and not raster.opened(mask, 3)[5, 5]
    assert raster.labelled(mask)[1] == 3
    assert sorted(round(b["area_m2"], 2) for b in raster.blobs(mask, 0.1)) == [0.01, 1.0, 2.0]
    y = np.arange(400)[:, None] * np.ones((1, 400))
    rows = (y % 25) < 8  # a row every 2.5 m at 10 cm
    direction, share, period = raster.row_direction(rows, 0.1, coarse=5.0, fine=1.0)
    assert min(direction, 180 - direction) <= 1 and share > 0.5 and period == pytest.approx(2.5, abs=0.1)
    assert raster.periodicity(np.zeros(200), 0.1, 1.5, 4.0) == (0.0, 0.0)
    black = np.zeros((50, 50, 3), np.uint8)
    assert not raster.has_image(black).any()
