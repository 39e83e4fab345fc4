"""Ordered folds and searches, which SQL doesn't express, against plain loops; the queries themselves too."""

import itertools
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from terrane import plans
from terrane.operators import graph, matching, routes, selection

SF = "/root/testdata/sf0.001"


def read(table, *columns):
    return duckdb.sql(f"SELECT {', '.join(columns)} FROM read_parquet('{SF}/{table}.parquet') ORDER BY 1").fetchall()


def iou(p, q):
    w, h = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
    shared = max(0, w) * max(0, h)
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    return shared, shared / (area(p) + area(q) - shared + 1e-12), shared / max(min(area(p), area(q)), 1e-12)


def test_suppression_query(spark):
    kept = {}
    for tile in (0, 1):
        boxes = [(-(k * 31 % 101) / 101, k, (k * 7919 % 1000, k * 104729 % 997, k * 7919 % 1000 + 60, k * 104729 % 997 + 60)) for (k,) in read("customer", "c_custkey") if k % 2 == tile]
        kept[tile] = []
        for _, k, b in sorted(boxes):
            if all(iou(b, o)[1] < 0.3 and iou(b, o)[2] < 0.8 for _, o in kept[tile]):
                kept[tile].append((k, b))
    got = sorted((r.tile, r.c_custkey) for r in plans.QUERIES["q25_nms"](spark, SF).collect())
    assert got == sorted((t, k) for t, rows in kept.items() for k, _ in rows)


def test_shortest_ways_query(spark):
    keys = [k for (k,) in read("part", "p_partkey")]
    side = max(2, int(len(keys) ** 0.5))
    cost = {(k // side, k % side): 1.0 if k % side % 4 == 0 else 20.0 for k in keys if not (k // side % 5 == 3 and k % side % 7 != 2)}
    sites = [k for (k,) in read("supplier", "s_suppkey")]
    expected = {}
    for s in [k for k in sites if k % 25 == 1][:4]:
        at = (s // side, s % side)
        if at not in cost:
            continue
        best, changed = {at: 0.0}, True
        while changed:  # relaxation until nothing changes
            changed = False
            for (r, c), d in list(best.items()):
                for dr, dc in itertools.product((-1, 0, 1), repeat=2):
                    to = (r + dr, c + dc)
                    if (dr or dc) and to in cost:
                        e = d + (cost[r, c] + cost[to]) / 2 * math.hypot(dr, dc) * 0.5
                        if e < best.get(to, 1500.0) - 1e-12:
                            best[to], changed = e, True
        expected |= {(s, t): best[t // side, t % side] for t in sites if (t // side, t % side) in best}
    got = {(r.src, r.dst): r.d for r in plans.QUERIES["q38_dijkstra_small"](spark, SF).collect()}
    assert got.keys() == expected.keys() and all(v == pytest.approx(expected[k], abs=1e-5) for k, v in got.items())


def test_tour_query(spark):
    sites = {}
    for k, n in read("supplier", "s_suppkey", "s_nationkey"):
        sites.setdefault(n, []).append((k, k * 6151 % 1000, k * 3571 % 997))
    got = {}
    for r in plans.QUERIES["q39_tsp_2opt"](spark, SF).collect():
        got.setdefault(r.s_nationkey, []).append((r.seq, r.s_suppkey, r.leg))
    assert got.keys() == sites.keys()
    for n, rows in got.items():
        place = {k: (x, y) for k, x, y in sites[n]}
        order = [k for _, k, _ in sorted(rows)]
        assert sorted(order) == sorted(place)
        length = lambda o: sum(math.dist(place[a], place[b]) for a, b in zip(o, [*o[1:], o[0]], strict=True))  # noqa: E731,B023
        if len(order) <= 6:
            best = min(length([order[0], *p]) for p in itertools.permutations(order[1:]))
            assert length(order) <= 1.1 * best + 1e-6  # 2-opt is a local search
        assert all(d == pytest.approx(math.dist(place[order[s - 1]], place[k]) if s else 0.0, abs=1e-5) for s, k, d in rows)


def test_boxes_by_area(spark):
    boxes = [(k % 3, k, float(k * 17 % 90), float(k * 29 % 90), float(k * 17 % 90 + 8 + k % 13), float(k * 29 % 90 + 8 + k % 7)) for k in range(150)]
    kept = set()
    for t in range(3):
        here = []
        for *_, k, b in sorted((-(b[2] - b[0]) * (b[3] - b[1]), k, b) for g, k, *b in boxes if g == t):
            if all(iou(b, o)[1] < 0.3 for _, o in here):
                here.append((k, b))
        kept |= {(t, k) for k, _ in here}
    df = spark.createDataFrame(boxes, "tile int, k int, x0 double, y0 double, x1 double, y1 double")
    assert {tuple(r) for r in selection.by_area(df, "tile", "k").collect()} == kept


def test_anchors_taken_together(spark):
    # The second is close and all its targets are in the first's reach; the third has one that isn't; the fourth is far.
    rows = [(1, 1, 0.0, 0.0, 0.0, 1.0), (1, 1, 0.0, 0.0, 1.0, 0.0), (1, 2, 1.0, 0.0, 1.5, 0.0), (1, 3, 0.0, 2.0, 0.0, 3.9), (1, 4, 50.0, 0.0, 50.0, 0.0), (2, 5, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "g int, anchor int, ax double, ay double, x double, y double")
    assert {(r.g, r.anchor): r.stands for r in selection.merge_anchors(df, "g", 2.0).collect()} == {(1, 1): 1, (1, 2): 1, (1, 3): 3, (1, 4): 4, (2, 5): 5}


def test_budget(spark):
    stops = [(g, i, float(i * 37 % 50), float(i * 53 % 40)) for g in (1, 2) for i in range(9)]
    length = lambda o: sum(math.dist(a[2:], b[2:]) for a, b in zip(o, o[1:], strict=False))
    budget = {1: 120.0, 2: 1e9}
    expected = set()
    for g in (1, 2):
        order = [s for s in stops if s[0] == g]
        while length(order) > budget[g]:
            gains = [(math.dist(a[2:], s[2:]) + math.dist(s[2:], b[2:]) - math.dist(a[2:], b[2:])) for a, s, b in zip(order, order[1:], order[2:], strict=False)]
            order.pop(1 + max(range(len(gains)), key=lambda i: (round(gains[i], 9), -order[i + 1][1])))
        expected |= {s[:2] for s in order}
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    df = spark.createDataFrame(stops, "g int, i int, x double, y double")
    kept = routes.within_budget(df, "g", "i", "i", F.lit(1.0), F.when(F.col("g") == 1, 120.0).otherwise(1e9))
    assert {(r.g, r.i) for r in kept.collect()} == expected


def test_cover_items(spark):
    pairs = [(g, i, s) for g in (1, 2) for i in range(20) for s in range(8) if (i * 5 + s * 3 + g) % 7 < 2]
    got = graph.cover_items(spark.createDataFrame(pairs, "g int, item int, place int"), "g", "item", "place").collect()
    assert {(r.g, r.item) for r in got} == {p[:2] for p in pairs} and {tuple(r) for r in got} <= set(pairs)


def test_contested_assignment(spark):
    rows = [(1, a, b, ((a * 13 + b * 7 + a * b * 5) % 17) / 17) for a in range(5) for b in range(5)]
    got = matching.match_one_to_one(spark.createDataFrame(rows, "t int, a int, b int, w double"), "t", "a", "b", "w", 0.0).collect()
    w = {(a, b): v for _, a, b, v in rows}
    best = max(sum(w[a, p[a]] for a in range(5)) for p in itertools.permutations(range(5)))
    assert sum(r.w for r in got) == pytest.approx(best)
