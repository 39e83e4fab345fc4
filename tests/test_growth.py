"""What holds when tables grow: plans that send no side to every task, and results beyond what small tables have."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from terrane import plans
from terrane.functions import geometry as G
from terrane.operators import matching, routes, spatial, union_area, walls

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_grid_costs_send_no_cells_to_every_task(spark):
    assert "Broadcast" not in _plan(plans.QUERIES["q81_grid_costs"](spark, SF))


def test_marked_cells(spark):
    cells = lambda *rows: spark.createDataFrame(rows, "r long, c long")
    found = routes.marked_cells(a=cells((0, 0), (0, 0), (1, 0)), b=cells((1, 0), (2, 2))).collect()
    assert sorted(map(tuple, found)) == [(0, 0, True, False), (1, 0, True, True), (2, 2, False, True)]


def _stars(seed, n):
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        k = rng.integers(3, 9)
        angle = np.sort(rng.uniform(0, 2 * np.pi, k))
        if np.diff([*angle, angle[0] + 2 * np.pi]).max() < np.pi:  # else sides may cross
            r = rng.uniform(2, 10, k)
            p = np.stack([r * np.cos(angle), r * np.sin(angle)], 1) + rng.uniform(-5, 5, 2) + 1000
            out.append(p if rng.random() < 0.5 else p[::-1])
    return out


def test_common_areas_against_slabs():
    ps, qs = _stars(1, 300), _stars(2, 300)
    column = lambda rings: pa.array([[{"x": x, "y": y} for x, y in r] for r in rings])
    shared, apart = union_area.common_areas(column(ps), column(qs))
    for p, q, s, a in zip(ps, qs, shared, apart, strict=True):
        one = union_area.union_area([p])
        expected = one + union_area.union_area([q]) - union_area.union_area([p, q])
        assert abs(s - expected) < 1e-7 and abs(a - (one - expected)) < 1e-7


def test_matching_takes_a_tile_of_many_objects(spark):
    """A table of weights of all objects would take 80 GB."""
    n = 100_000
    c = spark.range(n).selectExpr("'t' AS tile", "id AS l", "id AS r", "0.9D AS w").union(spark.createDataFrame([("t", 0, 1, 0.95), ("t", 1, 0, 0.9)], "tile string, l long, r long, w double"))
    found = matching.match_one_to_one(c, "tile", "l", "r", "w", 0.5)
    assert sorted((r.l, r.r) for r in found.where("l < 2").collect()) == [(0, 1), (1, 0)] and found.count() == n


def test_next_on_axis_against_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(0, 3)), i, float(lo), float(lo + rng.integers(0, 9))) for i, lo in enumerate(rng.integers(0, 60, 200))]
    found = spatial.next_on_axis(spark.createDataFrame(rows, "axis long, k long, lo double, hi double"), "axis", "k", 20.0)
    expected = [(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and 0 <= b[2] - a[3] <= 20 and not any(t[0] == a[0] and a[3] < (t[2] + t[3]) / 2 < b[2] for t in rows if t[1] not in (a[1], b[1]))]
    assert sorted((r.k, r.b_k) for r in found.collect()) == sorted(expected)
    assert "BroadcastNestedLoop" not in _plan(plans.QUERIES["q22_link_candidates"](spark, SF))


def test_nearest_centres_are_found_without_all_pairs(spark):
    p = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 9.0, 0.0), (2, 3, 0.0, 0.0), (3, 4, 0.0, 0.0)], "g long, k long, x double, y double")
    c = spark.createDataFrame([(1, 8, 4.0, 0.0), (1, 7, -4.0, 0.0), (2, 9, 3.0, 4.0)], "g long, c long, cx double, cy double")
    found = spatial.cells_of_centres(p, c, "g", "k", ("x", "y"), "c", ("cx", "cy"))
    assert sorted(map(tuple, found.collect())) == [(1, 1, 7, 4.0), (1, 2, 8, 5.0), (2, 3, 9, 5.0)]
    assert "Join" not in _plan(found)


def test_links_meet_in_small_cells(spark):
    """Pairs in one grid cell of the whole reach, 88 metres, would be all of these 16 million."""
    seg = spark.range(4000).selectExpr("id AS seg", "id % 2 AS tile", "(id % 63) * 1.0D AS ax", "(id DIV 63) * 1.0D AS ay", "(id % 63) + 0.5D AS bx", "(id DIV 63) * 1.0D AS by", "0.0D AS angle")
    found = spatial.link_candidates(seg)
    assert found.where("off <= 0.5 + 0.02 * greatest(gap, 0.0)").count() == found.count() > 4000
    assert "sequence(_fx" in _plan(found) and "87.68" not in _plan(found)


def test_spatial_joins_are_dealt_over_cores(spark):
    plan = _plan(plans.QUERIES["q20_line_clip_length"](spark, SF))
    assert "Broadcast" not in plan and plan.count("REPARTITION_BY_NUM") == 2


def test_point_on_a_slanted_edge_is_as_far_as_sql_says(spark):
    import duckdb

    rows = [(float(x), float(y), r) for x in range(0, 40) for y in range(0, 40) for r in (17.0, 23.0, 41.0)]
    df = spark.createDataFrame(rows, "x double, y double, r double")
    d = G.segment_distance(G.point("x", "y"), G.point(F.col("r"), F.lit(0.0)), G.point(F.lit(0.0), F.col("r")))
    found = sorted(tuple(r) for r in df.select("x", "y", "r", d.alias("d")).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE p(x DOUBLE, y DOUBLE, r DOUBLE)")
    con.executemany("INSERT INTO p VALUES (?, ?, ?)", rows)
    t = "SELECT *, greatest(0, least(1, ((x - ax) * (ex - ax) + (y - ay) * (ey - ay)) / ((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay)))) AS t FROM (SELECT *, r AS ax, 0.0::DOUBLE AS ay, 0.0::DOUBLE AS ex, r AS ey FROM p)"
    assert found == sorted(con.execute(f"SELECT x, y, r, sqrt((x - ax - t * (ex - ax)) * (x - ax - t * (ex - ax)) + (y - ay - t * (ey - ay)) * (y - ay - t * (ey - ay))) FROM ({t})").fetchall())


def test_legs_that_cross_an_axis_beside_their_point_cross_twice(spark):
    route = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 100.25), (2, 10.0, 100.25, 20.0, 0.0)], "leg long, px double, py double, qx double, qy double")
    axes = spark.createDataFrame([(1, -50.0, 100.24, 50.0, 100.24), (2, -50.0, 100.25, 50.0, 100.25)], "row_id long, ax double, ay double, bx double, by double")
    assert sorted(r.row_id for r in walls.crossings(route, axes).collect()) == [1, 1, 2]
