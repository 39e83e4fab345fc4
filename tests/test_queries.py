"""Each query against the same in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from terrane import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(plain(float(r[i]) if isinstance(r[i], float) else r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query(spark, duck, name):
    ours = plans.QUERIES[name](spark, SF)
    theirs = duck.execute(plans.ORACLE[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    assert rows(ours.columns, ours.collect()) == rows(columns, theirs.fetchall())


def test_clip_takes_all_customers(spark, tmp_path):
    keys = [1, 17, 2999, 3000, 3001, 15_000, 150_017, 9_999_999]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.c_custkey: r.shared for r in plans.QUERIES["q18_convex_clip_area"](spark, str(tmp_path)).collect()}
    assert sorted(got) == keys
    # The area in a quadrant by midpoints of thin columns; the integrand is piecewise linear and bends at whole numbers.
    for k in keys:
        r, h = 5 + k % 20, 1 + k % 17
        assert got[k] == pytest.approx(4 * sum(max(0, min(h, r - (x + 0.5) / 100)) for x in range(100 * h)) / 100, abs=1e-4)


def test_mismatches_take_all_parcels(spark):
    sf = SF.replace("0.001", "0.01")
    read = lambda t, *c: duckdb.sql(f"SELECT {', '.join(c)} FROM read_parquet('{sf}/{t}.parquet') ORDER BY 1").fetchall()
    parts, keys = read("part", "p_partkey", "p_size"), [k for (k,) in read("supplier", "s_suppkey")]
    assert max(k for k, _ in parts) >= 400
    blocks = [(k * 37 % 409, k * 91 % 401, k * 37 % 409 + 10 + k % 7, k * 91 % 401 + 8 + k % 5) for k in keys]
    expected, n = {}, 0
    for k, size in parts:
        x, y = k % 20 * 21, k // 20 * 21
        covered = sum(max(0, min(x1, x + 20) - max(x0, x)) * max(0, min(y1, y + 20) - max(y0, y)) for x0, y0, x1, y1 in blocks)
        if size % 5 and covered / 400 < 0.02:
            n += 1
            expected[k] = (400.0, covered / 4, f"B{n:02}")
    got = {r.object: (r.area, r.share_pct, r.item_id) for r in plans.QUERIES["q36_register_mismatch"](spark, sf).where("kind = 'B'").collect()}
    assert got.keys() == expected.keys() and max(got) >= 400
    assert all(got[k][::2] == v[::2] and got[k][1] == pytest.approx(v[1], abs=0.051) for k, v in expected.items())


def test_spatial_joins_have_keys(spark):
    for name in ("q13_median_spacing", "q14_nearest_within", "q15_pip_else_nearest", "q16_max_overlap", "q20_line_clip_length"):
        plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Inner\n" not in plan, name


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
