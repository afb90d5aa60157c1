"""What the fourth review found: work and memory on larger tables."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomix.plans import catalogue
from oracle import connect, same

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def tables(tmp_path):
    """Writes a table as name.parquet into a folder of its own and gives the folder."""

    def write(**named):
        for name, sql in named.items():
            duckdb.sql(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet'")
        return str(tmp_path)

    return write


def agree(spark, folder, name):
    same(catalogue.QUERIES[name](spark, folder).toPandas(), connect(folder).sql(catalogue.SQL[name]).df())


def test_few_offsets_are_tried_vertex_by_vertex(monkeypatch):
    from fathomix.operators import registration as rg

    rng = np.random.default_rng(2)
    tried, exact = [], rg._misplaced
    monkeypatch.setattr(rg, "_misplaced", lambda *a: tried.append(1) or exact(*a))
    walk = lambda n: np.cumsum(rng.normal(size=(n, 2)) * 8, 0)
    for k in range(8):
        s = walk(400 + 50 * k) + 9e7
        t = [walk(700) + 9e7, s + [3, -2], np.concatenate([s, s])[100:], s[60:] - [4, 1]][k % 4]
        weight = rg.overlaps(len(s), len(t)) * np.log(rg.overlaps(len(s), len(t)) + 1)
        want = rg.sliding_sums(s, t, lambda a, b: np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])) / weight
        assert want[rg.least_misplacement(s, t, weight)] == pytest.approx(want.min(), rel=1e-9)
    tried.clear()
    s = walk(6000)
    assert rg.best_match(s, s + [1.5, 0.5], 100.0) == (5998, 0.0)
    assert len(tried) < 600


def test_registration_is_many_tasks(spark):
    """A megabyte of lines is much work: adaptive execution must not put it into one task."""
    df = catalogue.QUERIES["x26_w16_registration"](spark, DATA)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    at = plan.index("FlatMapCoGroupsInPandas")
    assert plan[at : plan.index("== Initial Plan ==")].count("REPARTITION_BY_NUM") == 2


def shuffled_rows(df):
    """The plan without what is broadcast: exchanges that the rows themselves go through."""
    plan, kept, within = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0], [], None
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        if within is not None and depth > within:
            continue
        within = depth if "Broadcast" in line and "Join" not in line else None
        kept.append(line)
    return [k for k in kept if "Exchange hashpartitioning" in k or "Exchange rangepartitioning" in k or "FlatMap" in k]


def test_beams_are_relaunched_where_they_are(spark, monkeypatch, request):
    """Neither shuffled nor grouped; by shuffles, where profiles and times are many, and in small batches the same."""
    from fathomix.operators import beams as bm

    query = catalogue.QUERIES["x21_relaunch"]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    request.addfinalizer(lambda: spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit))
    df = query(spark, DATA)
    want = sorted(map(tuple, df.collect()), key=str)
    assert not shuffled_rows(df)
    for name, few in (("FEW_PROFILES", 0), ("FEW_TIMES", 0), ("AT_ONCE", 700)):
        monkeypatch.setattr(bm, name, few)
    df = query(spark, DATA)
    assert sorted(map(tuple, df.collect()), key=str) == want
    assert shuffled_rows(df)


def test_beams_are_launched_where_they_are(spark):
    df = catalogue.QUERIES["x19_x21_launch_triangles"](spark, DATA)
    df.collect()
    assert not shuffled_rows(df)


def test_a_middle_in_line_with_points_ends(spark):
    """Here the simplex method went round for ever; and no triangle is missed by trying all of them."""
    from fathomix.operators import triangulation as tg

    x, y, lift = np.array([[-0.7, 1.02, 1.02]]), np.array([[-0.7, 0.3, 1.0]]), np.array([[0.98000087, 1.13040094, 2.04040048]])
    assert tg.lowest_triangles(x, y, lift)[0].tolist() == [[-1, -1, -1]]
    rng = np.random.default_rng(6)
    x, y = rng.uniform(-2, 2, (300, 9)), rng.uniform(-2, 2, (300, 9))
    lift = np.where(rng.random((300, 9)) < 0.2, np.nan, x * x + y * y)
    three, weight = tg.lowest_triangles(x, y, lift)
    for n in range(300):
        alone, own = tg._lowest_of_all(x[n], y[n], np.where(np.isnan(lift[n]), np.inf, lift[n]))
        if three[n, 0] < 0:
            assert (alone == 9).all()
        else:
            assert dict(zip(alone.tolist(), own)) == {k: pytest.approx(w, abs=1e-9) for k, w in zip(three[n].tolist(), weight[n])}


def test_triangulated_of_points_on_a_lattice(spark, tables):
    """Points a cell are few and in line with many middles, as at 60 times sf0.1."""
    thin = "SELECT CAST(hash(i, 1) % 3000 AS BIGINT) AS l_suppkey, CAST(hash(i, 2) % 15000 AS BIGINT) AS l_partkey, 100.0 + i % 97 AS l_extendedprice"
    more = "0.0 AS l_discount, 1.0 AS l_quantity, 0.0 AS l_tax, 'A' AS l_returnflag, 'F' AS l_linestatus, 1 AS l_linenumber, TIMESTAMP '1995-01-02' AS l_shipdate, i AS l_orderkey"
    folder = tables(lineitem=f"{thin}, {more} FROM range(14000) r(i)")
    want = connect(folder).sql(catalogue.SQL["x10_triangulated"]).df()
    got = {(r.row, r.col): r.value for r in catalogue.QUERIES["x10_triangulated"](spark, folder).collect()}
    # a middle on an edge may have two triangles in SQL; on the border rounding may leave it none there
    assert all(got[r.row, r.col] == pytest.approx(r.value, abs=1.01e-4) for r in want.itertuples())
    assert len(got) - len(want[["row", "col"]].drop_duplicates()) < 30


def test_holes_are_filled_without_a_join(spark, tables):
    """The tiles know which cells have a value: what is filled isn't sent to be compared with the grid."""
    query = catalogue.QUERIES["x10_x13_inverse_distance_fill"]
    assert "Join" not in query(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    far = f"SELECT * REPLACE (l_extendedprice + 0.00314159 AS l_extendedprice, l_suppkey + CAST(hash(l_orderkey, l_linenumber) % 40 AS BIGINT) * 70 AS l_suppkey, l_partkey + CAST(hash(l_linenumber, l_orderkey) % 30 AS BIGINT) * 450 AS l_partkey) FROM '{DATA}/lineitem.parquet'"
    agree(spark, tables(lineitem=far), "x10_x13_inverse_distance_fill")


@pytest.mark.parametrize("tile", [5, 512])
def test_closing_sends_a_cell_once(spark, monkeypatch, tile):
    """Dilation and erosion in one tile, whatever the tiles: no row a cell of the kernel, no join."""
    from fathomix.operators import stencil as st

    monkeypatch.setattr(st, "CLOSING_TILE", tile)
    rng = np.random.default_rng(9)
    cells = {(int(r), int(c)): float(v) for r, c, v in zip(rng.integers(-9, 12, 150), rng.integers(-5, 30, 150), rng.normal(size=150))}
    df = spark.createDataFrame([(*p, v) for p, v in cells.items()] + [(0, 99, None)], "row int, col int, mean double")
    around = lambda at, k: {(at[0] + i, at[1] + j) for i in range(-k, k + 1) for j in range(-k, k + 1)}
    wide = {q for p in cells for q in around(p, 2)}
    holes = {p for p in wide if around(p, 2) <= wide} - set(cells)
    got = {(r.row, r.col): r["mean"] for r in st.closed(df, "mean", 2).collect()}
    assert got == cells | dict.fromkeys(holes)

    def along(p, axis):
        line = sorted((q[axis], v) for q, v in cells.items() if q[1 - axis] == p[1 - axis])
        lo, hi = [k for k in line if k[0] < p[axis]][-1:], [k for k in line if k[0] > p[axis]][:1]
        if lo and hi and min(p[axis] - lo[0][0], hi[0][0] - p[axis]) <= 3:
            return [lo[0][1] + (hi[0][1] - lo[0][1]) * (p[axis] - lo[0][0]) / (hi[0][0] - lo[0][0])]
        return []

    want = {p: np.mean(v) for p in holes if (v := along(p, 0) + along(p, 1))}
    query = st.bilinear_fill(df, "mean", 2, 3)
    assert {(r.row, r.col): r["mean"] for r in query.collect()} == {p: pytest.approx(v) for p, v in want.items()}
    plan = query._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Union" not in plan
