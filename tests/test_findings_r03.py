"""What the third review found: results at other sizes, and work that grew faster than its input."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomix.operators import triangulation as tg
from fathomix.plans import catalogue
from oracle import connect, same

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def tables(spark, tmp_path):
    """Writes a table as name.parquet into a folder of its own and gives the folder."""

    def write(**named):
        for name, sql in named.items():
            duckdb.sql(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet'")
        return str(tmp_path)

    return write


def agree(spark, folder, name):
    same(catalogue.QUERIES[name](spark, folder).toPandas(), connect(folder).sql(catalogue.SQL[name]).df())


FAR = f"SELECT * REPLACE (CAST(l_suppkey + 60000 * (l_orderkey % 2) AS BIGINT) AS l_suppkey, CAST(l_partkey + 1200000 * (l_orderkey % 2) AS BIGINT) AS l_partkey) FROM '{DATA}/lineitem.parquet'"


def test_shapes_are_read_in_one_pass(spark):
    for name in ("s24_k14_line_shapes", "s24_k15_point_shapes"):
        plan = catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan


@pytest.mark.parametrize("name", ["a09_k10_gridded_csv", "x10_x13_inverse_distance_fill"])
def test_grids_of_any_extent(spark, tables, name):
    agree(spark, tables(lineitem=FAR), name)


def test_histogram_bins_just_below_an_edge(spark, tables):
    agree(spark, tables(embeddings="SELECT CAST(1 AS BIGINT) AS vec_id, [CAST(-1e-9 AS FLOAT), CAST(0.5 AS FLOAT), CAST(1 AS FLOAT)] AS embedding"), "s38_f50_array_histogram")


def test_turns_at_the_threshold(spark, tables):
    agree(spark, tables(events="SELECT * FROM '/root/testdata/sf0.1/events.parquet' WHERE user_id = 439"), "w17_lines_between_turns")


def quadratic_frames(df):
    """Window frames that run to the partition's end from each row, or value ranges around it."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [k for k in ("currentrow$(), unboundedfollowing$()", "RangeFrame, -") if k in plan]


@pytest.mark.parametrize("name", ["x19_x21_launch_triangles", "x21_relaunch", "x09_bilinear_fill", "w01_sliding_mean", "w02_sliding_median", "f16_sliding_normalisation"])
def test_frames_are_not_gone_through_for_every_row(spark, name):
    assert not quadratic_frames(catalogue.QUERIES[name](spark, DATA))


def test_asof_over_slabs(spark):
    from fathomix.operators.temporal import asof

    left = spark.range(200).selectExpr("id % 2 AS k", "CAST(id * 7 % 101 - 50 AS LONG) AS t", "id")
    right = spark.range(12).selectExpr("id % 2 AS k", "CAST(id * 9 - 40 AS LONG) AS t", "IF(id = 5, NULL, id) AS v")
    for strict in (False, True):
        for edges in ("none", "first"):
            a, b = (sorted((tuple(r) for r in asof(left, right, ["k"], "t", "v", strict, edges, slab).select("id", "v").collect()), key=str) for slab in (None, 8))
            assert a == b


def test_closest_and_totals_without_pairs(spark, tables):
    plan = lambda name: catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan("j02_nearest_same_key")
    assert "sequence" not in plan("j09_p25_interval_join")
    same_time = f"SELECT * REPLACE (date_trunc('hour', ts) AS ts, event_id % 9 AS user_id) FROM '{DATA}/events.parquet'"
    agree(spark, tables(events=same_time), "j09_p25_interval_join")


def test_sliding_windows_with_equal_times(spark, tables):
    folder = tables(events=f"SELECT * REPLACE (date_trunc('hour', ts) AS ts) FROM '/root/testdata/sf0.01/events.parquet'")
    for name in ("w01_sliding_mean", "w02_sliding_median"):
        agree(spark, folder, name)


def test_stencils_send_a_row_a_cell(spark):
    """Of a dense grid, what is shuffled after sums by block is cells and the blocks' rims."""
    from fathomix.operators import stencil as st

    cells = spark.range(256 * 256, numPartitions=16).selectExpr("CAST(id DIV 256 AS INT) AS row", "CAST(id % 256 AS INT) AS col", "CAST(id AS DOUBLE) AS mean").repartition(16)
    df = st.convolve(cells, "mean", st.KERNELS["box5"])
    assert df.count() == 256 * 256
    plan = df.select("row", "col").distinct()._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan
    plan = st.nearest_fill(cells.filter("col % 5 != 0"), "mean", 2, cells)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_stencil_queries_on_spread_out_grids(spark, tables):
    folder = tables(lineitem=FAR)
    for name in ("x01_convolve", "x03_box_mean", "x04_neighbour_deviation", "x08_nearest_fill", "x15_peaks_by_deviation"):
        agree(spark, folder, name)


def test_nearest_path_point_without_pairs(spark):
    import numpy as np
    import pandas as pd

    from fathomix.operators.slices import closest_points, nearest_within

    plan = catalogue.QUERIES["j12_nearest_path_point"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    rng = np.random.default_rng(3)
    at, to = rng.uniform(-1, 1, (60, 2)), np.concatenate([rng.uniform(-1, 1, (40, 2)), [[0.0, 0.5], [0.0, 0.5]]])
    d = lambda a, b: 2 * 6371000.0 * np.arcsin(np.sqrt(np.sin(np.radians(b[1] - a[1]) / 2) ** 2 + np.cos(np.radians(a[1])) * np.cos(np.radians(b[1])) * np.sin(np.radians(b[0] - a[0]) / 2) ** 2))
    at = np.concatenate([at, to[-2:]])
    who, how = closest_points(*at.T, *to.T, np.arange(len(to))[::-1])
    want = [min((d(a, b), len(to) - 1 - i, i) for i, b in enumerate(to)) for a in at]
    assert who.tolist() == [w[2] for w in want] and np.allclose(how, [w[0] for w in want])
    points = spark.createDataFrame(pd.DataFrame({"id": range(3), "lon": [0.0, 50.0, np.nan], "lat": [0.0, 50.0, np.nan]})).selectExpr("id", "nullif(lon, double('nan')) AS lon", "lat")
    path = spark.createDataFrame([(7, 0.1, 0.0), (5, 0.1, 0.0)], "path_id long, lon double, lat double")
    got = nearest_within(points, path, 200_000.0).orderBy("id").collect()
    assert [(r["path_id"], r["distance"] is None) for r in got] == [(5, False), (-1, True), (-1, True)]


def test_segments_are_paired_once(spark):
    from fathomix.operators import registration as rg

    lines = spark.createDataFrame([("a", 0, i, 1000.0 * i, 700.0 * i) for i in range(3)], "line string, level int, i int, x double, y double")
    plan = rg.nearest_lines(lines, lines, 100.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "greatest(" in plan
    assert [tuple(r) for r in rg.nearest_lines(lines, lines.selectExpr("'b' AS line", "level", "i", "x + 30 AS x", "y"), 100.0).select("line", "target").collect()] == [("a", "b")]


def test_triangles_are_sought_among_points_only(monkeypatch):
    rng, work, solve = np.random.default_rng(4), [], tg.lowest_triangles
    monkeypatch.setattr(tg, "lowest_triangles", lambda x, *rest: work.append(x.size) or solve(x, *rest))
    at = rng.permutation(100 * 100)[:1500]
    row, col = at // 100, at % 100
    tg.interpolate_cells(row, col, col + rng.uniform(0, 1, 1500), row + rng.uniform(0, 1, 1500), rng.normal(size=1500), (0, 0), (100, 100), 2, block=256)
    assert sum(work) < 1.5 * 25 * 1500


def test_triangulated_on_a_thin_grid(spark, tables):
    far = f"SELECT * REPLACE (CAST(l_suppkey + 100 * (hash(l_orderkey, l_extendedprice, 1) % 4) AS BIGINT) AS l_suppkey, CAST(l_partkey + 600 * (hash(l_orderkey, l_extendedprice, 2) % 24) AS BIGINT) AS l_partkey) FROM '{DATA}/lineitem.parquet'"
    agree(spark, tables(lineitem=far), "x10_triangulated")


def test_ordinary_words_of_templates_take_no_expression(monkeypatch):
    from fathomix.llm import decontaminate as dc

    words = ["word", "Word,", "end.***", "y", "ß", "Two.", "the", "km!", "$5,", "don't", "a%", "end.)"]
    want, seen, edge = [dc._token(w) for w in words], [], dc._EDGE
    monkeypatch.setattr(dc, "_EDGE", type("Edge", (), {"sub": lambda self, by, s: seen.append(s) or edge.sub(by, s)})())
    assert [dc._token(w) for w in words] == want
    assert seen == ["$5,", "don't", "a%", "end.)"]
    assert want[1] & ~63 == dc._token("word") & ~63 and want[5] & dc._STOP and want[1] & dc._CAPITAL


def test_rasters_are_few_files(spark, tables, monkeypatch):
    from fathomix.sources import rasters

    folders, write = [], rasters.write_tiles
    monkeypatch.setattr(rasters, "write_tiles", lambda cells, layer, spec, folder, *rest: folders.append(folder) or write(cells, layer, spec, folder, *rest))
    wide = f"SELECT * REPLACE (CAST(l_suppkey + 100 * (l_orderkey % 8) AS BIGINT) AS l_suppkey, CAST(l_partkey + 600 * (l_linenumber % 24) AS BIGINT) AS l_partkey) FROM '{DATA}/lineitem.parquet'"
    agree(spark, tables(lineitem=wide), "s18_s19_k06_raster_round_trip")
    assert spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").load(folders[0]).count() == 1


def naive(cells, steps):
    """Each cell's present neighbours, cell by cell."""
    return {p: [cells[p[0] + i, p[1] + j] for i, j in steps if (p[0] + i, p[1] + j) in cells] for p in cells}


@pytest.mark.parametrize("tile", [3, 7, 256])
def test_stencils_make_no_row_a_step(spark, monkeypatch, tile):
    """Windows are looked up tile by tile, whatever the tiles; nothing is exploded by the kernel's steps."""
    from fathomix.operators import resample as rs
    from fathomix.operators import stencil as st

    monkeypatch.setattr(st, "TILE", tile)
    rng = np.random.default_rng(5)
    cells = {(int(r), int(c)): float(v) for r, c, v in zip(rng.integers(-9, 12, 260), rng.integers(-5, 30, 260), rng.normal(size=260))}
    df = spark.createDataFrame([(r, c, v, 2 * v) for (r, c), v in cells.items()] + [(0, 99, None, None)], "row int, col int, mean double, stdev double")
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    around, ring = naive(cells, steps), naive(cells, [s for s in steps if s != (0, 0)])
    near = lambda q, want: {(r[0], r[1]): r[2] for r in q.collect()} == {p: pytest.approx(v) for p, v in want.items()}
    assert near(st.convolve(df, "mean", [[1.0] * 3] * 3), {p: np.mean(v) for p, v in around.items()})
    assert near(st.peaks_by_deviation(df.drop("stdev"), "mean", 1.2), {p: v for p, v in cells.items() if abs(v - np.mean(around[p])) > 1.2 * np.std(around[p])})
    assert near(rs.residual_rejection(df, "mean", 1.2), {p: v for p, v in cells.items() if len(ring[p]) > 2 and abs(v - np.mean(ring[p])) > 1.2 * np.std(ring[p])})
    spread_ = {(r.row, r.col): (r.near_stdev, r.near_spread) for r in st.neighbour_deviation(df).collect()}
    assert spread_.pop((0, 99)) == (None, None)
    assert spread_ == {p: pytest.approx((2 * np.mean(v), np.std(v))) if v else (None, None) for p, v in ring.items()}
    assert {tuple(r) for r in st.dilate(df, 2).collect()} == {(r + i, c + j) for r, c in [*cells, (0, 99)] for i in range(-2, 3) for j in range(-2, 3)}
    assert {tuple(r) for r in st.erode(df).select("row", "col").collect()} == {p for p, v in naive(dict.fromkeys([*cells, (0, 99)], 1), steps).items() if len(v) == 9}
    whole = {p for p, v in around.items() if len(v) == 9}
    assert {(r.row, r.col) for r in st.slope_aspect(df, "mean", 1.0, 1.0).collect()} == whole
    for q in (st.convolve(df, "mean", [[1.0] * 3] * 3), st.slope_aspect(df, "mean", 1.0, 1.0), st.neighbour_deviation(df), st.peaks_by_deviation(df, "mean", 1.2), rs.residual_rejection(df, "mean", 1.2)):
        plan = q._jdf.queryExecution().optimizedPlan().toString()
        assert "explode(array" not in plan.lower() and "Aggregate" not in plan and "Join" not in plan


@pytest.mark.parametrize("how", ["harmonic", "amle", "tv"])
def test_rounds_with_a_narrow_halo_need_no_exchange(spark, how):
    """Rounds whose halo is small beside the tile are made at once: nothing is written between them."""
    from fathomix.operators.inpaint import inpaint
    from fathomix.plans.tables import cut

    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(rng.normal(size=(30, 40))) if rng.random() < 0.3], "row int, col int, z double")
    cuts = []
    at_once = {(r.row, r.col): (r.value, r.change) for r in inpaint(df, "z", 30, 40, lambda d: cuts.append(1) or cut(d), how, 3, 4, 128).collect()}
    assert not cuts
    apart = {(r.row, r.col): (r.value, r.change) for r in inpaint(df, "z", 30, 40, lambda d: cuts.append(1) or cut(d), how, 3, 4, 16).collect()}
    assert cuts and at_once == {p: pytest.approx(v, abs=1e-6) for p, v in apart.items()}


def test_gap_tiles_travel_in_squares(spark):
    """Small tiles are filled as before, each in its own box, but share one group of up to 256 cells a side."""
    from fathomix.operators import solvers

    rng = np.random.default_rng(8)
    cells = {(i, j): float(rng.normal()) for i in range(70) for j in range(45) if rng.random() < 0.25}
    df = spark.createDataFrame([(*p, v) for p, v in cells.items()], "row int, col int, z double")
    want = {}
    for tr in range(9):
        for tc in range(6):
            near = {p: v for p, v in cells.items() if -3 <= p[0] - 8 * tr < 11 and -3 <= p[1] - 8 * tc < 11}
            r0, c0 = min(p[0] for p in near), min(p[1] for p in near)
            a = np.full((max(p[0] for p in near) - r0 + 1, max(p[1] for p in near) - c0 + 1), np.nan)
            for (i, j), v in near.items():
                a[i - r0, j - c0] = v
            hole, out = np.isnan(a), np.where(np.isnan(a), np.nanmean(a), a)
            for _ in range(400):
                p = np.pad(out, 1, mode="edge")
                out = np.where(hole, (p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]) / 4, out)
            want |= {(i + r0, j + c0): out[i, j] for i, j in np.argwhere(hole) if (i + r0) // 8 == tr and (j + c0) // 8 == tc}
    plan = solvers.fill_gaps(df, "z", 3, 8, "harmonic")
    assert {(r.row, r.col): r.value for r in plan.collect()} == {p: pytest.approx(v, abs=1e-12) for p, v in want.items()}
    assert "256" in plan._jdf.queryExecution().optimizedPlan().toString()


def test_what_only_met_windows_need_is_made_for_them(monkeypatch):
    """A document without an item takes no look-up of raw words, and a new ordinary word no full analysis."""
    from fathomix.llm import decontaminate as dc

    words = ["word", "Word", "a", "Z", "ß", "the", "The", "km", "Two", "end.", "Erouin"]
    want, full = [dc._token(w) for w in words], []
    token = dc._token
    monkeypatch.setattr(dc, "_token", lambda raw: full.append(raw) or token(raw))
    assert [dc._Tokens()[w] for w in words] == want
    assert full == ["a", "Z", "ß", "the", "The", "km", "Two", "end."]
    t = dc.Template("He saw The New York Times in 120km and 5 kg.")
    t.windows(8), t.verbatim_windows(8)
    assert not {"place", "last", "last_word"} & set(vars(t))
    assert t.slots(0, len(t)) == ["3:the new york times", "1:120", "2:km", "1:5", "2:kg"]
    assert t.last_word.tolist() == sorted(t.last_word) and t.last.tolist() == [t.at[k] if t.first_word[k] == t.last_word[k] else t.last[k] for k in range(len(t))]
