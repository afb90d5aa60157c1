import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomix.functions import geo
from fathomix.operators import resample, tracks
from fathomix.plans.tables import cut


def test_path_resampling_keeps_vertices():
    xy = np.array([[0.0, 0], [3, 0], [3, 4]])
    out = tracks.resample_path(xy, 8)
    assert len(out) == 8
    for v in xy:
        assert (np.abs(out - v).sum(1) < 1e-9).any()


def test_offsets_along_and_beside():
    got = tracks.propagate([("a", "b", 1.0, 4), ("b", "c", 2.0, 4), ("a", "c", 5.0, 2)], "a")
    assert got["b"] == (1.0, 4) and got["c"] == (5.0, 2)
    got = tracks.propagate([("a", "b", 1.0, 4), ("a", "d", 0.0, 2), ("b", "c", 2.0, 4), ("d", "c", 6.0, 2)], "a")
    assert got["c"] == (pytest.approx((3.0 * 2 + 6.0 * 1) / 3), 3.0)


def test_offsets_in_rounds_like_the_walk(spark):
    """Series, parallel ways and cycles, against the walk over a dictionary."""
    rng = np.random.default_rng(6)
    graphs = [[("a", "b", 1.0, 4), ("a", "d", 0.0, 2), ("b", "c", 2.0, 4), ("d", "c", 6.0, 2), ("c", "a", 9.0, 1), ("x", "y", 1.0, 1)]]
    for _ in range(3):
        pairs = {(int(a), int(b)) for a, b in rng.integers(0, 14, (24, 2)) if a != b}
        graphs.append([(f"m{a}", f"m{b}", float(rng.normal()), int(rng.integers(1, 9))) for a, b in sorted(pairs)])
    for edges in graphs:
        start = edges[0][0]
        odd = [(None, "b", 1.0, 1), ("a", None, 1.0, 1), (start, "nowhere", None, 1), (start, "never", 1.0, 0)]
        e = spark.createDataFrame(edges + odd, "from_mode string, to_mode string, offset double, n long")
        got = {r.mode: (r.offset, r.weight) for r in tracks.propagate_offsets(e, spark.createDataFrame([(start,)], "mode string"), cut).collect()}
        want = tracks.propagate(edges, start)
        assert got.pop(start) == (0.0, None) and want.pop(start)
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_chain_code_of_a_corner(spark):
    pts = [(0, i, float(i), 0.0) for i in range(5)] + [(0, 5 + i, 4.0, float(-1 - i)) for i in range(5)]
    rows = tracks.chain_code(spark.createDataFrame(pts, "k int, i int, x double, y double"), "k", "i", 4.0).orderBy("i").collect()
    assert rows[1].code == 0 and rows[4].code > 45


def test_label_of_hole(spark):
    cells = [(r, c, None if (r, c) == (1, 1) else 1.0, "x" if c else "y", 1) for r in range(3) for c in range(3)]
    df = spark.createDataFrame(cells, "row int, col int, mean double, cdi string, value_count int")
    assert [r.cdi for r in resample.label_holes(df, "mean", "cdi", "value_count", cut).collect()] == ["x"]


def test_contours_between_cells(spark):
    df = spark.createDataFrame([(0, 0, 0.0), (0, 1, 10.0), (1, 0, 5.0)], "row int, col int, z double")
    got = {(r.level, r.x, r.y) for r in resample.contour_crossings(df, "z", 4.0).collect()}
    assert got == {(4.0, 0.4, 0.0), (8.0, 0.8, 0.0), (4.0, 0.0, 0.8)}


def test_shift_by_vectors(spark):
    nav = spark.createDataFrame([(0, 5, 0.0, 0.0), (0, 50, 1.0, 0.0)], "k int, t long, lon double, lat double")
    vec = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 10, 1000.0, 2000.0)], "k int, t long, east double, north double")
    a, b = tracks.shift(nav, vec, ["k"], "t").orderBy("t").collect()
    assert (a.lon, a.lat) == (pytest.approx(500 / 111319.49, rel=1e-4), pytest.approx(1000 / 110574.3, rel=1e-4))
    assert (b.lon, b.lat) == (1.0, 0.0)


def test_straight_beams(spark):
    i, a = geo.beam_direction(F.lit(0.0), F.lit(-30.0), F.lit(0.0))
    r = spark.range(1).select(i.alias("i"), a.alias("a")).first()
    assert (r.i, r.a) == (pytest.approx(30.0), pytest.approx(90.0))
