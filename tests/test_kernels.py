"""Kernels that SQL can't express, against hand-computed values and properties."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathomix.functions import acoustics as ac
from fathomix.functions import geo, text
from fathomix.operators import angular, grid, solvers, stencil, temporal
from fathomix.plans.tables import cut
from fathomix.sources import readers, writers


def one(spark, **cols):
    return spark.range(1).select(*(v.alias(k) for k, v in cols.items())).first()


def test_geodesic_known_distance(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0), (50.0, 0.0, 50.0, 0.0), (48.0, -5.0, 49.0, -4.0)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(geo.geodesic("a", "b", "c", "d")).collect()]
    assert got[0] == pytest.approx(111319.4908, abs=1e-3)
    assert got[1] == 0.0
    assert got[2] == pytest.approx(133312, rel=2e-2)


def test_utm_zones_and_transverse_mercator(spark):
    x, y = geo.to_utm(F.lit(3.0), F.lit(0.0), F.lit(31))
    r = one(spark, zone=geo.utm_zone(F.lit(5.0), F.lit(60.0)), svalbard=geo.utm_zone(F.lit(10.0), F.lit(75.0)), x=x, y=y)
    assert (r.zone, r.svalbard) == (32, 33)
    assert (r.x, r.y) == (pytest.approx(500000.0), pytest.approx(0.0))


def test_mercator_round_trip(spark):
    x, y = geo.to_mercator(F.lit(-4.5), F.lit(48.4))
    lon, lat = geo.from_mercator(x, y)
    r = one(spark, lon=lon, lat=lat)
    assert (r.lon, r.lat) == (pytest.approx(-4.5), pytest.approx(48.4))


def test_grid_spec():
    s = geo.GridSpec.of_extent(0, 10, 0, 5, 2, 2)
    assert (s.rows, s.cols) == (3, 5)
    assert s.shifted(1, 1).west == 2
    assert s.compatible(geo.GridSpec(1, 1, 2, 2, 1, 1))
    assert geo.needs_antimeridian(-179, 179) and not geo.needs_antimeridian(-10, 10)
    assert geo.round_resolution(123) == 120 and geo.round_resolution(15.4) == 15 and geo.round_resolution(1.234) == 1.23


def test_antimeridian_cell(spark):
    s = geo.GridSpec(179.0, 0.0, 1.0, 1.0, 1, 2)
    row, col = s.cell(F.lit(-179.5), F.lit(0.5))
    r = one(spark, row=row, col=col)
    assert (r.row, r.col) == (0, 1)


def test_points_on_edges_and_outside(spark):
    s = geo.GridSpec(0.0, 0.0, 1.0, 1.0, 2, 2, "x")
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (2.0, 0.0), (-0.1, 0.0)], "x double, y double")
    row, col = s.cell("x", "y")
    assert [tuple(r) for r in df.select(row, col).collect()] == [(0, 0), (1, 1), (None, None), (None, None)]




def test_nmea_checksum(spark):
    line = "$GPGGA,123519,4807.038,N,01131.000,E,1,08,0.9,545.4,M,46.9,M,,*47"
    r = one(spark, ok=text.nmea_valid(F.lit(line)), bad=text.nmea_valid(F.lit(line.replace("123519", "123518"))), f=text.nmea_fields(F.lit(line)))
    assert r.ok and not r.bad
    assert (r.f.talker, r.f.sentence, r.f.fields[0]) == ("GP", "GGA", "123519")


@pytest.mark.parametrize("raw, want", [("48° 30' 36\" N", 48.51), ("4°30.6'W", -4.51), ("-12.5", -12.5), ("12.25 S", -12.25), ("", None), (None, None)])
def test_degrees(spark, raw, want):
    got = one(spark, d=text.parse_degrees(F.lit(raw).cast("string"))).d
    assert got == (None if want is None else pytest.approx(want))


def test_seconds_carry_over(spark):
    r = one(spark, a=text.format_dms(F.lit(9.9999999), "N", "S"), b=text.format_ddm(F.lit(-9.99999999), "E", "W"))
    assert (r.a, r.b) == ("10°00'00.00\"N", "10°00.000'W")


def test_missing_markers(spark):
    df = spark.createDataFrame([(float("nan"), -1, ""), (1.0, 2, "a")], "f double, i int, s string")
    assert [tuple(r) for r in readers.missing_to_null(df).collect()] == [(None, None, None), (1.0, 2, "a")]


def test_closed_bins(spark):
    df = spark.createDataFrame([(v,) for v in (-0.5, 0.49, 0.5, 89.5, 89.6, None)], "a double")
    assert [r[0] for r in df.select(ac.closed_bin("a", -0.5, 89.5, 1.0)).collect()] == [0, 0, 1, 89, None, None]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.floats(-40, 10)), min_size=1, max_size=12, unique_by=lambda p: p[0]), st.lists(st.floats(-5, 70), min_size=1, max_size=5))
def test_interpolation_is_numpy_interp(spark, points, at):
    x, y = zip(*sorted(points))
    lut = F.array(*(F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in zip(x, y)))
    row = spark.range(1).select(*(angular.interpolate(lut, F.lit(float(v))).alias(f"v{i}") for i, v in enumerate(at))).first()
    assert list(row) == pytest.approx(list(np.interp(at, x, y)), abs=1e-6)


def test_gridding_of_empty_and_missing(spark):
    df = spark.createDataFrame([(0, 0, None, 1), (0, 0, 2.0, 2), (0, 0, 4.0, 3)], "row int, col int, z double, k int")
    r = grid.grid_statistics(df, "z", ["k"]).first()
    assert (r.value_count, r["mean"], r.last, r.filtered_count, r.stdev) == (2, 3.0, 4.0, 1, 1.0)
    assert grid.grid_statistics(df.limit(0), "z", ["k"]).count() == 0


def test_weights_that_do_not_count(spark):
    df = spark.createDataFrame([(0, 0, 1.0, 0.0), (0, 0, 2.0, -1.0), (0, 0, 5.0, 2.0), (0, 0, 8.0, 1.0)], "row int, col int, z double, w double")
    r = grid.weighted_statistics(df, "z", "w").first()
    assert (r["mean"], r.weight_sum, r.value_count) == (6.0, 3.0, 2)


def test_reduction_keeps_counts(spark):
    df = spark.range(100).selectExpr("cast(id / 10 as int) row", "cast(id % 10 as int) col", "double(id) mean", "1.0 stdev", "id % 4 value_count", "double(id) min", "double(id) max", "0 flag", "'a' cdi")
    assert grid.reduce_grid(df, 3).agg(F.sum("value_count")).first()[0] == df.agg(F.sum("value_count")).first()[0]


def test_components_of_a_snake(spark):
    cells = [(0, c) for c in range(9)] + [(r, 8) for r in range(1, 5)] + [(10, 10)]
    got = stencil.components(spark.createDataFrame(cells, "row int, col int"), cut).collect()
    assert len({r.label for r in got}) == 2


def test_small_holes(spark):
    df = spark.createDataFrame([(r, c, None if (r, c) in {(2, 2), (2, 3)} else 1.0) for r in range(5) for c in range(6)], "row int, col int, mean double")
    assert [(h.area, h.row, h.col) for h in stencil.small_holes(df, "mean", 3, cut).collect()] == [(2, 2.0, 2.5)]


def test_unwrap_then_wrap(spark):
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate((350, 355, 2, 10, 359, 340))], "k int, t int, h double")
    u = temporal.unwrap(df, ["k"], "t", "h").orderBy("t").select("unwrapped", temporal.wrap("unwrapped").alias("w")).collect()
    assert [r.unwrapped for r in u] == [350, 355, 362, 370, 359, 340]
    assert [r.w for r in u] == [350, 355, 2, 10, 359, 340]


def test_asof_with_equal_times(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (1, 10)], "k int, t long")
    right = spark.createDataFrame([(1, 5, "a"), (1, 8, "b")], "k int, t long, v string")
    get = lambda **o: {r.t: r.v for r in temporal.asof(left, right, ["k"], "t", "v", **o).collect()}
    assert get() == {1: None, 5: "a", 10: "b"}
    assert get(strict=True, edges="first") == {1: "a", 5: "a", 10: "b"}


def test_ray_through_constant_speed():
    x, z = solvers.ray_by_time(np.array([0.0, 5000.0]), np.array([1500.0, 1500.0]), np.array([1.0, 1.0]), np.array([0.0, 30.0]), 10.0)
    assert z[0] == pytest.approx(1510.0, abs=0.01) and x[0] == 0
    assert (x[1], z[1]) == (pytest.approx(750.0, abs=0.1), pytest.approx(10 + 1500 * math.cos(math.pi / 6), abs=0.1))


def test_spline_passes_few_points_and_smooths_many():
    x = np.arange(4.0)
    assert (solvers.smoothing_spline(x, x**2, np.ones(4)) == x**2).all()
    x = np.arange(40.0)
    y = np.sin(x) + x
    assert np.abs(np.diff(solvers.smoothing_spline(x, y, np.ones(40), 100.0), 2)).max() < np.abs(np.diff(y, 2)).max()
    line = 3 * x + 1
    assert solvers.smoothing_spline(x, line, np.ones(40)) == pytest.approx(line)


def test_cubic_spline_goes_through_points():
    x, y = np.array([0.0, 1, 3, 4]), np.array([1.0, 3, 2, 5])
    assert solvers.cubic_spline(x, y, x) == pytest.approx(y)


def test_gsab_fit_recovers_a_curve():
    x = np.arange(0.0, 70)
    y = solvers.gsab_value(np.array([10**-0.5, 6, 10**-2.0, 2, 10**-1.5, 20]), x)
    p = solvers.fit_gsab(x, y, np.full(70, 10.0))
    fit = solvers.gsab_value(np.array([10 ** (p[0] / 10), p[1], 10 ** (p[2] / 10), p[3], 10 ** (p[4] / 10), p[5]]), x)
    assert np.sqrt(np.mean((fit - y) ** 2)) < 0.5


def test_annealing_is_seeded():
    f = lambda p: float(((p - 3) ** 2).sum())
    box = np.full(2, -10.0), np.full(2, 10.0), np.full(2, 0.5)
    a, b = (solvers.anneal(f, np.zeros(2), *box, seed=1) for _ in range(2))
    assert (a[0] == b[0]).all() and a[1] < 0.1


def test_filter_keeps_constants_and_trend():
    v = np.full(200, 7.0)
    assert solvers.filtfilt(solvers.butterworth(4, 0.1), v) == pytest.approx(v)
    t = np.arange(400.0)
    noisy = np.sin(t / 40) + 0.5 * np.sin(t * 2)
    out = solvers.filtfilt(solvers.butterworth(4, 0.1), noisy)
    assert np.abs(out[50:-50] - np.sin(t / 40)[50:-50]).max() < 0.1


def test_plane_and_procrustes():
    x, y = np.meshgrid(np.arange(5.0), np.arange(4.0))
    a, b, c, d = solvers.best_plane(x.ravel(), y.ravel(), (2 * x + 3).ravel())
    assert (a / c, b / c, d / c) == (pytest.approx(-2), pytest.approx(0, abs=1e-9), pytest.approx(3))
    src = np.random.default_rng(0).normal(size=(10, 2))
    k = math.radians(25)
    rot = np.array([[math.cos(k), -math.sin(k)], [math.sin(k), math.cos(k)]])
    angle, shift, rms = solvers.procrustes(src, src @ rot.T + [4, -2])
    assert angle == pytest.approx(25) and shift == pytest.approx([4, -2]) and rms < 1e-9


def test_roots_and_beams():
    assert solvers.roots([1, -6, 11, -6]) == pytest.approx([1, 2, 3])
    assert solvers.beam_vector(0.0, 0.0, 0.0) == pytest.approx((0, 0, 1))


def test_fills():
    a = np.arange(25.0).reshape(5, 5)
    a[2, 2] = np.nan
    assert solvers.quadrant_fill(a, 2)[2, 2] == pytest.approx(12.0)
    assert solvers.harmonic_fill(a)[2, 2] == pytest.approx(12.0, abs=0.01)


def test_isolation_finds_the_outlier():
    x = np.concatenate([np.random.default_rng(1).normal(size=(200, 3)), [[15, 15, 15]]])
    assert solvers.isolation_scores(x, 0).argmax() == 200


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("lon;lat;z\n1,5;2;-3,25\n\n2;x;4\n")
    rows = readers.soundings_csv(spark, str(tmp_path / "a.csv"), {"lon": 0, "lat": 1, "elevation": 2}, ";", ",", 1, -1.0).orderBy("lon").collect()
    assert [(r.lon, r.lat, r.elevation) for r in rows] == [(1.5, 2.0, 3.25), (2.0, None, -4.0)]
    (tmp_path / "c.cut").write_text("# cut\n> 01/02/2024 03:04:05.000 01/02/2024 04:00:00.000 line 1\n")
    r = readers.cut_file(spark, str(tmp_path / "c.cut")).first()
    assert r.name == "line 1" and (r.stop - r.start).seconds == 3355
    (tmp_path / "n.txt").write_text("$GPGGA,123519,4807.038,N,01131.000,E,1,08,0.9,545.4,M,46.9,M,,*47\njunk\n")
    g = readers.gga(readers.nmea(spark, str(tmp_path / "n.txt"))).first()
    assert (g.lat, g.height) == (pytest.approx(48.1173), pytest.approx(592.3))
    np.array([(1, 2.5), (3, 4.5)], [("t", "<i4"), ("v", "<f4")]).tofile(tmp_path / "m.bin")
    assert [tuple(r) for r in readers.mapped_binary(spark, str(tmp_path / "m.bin"), [("t", "<i4"), ("v", "<f4")]).orderBy("t").collect()] == [(1, 2.5), (3, 4.5)]
    assert readers.response_text(["1 0 1", "5.0 2", "0 -20 10 -25"], 1.0, True) == [(1, 0, 0, 0.0, -15.0), (1, 0, 0, 10.0, -20.0)]
    kml = "<kml><Placemark><name>m</name><Polygon><outerBoundaryIs><LinearRing><coordinates>0,0 1,0 1,1</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></kml>"
    assert readers.kml_rings(kml) == [("m", [(0, 0), (1, 0), (1, 1)])]
    with pytest.raises(NotImplementedError):
        readers.read(spark, "x.xsf")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read(spark, "x.mbg")
    with pytest.raises(ValueError):
        readers.read(spark, "x.unknown")


def test_grid_text_dummy():
    assert writers.gxf_dummy(1, 5) == 0 and writers.gxf_dummy(-5, 50) == 99
