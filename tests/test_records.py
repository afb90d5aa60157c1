"""Record rules, navigation and the seabed model on small and odd tables."""

import numpy as np
from fathomix.functions import seabed
from fathomix.operators import navigation as nv
from fathomix.operators import records as rc
from fathomix.operators import slices as sl
from fathomix.operators import solvers as so
from fathomix.plans.tables import cut
from pyspark.sql import functions as F

ROWS = "k string, t long, v double, cdi string"


def table(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def test_rules_on_nulls_ties_and_empty_tables(spark):
    rows = [("a", 1, 1.0, "x"), ("a", 1, 1.0, "x"), ("b", 2, None, None), ("b", 3, float("nan"), "y"), (None, 4, float("inf"), "x")]
    df, none = table(spark, rows), table(spark, [])
    assert rc.remove_invalid(df, ["v"]).count() == 2 and rc.remove_invalid(none, ["v"]).count() == 0
    assert rc.keep_between(df, "v", 0.0, 5.0).count() == 2 and rc.keep_between(df, "v").count() == 4
    assert {r.cdi for r in rc.relabel(df, {"x": "z"}).collect()} == {"z", "y", None}
    assert {r.cdi for r in rc.label_missing(df, "new", F.col("t") == 2).collect()} == {"x", "y", "new"}
    assert rc.mask_invalid(df, ["v"], F.col("t") == 1).filter("v is not null").count() == 2
    assert rc.bounds(none, {"t": "lo hi"}).collect()[0].n == 0 and rc.bounds(none, {"t": "lo hi"}, ["k"]).count() == 0
    assert [(r.k, r.n) for r in rc.most_frequent(df, ["k"], []).collect()] == [("a", 2), ("b", 2), (None, 1)]
    ids = {(r.k, r.id) for r in rc.dense_ids(df, ["k"], "id", cut).collect()}
    assert ids == {(None, 1), ("a", 2), ("b", 3)} and rc.dense_ids(none, ["k"], "id", cut).count() == 0
    assert rc.in_both(df, df, ["k"]).count() == 3 and rc.not_in(df, df.filter("k = 'a'"), ["k"]).count() == 2
    out = rc.reject(df.withColumn("status", F.lit(1)), F.col("t") > 2).collect()
    assert [(r.status, r.detail) for r in sorted(out, key=lambda r: r.t)] == [(1, 0)] * 3 + [(3, 1)] * 2


def test_navigation_at_times(spark):
    nav = spark.createDataFrame([("n", 0, 10.0, 350.0), ("n", 10, 20.0, 10.0)], "k string, t long, lon double, heading double")
    times = spark.createDataFrame([("n", 5, 1), ("n", 0, 2), ("n", 11, 3), ("m", 5, 4)], "k string, t long, id int")
    got = {r.id: (r.lon, r.heading) for r in nv.at_times(times, nav, ["k"], "t", ["lon"], "heading").collect()}
    assert got == {1: (15.0, 0.0), 2: (10.0, 350.0), 3: (None, None), 4: (None, None)}
    held = {r.id: r.lon for r in nv.at_times(times, nav, ["k"], "t", ["lon"], outside="clamp").collect()}
    assert held[3] == 20.0
    assert nv.at_times(times.limit(0), nav, ["k"], "t", ["lon"], "heading").count() == 0


def test_gaps_and_matches(spark):
    a = spark.createDataFrame([("n", t) for t in (0, 10, 100, 110)], "k string, t long")
    b = spark.createDataFrame([("n", t) for t in (5, 50, 60, 100, 500)], "k string, t long")
    assert sorted(r.t for r in nv.fill_gaps(a, b, ["k"], "t", 30).collect()) == [0, 10, 50, 60, 100, 110]
    got = {r.t: r.match_t for r in nv.nearest_in_time(b, a, ["k"], "t", 20).collect()}
    assert got == {5: 0, 50: None, 60: None, 100: 100, 500: None}
    assert nv.fill_gaps(a, b.limit(0), ["k"], "t", 30).count() == 4


def test_clip_by_cells_is_the_same(spark):
    rings = [([(float(x), float(y)), (x + 2.5, float(y)), (x + 2.5, y + 1.5)],) for x in range(0, 9, 3) for y in range(0, 9, 3)]
    polygons = spark.createDataFrame(rings, "ring array<struct<x double, y double>>")
    points = spark.createDataFrame([(i, i * 0.37 % 10, i * 0.61 % 10) for i in range(300)] + [(999, None, 1.0)], "id int, lon double, lat double")
    for reverse in (False, True):
        a = {r.id for r in sl.clip(points, polygons, "lon", "lat", ["id"], reverse).collect()}
        assert a == {r.id for r in sl.clip(points, polygons, "lon", "lat", ["id"], reverse, few=2).collect()} and a


def test_seabed_model_and_its_inversion(spark):
    angles = np.arange(-80.0, 81.0, 2.0)
    truth = (3.0, 9.0, 20.0, -22.0)
    want = seabed.level_array(angles, 200_000.0, *truth)
    df = spark.createDataFrame([("m", float(a)) for a in angles], "mode string, bin double")
    df = df.withColumn("mean_db", seabed.level("bin", F.lit(200_000.0), *map(F.lit, truth)))
    assert np.allclose([r.mean_db for r in df.orderBy("bin").collect()], want, atol=1e-6)
    got = so.invert_seabed(df, ["mode"], 200_000.0).collect()
    assert len(got) == 1 and got[0].rms < 0.5 and so.invert_seabed(df.limit(0), ["mode"], 200_000.0).count() == 0


def test_raster_and_file_formats():
    import pytest
    from fathomix.sources import netcdf3, rasters

    v = np.array([[1.5, np.nan, 3.0], [4.0, 5.0, -6.25]])
    got, west, north, sx, sy = rasters.parse_tiff(rasters.tiff_bytes(v, 10.0, 50.0, 0.5, 0.25))
    assert np.array_equal(got, v, equal_nan=True) and (west, north, sx, sy) == (10.0, 50.0, 0.5, 0.25)
    for bad in (b"", b"II*\0", b"%PDF-1.4"):
        with pytest.raises((ValueError, Exception)):
            rasters.parse_tiff(bad)
    raw = netcdf3.file_bytes({"a": 2, "b": 3}, {"x": (["a", "b"], np.arange(6, dtype="f8").reshape(2, 3), {}), "s": (["a"], np.array([7, 8], "i2"), {"scale_factor": 0.1})})
    head = netcdf3._Header(raw)
    assert head.values("x").tolist() == [0, 1, 2, 3, 4, 5] and np.allclose(head.values("s"), [0.7, 0.8]) and head.shape("x") == [("a", 2), ("b", 3)]
    with pytest.raises(ValueError):
        netcdf3._Header(b"\x89HDF")


def test_stop_band_filter():
    (b, a), = so.chebyshev2(2, 40.0, 0.25)
    gain = lambda w: abs(np.polyval(b[::-1], np.exp(-1j * np.pi * w)) / np.polyval(a[::-1], np.exp(-1j * np.pi * w)))
    assert abs(gain(0.0) - 1) < 1e-9 and abs(20 * np.log10(gain(0.25)) + 40) < 1e-6
    assert all(gain(w) <= 10**-2 + 1e-9 for w in np.linspace(0.25, 1, 50))


def test_rays_to_depth_undo_rays_by_time():
    depths, speeds = np.array([0.0, 50.0, 300.0, 900.0]), np.array([1500.0, 1480.0, 1470.0, 1490.0])
    target, angle = np.array([20.0, 200.0, 700.0, 1500.0, 700.0, 2.0]), np.array([30.0, -45.0, 10.0, 0.0, 60.0, 20.0])
    x, t = so.ray_by_depth(depths, speeds, target, angle, 5.0)
    x2, z2 = so.ray_by_time(depths, speeds, t[:5], angle[:5], 5.0)
    assert np.allclose(z2, target[:5], atol=1e-3) and np.allclose(x2, x[:5], atol=1e-2) and np.isnan(x[5])


def test_bilinear_fill_of_a_plane(spark):
    from fathomix.operators import stencil as st

    cells = [(i, j, 2.0 * i + 3.0 * j) for i in range(8) for j in range(9)]
    holes = {(3, 4), (3, 5), (5, 2)}
    df = spark.createDataFrame([(i, j, None if (i, j) in holes else v) for i, j, v in cells], "row int, col int, mean double")
    got = {(r.row, r.col): r.mean for r in st.bilinear_fill(df, "mean").collect()}
    assert got == {(i, j): 2.0 * i + 3.0 * j for i, j in holes}
    assert st.bilinear_fill(df.limit(0), "mean").count() == 0
