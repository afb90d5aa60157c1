"""Queries on whole conversions, navigation of several sources, sections and scalar rules."""

from __future__ import annotations

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import functions as F

from ..functions import acoustics as ac
from ..functions import geo, seabed, text
from ..functions.geo import GridSpec
from ..operators import angular as an
from ..operators import grid as g
from ..operators import navigation as nv
from ..operators import records as rc
from ..operators import slices as sl
from ..operators import solvers as so
from ..operators import stencil as st
from ..operators import temporal as tp
from ..sources import netcdf3, rasters, readers, writers
from .bind import DET, GRID, GRIDS, PINGS, TRACK, detections, grid, grids, pings, r, table, track
from .io_q import _folder
from .registry import query
from .tables import cut


def _spec(spark, sf):
    """The grid that holds all detections."""
    top = table(spark, sf, "lineitem").agg(F.max("l_suppkey"), F.max("l_partkey")).first()
    return GridSpec(0.0, 0.0, 50.0, 10.0, int(top[0] or 0) // 10 + 1, int(top[1] or 0) // 50 + 1, "x")


# -- conversions --------------------------------------------------------------------------------------


@query("a08_csv_to_grid", """SELECT CAST(floor(l_suppkey / 10) AS INTEGER) AS "row", CAST(floor(l_partkey / 50) AS INTEGER) AS col, count(*) AS value_count,
round(avg(-floor(l_extendedprice)), 4) AS mean, min(-floor(l_extendedprice)) AS min, max(-floor(l_extendedprice)) AS max FROM lineitem GROUP BY ALL""")
def a08(spark, sf):
    """Soundings written with decimal commas and positive depths, read back and gridded."""
    path = _folder(spark, "soundings")
    value = F.format_string("%d,0;%d,0;%d,0", "l_partkey", "l_suppkey", F.floor("l_extendedprice"))
    writers.lines(table(spark, sf, "lineitem").select(value.alias("value")), path)
    points = readers.soundings_csv(spark, path, {"x": 0, "y": 1, "elevation": 2}, ";", ",", depth_sign=-1.0)
    row, col = _spec(spark, sf).cell("x", "y")
    cells = points.withColumns({"row": row, "col": col}).filter("row is not null")
    return g.grid_statistics(cells, "elevation", ["seq"]).select("row", "col", "value_count", *r("mean"), "min", "max")


@query("a09_k10_gridded_csv", f"""WITH {GRID} SELECT "row", col, floor(min) / 4 AS elevation, CAST(1 AS BIGINT) AS value_count FROM grid""")
def a09(spark, sf):
    """A gridded text file, one line a cell: the last elevation of each."""
    path = _folder(spark, "gridded")
    cells = grid(spark, sf).select((F.col("col") * 0.5 + 0.1).alias("x"), (F.col("row") + 0.2).alias("y"), (F.floor("min") / 4).alias("z"))
    writers.lines(writers.xyz_lines(cells), path)
    points = readers.xyz(spark, path).select(F.col("lon").alias("x"), F.col("lat").alias("y"), "elevation", F.monotonically_increasing_id().alias("seq"))
    whole = _spec(spark, sf)
    return g.grid_points(points, GridSpec(0.0, 0.0, 0.5, 1.0, whole.rows, whole.cols, "x"), "elevation", ["seq"])


@query("k11_point_gridder", f"""WITH {DET} SELECT CAST(floor(sy / 10) AS INTEGER) AS "row", CAST(floor(px / 50) AS INTEGER) AS col, round(avg(z), 4) AS z, count(*) AS value_count FROM det GROUP BY ALL""")
def k11(spark, sf):
    d = detections(spark, sf).withColumns({"x": F.col("px"), "y": F.col("sy")})
    return g.grid_points(d, _spec(spark, sf), "z", [], "mean").withColumn("z", F.round("z", 4))


@query("p11_crop", f"""WITH {GRID}, k AS (SELECT * FROM grid WHERE col BETWEEN 5 AND 20 AND value_count > 2), b AS (SELECT min("row") AS r0, min(col) AS c0 FROM k)
SELECT "row" - r0 AS "row", col - c0 AS col, value_count FROM k, b""")
def p11(spark, sf):
    return g.crop(grid(spark, sf), F.col("col").between(5, 20) & (F.col("value_count") > 2)).select("row", "col", "value_count")


@query("a42_elevation_reference", f"""WITH {DET}, m AS (SELECT "row", col, avg(z) AS mean FROM det WHERE antenna = 1 GROUP BY ALL), w AS (SELECT DISTINCT "row", col FROM det),
n AS (SELECT w."row", w.col, s.mean, power(s."row" - w."row", 2) + power(s.col - w.col, 2) AS d FROM w JOIN m s ON abs(s."row" - w."row") <= 2 AND abs(s.col - w.col) <= 2 WHERE NOT EXISTS (SELECT 1 FROM m WHERE m."row" = w."row" AND m.col = w.col))
SELECT "row", col, round(arg_min(mean, (d, mean)), 4) AS mean FROM n GROUP BY ALL UNION ALL SELECT "row", col, round(mean, 4) FROM m""")
def a42(spark, sf):
    """Mean elevation of one antenna's cells; other cells take the nearest within two cells."""
    d = detections(spark, sf)
    own = d.filter("antenna = 1").groupBy("row", "col").agg(F.avg("z").alias("mean"))
    filled = st.nearest_fill(own, "mean", 2, d.select("row", "col").distinct())
    return own.unionByName(filled.select("row", "col", "mean")).withColumn("mean", F.round("mean", 4))


@query("k02_missing_layers", f"""WITH {GRID} SELECT count(*) AS cells, round(sum(min) - sum(mean), 2) AS low, round(sum(max) - sum(mean), 2) AS high FROM (SELECT mean, mean AS min, mean AS max FROM grid)""")
def k02(spark, sf):
    made = g.default_layers(grid(spark, sf).select("row", "col", "mean"))
    return made.agg(F.count("*").alias("cells"), F.round(F.sum("min") - F.sum("mean"), 2).alias("low"), F.round(F.sum("max") - F.sum("mean"), 2).alias("high"))


@query("p26_sensor_filter", f"WITH {PINGS} SELECT event_id, round(value * 2 - 3, 6) AS value FROM pings WHERE value BETWEEN 10 AND 80")
def p26(spark, sf):
    p = rc.keep_between(rc.remove_invalid(pings(spark, sf), ["value"]), "value", 10.0, 80.0)
    return rc.linear_layer(p, "value", 2.0, -3.0).select("event_id", *r("value", digits=6))


@query("s04_valid_positions", f"WITH {DET} SELECT ok, ln, p, CASE WHEN antenna % 3 = 0 THEN px END AS lon, CASE WHEN antenna % 3 = 0 THEN sy END AS lat FROM det")
def s04(spark, sf):
    d = detections(spark, sf).withColumnsRenamed({"px": "lon", "sy": "lat"})
    return rc.mask_invalid(d, ["lon", "lat"], F.col("antenna") % 3 == 0).select("ok", "ln", "p", "lon", "lat")


@query("s31_sensor_csv", """SELECT count(*) AS n, count(*) FILTER (event_id % 10 = 0) AS bad, round(sum(CASE WHEN event_id % 10 <> 0 THEN floor(value) END), 2) AS total FROM events""")
def s31(spark, sf):
    """A sensor's CSV in which every tenth line has a broken number."""
    path = _folder(spark, "sensor")
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, "broken").otherwise(F.floor("value").cast("string")).alias("value"))
    e.write.csv(path, header=True, sep=";")
    back = readers.csv_table(spark, path, "event_id LONG, value DOUBLE", required=["event_id"])
    return cut(back).agg(F.count("*").alias("n"), F.count("_corrupt").alias("bad"), F.round(F.sum(F.when(F.col("_corrupt").isNull(), F.col("value"))), 2).alias("total"))


@query("s33_cut_lines", f"WITH {PINGS} SELECT 'line ' || file AS name, min(t) // 1000000 * 1000000 AS start, max(t) // 1000000 * 1000000 AS stop FROM pings GROUP BY file")
def s33(spark, sf):
    path = _folder(spark, "cuts")
    b = rc.bounds(pings(spark, sf), {"t": "start stop"}, ["file"])
    at = lambda k: F.date_format(F.timestamp_micros(k), "dd/MM/yyyy HH:mm:ss")
    writers.lines(b.select(F.concat_ws(" ", at("start"), at("stop"), F.lit("line"), "file").alias("value")), path)
    return readers.cut_file(spark, path).select("name", F.unix_micros("start").alias("start"), F.unix_micros("stop").alias("stop"))


@query("s29_acoustic_positions", """SELECT CAST(event_id AS VARCHAR) AS utc, event_type AS beacon, floor(value) AS x, CAST(user_id AS DOUBLE) AS y, CAST(event_id % 7 AS DOUBLE) AS z FROM events""")
def s29(spark, sf):
    path = _folder(spark, "usbl")
    e = table(spark, sf, "events")
    line = F.concat_ws(",", F.lit("$PSIMSSB"), "event_id", "event_type", *[F.lit("")] * 5, F.floor("value"), "user_id", F.col("event_id") % 7)
    writers.lines(e.select(line.alias("value")).unionByName(e.select(F.lit("$OTHER,1").alias("value"))), path)
    return readers.usbl(spark, path)


@query("s42_files", """SELECT count(DISTINCT l_returnflag) AS folders FROM lineitem""")
def s42(spark, sf):
    path = _folder(spark, "listed")
    detections(spark, sf).select("mode", "z").write.partitionBy("mode").parquet(path)
    found = readers.files(spark, path, "*.parquet").select(F.regexp_extract("path", r"/mode=([^/]+)/", 1).alias("mode"))
    return found.agg(F.count_distinct("mode").alias("folders"))


@query("k16_k25_separated_lines", """SELECT s_suppkey || ';' || s_name || ';' || format('{:.2f}', floor(s_acctbal)) AS value FROM supplier""")
def k16(spark, sf):
    s = table(spark, sf, "supplier").withColumn("balance", F.floor("s_acctbal").cast("double"))
    return nv.lines_csv(s, {"s_suppkey": "%d", "s_name": "%s", "balance": "%.2f"})


@query("k17_depth_sentences", f"""WITH {PINGS}, b AS (SELECT event_id, 'SDDBT,,f,' || format('{{:.1f}}', CAST(floor(value) AS DOUBLE)) || ',M,,F' AS body FROM pings),
x AS (SELECT *, list_reduce(list_transform(string_split(body, ''), lambda c: ascii(c)), lambda a, c: xor(a, c)) AS k FROM b)
SELECT event_id, '$' || body || '*' || upper(lpad(to_hex(k), 2, '0')) AS value FROM x""")
def k17(spark, sf):
    body = F.concat(F.lit("SDDBT,,f,"), F.format_string("%.1f", F.floor("value").cast("double")), F.lit(",M,,F"))
    return pings(spark, sf).select("event_id", text.nmea_sentence(body).alias("value"))


@query("k21_history", f"""WITH {DET} SELECT 'gridded ' || count(*) || ' soundings' AS line FROM det UNION ALL SELECT 'merged ' || count(DISTINCT mode) || ' modes' FROM det""")
def k21(spark, sf):
    """What was done to a data set, appended step by step."""
    path = _folder(spark, "history")
    n, modes = detections(spark, sf).agg(F.count("*"), F.count_distinct("mode")).first()
    for line in (f"gridded {n} soundings", f"merged {modes} modes"):
        writers.history(spark, path, line)
    return spark.read.parquet(path).select("line")


@query("k26_summary_lines", f"WITH {PINGS} SELECT kind || ';' || file || ';' || count(*) AS value FROM pings GROUP BY kind, file")
def k26(spark, sf):
    n = pings(spark, sf).groupBy("kind", "file").agg(F.count("*").alias("n"))
    return nv.lines_csv(n, {"kind": "%s", "file": "%d", "n": "%d"})


# -- navigation -----------------------------------------------------------------------------------------

_NAV = TRACK + """, nav AS (SELECT file, t, lon, heading FROM track WHERE kind = 'purchase'), q AS (SELECT event_id, file, t FROM track WHERE kind <> 'purchase')"""


def _nav(spark, sf):
    tr = track(spark, sf)
    return tr.filter("kind = 'purchase'").select("file", "t", "lon", "heading"), tr.filter("kind != 'purchase'").select("event_id", "file", "t")


@query("s22_navigation_of_files", f"WITH {TRACK} SELECT file, t, round(lon, 6) AS lon, round(lat, 6) AS lat FROM track")
def s22(spark, sf):
    tr = track(spark, sf).select("file", "t", "lon", "lat")
    return nv.from_files([tr.filter("file % 2 = 0"), tr.filter("file % 2 = 1"), tr.filter("file % 4 = 0")], ["file"]).select("file", "t", *r("lon", "lat", digits=6))


@query("s23_navigation_from_arrays", "SELECT 'n' AS name, CAST(i AS BIGINT) AS t, i * 0.5 AS lon FROM range(5) v(i)")
def s23(spark, sf):
    return nv.from_arrays(spark, "n", t=list(range(5)), lon=[i * 0.5 for i in range(5)]).select("name", "t", "lon")


@query("j15_navigation_at_times", f"""WITH {_NAV}, u AS (SELECT *, heading + 360.0 * sum(-round_even((heading - h0) / 360.0, 0)) OVER (PARTITION BY file ORDER BY t ROWS UNBOUNDED PRECEDING) AS uh
  FROM (SELECT *, coalesce(lag(heading) OVER (PARTITION BY file ORDER BY t), heading) AS h0 FROM nav)),
a AS (SELECT q.*, u.t AS t0, u.lon AS l0, u.uh AS u0 FROM q ASOF LEFT JOIN u ON q.file = u.file AND q.t >= u.t), b AS (SELECT a.*, u.t AS t1, u.lon AS l1, u.uh AS u1 FROM a ASOF LEFT JOIN u ON a.file = u.file AND a.t <= u.t)
SELECT event_id, round(l0 + (l1 - l0) * (t - t0) / nullif(t1 - t0, 0), 6) AS lon, round(((u0 + (u1 - u0) * (t - t0) / nullif(t1 - t0, 0)) % 360 + 360) % 360, 6) AS heading FROM b""")
def j15(spark, sf):
    nav, times = _nav(spark, sf)
    return nv.at_times(times, nav, ["file"], "t", ["lon"], "heading").select("event_id", *r("lon", "heading", digits=6))


@query("j21_fill_gaps", f"""WITH {PINGS}, f AS (SELECT * FROM pings WHERE kind = 'click'), s AS (SELECT * FROM pings WHERE kind <> 'click'),
a AS (SELECT s.*, f.t AS t0 FROM s ASOF JOIN f ON s.file = f.file AND s.t >= f.t), b AS (SELECT a.*, f.t AS t1 FROM a ASOF JOIN f ON a.file = f.file AND a.t <= f.t)
SELECT event_id FROM b WHERE t1 - t0 > CAST(86400000000 AS BIGINT) AND t > t0 AND t < t1 UNION ALL SELECT event_id FROM f""")
def j21(spark, sf):
    p = pings(spark, sf)
    return nv.fill_gaps(p.filter("kind = 'click'"), p.filter("kind != 'click'"), ["file"], "t", 86_400_000_000).select("event_id")


@query("j22_nearest_in_time", f"""WITH {_NAV}, a AS (SELECT q.*, nav.t AS t0 FROM q ASOF LEFT JOIN nav ON q.file = nav.file AND q.t >= nav.t), b AS (SELECT a.*, nav.t AS t1 FROM a ASOF LEFT JOIN nav ON a.file = nav.file AND a.t <= nav.t),
c AS (SELECT event_id, t, CASE WHEN t - t0 <= 36000000000 THEN t0 END AS t0, CASE WHEN t1 - t <= 36000000000 THEN t1 END AS t1 FROM b)
SELECT event_id, CASE WHEN t1 IS NULL OR t - t0 <= t1 - t THEN t0 ELSE t1 END AS match_t FROM c""")
def j22(spark, sf):
    nav, times = _nav(spark, sf)
    return nv.nearest_in_time(times, nav, ["file"], "t", 36_000_000_000).select("event_id", "match_t")


@query("j10_nearest_column", f"""WITH {TRACK}, c AS (SELECT i AS x_idx, i - 180.0 AS lon, (i * 7 % 120) - 60.0 AS lat FROM range(360) v(i)), p AS (SELECT event_id, lon, lat, event_id % 360 AS i0 FROM track),
n AS (SELECT event_id, c.x_idx, power(p.lon - c.lon, 2) + power(p.lat - c.lat, 2) AS d FROM p JOIN c ON c.x_idx BETWEEN i0 - 5 AND i0 + 5)
SELECT event_id, arg_min(x_idx, (d, x_idx)) AS x_idx FROM n GROUP BY ALL""")
def j10(spark, sf):
    i = F.col("id")
    columns = spark.range(360).select(i.alias("x_idx"), (i - 180.0).alias("lon"), (i * 7 % 120 - 60.0).alias("lat"))
    return nv.nearest_column(track(spark, sf), columns, F.col("event_id") % 360, 5, ["event_id"])


@query("j03_closest_per_time", f"""WITH {TRACK}, m AS (SELECT *, t // 86400000000 AS day, row_number() OVER (PARTITION BY file, t // 86400000000 ORDER BY abs(lat), event_id) AS k FROM track), o AS (SELECT *, count(*) OVER (PARTITION BY file) AS n FROM m WHERE k = 1)
SELECT file, day, event_id FROM o WHERE n >= 4""")
def j03(spark, sf):
    m = track(spark, sf).withColumns({"day": F.floor(F.col("t") / 86_400_000_000), "d": F.abs("lat")})
    return nv.closest_per_time(m, ["file"], "day", "d", ["event_id"], 4).select("file", "day", "event_id")


@query("k14_navigation_lines", f"""WITH {TRACK} SELECT file || ';' || t || ';' || format('{{:.3f}}', floor(lon) * 1.0) || ';' || format('{{:.3f}}', floor(lat) * 1.0) AS value FROM track""")
def k14(spark, sf):
    tr = track(spark, sf).withColumns({"lon": F.floor("lon").cast("double"), "lat": F.floor("lat").cast("double")})
    return nv.lines_csv(tr, {"file": "%d", "t": "%d", "lon": "%.3f", "lat": "%.3f"})


_HAV = "2 * 6371000.0 * asin(sqrt(power(sin(radians(lat - y) / 2), 2) + cos(radians(y)) * cos(radians(lat)) * power(sin(radians(lon - x) / 2), 2)))"


@query("f29_section_arguments", f"""WITH {TRACK}, d AS (SELECT file, {_HAV} AS d FROM (SELECT *, lag(lat) OVER w AS y, lag(lon) OVER w AS x FROM track WINDOW w AS (PARTITION BY file ORDER BY t)))
SELECT file, count(*) AS n, round(coalesce(sum(d), 0), 2) AS length, round(avg(d), 2) AS step FROM d GROUP BY ALL""")
def f29(spark, sf):
    return nv.track_length(track(spark, sf), ["file"], "t", "lon", "lat").select("file", "n", *r("length", "step", digits=2))


# -- curves and scalar rules ------------------------------------------------------------------------------


@query("a25_merge_transmission", f"""WITH {DET}, f AS (SELECT mode, sector, antenna AS bin, avg(db) AS mean_db, avg(z) AS residual_db, count(*) AS n FROM det GROUP BY ALL)
SELECT sector, bin, round(sum(mean_db * n) / sum(n), 5) AS mean_db, round(sum(residual_db * n) / sum(n), 5) AS residual_db, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY ALL""")
def a25(spark, sf):
    f = detections(spark, sf).groupBy("mode", "sector", F.col("antenna").alias("bin")).agg(F.avg("db").alias("mean_db"), F.avg("z").alias("residual_db"), F.count("*").alias("n"))
    return an.merge_values(f, ["sector", "bin"], ["mean_db", "residual_db"]).select("sector", "bin", *r("mean_db", "residual_db", digits=5), "n")


@query("x02_kernel_smoothing", f"""WITH {GRID}, s AS (SELECT t."row", t.col, sum(s.mean * w) / sum(w) AS m FROM grid t JOIN (SELECT "row", col, mean FROM grid) s ON abs(s."row" - t."row") <= 1 AND abs(s.col - t.col) <= 1,
LATERAL (SELECT CASE WHEN s."row" = t."row" THEN 2 ELSE 1 END * CASE WHEN s.col = t.col THEN 2 ELSE 1 END AS w) GROUP BY ALL)
SELECT "row", col, round(m, 4) AS mean, round(least(min, m), 4) AS min, round(greatest(max, m), 4) AS max FROM grid JOIN s USING ("row", col)""")
def x02(spark, sf):
    return st.smooth(grid(spark, sf), "gauss3").select("row", "col", *r("mean", "min", "max"))


@query("f23_roots", f"""WITH {DET}, x AS (SELECT ok, ln, p, w - 0.04 AS a, angle - 25 AS b, db AS c FROM det), y AS (SELECT *, b * b - 4 * a * c AS d FROM x)
SELECT ok, ln, p, round(CASE WHEN abs(a) < 1e-12 THEN -c / nullif(b, 0) WHEN d >= 0 THEN least((-b - sqrt(d)) / (2 * a), (-b + sqrt(d)) / (2 * a)) END, 5) AS low,
round(CASE WHEN abs(a) >= 1e-12 AND d >= 0 THEN greatest((-b - sqrt(d)) / (2 * a), (-b + sqrt(d)) / (2 * a)) END, 5) AS high FROM y""")
def f23(spark, sf):
    low, high = geo.quadratic_roots(F.col("w") - 0.04, F.col("angle") - 25, "db")
    return detections(spark, sf).select("ok", "ln", "p", F.round(low, 5).alias("low"), F.round(high, 5).alias("high"))


@query("f26_f27_f28_box_rules", f"""WITH {TRACK}, b AS (SELECT file, min(lon) AS west, max(lon) AS east, min(lat) AS south, max(lat) AS north FROM track GROUP BY ALL)
SELECT file, CAST(ceil(round((north - south) / 0.25, 10)) AS BIGINT) AS n_rows, CAST(ceil(round((east - west) / 0.5, 10)) AS BIGINT) AS n_cols, west - east + 360.0 < east - west AS antimeridian,
round(CASE WHEN east - west >= 100 THEN round_even((east - west) / 10, 0) * 10 WHEN east - west >= 10 THEN round_even(east - west, 0) ELSE round_even((east - west) / 0.01, 0) * 0.01 END, 6) AS resolution FROM b""")
def f26(spark, sf):
    b = g.extent(track(spark, sf), "lon", "lat", ["file"])
    width = F.col("east") - F.col("west")
    return b.select(
        "file", geo.cell_count("south", "north", 0.25).alias("n_rows"), geo.cell_count("west", "east", 0.5).alias("n_cols"),
        geo.crosses_antimeridian("west", "east").alias("antimeridian"), F.round(geo.rounded_resolution(width), 6).alias("resolution"),
    )


@query("p31_position_in_cell", f"""WITH {GRID} SELECT "row", col, 1.0 - 0.25 + (col + 0.5) * 0.5 AS x, 2.0 - 0.5 + ("row" + 0.5) * 1.0 AS y FROM grid""")
def p31(spark, sf):
    x, y = GridSpec(1.0, 2.0, 0.5, 1.0, 11, 41).at_position("center").centre("row", "col")
    return grid(spark, sf).select("row", "col", x.alias("x"), y.alias("y"))


@query("x34_compatible_grids", "SELECT TRUE AS same, FALSE AS other_step, FALSE AS other_system")
def x34(spark, sf):
    a = GridSpec(0.0, 0.0, 0.5, 0.5, 10, 10)
    tests = {"same": GridSpec(3.0, 1.0, 0.5, 0.5, 4, 4), "other_step": GridSpec(0.0, 0.0, 0.25, 0.5, 10, 10), "other_system": GridSpec(0.0, 0.0, 0.5, 0.5, 10, 10, "EPSG:3857")}
    return spark.range(1).select(*(F.lit(a.compatible(b)).alias(k) for k, b in tests.items()))


@query("u05_distinct_names", """SELECT s_suppkey, CAST(dense_rank() OVER (ORDER BY n_name) - 1 AS INTEGER) AS name_id FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def u05(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    named = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select("s_suppkey", "n_name")
    return rc.dense_ids(named, ["n_name"], "name_id", cut, first=0).select("s_suppkey", "name_id")


@query("o03_sorted_rolling", f"""WITH {PINGS} SELECT event_id, round(avg(value) OVER (PARTITION BY file ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 5) AS rolling FROM pings""")
def o03(spark, sf):
    return tp.rolling_mean(pings(spark, sf), ["file"], "t", "value", 5, 1).select("event_id", *r("rolling", digits=5))


@query("s10_distances", f"WITH {DET} SELECT ok, ln, p, round(px / 10.0, 4) AS along, round(sy * 1.0, 4) AS across, round(-z - 1.5, 4) AS vertical FROM det")
def s10(spark, sf):
    along, across, vertical = sl.distances("px", "sy", -F.col("z"), F.lit(1.5), 0.1)
    return detections(spark, sf).select("ok", "ln", "p", F.round(along, 4).alias("along"), F.round(across, 4).alias("across"), F.round(vertical, 4).alias("vertical"))


# -- seabed -------------------------------------------------------------------------------------------------

_G = "10.0 / 3"
_ESAB = f"""WITH {DET}, x AS (SELECT ok, ln, p, greatest(1e-8, radians(angle)) AS t, 1.5 + antenna / 2.0 AS z, 4.0 + antenna AS s1, -30.0 + antenna AS mu FROM det),
y AS (SELECT *, 0.7030 + 0.2055 * z AS ratio, power(radians(s1 * power(2.0, ({_G} - 2) / 4)), 2) AS d1, power(radians(20.0), 2) AS d2, power((z - 1) / (z + 1), 2) AS v0, power(tan(t), 2) AS tan2, power(cos(t), 4) AS cos4 FROM x),
k AS (SELECT *, ratio * sin(t) AS s, list_reduce(list_prepend(2 * d1 * 1.5 * ln(10.0), list_transform(range(40), lambda i: CAST(i AS DOUBLE))), lambda u, i: 2 * d1 * (2 * ln(1 + u) + 1.5 * ln(10.0))) AS u FROM y),
w AS (SELECT *, sqrt(greatest(0, 1 - s * s)) AS down FROM k), r AS (SELECT *, CASE WHEN s < 1 THEN power((z * cos(t) - down) / (z * cos(t) + down), 2) ELSE 1.0 END AS v2, 1 / (1 + exp(-degrees(t - atan(sqrt(u))))) AS inner_ FROM w),
q AS (SELECT *, power(2.0, {_G} - 5) * power(pi(), {_G} - 3) * power(4 - {_G}, ({_G} - 2) / 2) * power({_G} - 2, 1 - ({_G} - 2) / 2) * v2 * cos4 / power(sin(t), {_G}) * power(d1, ({_G} - 2) / 2) AS bragg,
  v0 * exp(-tan2 / (2 * d1)) / (8 * pi() * d1 * cos4) * exp(-1) AS f1, v0 * exp(-tan2 / (2 * d2)) / (8 * pi() * d2 * cos4) * exp(-1) AS f2,
  CASE WHEN s < 1 THEN power(10.0, mu / 10) * power(2.0, 0.65) * power(1 - v2, 2) * ratio * ratio * power(cos(t), 2) / greatest(down, 1e-6) / (1 + exp(-degrees(t - radians(10)) / 2)) ELSE 0 END AS vol FROM r)
SELECT ok, ln, p, round(10 * log10((bragg + f2) * inner_ + (1 - inner_) * f1 + vol + 1e-15), 4) AS level FROM q"""


@query("f18_seabed_level", _ESAB)
def f18(spark, sf):
    a = F.col("antenna")
    v = seabed.level("angle", F.lit(300_000.0), 1.5 + a / 2.0, 4.0 + a, F.lit(20.0), -30.0 + a)
    return detections(spark, sf).select("ok", "ln", "p", F.round(v, 4).alias("level"))


@query("x24_seabed_inversion")
def x24(spark, sf):
    """Seabed properties of each mode's mean curve; annealing, so there is no SQL."""
    d = detections(spark, sf).groupBy("mode", F.col("angle").alias("bin")).agg(ac.mean_db(F.col("db") - F.col("angle") / 5).alias("mean_db"))
    return so.invert_seabed(d, ["mode"], 300_000.0).select("mode", *r("impedance", "slope", "second", "volume_db", "rms"))


# -- rasters and files ------------------------------------------------------------------------------------


@query("s18_s19_k06_raster_round_trip", f"""WITH {GRID} SELECT col * 0.5 + 0.25 AS x, "row" + 0.5 AS y, floor(min) AS value FROM grid""")
def k06(spark, sf):
    path = _folder(spark, "raster")
    cells = grid(spark, sf).withColumn("v", F.floor("min"))
    size = cells.agg(F.max("row"), F.max("col")).first()
    spec = GridSpec(0.0, 0.0, 0.5, 1.0, (size[0] or 0) + 1, (size[1] or 0) + 1)
    rasters.write_tiles(cells, "v", spec, path).write.format("noop").mode("overwrite").save()
    return rasters.read_raster(spark, path).select("x", "y", "value")


@query("k09_raster_lines", f"""WITH {GRID} SELECT format('{{:.8f}} {{:.8f}} {{:.2f}}', col * 0.5 + 0.25, "row" + 0.5, CAST(floor(min) AS DOUBLE)) AS value FROM grid""")
def k09(spark, sf):
    return writers.xyz_lines(k06(spark, sf).withColumnRenamed("value", "z"))


@query("s02_s03_sounding_file", """SELECT CAST(i AS BIGINT) AS "mbCycleNbr", CAST(j AS BIGINT) AS "mbBeamNbr", CASE WHEN (i * 7 + j) % 5 <> 0 THEN -(i * 7 + j) * 0.5 + 10 END AS depth, CAST(j % 3 AS DOUBLE) AS flag FROM range(40) a(i), range(7) b(j)""")
def s02(spark, sf):
    """A sounding file of 40 pings written and read by its extension."""
    path = _folder(spark, "soundings") + ".mbg"
    n = np.arange(280).reshape(40, 7)
    layers = {"mbAlongDistance": n, "mbAcrossDistance": n, "mbDepth": np.where(n % 5 == 0, -9999, -n), "mbSFlag": n % 7 % 3}
    extra = {"mbDepth": {"_FillValue": -9999.0, "scale_factor": 0.5, "add_offset": 10.0, "units": "m"}}
    dims = dict(zip(readers.MBG_DIMENSIONS, (40, 7)))
    raw = netcdf3.file_bytes(dims, {k: (readers.MBG_DIMENSIONS, v.astype("i4"), extra.get(k, {})) for k, v in layers.items()})
    fs, base = pafs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/line.mbg") as f:
        f.write(raw)
    return readers.read(spark, path).select(*readers.MBG_DIMENSIONS, F.col("mbDepth").alias("depth"), F.col("mbSFlag").alias("flag"))


@query("x18_rays_to_depth")
def x18(spark, sf):
    d = detections(spark, sf).select(F.xxhash64("ok", "ln", "p").alias("id"), (-F.col("z")).alias("depth"), F.col("angle").alias("incidence"))
    out = so.trace_to_depth(d, [0.0, 100.0, 400.0, 1200.0], [1500.0, 1490.0, 1480.0, 1495.0], 5.0)
    return out.select("id", *r("x", "seconds"))


@query("w19_stop_band")
def w19b(spark, sf):
    """Each file's series through the stop-band filter of order 2, 40 dB."""
    return so.low_pass(pings(spark, sf), ["file"], "t", "value", 2, 0.2, 40.0).select("file", "t", *r("filtered"))


# -- neighbourhoods -----------------------------------------------------------------------------------------


@query("a17_merge_with_border", f"""WITH {GRIDS}, m AS (SELECT "row", col, arg_min(mean, priority) AS mean FROM grids GROUP BY ALL), f AS (SELECT "row" AS fr, col AS fc FROM grids WHERE priority = 0),
n AS (SELECT m."row", m.col, count(*) AS c FROM m JOIN f ON abs(fr - m."row") <= 1 AND abs(fc - m.col) <= 1 GROUP BY ALL),
b AS (SELECT m."row", m.col, avg(s.mean) AS a FROM m JOIN m s ON abs(s."row" - m."row") <= 1 AND abs(s.col - m.col) <= 1 GROUP BY ALL)
SELECT m."row", m.col, round(CASE WHEN c BETWEEN 1 AND 8 THEN a ELSE mean END, 4) AS mean FROM m JOIN b USING ("row", col) LEFT JOIN n USING ("row", col)""")
def a17(spark, sf):
    return st.merge_smoothed(grids(spark, sf), "mean").withColumn("mean", F.round("mean", 4))


@query("x15_peaks_by_deviation", f"""WITH {GRID}, n AS (SELECT t."row", t.col, any_value(t.mean) AS mean, avg(s.mean) AS m, stddev_pop(s.mean) AS d FROM grid t JOIN grid s ON abs(s."row" - t."row") <= 1 AND abs(s.col - t.col) <= 1 GROUP BY t."row", t.col)
SELECT "row", col, round(mean, 4) AS mean FROM n WHERE abs(mean - m) > 1.5 * d""")
def x15d(spark, sf):
    return st.peaks_by_deviation(grid(spark, sf).select("row", "col", "mean"), "mean", 1.5).select("row", "col", *r("mean"))


@query("x09_bilinear_fill")
def x09(spark, sf):
    fine = detections(spark, sf).groupBy(F.col("sy").cast("int").alias("row"), F.floor(F.col("px") / 20).cast("int").alias("col")).agg(F.avg("z").alias("mean"))
    return st.bilinear_fill(fine.filter("(row * 7 + col) % 5 != 0"), "mean", 2, 3).select("row", "col", *r("mean"))
