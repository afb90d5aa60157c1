"""Queries on beam geometry: footprints, launch vectors of two separate arrays, relaunched soundings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import beams as bm
from ..operators import registration as rg
from ..operators import triangulation as tg
from .bind import DET, TRACK, detections, r, table, track
from .registry import query


def _beams(spark, sf):
    """Detections as beams: steering angles, arrays that stand apart and not quite at a right angle."""
    d = detections(spark, sf)
    return d.select(
        "ok", "ln", "p", "mode", F.datediff("t", F.lit("1990-01-01")).cast("long").alias("t"), (F.col("w") * 100 - 4).alias("tx_steer"), ((F.col("angle") - 25.5) * 2).alias("rx_steer"),
        ((F.col("antenna") - 4) * 0.5).alias("delta"), (F.col("antenna") * 0.25).alias("sx"), F.lit(-0.75).alias("sy"), (F.col("antenna") * 0.1).alias("sz"),
        (F.col("p") / 1000 + 5).alias("depth"), (0.02 + F.col("p") / 1e6).alias("seconds"), F.lit(3.0).alias("tx_depth"), F.lit(None).cast("double").alias("speed"),
    )


@query("x20_f24_footprints", f"""WITH RECURSIVE {DET}, b AS (SELECT row_number() OVER () AS i, ok, ln, p, tan(radians(w * 100 - 4)) AS a, tan(-radians((angle - 25.5) * 2)) AS k, radians((antenna - 4) * 0.5) AS m, antenna * 0.25 AS sx, -0.75 AS sy,
  antenna * 0.1 AS sz, p / 1000 + 5 AS z FROM det), s AS (SELECT i, a, k, m, sx, sy, sz, z, -1e4 AS lo, 1e4 AS hi, 0 AS n FROM b
  UNION ALL SELECT i, a, k, m, sx, sy, sz, z, CASE WHEN miss < 0 THEN mid ELSE lo END, CASE WHEN miss < 0 THEN hi ELSE mid END, n + 1 FROM (SELECT *, -sin(m) * (x - sx) + cos(m) * (mid - sy) - k * sqrt(power(cos(m) * (x - sx) + sin(m) * (mid - sy), 2) + power(z - sz, 2)) AS miss
    FROM (SELECT *, a * sqrt(mid * mid + z * z) AS x FROM (SELECT *, (lo + hi) / 2 AS mid FROM s WHERE n < 52))))
SELECT ok, ln, p, round(s.a * sqrt(lo * lo + s.z * s.z), 4) AS fx, round(lo, 4) AS fy FROM s JOIN b USING (i) WHERE n = 52""")
def x20(spark, sf):
    """Where transmit and receive cones meet on a plane, by the quartic; the SQL halves intervals."""
    return bm.footprint_table(_beams(spark, sf)).select("ok", "ln", "p", *r("fx", "fy"))


def _profiles(spark, sf):
    """A sound-speed profile of seven layers a year, in force from its first day."""
    d = table(spark, sf, "lineitem").groupBy(F.year("l_shipdate").alias("profile"), F.col("l_linenumber").alias("n")).agg(F.avg("l_discount").alias("v"))
    layers = d.select("profile", ((F.col("n") - 1) * 15.0).alias("depth"), (1480 + F.col("v") * 200 + F.col("n")).alias("speed"))
    years = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("mode"), F.year("l_shipdate").alias("profile")).distinct()
    taken = years.select("mode", F.datediff(F.make_date("profile", F.lit(1), F.lit(1)), F.lit("1990-01-01")).cast("long").alias("t"), "profile")
    return layers, taken


@query("x19_x21_launch_triangles")
def x19n(spark, sf):
    """Launch angles and one-way times of separate arrays, level platform, the profile of the time."""
    layers, taken = _profiles(spark, sf)
    b = bm.with_profile(_beams(spark, sf).withColumns({"roll": F.lit(0.0), "pitch": F.lit(0.0)}), taken, ["mode"], "t", 90)
    return bm.launch(b, layers, "t", 90, "triangles").select("ok", "ln", "p", *r("incidence", "azimuth"), *r("one_way", digits=8))


@query("x21_relaunch")
def x21(spark, sf):
    """Soundings anew by the cones' crossing, attitude interpolated at their time, then their place."""
    layers, taken = _profiles(spark, sf)
    i = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("mode"), (F.floor(F.datediff("l_shipdate", F.lit("1990-01-01")) / 7) * 7).cast("long").alias("t"))
    att = i.agg(((F.avg("l_discount") - 0.05) * 100).alias("roll"), ((F.avg("l_tax") - 0.04) * 50).alias("pitch"), (F.avg("l_quantity") / 50 - 0.5).alias("heave"))
    out = bm.relaunch(_beams(spark, sf), att, taken, layers, ["mode"], "t", 90)
    lon, lat = geo.offset_position("x", "y", F.lit(-4.5), F.lit(48.25), (F.col("t") % 360).cast("double"))
    return out.withColumns({"lon": lon, "lat": lat}).select("ok", "ln", "p", *r("incidence", "azimuth"), *r("one_way", digits=8), *r("depth"), *r("lon", "lat", digits=8))


@query("x26_w16_registration", f"""WITH {TRACK}, d AS (SELECT file, sqrt(power(lead(lon) OVER w - lon, 2) + power(lead(lat) OVER w - lat, 2)) AS d FROM track WINDOW w AS (PARTITION BY file ORDER BY t))
SELECT file AS line, file AS target, file % 7 * 0.5 - 1.5 AS east, 1.0 - file % 5 * 0.5 AS north FROM d GROUP BY file HAVING round(sum(d) / 8) > 200""")
def x26(spark, sf):
    """Every file's track against its copy, moved by a shift of its own that must be found again;
    200 vertices, 1.6 km, have to meet."""
    s = track(spark, sf).select(F.col("file").alias("line"), (F.col("file") % 10).alias("level"), F.col("t").alias("i"), (F.col("lon") + F.col("file") * 1000.0).alias("x"), F.col("lat").alias("y"))
    t = s.withColumns({"x": F.col("x") + F.col("line") % 7 * 0.5 - 1.5, "y": F.col("y") + 1 - F.col("line") % 5 * 0.5})
    out = rg.shift_vectors(s, t, reach=100.0, spacing=8.0, least=200)
    return out.select("line", "target", F.round("east", 3).alias("east"), F.round("north", 3).alias("north"))


@query("x10_triangulated", f"""WITH {DET}, pts AS (SELECT * FROM (SELECT CAST(floor(sy / 10) AS BIGINT) AS "row", CAST(floor(px / 50) AS BIGINT) AS col, avg(px / 50) AS x, avg(sy / 10) AS y, avg(z) AS v, count(*) AS n FROM det GROUP BY ALL) WHERE n % 5 <> 0),
near AS (SELECT "row" + dr AS r, col + dc AS c, x - (col + dc + 0.5) AS x, y - ("row" + dr + 0.5) AS y, v, "row" * 1000000 + col AS k, n FROM pts, (SELECT unnest(range(-2, 3)) AS dr), (SELECT unnest(range(-2, 3)) AS dc)),
tri AS (SELECT *, (bx - ax) * (cy - ay) - (b_y - ay) * (cx - ax) AS d FROM (SELECT a.r, a.c, a.x AS ax, a.y AS ay, a.v AS av, b.x AS bx, b.y AS b_y, b.v AS bv, e.x AS cx, e.y AS cy, e.v AS cv
  FROM near a JOIN near b ON a.r = b.r AND a.c = b.c AND a.k < b.k JOIN near e ON e.r = b.r AND e.c = b.c AND b.k < e.k)),
w AS (SELECT *, (bx * cy - b_y * cx) / d AS wa, (cx * ay - cy * ax) / d AS wb, (ax * b_y - ay * bx) / d AS wc FROM tri WHERE abs(d) > 1e-12),
o AS (SELECT *, ((cy - ay) * (power(bx - ax, 2) + power(b_y - ay, 2)) - (b_y - ay) * (power(cx - ax, 2) + power(cy - ay, 2))) / (2 * d) AS ux, ((bx - ax) * (power(cx - ax, 2) + power(cy - ay, 2)) - (cx - ax) * (power(bx - ax, 2) + power(b_y - ay, 2))) / (2 * d) AS uy FROM w WHERE wa >= 0 AND wb >= 0 AND wc >= 0),
f AS (SELECT *, sqrt(ux * ux + uy * uy) AS rad FROM o)
SELECT f.r AS "row", f.c AS col, round(wa * av + wb * bv + wc * cv, 4) AS value, EXISTS (SELECT 1 FROM pts WHERE "row" = f.r AND col = f.c) AS known FROM f
WHERE greatest(abs(ux + ax), abs(uy + ay)) + rad <= 2 AND NOT EXISTS (SELECT 1 FROM near p WHERE p.r = f.r AND p.c = f.c AND sqrt(power(p.x - ux - ax, 2) + power(p.y - uy - ay, 2)) < rad - 1e-9)""")
def x10(spark, sf):
    """Cells' mean points, some missing, as a triangulated surface at all cells' middles; the SQL tries all triples."""
    d = detections(spark, sf).select((F.col("px") / 50).alias("x"), (F.col("sy") / 10).alias("y"), "z")
    return tg.interpolate(tg.centroids(d, "x", "y", "z").filter("n % 5 != 0"), 2).withColumn("value", F.round("value", 4))
