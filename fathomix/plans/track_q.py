"""Queries on regridding, contours, tiles, tracks and mode graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..functions.geo import GridSpec
from ..operators import angular as an
from ..operators import grid as gr
from ..operators import records as rc
from ..operators import resample as rs_
from ..operators import temporal as tp
from ..operators import tracks as tr
from .bind import DET, GRID, PINGS, TRACK, detections, grid, pings, r, table, track
from .registry import query
from .tables import cut

_SRC, _DST = GridSpec(0.0, 0.0, 10.0, 20.0, 11, 41, "x"), GridSpec(3.0, 1.0, 7.0, 15.0, 12, 50, "x")


@query("j01_x14_resample_grid", f"""WITH {GRID}, t AS (SELECT CAST(i AS INTEGER) AS r, CAST(j AS INTEGER) AS k, CAST(floor((1 + (i + 0.5) * 15) / 20) AS INTEGER) AS "row", CAST(floor((3 + (j + 0.5) * 7) / 10) AS INTEGER) AS col FROM range(12) a(i), range(50) b(j))
SELECT r AS "row", k AS col, round(mean, 4) AS mean FROM t JOIN grid USING ("row", col)""")
def j01(spark, sf):
    return rs_.onto(grid(spark, sf).select("row", "col", "mean"), _SRC, _DST).withColumn("mean", F.round("mean", 4))


@query("j18_bilinear_lookup", f"""WITH {GRID}, p AS (SELECT ok, ln, p, px / 50.0 - 0.5 AS fx, sy / 10.0 - 0.5 AS fy FROM det), q AS (SELECT *, floor(fx) AS i, floor(fy) AS j FROM p),
k AS (SELECT q.*, CASE di WHEN 1 THEN fx - i ELSE 1 - (fx - i) END * CASE dj WHEN 1 THEN fy - j ELSE 1 - (fy - j) END AS w, i + di AS c2, j + dj AS r2 FROM q, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(di, dj))
SELECT ok, ln, p, round(sum(w * mean), 4) AS mean FROM k JOIN grid ON grid."row" = r2 AND grid.col = c2 GROUP BY ok, ln, p, fx, fy HAVING count(*) = 4""")
def j18(spark, sf):
    d = detections(spark, sf)
    return rs_.bilinear(d, grid(spark, sf), "mean", F.col("px") / 50.0, F.col("sy") / 10.0, ["ok", "ln", "p", "px", "sy"]).select("ok", "ln", "p", *r("mean"))


@query("j14_nearest_cell", f"""WITH {GRID} SELECT "row", col FROM grid ORDER BY power("row" - 3.2, 2) + power(col - 17.4, 2), "row", col LIMIT 1""")
def j14(spark, sf):
    return gr.nearest_cell(grid(spark, sf), 3.2, 17.4).select("row", "col")


_IDW = """w AS (SELECT t."row", t.col, sum(s.mean / sqrt(power(s."row" - t."row", 2) + power(s.col - t.col, 2))) / sum(1 / sqrt(power(s."row" - t."row", 2) + power(s.col - t.col, 2))) AS mean
FROM (SELECT DISTINCT CAST("row" + i AS INTEGER) AS "row", CAST(col + j AS INTEGER) AS col FROM h, range(-2, 3) a(i), range(-2, 3) b(j)) t JOIN h s ON abs(s."row" - t."row") <= 2 AND abs(s.col - t.col) <= 2 AND (s."row", s.col) <> (t."row", t.col) GROUP BY t."row", t.col)"""


@query("x10_x13_inverse_distance_fill", f"""WITH {GRID}, h AS (SELECT "row", col, mean FROM grid WHERE value_count % 5 <> 0), {_IDW} SELECT "row", col, round(w.mean, 4) AS mean FROM w ANTI JOIN h USING ("row", col)""")
def x10(spark, sf):
    return rs_.inverse_distance_fill(grid(spark, sf).filter("value_count % 5 != 0"), "mean", 2).withColumn("mean", F.round("mean", 4))


@query("x17_residual_rejection", f"""WITH {GRID}, n AS (SELECT t."row", t.col, any_value(t.mean) AS mean, avg(s.mean) AS m, stddev_pop(s.mean) AS d FROM grid t JOIN grid s ON abs(s."row" - t."row") <= 1 AND abs(s.col - t.col) <= 1 AND (s."row", s.col) <> (t."row", t.col) GROUP BY t."row", t.col HAVING count(*) > 2)
SELECT "row", col, round(mean, 4) AS mean FROM n WHERE abs(mean - m) > 1.5 * d""")
def x17(spark, sf):
    return rs_.residual_rejection(grid(spark, sf), "mean", 1.5).withColumn("mean", F.round("mean", 4))


@query("k08_contour_crossings", f"""WITH {GRID}, e AS (SELECT a."row", a.col, a.mean AS a, b.mean AS b, b.col - a.col AS h FROM grid a JOIN grid b ON (b."row" = a."row" AND b.col = a.col - 1) OR (b."row" = a."row" + 1 AND b.col = a.col)),
l AS (SELECT *, unnest(range(CAST(floor(least(a, b) / 50) + 1 AS BIGINT), CAST(floor(greatest(a, b) / 50) + 1 AS BIGINT))) * 50.0 AS level FROM e)
SELECT CAST(level AS DOUBLE) AS level, round(col + CASE WHEN h = -1 THEN -(level - a) / (b - a) ELSE 0 END, 4) AS x, round("row" + CASE WHEN h = 0 THEN (level - a) / (b - a) ELSE 0 END, 4) AS y FROM l""")
def k08(spark, sf):
    return rs_.contour_crossings(grid(spark, sf), "mean", 50.0).select("level", *r("x", "y"))


_TILE = "CAST(floor((radians(lon) * 6378137.0 + pi() * 6378137.0) / (2 * pi() * 6378137.0) * {n}) AS INTEGER) AS tx, CAST(floor((pi() * 6378137.0 - 6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2))) / (2 * pi() * 6378137.0) * {n}) AS INTEGER) AS ty"


@query("k07_tile_pyramid", f"""WITH {TRACK}, t AS ({' UNION ALL '.join(f"SELECT {z} AS zoom, {_TILE.format(n=1 << z)}, value FROM track" for z in (2, 5))}) SELECT zoom, tx, ty, round(avg(value), 4) AS mean, count(value) AS n FROM t GROUP BY ALL""")
def k07(spark, sf):
    return rs_.pyramid(track(spark, sf), "lon", "lat", "value", [2, 5]).withColumn("mean", F.round("mean", 4))


@query("a49_label_of_holes")
def a49(spark, sf):
    h = grid(spark, sf).withColumn("mean", F.when(F.col("value_count") % 5 != 0, F.col("mean")))
    return rs_.label_holes(h, "mean", "cdi", "value_count", cut)


@query("x19_beam_direction", f"""WITH {DET}, x AS (SELECT *, sin(radians(w * 100)) AS x, sin(radians(w * 100)) * tan(radians(1.5)) - sin(radians(angle)) / cos(radians(1.5)) AS y FROM det)
SELECT ok, ln, p, round(degrees(atan2(sqrt(x * x + y * y), sqrt(greatest(0, 1 - x * x - y * y)))), 4) AS incidence, round(degrees(atan2(y, x)), 4) AS azimuth FROM x""")
def x19(spark, sf):
    i, a = geo.beam_direction(F.col("w") * 100, "angle", 1.5)
    return detections(spark, sf).select("ok", "ln", "p", F.round(i, 4).alias("incidence"), F.round(a, 4).alias("azimuth"))


_LERP = "CASE WHEN t0 IS NULL OR t1 IS NULL THEN 0 WHEN t0 = t1 THEN {0}0 ELSE {0}0 + ({0}1 - {0}0) * (t - t0) / (t1 - t0) END"


@query("x31_j20_shift_navigation", f"""WITH {TRACK}, v AS (SELECT file, t, value - 50 AS e, 50 - value AS n FROM track WHERE kind = 'purchase'),
a AS (SELECT k.*, v.t AS t0, v.e AS e0, v.n AS n0 FROM track k ASOF LEFT JOIN v ON k.file = v.file AND k.t >= v.t), b AS (SELECT a.*, v.t AS t1, v.e AS e1, v.n AS n1 FROM a ASOF LEFT JOIN v ON a.file = v.file AND a.t <= v.t),
s AS (SELECT event_id, lon, lat, {_LERP.format('e')} AS east, {_LERP.format('n')} AS north, 1 - {geo.E2!r} * power(sin(radians(lat)), 2) AS k FROM b)
SELECT event_id, round(degrees(east / ({geo.SEMI_MAJOR!r} / sqrt(k))) / cos(radians(lat)) + lon, 6) AS lon, round(degrees(north / ({geo.SEMI_MAJOR!r} / sqrt(k) * (1 - {geo.E2!r}) / k)) + lat, 6) AS lat FROM s""")
def x31(spark, sf):
    n = track(spark, sf)
    v = n.filter("kind = 'purchase'").select("file", "t", (F.col("value") - 50).alias("east"), (50 - F.col("value")).alias("north"))
    return tr.shift(n.select("event_id", "file", "t", "lon", "lat"), v, ["file"], "t").select("event_id", *r("lon", "lat", digits=6))


@query("w22_resample_paths")
def w22(spark, sf):
    return tr.resample_paths(track(spark, sf).select("file", "t", F.col("lon").alias("x"), F.col("lat").alias("y")), "file", "t", 50).select("file", "i", *r("x", "y"))


@query("w15_chain_code", f"""WITH {TRACK}, d AS (SELECT file, t, lead(lon) OVER w - lon AS dx, lead(lat) OVER w - lat AS dy FROM track WINDOW w AS (PARTITION BY file ORDER BY t)),
p AS (SELECT file, t, (degrees(atan2(dx, dy)) % 360 + 360) % 360 AS a, sqrt(dx * dx + dy * dy) AS d FROM d),
q AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY file ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS along FROM p), m AS (SELECT *, CAST(round(along * 1000) AS BIGINT) AS mm FROM q)
SELECT file, t, round(along, 4) AS along, round(avg(a) OVER (PARTITION BY file ORDER BY mm RANGE BETWEEN CURRENT ROW AND 100000 FOLLOWING) - avg(a) OVER (PARTITION BY file ORDER BY mm RANGE BETWEEN 100000 PRECEDING AND CURRENT ROW), 4) AS code FROM m""")
def w15(spark, sf):
    return tr.chain_code(track(spark, sf).select("file", "t", F.col("lon").alias("x"), F.col("lat").alias("y")), "file", "t", 200.0).select("file", "t", *r("along", "code"))


@query("w06_propagated_offsets", f"""WITH RECURSIVE {PINGS}, s AS (SELECT kind AS mode, value AS level, t, lag(kind) OVER w AS m0, lag(value) OVER w AS l0, lag(t) OVER w AS t0 FROM pings WINDOW w AS (PARTITION BY file ORDER BY t)),
f AS (SELECT m0 AS a, mode AS b, avg(level - l0) AS o, count(*) AS n FROM s WHERE m0 <> mode AND t / 1e6 - t0 / 1e6 <= 86400 GROUP BY ALL), g AS (SELECT a, b, sum(o * n) / sum(n) AS o, sum(n) AS n FROM (SELECT * FROM f UNION ALL SELECT b, a, -o, n FROM f) GROUP BY ALL),
main AS (SELECT kind AS mode FROM pings GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1),
walk(d, reached) AS (SELECT 0, [{{'mode': mode, 'offset': 0.0::DOUBLE, 'weight': 'infinity'::DOUBLE, 'd': 0}}] FROM main
  UNION ALL SELECT d + 1, list_concat(reached, fresh) FROM (SELECT d, reached, (SELECT list({{'mode': b, 'offset': o, 'weight': w, 'd': d + 1}}) FROM (SELECT b, sum(o * w) / sum(w) AS o, sum(w) AS w FROM (
    SELECT g.b, r.x.offset + g.o AS o, CASE WHEN isinf(r.x.weight) THEN g.n ELSE r.x.weight * g.n / (r.x.weight + g.n) END AS w FROM (SELECT unnest(reached) AS x) r JOIN g ON g.a = r.x.mode
    WHERE r.x.d = d AND NOT list_contains(list_transform(reached, lambda v: v.mode), g.b)) GROUP BY b)) AS fresh FROM walk) WHERE fresh IS NOT NULL)
SELECT x.mode AS mode, round(x.offset, 5) AS offset FROM (SELECT unnest(max_by(reached, d)) AS x FROM walk)""")
def w06(spark, sf):
    """Offsets of all modes against the commonest one, which is 0."""
    p = pings(spark, sf).select("file", (F.col("t") / 1e6).alias("t"), F.col("kind").alias("mode"), F.col("value").alias("level"))
    main = p.groupBy("mode").count().orderBy(F.desc("count"), "mode").limit(1)
    return tr.propagate_offsets(cut(an.transitions(p, 86400.0)), main, cut).select("mode", F.round("offset", 5).alias("offset"))


_LV = PINGS + ", lv AS (SELECT t, kind AS mode, event_id % 5 AS bin, -20 - value / 100 AS mean_db, event_id FROM pings)"


@query("f16_sliding_normalisation", f"""WITH {_LV}, s AS (SELECT *, quantile_cont(mean_db, 0.5) OVER (PARTITION BY mode, bin ORDER BY t RANGE BETWEEN 14399999999 PRECEDING AND 14400000000 FOLLOWING) AS c FROM lv), f AS (SELECT mode, avg(mean_db) AS ref FROM lv WHERE bin >= 3 GROUP BY ALL)
SELECT event_id, round(mean_db + ref - c, 6) AS corrected FROM s JOIN f USING (mode)""")
def f16(spark, sf):
    i = F.col("event_id")
    lv = pings(spark, sf).select("t", "event_id", F.col("kind").alias("mode"), (i % 5).alias("bin"), (-20 - F.col("value") / 100).alias("mean_db"), F.lit(1).alias("n"))
    ref = lv.filter("bin >= 3").groupBy("mode").agg(F.avg("mean_db").alias("ref"))
    s = tp.sliding_curve(lv, ["mode", "bin"], "t", 480).join(ref, "mode")
    return s.select("event_id", F.round(F.col("mean_db") + F.col("ref") - F.col("sliding_db"), 6).alias("corrected"))


@query("j23_equivalent_mode", """SELECT n_nationkey, arg_min(r_regionkey, (CASE WHEN r_regionkey = n_regionkey THEN 0 ELSE 1 END, r_regionkey)) AS r_regionkey FROM nation JOIN region ON r_regionkey <= n_regionkey GROUP BY ALL""")
def j23(spark, sf):
    n, g = table(spark, sf, "nation"), table(spark, sf, "region")
    rank = [F.when(F.col("r_regionkey") == F.col("n_regionkey"), 0).otherwise(1), F.col("r_regionkey")]
    return tr.first_match(n, g, F.col("r_regionkey") <= F.col("n_regionkey"), ["n_nationkey"], rank, ["r_regionkey"])


@query("j24_frequency_interpolation", f"""WITH {DET}, f AS (SELECT mode, antenna * 100.0 AS x, avg(db) AS y FROM det WHERE antenna % 2 = 1 GROUP BY ALL), q AS (SELECT DISTINCT mode, antenna FROM det WHERE antenna % 2 = 0)
SELECT q.mode, q.antenna, round(a.y + (b.y - a.y) * 0.5, 5) AS level FROM q JOIN f a ON a.mode = q.mode AND a.x = (q.antenna - 1) * 100 JOIN f b ON b.mode = q.mode AND b.x = (q.antenna + 1) * 100""")
def j24(spark, sf):
    d = detections(spark, sf)
    f = d.filter("antenna % 2 = 1").groupBy("mode", (F.col("antenna") * 100.0).alias("bin")).agg(F.avg("db").alias("mean_db"))
    q = d.filter("antenna % 2 = 0").select("mode", "antenna").distinct()
    return q.join(an.as_lookup(f, ["mode"]), "mode").select("mode", "antenna", F.round(an.interpolate(F.col("lut"), F.col("antenna") * 100.0), 5).alias("level"))


@query("j26_merge_curves_outer", f"""WITH {DET} SELECT mode, bin, max(a) AS a, max(b) AS b FROM (SELECT mode, antenna AS bin, count(*) AS a, NULL AS b FROM det WHERE antenna < 5 GROUP BY ALL UNION ALL SELECT mode, antenna, NULL, count(*) FROM det WHERE antenna > 3 GROUP BY ALL) GROUP BY ALL""")
def j26(spark, sf):
    g = lambda cond, k: detections(spark, sf).filter(cond).groupBy("mode", F.col("antenna").alias("bin")).agg(F.count("*").alias(k))
    return rc.outer_merge([g("antenna < 5", "a"), g("antenna > 3", "b")], ["mode", "bin"])


@query("p21_expected_deviation", f"""WITH {DET}, x AS (SELECT *, greatest(0, least(60, degrees(atan(px / 10.0 / -z)))) AS a FROM det) SELECT ok, ln, p, round(CASE WHEN a <= 30 THEN 0.1 + a / 30 * 0.2 ELSE 0.3 + (a - 30) / 30 * 0.7 END, 5) AS expected FROM x""")
def p21(spark, sf):
    lut = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.1), (30.0, 0.3), (60.0, 1.0))))
    a = F.degrees(F.atan(F.col("px") / 10.0 / -F.col("z")))
    return detections(spark, sf).select("ok", "ln", "p", F.round(an.interpolate(lut, a), 5).alias("expected"))


@query("p27_mask_invalid", f"WITH {DET} SELECT ok, ln, p, CASE WHEN antenna % 3 = 0 THEN z END AS z FROM det")
def p27(spark, sf):
    return rc.mask_invalid(detections(spark, sf), ["z"], F.col("antenna") % 3 == 0).select("ok", "ln", "p", "z")


@query("a45_elevation_range", f"WITH {DET} SELECT min(z) AS low, max(z) AS high, count(*) AS n FROM det")
def a45(spark, sf):
    return rc.bounds(detections(spark, sf), {"z": "low high"})


@query("o01_sort_navigation", f"WITH {TRACK} SELECT event_id, t, round(lon, 6) AS lon, round(lat, 6) AS lat FROM track ORDER BY t")
def o01(spark, sf):
    return rc.together([track(spark, sf)], ["t"]).select("event_id", "t", *r("lon", "lat", digits=6))


@query("w04_reference_level", f"""WITH {_LV}, f AS (SELECT mode, t // 3600000000 AS h, avg(CASE WHEN bin >= 3 THEN mean_db END) AS v FROM lv GROUP BY ALL), k AS (SELECT * FROM f WHERE v IS NOT NULL),
a AS (SELECT f.*, k.h AS h0, k.v AS v0 FROM f ASOF LEFT JOIN k ON f.mode = k.mode AND f.h >= k.h), b AS (SELECT a.*, k.h AS h1, k.v AS v1 FROM a ASOF LEFT JOIN k ON a.mode = k.mode AND a.h <= k.h)
SELECT mode, h, round(coalesce(v, v0 + (v1 - v0) * (h - h0) / nullif(h1 - h0, 0), v0, v1), 6) AS v FROM b""")
def w04(spark, sf):
    from pyspark.sql import Window

    lv = pings(spark, sf).select(F.col("kind").alias("mode"), F.floor(F.col("t") / 3_600_000_000).alias("h"), F.when(F.col("event_id") % 5 >= 3, -20 - F.col("value") / 100).alias("v"))
    f = tp.fill_linear(lv.groupBy("mode", "h").agg(F.avg("v").alias("v")), ["mode"], "h", "v")
    w = Window.partitionBy("mode").orderBy("h")
    edge = F.coalesce(F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("v", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    return f.select("mode", "h", F.round(F.coalesce("v", edge), 6).alias("v"))
