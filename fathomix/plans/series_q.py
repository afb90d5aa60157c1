"""Queries on time series, lookups, angular curves, slices, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import acoustics as ac
from ..functions import geo
from ..operators import angular as an
from ..operators import records as rc
from ..operators import slices as sl
from ..operators import temporal as tp
from .bind import DET, PINGS, TRACK, detections, pings, r, table, track
from .registry import query
from .tables import cut

# -- angular curves -----------------------------------------------------------------------------

_CURVE = """cur AS (SELECT mode, antenna, sector, CAST(least(floor(angle + 0.5), 89) AS INTEGER) AS bin, 10 * log10(avg(power(10, db / 10))) AS mean_db, count(*) AS n
FROM det WHERE angle BETWEEN -0.5 AND 89.5 GROUP BY ALL)"""


def _curve(spark, sf):
    return an.incidence_curve(detections(spark, sf), "db", "angle")


@query("a21_incidence_curve", f"WITH {DET}, {_CURVE} SELECT mode, antenna, sector, bin, round(mean_db, 4) AS mean_db, n FROM cur")
def a21(spark, sf):
    return _curve(spark, sf).withColumn("mean_db", F.round("mean_db", 4))


@query("a21_incidence_median", f"""WITH {DET} SELECT mode, antenna, sector, CAST(least(floor(angle + 0.5), 89) AS INTEGER) AS bin, round(10 * log10(quantile_cont(power(10, db / 10), 0.5)), 4) AS mean_db, count(*) AS n FROM det GROUP BY ALL""")
def a21b(spark, sf):
    return an.incidence_curve(detections(spark, sf), "db", "angle", median=True).withColumn("mean_db", F.round("mean_db", 4))


_RES = _CURVE + """, res AS (SELECT det.*, db - mean_db AS residual FROM det JOIN cur USING (mode, antenna, sector) WHERE cur.bin = det.angle)"""


@query("a22_transmission_residual", f"""WITH {DET}, {_RES} SELECT mode, antenna, sector, CAST(least(floor(angle - 25 + 80.5), 160) AS INTEGER) AS bin, round(10 * log10(avg(power(10, db / 10))), 4) AS mean_db,
round(avg(residual), 4) AS residual_db, count(residual) AS n FROM res GROUP BY ALL""")
def a22(spark, sf):
    """Angles are whole numbers here, so the curve's points are hit exactly."""
    d = an.residuals(detections(spark, sf), _curve(spark, sf), "db", "angle", an.CURVE)
    return an.transmission_curve(d, "db", "residual", F.col("angle") - 25).select(*an.CURVE, "bin", *r("mean_db", "residual_db"), "n")


@query("a23_a27_merge_curves", f"WITH {DET}, {_CURVE} SELECT mode, bin, round(sum(mean_db * n) / sum(n), 4) AS mean_db, CAST(sum(n) AS BIGINT) AS n FROM cur GROUP BY ALL")
def a23(spark, sf):
    return an.merge_curves(_curve(spark, sf), ["mode", "bin"]).withColumn("mean_db", F.round("mean_db", 4))


@query("a26_common_curve", f"WITH {DET}, {_CURVE} SELECT bin, round(sum(mean_db * n) / sum(n), 4) AS mean_db, CAST(sum(n) AS BIGINT) AS n FROM cur GROUP BY ALL")
def a26(spark, sf):
    return an.merge_curves(_curve(spark, sf), ["bin"]).withColumn("mean_db", F.round("mean_db", 4))


@query("a28_split_by_mode", f"WITH {DET}, {_CURVE} SELECT mode, count(*) AS points, CAST(sum(n) AS BIGINT) AS n FROM cur GROUP BY ALL")
def a28(spark, sf):
    return _curve(spark, sf).groupBy("mode").agg(F.count("*").alias("points"), F.sum("n").alias("n"))


@query("a30_reference_level", f"WITH {DET}, {_CURVE} SELECT round(sum(mean_db * n) / sum(n), 5) AS level FROM cur")
def a30(spark, sf):
    return an.reference_level(_curve(spark, sf)).select(F.round("level", 5).alias("level"))


@query("a33_metrics", f"""WITH {DET}, g AS (SELECT 5 * round_even(angle / 5, 0) AS x, mode, avg(z) AS mean, stddev_samp(z) AS std, quantile_cont(z, 0.9) AS quantile, count(z) AS n FROM det GROUP BY ALL),
s AS (SELECT *, 100.0 * n / sum(n) OVER (PARTITION BY x) AS share FROM g) SELECT x, mode, round(CASE WHEN share >= 30 THEN mean END, 4) AS mean, round(CASE WHEN share >= 30 THEN std END, 4) AS std,
round(CASE WHEN share >= 30 THEN quantile END, 3) AS quantile, n FROM s""")
def a33(spark, sf):
    m = an.metrics(detections(spark, sf), ac.round_bin("angle", 5.0), "z", 0.9, 30.0, ["mode"])
    return m.select("x", "mode", *r("mean", "std"), *r("quantile", digits=3), "n")


@query("j06_f15_static_normalisation", f"""WITH {DET}, {_CURVE}, odd AS (SELECT * FROM cur WHERE bin % 2 = 1), b AS (SELECT mode, antenna, sector, min(bin) AS lo, max(bin) AS hi FROM odd GROUP BY ALL),
x AS (SELECT det.*, greatest(least(CAST(angle AS INTEGER), hi), lo) AS a FROM det JOIN b USING (mode, antenna, sector)),
y AS (SELECT ok, ln, p, db, a, (SELECT arg_max((bin, mean_db), bin) FROM odd o WHERE o.mode = x.mode AND o.antenna = x.antenna AND o.sector = x.sector AND o.bin <= a) AS u,
(SELECT arg_min((bin, mean_db), bin) FROM odd o WHERE o.mode = x.mode AND o.antenna = x.antenna AND o.sector = x.sector AND o.bin >= a) AS v FROM x)
SELECT ok, ln, p, round(db + -20 - CASE WHEN u[1] = v[1] THEN u[2] ELSE u[2] + (v[2] - u[2]) * (a - u[1]) / (v[1] - u[1]) END, 4) AS corrected FROM y""")
def f15(spark, sf):
    """Only odd bins are kept, so even angles are interpolated."""
    out = an.normalise(detections(spark, sf), _curve(spark, sf).filter("bin % 2 = 1"), "db", "angle", an.CURVE)
    return out.select("ok", "ln", "p", F.round("corrected", 4).alias("corrected"))


@query("a46_modes", """SELECT event_type AS kind, epoch_us(min(ts)) AS first_seen, count(*) AS n, CAST(row_number() OVER (ORDER BY min(ts), event_type) - 1 AS INTEGER) AS mode_id FROM events GROUP BY 1""")
def a46(spark, sf):
    return an.modes(pings(spark, sf), ["kind"], "t")


@query("a47_emission_plans", f"""WITH {DET}, x AS (SELECT mode, sector, antenna, list_sort(list(DISTINCT CAST(angle AS INTEGER))) AS f FROM det GROUP BY ALL) SELECT mode, sector, antenna, CAST(dense_rank() OVER (ORDER BY f) AS INTEGER) AS plan FROM x""")
def a47(spark, sf):
    x = detections(spark, sf).groupBy("mode", "sector", "antenna").agg(F.array_sort(F.collect_set(F.col("angle").cast("int"))).alias("f"))
    return rc.dense_ids(x, ["f"], "plan", cut).select("mode", "sector", "antenna", "plan")


@query("a48_group_to_list", """SELECT n_regionkey, list_sort(list(n_name)) AS names FROM nation GROUP BY ALL""")
def a48(spark, sf):
    return rc.to_list(table(spark, sf, "nation"), ["n_regionkey"], "n_name", "names")


@query("a50_mean_level", f"""WITH {DET} SELECT mode, round(10 * log10(avg(power(10, db / 10)) FILTER (angle < 30)), 5) AS level FROM det GROUP BY ALL""")
def a50(spark, sf):
    return detections(spark, sf).groupBy("mode").agg(F.round(ac.mean_db(F.when(F.col("angle") < 30, F.col("db"))), 5).alias("level"))


@query("a52_span_filter", f"""WITH {PINGS} SELECT file, max(value) AS top, count(*) AS n FROM pings GROUP BY ALL HAVING max(t) - min(t) <= CAST(20 AS BIGINT) * 86400000000""")
def a52(spark, sf):
    return rc.shorter_than(pings(spark, sf), ["file"], "t", 20 * 86_400_000_000, [F.max("value").alias("top"), F.count("*").alias("n")])


@query("a53_first_per_day", f"""WITH {PINGS}, x AS (SELECT *, t // 86400000000 AS day, row_number() OVER (PARTITION BY file, t // 86400000000 ORDER BY t, event_id) AS k FROM pings) SELECT file, day, event_id FROM x WHERE k = 1""")
def a53(spark, sf):
    p = pings(spark, sf).withColumn("day", F.floor(F.col("t") / 86_400_000_000))
    return tp.first_per(p, ["file", "day"], ["t", "event_id"]).select("file", "day", "event_id")


@query("a54_time_bounds", f"WITH {PINGS} SELECT file, min(t) AS start, max(t) AS stop FROM pings GROUP BY ALL")
def a54(spark, sf):
    return rc.bounds(pings(spark, sf), {"t": "start stop"}, ["file"]).drop("n")


# -- as-of and interpolating lookups ---------------------------------------------------------------

_SIDES = PINGS + ", l AS (SELECT * FROM pings WHERE kind <> 'purchase'), rr AS (SELECT file, t, value AS v FROM pings WHERE kind = 'purchase')"


def _sides(spark, sf):
    p = pings(spark, sf)
    return p.filter("kind != 'purchase'").drop("value"), p.filter("kind = 'purchase'").select("file", "t", "value")


@query("j05_asof", f"WITH {_SIDES} SELECT l.event_id, l.file, rr.v AS value FROM l ASOF LEFT JOIN rr ON l.file = rr.file AND l.t >= rr.t")
def j05(spark, sf):
    a, b = _sides(spark, sf)
    return tp.asof(a, b, ["file"], "t", "value").select("event_id", "file", "value")


@query("j08_asof_strict_first", f"""WITH {_SIDES}, f AS (SELECT file, arg_min(v, t) AS v0 FROM rr GROUP BY ALL) SELECT l.event_id, coalesce(rr.v, v0) AS value FROM l ASOF LEFT JOIN rr ON l.file = rr.file AND l.t > rr.t LEFT JOIN f ON f.file = l.file""")
def j08(spark, sf):
    a, b = _sides(spark, sf)
    return tp.asof(a, b, ["file"], "t", "value", strict=True, edges="first").select("event_id", "value")


def _lerp_sql(outside: str) -> str:
    return f"""WITH {_SIDES}, a AS (SELECT l.event_id, l.file, l.t, rr.t AS t0, rr.v AS v0 FROM l ASOF LEFT JOIN rr ON l.file = rr.file AND l.t >= rr.t),
b AS (SELECT a.*, rr.t AS t1, rr.v AS v1 FROM a ASOF LEFT JOIN rr ON a.file = rr.file AND a.t <= rr.t)
SELECT event_id, round(CASE WHEN t0 IS NULL OR t1 IS NULL THEN {outside} WHEN t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, 5) AS value FROM b"""


@query("j07_interpolating_zero", _lerp_sql("0.0"))
def j07(spark, sf):
    a, b = _sides(spark, sf)
    return tp.interpolating(a, b, ["file"], "t", "value", "zero").select("event_id", *r("value", digits=5))


@query("j16_interpolating_null", _lerp_sql("NULL"))
def j16(spark, sf):
    a, b = _sides(spark, sf)
    return tp.interpolating(a, b, ["file"], "t", "value").select("event_id", *r("value", digits=5))


_LINES = "li AS (SELECT file AS line, min(t) AS start, min(t) + CAST(36000000000 AS BIGINT) AS stop FROM pings GROUP BY ALL)"


@query("j09_p25_interval_join", f"WITH {PINGS}, {_LINES} SELECT line, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM pings JOIN li ON t BETWEEN start AND stop GROUP BY ALL")
def j09(spark, sf):
    p = pings(spark, sf)
    lines = p.groupBy(F.col("file").alias("line")).agg(F.min("t").alias("start")).withColumn("stop", F.col("start") + 36_000_000_000)
    return tp.within_totals(p, lines, "t", ["event_id"]).select("line", "n", F.col("event_id").alias("ids"))


@query("j12_nearest_path_point", f"""WITH {TRACK}, pt AS (SELECT event_id AS id, lon, lat FROM track), pa AS (SELECT event_id AS path_id, lon AS lon2, lat AS lat2 FROM track WHERE kind = 'purchase'),
d AS (SELECT id, path_id, 2 * 6371000.0 * asin(sqrt(power(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon) / 2), 2))) AS d FROM pt, pa WHERE abs(lat2 - lat) < 3),
b AS (SELECT id, arg_min(path_id, d) AS path_id, min(d) AS d FROM d WHERE d < 200000 GROUP BY ALL) SELECT id, coalesce(path_id, -1) AS path_id, round(d, 2) AS distance FROM pt LEFT JOIN b USING (id)""")
def j12(spark, sf):
    """All positions against those of purchases, which are the path."""
    t = track(spark, sf)
    pts = t.select(F.col("event_id").alias("id"), "lon", "lat")
    path = t.filter("kind = 'purchase'").select(F.col("event_id").alias("path_id"), "lon", "lat")
    return sl.nearest_within(pts, path, 200_000.0).select("id", "path_id", *r("distance", digits=2))


@query("j13_nearest_axis", f"WITH {DET} SELECT ok, ln, p, CAST(greatest(0, least(19, ceil((-z - 10) / 50 - 0.5))) AS INTEGER) AS i FROM det")
def j13(spark, sf):
    return detections(spark, sf).select("ok", "ln", "p", sl.nearest_axis(-F.col("z"), 10.0, 50.0, 20).alias("i"))


@query("j02_nearest_same_key", """WITH d AS (SELECT s_suppkey, c_custkey, abs(s_acctbal - c_acctbal) AS d FROM supplier JOIN customer ON s_nationkey = c_nationkey) SELECT s_suppkey, arg_min(c_custkey, (d, c_custkey)) AS c_custkey, round(min(d), 4) AS distance FROM d GROUP BY ALL""")
def j02(spark, sf):
    s = table(spark, sf, "supplier").withColumnRenamed("s_nationkey", "k")
    c = table(spark, sf, "customer").withColumnRenamed("c_nationkey", "k")
    return sl.by_key_closest(s, c, "k", "s_acctbal", "c_acctbal", "s_suppkey", "c_custkey").withColumn("distance", F.round("distance", 4))


_BOX = [(-50.0, -20.0), (60.0, -20.0), (60.0, 40.0), (-50.0, 40.0)]


def _clip_sql(neg: str) -> str:
    return f"WITH {TRACK} SELECT event_id FROM track WHERE {neg} (lon >= -50 AND lon < 60 AND lat >= -20 AND lat < 40)"


def _polygons(spark):
    return spark.createDataFrame([(_BOX,)], "ring array<struct<x double, y double>>")


@query("j04_clip", _clip_sql(""))
def j04(spark, sf):
    return sl.clip(track(spark, sf), _polygons(spark), "lon", "lat", ["event_id"]).select("event_id")


@query("j04_clip_reverse", _clip_sql("NOT"))
def j04b(spark, sf):
    return sl.clip(track(spark, sf), _polygons(spark), "lon", "lat", ["event_id"], reverse=True).select("event_id")


@query("j17_reference_cell", f"""WITH {DET}, rf AS (SELECT "row", col, avg(z) AS ref FROM det WHERE mode = 'A' GROUP BY ALL) SELECT ok, ln, p, round(z - ref, 7) AS bias FROM det LEFT JOIN rf USING ("row", col)""")
def j17(spark, sf):
    d = detections(spark, sf)
    ref = d.filter("mode = 'A'").groupBy("row", "col").agg(F.avg("z").alias("ref"))
    return rc.bias_to(d, ref, ["row", "col"], "z", "ref").select("ok", "ln", "p", F.round("bias", 7).alias("bias"))


@query("j19_s06_fixed_depth", """SELECT l_orderkey AS ok, l_linenumber AS ln, l_extendedprice AS p, round(l_extendedprice / 100 - o_custkey % 7 - o_custkey % 3, 4) AS depth FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def s06(spark, sf):
    pg = table(spark, sf, "orders").select(F.col("o_orderkey").alias("ok"), (F.col("o_custkey") % 7).alias("vertical_offset"), (F.col("o_custkey") % 3).alias("waterline"))
    d = detections(spark, sf).withColumn("z", -F.col("z"))
    return sl.fixed_depth(d, pg, ["ok"]).select("ok", "ln", "p", *r("depth"))


@query("j25_dictionary_lookup", """SELECT s_suppkey, coalesce(n_name, '') AS cdi FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey < 3""")
def j25(spark, sf):
    n = table(spark, sf, "nation").filter("n_regionkey < 3")
    s = table(spark, sf, "supplier")
    return rc.look_up(s, n, s["s_nationkey"] == n["n_nationkey"], "n_name", "cdi").select("s_suppkey", "cdi")


# -- windows ----------------------------------------------------------------------------------------

_BINS = PINGS + ", cb AS (SELECT *, kind AS mode, event_id % 5 AS bin, -20 - value / 100 AS mean_db, 1 + event_id % 3 AS n FROM pings)"


def _bins(spark, sf):
    i = F.col("event_id")
    return pings(spark, sf).select("*", F.col("kind").alias("mode"), (i % 5).alias("bin"), (-20 - F.col("value") / 100).alias("mean_db"), (1 + i % 3).alias("n"))


_FRAME = "OVER (PARTITION BY mode, bin ORDER BY t RANGE BETWEEN 14399999999 PRECEDING AND 14400000000 FOLLOWING)"


@query("w01_sliding_mean", f"WITH {_BINS} SELECT event_id, round(10 * log10(sum(power(10, mean_db / 10) * n) {_FRAME} / sum(n) {_FRAME}), 4) AS sliding_db FROM cb")
def w01(spark, sf):
    return tp.sliding_curve(_bins(spark, sf), ["mode", "bin"], "t", 480, median=False).select("event_id", *r("sliding_db"))


@query("w02_sliding_median", f"WITH {_BINS} SELECT event_id, round(quantile_cont(mean_db, 0.5) {_FRAME}, 7) AS sliding_db FROM cb")
def w02(spark, sf):
    return tp.sliding_curve(_bins(spark, sf), ["mode", "bin"], "t", 480).select("event_id", *r("sliding_db", digits=7))


@query("w03_short_median", f"WITH {_BINS} SELECT event_id, round(quantile_cont(mean_db, 0.5) {_FRAME.replace('14399999999', '1439999999').replace('14400000000', '1440000000')}, 7) AS sliding_db FROM cb")
def w03(spark, sf):
    return tp.sliding_curve(_bins(spark, sf), ["mode", "bin"], "t", 48).select("event_id", *r("sliding_db", digits=7))


@query("w05_mode_transitions", f"""WITH {PINGS}, d AS (SELECT kind, value, t, lag(kind) OVER w AS m0, lag(value) OVER w AS l0, lag(t) OVER w AS t0 FROM pings WINDOW w AS (PARTITION BY file ORDER BY t)),
f AS (SELECT m0 AS a, kind AS b, avg(value - l0) AS o, count(*) AS n FROM d WHERE m0 <> kind AND (t - t0) / 1e6 <= 86400 GROUP BY ALL), u AS (SELECT * FROM f UNION ALL SELECT b, a, -o, n FROM f)
SELECT a AS from_mode, b AS to_mode, round(sum(o * n) / sum(n), 5) AS "offset", CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY ALL""")
def w05(spark, sf):
    p = pings(spark, sf).select("file", (F.col("t") / 1e6).alias("t"), F.col("kind").alias("mode"), F.col("value").alias("level"))
    return an.transitions(p, 86400.0).withColumn("offset", F.round("offset", 5))


@query("w07_gaps", f"""WITH {PINGS}, d AS (SELECT file, t AS start, lead(t) OVER (PARTITION BY file ORDER BY t) AS stop FROM pings), m AS (SELECT file, quantile_cont(CAST(stop - start AS DOUBLE), 0.5) AS m FROM d WHERE stop IS NOT NULL GROUP BY ALL)
SELECT file, start, stop FROM d JOIN m USING (file) WHERE stop IS NOT NULL AND stop - start > 1.5 * m""")
def w07(spark, sf):
    return tp.gaps(pings(spark, sf), ["file"], "t")


@query("w08_sessions", f"""WITH {PINGS}, d AS (SELECT *, value > 30 AS i, lag(value > 30) OVER (PARTITION BY file ORDER BY t) AS b FROM pings), x AS (SELECT *, sum(CASE WHEN i AND NOT coalesce(b, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY t) AS run FROM d)
SELECT file, CAST(run AS BIGINT) AS run, min(t) AS start, max(t) AS stop FROM x WHERE i GROUP BY file, run HAVING max(t) > min(t)""")
def w08(spark, sf):
    return tp.runs(pings(spark, sf), ["file"], "t", F.col("value") > 30)


@query("w09_fill_linear", f"""WITH {PINGS}, g AS (SELECT file, event_id, t, CASE WHEN event_id % 4 <> 0 THEN value END AS v FROM pings), k AS (SELECT * FROM g WHERE v IS NOT NULL),
a AS (SELECT g.*, k.t AS t0, k.v AS v0 FROM g ASOF LEFT JOIN k ON g.file = k.file AND g.t >= k.t), b AS (SELECT a.*, k.t AS t1, k.v AS v1 FROM a ASOF LEFT JOIN k ON a.file = k.file AND a.t <= k.t)
SELECT event_id, round(coalesce(v, v0 + (v1 - v0) * (t - t0) / nullif(t1 - t0, 0)), 5) AS v FROM b""")
def w09(spark, sf):
    g = pings(spark, sf).withColumn("v", F.when(F.col("event_id") % 4 != 0, F.col("value")))
    return tp.fill_linear(g, ["file"], "t", "v").select("event_id", *r("v", digits=5))


@query("w10_unwrap", f"""WITH {TRACK}, d AS (SELECT *, coalesce(-round_even((heading - lag(heading) OVER (PARTITION BY file ORDER BY t)) / 360, 0) * 360, 0) AS turn FROM track)
SELECT event_id, heading + sum(turn) OVER (PARTITION BY file ORDER BY t) AS unwrapped FROM d""")
def w10(spark, sf):
    return tp.unwrap(track(spark, sf), ["file"], "t", "heading").select("event_id", "unwrapped")


_STEP = "2 * 6371000.0 * asin(least(1, sqrt(power(sin(radians(lat - y) / 2), 2) + cos(radians(y)) * cos(radians(lat)) * power(sin(radians(lon - x) / 2), 2))))"


@query("w11_track_distance", f"""WITH {TRACK}, d AS (SELECT *, lag(lat) OVER w AS y, lag(lon) OVER w AS x FROM track WINDOW w AS (PARTITION BY file ORDER BY t)), s AS (SELECT *, CASE WHEN y IS NULL THEN 0 ELSE {_STEP} END AS step FROM d)
SELECT event_id, round(step, 1) AS step, round(sum(step) OVER (PARTITION BY file ORDER BY t), 0) AS along FROM s""")
def w11(spark, sf):
    return tp.step_distance(track(spark, sf), ["file"], "t", "lon", "lat").select("event_id", F.round("step", 1).alias("step"), F.round("along", 0).alias("along"))


@query("w12_rolling_mean", f"""WITH {PINGS} SELECT event_id, round(CASE WHEN count(value) OVER w >= 10 THEN avg(value) OVER w END, 8) AS rolling FROM pings WINDOW w AS (PARTITION BY kind ORDER BY t ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING)""")
def w12(spark, sf):
    return tp.rolling_mean(pings(spark, sf), ["kind"], "t", "value").select("event_id", *r("rolling", digits=8))


@query("w13_w14_resample", f"""WITH {PINGS}, s AS (SELECT kind, min(t) AS lo, max(t) AS hi FROM pings GROUP BY ALL), g AS (SELECT kind, unnest(range(CAST(ceil(lo / 86400000000.0) AS BIGINT) * 86400000000, hi + 1, 86400000000)) AS t FROM s),
a AS (SELECT g.*, p.t AS t0, p.value AS v0 FROM g ASOF JOIN pings p ON g.kind = p.kind AND g.t >= p.t), b AS (SELECT a.*, p.t AS t1, p.value AS v1 FROM a ASOF JOIN pings p ON a.kind = p.kind AND a.t <= p.t)
SELECT kind, t, round(CASE WHEN t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, 5) AS value FROM b""")
def w13(spark, sf):
    return tp.resample(pings(spark, sf).select("kind", "t", "value"), ["kind"], "t", "value", 86_400_000_000).select("kind", "t", *r("value", digits=5))


@query("w17_lines_between_turns", f"""WITH {PINGS}, h AS (SELECT *, event_id % 40 / 4.0 AS heading FROM pings), j AS (SELECT *, heading - lag(heading) OVER (PARTITION BY file ORDER BY t) AS jump FROM h),
u AS (SELECT *, heading + sum(coalesce(-round_even(jump / 360.0, 0) * 360.0, 0)) OVER (PARTITION BY file ORDER BY t ROWS UNBOUNDED PRECEDING) AS uh FROM j),
s AS (SELECT *, coalesce(round(stddev_samp(uh) OVER (PARTITION BY file ORDER BY t RANGE BETWEEN 43200000000 PRECEDING AND 43200000000 FOLLOWING), 9), 0) < 3 AS i FROM u), d AS (SELECT *, lag(i) OVER (PARTITION BY file ORDER BY t) AS b FROM s),
x AS (SELECT *, sum(CASE WHEN i AND NOT coalesce(b, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY t) AS run FROM d)
SELECT file, CAST(run AS BIGINT) AS run, min(t) AS start, max(t) AS stop FROM x WHERE i GROUP BY file, run HAVING max(t) - min(t) >= 3600000000""")
def w17(spark, sf):
    return tp.turns(track(spark, sf).withColumn("heading", F.col("event_id") % 40 / 4), ["file"], "t", "heading", 86_400_000_000, 3.0, 3_600_000_000)


def _savgol_sql() -> str:
    import numpy as np

    w = np.linalg.pinv(np.vander(np.arange(-3, 4), 3, increasing=True))[0]
    terms = " + ".join(f"{float(w[i + 3])!r} * {'lag' if i < 0 else 'lead'}(value, {abs(i)}) OVER w" for i in range(-3, 4))
    return f"WITH {PINGS} SELECT event_id, round(coalesce({terms}, value), 5) AS smooth FROM pings WINDOW w AS (PARTITION BY kind ORDER BY t)"


@query("w18_savitzky_golay", _savgol_sql())
def w18(spark, sf):
    return tp.savitzky_golay(pings(spark, sf), ["kind"], "t", "value", 7, 2).select("event_id", *r("smooth", digits=5))


@query("w18_running_median", f"WITH {PINGS} SELECT event_id, round(quantile_cont(value, 0.5) OVER (PARTITION BY kind ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 5) AS smooth FROM pings")
def w18b(spark, sf):
    return tp.running_median(pings(spark, sf), ["kind"], "t", "value", 5).select("event_id", *r("smooth", digits=5))


@query("w20_interping_distance", f"""WITH {TRACK}, d AS (SELECT event_id, file, t, {_STEP.replace('(lat - y)', '(ny - lat)').replace('radians(y)', 'radians(ny)').replace('(lon - x)', '(nx - lon)')} AS d FROM (SELECT *, lead(lat) OVER w AS ny, lead(lon) OVER w AS nx FROM track WINDOW w AS (PARTITION BY file ORDER BY t)) WHERE TRUE),
n AS (SELECT d.*, lead(t) OVER (PARTITION BY file ORDER BY t) AS nt FROM d), m AS (SELECT *, CASE WHEN nt IS NOT NULL THEN d END AS e FROM n) SELECT event_id, round(coalesce(e, lag(e) OVER (PARTITION BY file ORDER BY t)), 1) AS interping FROM m""")
def w20(spark, sf):
    return tp.next_distance(track(spark, sf), ["file"], "t", "lon", "lat").select("event_id", *r("interping", digits=1))


@query("w21_swath_count", f"""WITH {PINGS} SELECT l.event_id, CASE WHEN m > 0 THEN 2 WHEN m = 0 THEN 1 ELSE 0 END AS swaths FROM pings l ASOF LEFT JOIN (SELECT file, t, event_id % 3 - 1 AS m FROM pings WHERE kind = 'purchase') r ON l.file = r.file AND l.t >= r.t""")
def w21(spark, sf):
    p = pings(spark, sf)
    modes = p.filter("kind = 'purchase'").select("file", "t", (F.col("event_id") % 3 - 1).alias("m"))
    return tp.asof(p, modes, ["file"], "t", "m").select("event_id", tp.swath_mode("m").alias("swaths"))


@query("s28_day_rollover", f"""WITH {PINGS}, d AS (SELECT event_id, file, t, CAST(t // 1000000 % 86400 AS BIGINT) AS s FROM pings), b AS (SELECT *, CASE WHEN s < lag(s) OVER (PARTITION BY file ORDER BY t) THEN 1 ELSE 0 END AS b FROM d)
SELECT event_id, CAST(sum(b) OVER (PARTITION BY file ORDER BY t) AS BIGINT) AS day FROM b""")
def s28(spark, sf):
    p = pings(spark, sf).withColumn("s", F.floor(F.col("t") / 1_000_000) % 86400)
    return tp.day_rollover(p, ["file"], "t", "s").select("event_id", "day")


@query("p30_decimate", f"WITH {PINGS}, x AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY t) AS k FROM pings) SELECT event_id FROM x WHERE (k - 1) % 3 = 0")
def p30(spark, sf):
    return tp.decimate(pings(spark, sf), ["file"], "t", 3).select("event_id")


# -- slices -------------------------------------------------------------------------------------------

_ECHO = DET + """, echo AS (SELECT *, CAST(round_even(-z / 50.0 - 0.5, 0) AS INTEGER) AS zi, CAST(round_even((px - 500) / 100.0 - 0.5, 0) AS INTEGER) AS yi FROM det)"""


def _echo(spark, sf):
    return detections(spark, sf).withColumns({"zi": sl.half_even_index(-F.col("z"), 50.0), "yi": sl.half_even_index(F.col("px") - 500, 100.0)})


def _energy_sql(keys: str) -> str:
    return f"WITH {_ECHO} SELECT {keys}, round(10 * log10(avg(power(10, db / 10))), 4) AS mean_db, max(db) AS max_db, count(db) AS n FROM echo GROUP BY ALL"


def _energy(spark, sf, keys):
    return sl.energy_cells(_echo(spark, sf), "db", keys).withColumn("mean_db", F.round("mean_db", 4))


@query("a38_horizontal_slices", _energy_sql('zi, "row", col'))
def a38(spark, sf):
    return _energy(spark, sf, ["zi", "row", "col"])


@query("a39_longitudinal_slices", _energy_sql('zi, yi, "row"'))
def a39(spark, sf):
    return _energy(spark, sf, ["zi", "yi", "row"])


@query("a40_polar_echograms", _energy_sql("ok, yi, zi"))
def a40(spark, sf):
    return _energy(spark, sf, ["ok", "yi", "zi"])


@query("a41_vertical_integration", _energy_sql('"row", col'))
def a41(spark, sf):
    return _energy(spark, sf, ["row", "col"])


@query("a37_slice_extent", f"WITH {_ECHO} SELECT ok, min(px) AS across_min, max(px) AS across_max, min(z) AS z_min, max(z) AS z_max, count(*) AS n FROM echo GROUP BY ALL")
def a37(spark, sf):
    return rc.bounds(detections(spark, sf), {"px": "across_min across_max", "z": "z_min z_max"}, ["ok"])


@query("a43_a44_section_grid", f"WITH {DET} SELECT CAST(greatest(0, least(19, ceil((-z - 10) / 50 - 0.5))) AS INTEGER) AS zi, CAST(greatest(0, least(39, ceil((px - 1) / 50.0 - 0.5))) AS INTEGER) AS xi, round(avg(db), 4) AS value FROM det GROUP BY ALL")
def a43(spark, sf):
    d = detections(spark, sf).select(sl.nearest_axis(-F.col("z"), 10.0, 50.0, 20).alias("zi"), sl.nearest_axis("px", 1.0, 50.0, 40).alias("xi"), "db")
    return d.groupBy("zi", "xi").agg(F.round(F.avg("db"), 4).alias("value"))


@query("p23_water_column_filters", f"WITH {_ECHO} SELECT ok, ln, p, db FROM echo WHERE yi BETWEEN -4 AND 10 AND db >= -18 AND antenna BETWEEN 1 AND 5 AND -z BETWEEN 100 AND 800 AND ok % 2 = 0")
def p23(spark, sf):
    e = _echo(spark, sf).filter(F.col("yi").between(-4, 10) & (F.col("db") >= -18) & F.col("antenna").between(1, 5) & (-F.col("z")).between(100, 800) & (F.col("ok") % 2 == 0))
    return e.select("ok", "ln", "p", "db")


@query("p24_range_normalisation", f"WITH {_ECHO}, m AS (SELECT zi, 10 * log10(avg(power(10, db / 10))) AS m FROM echo GROUP BY ALL) SELECT ok, ln, p, round(db - m, 4) AS level FROM echo JOIN m USING (zi)")
def p24(spark, sf):
    e = _echo(spark, sf)
    return e.join(e.groupBy("zi").agg(ac.mean_db("db").alias("m")), "zi").select("ok", "ln", "p", F.round(F.col("db") - F.col("m"), 4).alias("level"))


# -- sorts and sets -------------------------------------------------------------------------------------


@query("o02_files_by_first_ping", f"WITH {PINGS} SELECT file, min(t) AS first_ping FROM pings GROUP BY ALL ORDER BY first_ping")
def o02(spark, sf):
    return rc.bounds(pings(spark, sf), {"t": "first_ping last_ping"}, ["file"]).select("file", "first_ping").orderBy("first_ping", "file")


@query("o04_modes_by_count", f"WITH {PINGS} SELECT kind, count(*) AS n FROM pings GROUP BY ALL ORDER BY n DESC")
def o04(spark, sf):
    return rc.most_frequent(pings(spark, sf), ["kind"], [])


@query("o05_best_match", """SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(o_totalprice - c_acctbal), o_orderkey) AS k FROM customer JOIN orders ON c_custkey = o_custkey) WHERE k = 1""")
def o05(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return rc.best_match(c, o, c["c_custkey"] == o["o_custkey"], "c_custkey", F.abs(F.col("o_totalprice") - F.col("c_acctbal")), "o_orderkey")


@query("o06_first_last", f"WITH {PINGS}, x AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY t) AS u, row_number() OVER (PARTITION BY file ORDER BY t DESC) AS d FROM pings) SELECT event_id FROM x WHERE u <= 10 OR d <= 10")
def o06(spark, sf):
    return tp.ends(pings(spark, sf), ["file"], "t").select("event_id")


@query("o07_argmax", """WITH x AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT vec_id, CASE WHEN max(v) > 0 THEN CAST(arg_max(i - 1, (v, -i)) AS INTEGER) END AS argmax FROM x GROUP BY ALL""")
def o07(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return sl.argmax_first(e, ["vec_id"], "i", "v")


@query("o08_seeded_sample", f"""WITH {DET}, e AS (SELECT "row", ok, ln, ok || '-' || ln || '-' || CAST(round(p * 100) AS BIGINT) AS id FROM det), x AS (SELECT *, row_number() OVER (PARTITION BY "row" ORDER BY md5(id || ':0'), id) AS k FROM e)
SELECT "row", ok, ln FROM x WHERE k <= 100""")
def o08(spark, sf):
    """100 echoes per ping at most, a sampling operator."""
    e = _echo(spark, sf).withColumn("id", F.concat_ws("-", "ok", "ln", F.round(F.col("p") * 100).cast("long")))
    return sl.seeded_sample(e, ["row"], "id", 100).select("row", "ok", "ln")


@query("u03_modes_in_both", """SELECT DISTINCT l_returnflag AS mode, l_linenumber AS antenna FROM lineitem WHERE l_quantity < 5 INTERSECT SELECT l_returnflag, l_linenumber FROM lineitem WHERE l_quantity > 45""")
def u03(spark, sf):
    d = detections(spark, sf)
    return rc.in_both(d.filter("angle < 5"), d.filter("angle > 45"), ["mode", "antenna"])


@query("u04_modes_not_seen", """SELECT DISTINCT l_partkey AS px FROM lineitem WHERE l_quantity < 3 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40""")
def u04(spark, sf):
    d = detections(spark, sf)
    return rc.not_in(d.filter("angle < 3"), d.filter("angle > 40"), ["px"])


@query("u02_merge_by_time", f"WITH {PINGS} SELECT kind AS source, count(*) AS n, min(t) AS start, max(t) AS stop FROM pings WHERE kind IN ('click', 'purchase') GROUP BY ALL")
def u02(spark, sf):
    p = pings(spark, sf)
    u = rc.together([p.filter("kind = 'click'"), p.filter("kind = 'purchase'")], ["t"]).withColumnRenamed("kind", "source")
    return rc.bounds(u, {"t": "start stop"}, ["source"])


@query("w22_w23_path_vertices", f"""WITH {TRACK}, d AS (SELECT *, lead(lat) OVER w AS ny, lead(lon) OVER w AS nx FROM track WINDOW w AS (PARTITION BY file ORDER BY t)) SELECT event_id, round(CASE WHEN degrees(atan2(nx - lon, ny - lat)) < 0 THEN degrees(atan2(nx - lon, ny - lat)) + 360 ELSE degrees(atan2(nx - lon, ny - lat)) END, 4) AS azimuth,
round((lon + nx) / 2, 6) AS mid_lon, round((lat + ny) / 2, 6) AS mid_lat FROM d WHERE nx IS NOT NULL""")
def w23(spark, sf):
    w = Window.partitionBy("file").orderBy("t")
    d = track(spark, sf).withColumns({"nx": F.lead("lon").over(w), "ny": F.lead("lat").over(w)}).filter("nx is not null")
    return d.select("event_id", F.round(geo.azimuth(F.col("nx") - F.col("lon"), F.col("ny") - F.col("lat")), 4).alias("azimuth"), F.round((F.col("lon") + F.col("nx")) / 2, 6).alias("mid_lon"), F.round((F.col("lat") + F.col("ny")) / 2, 6).alias("mid_lat"))
