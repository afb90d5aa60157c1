"""Queries on scalar functions: levels, corrections, geodesy, text, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import acoustics as ac
from ..functions import geo, text
from .bind import DET, TRACK, detections, r, table, track
from .registry import query

_KEY = ["ok", "ln", "p"]


@query("f01_level_conversions", f"""WITH {DET} SELECT ok, ln, p, round(power(10, db / 20), 6) AS amplitude, round(power(10, db / 10), 6) AS energy,
round(20 * log10(angle), 4) AS db_of_amplitude, round(10 * log10(angle), 4) AS db_of_energy, round(10 * log10(nullif(w, 0)), 4) AS guarded FROM det""")
def f01(spark, sf):
    d = detections(spark, sf)
    return d.select(*_KEY, F.round(ac.to_linear("db", ac.AMPLITUDE), 6).alias("amplitude"), F.round(ac.to_linear("db"), 6).alias("energy"), F.round(ac.to_db("angle", ac.AMPLITUDE), 4).alias("db_of_amplitude"), F.round(ac.to_db("angle"), 4).alias("db_of_energy"), F.round(ac.to_db("w"), 4).alias("guarded"))


_HAV = "2 * 6371000.0 * atan2(sqrt({a}), sqrt(1 - {a}))".format(a="(power(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon) / 2), 2))")


@query("f02_haversine", f"""WITH {TRACK}, x AS (SELECT *, lat * 0.5 + 10 AS lat2, lon * 0.9 - 3 AS lon2 FROM track) SELECT event_id, round({_HAV}, 3) AS distance FROM x""")
def f02(spark, sf):
    return track(spark, sf).select("event_id", F.round(geo.haversine("lat", "lon", F.col("lat") * 0.5 + 10, F.col("lon") * 0.9 - 3), 3).alias("distance"))


@query("f03_geodesic")
def f03(spark, sf):
    return track(spark, sf).select("event_id", F.round(geo.geodesic(F.col("lat"), F.col("lon"), F.col("lat") * 0.5 + 10, F.col("lon") * 0.9 - 3), 3).alias("distance"))


_E2 = repr(geo.E2)
_NR = f"6378137.0 / sqrt(1 - {_E2} * power(sin(radians(lat)), 2)) AS norm, 6378137.0 / sqrt(1 - {_E2} * power(sin(radians(lat)), 2)) * (1 - {_E2}) / (1 - {_E2} * power(sin(radians(lat)), 2)) AS radius"


@query("f04_f05_detection_position", f"""WITH {TRACK}, x AS (SELECT *, value AS along, value * 2 - 50 AS across, sin(radians(heading)) AS s, cos(radians(heading)) AS k, {_NR} FROM track)
SELECT event_id, round(norm, 3) AS norm, round(radius, 3) AS radius, round(degrees((along * s + across * k) / norm) / cos(radians(lat)) + lon, 8) AS dlon, round(degrees((along * k - across * s) / radius) + lat, 8) AS dlat FROM x""")
def f05(spark, sf):
    n, q = geo.norm_and_radius("lat")
    lon, lat = geo.offset_position("value", F.col("value") * 2 - 50, "lon", "lat", "heading")
    return track(spark, sf).select("event_id", F.round(n, 3).alias("norm"), F.round(q, 3).alias("radius"), F.round(lon, 8).alias("dlon"), F.round(lat, 8).alias("dlat"))


@query("f06_wrap_coordinates", f"""WITH {TRACK}, x AS (SELECT *, lon * 3 + 180.0 AS a, lat * 4 + 90.0 AS b FROM track), y AS (SELECT *, b - 360 * floor(b / 360) AS m FROM x)
SELECT event_id, round(a - 360 * floor(a / 360) - 180, 6) AS lon, round(CASE WHEN m <= 180 THEN m ELSE 360 - m END - 90, 6) AS lat FROM y""")
def f06(spark, sf):
    return track(spark, sf).select("event_id", F.round(geo.wrap_longitude(F.col("lon") * 3), 6).alias("lon"), F.round(geo.fold_latitude(F.col("lat") * 4), 6).alias("lat"))


@query("f07_utm_zone", f"""WITH {TRACK}, x AS (SELECT event_id, lon, lat * 1.3 AS lat FROM track) SELECT event_id, CAST(CASE WHEN lat >= 56 AND lat < 64 AND lon >= 3 AND lon < 12 THEN 32
WHEN lat BETWEEN 72 AND 84 AND lon >= 0 AND lon < 9 THEN 31 WHEN lat BETWEEN 72 AND 84 AND lon >= 9 AND lon < 21 THEN 33 WHEN lat BETWEEN 72 AND 84 AND lon >= 21 AND lon < 33 THEN 35
WHEN lat BETWEEN 72 AND 84 AND lon >= 33 AND lon < 42 THEN 37 ELSE floor((lon + 180) / 6) + 1 END AS INTEGER) AS zone FROM x""")
def f07(spark, sf):
    return track(spark, sf).select("event_id", geo.utm_zone("lon", F.col("lat") * 1.3).alias("zone"))


@query("f08_projections", f"""WITH {TRACK} SELECT event_id, round(radians(lon) * 6378137.0, 3) AS x, round(6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)), 3) AS y, round(lon, 8) AS lon, round(lat, 8) AS lat FROM track""")
def f08(spark, sf):
    x, y = geo.to_mercator("lon", "lat")
    t = track(spark, sf).select("event_id", x.alias("x"), y.alias("y"))
    lon, lat = geo.from_mercator("x", "y")
    return t.select("event_id", *r("x", "y", digits=3), F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


@query("f08_transverse_mercator")
def f08b(spark, sf):
    t = track(spark, sf).withColumn("zone", geo.utm_zone("lon", "lat"))
    x, y = geo.to_utm("lon", "lat", "zone")
    return t.select("event_id", "zone", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("f09_f10_level_laws", f"""WITH {DET}, x AS (SELECT *, greatest(angle * 20, 300.0) AS r, 300.0 / cos(radians(25)) AS rc FROM det) SELECT ok, ln, p, round(20 * log10(r / 300), 4) AS lambert,
round(CASE WHEN r < rc THEN (sqrt((r - 300) / (rc - 300)) - 1) * (-12.0 - -25.0) ELSE 0 END, 4) AS specular FROM x""")
def f09(spark, sf):
    rng = F.col("angle") * 20.0
    return detections(spark, sf).select(*_KEY, F.round(ac.lambert(rng, 300.0), 4).alias("lambert"), F.round(ac.specular(rng, 300.0, -12.0, -25.0, 25.0), 4).alias("specular"))


@query("f11_area_by_pulse", f"""WITH {DET}, x AS (SELECT *, greatest(angle * 40 * 1500 / 20000.0, 400 * 1500 / 20000.0) AS r, 400 * 1500 / 20000.0 AS rn, radians(1.0) AS al, radians(2.0 / cos(radians(angle))) AS ac FROM det),
y AS (SELECT *, sqrt(1 - power(rn / r, 2)) AS s FROM x) SELECT ok, ln, p, round(10 * log10(least(CASE WHEN s > 0 THEN 1500 * 0.0005 * al * r / (2 * s) END, ac * al * r * r)), 4) AS area_db FROM y""")
def f11(spark, sf):
    a = ac.area_by_pulse(F.col("angle") * 40.0, 400.0, 10000.0, "angle", 0.0005, 1500.0, 1.0, 2.0)
    return detections(spark, sf).select(*_KEY, F.round(a, 4).alias("area_db"))


@query("f12_f13_incidence_and_area", f"""WITH {DET}, x AS (SELECT *, radians(angle) AS ac, radians(w * 100 + 1) AS al, angle * 40 * 1500 / 20000.0 AS r, tan(radians(1.0)) AS ol, tan(radians(2.0)) / cos(radians(angle)) AS oc FROM det),
y AS (SELECT *, atan(sqrt(power(tan(ac), 2) + power(tan(al), 2))) AS inc, atan2(tan(ac), tan(al)) AS asp FROM x) SELECT ok, ln, p, round(degrees(inc), 4) AS incidence,
round(10 * log10(least(1500 * 0.0005 / (2 * abs(sin(inc))) * r * sqrt(power(ol * sin(asp), 2) + power(oc * cos(asp), 2)), (oc * r / cos(ac)) * (ol * r / cos(al)))), 4) AS area_db FROM y""")
def f12(spark, sf):
    along = F.col("w") * 100 + 1
    a = ac.area_by_incidence(F.col("angle") * 40.0, 10000.0, "angle", 0.0005, 1500.0, 1.0, 2.0, "angle", along)
    return detections(spark, sf).select(*_KEY, F.round(ac.seafloor_incidence("angle", along), 4).alias("incidence"), F.round(a, 4).alias("area_db"))


@query("f14_corrected_level", f"""WITH {DET} SELECT ok, ln, p, round(CASE WHEN sector = 'O' THEN db - w * 10 - angle / 10 ELSE db END + 1.5, 4) AS level FROM det""")
def f14(spark, sf):
    lev = ac.corrected_level("db", F.when(F.col("sector") == "O", F.col("db")), F.col("w") * 10, F.col("angle") / 10, 1.5)
    return detections(spark, sf).select(*_KEY, F.round(lev, 4).alias("level"))


@query("f17_gsab_curve", f"""WITH {DET} SELECT ok, ln, p, round(10 * log10(0.2 * exp(-angle * angle / (2 * 36.0)) + 0.01 * power(cos(radians(angle)), 2) + 0.02 * exp(-angle * angle / (2 * 400.0))), 4) AS level FROM det""")
def f17(spark, sf):
    return detections(spark, sf).select(*_KEY, F.round(ac.gsab("angle", 0.2, 6.0, 0.01, 2.0, 0.02, 20.0), 4).alias("level"))


@query("f19_geoacoustics", f"""WITH {DET}, x AS (SELECT *, 1 + w * 50 AS q FROM det) SELECT ok, ln, p, round(0.7030 + 0.2055 * q, 6) AS speed, round(q / (0.7030 + 0.2055 * q), 6) AS density, CASE WHEN q < 1.8 THEN 0.05 WHEN q < 3 THEN 0.4 ELSE 0.1 END::DOUBLE AS beta FROM x""")
def f19(spark, sf):
    a, b, d = ac.geoacoustics(1 + F.col("w") * 50)
    return detections(spark, sf).select(*_KEY, F.round(a, 6).alias("speed"), F.round(b, 6).alias("density"), d.alias("beta"))


@query("f20_f21_pointing", f"""WITH {DET}, x AS (SELECT *, sin(radians(angle)) * (1480 + w * 1000) / 1500.0 AS s FROM det) SELECT ok, ln, p, round(CASE WHEN abs(s) <= 1 THEN degrees(asin(s)) END, 4) AS incidence, round(angle - 0.5 - w * 10, 4) AS pointing FROM x""")
def f20(spark, sf):
    return detections(spark, sf).select(*_KEY, F.round(ac.refracted_incidence("angle", 1500.0, 1480 + F.col("w") * 1000), 4).alias("incidence"), F.round(ac.surface_pointing("angle", 0.5, F.col("w") * 10), 4).alias("pointing"))


@query("f22_rotations", f"""WITH {DET}, a AS (SELECT *, radians(w * 100) AS r, radians(5) AS q, radians(angle * 7) AS y FROM det), b AS (SELECT *, 1.0 * cos(r) - 2.0 * sin(r) AS y1, 1.0 * sin(r) + 2.0 * cos(r) AS z1 FROM a),
d AS (SELECT *, 3.0 * cos(q) + z1 * sin(q) AS x2, z1 * cos(q) - 3.0 * sin(q) AS z2 FROM b) SELECT ok, ln, p, round(x2 * cos(y) - y1 * sin(y), 6) AS x, round(x2 * sin(y) + y1 * cos(y), 6) AS yy, round(z2, 6) AS z FROM d""")
def f22(spark, sf):
    x, y, z = geo.rotate(3.0, 1.0, 2.0, F.col("w") * 100, 5.0, F.col("angle") * 7)
    return detections(spark, sf).select(*_KEY, F.round(x, 6).alias("x"), F.round(y, 6).alias("yy"), F.round(z, 6).alias("z"))


@query("f25_pulse_and_range", f"""WITH {DET} SELECT ok, ln, p, round(CASE WHEN mode = 'A' THEN w WHEN antenna = 2 THEN w * 0.7 ELSE w / 0.7 * 0.375 END, 8) AS pulse, round(angle * 0.01 * 5000, 6) AS samples FROM det""")
def f25(spark, sf):
    e = ac.effective_pulse("w", F.when(F.col("antenna") == 2, 850).otherwise(710), F.col("mode") != "A")
    return detections(spark, sf).select(*_KEY, F.round(e, 8).alias("pulse"), F.round(ac.range_samples(F.col("angle") * 0.01, 5000), 6).alias("samples"))


@query("p33_display_curve", f"""WITH {DET}, x AS (SELECT *, angle / 50 AS v FROM det) SELECT ok, ln, p, round(CASE WHEN v > 0.6 THEN 0.6 + (v - 0.6) / (1 + 2 * (v - 0.6)) ELSE v END, 6) AS shoulder, round(power(greatest(0, least(1, v)), 1 / 2.2), 6) AS gamma FROM x""")
def p33c(spark, sf):
    v = F.col("angle") / 50
    return detections(spark, sf).select(*_KEY, F.round(ac.shoulder(v, 2.0, 0.6), 6).alias("shoulder"), F.round(ac.gamma(v, 2.2), 6).alias("gamma"))


# -- text ---------------------------------------------------------------------------------------



@query("s27_nmea_sentences", """WITH b AS (SELECT event_id, 'GPGLL,' || event_id || ',N,' || user_id || ',E' AS body FROM events),
x AS (SELECT *, list_reduce(list_transform(string_split(body, ''), lambda c: ascii(c)), lambda a, c: xor(a, c)) AS k FROM b)
SELECT event_id, '$' || body || '*' || upper(lpad(to_hex(k), 2, '0')) AS sentence, TRUE AS valid, 'GP' AS talker, 'GLL' AS kind, string_split(body, ',')[2] AS first_field FROM x""")
def s27(spark, sf):
    e = table(spark, sf, "events").select("event_id", text.nmea_sentence(F.concat_ws(",", F.lit("GPGLL"), "event_id", F.lit("N"), "user_id", F.lit("E"))).alias("sentence"))
    f = text.nmea_fields("sentence")
    return e.select("event_id", "sentence", text.nmea_valid("sentence").alias("valid"), f["talker"].alias("talker"), f["sentence"].alias("kind"), F.element_at(f["fields"], 1).alias("first_field"))


@query("f40_parse_degrees", f"""WITH {TRACK}, x AS (SELECT event_id, abs(event_id % 90) AS d, event_id % 60 AS m, event_id % 50 AS s, event_id % 2 AS h FROM track)
SELECT event_id, round(CASE h WHEN 0 THEN 1 ELSE -1 END * (d + m / 60.0 + s / 3600.0), 8) AS degrees FROM x""")
def f40(spark, sf):
    i = F.col("event_id")
    t = F.format_string("%d° %02d' %02d\" %s", i % 90, i % 60, i % 50, F.when(i % 2 == 0, "N").otherwise("S"))
    return track(spark, sf).select("event_id", F.round(text.parse_degrees(t), 8).alias("degrees"))


@query("f41_format_degrees", """WITH x AS (SELECT event_id, event_id % 180 - 90 + 0.123456 AS d FROM events), u AS (SELECT *, CAST(round(abs(d) * 360000) AS BIGINT) AS c, CAST(round(abs(d) * 60000) AS BIGINT) AS k FROM x)
SELECT event_id, (c // 360000) || '°' || lpad((c // 6000 % 60)::VARCHAR, 2, '0') || '''' || lpad((c % 6000 // 100)::VARCHAR, 2, '0') || '.' || lpad((c % 100)::VARCHAR, 2, '0') || '"' || CASE WHEN d < 0 THEN 'S' ELSE 'N' END AS dms,
(k // 60000) || '°' || lpad((k % 60000 // 1000)::VARCHAR, 2, '0') || '.' || lpad((k % 1000)::VARCHAR, 3, '0') || '''' || CASE WHEN d < 0 THEN 'S' ELSE 'N' END AS ddm FROM u""")
def f41(spark, sf):
    d = F.col("event_id") % 180 - 90 + 0.123456
    return table(spark, sf, "events").select("event_id", text.format_dms(d, "N", "S").alias("dms"), text.format_ddm(d, "N", "S").alias("ddm"))


@query("f42_f43_names", """SELECT page_id, upper(url[1]) || substr(url, 2) AS capital, regexp_extract(regexp_replace(url, '[?#].*', ''), '([^/]*)$', 1) AS name,
regexp_replace(regexp_extract(regexp_replace(url, '[?#].*', ''), '([^/]*)$', 1), '\\.[^.]*$', '') AS stem, regexp_extract(regexp_extract(regexp_replace(url, '[?#].*', ''), '([^/]*)$', 1), '(\\.[^.]*)$', 1) AS extension FROM pages""")
def f42(spark, sf):
    u = F.regexp_replace("url", "[?#].*", "")
    return table(spark, sf, "pages").select("page_id", text.capital_first("url").alias("capital"), text.file_name(u).alias("name"), text.file_stem(u).alias("stem"), text.file_extension(u).alias("extension"))


@query("f45_provenance_prefix", """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS cdi, CASE WHEN s_suppkey % 2 = 1 THEN s_name END AS cprd FROM supplier""")
def f45(spark, sf):
    full = F.concat(F.when(F.col("s_suppkey") % 2 == 0, text.CDI).otherwise(text.CPRD), "s_name")
    return table(spark, sf, "supplier").select("s_suppkey", text.provenance(full, text.CDI).alias("cdi"), text.provenance(full, text.CPRD).alias("cprd"))


@query("f46_date_in_name", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders""")
def f46(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", text.date_in_name(F.concat(F.lit("/data/line_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_x.all"))).alias("day"))


@query("f47_nanoseconds", """SELECT event_id, epoch_us(ts) * 1000 AS ns, epoch_us(ts) AS back FROM events""")
def f47(spark, sf):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", (us * 1000).alias("ns"), F.unix_micros(text.ns_to_timestamp(us * 1000)).alias("back"))


@query("f48_typed_fields", """SELECT conv_id, turn, try_cast(nullif(trim(substr(text, 1, 3)), '') AS DOUBLE) AS f, try_cast(nullif(trim(CAST(turn AS VARCHAR)), '') AS INTEGER) AS i FROM conversations""")
def f48(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.to_float(F.substring("text", 1, 3)).alias("f"), text.to_int(F.col("turn").cast("string")).alias("i"))


@query("f49_json_keys", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def f49(spark, sf):
    return table(spark, sf, "events").select("event_id", text.json_key("props", "k", "long").alias("k"))


@query("s38_f50_array_histogram", """WITH x AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), b AS (SELECT vec_id, CAST(least(floor((v + 1) / 0.25), 7) AS INTEGER) AS bin FROM x WHERE v BETWEEN -1 AND 1)
SELECT vec_id, bin, CAST(count(*) AS INTEGER) AS n FROM b GROUP BY ALL""")
def f50(spark, sf):
    e = table(spark, sf, "embeddings")
    h = e.select("vec_id", F.posexplode(text.array_histogram(F.transform("embedding", lambda v: v.cast("double")), -1.0, 1.0, 8)).alias("bin", "n"))
    return h.filter("n > 0")


@query("s08_reflectivity_units", f"""WITH {DET} SELECT ok, ln, p, round(CASE WHEN sector = 'O' THEN db ELSE 20 * log10(angle) END, 4) AS level FROM det""")
def s08(spark, sf):
    return detections(spark, sf).select(*_KEY, F.round(F.when(F.col("sector") == "O", F.col("db")).otherwise(ac.to_db("angle", ac.AMPLITUDE)), 4).alias("level"))


@query("s09_across_angle", f"""WITH {DET} SELECT ok, ln, p, round(CASE WHEN antenna - 2 >= 0 THEN degrees(atan2(px / 10.0 - antenna, -z - 1)) END, 4) AS across FROM det""")
def s09(spark, sf):
    a = F.when(F.col("antenna") - 2 >= 0, ac.across_angle(F.col("px") / 10.0, -F.col("z"), F.col("antenna"), 1))
    return detections(spark, sf).select(*_KEY, F.round(a, 4).alias("across"))


