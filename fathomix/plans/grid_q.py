"""Queries on gridding, merging, coarsening, cell rules, stencils and layer statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import acoustics as ac
from ..operators import grid as g
from ..operators import records as rc
from ..operators import stencil as st
from .bind import DET, GRID, GRIDS, ORDER, detections, grid, grids, r, rs
from .registry import query

_STATS = ["mean", "min", "max", "last", "sum", "stdev", "mean_x", "mean_y"]
_LAST = 'last(z ORDER BY t, ok, ln, p)'


@query("a01_grid_statistics", f"""WITH {DET}, s AS (SELECT "row", col, count(z) AS value_count, avg(z) AS mean, min(z) AS min, max(z) AS max, {_LAST} AS last,
sum(z) AS sum, stddev_pop(z) AS stdev, count(*) FILTER (z IS NULL) AS filtered_count, avg(px) AS mean_x, avg(sy) AS mean_y FROM det GROUP BY ALL)
SELECT "row", col, value_count, filtered_count, {rs(*_STATS)} FROM s""")
def a01(spark, sf):
    s = g.grid_statistics(detections(spark, sf), "z", ORDER, "px", "sy")
    return s.select("row", "col", "value_count", "filtered_count", *r(*_STATS))


@query("a02_weighted_statistics", f"""WITH {DET} SELECT "row", col, round(sum(z * w) / sum(w), 4) AS mean, round(sum(w), 4) AS weight_sum, count(*) AS value_count
FROM det WHERE w > 0 GROUP BY ALL""")
def a02(spark, sf):
    s = g.weighted_statistics(detections(spark, sf), "z", "w").filter("value_count > 0")
    return s.select("row", "col", *r("mean", "weight_sum"), "value_count")


@query("a03_keep_last", f"""WITH {DET} SELECT "row", col, -1.0 * {_LAST} AS last FROM det GROUP BY ALL""")
def a03(spark, sf):
    return g.keep_last(detections(spark, sf), "z", ORDER, factor=-1.0)


@query("a04_cell_deviation", f"""WITH {DET} SELECT "row", col, round(stddev_pop(z), 4) AS stdev FROM det GROUP BY ALL""")
def a04(spark, sf):
    return g.cell_deviation(detections(spark, sf), "z").select("row", "col", F.round("stdev", 4).alias("stdev"))


@query("a05_cell_extremes", f"""WITH {DET} SELECT "row", col, min(z) AS min, max(z) AS max FROM det GROUP BY ALL""")
def a05(spark, sf):
    return g.cell_extremes(detections(spark, sf), "z")


@query("a06_oblique_weighted_level", f"""WITH {DET}, x AS (SELECT *, exp(-0.5 * power((angle - 45) / 15, 2)) AS ow FROM det)
SELECT "row", col, round(20 * log10(sum(power(10, db / 20) * ow) / sum(ow)), 4) AS level FROM x GROUP BY ALL""")
def a06(spark, sf):
    d = detections(spark, sf).withColumns({"ow": ac.oblique_weight("angle"), "lin": ac.to_linear("db", ac.AMPLITUDE)})
    return g.weighted_statistics(d, "lin", "ow").select("row", "col", F.round(ac.to_db("mean", ac.AMPLITUDE), 4).alias("level"))


@query("a07_soundings_to_grid", f"""WITH {DET}, s AS (SELECT "row", col, count(*) AS value_count, avg(z) AS mean, stddev_pop(z) AS stdev,
sum(power(10, db / 20)) AS e FROM det WHERE -z BETWEEN 50 AND 900 AND angle <= 45 GROUP BY ALL)
SELECT "row", col, value_count, {rs('mean', 'stdev')}, round(20 * log10(e / value_count), 4) AS backscatter FROM s WHERE value_count >= 2""")
def a07(spark, sf):
    """The whole export: range filter on the raw value, validity, statistics, level, threshold."""
    d = detections(spark, sf).withColumn("z", -g.clamp_null(-F.col("z"), 900, 50)).filter("z is not null and angle <= 45")
    s = d.groupBy("row", "col").agg(F.count("*").alias("value_count"), F.avg("z").alias("mean"), F.stddev_pop("z").alias("stdev"), ac.mean_db("db", ac.AMPLITUDE).alias("backscatter"))
    return s.filter("value_count >= 2").select("row", "col", "value_count", *r("mean", "stdev", "backscatter"))


@query("a10_last_label", f"""WITH {DET} SELECT "row", col, last('CDI:' || mode || sector ORDER BY t, ok, ln, p) AS cdi FROM det GROUP BY ALL""")
def a10(spark, sf):
    return g.last_label(detections(spark, sf), F.concat(F.lit("CDI:"), "mode", "sector"), ORDER)


@query("a11_merge_mean", f"""WITH {GRIDS} SELECT "row", col, round(avg(mean), 4) AS mean FROM grids GROUP BY ALL""")
def a11(spark, sf):
    return g.merge_mean(grids(spark, sf), ["mean"]).select("row", "col", *r("mean"))


@query("a12_a13_merge_layers", f"""WITH {GRIDS} SELECT "row", col, round(sqrt(avg(stdev * stdev)), 4) AS stdev, min(min) AS min, max(max) AS max,
CAST(sum(value_count) AS BIGINT) AS value_count, max(flag) AS flag FROM grids GROUP BY ALL""")
def a12(spark, sf):
    return g.merge_layers(grids(spark, sf)).withColumn("stdev", F.round("stdev", 4))


@query("a14_dominant_label", f"""WITH {GRIDS} SELECT "row", col, last(cdi ORDER BY value_count, priority) AS cdi FROM grids GROUP BY ALL""")
def a14(spark, sf):
    return g.dominant(grids(spark, sf))


@query("a15_merge_fill", f"""WITH {GRIDS} SELECT "row", col, round(first(mean ORDER BY priority), 4) AS mean, first(cdi ORDER BY priority) AS cdi FROM grids GROUP BY ALL""")
def a15(spark, sf):
    return g.merge_fill(grids(spark, sf), ["mean", "cdi"]).withColumn("mean", F.round("mean", 4))


@query("a16_merge_by_slope", f"""WITH {GRIDS}, j AS (SELECT "row", col, max(mean) FILTER (mode = 'A') AS a, max(mean) FILTER (mode = 'N') AS b,
max(stdev) FILTER (mode = 'R') / 50 AS s, count(*) FILTER (mode <> 'R') AS k FROM grids GROUP BY ALL)
SELECT "row", col, round(CASE WHEN a IS NULL OR b IS NULL OR s IS NULL THEN coalesce(a, b) WHEN s <= 2 THEN a WHEN s >= 6 THEN b
ELSE (1 - (s - 2) / 4) * a + (s - 2) / 4 * b END, 3) AS mean FROM j WHERE k > 0""")
def a16(spark, sf):
    s = grids(spark, sf)
    slope = s.filter("mode = 'R'").withColumn("slope", F.col("stdev") / 50)
    out = g.merge_by_slope(s.filter("mode = 'A'"), s.filter("mode = 'N'"), slope, "mean", 2, 6)
    return out.select("row", "col", *r("mean", digits=3))


@query("a18_a20_reduce", f"""WITH {GRID}, x AS (SELECT *, CAST(value_count AS DOUBLE) AS w FROM grid)
SELECT CAST(floor("row" / 4) AS INTEGER) AS "row", CAST(floor(col / 4) AS INTEGER) AS col, round(sum(mean * w) / sum(w), 4) AS mean,
round(sqrt(sum(stdev * stdev * w) / sum(w)), 4) AS stdev, CAST(sum(value_count) AS BIGINT) AS value_count, min(min) AS min, max(max) AS max,
min(flag) AS flag, last(cdi ORDER BY value_count, x."row", x.col) AS cdi FROM x GROUP BY floor("row" / 4), floor(col / 4)""")
def a18(spark, sf):
    return g.reduce_grid(grid(spark, sf), 4).withColumns({k: F.round(k, 4) for k in ("mean", "stdev")})


@query("a31_layer_statistics", """SELECT l_returnflag AS file, round(min(l_extendedprice), 4) AS min, round(max(l_extendedprice), 4) AS max, round(avg(l_extendedprice), 4) AS mean,
round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(stddev_samp(l_extendedprice), 4) AS std, round(quantile_cont(l_extendedprice, 0.025), 3) AS low,
round(quantile_cont(l_extendedprice, 0.975), 3) AS high, count(*) AS n FROM lineitem GROUP BY 1""")
def a31(spark, sf):
    d = detections(spark, sf)
    s = g.layer_statistics(d.withColumnRenamed("mode", "file"), "p", ["file"], 0.95)
    return s.select("file", *r("min", "max", "mean", "median", "std"), *r("low", "high", digits=3), "n")


@query("a31_sigma_levels", f"""WITH {DET}, b AS (SELECT mode, avg(z) AS m, stddev_samp(z) AS s FROM det GROUP BY ALL)
SELECT mode, round(avg(CASE WHEN z BETWEEN m - s AND m + s THEN 1.0 ELSE 0 END), 5) AS one_sigma, round(avg(CASE WHEN z BETWEEN m - 2 * s AND m + 2 * s THEN 1.0 ELSE 0 END), 5) AS two_sigma
FROM det JOIN b USING (mode) GROUP BY ALL""")
def a31b(spark, sf):
    return g.sigma_levels(detections(spark, sf), "z", ["mode"]).select("mode", *r("one_sigma", "two_sigma", digits=5))


@query("a32_histogram", f"""WITH {DET} SELECT CAST(least(floor((z + 1100) / 55), 19) AS INTEGER) AS bin, count(*) AS n FROM det WHERE z BETWEEN -1100 AND 0 GROUP BY 1""")
def a32(spark, sf):
    return g.histogram(detections(spark, sf), "z", -1100.0, 0.0, 20)


@query("a34_uncertainty_limits", f"""WITH {DET}, d AS (SELECT avg(-z) AS d FROM det) SELECT o AS "order", round(sqrt(a * a + power(b * d, 2)), 5) AS tvu
FROM d, (VALUES ('2', 1.0, 0.023), ('special', 0.25, 0.0075), ('exclusive', 0.15, 0.0075), ('1a', 0.5, 0.013), ('1b', 0.5, 0.013)) v(o, a, b)""")
def a34(spark, sf):
    d = detections(spark, sf).agg(F.avg(-F.col("z")).alias("d"))
    rows = F.array(*(F.struct(F.lit(k).alias("order"), F.round(ac.uncertainty_limit("d", a, b), 5).alias("tvu")) for k, (a, b) in ac.ORDERS.items()))
    return d.select(F.inline(rows))


@query("a35_extent", f"""WITH {DET} SELECT mode, min(px) AS west, max(px) AS east, min(sy) AS south, max(sy) AS north FROM det GROUP BY ALL""")
def a35(spark, sf):
    return g.extent(detections(spark, sf), "px", "sy", ["mode"])


@query("a36_resolution", """WITH x AS (SELECT DISTINCT l_extendedprice AS p, l_suppkey AS s FROM lineitem), d AS (SELECT s, p - lag(p) OVER (PARTITION BY s ORDER BY p) AS d FROM x)
SELECT s AS sy, round(min(nullif(abs(d), 0)), 4) AS least, round(quantile_cont(nullif(d, 0), 0.5), 4) AS median FROM d GROUP BY ALL""")
def a36(spark, sf):
    return g.axis_resolution(detections(spark, sf), "p", ["sy"]).select("sy", *r("least", "median"))


@query("a51_block_mean", f"""WITH {GRID} SELECT CAST(floor("row" / 3) AS INTEGER) AS "row", CAST(floor(col / 3) AS INTEGER) AS col, round(avg(mean), 4) AS mean
FROM grid WHERE "row" < 9 AND col < 39 GROUP BY 1, 2""")
def a51(spark, sf):
    return g.block_mean(grid(spark, sf), "mean", 3, 11, 41).withColumn("mean", F.round("mean", 4))


@query("p01_range_filter", f"""WITH {DET} SELECT ok, ln, p, CASE WHEN z BETWEEN -500 AND -100 THEN z END AS z FROM det""")
def p01(spark, sf):
    return detections(spark, sf).select("ok", "ln", "p", g.clamp_null("z", -100, -500).alias("z"))


@query("p02_p03_project", """SELECT l_orderkey AS ok, l_linenumber AS ln, l_partkey AS px, l_suppkey AS sy, round((l_partkey - 10) / 7.5, 6) AS x, round((l_suppkey - 5) / 2.5, 6) AS y,
CASE WHEN l_partkey >= 10 AND l_partkey < 1510 AND l_suppkey >= 5 AND l_suppkey < 80 THEN CAST(floor((l_suppkey - 5) / 2.5) AS INTEGER) END AS "row",
CASE WHEN l_partkey >= 10 AND l_partkey < 1510 AND l_suppkey >= 5 AND l_suppkey < 80 THEN CAST(floor((l_partkey - 10) / 7.5) AS INTEGER) END AS col FROM lineitem""")
def p02(spark, sf):
    from ..functions.geo import GridSpec

    spec = GridSpec(10.0, 5.0, 7.5, 2.5, 30, 200, "EPSG:3857")
    d = detections(spark, sf)
    x, y = spec.xy("px", "sy")
    row, col = spec.cell("px", "sy")
    return d.select("ok", "ln", "px", "sy", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), row.alias("row"), col.alias("col"))


@query("p04_reset_cells", f"""WITH {GRID} SELECT "row", col, CASE WHEN NOT coalesce(value_count <= 5 OR (mean BETWEEN -400 AND -300 AND flag = 0), FALSE) THEN round(mean, 4) END AS mean, cdi FROM grid""")
def p04(spark, sf):
    spec = {"op": "or", "of": [{"layer": "value_count", "op": "less", "value": 5}, {"op": "and", "of": [{"layer": "mean", "op": "between", "value": (-400, -300)}, {"layer": "flag", "op": "equal", "value": 0}]}]}
    return g.reset_where(grid(spark, sf), g.predicate(spec), ["mean"]).select("row", "col", *r("mean"), "cdi")


@query("p05_count_threshold", f"""WITH {GRID} SELECT "row", col, CASE WHEN value_count >= 10 THEN round(mean, 4) END AS mean, CASE WHEN value_count >= 10 THEN value_count END AS value_count FROM grid""")
def p05(spark, sf):
    return g.reset_where(grid(spark, sf), F.col("value_count") < 10, ["mean", "value_count"]).select("row", "col", *r("mean"), "value_count")


@query("p06_set_where", f"""WITH {GRID} SELECT "row", col, CASE WHEN "row" < 5 AND cdi = 'c1' THEN 'set' ELSE cdi END AS cdi FROM grid""")
def p06(spark, sf):
    return rc.set_where(grid(spark, sf), "cdi", (F.col("row") < 5) & (F.col("cdi") == "c1"), "set").select("row", "col", "cdi")


@query("p07_linear_transform", f"""WITH {GRID} SELECT "row", col, round(-2 * mean + 7, 4) AS mean, round(-2 * max + 7, 4) AS min, round(-2 * min + 7, 4) AS max, round(2 * stdev, 4) AS stdev FROM grid""")
def p07(spark, sf):
    return g.linear(grid(spark, sf), -2.0, 7.0).select("row", "col", *r("mean", "min", "max", "stdev"))


@query("p08_translate", f"""WITH {GRID} SELECT "row", col, 100.0 + 3 * 0.5 + (col + 0.5) * 0.5 AS x, 10.0 - 2 * 0.25 + ("row" + 0.5) * 0.25 AS y FROM grid""")
def p08(spark, sf):
    from ..functions.geo import GridSpec

    x, y = GridSpec(100.0, 10.0, 0.5, 0.25, 11, 41).shifted(-2, 3).centre("row", "col")
    return grid(spark, sf).select("row", "col", x.alias("x"), y.alias("y"))


_RING = [(2.5, 1.5), (30.5, 1.5), (20.5, 9.5), (2.5, 7.5)]


def _ring():
    return F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in _RING))


def _ring_sql(x: str, y: str) -> str:
    parts = []
    for i, (ax, ay) in enumerate(_RING):
        bx, by = _RING[i - 1]
        parts.append(f"CASE WHEN ({ay} > {y}) <> ({by} > {y}) AND {x} < ({bx} - {ax}) * ({y} - {ay}) / nullif({by} - {ay}, 0) + {ax} THEN 1 ELSE 0 END")
    return "(" + " + ".join(parts) + ") % 2 = 1"


@query("p09_polygon_mask", f"""WITH {GRID} SELECT "row", col, {_ring_sql('col', '"row"')} AS inside FROM grid""")
def p09(spark, sf):
    from ..functions.geo import in_ring

    return grid(spark, sf).select("row", "col", in_ring(F.col("col").cast("double"), F.col("row").cast("double"), _ring()).alias("inside"))


@query("p10_point_mask", f"""WITH {DET} SELECT mode, count(*) AS n FROM det WHERE {_ring_sql('(px / 50.0)', '(sy / 10.0)')} GROUP BY ALL""")
def p10(spark, sf):
    from ..functions.geo import in_ring

    return detections(spark, sf).filter(in_ring(F.col("px") / 50.0, F.col("sy") / 10.0, _ring())).groupBy("mode").agg(F.count("*").alias("n"))


@query("p12_shrink", f"""WITH {GRID} SELECT min("row") AS row_min, max("row") AS row_max, min(col) AS col_min, max(col) AS col_max FROM grid WHERE value_count > 5""")
def p12(spark, sf):
    return g.shrink(grid(spark, sf).withColumn("mean", F.when(F.col("value_count") > 5, F.col("mean"))))


@query("p13_default_layers", f"""WITH {GRID} SELECT "row", col, round(mean, 4) AS mean, round(mean, 4) AS min, round(mean, 4) AS max, CAST(1 AS BIGINT) AS value_count, 0 AS flag FROM grid""")
def p13(spark, sf):
    return g.default_layers(grid(spark, sf).select("row", "col", "mean")).select("row", "col", *r("mean", "min", "max"), "value_count", "flag")


@query("p14_remap_labels", f"""WITH {GRID} SELECT "row", col, CASE cdi WHEN 'c0' THEN 'x' WHEN 'c2' THEN 'y' ELSE cdi END AS cdi FROM grid""")
def p14(spark, sf):
    return rc.relabel(grid(spark, sf), {"c0": "x", "c2": "y"}).select("row", "col", "cdi")


@query("p15_set_label", f"""WITH {GRID} SELECT "row", col, coalesce(CASE WHEN cdi <> 'c0' THEN cdi END, CASE WHEN value_count > 3 THEN 'new' END) AS cdi FROM grid""")
def p15(spark, sf):
    cells = grid(spark, sf).withColumn("cdi", F.when(F.col("cdi") != "c0", F.col("cdi")))
    return rc.label_missing(cells, "new", F.col("value_count") > 3).select("row", "col", "cdi")


@query("p16_split_by_label", f"""WITH {GRID} SELECT cdi, count(*) AS cells, CAST(sum(value_count) AS BIGINT) AS values FROM grid GROUP BY ALL""")
def p16(spark, sf):
    return rc.by_label(grid(spark, sf))


@query("p17_compact_labels", f"""WITH {GRIDS}, u AS (SELECT DISTINCT mode || cdi AS name FROM grids WHERE mode <> 'N') SELECT name AS old_id, name, CAST(dense_rank() OVER (ORDER BY name) - 1 AS INTEGER) AS new_id FROM u""")
def p17(spark, sf):
    names = grids(spark, sf).select(F.concat("mode", "cdi").alias("old_id"), "mode").distinct()
    used = names.filter("mode != 'N'").select("old_id")
    return g.compact_ids(used, names.select("old_id", F.col("old_id").alias("name"))).select("old_id", "name", "new_id")


@query("p18_label_gaps", f"""WITH {GRID}, x AS (SELECT CASE WHEN value_count > 5 THEN mean END AS mean, CASE WHEN flag = 0 THEN cdi END AS cdi FROM grid)
SELECT count(*) FILTER (mean IS NOT NULL AND cdi IS NULL) AS undefined, count(*) FILTER (mean IS NULL AND cdi IS NOT NULL) AS unused FROM x""")
def p18(spark, sf):
    return g.provenance_gaps(grid(spark, sf).select(F.when(F.col("value_count") > 5, F.col("mean")).alias("mean"), F.when(F.col("flag") == 0, F.col("cdi")).alias("cdi")))


@query("p19_sanity", f"""WITH {GRID} SELECT "row", col, CASE WHEN value_count > 5 THEN round(mean, 4) END AS mean, CASE WHEN value_count > 5 THEN min END AS min, CASE WHEN value_count > 5 THEN cdi END AS cdi, CASE WHEN value_count > 5 THEN flag END AS flag FROM grid""")
def p19(spark, sf):
    x = grid(spark, sf).withColumn("mean", F.when(F.col("value_count") > 5, F.col("mean")))
    return g.sanity(x).select("row", "col", *r("mean"), "min", "cdi", "flag")


@query("p20_quality_mask", f"""WITH {GRID}, x AS (SELECT *, value_count * 7 % 80 AS angle, value_count % 4 AS rate FROM grid), m AS (SELECT avg(rate) AS m, avg(stdev) AS s FROM x)
SELECT "row", col, CASE WHEN mean IS NULL THEN 255 ELSE (CASE WHEN abs(angle) > 65 THEN 1 ELSE 0 END) + (CASE WHEN rate / m > 1.5 THEN 2 ELSE 0 END) + (CASE WHEN stdev > s THEN 4 ELSE 0 END)
+ (CASE WHEN value_count < 5 THEN 8 ELSE 0 END) + (CASE WHEN flag = 1 THEN 16 ELSE 0 END) END AS quality FROM x, m""")
def p20(spark, sf):
    x = grid(spark, sf).withColumns({"angle": F.col("value_count") * 7 % 80, "rate": F.col("value_count") % 4})
    m = x.agg(F.avg("rate").alias("m"), F.avg("stdev").alias("s"))  # one row
    return x.crossJoin(F.broadcast(m)).select("row", "col", ac.quality_mask("angle", "rate", "m", "stdev", "s", "value_count", "flag", "mean").alias("quality"))


@query("p22_grid_difference", f"""WITH {GRIDS} SELECT a."row", a.col, round(a.mean - b.mean, 4) AS mean FROM (SELECT * FROM grids WHERE mode = 'A') a JOIN (SELECT * FROM grids WHERE mode = 'R') b USING ("row", col)""")
def p22(spark, sf):
    s = grids(spark, sf)
    return g.difference(s.filter("mode = 'A'"), s.filter("mode = 'R'"), "mean").withColumn("mean", F.round("mean", 4))


@query("p32_fill_from", f"""WITH {GRIDS}, a AS (SELECT "row", col, mean, min, max, value_count, flag FROM grids WHERE mode = 'A' AND value_count > 5), b AS (SELECT "row", col, mean AS n FROM grids WHERE mode = 'N')
SELECT "row", col, round(CASE WHEN a.mean IS NULL THEN n ELSE a.mean END, 4) AS mean, CASE WHEN a.mean IS NULL THEN 1 ELSE value_count END AS value_count, CASE WHEN a.mean IS NULL THEN 1 ELSE flag END AS flag
FROM a FULL JOIN b USING ("row", col)""")
def p32(spark, sf):
    s = grids(spark, sf)
    return g.fill_from(s.filter("mode = 'A' and value_count > 5"), s.filter("mode = 'N'")).select("row", "col", *r("mean"), "value_count", "flag")


@query("u01_union_of_grids", f"""WITH {GRIDS} SELECT priority, count(*) AS cells, CAST(sum(value_count) AS BIGINT) AS n FROM grids WHERE mode <> 'N' GROUP BY ALL""")
def u01(spark, sf):
    s = grids(spark, sf)
    parts = [s.filter(f"mode = '{m}'").drop("priority") for m in "AR"]
    out = g.stack(parts).withColumn("priority", F.col("priority") * 2)
    return out.groupBy("priority").agg(F.count("*").alias("cells"), F.sum("value_count").alias("n"))


def _pair_sql(radius: int) -> str:
    return f"""FROM grid t JOIN grid s ON s."row" BETWEEN t."row" - {radius} AND t."row" + {radius} AND s.col BETWEEN t.col - {radius} AND t.col + {radius}"""


@query("x01_convolve", f"""WITH {GRID}, k AS (SELECT * FROM (VALUES (0, 4.0), (1, 2.0), (2, 1.0)) v(d, w))
SELECT t."row", t.col, round(sum(s.mean * w) / sum(w), 4) AS mean {_pair_sql(1)} JOIN k ON k.d = abs(s."row" - t."row") + abs(s.col - t.col) GROUP BY t."row", t.col""")
def x01(spark, sf):
    return st.convolve(grid(spark, sf), "mean", st.KERNELS["gauss3"]).withColumn("mean", F.round("mean", 4))


@query("x03_box_mean", f"""WITH {GRID}, m AS (SELECT t."row", t.col, avg(s.mean) AS m {_pair_sql(2)} GROUP BY t."row", t.col)
SELECT "row", col, round(CASE WHEN col < 20 THEN m ELSE mean END, 4) AS mean FROM grid JOIN m USING ("row", col)""")
def x03(spark, sf):
    return st.box_mean(grid(spark, sf), "mean", 5, F.col("col") < 20).withColumn("mean", F.round("mean", 4))


@query("x04_neighbour_deviation", f"""WITH {GRID}, n AS (SELECT t."row", t.col, avg(s.stdev) AS near_stdev, stddev_pop(s.mean) AS near_spread {_pair_sql(1)} AND (s."row", s.col) <> (t."row", t.col) GROUP BY t."row", t.col)
SELECT "row", col, {rs('near_stdev', 'near_spread')} FROM (SELECT "row", col FROM grid) LEFT JOIN n USING ("row", col)""")
def x04(spark, sf):
    return st.neighbour_deviation(grid(spark, sf)).select("row", "col", *r("near_stdev", "near_spread"))


_PICK = '(SELECT "row", col FROM grid WHERE value_count % 5 = 0)'


@query("x05_dilate", f"""WITH {GRID}, p AS {_PICK} SELECT DISTINCT CAST("row" + i AS INTEGER) AS "row", CAST(col + j AS INTEGER) AS col FROM p, range(-1, 2) a(i), range(-1, 2) b(j)""")
def x05(spark, sf):
    return st.dilate(grid(spark, sf).filter("value_count % 5 = 0"))


@query("x05_erode", f"""WITH {GRID}, p AS (SELECT "row", col FROM grid WHERE value_count % 7 <> 0) SELECT CAST("row" + i AS INTEGER) AS "row", CAST(col + j AS INTEGER) AS col FROM p, range(-1, 2) a(i), range(-1, 2) b(j) GROUP BY 1, 2 HAVING count(*) = 9""")
def x05b(spark, sf):
    return st.erode(grid(spark, sf).filter("value_count % 7 != 0"))


@query("x06_components", f"""WITH RECURSIVE {GRID}, p AS {_PICK}, walk AS (SELECT "row", col, CAST("row" AS BIGINT) * 4294967296 + col AS label FROM p
UNION SELECT p."row", p.col, w.label FROM walk w JOIN p ON abs(p."row" - w."row") + abs(p.col - w.col) = 1)
SELECT "row", col, min(label) AS label FROM walk GROUP BY ALL""")
def x06(spark, sf):
    from .tables import cut

    return st.components(grid(spark, sf).filter("value_count % 5 = 0"), cut)


@query("x08_nearest_fill", f"""WITH {GRID}, h AS (SELECT "row", col, CASE WHEN value_count % 5 <> 0 THEN mean END AS mean FROM grid),
c AS (SELECT t."row", t.col, s.mean, row_number() OVER (PARTITION BY t."row", t.col ORDER BY power(s."row" - t."row", 2) + power(s.col - t.col, 2), s.mean) AS k
FROM h t JOIN h s ON t.mean IS NULL AND s.mean IS NOT NULL AND abs(s."row" - t."row") <= 2 AND abs(s.col - t.col) <= 2) SELECT "row", col, round(mean, 4) AS mean FROM c WHERE k = 1""")
def x08(spark, sf):
    h = grid(spark, sf).withColumn("mean", F.when(F.col("value_count") % 5 != 0, F.col("mean")))
    return st.nearest_fill(h, "mean", 2, h).withColumn("mean", F.round("mean", 4))


@query("x15_peaks_by_share", f"""WITH {GRID}, m AS (SELECT t."row", t.col, any_value(t.mean) AS mean, avg(s.mean) AS m {_pair_sql(1)} GROUP BY t."row", t.col), h AS (SELECT * FROM m WHERE abs(m - mean) >= 0.2 * abs(mean))
SELECT DISTINCT CAST("row" + i AS INTEGER) AS "row", CAST(col + j AS INTEGER) AS col FROM h, range(-2, 3) a(i), range(-2, 3) b(j)""")
def x15(spark, sf):
    return st.peaks_by_share(grid(spark, sf), "mean", 3, 20.0)


def _nine(expr: str, cols: str) -> str:
    z = ", ".join(f"""max(s.mean) FILTER (s."row" - t."row" = {i - 1} AND s.col - t.col = {j - 1}) AS z{3 * i + j + 1}""" for i in range(3) for j in range(3))
    return f"""WITH {GRID}, z AS (SELECT t."row", t.col, {z}, count(*) AS n {_pair_sql(1)} GROUP BY t."row", t.col), d AS (SELECT *, {expr} FROM z WHERE n = 9) SELECT "row", col, {cols} FROM d"""


_HORN = "((z3 + 2 * z6 + z9) - (z1 + 2 * z4 + z7)) / 80 AS dx, ((z7 + 2 * z8 + z9) - (z1 + 2 * z2 + z3)) / 160 AS dy"


@query("f30_slope_aspect", _nine(_HORN, "round(degrees(atan(sqrt(dx * dx + dy * dy))), 4) AS slope, round(CASE WHEN degrees(atan2(-dx, -dy)) < 0 THEN degrees(atan2(-dx, -dy)) + 360 ELSE degrees(atan2(-dx, -dy)) END, 4) AS aspect"))
def f30(spark, sf):
    return st.slope_aspect(grid(spark, sf), "mean", 10.0, 20.0).select("row", "col", *r("slope", "aspect"))


@query("x15_curvature", _nine("(z6 - z4) / 2 AS gx, (z8 - z2) / 2 AS gy, z6 - 2 * z5 + z4 AS gxx, z8 - 2 * z5 + z2 AS gyy, (z9 - z7 - z3 + z1) / 4 AS gxy", "round((gxx * gyy - gxy * gxy) / power(1 + gx * gx + gy * gy, 2), 6) AS curvature"))
def x15b(spark, sf):
    return st.curvature(grid(spark, sf), "mean").withColumn("curvature", F.round("curvature", 6))


@query("p33_hillshade", _nine(_HORN, "round(greatest(0, sin(radians(45)) * cos(atan(sqrt(dx * dx + dy * dy))) + cos(radians(45)) * sin(atan(sqrt(dx * dx + dy * dy))) * cos(radians(315) - atan2(-dx, -dy))), 4) AS light"))
def p33(spark, sf):
    return st.hillshade(grid(spark, sf), "mean", 10.0, 20.0).withColumn("light", F.round("light", 4))
