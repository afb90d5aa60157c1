"""Queries on water-column samples: from travel time to echogram cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import echoes as ec
from .bind import DET, detections
from .registry import query

CELL, ACROSS, HEIGHT = (2.5, 1.5), 12.0, 20


def _beams(spark, sf):
    """Detections as beams of 8 to 15 samples, of which every fourth is missing in some."""
    level = lambda i: F.when((i % 4 != 1) | (F.col("ln") % 2 == 0), F.col("db") - 0.5 * i)
    d = detections(spark, sf).withColumn("levels", F.transform(F.sequence(F.lit(0), F.col("ln") + 7), level))
    return d.select(
        "ok", "ln", "levels", ((F.col("angle") - 25.5) * 2.5).alias("angle"), (F.col("w") * 100 - 4).alias("tilt"), (F.col("w") / 100).alias("blank"), F.lit(0.004).alias("interval"),
        F.lit(1500.0).alias("speed"), (3 + F.col("ln") / 10).alias("depth"),
    )


_ECHOES = DET + f""", b AS (SELECT ok, ln, db, ok AS ping, radians((angle - 25.5) * 2.5) AS a, radians(w * 100 - 4) AS k, w / 100 AS blank, 3 + ln / 10 AS depth, (angle - 25.5) * 2.5 AS deg FROM det),
s AS (SELECT *, unnest(range(ln + 8)) AS i FROM b), e AS (SELECT *, (blank + i * 0.004) * 1500 / 2 AS r FROM s WHERE i % 4 <> 1 OR ln % 2 = 0),
echo AS (SELECT *, r * cos(k) * sin(a) AS x, -depth - r * cos(k) * cos(a) AS z, db - 0.5 * i AS level FROM e),
o AS (SELECT ok, deg, count(*) AS same FROM b GROUP BY ALL), g AS (SELECT *, deg - lag(deg) OVER v AS l, lead(deg) OVER v - deg AS u FROM o WINDOW v AS (PARTITION BY ok ORDER BY deg)),
opn AS (SELECT ok, max(least(coalesce((coalesce(l, u) + coalesce(u, l)) / 2, 3.0) / same, 3.0)) AS opening FROM g GROUP BY ALL),
m AS (SELECT ok, greatest(min(x), -2 * {ACROSS}) AS x0, least(max(x), 2 * {ACROSS}) AS x1, -min(depth) AS z1, greatest(min(z), -min(depth) - {HEIGHT} * {CELL[1]}) AS z0 FROM echo GROUP BY ALL),
fr AS (SELECT *, round_even((x1 - x0) / {CELL[0]}, 0) + 1 AS nx, round_even((z1 - z0) / {CELL[1]}, 0) + 1 AS nz FROM m)"""


@query("x29_polar_echograms", f"""WITH {_ECHOES}, c AS (SELECT ok, CAST(round_even((x - x0) / {CELL[0]}, 0) AS INTEGER) AS yi, CAST(round_even((z1 - z) / {CELL[1]}, 0) AS INTEGER) AS zi, level, nx, nz FROM echo JOIN fr USING (ok))
SELECT ok, yi, zi, round(10 * log10(avg(power(10, level / 10))), 4) AS mean_db, max(level) AS max_db, count(*) AS n FROM c WHERE yi >= 0 AND yi < nx AND zi >= 0 AND zi < nz GROUP BY ALL""")
def x29(spark, sf):
    """Samples of every beam, placed by range and angles, on a grid a ping."""
    b = ec.openings(_beams(spark, sf), ["ok"], 3.0)
    return ec.polar_echograms(b, ["ok"], CELL, ACROSS, HEIGHT).select("ok", "yi", "zi", F.round("mean_db", 4).alias("mean_db"), F.round("max_db", 6).alias("max_db"), "n")


@query("x29_ping_bounds", f"""WITH {_ECHOES}, q AS (SELECT *, greatest(abs(x0), abs(x1)) AS far FROM fr JOIN opn USING (ok))
SELECT ok, round(x0, 4) AS across_min, round(x1, 4) AS across_max, round(z0, 4) AS elevation_min, CAST(nx AS INTEGER) AS columns, CAST(nz AS INTEGER) AS rows,
CAST(ceil(1.1 * tan(radians(opening / 2)) * 2 * (far * far + (z1 - z0) * (z1 - z0)) / nullif(far, 0) / {CELL[0]} + 1) AS INTEGER) AS gap FROM q""")
def x29b(spark, sf):
    """Each ping's extent, from the ends of its beams, and how far gaps between beams reach."""
    b = ec.bounds(ec.openings(_beams(spark, sf), ["ok"], 3.0), ["ok"], CELL, ACROSS, HEIGHT)
    return b.select("ok", *(F.round(k, 4).alias(k) for k in ("across_min", "across_max", "elevation_min")), "columns", "rows", "gap")
