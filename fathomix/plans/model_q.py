"""Queries on mean-response models: two-step statistics, correction models and their text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import angular as an
from ..operators import models as mo
from .bind import DET, detections, r
from .registry import query


def _beams(spark, sf):
    """Detections with a file a year."""
    return detections(spark, sf).withColumn("file", F.year("t"))


def _model(spark, sf):
    return mo.two_step_model(_beams(spark, sf), "file", "db", "angle", F.col("angle") - 25)


# angles are whole numbers here, so the curves' points are hit exactly
_TWO = DET + """, beams AS (SELECT *, year(t) AS file FROM det), own AS (SELECT file, mode, antenna, sector, CAST(angle AS INTEGER) AS bin, 10 * log10(avg(power(10, db / 10))) AS mean_db, count(*) AS n FROM beams GROUP BY ALL),
cur AS (SELECT mode, antenna, sector, bin, sum(mean_db * n) / sum(n) AS mean_db FROM own GROUP BY ALL),
res AS (SELECT beams.*, db - mean_db AS residual FROM beams JOIN cur USING (mode, antenna, sector) WHERE cur.bin = beams.angle),
per AS (SELECT file, mode, antenna, sector, CAST(angle - 25 + 80 AS INTEGER) AS bin, 10 * log10(avg(power(10, db / 10))) AS mean_db, avg(residual) AS residual_db, count(*) AS n FROM res GROUP BY ALL),
tra AS (SELECT mode, antenna, sector, bin, sum(mean_db * n) / sum(n) AS mean_db, sum(residual_db * n) / sum(n) AS residual_db, CAST(sum(n) AS BIGINT) AS n FROM per GROUP BY ALL)"""


@query("a29_two_step_model", f"WITH {_TWO} SELECT mode, antenna, sector, bin, round(mean_db, 4) AS mean_db, round(residual_db, 4) + 0.0 AS residual_db, n FROM tra")
def a29(spark, sf):
    """Incidence curves by file, then residuals from the merged ones by transmission angle."""
    return _model(spark, sf)[1].select(*an.CURVE, "bin", F.round("mean_db", 4).alias("mean_db"), (F.round("residual_db", 4) + 0.0).alias("residual_db"), "n")


def _sounder(spark, sf):
    """A sounder's model before its correction: a level for each angle of the first antenna's beams."""
    d = detections(spark, sf)
    first = d.groupBy("mode").agg(F.min("antenna").alias("antenna"))
    return d.join(first, ["mode", "antenna"]).groupBy("mode", "sector", F.col("angle").cast("double").alias("angle")).agg((F.avg("w") * 100).alias("level"))


def _numbered(df):
    return df.withColumns({"mode": F.instr(F.lit("ANR"), F.col("mode")), "sector": F.instr(F.lit("FO"), F.col("sector")) - 1, "swath": F.lit(0)})


_FIX = _TWO + """, mod AS (SELECT mode, sector, angle, avg(w) * 100 AS level FROM det WHERE antenna = (SELECT min(antenna) FROM det AS o WHERE o.mode = det.mode) GROUP BY ALL),
fine AS (SELECT mode, sector, bin, residual_db FROM tra WHERE antenna = (SELECT min(antenna) FROM det AS o WHERE o.mode = tra.mode)),
fix AS (SELECT strpos('ANR', mod.mode) AS mode, 0 AS swath, strpos('FO', mod.sector) - 1 AS sector, angle - 25 AS angle, level - residual_db AS level FROM mod JOIN fine ON mod.mode = fine.mode AND mod.sector = fine.sector AND fine.bin = mod.angle + 55)"""


def _corrected(spark, sf):
    curve = _model(spark, sf)[1].withColumn("bin", F.col("bin") - 80)  # bins as angles
    model = _sounder(spark, sf).withColumn("angle", F.col("angle") - 25)
    return _numbered(mo.correct_model(model, curve))


@query("x32_corrected_model", f"WITH {_FIX} SELECT mode, swath, sector, angle, round(level, 4) AS level FROM fix")
def x32(spark, sf):
    """A sounder's model less the residuals, by splines; at their knots the SQL needs none."""
    return _corrected(spark, sf).select(F.col("mode").cast("long"), "swath", F.col("sector").cast("long"), "angle", *r("level"))


_LINES = """, top AS (SELECT mode, swath, sector, max(level) AS top, count(*) AS n FROM fix GROUP BY ALL),
num AS (SELECT fix.*, row_number() OVER (PARTITION BY mode, swath, sector ORDER BY angle DESC, level DESC) AS k FROM fix)"""


@query("k19_correction_lines", f"""WITH {_FIX}{_LINES} SELECT mode, swath, 0 AS sector, 0 AS line, mode || '   ' || swath || '   ' || count(*) AS value FROM top GROUP BY mode, swath
UNION ALL SELECT mode, swath, sector + 1, 0, '# TX Sector ' || (sector + 1) || ':' FROM top UNION ALL SELECT mode, swath, sector + 1, 1, CAST(n AS VARCHAR) FROM top
UNION ALL SELECT mode, swath, sector + 1, 1 + k, CAST(CAST(angle AS INTEGER) AS VARCHAR) || ' ' || printf('%.2f', -round(level, 6)) FROM num""")
def k19(spark, sf):
    """The text of the newer sounders, with signs turned."""
    return mo.correction_text(_corrected(spark, sf).withColumn("level", F.round("level", 6)), False)


@query("k19_source_level_lines", f"""WITH {_FIX}{_LINES} SELECT mode, swath, 0 AS sector, 0 AS line, mode || chr(9) || swath || chr(9) || count(*) AS value FROM top GROUP BY mode, swath
UNION ALL SELECT mode, swath, sector + 1, 0, '# TX Sector ' || (sector + 1) || ':' FROM top UNION ALL SELECT mode, swath, sector + 1, 1, printf('%.1f', round(top, 6)) FROM top UNION ALL SELECT mode, swath, sector + 1, 2, CAST(n AS VARCHAR) FROM top
UNION ALL SELECT mode, swath, sector + 1, 2 + k, printf('%.1f', angle) || chr(9) || printf('%.1f', round(level, 6) - round(top, 6)) FROM num JOIN top USING (mode, swath, sector)""")
def k19b(spark, sf):
    """The text of the older sounders: a source level, and levels below it."""
    return mo.correction_text(_corrected(spark, sf).withColumn("level", F.round("level", 6)), True)
