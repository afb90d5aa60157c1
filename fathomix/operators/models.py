"""Mean-response models in two steps, and the sounder's correction model made from them.

The first pass gives incidence curves by file, merged by their counts.  The second pass takes each
level's residual from the merged curve and bins it by transmission angle, again by file, merged by
counts.  A sounder's correction model is then lessened by the residual curve of the same mode and
sector, and written as the text the sounder reads.

Beams are scanned twice; what is shuffled are partial aggregates, at most 90 and 161 bins a file
and key.  Curves and models don't grow with the number of beams.

Defined cases: beams with a null level or with an angle that is null or beyond the bins are left out;
a residual is null where no curve has the beam's mode, and then doesn't count; curves of several
antennas give the correction of the smallest one; curves of fewer than two points correct nothing;
of a curve's points at one angle the smallest counts; model points without an angle or a level are
left out; empty tables give none; further columns of beams are ignored, of models kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import angular as an


def two_step_model(
    beams: DataFrame, file: str, level: str, incidence: str, transmission: str | Column, keys: list[str] = an.CURVE, by_sector: bool = True, reference: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(incidence curves, transmission curves with mean_db, residual_db and n) of all files.

    ``reference`` replaces the first pass by given curves (keys, bin, mean_db, n); without
    ``by_sector`` residuals are taken from one curve for all sectors."""
    ok = beams.filter(F.col(level).isNotNull())
    own = keys if by_sector else [k for k in keys if k != "sector"]
    curves = reference
    if curves is None:
        curves = an.merge_curves(an.incidence_curve(ok, level, incidence, [file, *keys]), [*keys, "bin"])
    base = curves if by_sector else an.merge_curves(curves, [*own, "bin"])
    rest = an.residuals(ok, base, level, incidence, own)
    per_file = an.transmission_curve(rest, level, "residual", transmission, [file, *keys])
    return curves, an.merge_values(per_file, [*keys, "bin"], ["mean_db", "residual_db"])


def spline_through(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Interpolating cubic spline whose first two and last two pieces are one polynomial each, going on
    beyond its ends; a parabola through three points, a line through two."""
    m = len(x)
    if m <= 3:
        return sum(y[i] * np.prod([(at - x[j]) / (x[i] - x[j]) for j in range(m) if j != i], axis=0) for i in range(m))
    h = np.diff(x)
    slope = np.diff(y) / h
    a, b = np.zeros((m, m)), np.zeros(m)
    inner = np.arange(1, m - 1)
    a[inner, inner - 1], a[inner, inner], a[inner, inner + 1] = h[:-1], 2 * (h[:-1] + h[1:]), h[1:]
    b[1:-1] = 6 * np.diff(slope)
    a[0, :3] = h[1], -h[0] - h[1], h[0]
    a[-1, -3:] = h[-1], -h[-2] - h[-1], h[-2]
    k = np.linalg.solve(a, b)
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, m - 2)
    d = at - x[i]
    return y[i] + d * (slope[i] - h[i] * (2 * k[i] + k[i + 1]) / 6 + d * (k[i] / 2 + d * (k[i + 1] - k[i]) / (6 * h[i])))


def correct_model(model: DataFrame, transmission: DataFrame, from_zero: bool = False) -> DataFrame:
    """The model (mode, sector, angle, level, ...) less the residual curve (mode, antenna, sector, bin,
    residual_db) of its mode and sector at its angles; ``from_zero`` forgets the levels there were,
    where a curve corrects them."""
    ok = transmission.filter(F.col("residual_db").isNotNull() & ~F.isnan("residual_db"))
    first = transmission.groupBy("mode").agg(F.min("antenna").alias("antenna"))
    curve = ok.join(first, ["mode", "antenna"]).select("mode", "sector", F.col("bin").cast("double").alias("x"), F.col("residual_db").cast("double").alias("y"))
    points = model.withColumns({"angle": F.col("angle").cast("double"), "level": F.col("level").cast("double")})
    points = points.filter(F.col("angle").isNotNull() & F.col("level").isNotNull() & ~F.isnan("angle") & ~F.isnan("level"))

    def one(key: tuple, own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if len(own):
            c = other.sort_values(["x", "y"]).drop_duplicates("x")
            if len(c) >= 2:
                base = 0.0 if from_zero else own["level"].to_numpy()
                own = own.assign(level=base - spline_through(c["x"].to_numpy(), c["y"].to_numpy(), own["angle"].to_numpy()))
        return own

    return points.groupBy("mode", "sector").cogroup(curve.groupBy("mode", "sector")).applyInPandas(one, points.schema)


def _number(x: Column) -> Column:
    """A number of up to six decimals without the zeros at its end."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", x), "0+$", ""), r"\.$", "")


def correction_text(model: DataFrame, source_level: bool) -> DataFrame:
    """(mode, swath, sector, line, value): the lines of a sounder's text model, to be ordered by the
    first four columns.  Sectors are numbered from 1; 0 stands for a mode's head.

    With ``source_level`` each sector states its greatest level and levels below it, with one
    decimal and tabs; without, levels change sign and have two decimals."""
    points = model.filter("angle is not null and level is not null").filter(~F.isnan("angle") & ~F.isnan("level"))
    pair = F.struct(F.col("angle").cast("double").alias("angle"), F.col("level").cast("double").alias("level"))
    per = points.groupBy("mode", "swath", "sector").agg(F.max("level").cast("double").alias("top"), F.reverse(F.array_sort(F.collect_list(pair))).alias("points"))
    sector = (F.col("sector") + 1).cast("int")
    gap = "\t" if source_level else "   "
    if source_level:
        pairs = F.transform("points", lambda p: F.concat(F.format_string("%.1f", p["angle"]), F.lit("\t"), F.format_string("%.1f", p["level"] - F.col("top"))))
        head = F.array(F.concat(F.lit("# TX Sector "), sector, F.lit(":")), F.format_string("%.1f", F.col("top")), F.size("points").cast("string"))
    else:
        pairs = F.transform("points", lambda p: F.concat(_number(p["angle"]), F.lit(" "), F.format_string("%.2f", -p["level"])))
        head = F.array(F.concat(F.lit("# TX Sector "), sector, F.lit(":")), F.size("points").cast("string"))
    body = per.select("mode", "swath", sector.alias("sector"), F.posexplode(F.concat(head, pairs)).alias("line", "value"))
    heads = points.groupBy("mode", "swath").agg(F.concat_ws(gap, F.col("mode"), F.col("swath"), F.count_distinct("sector")).alias("value"))
    return heads.select("mode", "swath", F.lit(0).alias("sector"), F.lit(0).alias("line"), "value").unionByName(body)
