"""Water-column echoes: from samples in time to places around the platform, and to echogram cells.

A beam's samples are an array of levels, ``interval`` seconds apart from ``blank`` seconds on.  A
sample's range is half its travel time at the speed of sound; the beam's angles say where that is:
across to starboard, along to the bow, elevation upwards from the surface.

Beams stay rows until their samples are exploded, in the step before the map-side aggregate, so what is
shuffled are beams (for the bounds of their ping) and partial cells, never samples.  A ping's cells are
bounded by ``across`` and ``height`` over the cell size, whatever the samples.

Defined cases: null and NaN levels are no echoes and don't widen a ping's bounds; a beam without
levels, angle, interval, speed or depth has none either; a null blank or tilt counts 0; beams of
equal angle share the room between their neighbours; a ping without echoes gives no cells; an empty
table gives none; further columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .slices import energy_cells


def _present(level: Column) -> Column:
    return level.isNotNull() & ~F.isnan(level)


def _range(sample: Column) -> Column:
    """Range of a sample number in metres."""
    return (F.coalesce(F.col("blank"), F.lit(0.0)) + sample * F.col("interval")) * F.col("speed") / 2


def _place(distance: Column) -> tuple[Column, Column, Column]:
    """(across, along, elevation) of a range along the beam."""
    tilt = F.radians(F.coalesce(F.col("tilt"), F.lit(0.0)))
    flat = distance * F.cos(tilt)
    return flat * F.sin(F.radians("angle")), distance * F.sin(tilt), -F.col("depth") - flat * F.cos(F.radians("angle"))


def openings(beams: DataFrame, ping: list[str], width: float) -> DataFrame:
    """Beams with ``opening``: the degrees across of each that no other of its ping covers, half the way to
    its neighbours on both sides, at most ``width``; at the ends the inner half counts twice."""
    w = Window.partitionBy(*ping).orderBy("angle")
    steps = beams.filter("angle is not null").groupBy(*ping, "angle").agg(F.count("*").alias("_same"))
    left, right = F.col("angle") - F.lag("angle").over(w), F.lead("angle").over(w) - F.col("angle")
    room = (F.coalesce(left, right) + F.coalesce(right, left)) / 2
    steps = steps.withColumn("opening", F.least(F.coalesce(room, F.lit(float(width))) / F.col("_same"), F.lit(float(width)))).drop("_same")
    return beams.join(steps, [*ping, "angle"], "left")


def bounds(beams: DataFrame, ping: list[str], cell: tuple[float, float], across: float, height: int) -> DataFrame:
    """(ping, across_min, across_max, elevation_min, elevation_max, columns, rows, gap) of each ping's echoes.

    Bounds reach twice ``across`` to each side at most and ``height`` cells down from the shallowest
    transducer.  gap is the cells between neighbouring beams at the outer edge, as far as an
    interpolation may bridge.  Only a beam's first and last echoes are looked at: others lie between."""
    number = F.filter(F.sequence(F.lit(0), F.size("levels") - 1), lambda i: _present(F.get("levels", i)))
    some = beams.filter(F.size("levels") > 0).withColumn("_n", number).filter(F.size("_n") > 0)
    ends = some.withColumn("_s", F.explode(F.array_distinct(F.array(F.array_min("_n"), F.array_max("_n")))))
    x, _, z = _place(_range(F.col("_s")))
    ends = ends.withColumns({"_x": x, "_z": z}).filter("_x is not null and _z is not null")
    per = ends.groupBy(*ping).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.min("_z").alias("_low"), F.min("depth").alias("_top"), F.max("opening").alias("_open"))
    per = per.select(*ping, F.greatest("_lo", F.lit(-2.0 * across)).alias("across_min"), F.least("_hi", F.lit(2.0 * across)).alias("across_max"), (-F.col("_top")).alias("elevation_max"), F.greatest("_low", -F.col("_top") - height * cell[1]).alias("elevation_min"), "_open")
    far, drop = F.greatest(F.abs("across_min"), F.abs("across_max")), F.col("elevation_max") - F.col("elevation_min")
    spacing = F.tan(F.radians(F.col("_open") / 2)) * 2 * (far * far + drop * drop) / F.nullif(far, F.lit(0.0))
    return per.select(
        *ping, "across_min", "across_max", "elevation_min", "elevation_max", (F.rint((F.col("across_max") - F.col("across_min")) / cell[0]) + 1).cast("int").alias("columns"),
        (F.rint(drop / cell[1]) + 1).cast("int").alias("rows"), F.ceil(1.1 * spacing / cell[0] + 1).cast("int").alias("gap"),
    )


def spatialise(beams: DataFrame) -> DataFrame:
    """Every echo of every beam: the beam's columns but levels, with sample, level, range, across, along
    and elevation."""
    rest = [c for c in beams.columns if c != "levels"]
    at = beams.select("*", F.posexplode("levels").alias("sample", "level")).filter(_present(F.col("level")))
    x, y, z = _place(F.col("range"))
    at = at.withColumn("range", _range(F.col("sample"))).withColumns({"across": x, "along": y, "elevation": z})
    return at.filter("across is not null and along is not null and elevation is not null").select(*rest, "sample", "level", "range", "across", "along", "elevation")


def polar_echograms(beams: DataFrame, ping: list[str], cell: tuple[float, float], across: float, height: int) -> DataFrame:
    """(ping, yi, zi, mean_db, max_db, n): each ping's echoes on a grid across and down from its bounds' upper
    left corner; echoes outside of the bounds count nowhere."""
    frame = bounds(beams, ping, cell, across, height).select(*ping, "across_min", "elevation_max", "columns", "rows")
    echoes = spatialise(beams.join(frame, ping))
    yi, zi = F.rint((F.col("across") - F.col("across_min")) / cell[0]).cast("int"), F.rint((F.col("elevation_max") - F.col("elevation")) / cell[1]).cast("int")
    inside = echoes.withColumns({"yi": yi, "zi": zi}).filter((F.col("yi") >= 0) & (F.col("yi") < F.col("columns")) & (F.col("zi") >= 0) & (F.col("zi") < F.col("rows")))
    return energy_cells(inside, "level", [*ping, "yi", "zi"])
