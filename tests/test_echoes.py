"""Placing and gridding of echoes against plain code."""

import math
import random

from fathomix.operators import echoes as ec

BEAM = "p int, b int, levels array<double>, angle double, tilt double, blank double, interval double, speed double, depth double, x string"


def beams(seed=3):
    rng = random.Random(seed)
    level = lambda: rng.choice([None, float("nan"), rng.uniform(-80, -10), rng.uniform(-80, -10)])
    out = [(p, b, [level() for _ in range(rng.choice([0, 1, 5, 12]))], rng.choice([b * 10 - 30.0, 0.0]), rng.choice([None, 2.0]), rng.choice([None, 0.001]), 0.004, 1500.0, 3.0 + b / 10, "x") for p in range(5) for b in range(7)]
    return out + [(9, 0, None, 1.0, 0.0, 0.0, 0.004, 1500.0, 3.0, None), (9, 1, [-10.0], None, 0.0, 0.0, 0.004, 1500.0, 3.0, None), (9, 2, [None, float("nan")], 1.0, 0.0, 0.0, 0.004, 1500.0, 3.0, None)]


def plain(rows):
    """(p, b, sample, level, across, along, elevation) of each echo."""
    out = []
    for p, b, levels, angle, tilt, blank, step, speed, depth, _ in rows:
        for i, v in enumerate(levels or []):
            if v is not None and not math.isnan(v) and angle is not None:
                r, k, a = ((blank or 0) + i * step) * speed / 2, math.radians(tilt or 0), math.radians(angle)
                out.append((p, b, i, v, r * math.cos(k) * math.sin(a), r * math.sin(k), -depth - r * math.cos(k) * math.cos(a)))
    return out


def test_places(spark):
    rows = beams()
    got = ec.spatialise(spark.createDataFrame(rows, BEAM))
    assert "x" in got.columns and "levels" not in got.columns
    found = sorted((r.p, r.b, r.sample, r.level, *(round(v, 8) for v in (r.across, r.along, r.elevation))) for r in got.collect())
    assert found == sorted((*e[:4], *(round(v, 8) for v in e[4:])) for e in plain(rows)) and len(found) > 60


def test_echograms(spark):
    rows, cell, across, height = beams(), (2.0, 1.0), 5.0, 12
    df = ec.openings(spark.createDataFrame(rows, BEAM), ["p"], 4.0)
    want, sizes = {}, {}
    for p in {r[0] for r in rows}:
        own = [e for e in plain(rows) if e[0] == p]
        if not own:
            continue
        top = -min(r[8] for r in rows if r[0] == p and any(e[1] == r[1] for e in own))
        x0, x1 = max(min(e[4] for e in own), -2 * across), min(max(e[4] for e in own), 2 * across)
        z0 = max(min(e[6] for e in own), top - height * cell[1])
        nx, nz = round((x1 - x0) / cell[0]) + 1, round((top - z0) / cell[1]) + 1
        sizes[p] = (nx, nz)
        for e in own:
            y, z = round((e[4] - x0) / cell[0]), round((top - e[6]) / cell[1])
            if 0 <= y < nx and 0 <= z < nz:
                want.setdefault((p, y, z), []).append(10 ** (e[3] / 10))
    got = ec.polar_echograms(df, ["p"], cell, across, height).collect()
    assert {(r.p, r.yi, r.zi): (round(r.mean_db, 6), r.n) for r in got} == {k: (round(10 * math.log10(sum(v) / len(v)), 6), len(v)) for k, v in want.items()}
    assert {r.p: (r["columns"], r["rows"]) for r in ec.bounds(df, ["p"], cell, across, height).collect()} == sizes


def test_openings_and_empty(spark):
    df = spark.createDataFrame([(0, i, a) for i, a in enumerate([0.0, 2.0, 5.0, 5.0, None])] + [(1, 0, 3.0)], "p int, b int, angle double")
    assert {(r.p, r.b): r.opening for r in ec.openings(df, ["p"], 2.75).collect()} == {(0, 0): 2.0, (0, 1): 2.5, (0, 2): 1.5, (0, 3): 1.5, (0, 4): None, (1, 0): 2.75}
    none = spark.createDataFrame([], BEAM)
    assert ec.polar_echograms(ec.openings(none, ["p"], 1.0), ["p"], (1.0, 1.0), 5.0, 10).count() == 0
