"""Inpainting by tiles against the same sweeps over the whole grid, cell by cell."""

import math
import random

import pytest

from fathomix.operators.inpaint import inpaint
from fathomix.plans.tables import cut


def whole(cells, rows, cols, how, sweeps, least=1e-3):
    u = dict(cells)
    last = {}
    for _ in range(sweeps):
        def near(p):
            return [q for q in ((p[0] - 1, p[1]), (p[0] + 1, p[1]), (p[0], p[1] - 1), (p[0], p[1] + 1)) if q in u]

        def g(p):
            s = 0.0
            for d in ((1, 0), (0, 1)):
                a, b = (p[0] - d[0], p[1] - d[1]), (p[0] + d[0], p[1] + d[1])
                n = (a in u) + (b in u)
                if n and p in u:
                    s += ((u.get(b, u[p]) - u.get(a, u[p])) / n) ** 2
                elif n == 2:
                    s += ((u[b] - u[a]) / 2) ** 2
            return 1 / math.sqrt(least**2 + s)

        new = {}
        for p in ((i, j) for i in range(rows) for j in range(cols)):
            if p in cells or not near(p):
                continue
            v = [u[q] for q in near(p)]
            if how == "amle":
                new[p] = (min(v) + max(v)) / 2
            elif how == "harmonic":
                new[p] = sum(v) / len(v)
            else:
                w = [(g(p) + g(q)) / 2 if p in u else g(q) for q in near(p)]
                new[p] = sum(a * b for a, b in zip(w, v)) / sum(w)
        last = {p: abs(v - u.get(p, 0.0)) for p, v in new.items()}
        u |= new
    return {p: (round(v, 6), round(last[p], 6)) for p, v in u.items() if p not in cells}


@pytest.mark.parametrize("how", ["harmonic", "amle", "tv"])
def test_tiles_dont_change_the_result(spark, how):
    rng = random.Random(4)
    rows, cols = 23, 19
    cells = {(i, j): (5.0 if j > 9 else 0.0) + rng.random() for i in range(rows) for j in range(cols) if not (4 < i < 17 and 5 < j < 15) and rng.random() < 0.8}
    df = spark.createDataFrame([(i, j, v, "x") for (i, j), v in cells.items()] + [(8, 8, None, "x"), (99, 0, 1.0, "x"), (0, -1, 1.0, "x")], "row int, col int, z double, value string")
    want = whole(cells, rows, cols, how, 6)
    for tile, rounds, sweeps in ((5, 3, 2), (64, 1, 6)):
        got = {(r.row, r.col): (round(r.value, 6), round(r.change, 6)) for r in inpaint(df, "z", rows, cols, cut, how, rounds, sweeps, tile).collect()}
        assert got.keys() == want.keys() and all(abs(a - b) < 2e-6 for p in want for a, b in zip(got[p], want[p]))


def test_edges_stay_and_cases(spark):
    df = spark.createDataFrame([(i, j, 0.0 if j < 4 else 10.0) for i in range(9) for j in range(9) if not (3 <= i <= 5 and 2 <= j <= 6)], "row int, col int, z double")
    ends = {how: {(r.row, r.col): r.value for r in inpaint(df, "z", 9, 9, cut, how, 6, 10, 16).collect()} for how in ("harmonic", "tv")}
    sharp = {how: v[4, 5] - v[4, 2] for how, v in ends.items()}
    assert sharp["tv"] > sharp["harmonic"]
    assert inpaint(df.limit(0), "z", 5, 5, cut).count() == 0
    one = spark.createDataFrame([(2, 2, 7.0), (2, 2, 3.0)], "row int, col int, z double")
    assert {(r.row, r.col): r.value for r in inpaint(one, "z", 5, 5, cut, "amle", 1, 1).collect()} == {p: 3.0 for p in ((1, 2), (3, 2), (2, 1), (2, 3))}
