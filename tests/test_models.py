"""Two-step models and their correction against plain code."""

import numpy as np
import pytest

from fathomix.operators import models as mo


def polynomials(x, y, at):
    """The same spline from its conditions: four coefficients a piece, solved as one system."""
    m = len(x) - 1
    a, b = np.zeros((4 * m, 4 * m)), np.zeros(4 * m)
    power = lambda t, k: np.array([np.prod(range(i, i - k, -1)) * t ** (i - k) if i >= k else 0.0 for i in range(4)])
    row = 0
    for i in range(m):
        for t in (x[i], x[i + 1]):
            a[row, 4 * i : 4 * i + 4], b[row] = power(t, 0), y[i] if t == x[i] else y[i + 1]
            row += 1
    for i in range(m - 1):
        for k in (1, 2):
            a[row, 4 * i : 4 * i + 4], a[row, 4 * i + 4 : 4 * i + 8] = power(x[i + 1], k), -power(x[i + 1], k)
            row += 1
    for i in (0, m - 2):
        a[row, 4 * i : 4 * i + 4], a[row, 4 * i + 4 : 4 * i + 8] = power(x[i + 1], 3), -power(x[i + 1], 3)
        row += 1
    c = np.linalg.solve(a, b).reshape(m, 4)
    piece = np.clip(np.searchsorted(x, at, side="right") - 1, 0, m - 1)
    return np.array([c[p] @ power(t, 0) for p, t in zip(piece, at)])


@pytest.mark.parametrize("n", [4, 5, 9])
def test_spline_against_its_conditions(n):
    rng = np.random.default_rng(n)
    x, y = np.cumsum(rng.uniform(0.3, 1.0, n)) - 2, rng.normal(size=n)
    at = np.linspace(x[0] - 0.5, x[-1] + 0.5, 41)  # beyond the ends too
    assert np.allclose(mo.spline_through(x, y, at), polynomials(x, y, at), atol=1e-6)
    assert np.allclose(mo.spline_through(x, y, x), y)


def test_spline_keeps_polynomials():
    at = np.linspace(-3, 6, 19)
    for x, f in (([0.0, 2.0], lambda t: 3 * t - 1), ([0.0, 1.0, 3.0], lambda t: t * t - t), ([0.0, 1.0, 2.5, 3.0, 5.0], lambda t: t**3 - 2 * t)):
        assert np.allclose(mo.spline_through(np.array(x), f(np.array(x)), at), f(at))


BEAM = "file string, mode string, antenna int, sector int, db double, inc double, tx double, bin string"


def test_two_steps_against_plain_code(spark):
    rng = np.random.default_rng(1)
    rows = [(f"f{rng.integers(3)}", "a", 1, int(rng.integers(2)), float(rng.normal(-20, 4)), float(rng.integers(0, 4)), float(rng.integers(-2, 3)), "x") for _ in range(300)]
    odd = [("f0", "a", 1, 0, None, 1.0, 1.0, "x"), ("f0", "a", 1, 0, -3.0, None, None, "x"), ("f0", "a", 1, 0, -3.0, 95.0, 95.0, "x")]
    curves, out = mo.two_step_model(spark.createDataFrame(rows + odd, BEAM), "file", "db", "inc", "tx")

    def curve(values, key):  # means by file in energy, then of files in dB by count
        per = {}
        for r, v in values:
            per.setdefault((*key(r), r[0]), []).append(v)
        total = {}
        for k, v in per.items():
            total.setdefault(k[:-1], []).append((v, len(v)))
        return total

    level = lambda v: 10 * np.log10(np.mean(10 ** (np.array(v) / 10)))
    inc = {k: sum(level(v) * n for v, n in p) / sum(n for _, n in p) for k, p in curve([(r, r[4]) for r in rows], lambda r: (r[3], int(r[5]))).items()}
    assert {(r.sector, r.bin): round(r.mean_db, 8) for r in curves.collect()} == {k: round(v, 8) for k, v in inc.items()}
    tra = curve([(r, r[4] - inc[r[3], int(r[5])]) for r in rows], lambda r: (r[3], int(r[6]) + 80))
    want = {k: (round(sum(np.mean(v) * n for v, n in p) / sum(n for _, n in p), 8), sum(n for _, n in p)) for k, p in tra.items()}
    assert {(r.sector, r.bin): (round(r.residual_db, 8), r.n) for r in out.collect()} == want
    again = mo.two_step_model(spark.createDataFrame(rows, BEAM), "file", "db", "inc", "tx", reference=curves)[1]
    assert {(r.sector, r.bin): (round(r.residual_db, 8), r.n) for r in again.collect()} == want
    common = mo.two_step_model(spark.createDataFrame(rows, BEAM), "file", "db", "inc", "tx", by_sector=False)[1]
    assert common.count() == len(want) and abs(sum(r.residual_db * r.n for r in common.collect())) > 0


def test_correction_and_its_cases(spark):
    curve = spark.createDataFrame([("a", 2, 0, float(b), 100.0) for b in range(4)] + [("a", 1, 0, float(b), float(b * b)) for b in (0, 1, 2, 3)] + [("a", 1, 0, 3.0, 50.0), ("a", 1, 1, 0.0, 9.0), ("a", 1, 0, 4.0, None)], "mode string, antenna int, sector int, bin double, residual_db double")
    model = spark.createDataFrame([("a", 0, 0, 1.5, 10.0, "k"), ("a", 0, 0, 5.0, 10.0, "k"), ("a", 0, 1, 0.0, 7.0, "k"), ("b", 0, 0, 0.0, 6.0, None), ("a", 0, 0, None, 1.0, "k"), ("a", 0, 0, 1.0, None, "k")], "mode string, swath int, sector int, angle double, level double, x string")
    got = sorted((r.mode, r.sector, r.angle, round(r.level, 6), r.x) for r in mo.correct_model(model, curve).collect())
    # the first antenna only, beyond the curve too; one point corrects nothing; nor does no curve
    assert got == [("a", 0, 1.5, 7.75, "k"), ("a", 0, 5.0, -15.0, "k"), ("a", 1, 0.0, 7.0, "k"), ("b", 0, 0.0, 6.0, None)]
    zero = {(r.mode, r.sector, r.angle): round(r.level, 6) for r in mo.correct_model(model, curve, True).collect()}
    assert zero == {("a", 0, 1.5): -2.25, ("a", 0, 5.0): -25.0, ("a", 1, 0.0): 7.0, ("b", 0, 0.0): 6.0}
    assert mo.correct_model(model.limit(0), curve).count() == 0 and mo.correct_model(model, curve.limit(0)).count() == 4


def test_text_reads_back(spark):
    from fathomix.sources.readers import response_text

    model = spark.createDataFrame([(1, 0, 0, 10.5, -2.25), (1, 0, 0, -10.0, 1.5), (1, 0, 1, 0.25, 3.0), (2, 1, 0, 0.0, 0.0), (2, 1, 0, None, 0.0)], "mode int, swath int, sector int, angle double, level double")
    new = [r.value for r in mo.correction_text(model, False).orderBy("mode", "swath", "sector", "line").collect()]
    assert new == ["1   0   2", "# TX Sector 1:", "2", "10.5 2.25", "-10 -1.50", "# TX Sector 2:", "1", "0.25 -3.00", "2   1   1", "# TX Sector 1:", "1", "0 -0.00"]
    assert response_text(new, -1.0, False) == [(1, 0, 0, 10.5, -2.25), (1, 0, 0, -10.0, 1.5), (1, 0, 1, 0.25, 3.0), (2, 1, 0, 0.0, 0.0)]
    old = [r.value for r in mo.correction_text(model, True).orderBy("mode", "swath", "sector", "line").collect()]
    assert old[:5] == ["1\t0\t2", "# TX Sector 1:", "1.5", "2", "10.5\t-3.8"]
    assert response_text(old, 1.0, True)[1] == (1, 0, 0, -10.0, 1.5)
    assert mo.correction_text(model.limit(0), True).count() == 0
