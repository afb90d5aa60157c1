"""Registration of contour lines: by how much must one survey be shifted to fit another?

Each source line is matched with the nearest target line of its level.  Both get evenly spaced
vertices and, for several window widths, chain codes (how the mean azimuth changes along the line).
Sliding one along the other, the mismatch of the codes says which stretches are alike and the
misplacement (distance of vertices) where to look; the best stretch gives the shift, by Procrustes.

Lines meet by equi-joins on level and cells as wide as the greatest shift, never in all pairs.  A
source line's group holds it and the target's vertices around it, so the target's length doesn't count.

Defined cases: null vertices are left out; of vertices with one place in the order the one with the
smallest x stays; lines with fewer than two places, or with too little overlap, give no vector; of
target lines equally near the smallest id is taken; empty tables give no vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData

from .solvers import procrustes

WINDOWS = (10, 30, 50, 70, 90)

# -- kernels --------------------------------------------------------------------------------------


def even_vertices(xy: np.ndarray, spacing: float) -> np.ndarray:
    """A path with evenly spaced vertices, about ``spacing`` apart; its ends stay."""
    d = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(xy, axis=0).T))])
    at = np.linspace(0, d[-1], max(1, round(d[-1] / spacing)) + 1)
    return np.stack([np.interp(at, d, xy[:, k]) for k in (0, 1)], 1)


def chain_codes(xy: np.ndarray, windows: tuple[int, ...] = WINDOWS) -> np.ndarray:
    """(window, vertex): mean azimuth of the half of the window ahead less that of the one behind;
    the middle one of an odd number counts in both.  The last vertex has no azimuth and no code."""
    step = np.diff(xy, axis=0)
    azimuth = np.unwrap(np.degrees(np.arctan2(step[:, 0], step[:, 1])), period=360)
    along = np.cumsum(np.hypot(*step.T))
    total = np.concatenate([[0], np.cumsum(azimuth)])
    out = np.empty((len(windows), len(azimuth)))
    for row, width in zip(out, windows):
        a = np.searchsorted(along, along - width / 2 - 1e-9)
        b = np.searchsorted(along, along + width / 2 + 1e-9, "right")
        n = b - a
        row[:] = (total[b] - total[a + n // 2]) / (n - n // 2) - (total[a + (n + 1) // 2] - total[a]) / ((n + 1) // 2)
    return out


def sliding_sums(source: np.ndarray, target: np.ndarray, differ, block: int = 1024) -> np.ndarray:
    """Sum of differ(target[j], source[k]) for every offset: entry i has j - k = i - (sources - 1)."""
    n, m = len(source), len(target)
    out = np.zeros(n + m - 1)
    for lo in range(0, m, block):  # bounded memory
        d = differ(target[lo : lo + block], source)[:, ::-1]
        # rows moved by one place each, so that an offset's entries stand in one column
        moved = np.zeros((len(d), n + len(d)))
        moved[:, :n] = d
        out[lo : lo + n + len(d) - 1] += moved.ravel()[: len(d) * (n + len(d) - 1)].reshape(len(d), -1).sum(0)
    return out


def overlaps(n: int, m: int) -> np.ndarray:
    """Vertices that meet at each offset."""
    i = np.arange(n + m - 1)
    return np.minimum(np.minimum(i + 1, n + m - 1 - i), min(n, m))


def meeting(source: np.ndarray, target: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of target and source that meet at an offset."""
    k, j = max(0, len(source) - 1 - offset), max(0, offset + 1 - len(source))
    both = min(len(source) - k, len(target) - j)
    return target[j : j + both], source[k : k + both]


def least_misplacement(s: np.ndarray, t: np.ndarray, weight: np.ndarray, sizes: tuple[int, ...] = (512, 64, 8)) -> int:
    """The first offset with the least sum of distances over its weight.

    Distances of the sums of a run of vertices are no more than the sum of their distances, so sums by runs
    bound an offset from below; only offsets whose bound isn't above the best one are looked at by shorter
    runs, and in the end vertex by vertex."""
    n, m = len(s), len(t)
    if n * m <= 1 << 16:
        return int((sliding_sums(s, t, lambda a, b: np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])) / weight).argmin())
    middle = s.mean(0)  # small numbers keep the running sums exact enough; ``loose`` is what rounding can make of them
    up_s, up_t = (np.concatenate([np.zeros((1, 2)), np.cumsum(v - middle, axis=0)]) for v in (s, t))
    loose = 8 * np.finfo(float).eps * (n + m) * (np.abs(s - middle).sum() + np.abs(t - middle).sum())
    best = (np.inf, 0)
    left = np.arange(n + m - 1)
    low = np.zeros(len(left))
    for size in sizes:
        edges = np.append(np.arange(0, n, size), n)
        low = np.zeros(len(left))
        for a, b in zip(edges[:-1], edges[1:]):
            # of a run what meets the target, if any
            step = left - (n - 1)
            k0, k1 = np.maximum(a, -step), np.minimum(b, m - step)
            on = k1 > k0
            k0, k1, step = k0[on], k1[on], step[on]
            low[on] += np.hypot(*(up_t[k1 + step] - up_t[k0 + step] - up_s[k1] + up_s[k0]).T)
        low = (low - loose * len(edges)) * (1 - 1e-9) / weight[left]
        at = int(left[low.argmin()])
        best = min(best, (_misplaced(s, t, at) / weight[at], at))
        low, left = low[low <= best[0]], left[low <= best[0]]
    for bound, at in sorted(zip(low.tolist(), left.tolist())):
        if bound > best[0]:
            break
        best = min(best, (_misplaced(s, t, at) / weight[at], at))
    return best[1]


def _misplaced(s: np.ndarray, t: np.ndarray, offset: int) -> float:
    u, v = meeting(s, t, offset)
    return float(np.hypot(u[:, 0] - v[:, 0], u[:, 1] - v[:, 1]).sum())


def best_match(source: np.ndarray, target: np.ndarray, reach: float, windows: tuple[int, ...] = WINDOWS) -> tuple[int, float]:
    """(offset, score) where the chain codes of two evenly spaced paths are most alike.

    Sums are divided by n log(n + 1) of the n vertices that meet, which favours long overlaps.  The
    least misplacement is found first; around it, as far as ``reach`` goes in vertices, each window's
    least mismatch; of those the one nearest to it, then of the lowest score."""
    s, t = source[:-1], target[:-1]
    n, m = len(s), len(t)
    weight = overlaps(n, m) * np.log(overlaps(n, m) + 1)
    middle = least_misplacement(s, t, weight)
    span = round(reach / np.hypot(*np.diff(target, axis=0).T).mean())
    lo, hi = max(0, middle - span), min(n + m - 2, middle + span) + 1
    found = []
    for a, b in zip(chain_codes(source, windows), chain_codes(target, windows)):
        score = np.array([np.abs(u - v).sum() for u, v in (meeting(a, b, i) for i in range(lo, hi))]) / weight[lo:hi]
        i = int(score.argmin())
        found.append((abs(lo + i - middle), float(score[i]), lo + i))
    _, score, at = min(found)
    return at, score


def shift_of(source: np.ndarray, target: np.ndarray, spacing: float, least: int, reach: float, most_turn: float, windows: tuple[int, ...] = WINDOWS) -> dict | None:
    """The shift that lays a source path on a target path, or None: too short, too far, too turned."""
    s, t = even_vertices(source, spacing), even_vertices(target, spacing)
    n, m = len(s) - 1, len(t) - 1
    if n <= least or m <= least:
        return None
    at, score = best_match(s, t, reach, windows)
    k, j = max(0, n - 1 - at), max(0, at + 1 - n)
    both = int(overlaps(n, m)[at])
    if both <= least:
        return None
    a, b = s[k : k + both], t[j : j + both]
    turn = procrustes(a, b)[0]
    east, north = (b.mean(0) - a.mean(0)).tolist()
    if np.hypot(east, north) >= reach or abs(turn) >= most_turn:
        return None
    return {"east": east, "north": north, "turn": turn, "overlap": both, "score": score}


# -- on tables --------------------------------------------------------------------------------------


def segments(lines: DataFrame) -> DataFrame:
    """lines (line, level, i, x, y) as segments (line, level, ax, ay, bx, by)."""
    one = lines.filter("line is not null and i is not null and x is not null and y is not null").groupBy("line", "level", "i").agg(F.min(F.struct("x", "y")).alias("p"))
    w = Window.partitionBy("line", "level").orderBy("i")
    pair = one.select("line", "level", F.col("p.x").alias("ax"), F.col("p.y").alias("ay"), F.lead("p").over(w).alias("q")).filter("q is not null")
    return pair.select("line", "level", "ax", "ay", F.col("q.x").alias("bx"), F.col("q.y").alias("by"))


def _to_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = bx - ax, by - ay
    u = F.coalesce(((px - ax) * dx + (py - ay) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), u))
    return F.sqrt((px - ax - u * dx) ** 2 + (py - ay - u * dy) ** 2)


def _apart(s: str, t: str) -> Column:
    """Distance of two segments; 0 where they cross."""
    c = lambda side, k: F.col(f"{side}{k}")
    a, b, p, q = ((c(s, "ax"), c(s, "ay")), (c(s, "bx"), c(s, "by")), (c(t, "ax"), c(t, "ay")), (c(t, "bx"), c(t, "by")))
    side = lambda u, v, w: F.signum((v[0] - u[0]) * (w[1] - u[1]) - (v[1] - u[1]) * (w[0] - u[0]))
    cross = (side(a, b, p) * side(a, b, q) < 0) & (side(p, q, a) * side(p, q, b) < 0)
    return F.when(cross, 0.0).otherwise(F.least(_to_segment(*a, *p, *q), _to_segment(*b, *p, *q), _to_segment(*p, *a, *b), _to_segment(*q, *a, *b)))


def _cells(seg: DataFrame, width: float, around: float) -> DataFrame:
    """Segments with every cell that their box, ``around`` wider, touches."""
    edge = lambda k, way: F.floor(((F.least if way < 0 else F.greatest)(f"a{k}", f"b{k}") + way * around) / width)
    seg = seg.withColumns({"cx0": edge("x", -1), "cy0": edge("y", -1)})
    return seg.withColumn("cx", F.explode(F.sequence("cx0", edge("x", 1)))).withColumn("cy", F.explode(F.sequence("cy0", edge("y", 1))))


def nearest_lines(source: DataFrame, target: DataFrame, reach: float) -> DataFrame:
    """(line, target, distance): each source line's nearest target line of its level within ``reach``."""
    name = lambda d, k: d.select(*(F.col(c).alias(k + c) for c in ("line", "level", "ax", "ay", "bx", "by", "cx0", "cy0")), "cx", "cy")
    s, t = name(_cells(segments(source), reach, reach), "s"), name(_cells(segments(target), reach, 0.0), "t")
    near = s.join(t, (F.col("slevel") == F.col("tlevel")) & (s["cx"] == t["cx"]) & (s["cy"] == t["cy"]))
    # of the cells that two segments share, the first one counts: each pair is measured once
    near = near.filter((s["cx"] == F.greatest("scx0", "tcx0")) & (s["cy"] == F.greatest("scy0", "tcy0")))
    near = near.groupBy("sline", "tline").agg(F.min(_apart("s", "t")).alias("d")).filter(F.col("d") <= reach)
    return near.groupBy(F.col("sline").alias("line")).agg(F.min(F.struct("d", "tline")).alias("m")).select("line", F.col("m.tline").alias("target"), F.col("m.d").alias("distance"))


def nearest_times(source: DataFrame, nav: DataFrame, reach: float) -> DataFrame:
    """(line, t): the time of the navigation point (t, x, y) nearest to each source line within
    ``reach``; of lines that share it only the closest one."""
    s = _cells(segments(source), reach, reach)
    n = nav.filter("t is not null and x is not null and y is not null").select("t", F.col("x").alias("nx"), F.col("y").alias("ny"))
    n = n.withColumns({"cx": F.floor(F.col("nx") / reach), "cy": F.floor(F.col("ny") / reach)})
    d = s.join(n, ["cx", "cy"]).select("line", "t", _to_segment(*(F.col(k) for k in ("nx", "ny", "ax", "ay", "bx", "by"))).alias("d"))
    one = d.filter(F.col("d") <= reach).groupBy("line").agg(F.min(F.struct("d", "t")).alias("m")).select("line", "m.t", "m.d")
    return one.groupBy("t").agg(F.min(F.struct("d", "line")).alias("m")).select("m.line", "t")


def shift_vectors(source: DataFrame, target: DataFrame, nav: DataFrame | None = None, reach: float = 100.0, spacing: float = 4.0, least: int = 6, most_turn: float = 20.0, near: float = 50.0, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """(line, target, east, north, turn, overlap, score) of every source line that fits a target line;
    with ``nav`` also t, and only lines that have a navigation point within ``near``.

    Lines are (line, level, i, x, y).  Target vertices farther than ``reach`` from the source line's box
    are left out; what remains of a line in several pieces is matched piece by piece, and the piece with
    the lowest score counts."""
    clean = "line is not null and i is not null and x is not null and y is not null"
    pairs = nearest_lines(source, target, reach)
    if nav is not None:
        pairs = pairs.join(nearest_times(source, nav, near), "line")
    s = source.filter(clean).join(pairs.select("line"), "line")
    box = s.groupBy("line").agg(*(f(k).alias(f"{n}{k}") for n, f in (("lo", F.min), ("hi", F.max)) for k in ("x", "y")))
    w = Window.partitionBy("line").orderBy("i")
    order = target.filter(clean).withColumn("n", F.row_number().over(w)).select(F.col("line").alias("target"), "i", "x", "y", "n")
    t = order.join(pairs.join(box, "line"), "target").filter("x >= lox - {0} AND x <= hix + {0} AND y >= loy - {0} AND y <= hiy + {0}".format(float(reach)))

    kind = pairs.select("line", "target").schema
    schema = f"line {kind['line'].dataType.simpleString()}, east double, north double, turn double, overlap long, score double"

    def vertices(p: pd.DataFrame) -> np.ndarray:
        return p.sort_values(["i", "x"]).drop_duplicates("i")[["x", "y"]].to_numpy(float)

    def pieces(p: pd.DataFrame) -> Iterator[np.ndarray]:
        p = p.sort_values(["n", "x"])
        for _, part in p.groupby((p["n"].diff() != 1).cumsum()):
            yield vertices(part)

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.rename(columns=lambda k: k.removeprefix("one_")), b.rename(columns=lambda k: k.removeprefix("two_"))
        if not len(a) or not len(b):
            return pd.DataFrame({k: [] for k in ("line", "east", "north", "turn", "overlap", "score")})
        own = vertices(a)
        found = [shift_of(own, piece, spacing, least, reach, most_turn, windows) for piece in pieces(b) if len(piece) > 1] if len(own) > 1 else []
        best = min((f for f in found if f), key=lambda f: f["score"], default=None)
        return pd.DataFrame([{"line": a["one"].iloc[0], **best}] if best else {k: [] for k in ("line", "east", "north", "turn", "overlap", "score")})

    # few bytes, much work: the number of tasks is stated, or adaptive execution puts all lines into one; by a key
    # more than the line, since an exchange by what tables are dealt by already is left out
    tasks = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))

    def rows(d: DataFrame, who: str, *names: str) -> GroupedData:
        """Groups by line; names apart, also of one table."""
        d = d.select(F.col("line").alias(who), F.hash("line").alias(f"{who}_at"), *(F.col(k).alias(f"{who}_{k}") for k in names))
        return d.repartition(tasks, f"{who}_at", who).groupBy(f"{who}_at", who)

    left, right = rows(s, "one", "i", "x", "y"), rows(t, "two", "n", "i", "x", "y")
    return left.cogroup(right).applyInPandas(one, schema).join(pairs.drop("distance"), "line")
