"""As-of and interpolating joins, sliding windows, gaps, sessions, resampling.

Series are partitioned by a key (file, track, mode); a key's rows are ordered in one task, which
is what these operators mean.  Where one key may hold most rows, cut it first with ``slabs``.
Times are integers (micro- or nanoseconds), so frames are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions._cols import Num, c
from ..functions.acoustics import to_db, to_linear


def asof(left: DataFrame, right: DataFrame, keys: list[str], t: str, value: str, strict: bool = False, edges: str = "none", slab: int | None = None) -> DataFrame:
    """left with the last value of right at or before (``strict``: before) its time.

    Union and running last value: one shuffle by key, no range join.  ``edges``: "none" leaves
    times before the first value null, "first" gives them the first value.  With ``slab`` long series
    are cut into slabs of that many units of time, each begun by the last value before it."""
    tag = 1 if not strict else -1
    r = right.select(*keys, t, F.col(value).alias("_v"), F.lit(-tag).alias("_side"))
    u = left.withColumns({"_v": F.lit(None).cast(right.schema[value].dataType), "_side": F.lit(0)})
    if slab is None:
        u, by = u.unionByName(r, allowMissingColumns=True), keys
    else:
        by = [*keys, "_slab"]
        u, r = (d.withColumn("_slab", slabs(t, slab)) for d in (u, r.filter("_v is not null")))
        ends = r.groupBy(*by).agg(F.min_by(F.struct("_v"), t).alias("_a"), F.max_by(F.struct("_v"), t).alias("_z"))
        ends = u.select(*by).distinct().unionByName(ends, allowMissingColumns=True).groupBy(*by).agg(F.max_by("_a", F.col("_a").isNotNull()).alias("_a"), F.max_by("_z", F.col("_z").isNotNull()).alias("_z"))
        w = Window.partitionBy(*keys).orderBy("_slab")
        seed = F.last("_z", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        if edges == "first":
            seed = F.coalesce(seed, F.first("_a", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        seeds = ends.withColumn("_s", seed).select(*by, (F.col("_slab") * slab).cast(left.schema[t].dataType).alias(t), F.col("_s._v").alias("_v"), F.lit(-2).alias("_side"))
        u = u.unionByName(r, allowMissingColumns=True).unionByName(seeds, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(t, "_side")
    got = F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if edges == "first" and slab is None:  # before the first value of a key, the next one is its first
        got = F.coalesce(got, F.first("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return u.withColumn(value, got).filter("_side = 0").drop("_v", "_side", "_slab")


def interpolating(left: DataFrame, right: DataFrame, keys: list[str], t: str, value: str, outside: str = "null") -> DataFrame:
    """left with right's value linearly interpolated at its time.

    ``outside`` the range of right: "null", "zero" or "clamp"."""
    u = left.withColumns({"_v": F.lit(None).cast("double"), "_t": F.lit(None).cast("long"), "_side": F.lit(1)})
    r = right.select(*keys, t, F.col(value).cast("double").alias("_v"), F.col(t).cast("long").alias("_t"), F.lit(0).alias("_side"))
    u = u.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(t, "_side")
    back, fwd = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys).orderBy(F.col(t).desc(), F.col("_side").asc()).rowsBetween(Window.unboundedPreceding, 0)
    v0, t0 = F.last("_v", ignorenulls=True).over(back), F.last("_t", ignorenulls=True).over(back)
    v1, t1 = F.last("_v", ignorenulls=True).over(fwd), F.last("_t", ignorenulls=True).over(fwd)
    u = u.select("*", v0.alias("_v0"), t0.alias("_t0"), v1.alias("_v1"), t1.alias("_t1")).filter("_side = 1")
    inner = F.when(F.col("_t0") == F.col("_t1"), F.col("_v0")).otherwise(F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col(t) - F.col("_t0")) / (F.col("_t1") - F.col("_t0")))
    edge = {"null": F.lit(None).cast("double"), "zero": F.lit(0.0), "clamp": F.coalesce("_v0", "_v1")}[outside]
    got = F.when(F.col("_t0").isNotNull() & F.col("_t1").isNotNull(), inner).otherwise(edge)
    return u.withColumn(value, got).drop("_v", "_t", "_side", "_v0", "_t0", "_v1", "_t1")


def within(rows: DataFrame, intervals: DataFrame, t: str, keys: list[str] = (), slab: int = 3_600_000_000, small: bool = True) -> DataFrame:
    """Rows with each interval (start, stop, both included) that holds them.

    Intervals are cut into time slabs and joined on the slab, so the join is an equi-join of any
    size; cut lines are few, and ``small`` lets Spark broadcast them if their size allows."""
    cut = intervals.withColumn("_slab", F.explode(F.sequence(F.floor(F.col("start") / slab), F.floor(F.col("stop") / slab))))
    r = rows.withColumn("_slab", F.floor(F.col(t) / slab))
    return r.join(cut, [*keys, "_slab"]).filter(F.col(t).between(F.col("start"), F.col("stop"))).drop("_slab")


def within_totals(rows: DataFrame, intervals: DataFrame, t: str, values: list[str], slab: int = 3_600_000_000) -> DataFrame:
    """Each interval (start, stop, both included) that holds any rows with their number n and the sums of
    whole-number ``values``; rows aren't paired with intervals.

    Running totals within time slabs and over the slabs' own totals are looked up at both ends; whole
    numbers, so differences of them are exact."""
    names = ["n", *values]
    ones = rows.filter(F.col(t).isNotNull()).select(F.col(t).cast("long").alias("_t"), F.lit(1).cast("long").alias("n"), *(F.coalesce(F.col(v).cast("long"), F.lit(0)).alias(v) for v in values))
    ones = ones.withColumns({"_slab": slabs("_t", slab), "_side": F.lit(0)})
    lines = intervals.filter("start <= stop").withColumn("_line", F.struct(*intervals.columns))
    ends = lines.select("_line", F.inline(F.array(F.struct(F.col("start").cast("long").alias("_t"), F.lit(-1).alias("_side")), F.struct(F.col("stop").cast("long").alias("_t"), F.lit(1).alias("_side")))))
    w = Window.partitionBy("_slab").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    u = ones.unionByName(ends.withColumn("_slab", slabs("_t", slab)), allowMissingColumns=True)
    u = u.select("_slab", "_line", "_side", *(F.coalesce(F.sum(k).over(w), F.lit(0)).alias(k) for k in names)).filter("_side != 0")
    # slabs are few: their totals are summed up in one task
    before = ones.groupBy("_slab").agg(*(F.sum(k).alias(k) for k in names)).unionByName(u.select("_slab").distinct(), allowMissingColumns=True).groupBy("_slab").agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in names))
    up = Window.partitionBy(F.lit(0)).orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("_slab", *(F.coalesce(F.sum(k).over(up), F.lit(0)).alias(f"_{k}") for k in names))
    total = u.join(before, "_slab").groupBy("_line").agg(*(F.sum(F.col("_side") * (F.col(k) + F.col(f"_{k}"))).alias(k) for k in names))
    return total.filter("n > 0").select("_line.*", *names)


def range_kth(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The k-th smallest (from 0) of values[lo:hi] for many ranges at once: bit by bit of the values' ranks,
    each bit parting them into zeros and ones in order."""
    order = np.argsort(values, kind="stable")
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    at = np.zeros(len(lo), np.int64)
    for bit in reversed(range(max(1, (len(values) - 1).bit_length()))):
        one = (rank >> bit) & 1 == 1
        zeros = np.concatenate([[0], np.cumsum(~one)])
        lo0, hi0 = zeros[lo], zeros[hi]
        up = k >= hi0 - lo0
        at |= up.astype(np.int64) << bit
        k = np.where(up, k - (hi0 - lo0), k)
        lo, hi = np.where(up, zeros[-1] + lo - lo0, lo0), np.where(up, zeros[-1] + hi - hi0, hi0)
        rank = np.concatenate([rank[~one], rank[one]])
    return values[order][at]


def sliding_curve(curves: DataFrame, keys: list[str], t: str, minutes: float, median: bool = True) -> DataFrame:
    """Centred sliding window of W minutes, (t - W/2, t + W/2]: median of levels, or weighted mean
    of linear values by counts.

    A series is cut into slabs as long as the window, with half a window from either neighbour, so every row
    is sent twice; all windows of a slab hold its middle, and sums run from there both ways."""
    half = int(minutes * 60e6 / 2)
    width = 2 * half
    columns = [k for k in curves.columns if k != "sliding_db"]
    part = F.pmod(F.col(t).cast("long"), F.lit(width).cast("long"))
    own = ((F.col(t).cast("long") - part) / width).cast("long")
    v, weight = (F.col("mean_db"), F.lit(1)) if median else (to_linear("mean_db") * F.col("n"), F.col("n"))
    sent = curves.select(*columns, F.col(t).cast("long").alias("_t"), own.alias("_own"), v.cast("double").alias("_v"), weight.cast("double").alias("_w"))
    sent = sent.withColumn("_slab", F.explode(F.array_distinct(F.array(own, own + F.when(part < half, -1).otherwise(1)))))

    def one(p: pa.Table) -> pa.Table:
        p = p.sort_by("_t")
        slab = p["_slab"][0].as_py()
        v, weight = (p[k].fill_null(np.nan).to_numpy() for k in ("_v", "_w"))
        mine = np.ones(len(v), bool) if slab is None else p["_own"].to_numpy() == slab
        if slab is None:  # rows without a time are one another's window
            when, lo, hi, middle = None, np.zeros(len(v), int), np.full(len(v), len(v)), 0
        else:
            when = p["_t"].to_numpy()
            lo, hi = np.searchsorted(when, when[mine] - half + 1), np.searchsorted(when, when[mine] + half, "right")
            middle = int(np.searchsorted(when, slab * width + half))
        there = np.concatenate([[0], np.cumsum(p["_v"].is_valid().to_numpy(zero_copy_only=False))])
        n = there[hi] - there[lo]
        out = np.full(len(lo), np.nan)
        some = n > 0
        if median and some.any():
            held = v[p["_v"].is_valid().to_numpy(zero_copy_only=False)]
            a, b, c = there[lo[some]], there[hi[some]], n[some]
            out[some] = 0.5 * range_kth(held, a, b, (c - 1) // 2) + 0.5 * range_kth(held, a, b, c // 2)
        elif some.any():
            def total(x: np.ndarray) -> np.ndarray:
                x = np.nan_to_num(x)
                left, right = np.append(np.cumsum(x[:middle][::-1])[::-1], 0.0), np.concatenate([[0.0], np.cumsum(x[middle:])])
                return left[lo] + right[hi - middle]

            sums = total(weight)
            with np.errstate(all="ignore"):
                out = np.where(some & (sums != 0), total(v) / sums, np.nan)
        some &= np.isfinite(out)
        return p.filter(pa.array(mine)).select(columns).append_column("sliding_db", pa.array(out, pa.float64(), mask=~some))

    schema = curves.select(*columns).withColumn("sliding_db", F.lit(None).cast("double")).schema
    got = sent.groupBy(*keys, "_slab").applyInArrow(one, schema)
    return got.withColumn("sliding_db", F.when(F.col("n") > 0, F.col("sliding_db") if median else to_db("sliding_db")))


def gaps(rows: DataFrame, keys: list[str], t: str, factor: float = 1.5) -> DataFrame:
    """(keys, start, stop) where the step exceeds factor times the key's median step."""
    w = Window.partitionBy(*keys).orderBy(t)
    d = rows.select(*keys, F.col(t).alias("start"), F.lead(t).over(w).alias("stop")).filter("stop is not null")
    med = d.groupBy(*keys).agg(F.percentile(F.col("stop") - F.col("start"), F.lit(0.5)).alias("_m"))
    return d.join(med, keys).filter(F.col("stop") - F.col("start") > factor * F.col("_m")).drop("_m")


def runs(rows: DataFrame, keys: list[str], t: str, inside: Column) -> DataFrame:
    """Contiguous runs of rows inside as (keys, run, start, stop); runs of no length are dropped."""
    w = Window.partitionBy(*keys).orderBy(t)
    d = rows.withColumn("_in", F.coalesce(inside, F.lit(False)))
    d = d.withColumn("_new", (F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False))).cast("int"))
    d = d.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("_in")
    return d.groupBy(*keys, "run").agg(F.min(t).alias("start"), F.max(t).alias("stop")).filter("stop > start")


def fill_linear(rows: DataFrame, keys: list[str], x: str, value: str, limit: int | None = None) -> DataFrame:
    """Missing values interpolated between present ones; at most ``limit`` steps from either."""
    w = Window.partitionBy(*keys).orderBy(x)
    # running frames both ways: one that ends with the partition is gone through anew for every row
    back, fwd = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys).orderBy(F.col(x).desc()).rowsBetween(Window.unboundedPreceding, 0)
    at = F.when(F.col(value).isNotNull(), F.col(x))
    x0, x1 = F.last(at, ignorenulls=True).over(back), F.last(at, ignorenulls=True).over(fwd)
    v0, v1 = F.last(value, ignorenulls=True).over(back), F.last(value, ignorenulls=True).over(fwd)
    lerp = v0 + (v1 - v0) * (F.col(x) - x0) / F.nullif(x1 - x0, F.lit(0))
    ok = F.lit(True) if limit is None else F.least(F.col(x) - x0, x1 - F.col(x)) <= limit
    return rows.withColumn(value, F.coalesce(F.col(value), F.when(ok, lerp)))


def unwrap(rows: DataFrame, keys: list[str], t: str, angle: str, period: float = 360.0) -> DataFrame:
    """A periodic series made continuous."""
    w = Window.partitionBy(*keys).orderBy(t)
    jump = F.col(angle) - F.lag(angle).over(w)
    turn = -F.rint(jump / period) * period
    return rows.withColumn("_turn", F.coalesce(turn, F.lit(0.0))).withColumn("unwrapped", F.col(angle) + F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_turn")


def wrap(x: Num, period: float = 360.0) -> Column:
    return F.pmod(c(x), F.lit(period))


def rolling_mean(rows: DataFrame, keys: list[str], t: str, value: str, size: int = 30, least: int = 10) -> DataFrame:
    """Centred mean of ``size`` rows (an even window looks one row further back)."""
    w = Window.partitionBy(*keys).orderBy(t).rowsBetween(-(size // 2), (size - 1) // 2)
    return rows.withColumn("rolling", F.when(F.count(value).over(w) >= least, F.avg(value).over(w)))


def savitzky_golay(rows: DataFrame, keys: list[str], t: str, value: str, size: int, order: int) -> DataFrame:
    """Local polynomial smoothing with fixed weights; edges without a whole window stay as they are."""
    import numpy as np

    k = size // 2
    weights = np.linalg.pinv(np.vander(np.arange(-k, k + 1), order + 1, increasing=True))[0]
    w = Window.partitionBy(*keys).orderBy(t)
    parts = [float(weights[i + k]) * (F.lag(value, -i) if i < 0 else F.lead(value, i) if i else F.col(value)) if i == 0 else float(weights[i + k]) * (F.lag(value, -i).over(w) if i < 0 else F.lead(value, i).over(w)) for i in range(-k, k + 1)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return rows.withColumn("smooth", F.coalesce(total, F.col(value)))


def running_median(rows: DataFrame, keys: list[str], t: str, value: str, size: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(t).rowsBetween(-(size // 2), size // 2)
    return rows.withColumn("smooth", F.percentile(value, F.lit(0.5)).over(w))


def turns(rows: DataFrame, keys: list[str], t: str, heading: str, period: int, threshold: float, minimum: int) -> DataFrame:
    """Lines between turns: runs whose rolling heading deviation, to nine digits, stays below the
    threshold for at least ``minimum``."""
    u = unwrap(rows, keys, t, heading)
    w = Window.partitionBy(*keys).orderBy(t).rangeBetween(-period // 2, period // 2)
    u = u.withColumn("_dev", F.coalesce(F.round(F.stddev_samp("unwrapped").over(w), 9), F.lit(0.0)))
    return runs(u, keys, t, F.col("_dev") < threshold).filter(F.col("stop") - F.col("start") >= minimum)


def resample(rows: DataFrame, keys: list[str], t: str, value: str, step: int) -> DataFrame:
    """Values at every multiple of step within each key's span, interpolated."""
    span = rows.groupBy(*keys).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    first = F.ceil(F.col("_lo") / step) * step
    grid = span.filter(first <= F.col("_hi")).select(*keys, F.explode(F.sequence(first, F.col("_hi"), F.lit(step))).alias(t))
    return interpolating(grid, rows, keys, t, value)


def decimate(rows: DataFrame, keys: list[str], t: str, n: int) -> DataFrame:
    """Every n-th row."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(t))
    return rows.withColumn("_rn", rn).filter((F.col("_rn") - 1) % n == 0).drop("_rn")


def step_distance(rows: DataFrame, keys: list[str], t: str, lon: str, lat: str, exact: bool = False) -> DataFrame:
    """Distance from the previous point (0 for the first) and along the track."""
    from ..functions.geo import geodesic, haversine

    w = Window.partitionBy(*keys).orderBy(t)
    f = geodesic if exact else haversine
    d = rows.withColumns({"_y": F.lag(lat).over(w), "_x": F.lag(lon).over(w)})
    d = d.withColumn("step", F.when(F.col("_y").isNull(), 0.0).otherwise(f("_y", "_x", lat, lon))).drop("_x", "_y")
    return d.withColumn("along", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def next_distance(rows: DataFrame, keys: list[str], t: str, lon: str, lat: str) -> DataFrame:
    """Distance to the next ping; the last repeats the one before."""
    from ..functions.geo import haversine

    w = Window.partitionBy(*keys).orderBy(t)
    d = rows.withColumn("_d", haversine(F.col(lat), F.col(lon), F.lead(lat).over(w), F.lead(lon).over(w)))
    return d.withColumn("interping", F.coalesce(F.col("_d"), F.lag("_d").over(w))).drop("_d")


def ends(rows: DataFrame, keys: list[str], t: str, n: int = 10) -> DataFrame:
    """First and last n rows."""
    up, down = (F.row_number().over(Window.partitionBy(*keys).orderBy(o)) for o in (F.col(t).asc(), F.col(t).desc()))
    return rows.withColumns({"_u": up, "_d": down}).filter(f"_u <= {n} or _d <= {n}").drop("_u", "_d")


def first_per(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in a total order."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def swath_mode(mode: Num) -> Column:
    """Swaths per ping by the runtime's mode number."""
    return F.when(c(mode) > 0, 2).when(c(mode) == 0, 1).otherwise(0)


def day_rollover(rows: DataFrame, keys: list[str], order: str, seconds: str) -> DataFrame:
    """Day number of a clock that starts again at midnight."""
    w = Window.partitionBy(*keys).orderBy(order)
    back = (F.col(seconds) < F.lag(seconds).over(w)).cast("int")
    return rows.withColumn("_b", F.coalesce(back, F.lit(0))).withColumn("day", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_b")


def slabs(t: Num, width: int) -> Column:
    """Number of the fixed time slab, a further key that cuts a very long series."""
    return F.floor(c(t) / width)
