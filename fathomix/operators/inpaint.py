"""Filling missing cells by sweeps of a differential equation over tiles.

Three equations, each by simultaneous (Jacobi) sweeps over the missing cells: ``harmonic`` (the mean of the
neighbours), ``amle`` (the middle between the least and the greatest neighbour, an absolutely minimising
Lipschitz extension) and ``tv`` (neighbours weighted by the inverse of the slope, which keeps edges, as
total variation does).  A cell without neighbours waits until the front reaches it.

A sweep lets a cell act on cells at most ``REACH`` away.  A tile with a halo of that many cells a sweep
makes its sweeps alone and its own cells come out exactly as on the whole grid.  As many rounds are made at
once as keep the halo within a quarter of the tile: often all of them, from the known cells alone.  Then tiles
exchange borders, one shuffle and one table written each time.  So tiles and their size don't
change the result, and a task holds one tile and its halo.

Defined cases: null and NaN values are missing; of several rows of a cell the least value counts; cells
outside of the grid are no neighbours and aren't filled; cells that no front has reached after all
rounds have no row, as in an empty grid; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .solvers import with_tiles

REACH = {"harmonic": 1, "amle": 1, "tv": 2}


def _around(p: np.ndarray) -> tuple[np.ndarray, ...]:
    """The four neighbours of an array with a rim of one cell."""
    return p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]


def _slope(u: np.ndarray, near: tuple[np.ndarray, ...], there: tuple[np.ndarray, ...]) -> np.ndarray:
    """Length of the gradient: central differences, one-sided at missing cells, 0 with none on either side."""
    total = np.zeros(u.shape)
    for k in (0, 2):
        d = np.where(there[k + 1], near[k + 1], u) - np.where(there[k], near[k], u)
        d[np.isnan(d)] = 0.0
        d /= np.maximum(there[k].astype(np.int8) + there[k + 1], 1)
        d *= d
        total += d
    return np.sqrt(total)


def sweep(u: np.ndarray, free: np.ndarray, how: str, least: float) -> np.ndarray:
    """One simultaneous sweep over the free cells."""
    if how == "amle":
        a, b, c, d = _around(np.pad(u, 1, constant_values=np.nan))
        new = np.fmax(np.fmax(a, b), np.fmax(c, d))
        new += np.fmin(np.fmin(a, b), np.fmin(c, d))
        new /= 2
        return np.where(free & ~np.isnan(new), new, u)
    here = ~np.isnan(u)
    near, there = _around(np.pad(np.where(here, u, 0.0), 1)), _around(np.pad(here, 1))
    weights = there
    if how == "tv":
        g = 1.0 / np.sqrt(least * least + _slope(u, near, there) ** 2)
        own, share = np.where(here, g / 2, 0.0), np.where(here, 0.5, 1.0)
        weights = tuple((v * share + own) * h for v, h in zip(_around(np.pad(g, 1)), there))
    total, new = np.zeros(u.shape), np.zeros(u.shape)
    for v, w in zip(near, weights):
        total += w
        new += v * w
    some = total > 0
    new /= np.where(some, total, 1.0)
    return np.where(free & some, new, u)


def inpaint(grid: DataFrame, layer: str, rows: int, cols: int, cut: Callable[[DataFrame], DataFrame], how: str = "amle", rounds: int = 4, sweeps: int = 8, tile: int = 256, least: float = 1e-3) -> DataFrame:
    """(row, col, value, change) of the missing cells of a grid of rows x cols after rounds x sweeps sweeps;
    change is how much the last sweep moved the cell; ``cut`` writes the table between two exchanges.  ``least`` is the slope below which tv sees none."""
    together = max(1, tile // 4 // (REACH[how] * sweeps))  # rounds whose halo is small beside the tile need no exchange

    def swept(state: DataFrame, n: int, last: bool) -> DataFrame:
        halo = REACH[how] * n
        side = tile + 2 * halo

        def one(key: tuple, t: pa.Table) -> pa.Table:
            top, left = (k.as_py() * tile - halo for k in key)
            value = t["value"].to_numpy()
            order = np.argsort(-value, kind="stable")  # of several rows of a cell the least comes last and stays
            u, free = np.full((side, side), np.nan), np.ones((side, side), bool)
            r, c = t["row"].to_numpy()[order] - top, t["col"].to_numpy()[order] - left
            u[r, c], free[r, c] = value[order], t["free"].to_numpy()[order]
            inside = ((np.arange(side) + top >= 0) & (np.arange(side) + top < rows))[:, None] & ((np.arange(side) + left >= 0) & (np.arange(side) + left < cols))
            before = u
            for _ in range(n):
                before, u = u, sweep(u, free & inside, how, least)
            own = np.zeros(u.shape, bool)
            own[halo : halo + tile, halo : halo + tile] = True
            at = np.nonzero(own & np.isfinite(u) & free if last else own & np.isfinite(u))
            moved = np.where(free[at], np.abs(u[at] - np.nan_to_num(before[at])), 0.0)
            return pa.table({"row": pa.array(at[0] + top, pa.int64()), "col": pa.array(at[1] + left, pa.int64()), "value": u[at], "free": free[at], "change": moved})

        tiles = with_tiles(state.select("row", "col", "value", "free"), tile, halo).drop("_own")
        return tiles.groupBy("_tr", "_tc").applyInArrow(one, "row long, col long, value double, free boolean, change double")

    state = grid.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col(layer).cast("double").alias("value"))
    state = state.filter(F.col("value").isNotNull() & ~F.isnan("value") & F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1))
    state = state.withColumn("free", F.lit(False)).withColumn("change", F.lit(0.0))
    for k in range(0, rounds, together):
        last = k + together >= rounds
        state = swept(state, sweeps * min(together, rounds - k), last)
        state = state if last else cut(state)
    return state.filter("free").select("row", "col", "value", "change")
