"""Best-fit packing of documents into sequences, improved by swap-based local search.

Documents are encoded and measured where they are read; from then on only lengths move.  Pieces
are dealt into groups of bounded size, each packed in one task: best-fit decreasing first, then
local search that empties the emptiest bins by moving documents, exchanging one for one, or two
for one, whenever that increases the sum of squared fills, to a local optimum.  Pieces of bins
with room left are dealt anew and packed again in further rounds, so the number of underfull bins
doesn't grow with the number of groups.

Defined cases: a null text is empty and still has its end id; a null doc_id is kept as null;
repeated rows are documents of their own; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialise
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): each document's ids with end_id, cut after
    every ``capacity`` ids.  Narrow: no shuffle, texts stay where they are."""

    bound_batches(docs.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                data = code.encode(text.as_py()) + end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    for c, v in zip(cols, (doc, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(measure, PIECES)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of item numbers."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set while some bin has room r
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        n = sizes[i]
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        by_room[room - n].append(b)
        rooms |= 1 << (room - n)
    return bins


def local_search(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Empty the emptiest bins into the others' room, to a local optimum.

    From the emptiest bin up, each bin gives to fuller ones by moving an item, exchanging one for
    one, two for one or one for two, always the exchange that shifts most of all open bins.  Each
    moves ids from an emptier bin to a fuller one, so the sum of squared fills grows and the search
    ends: when a whole pass finds no exchange, or when the bins are as few as their total allows.
    Every state is a valid packing.
    """
    bins = [b for b in bins if b]
    size = np.array(sizes, np.int64)
    fill = np.array([size[b].sum() for b in bins], np.int64)
    alive, least = len(bins), -(-int(fill.sum()) // capacity)
    if alive <= least:
        return bins
    owner = np.zeros(len(size), np.int64)
    for k, b in enumerate(bins):
        owner[b] = k
    moved = True
    while moved and alive > least:
        moved = False
        open_ = np.flatnonzero((fill < capacity) & (fill > 0))
        open_ = open_[np.argsort(fill[open_], kind="stable")]
        items = np.concatenate([np.array(bins[k], np.int64) for k in open_])
        pairs = [np.triu_indices(len(bins[k]), 1) for k in open_]
        one = np.concatenate([np.array(bins[k], np.int64)[p[0]] for k, p in zip(open_, pairs)])
        two = np.concatenate([np.array(bins[k], np.int64)[p[1]] for k, p in zip(open_, pairs)])
        # by size, so that an exchange looks only at what is a little smaller than what it gives
        takes = []
        for kind, sums in ((1, size[items]), (2, size[one] + size[two])):
            order = np.argsort(sums, kind="stable")
            takes.append((kind, order, sums[order]))
        for k in open_.tolist():
            if alive <= least:
                break
            while bins[k]:
                # what other open bins, at least as full, can take: nothing, one item or two
                room = np.where((fill >= fill[k]) & (fill > 0), capacity - fill, 0)
                room[k] = 0
                low = room[open_]
                most = int(low.max(initial=0))
                if not most:
                    break
                gives = [*combinations(bins[k], 1), *combinations(bins[k], 2)]
                best, gain = None, 0
                for give in gives:
                    if gain == most:
                        break
                    out = sum(sizes[i] for i in give)
                    if gain < out <= most:
                        fits = np.flatnonzero(low >= out)
                        best, gain = (give, (), int(open_[fits[low[fits].argmin()]])), out
                    for kind, order, sums in takes[: 3 - len(give)]:
                        lo, hi = sums.searchsorted((out - most, out - gain))
                        if lo >= hi:
                            continue
                        at, shift = order[lo:hi], out - sums[lo:hi]
                        if kind == 1:
                            fits = shift <= room[owner[items[at]]]
                        else:
                            first = owner[one[at]]
                            fits = (shift <= room[first]) & (first == owner[two[at]])
                        if fits.any():
                            shift, at = shift[fits], at[fits]
                            gain = int(shift.max())
                            at = int(at[shift == gain].min())  # of equals the first
                            take = (int(items[at]),) if kind == 1 else (int(one[at]), int(two[at]))
                            best = (give, take, int(owner[take[0]]))
                if best is None:
                    break
                give, take, o = best
                bins[k] = [i for i in bins[k] if i not in give] + list(take)
                bins[o] = [i for i in bins[o] if i not in take] + list(give)
                owner[list(give)] = o
                owner[list(take)] = k
                fill[k] -= gain
                fill[o] += gain
                moved = True
            alive -= not bins[k]
    return [b for b in bins if b]


def pack_sizes(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit, then local search."""
    return local_search(best_fit(sizes, capacity), sizes, capacity)


def _packer(names: list[str], capacity: int, base: int) -> Callable[[pa.Table], pa.Table]:
    """What packs one group: its rows with sequence_id, offset, and whether the bin has room."""

    def one(t: pa.Table) -> pa.Table:
        sizes = t["length"].to_pylist()
        seq, off, open_ = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), bool)
        first = base + (t["_group"][0].as_py() << 32)
        for k, items in enumerate(pack_sizes(sizes, capacity)):
            at = 0
            for i in items:
                seq[i], off[i] = first + k, at
                at += sizes[i]
            open_[items] = at < capacity
        out = t.select(names)
        for name, v in (("sequence_id", seq), ("offset", off), ("_open", open_)):
            out = out.append_column(name, pa.array(v))
        return out

    return one


def pack(pieces: DataFrame, capacity: int, group_rows: int = 8192, least_gain: float = 0.001) -> DataFrame:
    """Give each row of pieces (any columns with a ``length`` up to capacity) a sequence_id and
    an offset.

    ``group_rows`` bounds what one task packs.  Pieces of bins with room left are dealt into new
    groups and packed again, until they were one group or a round saved less than ``least_gain`` of
    their sequences; a round that saves none isn't kept.
    """
    spark = pieces.sparkSession
    names = pieces.columns
    schema = pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("_open")).schema
    done, todo, placed, bins, round_ = [], materialise(pieces, "pieces"), None, None, 0
    while n := todo.count():
        groups = max(1, -(-n // group_rows))
        group = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(round_)), F.lit(groups))
        fresh = todo.select(*names).withColumn("_group", group).groupBy("_group").applyInArrow(_packer(names, capacity, round_ << 56), schema)
        fresh = materialise(fresh, "packed")
        now = fresh.select("sequence_id").distinct().count()
        if placed is not None and now >= bins:
            done.append(placed.filter("_open").drop("_open"))
            break
        saved, placed = None if bins is None else (bins - now) / bins, fresh
        if groups == 1 or (saved is not None and saved < least_gain):
            done.append(placed.drop("_open"))
            break
        done.append(placed.filter(~F.col("_open")).drop("_open"))
        todo, round_ = placed.filter("_open"), round_ + 1
        bins = todo.select("sequence_id").distinct().count()
    if not done:
        return spark.createDataFrame([], schema).drop("_open")
    return reduce(DataFrame.unionByName, done)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, **options) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    return pack(token_pieces(docs, tokenizer, capacity, end_id), capacity, **options)
