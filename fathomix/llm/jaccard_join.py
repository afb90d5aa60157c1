"""Exact n-gram Jaccard join in the metric space of shingle sets.

Jaccard distance is a metric, and any set is a point of it.  Regions are made by pivots, and
triangle-inequality windows replicate the documents near a border, so a pair within e = 1 -
num/den of each other meets in some region.  Pivots of two kinds are used, one after the other:

1. One-shingle sets {s}, at the first level.  d(x, {s}) is 1 - 1/|x| if x holds s, else 1: the
   nearest pivots of x are its own shingles, ranked by one fixed order, rare ones first.  If
   d(x, y) <= e, at most e|x| of x lie outside y, so x and y share one of the first e|x| + 1 of x
   and of the first e|y| + 1 of y; two that meet at positions i and j can link only if i + j
   stays within the largest symmetric difference.  This is what set joins call prefix
   filtering.  Documents as pivots can't do it: nearly every document is at distance 1 from nearly
   every other, so each would be replicated to every region (README has the figures).
2. Documents, in every region of more than ``leaf`` members.  A few members become pivots.  Their
   distance to a member is computed exactly, from whole sets, unless a parity bitmap (which bounds
   the symmetric difference from below) shows it to be above 2e, which is all that needs to be
   known then.  A member within e of a pivot is linked to it and at home in the Voronoi region of
   its nearest pivot.  If d(x, y) <= e and y is at home with q, d(x, q) <= 2e: so each member
   visits the regions of all pivots within 2e, and those are the only replicas.  Members that are
   within e of no pivot stay together and are worked on again with pivots of their own.

In a region of up to ``leaf`` members the first one is compared with all others before these are
compared with one another: near copies meet in very many small regions, and most are closed by then.
Regions whose members are one component are closed.  Voronoi regions are leaves, compared at once.
Another region ends as a leaf when it is small or when its pivots have no other member near.  A leaf of more than ``split``
members is divided by the members' next shared shingle first: two that link and share the
region's shingle share another one within windows longer by one.  In a leaf, members at home are
compared with all others of other components, if positions, sizes, distances to the pivot (they
differ by at most e) and parity bitmaps allow a link.  The last word always has the comparison of
whole sets of 64-bit hashes.

The order of shingles only serves speed.  It comes from counts over all documents of the shingles
that repeat within a block; the commonest of them go last, so a passage that many documents share
isn't where they meet.

Equal sets are one class from the start and are never expanded into pairs.

Defined cases: a null or empty text has n_shingles 0 and links with nothing; a row with a null
doc_id keeps n_shingles and has component_id null; rows repeating a doc_id are one document as
to links; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, discard, hint_if_small, released
from .common import materialise_once as materialise
from .components import components
from .shingles import packed_set, parity_bitmap, read_set, set_digest, shingle_set

SKETCH = "doc_id long, n long, digest binary, path array<long>, bits array<long>"
_BLOCK = 1 << 20  # shingles counted together
_SPLITS = 2  # further shared shingles that may divide a region
_SENT = 1 << 21  # bytes of sets sent on together
_SLACK = 1e-9  # of distances as floating-point numbers


class JaccardJoin:
    """Documents whose ``size``-word shingle sets have den * |x & y| >= num * |x | y|.

    ``leaf`` is the members of a region compared directly, ``pivots`` the pivot documents of a
    larger one in each of at most ``rounds`` recursions; leaves of more than ``split`` members are
    divided by further shingles, and compared in blocks of about ``block`` members.  ``common``
    shingles are ordered by count; ``small_rows`` bounds what is broadcast.  None of them changes a result.
    """

    def __init__(self, size: int = 5, num: int = 80, den: int = 100, leaf: int = 16, pivots: int = 2, rounds: int = 3, split: int = 1024, common: int = 1_000_000, small_rows: int = 2_000_000, block: int = 512):
        self.size, self.num, self.den = size, num, den
        self.leaf, self.pivots, self.rounds, self.split = leaf, pivots, rounds, split
        self.common, self.small_rows, self.block = common, small_rows, block

    def common_shingles(self, docs: DataFrame) -> np.ndarray:
        """The commonest shingles, the commonest last; at most ``common`` of them.

        Each task counts the shingles of all its documents and passes on those that at least
        three documents of a block, and one in 2000, hold.
        """
        size = self.size

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n, docs_ = [], 0, 0

            def flush() -> pa.RecordBatch:
                h, k = np.unique(np.concatenate(held), return_counts=True)
                ok = k >= max(3, docs_ / 2000)
                return pa.RecordBatch.from_arrays([pa.array(h[ok].view(np.int64)), pa.array(k[ok].astype(np.int64))], names=["h", "k"])

            for b in released(batches):
                for text in b.column(0):
                    held.append(shingle_set(text.as_py(), size))
                    n, docs_ = n + len(held[-1]), docs_ + 1
                    if n >= _BLOCK:
                        yield flush()
                        held, n, docs_ = [], 0, 0
            if held:
                yield flush()

        rows = docs.select("text").mapInArrow(count, "h long, k long").groupBy("h").agg(F.sum("k").alias("k"))
        top = rows.orderBy(F.desc("k"), "h").limit(self.common).select("h").toPandas()
        return top["h"].to_numpy(dtype=np.int64)[::-1].view(np.uint64)

    def sketches(self, docs: DataFrame) -> DataFrame:
        """One narrow pass over the texts, written: set size, set digest, window (and what further
        splits need), parity bitmap."""
        size, over, den = self.size, self.den - self.num, self.den
        last = self.common_shingles(docs)
        by_hash = np.argsort(last)
        shared = docs.sparkSession.sparkContext.broadcast((last[by_hash], by_hash))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            known, rank = shared.value
            for b in released(batches):
                cols: tuple[list, ...] = ([], [], [], [])
                for text in b.column(1):
                    s = shingle_set(text.as_py(), size)
                    window = len(s) * over // den + 1 + _SPLITS
                    path = s[:window]
                    if len(known):
                        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        common = known[at] == s
                        path = s[~common][:window]
                        if len(path) < window:
                            path = np.concatenate([path, s[common][np.argsort(rank[at[common]])][: window - len(path)]])
                    for c, v in zip(cols, (len(s), set_digest(s), path.view(np.int64), parity_bitmap(s) if len(s) else [])):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["doc_id", "n", "digest", "path", "bits"])

        out = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, SKETCH), "sketches")
        shared.destroy()
        return out

    def _window(self, more: int = 0) -> Column:
        """Length of the window of a set of n."""
        return F.expr(f"n * {self.den - self.num} div {self.den}") + 1 + more

    @property
    def _wide(self) -> int:
        """What num is for pairs at most 2e apart."""
        return max(0, 2 * self.num - self.den)

    def _sizes(self, num: int) -> Column:
        """Whether sizes na and nb allow num / den."""
        return (F.col("na") * self.den >= F.col("nb") * num) & (F.col("nb") * self.den >= F.col("na") * num)

    def _places(self) -> Column:
        """Whether sizes, and positions pa and pb, allow a link of rows a and b."""
        return self._sizes(self.num) & ((F.col("pa") + F.col("pb")) * (self.den + self.num) <= (F.col("na") + F.col("nb")) * (self.den - self.num))

    @staticmethod
    def _folded(bits: Column, words: Column) -> Column:
        """A bitmap folded to ``words`` words, if it has twice as many."""
        half = F.zip_with(F.slice(bits, 1, words), F.slice(bits, words + 1, words), lambda u, v: u.bitwiseXOR(v))
        return F.when(F.size(bits) == 2 * words, half).otherwise(bits)

    def _bits(self, num: int) -> Column:
        """Whether the bitmaps bitsa and bitsb of sets of na and nb allow num / den; sizes do."""
        words = F.least(F.size("bitsa"), F.size("bitsb"))
        apart = F.zip_with(self._folded(F.col("bitsa"), words), self._folded(F.col("bitsb"), words), lambda u, v: F.bit_count(u.bitwiseXOR(v)).cast("long"))
        apart = F.aggregate(apart, F.lit(0).cast("long"), lambda s, v: s + F.coalesce(v, F.lit(0).cast("long")))
        return apart * (self.den + num) <= (F.col("na") + F.col("nb")) * (self.den - num)

    def _sets(self, ids: DataFrame, docs: DataFrame) -> DataFrame:
        """(id, members) of the documents in ids (doc_id), written."""
        size = self.size

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in released(batches):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([packed_set(shingle_set(t.as_py(), size)) for t in b.column(1)], pa.binary())], names=["id", "members"])

        whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(hint_if_small(ids, self.small_rows), "doc_id", "left_semi")
        return materialise(whole.mapInArrow(sets, "id long, members binary"), "sets")

    def _distances(self, pairs: DataFrame, docs: DataFrame) -> DataFrame:
        """pairs (a, b), a table of ``_near`` that isn't read again, with the exact distance d of their
        whole sets and whether they link, written.

        Few pivots are the b of many pairs, so a's set travels with the pair: it is made where the
        text is read, and shuffled once.
        """
        num, den, size = self.num, self.den, self.size
        sets = self._sets(pairs.select(F.col("b").alias("doc_id")).distinct(), docs)

        def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kinds = {"a": pa.int64(), "b": pa.int64(), "ma": pa.binary()}
            for batch in released(batches):
                rows, held = [], 0
                for a, text, others in zip(batch.column(0), batch.column(1), batch.column(2)):
                    raw = packed_set(shingle_set(text.as_py(), size))
                    for b in others.values.to_pylist():
                        rows.append((a.as_py(), b, raw))
                        held += len(raw)
                        if held >= _SENT:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], names=list(kinds))
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], names=list(kinds))

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in released(batches):
                d, linked, held = [], [], (None, None)
                for x, y in zip(batch.column(2), batch.column(3)):
                    if held[0] != (raw := y.as_py()):  # rows come sorted by b
                        held = (raw, read_set(raw))
                    u, v = read_set(x.as_py()), held[1]
                    common = len(np.intersect1d(u, v, assume_unique=True))
                    union = len(u) + len(v) - common
                    d.append(1 - common / union if union else 1.0)
                    linked.append(common > 0 and den * common >= num * union)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d, pa.float64()), pa.array(linked, pa.bool_())], names=["a", "b", "d", "linked"])

        others = hint_if_small(pairs.groupBy("a").agg(F.collect_list("b").alias("others")), self.small_rows)
        whole = docs.select(F.col("doc_id").cast("long").alias("a"), "text").join(others, "a").select("a", "text", "others")
        with_b = whole.mapInArrow(firsts, "a long, b long, ma binary").join(sets.select(F.col("id").alias("b"), F.col("members").alias("mb")), "b")
        out = materialise(with_b.select("a", "b", "ma", "mb").mapInArrow(measure, "a long, b long, d double, linked boolean"), "distances")
        discard(sets)
        discard(pairs)
        return out

    @staticmethod
    def _labels(found: list[DataFrame]) -> DataFrame:
        return components(reduce(DataFrame.unionByName, found)).withColumnRenamed("id", "_id").withColumnRenamed("comp", "_c")

    @staticmethod
    def _open(rows: DataFrame, labels: DataFrame) -> DataFrame:
        """Rows of the regions that hold more than one component and a member at home, with comp,
        the region's largest component ``most``, its members k and those at home."""
        rows = rows.join(labels, rows["id"] == labels["_id"], "left").select(*rows.columns, F.coalesce("_c", "id").alias("comp"))
        per = rows.groupBy("key", "comp").agg(F.count("*").alias("_k"), F.count_if("home").alias("_h"))
        top = per.groupBy("key").agg(F.count("*").alias("_kinds"), F.max_by("comp", F.struct("_k", "comp")).alias("most"), F.sum("_k").alias("k"), F.sum("_h").alias("homes"))
        return rows.join(top.filter("_kinds > 1 and homes > 0").drop("_kinds"), "key")

    def _pairs(self, rows: DataFrame, bits: DataFrame | None = None) -> DataFrame:
        """Pairs (a, b) of different components of one region, one of them at home, that positions,
        sizes and distances to the last pivot allow, and bitmaps (id, n, bits) if given; the least
        positions of each pair.  A large region is compared block by block, by as many tasks."""
        more = ["bits"] if bits is not None else []
        if more:
            rows = rows.join(bits.select("id", "n", "bits"), ["id", "n"])
        rows = rows.withColumn("_g", F.ceil(F.col("k") / self.block).cast("int"))
        own, each = F.pmod(F.xxhash64("id"), F.col("_g")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("_g") - 1))
        blocks = rows.select("*", own.alias("_own"), each.alias("_each"))

        def side(df: DataFrame, k: str, i: str, j: str, *keep: str) -> DataFrame:
            short = [("id", ""), ("pos", "p"), ("n", "n"), ("comp", "c"), ("home", "h"), ("d", "d"), *((m, m) for m in more)]
            return df.select("key", F.col(i).alias("_i"), F.col(j).alias("_j"), *keep, *(F.col(c).alias(f"{c_}{k}") for c, c_ in short))

        once = (F.col("a") < F.col("b")) | (F.col("cb") == F.col("most"))
        ok = (F.col("ca") != F.col("cb")) & once & (F.col("ha") | F.col("hb")) & F.coalesce(F.abs(F.col("da") - F.col("db")) <= 1 - self.num / self.den + _SLACK, F.lit(True))
        ok &= self._places()
        if more:
            ok &= self._bits(self.num)
        pairs = side(blocks.filter("comp != most"), "a", "_own", "_each").join(side(blocks, "b", "_each", "_own", "most"), ["key", "_i", "_j"]).filter(ok)
        return pairs.groupBy("a", "b").agg(*(F.min(k).alias(k) for k in ("pa", "pb", "na", "nb")))

    @staticmethod
    def _stars(regions: DataFrame) -> DataFrame:
        """Pairs of each small region's first member a, all its rows, with the others."""
        side = regions.select("a", F.explode(F.filter("members", lambda m: m["id"] == F.col("a"))).alias("x"), F.filter("members", lambda m: m["id"] != F.col("a")).alias("others"))
        pairs = side.select("a", "x", F.explode("others").alias("y"))
        return pairs.select("a", F.col("y.id").alias("b"), F.col("x.pos").alias("pa"), F.col("y.pos").alias("pb"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"))

    def _near(self, pairs: DataFrame, bits: DataFrame, num: int) -> DataFrame:
        """Of pairs (a, b) those whose sizes and bitmaps (id, n, bits) allow num / den, written."""
        pairs = pairs.select("a", "b")  # the ids alone travel; the rest comes with the bitmaps
        for k in ("a", "b"):
            pairs = pairs.join(bits.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"bits{k}")), k)
        return materialise(pairs.filter(self._bits(num)).select("a", "b").distinct(), "near-pairs")

    def _pivot_documents(self, rows: DataFrame) -> DataFrame:
        """(key, b, nb): up to ``pivots`` members of each region, of different components; of
        equals the smallest ids, so that the regions of a group of copies choose the same ones."""
        bucket = F.pmod(F.xxhash64("comp"), F.lit(self.pivots))
        return rows.groupBy("key", bucket.alias("_b")).agg(F.min(F.struct("id", "n")).alias("_p")).select("key", F.col("_p.id").alias("b"), F.col("_p.n").alias("nb"))

    def voronoi(self, rows: DataFrame, distances: DataFrame, pivots: DataFrame, several: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(cells, far) of rows (key, id, home, d, ...): the Voronoi regions, whose members are at
        home with their nearest pivot within e or visitors from within 2e, and the regions' other
        members.  A doc_id of ``several`` texts has no one place: it visits and stays far."""
        names = rows.columns
        close = distances.filter(F.col("d") <= 2 * (1 - self.num / self.den) + _SLACK).select(F.col("a").alias("id"), "b", F.col("d").alias("_d"), "linked")
        close = close.join(hint_if_small(several, self.small_rows), "id", "left").withColumn("linked", F.col("linked") & F.col("_several").isNull())
        at = materialise(rows.join(pivots, "key").join(close, ["id", "b"]), "visits")
        home = at.filter("linked").groupBy("key", "id").agg(F.min(F.struct("_d", "b")).alias("_near")).select("key", "id", F.col("_near.b").alias("_home"))
        own = at.join(home, ["key", "id"], "left").withColumns({
            "home": F.col("home") & F.coalesce(F.col("_home") == F.col("b"), F.lit(False)),
            "d": F.when(F.col("_several").isNull(), F.col("_d")),
        })
        # regions of one group of copies have the same pivots: a pivot's cells are one, compared once
        cells = own.groupBy("b", "id", "n", "d").agg(F.max("home").alias("home"))
        cells = cells.withColumns({"key": F.col("b"), "pos": F.lit(0), "last": F.lit(0)})
        return cells.select(*names), rows.join(home, ["key", "id"], "left_anti")

    def _split(self, rows: DataFrame, reps: DataFrame, depth: int) -> DataFrame:
        """Regions divided by the members' next shingle after the last one that divides them."""
        own = reps.select(F.col("doc_id").alias("id"), F.col("n").alias("_n"), "path")
        at = rows.join(own, "id").select(*rows.columns, F.posexplode("path").alias("_p", "_s"))
        deeper = at.filter((F.col("_p") > F.col("last")) & (F.col("_p") < self._window(depth)))
        deeper = deeper.withColumns({"key": F.xxhash64("key", "_s"), "last": F.col("_p")}).drop("_p", "_s")
        # two of the smallest sets may share one shingle only: those meet again without another
        single = rows.filter(F.col("n") * self.num < F.lit((1 + depth) * self.den)).withColumn("key", F.xxhash64("key", F.lit(0)))
        return deeper.unionByName(single)

    def _regions(self, reps: DataFrame) -> DataFrame:
        """(key, id, pos, n, k): members of the regions of one-shingle sets that have k > 1 of them.

        Counted over a window: a join with counts would shuffle every row twice."""
        every = reps.select(F.col("doc_id").alias("id"), "n", F.posexplode("path").alias("pos", "key")).filter(F.col("pos") < self._window())
        return every.select("key", "id", "pos", "n", F.count("*").over(Window.partitionBy("key")).alias("k")).filter("k > 1")

    def links(self, docs: DataFrame, reps: DataFrame, several: DataFrame) -> DataFrame:
        """Links (a, b) between class representatives that connect every pair that links."""
        rows = materialise(self._regions(reps), "regions")
        # a region of two is a pair already
        row = F.struct("id", "pos", "n")
        per = rows.filter("k = 2").groupBy("key").agg(F.min(row).alias("lo"), F.max(row).alias("hi")).filter("lo.id != hi.id")
        two = per.select(*(F.col(f"{s}.{c}").alias(f"{c_}{t}") for s, t in (("lo", "a"), ("hi", "b")) for c, c_ in (("id", ""), ("pos", "p"), ("n", "n"))))
        few = rows.filter((F.col("k") > 2) & (F.col("k") <= self.leaf)).groupBy("key").agg(F.min("id").alias("a"), F.collect_list(row).alias("members"))
        few = materialise(few, "small-regions")
        pairs = two.filter(self._places()).unionByName(self._stars(few).filter(self._places()))
        pairs = materialise(pairs.groupBy("a", "b").agg(*(F.min(k).alias(k) for k in ("pa", "pb", "na", "nb"))), "pairs")
        large = materialise(rows.filter(F.col("k") > self.leaf).select("key", "id", "pos", "n", F.lit(True).alias("home"), F.lit(0.0).alias("d"), F.col("pos").alias("last")), "large-regions")
        names = large.columns

        def bitmaps(ids: DataFrame, bits: Column) -> DataFrame:
            own = reps.select("doc_id", "n", bits.alias("bits")).join(hint_if_small(ids.distinct(), self.small_rows), "doc_id", "left_semi")
            return materialise(own.withColumnRenamed("doc_id", "id"), "bitmaps")

        # half as wide where only links matter
        half = F.when(F.size("bits") > 1, self._folded(F.col("bits"), F.floor(F.size("bits") / 2).cast("int"))).otherwise(F.col("bits"))
        found, labels = [], None
        for again in (False, True):
            if again:  # the first members have met all others of their regions and leave
                rest = few.select("key", "a", F.inline("members")).filter("id != a").select("key", "id", "pos", "n", F.lit(True).alias("home"), F.lit(0.0).alias("d"))
                pairs = materialise(self._pairs(materialise(self._open(rest, labels), "open-small-regions")), "pairs")
            bits = bitmaps(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")), half)
            found.append(self._distances(self._near(pairs, bits, self.num), docs).filter("linked").select("a", "b"))
            labels = self._labels(found)
            discard(bits)
            discard(pairs)
        discard(few)
        discard(rows)

        bits = bitmaps(large.select(F.col("id").alias("doc_id")), F.col("bits"))
        leaves, todo = [], large
        for _ in range(self.rounds):
            here = materialise(self._open(todo, labels), "open-regions")
            small = F.col("homes") * F.col("k") <= self.leaf**2
            leaves.append(here.filter(small).select(*names))
            here = here.filter(~small)
            if here.isEmpty():
                todo = None
                break
            pivots = materialise(self._pivot_documents(here), "pivots")
            ask = here.select("key", F.col("id").alias("a"), F.col("n").alias("na")).join(pivots, "key").filter((F.col("a") != F.col("b")) & self._sizes(self._wide))
            distances = self._distances(self._near(ask.select("a", "b").distinct(), bits, self._wide), docs)
            found.append(distances.filter("linked").select("a", "b"))
            labels = self._labels(found)
            # pivots have met all members of their regions and leave
            rest = here.join(pivots.select("key", F.col("b").alias("id")), ["key", "id"], "left_anti").select(*names)
            cells, far = self.voronoi(rest, distances, pivots, several)
            cells = materialise(self._open(cells, labels), "cells")
            if not cells.isEmpty():  # at once: what links there closes regions of the others
                # members have no positions there: bitmaps decide as the pairs are made
                near = materialise(self._pairs(cells, bits).select("a", "b"), "near-pairs")
                found.append(self._distances(near, docs).filter("linked").select("a", "b"))
                labels = self._labels(found)
            # where pivots had no member near, others would hardly have any
            alone = pivots.select("key").distinct().join(rest.join(pivots, "key").join(distances.filter("linked").select(F.col("a").alias("id"), "b"), ["id", "b"]).select("key").distinct(), "key", "left_anti")
            far = materialise(far.join(alone.withColumn("_alone", F.lit(True)), "key", "left"), "far")
            discard(cells)
            leaves.append(far.filter("_alone").select(*names))
            todo = far.filter("_alone is null").select(*names)
        if todo is not None:
            leaves.append(todo)
        left = materialise(self._open(reduce(DataFrame.unionByName, leaves), labels), "leaves")
        for depth in range(1, _SPLITS + 1):
            over = left.filter(F.col("k") > self.split).select(*names)
            if over.isEmpty():
                break
            deeper = self._open(self._split(over, reps, depth), labels)
            left = materialise(left.filter(F.col("k") <= self.split).unionByName(deeper), "leaves")
        near = self._near(self._pairs(left), bits, self.num)
        found.append(self._distances(near, docs).filter("linked").select("a", "b"))
        return reduce(DataFrame.unionByName, found)

    def join(self, docs: DataFrame) -> DataFrame:
        """Every row of docs (doc_id, text) as doc_id, n_shingles, component_id."""
        bound_batches(docs.sparkSession)
        sketch = self.sketches(docs)
        classes = sketch.filter("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"))
        own = sketch.select("doc_id", "n", "digest").join(classes, "digest", "left")
        own = materialise(own.select("doc_id", "n", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("rep")), "classes")
        copies = own.filter("n > 0 and rep != doc_id").select("doc_id").join(own.filter("rep = doc_id").select("doc_id"), "doc_id", "left_anti").distinct()
        reps = sketch.filter("n > 0 and doc_id is not null").drop("digest").join(hint_if_small(copies, self.small_rows), "doc_id", "left_anti")
        # a doc_id may have rows of several texts: it ties their classes together
        several = reps.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("id"), F.lit(True).alias("_several"))
        links = self.links(docs, reps, materialise(several, "several-texts"))
        some = own.filter("doc_id is not null and n > 0")
        multi = some.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo != hi").select("doc_id")
        repeated = some.join(multi, "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        labels = components(links.unionByName(repeated))
        out = own.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "rep")).alias("component_id"))
