"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the k smallest distinct 64-bit hashes of a text's word shingles, and whether that
is all of them.  Sketches of parts merge into the sketch of the whole; two sketches estimate
resemblance, containment and, each, the number of distinct shingles.  While a text has at most k
distinct shingles all figures are exact.

Defined cases: a null or empty text has an empty sketch; two empty sketches are alike (1.0), an
empty and another one aren't (0.0); a text shorter than a shingle is one shingle; null doc_ids
sort last in descending order; rows repeating a doc_id follow one another by text; in an empty
table there is no next document and no row; further columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, partitions, range_edges
from .shingles import shingle_hashes


class Sketch:
    """Bottom-k sketch: ascending distinct hashes, at most k of them; ``whole`` if none is left out."""

    __slots__ = ("k", "hashes", "whole")

    def __init__(self, hashes: np.ndarray, k: int = 128, whole: bool | None = None):
        self.k, self.hashes = k, hashes
        self.whole = len(hashes) < k if whole is None else whole

    @classmethod
    def of(cls, text: str | None, size: int = 5, k: int = 128) -> Sketch:
        h = shingle_hashes(text, size)
        if len(h) > 8 * k:  # distinct ones among the smallest decide; widen if repeats use them up
            low = np.unique(np.partition(h, 4 * k)[: 4 * k])
            if len(low) > k:
                return cls(low[:k], k, False)
        h = np.unique(h)
        return cls(h[:k], k, len(h) <= k)

    def merge(self, other: Sketch) -> Sketch:
        """Sketch of both parts together."""
        if self.k != other.k:
            raise ValueError("sketches of different k")
        h = np.union1d(self.hashes, other.hashes)
        return Sketch(h[: self.k], self.k, self.whole and other.whole and len(h) <= self.k)

    def distinct(self) -> float:
        """Distinct shingles."""
        if self.whole or not len(self.hashes):
            return float(len(self.hashes))
        return (len(self.hashes) - 1) / (float(self.hashes[-1]) / 2.0**64)

    def _sample(self, other: Sketch) -> tuple[int, int, int, int]:
        """Sizes, in the part of hash space both sketches cover, of union, intersection and each."""
        tops = [s.hashes[-1] for s in (self, other) if not s.whole]
        a, b = self.hashes, other.hashes
        if tops:
            a, b = a[a <= min(tops)], b[b <= min(tops)]
        both = len(np.intersect1d(a, b, assume_unique=True))
        return len(a) + len(b) - both, both, len(a), len(b)

    def resemblance(self, other: Sketch) -> float:
        """|x & y| / |x | y|."""
        union, both, _, _ = self._sample(other)
        return both / union if union else 1.0

    def containment(self, other: Sketch) -> float:
        """|x & y| / |x|: the share of this text's shingles that the other has."""
        _, both, own, _ = self._sample(other)
        return both / own if own else (1.0 if not len(self.hashes) else 0.0)

    def encode(self) -> str:
        """k, whole or not, and the hashes, as text."""
        head = self.k.to_bytes(2, "big") + bytes([self.whole])
        return base64.b64encode(head + self.hashes.astype(">u8").tobytes()).decode()

    @classmethod
    def decode(cls, text: str) -> Sketch:
        raw = base64.b64decode(text)
        return cls(np.frombuffer(raw, ">u8", offset=3).astype(np.uint64), int.from_bytes(raw[:2], "big"), bool(raw[2]))


def fingerprint(docs: DataFrame, size: int = 5, k: int = 128) -> DataFrame:
    """docs (doc_id, text) as doc_id, fingerprint, n_shingles (estimated).  Narrow."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [Sketch.of(t.as_py(), size, k) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.encode() for x in s], pa.string()), pa.array([x.distinct() for x in s], pa.float64())], names=["doc_id", "fingerprint", "n_shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, fingerprint string, n_shingles double")


_OUT = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]


def compare_with_next(docs: DataFrame, size: int = 5, k: int = 128) -> DataFrame:
    """Fingerprint each text, the text with its second half replaced from the next document's
    beginning, and their likeness; the next document is the one with the next smaller doc_id,
    after the last the first.

    Texts are shuffled once, into ranges of doc_id; the largest document of each range is also
    sent to the range above as its last one's successor, so no task needs another's rows and no
    global window arises.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = partitions(spark)
    edges = range_edges(docs, ["doc_id"], 4 * n)  # some ranges a task, to even them out
    # ranges downwards; a null doc_id, which is last, is below all
    order = lambda v: -(2**63) if v is None else v
    lows = [order(lo[0]) for lo, _ in edges]
    highs = [order(hi[0]) for _, hi in edges]
    schema = "bucket int, guest boolean, doc_id long, text string"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [order(v) for v in b.column(0).to_pylist()]
            own = [bisect.bisect_right(lows, v) - 1 for v in ids]
            first: dict[int, tuple] = {}  # of rows of a range's largest doc_id one a batch will do: the first by text
            for i, (v, k_) in enumerate(zip(ids, own)):
                if v == highs[k_]:
                    text = b.column(1)[i].as_py()
                    now = (text is not None, text or "", i)
                    first[k_] = min(first.get(k_, now), now)
            extra = [i for _, _, i in first.values()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([False] * len(own)), b.column(0), b.column(1)], names=["bucket", "guest", "doc_id", "text"])
            if extra:
                guests = b.take(pa.array(extra))
                yield pa.RecordBatch.from_arrays([pa.array([(own[i] + 1) % len(lows) for i in extra], pa.int32()), pa.array([True] * len(extra)), guests.column(0), guests.column(1)], names=["bucket", "guest", "doc_id", "text"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out = None, []  # the document that waits for its next one, with its sketch

        def row(x: tuple, y: tuple) -> None:
            doc, text, s = x[1], x[2], x[3]
            half = len(text) // 2
            edited = text[: len(text) - half] + y[2][:half]
            e = Sketch.of(edited, size, k)
            out.append((doc, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), s.encode(), e.encode(), s.resemblance(e), s.resemblance(y[3])))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _OUT)], names=[x for x, _ in _OUT])

        for b in batches:
            for bucket, guest, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                if guest and (last is None or last[0] != bucket):
                    continue  # another row of the successor's doc_id, the first one is taken
                text = text.as_py() or ""
                now = (bucket, doc, text, Sketch.of(text, size, k))
                if last is not None and last[0] == bucket:
                    row(last, now)
                last = None if guest else now
                if len(out) >= 500:
                    yield flush()
        if out:
            yield flush()

    dealt = docs.mapInArrow(deal, schema).repartition(n, "bucket")
    rows = dealt.sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())
    return rows.mapInArrow(walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
