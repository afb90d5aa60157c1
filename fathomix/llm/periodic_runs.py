"""Periodic runs of words in documents, and texts with the repetitions taken out.

A run is a stretch of words with smallest period q, at least twice as long as q, that can't be made
longer at either end.  All of them are found after Kolpakov and Kucherov: a suffix automaton gives
the LZ factorisation (each factor the longest one that occurs before, and where); Main's extension
functions give the runs that touch a border of factors, among them the leftmost of every run;
all others lie within a factor and are copied from its earlier occurrence.

Before that, words that no run can hold are set aside, exactly: a run of at least ``least`` words
with period q repeats ``least / 2`` words in a row at distance q, so each of its words lies in a
window of that many words which occurs twice in the text.  Stretches of such words are factorised
one by one; no run reaches out of one.

A text is one row's work, in time and memory in proportion to its words; nothing is shuffled.

Defined cases: a null text has no words and no runs, as have empty ones; a null doc_id's text is
taken as it is (nothing is made periodic); equal rows give equal results; an empty table gives no
rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

Run = tuple[int, int, int]  # start, length, period


class SuffixAutomaton:
    """Suffix automaton of a word sequence; ``first`` is where a state's words end for the first time.

    Most states have one way on, so that is held in arrays; only branching states have a dict."""

    def __init__(self, words: list[int]):
        n = 2 * len(words) + 1
        length, link, first = array("i", [0]) * n, array("i", [-1]) * n, array("i", [-1]) * n
        letter, target = array("i", [-1]) * n, array("i", [-1]) * n
        more: dict[int, dict[int, int]] = {}
        states, last = 1, 0
        for at, c in enumerate(words):
            cur, p = states, last
            states += 1
            length[cur] = at + 1
            first[cur] = at
            q = -1
            while p >= 0:
                if letter[p] == c:
                    q = target[p]
                    break
                if letter[p] < 0:
                    letter[p], target[p] = c, cur
                else:
                    ways = more.get(p)
                    if ways is None:
                        more[p] = {c: cur}
                    else:
                        q = ways.get(c, -1)
                        if q >= 0:
                            break
                        ways[c] = cur
                p = link[p]
            if p < 0:
                link[cur] = 0
            elif length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = states
                states += 1
                length[clone], link[clone], first[clone] = length[p] + 1, link[q], first[q]
                letter[clone], target[clone] = letter[q], target[q]
                if q in more:
                    more[clone] = more[q].copy()
                while p >= 0:
                    if letter[p] == c:
                        if target[p] != q:
                            break
                        target[p] = clone
                    else:
                        ways = more.get(p)
                        if ways is None or ways.get(c) != q:
                            break
                        ways[c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
            last = cur
        self.words, self.letter, self.target, self.more, self.first = words, letter, target, more, first

    def factors(self) -> list[tuple[int, int, int]]:
        """LZ factors (start, end, start of an earlier occurrence or -1), which may overlap it."""
        words, letter, target, more, first = self.words, self.letter, self.target, self.more, self.first
        out, at, n = [], 0, len(words)
        while at < n:
            state, end = 0, at
            while end < n:
                c = words[end]
                to = target[state] if letter[state] == c else more[state].get(c, -1) if state in more else -1
                if to < 0 or first[to] >= end:
                    break
                state, end = to, end + 1
            if end == at:
                out.append((at, at + 1, -1))
                at += 1
            else:
                out.append((at, end, first[state] - (end - at) + 1))
                at = end
        return out


def prefix_lengths(s: list[int]) -> list[int]:
    """Of every suffix, how long its longest common prefix with the whole is (Z function)."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    lo = hi = 0
    for i in range(1, n):
        k = 0
        if i < hi:
            k = z[i - lo]
            if k < hi - i:
                z[i] = k
                continue
            k = hi - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        lo, hi = i, i + k
    return z


def crossing(w: list[int], left: int, border: int, end: int, least: int) -> Iterator[tuple[int, int, int]]:
    """Main: stretches (start, stop, period) of at least ``least`` words that touch ``border`` and
    repeat within w[left:end], as far as they go there.

    For each period, how far the words right of the border are like those a period on, and those
    left of it like those a period back, are values of Z functions of the two sides."""
    t, v = w[left:border], w[border:end]
    lt, lv, t_back = len(t), len(v), w[left:border][::-1]
    if lv:  # at least one period right of the border
        ahead = prefix_lengths(v)
        behind = prefix_lengths([*t_back, -1, *v[::-1], *t_back])
        for p in range(1, lv + 1):
            more = ahead[p] if p < lv else 0
            less = behind[lt + 1 + lv - p]
            if more + less >= p and more + less + p >= least:
                yield border - less, border + p + more, p
    if lt:  # at least one period left of it
        ahead = prefix_lengths([*v, -1, *t, *v])
        behind = prefix_lengths(t_back)
        for p in range(1, lt + 1):
            more = ahead[lv + 1 + lt - p]
            less = behind[p] if p < lt else 0
            if more + less >= p and more + less + p >= least:
                yield border - p - less, border + more, p


def factor_runs(w: list[int], least: int = 12) -> list[Run]:
    """All runs of a word sequence that have at least ``least`` words, by start, then period."""
    n, factors = len(w), SuffixAutomaton(w).factors()
    found: dict[tuple[int, int], int] = {}  # a stretch repeats with multiples of its period too
    stops: dict[int, set[int]] = {}
    before = 0
    for start, end, source in [*factors, (n, n, -1)]:
        reach = 2 * before + end - start
        if reach + end - start >= least:
            for s, e, p in crossing(w, max(0, start - reach), start, end, least):
                if (e < n and w[e] == w[e - p]) or (s > 0 and w[s - 1] == w[s - 1 + p]):
                    continue  # goes on beyond what was looked at: another border has it
                if p < found.get((s, e), n):
                    found[s, e] = p
                    stops.setdefault(s, set()).add(e)
        before = end - start
        if source >= 0 and before >= least + 2:
            by = start - source
            for s in range(source + 1, end - by - least):
                for e in tuple(stops.get(s, ())):
                    if e < end - by:
                        found[s + by, e + by] = found[s, e]
                        stops.setdefault(s + by, set()).add(e + by)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def stretches(ids: np.ndarray, least: int = 12) -> list[tuple[int, int]]:
    """Stretches (start, stop) outside of which no run of ``least`` words has a word.  Windows are told
    apart by a hash; where two meet in one, a stretch is longer than it need be, nothing else."""
    k = (least + 1) // 2
    m = len(ids) - k + 1
    if m < 2:
        return []
    x, h = ids.astype(np.uint64) + np.uint64(1), np.zeros(m, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + x[j : j + m]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return []
    twice = np.zeros(m, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[:m] += twice
    edge[k : k + m] -= twice
    held = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
    turns = np.flatnonzero(held[1:] != held[:-1])
    return [(a, b) for a, b in turns.reshape(-1, 2).tolist() if b - a >= least]


def word_runs(words: list[bytes], least: int = 12) -> list[Run]:
    """All runs of a text's words, by start, then period."""
    if len(words) < least:
        return []
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    if len(number) == len(words):
        return []
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    return [(a + s, length, p) for a, b in stretches(ids, least) for s, length, p in factor_runs(ids[a:b].tolist(), least)]


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """words without those that any run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for s, length, p in runs:
        edge[s + p] += 1
        edge[s + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of all documents, by their id's checksum, gets a periodic end of words of its own."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


FOUND = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find(docs: DataFrame, least: int = 12, plant: bool = False) -> DataFrame:
    """(doc_id, runs, collapsed) of every document: its runs by start, then period, and its words
    without the repetitions, joined by one space.  Words are what ASCII white space parts."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            found, texts = [], []
            for doc_id, text in zip(x.column(0).to_pylist(), x.column(1)):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                if plant:
                    words = planted(doc_id, words)
                runs = word_runs(words, least)
                found.append([{"start": s, "length": k, "period": p} for s, k, p in runs])
                texts.append(b" ".join(collapse(words, runs)))
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(found, _RUN), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, FOUND)


def digest(found: DataFrame) -> DataFrame:
    """Of each document's runs: their number, the longest one, and digests of all and of the rest."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
    return rows.select(
        "doc_id", "n_runs", (-F.col("b.start")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.period")).alias("period"),
        F.expr("(1000 * b.length) div (-b.period)").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
