"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1.  A letter trigram is the product of its letters'
vectors, the first rotated twice and the second once; a text is the sum of its trigrams; a
language prototype is the sum of its training texts; a text gets the language whose prototype
has the highest cosine with it.  Letters are lower-cased, everything else is one blank, and
blanks count as a letter at word edges.  a-z have vectors of their own; all other letters share
37 more by code point, so the alphabet is open and the model's size fixed.

Defined cases: a null text or one without a letter is ``und`` with score 0; a null doc_id is
crc32 of the empty text (held out); rows without lang aren't learnt from; ties go to the
language first in order; without any training row all are ``und``; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, claim

SYMBOLS, SHARED = 64, 37
CODES = SYMBOLS**3
_CHARS = 1 << 19  # characters looked at together


@lru_cache(1)
def _symbol_table() -> np.ndarray:
    """Symbol of every code point; 0: blank."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = ord(chr(c).lower()[0])
            out[c] = low - 96 if 97 <= low <= 122 else 27 + low % SHARED
    return out


@lru_cache(4)
def _letters(dim: int, seed: int) -> np.ndarray:
    return (np.random.default_rng(seed).integers(0, 2, (SYMBOLS, dim)) * 2 - 1).astype(np.int8)


def trigram_vectors(codes: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """Bound vectors of trigram codes, one a row."""
    v = _letters(dim, seed)
    a, b, c = codes // SYMBOLS**2, codes // SYMBOLS % SYMBOLS, codes % SYMBOLS
    return np.roll(v, 2, 1)[a] * np.roll(v, 1, 1)[b] * v[c]


def trigrams(text: str) -> np.ndarray:
    """Codes of all letter trigrams of a text, word edges included, none with two blanks."""
    if not text:
        return np.zeros(0, np.int64)
    s = _symbol_table()[np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), "<u4")]
    s = s[np.concatenate([[True], (s[1:] > 0) | (s[:-1] > 0)])].astype(np.int64)  # one blank between words
    if len(s) < 3:
        return np.zeros(0, np.int64)
    return s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:]


def _blocks(texts: Iterator[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(document number, trigram code, documents) of some documents at a time."""
    claim("langid")
    rows, codes, held, n = [], [], 0, 0
    for t in texts:
        g = trigrams(t or "")
        rows.append(np.full(len(g), n, np.int64))
        codes.append(g)
        n, held = n + 1, held + len(g)
        if held >= _CHARS or n >= 256:
            yield np.concatenate(rows), np.concatenate(codes), n
            rows, codes, held, n = [], [], 0, 0
    if n:
        yield np.concatenate(rows), np.concatenate(codes), n


def _bundle(rows: np.ndarray, codes: np.ndarray, n: int, dim: int, seed: int) -> np.ndarray:
    """Sum of trigram vectors of each of n rows."""
    seen = np.zeros(CODES, bool)
    seen[codes] = True
    own = np.flatnonzero(seen)
    place = np.zeros(CODES, np.int64)
    place[own] = np.arange(len(own))
    out = np.zeros((n, dim), np.float32)
    for at in range(0, len(own), 4096):  # bounds the matrices for very mixed alphabets
        part = own[at : at + 4096]
        inside = (place[codes] >= at) & (place[codes] < at + len(part)) if len(own) > 4096 else slice(None)
        m = np.bincount(rows[inside] * len(part) + place[codes[inside]] - at, minlength=n * len(part)).reshape(n, len(part))
        out += m.astype(np.float32) @ trigram_vectors(part, dim, seed).astype(np.float32)
    return out


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Whether a document is kept from training."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0


def train(docs: DataFrame, dim: int = 1024, seed: int = 7) -> dict[str, list[float]]:
    """Prototype of each value of ``lang`` in docs (text, lang).

    Bundling is a sum, so each task bundles what it reads and only one vector per task and
    language is shuffled; the driver gets one vector per language.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([v.tolist() for v in held.values()], pa.list_(pa.int64()))], names=["lang", "bundle"])
            held.clear()
            return out

        for b in batches:
            langs = np.array(b.column(0).to_pylist(), dtype=object)
            at = 0
            for rows, codes, n in _blocks(t.as_py() for t in b.column(1)):
                names, which = np.unique(langs[at : at + n], return_inverse=True)
                at += n
                for name, v in zip(names, _bundle(which[rows], codes, len(names), dim, seed)):
                    held[name] = held.get(name, 0) + np.rint(v).astype(np.int64)
                if len(held) > 256:
                    yield flush()
        if held:
            yield flush()

    bound_batches(docs.sparkSession)
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    rows = (
        known.mapInArrow(partial, "lang string, bundle array<long>")
        .select("lang", F.posexplode("bundle").alias("at", "v"))
        .groupBy("lang", "at")
        .agg(F.sum("v").alias("v"))
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("p"))
        .collect()
    )
    return {r["lang"]: [float(x["v"]) for x in r["p"]] for r in sorted(rows, key=lambda r: r["lang"]) if any(x["v"] for x in r["p"])}


def predict(docs: DataFrame, model: dict[str, list[float]], dim: int = 1024, seed: int = 7) -> DataFrame:
    """docs with ``lang_pred`` and ``score``, the cosine with the best prototype, at least 0.

    Narrow.  The text is the only input; all columns of docs stay as they are.
    """
    names = sorted(model)
    protos = np.array([model[k] for k in names], np.float64).reshape(len(names), dim)
    protos = (protos / np.maximum(np.linalg.norm(protos, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(protos)
    bound_batches(docs.sparkSession)
    kept = docs.columns
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in batches:
            best, score = [], []
            for rows, codes, n in _blocks(t.as_py() for t in b.column(kept.index("text"))):
                v = _bundle(rows, codes, n, dim, seed)
                empty = np.bincount(rows, minlength=n) == 0
                if not len(p):
                    best += ["und"] * n
                    score += [0.0] * n
                    continue
                cos = v @ p.T / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                at = cos.argmax(1)
                best += ["und" if e else names[k] for k, e in zip(at, empty)]
                score += [0.0 if e else float(min(1.0, max(0.0, c))) for c, e in zip(cos.max(1), empty)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best, pa.string()), pa.array(score, pa.float64())], names=[*kept, "lang_pred", "score"])

    return docs.mapInArrow(label, schema)


def identify(docs: DataFrame, folds: int = 5, dim: int = 1024, seed: int = 7) -> DataFrame:
    """Train on the documents outside the held-out fold, then label all."""
    docs = docs.select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out(folds=folds)), dim, seed)
    out = predict(docs.select("doc_id", "text"), model, dim, seed)
    return out.select("doc_id", held_out(folds=folds).alias("held_out"), "lang_pred", "score")
