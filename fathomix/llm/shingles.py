"""Word shingles of whole texts as 64-bit hashes."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import xxhash

from .common import claim
from .token_store import mix64

_U = np.uint64
_STEP = _U(0xD6E8FEB86659FD93)


class _Words(dict):
    """Hash of each word met, up to a bound."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_WORDS = _Words()


def words(text: str | None) -> list[bytes]:
    """Runs of anything but the six ASCII white-space characters, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words in order; of the whole sequence if it is shorter."""
    claim("shingles", _WORDS)
    w = words(text)
    if not w:
        return np.zeros(0, np.uint64)
    get = _WORDS.__getitem__
    h = np.fromiter((get(x) for x in w), np.uint64, len(w))
    n = min(size, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, _U(n))
        for i in range(n):
            out = (out ^ h[i : len(h) - n + 1 + i]) * _STEP
            out ^= out >> _U(29)
        return mix64(out)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Distinct shingle hashes in ascending order."""
    return np.unique(shingle_hashes(text, size))


def set_digest(hashes: np.ndarray) -> bytes:
    """Equal for equal sets."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


@lru_cache(64)
def _shift(size: int) -> int:
    return max(6, int(size - 1).bit_length())


def parity_bitmap(hashes: np.ndarray) -> np.ndarray:
    """One bit of parity per hash class, one to two classes per member, as 64-bit words.

    The bits in which two bitmaps differ are at most the members in which the sets differ.
    """
    bits = 1 << _shift(len(hashes))
    odd = (np.bincount((hashes & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)
    return np.packbits(odd, bitorder="little").view("<i8")


def packed_set(hashes: np.ndarray) -> bytes:
    """A set as its members' eight bytes each, ascending."""
    return hashes.astype("<u8").tobytes()


def read_set(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u8")
