"""Encoding of whole texts with a public tokenizer file, word by word with a bounded cache.

White space never joins two pre-tokens of the vocabularies used here, so a text's ids are the
ids of its white-space separated chunks one after the other.  Chunks, and inside them
pre-tokens, repeat; each worker keeps the ids of those it has met.  The ids themselves always
come from the tokenizers library.
"""

from __future__ import annotations

import array
import json
import os

import numpy as np
import regex

from .common import claim

#: Printable characters below this need no Unicode normalisation, lower-case one by one, and
#: are white space to all regular-expression engines or to none.
_PLAIN = "İ"
#: The pattern by which a word of letters and a tail of these marks are two pre-tokens, whole.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_TAIL = ".,;:!?$%&#*"


def _byte_alphabet() -> dict[int, int]:
    """Printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(rest)}


class WordEncoder:
    """Ids of whole texts as bytes of little-endian unsigned 32-bit integers.

    A null text counts as empty.  ``cache`` bounds the chunks and the pre-tokens kept.  For
    tokenizer files of another build than lower-casing word-end BPE, every chunk is encoded by
    the library's full path, which gives the same ids more slowly.
    """

    def __init__(self, path: str, cache: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        pattern = steps[0].get("pattern", {}).get("Regex") if steps[0].get("type") == "Split" else None
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.wordwise = bool(pattern) and steps[0].get("invert") and kinds == ["NFC", "Replace", "Lowercase"]
        self.pattern = regex.compile(pattern) if self.wordwise else None
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.tails = self.wordwise and pattern == _WORDS and all(any(not (c.isalpha() or c in _TAIL) for c in x) for x in self.special)
        self.alphabet = _byte_alphabet()
        self.cache = cache
        self.chunks: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.model = self.tokenizer.model

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.older.pop(piece, None)
            if ids is None:
                mapped = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.alphabet)
                ids = array.array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
            if 2 * len(self.pieces) >= self.cache:  # what was met since the last time stays, once more
                self.older.clear()
                self.older.update(self.pieces)
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def _chunk(self, chunk: bytes) -> bytes:
        """Ids of a chunk; it is kept unless it is one word that is met for the first time."""
        s = chunk.decode("utf-8")
        body = s.rstrip(_TAIL) if self.tails else ""
        if body.isalpha() and (body.isascii() or max(body) < _PLAIN):
            low = body.lower()
            again = low in self.pieces or low in self.older
            ids = self._piece(low)
            if len(body) < len(s):
                ids += self._piece(s[len(body) :])
            if not again:
                return ids
        elif max(s) < _PLAIN and s.isprintable() and not any(x in s for x in self.special):
            ids = b"".join([self._piece(p) for p in self.pattern.findall(s.lower())])
        else:
            ids = self._library(s)
        if len(self.chunks) >= self.cache:
            self.chunks.clear()
        self.chunks[chunk] = ids
        return ids

    def _library(self, s: str) -> bytes:
        return array.array("I", self.tokenizer.encode(s, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.wordwise:
            return self._library(text)
        known, out = self.chunks, []
        for c in text.encode("utf-8").split():
            ids = known.get(c)
            if ids is None:
                ids = self._chunk(c)
            out.append(ids)
        return b"".join(out)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file; it lives as long as the worker does."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    own = _ENCODERS[path]
    claim(f"tokens {path}", own.chunks, own.pieces, own.older)
    return own


def as_ids(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<u4")
