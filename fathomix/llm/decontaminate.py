"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a benchmark question and the same question
with other parameters have one template.  Words of a name are one placeholder, a number glued to
its unit is two, and a word that begins a sentence is a name unless it usually begins one.
Windows of template tokens of documents and benchmark items are hash-joined; for each document and
item the windows that met are aligned, and the slots must be consistent: values of the item and of
the document stand for one another one to one throughout, as most windows have it; windows that
contradict that are left out.  A pair counts if the consistent windows cover enough of the item or
a long enough run of it.  Windows are joined on their bare lower-case tokens too, so a verbatim
copy is found whatever its share of slots and wherever it stands; only a copy with other values
needs enough literals.

Defined cases: null or empty texts and items match nothing; an item shorter than a window is one
window of its own length; one under ``shortest`` tokens, and windows with fewer literal tokens
than slots, are only found verbatim; windows that an item and a document both repeat meet in order,
the first with the first; repeated document or item rows count once; rows with a null id match
nothing; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, claim, hint_if_small, materialise, released
from .token_store import mix64

# Units and number words.
UNITS = """mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l gal s sec secs second seconds min mins minute minutes h hr hrs hour
hours day days week weeks month months year years meter meters metre metres kilometer kilometers kilometre kilometres centimeter
centimeters mile miles inch inches foot feet yard yards gram grams kilogram kilograms ton tons tonne tonnes pound pounds ounce ounces
liter liters litre litres gallon gallons dollar dollars cent cents euro euros percent degree degrees % ° °c °f mph kmh km/h m/s hz khz
mhz ghz w kw mw v kv a ma j kj kb mb gb tb""".split()
NUMBER_WORDS = """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen
nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half dozen""".split()

# Words that often begin a sentence and then are no names.
OPENERS = """a about after all also although an and another any are as at be because before both but by can could did do does during each either every few
find first for from give given had has have he her here his how however i if in is it its just let like many may more most much my neither next no not now
of often on once one only or other our over she should since so some still such suppose than that the their them then there these they this those though
through to under until up upon was we were what when where whether which while who whom whose why will with within without would yes yet you your""".split()

_NUMBER = re.compile(r"[+\-]?[$€£]?\d+(?:[.,:/]\d+)*")
_QUANTITY = re.compile(r"([+\-]?[$€£]?\d+(?:[.,:/]\d+)*)([^\W\d_/]+(?:/\w+)?|%|°[cf]?)")
_EDGE = re.compile(r"^[^\w$€£+\-%°]+|[^\w%°]+$")
_MARKS = ".,;:!?*&#$"  # such a tail of a word goes with or without the expression
_U = np.uint64
_hash = xxhash.xxh64_intdigest

LITERAL, NUMBER, UNIT, NAME, QUANTITY = range(5)
_VERBATIM = 1 << 32
_CAPITAL, _STOP, _SPECIAL = 1, 2, 4  # special: may be a unit, or of a capital word: may open a sentence
_SLOT_HASH = np.array([0, *(xxhash.xxh64_intdigest(f"<{k}>") for k in ("number", "unit", "name", "quantity"))], np.uint64)


def _token(raw: str) -> int:
    """A raw token as one number: hash of the bare lower-case token (0: none is left), then three
    bits for its type by itself and three for its flags."""
    bare = raw if raw.isalpha() else raw.rstrip(_MARKS)
    if bare.isalpha():
        low = bare.lower()
        if low not in _TYPED:  # an ordinary word
            stop = raw[-1:] in ".!?:;" or raw[-2:-1] in ".!?"
            return (xxhash.xxh64_intdigest(low) | 64) & ~63 | (_CAPITAL if bare[0].isupper() else 0) | (_STOP if stop else 0)
    else:
        bare = _EDGE.sub("", raw)
    low, plain = bare.lower(), bare.isalpha()  # a plain word has no digit
    flags = _STOP * (raw[-1:] in ".!?:;" or raw[-2:-1] in ".!?") | _CAPITAL * (bare[:1].isupper() and bare[:1].isalpha())
    if not bare:
        return flags
    kind = LITERAL
    if low in _NUMBERS or (not plain and _NUMBER.fullmatch(bare)):
        kind = NUMBER
    elif not plain and (m := _QUANTITY.fullmatch(low)) and m[2] in _UNIT_SET:
        kind = QUANTITY
    elif low in _UNIT_SET or (flags & _CAPITAL and low in _OPENERS):
        flags |= _SPECIAL
    return (xxhash.xxh64_intdigest(low) | 64) & ~63 | kind << 3 | flags


class _Tokens(dict):
    """What each raw token is, for those met, up to a bound."""

    LIMIT = 100_000

    def __missing__(self, raw: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        if raw.isalpha() and (low := raw.lower()) not in _TYPED and len(raw) > 1:
            # an ordinary word without marks, as most that are new
            self[raw] = v = (_hash(low) | 63) ^ (62 if raw[0].isupper() else 63) | 64
        else:
            self[raw] = v = _token(raw)
        return v


_TOKENS = _Tokens()
_NUMBERS, _UNIT_SET, _OPENERS = frozenset(NUMBER_WORDS), frozenset(UNITS), frozenset(OPENERS)
_TYPED = _NUMBERS | _UNIT_SET | _OPENERS


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs, the order told apart."""
    h = a * _U(0xD6E8FEB86659FD93)
    h += b
    h ^= h >> _U(29)
    return h


class Template:
    """Template tokens of a text: hashes, types and raw values."""

    def __init__(self, text: str | None):
        claim("templates", _TOKENS)
        values: list[str] = []
        starts: list[int] = []
        for line in (text or "").split("\n"):
            starts.append(len(values))
            values += line.split()
        info = np.fromiter(map(_TOKENS.__getitem__, values), np.uint64, len(values))
        low = (info & _U(63)).astype(np.uint8)  # kind and flags
        first = np.zeros(len(values) + 1, bool)
        first[starts] = True
        first[1:] |= (low & _STOP) > 0  # the token after the end of a sentence
        kind = low >> 3
        special = (low & _SPECIAL) > 0
        kind[(kind == LITERAL) & ((low & _CAPITAL) > 0) & ~(first[:-1] & special)] = NAME
        after = np.zeros(len(kind), bool)
        after[1:] = kind[:-1] == NUMBER
        kind[special & after & (kind == LITERAL)] = UNIT
        at = np.flatnonzero(info > _U(63))
        self.bare, self.values = info[at] & ~_U(63), values
        # a name of several words is one slot, a quantity two
        kind = kind[at]
        same, name = np.zeros(len(at), bool), kind == NAME
        same[1:] = name[1:] & name[:-1] & ~first[at[1:]]
        times = np.where(same, 0, np.where(kind == QUANTITY, 2, 1))
        self._real, self._same, self._times = at, same, times
        self.first_word = np.repeat(np.arange(len(at)), times)  # words of each template token
        self.at = at[self.first_word]
        self.kind = kind[self.first_word]
        self.second = np.zeros(len(self.at), bool)
        self.second[1:] = self.at[1:] == self.at[:-1]
        self.kind[self.kind == QUANTITY] = NUMBER
        self.kind[self.second] = UNIT
        self.hash = np.where(self.kind == LITERAL, self.bare[self.first_word], _SLOT_HASH[self.kind])

    # what only texts with windows that met need

    @cached_property
    def place(self) -> np.ndarray:
        """Of each real token in the template."""
        whole = np.cumsum(self._times)
        place = np.maximum(whole - self._times, 0)
        place[self._same] = whole[self._same] - 1
        return place

    @cached_property
    def last_word(self) -> np.ndarray:
        """Last word of each template token."""
        last = self.first_word.copy()
        if len(last):
            np.maximum.at(last, self.place, np.arange(len(self._real)))
        return last

    @cached_property
    def last(self) -> np.ndarray:
        """Last raw token of each template token."""
        return self._real[self.last_word]

    def __len__(self) -> int:
        return len(self.at)

    def item_window(self, at: int, n: int, place: int) -> dict:
        """A window of n words from the word ``at`` on, which begins at a place of the template."""
        last = int(self.place[at + n - 1])
        return {"at": at, "n": n, "slots": self.slots(place, last - place + 1)}

    @staticmethod
    def _rolled(tokens: np.ndarray, size: int, seed: int) -> np.ndarray:
        """Hash of each window of tokens, from hashes of its parts of 1, 2, 4, ... tokens."""
        n = len(tokens) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h, part, width, at = np.full(n, _U(seed)), tokens, 1, 0
        with np.errstate(over="ignore"):
            while True:
                if size & width:
                    h = _joined(h, part[at : at + n])
                    at += width
                if 2 * width > size:
                    return mix64(h)
                part, width = _joined(part[:-width], part[width:]), 2 * width

    def verbatim_windows(self, size: int) -> np.ndarray:
        """Hashes of all windows' bare lower-case tokens, apart from those of templates."""
        return self._rolled(self.bare, size, _VERBATIM + size)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) of the windows with at least as many literals as slots."""
        n = len(self) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = self._rolled(self.hash, size, size)
        literal = np.concatenate([[0], np.cumsum(self.kind == LITERAL)])
        at = np.flatnonzero(2 * (literal[size:] - literal[:n]) >= size)
        return at, h[at]

    def slots(self, at: int, size: int) -> list[str]:
        """Values of the slots of one window, as type:value."""
        out = []
        for i in range(at, at + size):
            if self.kind[i] != LITERAL:
                words = [_EDGE.sub("", w).lower() for w in self.values[self.at[i] : self.last[i] + 1]]
                if (self.second[i] or (i + 1 < len(self.second) and self.second[i + 1])) and (m := _QUANTITY.fullmatch(words[0])):
                    words = [m[2] if self.second[i] else m[1]]
                out.append(f"{self.kind[i]}:{' '.join(words)}")
        return out


def in_order(item_windows: list[list[tuple]], doc_windows: list[list[tuple]]) -> list[tuple[tuple, tuple]]:
    """Windows of one item and one document that met, hash by hash: the first with the first, and
    so on, the shorter list again from its start.  So repeats don't multiply."""
    out = []
    for a, b in zip(item_windows, doc_windows):
        out += [(a[k % len(a)], b[k % len(b)]) for k in range(max(len(a), len(b)))]
    return out


def judge(item_len: int, size: np.ndarray, item_at: np.ndarray, shift: np.ndarray, item_slots: list, doc_slots: list) -> tuple[float, int, bool]:
    """(coverage, longest run, verbatim) over the consistent windows of one document and item, in
    words of the item; ``shift`` is how many words the window stands further on in the document.

    Windows that met verbatim have None for the document's slots: these are the item's.
    Alignments are taken from the one with most windows down, of equals the one with most
    verbatim.  In each, a value of the item that has no value of the document yet gets the one
    most windows give it, if no other value has that; windows whose slots contradict this are left
    out, the others stay.  A pair is verbatim if no value differs and no token of a window left out
    lies outside the ones that stay.
    """
    exact = np.array([b is None for b in doc_slots], bool)
    order = np.lexsort((~exact, size, shift, item_at))  # of a window that met twice the verbatim one
    where = np.stack([item_at, shift, size], 1)[order]
    once = order[np.concatenate([[True], (where[1:] != where[:-1]).any(1)])]
    item_at, shift, size, exact = (x[once] for x in (item_at, shift, size, exact))
    pairs = [frozenset(zip(item_slots[r], item_slots[r] if doc_slots[r] is None else doc_slots[r])) for r in once]
    kinds, which, n = np.unique(shift, return_inverse=True, return_counts=True)
    by_shift = np.split(np.argsort(which, kind="stable"), np.cumsum(n)[:-1])
    taken: dict[str, str] = {}
    back: dict[str, str] = {}
    covered, against = np.zeros(item_len, bool), np.zeros(item_len, bool)
    longest = 0
    for s in np.lexsort((kinds, -np.bincount(which, exact), -n)):
        here, left = np.zeros(item_len, bool), by_shift[s].tolist()
        while left:
            # values whose windows were all left out are voted on again among the rest
            left = [r for r in left if all(taken.get(a, b) == b and back.get(b, a) == a for a, b in pairs[r])]
            votes = Counter(p for r in left for p in pairs[r] if p[0] not in taken)
            own, gone = dict(taken), dict(back)
            for a, b in sorted(votes, key=lambda p: (-votes[p], p[0] != p[1], p)):
                if a not in own and b not in gone:
                    own[a], gone[b] = b, a
            stay = [r for r in left if all(own.get(a) == b for a, b in pairs[r])]
            if not stay:
                break
            for r in stay:
                here[item_at[r] : item_at[r] + size[r]] = True
                taken.update(pairs[r])
                back.update((b, a) for a, b in pairs[r])
            left = sorted(set(left) - set(stay))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], here.astype(np.int8), [0]])))
        if len(edge):
            longest = max(longest, int((edge[1::2] - edge[::2]).max()))
        covered |= here
    for r in range(len(pairs)):
        if any(taken.get(a) != b for a, b in pairs[r]):
            against[item_at[r] : item_at[r] + size[r]] = True
    verbatim = all(a == b for a, b in taken.items()) and not (against & ~covered).any()
    return float(covered.mean()), longest, verbatim


class WindowFilter:
    """One bit for each of a power of two classes of window hashes, some 16 to 32 classes a window."""

    def __init__(self, hashes: np.ndarray, most: int = 1 << 28):
        self.mask = min(most, 1 << max(16, int(16 * len(hashes)).bit_length())) - 1
        bits = np.zeros((self.mask + 1) >> 3, np.uint8)
        at = hashes.view(np.uint64) & _U(self.mask)
        np.bitwise_or.at(bits, (at >> _U(3)).astype(np.int64), np.uint8(1) << (at & _U(7)).astype(np.uint8))
        self.bits = bits

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes whose bit is set."""
        at = hashes.view(np.uint64) & _U(self.mask)
        return np.flatnonzero(self.bits[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8) & 1)


_ITEM = "h long, size int, item_id long, item_len int, windows array<struct<at:int,n:int,slots:array<string>>>"
_WINDOW = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("slots", pa.list_(pa.string()))]))
_MET = pa.list_(pa.struct([("at", pa.int32()), ("slots", pa.list_(pa.string()))]))


def contaminated(docs: DataFrame, items: DataFrame, window: int = 8, coverage: float = 0.5, run: int = 13, shortest: int = 4, small_rows: int = 1_000_000) -> DataFrame:
    """Pairs (doc_id, item_id, coverage, longest_run, verbatim) of documents that hold an item.

    Texts stay where they are: a scan keeps only windows whose hash is in a filter made from all
    item windows and sized by their number (the driver gets their hashes, eight bytes each, and no
    documents').  The kept ones are joined on the full hash (broadcast if the item windows are
    counted to be few, else shuffled), then grouped by document and item.
    """
    spark = docs.sparkSession
    bound_batches(spark)

    def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t = Template(text)
                held: dict[tuple[int, int], list] = {}
                size = min(window, len(t))
                if size >= shortest:
                    at, h = t.windows(size)
                    for p, x in zip(at.tolist(), h.view(np.int64).tolist()):
                        first = int(t.first_word[p])
                        held.setdefault((x, size), []).append(t.item_window(first, int(t.last_word[p + size - 1]) - first + 1, p))
                size = min(window, len(t.bare))
                if size:
                    for p, x in enumerate(t.verbatim_windows(size).view(np.int64).tolist()):
                        held.setdefault((x, -size), []).append(t.item_window(p, size, int(t.place[p])))
                rows += [(x, k, item, len(t.bare), own) for (x, k), own in held.items()]
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), _WINDOW]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["h", "size", "item_id", "item_len", "windows"])

    theirs = items.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    theirs = materialise(theirs.mapInArrow(item_windows, _ITEM), "item-windows")  # size < 0: verbatim
    hashes = theirs.select("h").distinct().toArrow().column(0).to_numpy()
    sizes = [r[0] for r in theirs.select("size").distinct().collect()]
    shared = spark.sparkContext.broadcast(WindowFilter(hashes))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in released(batches):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                t = Template(text.as_py())
                held: dict[tuple[int, int], list] = {}
                for size in sizes:
                    if size > 0:
                        at, h = t.windows(size)
                        k = known.hits(h)
                        for x, p in zip(h[k].view(np.int64).tolist(), at[k].tolist()):
                            held.setdefault((x, size), []).append({"at": int(t.first_word[p]), "slots": t.slots(p, size)})
                    else:
                        h = t.verbatim_windows(-size)
                        k = known.hits(h)
                        for x, p in zip(h[k].view(np.int64).tolist(), k.tolist()):
                            held.setdefault((x, size), []).append({"at": p, "slots": None})
                rows += [(x, k, doc, own) for (x, k), own in held.items()]
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), _MET]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["h", "size", "doc_id", "met"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        held: list[tuple] = []
        kinds = [("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("longest_run", pa.int32()), ("verbatim", pa.bool_())]

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held), kinds)], names=[n for n, _ in kinds])
            held.clear()
            return out

        for (doc, item), own in groupby(rows, key=lambda r: r[:2]):
            own = list({r[3:5]: r for r in own}.values())  # hashes that this document and this item share
            n = own[0][2]
            theirs_ = [[(w["at"], w["n"], w["slots"]) for w in r[5]] for r in own]
            met = in_order(theirs_, [[(w["at"], w["slots"]) for w in r[6]] for r in own])
            size, item_at, shift = (np.array(v) for v in zip(*((a[1], a[0], b[0] - a[0]) for a, b in met)))
            cover, longest, verbatim = judge(n, size, item_at, shift, [a[2] for a, _ in met], [b[1] for _, b in met])
            if cover >= coverage or longest >= run:
                held.append((doc, item, cover, longest, verbatim))
            if len(held) >= 5000:
                yield flush()
        if held:
            yield flush()

    ours = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    met = ours.mapInArrow(scan, "h long, size int, doc_id long, met array<struct<at:int,slots:array<string>>>").join(hint_if_small(theirs, small_rows), ["h", "size"])
    met = met.select("doc_id", "item_id", "item_len", "h", "size", "windows", "met")
    met = met.repartition("doc_id", "item_id").sortWithinPartitions("doc_id", "item_id")
    return met.mapInArrow(pair, "doc_id long, item_id long, coverage double, longest_run int, verbatim boolean")


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without the contaminated documents; all columns stay."""
    hits = materialise(contaminated(docs, items, **options).select("doc_id").distinct(), "contaminated")
    return docs.join(hint_if_small(hits, 1_000_000), "doc_id", "left_anti").select(*docs.columns)
