"""Main-text extraction by nearest-URL page differencing.

Pages of a host are ordered by URL path and each is paired with the neighbour whose path shares
the longest beginning with its own and that isn't a copy of it.  The two pages' text lines are
aligned by longest common subsequence; shared lines are template text and are deleted.  Two things
that lines alone can't tell come from markup: parts whose role is stated (menus, headers, footers,
sidebars, adverts, notices, forms, scripts, comments) are never lines of the page, and lines inside
an article or main element are kept even where the neighbour has them, since articles do quote one
another.  Differencing decides for all other lines, on pages with such an element as on those
without.  README has the figures of differencing without the markup's help.

Defined cases: null or empty html gives an empty text; a null URL has empty host and path, and
such pages are one host; a page without a neighbour in its host loses no line to differencing,
and of one with an article or main element only the lines inside are kept;
a page whose neighbours are both copies of it (nine tenths of all lines are the same) loses
nothing; ties take the earlier neighbour; repeated rows are pages of their own; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import html as htmllib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, hint_if_small, materialise, partitions, range_edges
from .url_filter import parts

# Elements by what they mean for text.
RAW = "script style template noscript iframe svg math canvas object audio video textarea title select head".split()
ASIDE = "nav footer aside form button dialog menu".split()
BLOCKS = """html body main article section header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th
caption blockquote pre figure figcaption address details summary fieldset legend form dialog menu center hr""".split()
UNCLOSED = "p li dt dd tr td th thead tbody tfoot hr br img input meta link area base col embed source track wbr".split()
# Words of class, id and role that say a part isn't the article.
ROLES = """ad ads adv advert adverts advertisement advertising banner promo promoted promotion sponsor sponsored sidebar menu nav navbar
navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe
subscription signup login share sharing social related recommended comment comments disqus respond replies toolbar pagination pager
contentinfo complementary search dialog""".split()

_RAW, _ASIDE, _BLOCKS, _UNCLOSED, _ROLES = map(frozenset, (RAW, ASIDE, BLOCKS, UNCLOSED, ROLES))
_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_QUOTED = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ROLE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
# Where elements that hold no text end if their end tag is missing; others then hold the rest.
_ENDS = {
    "head": re.compile(rf"<(?:body|{'|'.join(x for x in BLOCKS if x != 'html')})[\s/>]", re.I),
    "title": re.compile(r"<(?:/?(?:head|body|meta|link|base|script|style|main|article|section|header|nav|div|p|h[1-6])[\s/>])", re.I),
    "select": re.compile(r"<(?!/?(?:option|optgroup|hr)[\s/>])/?[a-z]", re.I),
}
PLAIN, MAIN = 0, 1


class _Scanner:
    """The tags of a page one after the other, in time linear in its length.

    A tag ends at the first > outside quotes.  Where quotes never end, and from there on, it ends
    at the first > of all; without any > the rest is text.  An unclosed comment is the rest."""

    def __init__(self, page: str):
        self.page, self.quotes, self.last = page, True, page.rfind(">")

    def next(self, at: int) -> tuple[int, int, str, bool, str]:
        """(start, end, name, whether it closes, attributes) of the next tag from at on; the name is
        empty for comments and the like, start and end are the page's length if none is left."""
        page = self.page
        while m := _OPEN.search(page, at):
            if m[1]:
                end = page.find("-->", m.end())
                return m.start(), len(page) if end < 0 else end + 3, "", False, ""
            if m.end() > self.last:
                break
            if m[2]:
                return m.start(), page.index(">", m.end()) + 1, "", False, ""
            q = _QUOTED.match(page, m.end()) if self.quotes else None
            if not q:
                self.quotes = False
            end = q.end() if q else page.index(">", m.end()) + 1
            return m.start(), end, m[4].lower(), bool(m[3]), page[m.end() : end - 1]
        return len(page), len(page), "", False, ""


def _off(attributes: str, article: bool) -> bool:
    """Whether attributes say that the element isn't part of the article."""
    if _HIDDEN.search(attributes):
        return True
    for m in _ROLE.finditer(attributes):
        for word in (m[1] or m[2] or m[3] or "").lower().split():
            bits = [word] if article else _SPLIT.split(word)  # in an article share-price is no role
            if not _ROLES.isdisjoint(bits) or (not article and "header" in bits):
                return True
    return False


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(zone, text) of each text block outside parts with another role, in page order."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, bool, bool]] = []  # name, off, inside an article
    text: list[str] = []
    off = article = False
    page = page or ""
    scanner, at, open_ = _Scanner(page), 0, Counter()

    def flush() -> None:
        line = " ".join(htmllib.unescape("".join(text)).split())
        if line:
            out.append((MAIN if article else PLAIN, line))
        text.clear()

    while True:
        start, end, name, closes, attributes = scanner.next(at)
        if not off:
            text.append(page[at:start])
        if start == len(page):
            break
        at = end
        if not name:
            continue
        if name in _BLOCKS:
            flush()
        elif name == "br":
            text.append(" ")
        if closes:
            if open_[name]:
                flush()
                while True:
                    gone = stack.pop()[0]
                    open_[gone] -= 1
                    if gone == name:
                        break
                off, article = stack[-1][1:] if stack else (False, False)
            continue
        if name in _RAW and not attributes.endswith("/"):
            close = re.compile(rf"</{name}\b", re.I).search(page, at)
            end = page.find(">", close.end()) if close else -1
            rest = _ENDS[name].search(page, at) if end < 0 and name in _ENDS else None
            at = rest.start() if rest else len(page) if end < 0 else end + 1
            continue
        own = name in _ASIDE or (name == "header" and not article)
        if not own and attributes.strip() and name not in ("html", "body", "main", "article"):
            own = _off(attributes, article)
        if own or (name in _BLOCKS and name not in _UNCLOSED):
            if own:
                flush()
            if attributes.endswith("/") or (own and name in _UNCLOSED and name not in ("p", "li", "td", "tr", "th", "dd", "dt")):
                continue
            open_[name] += 1
            stack.append((name, off or own, article or (name in ("article", "main") and not (off or own))))
            off, article = stack[-1][1:]
        elif name in ("p", "li") and stack and stack[-1][0] == name:
            open_[stack.pop()[0]] -= 1  # the next paragraph ends one that has another role
            off, article = stack[-1][1:] if stack else (False, False)
    flush()
    return out


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of a and each beginning of b.

    One bit for each line of b: bit j of the row stays set unless line j makes the subsequence
    longer, so a whole row is one sum of large integers."""
    where: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    kept: dict[int, int] = {}  # only of lines that repeat often, so that all masks stay small

    def mask(x: int) -> int:
        at = where.get(x, ())
        if len(at) < 2:
            return 1 << at[0] if at else 0
        if x in kept:
            return kept[x]
        raw = bytearray(len(b) // 8 + 1)
        for j in at:
            raw[j >> 3] |= 1 << (j & 7)
        out = int.from_bytes(raw, "little")
        if len(at) > 64:
            kept[x] = out
        return out

    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & mask(x)
        row = (row + hit | row - hit) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_lines(a: list[str], b: list[str]) -> list[bool]:
    """For each line of a, whether one longest common subsequence of a and b has it.

    Equal ends are set aside, lines that the other page doesn't have are left out, and the rest is
    halved again and again, so memory is linear and a step costs a machine word per 64 lines."""
    shared = [False] * len(a)
    number: dict[str, int] = {}
    x, y = ([number.setdefault(v, len(number)) for v in z] for z in (a, b))
    both = set(x) & set(y)
    todo = [([i for i, v in enumerate(x) if v in both], [v for v in y if v in both])]
    while todo:
        at, v = todo.pop()
        low, high, top = 0, len(at), len(v)
        while low < min(high, top) and x[at[low]] == v[low]:
            shared[at[low]] = True
            low += 1
        while high > low and top > low and x[at[high - 1]] == v[top - 1]:
            shared[at[high - 1]] = True
            high, top = high - 1, top - 1
        at, v = at[low:high], v[low:top]
        if not at or not v:
            continue
        if len(at) == 1:
            shared[at[0]] = x[at[0]] in v
            continue
        half = len(at) // 2
        u = [x[i] for i in at]
        split = int((_lengths(u[:half], v) + _lengths(u[half:][::-1], v[::-1])[::-1]).argmax())
        todo += [(at[:half], v[:split]), (at[half:], v[split:])]
    return shared


def is_copy(lines: list[str], other: list[str], least: float = 0.9) -> bool:
    """Whether nearly all lines of both pages are the same: such a page says nothing about the
    other's template."""
    if lines == other:
        return True
    n = max(len(lines), len(other))
    if not lines or not other or sum((Counter(lines) & Counter(other)).values()) < least * n:
        return False
    return sum(common_lines(lines, other)) >= least * n


def prune(lines: list[str], zones: list[int], other: list[str] | None, differencing: bool = True) -> list[str]:
    """The page's main lines: those that the paired page doesn't share, and all in an article."""
    if not differencing:
        return lines
    if MAIN not in zones:
        shared = common_lines(lines, other) if other else [False] * len(lines)
        return [x for x, s in zip(lines, shared) if not s]
    if other is None:  # without a page to compare with, markup alone tells text from template
        return [x for x, z in zip(lines, zones) if z == MAIN]
    shared = common_lines(lines, other)
    return [x for x, z, s in zip(lines, zones, shared) if z == MAIN or not s]


def _prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


_FIELDS = [
    ("bucket", pa.int32()), ("guest", pa.bool_()), ("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("path", pa.string()),
    ("copied", pa.int64()), ("zones", pa.list_(pa.int8())), ("lines", pa.list_(pa.string())),
]
_DEALT = "bucket int, guest boolean, page_id long, url string, host string, path string, copied long, zones array<tinyint>, lines array<string>"


def extract(pages: DataFrame, differencing: bool = True) -> DataFrame:
    """pages (page_id, url, html) as page_id, url, text, n_chars.

    Of pages of a host with equal html one is compared with others; the rest take its text, joined
    by hash of the html.  Lines are shuffled once, into ranges of (host, path, page_id); a host of
    any size spreads over many ranges.  A range's first and last page also go to the ranges next
    to it.  Without ``differencing`` only markup decides (for comparison).
    """
    bound_batches(pages.sparkSession)
    host, path = parts(F.col("url"))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"), path.alias("path"))
    at = F.struct("path", F.coalesce("page_id", F.lit(-(2**63))).alias("p"))
    copied = F.xxhash64("html", F.length("html"))
    many = keyed.select("host", copied.alias("copied"), at.alias("_at")).groupBy("host", "copied").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    many = materialise(many.filter("_n > 1").drop("_n"), "equal-pages")
    if many.isEmpty():
        return _main_text(keyed.withColumn("copied", F.lit(None).cast("long")), differencing).drop("host", "copied")
    both = keyed.withColumn("copied", copied).join(hint_if_small(many, 200_000), ["host", "copied"], "left")
    own = both.filter(F.col("_first").isNull() | (F.col("_first") == at)).withColumn("copied", F.when(F.col("_first").isNotNull(), F.col("copied")))
    text = materialise(_main_text(own.select(*keyed.columns, "copied"), differencing), "page-texts")
    first = text.filter("copied is not null").groupBy("host", "copied").agg(F.min("text").alias("text"), F.min("n_chars").alias("n_chars"))
    rest = both.filter(F.col("_first").isNotNull() & (F.col("_first") != at)).select("page_id", "url", "host", "copied").join(first, ["host", "copied"])
    return text.select("page_id", "url", "text", "n_chars").unionByName(rest.select("page_id", "url", "text", "n_chars"))


def _main_text(keyed: DataFrame, differencing: bool) -> DataFrame:
    """keyed (page_id, url, html, host, path, copied) as page_id, url, text, n_chars, host, copied."""
    n = partitions(keyed.sparkSession)
    edges = range_edges(keyed, ["host", "path", "page_id"], 4 * n)
    order = lambda k: (k[0], k[1], k[2] is not None, k[2] or 0)
    lows, highs = [order(lo) for lo, _ in edges], [order(hi) for _, hi in edges]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for page, url, html, h, p, copied in zip(*b.columns):
                page, h, p = page.as_py(), h.as_py(), p.as_py()
                key = order((h, p, page))
                k = bisect_right(lows, key) - 1
                own = blocks(html.as_py())
                rest = (page, url.as_py(), h, p, copied.as_py(), [z for z, _ in own], [x for _, x in own])
                rows.append((k, False, *rest))
                if key == lows[k] and k and highs[k - 1][0] == h:
                    rows.append((k - 1, True, *rest))
                if key == highs[k] and k + 1 < len(lows) and lows[k + 1][0] == h:
                    rows.append((k + 1, True, *rest))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _FIELDS)], names=[x for x, _ in _FIELDS])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))

        def result(x: tuple, before: tuple | None, after: tuple | None) -> tuple:
            near = [y for y in (before, after) if y is not None and (y[0], y[4]) == (x[0], x[4])]
            near.sort(key=lambda y: -_prefix(x[5], y[5]))
            pair = next((y for y in near if not is_copy(x[8], y[8])), None)
            other = pair[8] if pair else ([] if near else None)
            text = "\n".join(prune(x[8], x[7], other, differencing))
            return x[2], x[3], text, len(text), x[4], x[6]

        held: list[tuple] = []
        before = now = None

        def batch() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=["page_id", "url", "text", "n_chars", "host", "copied"])
            held.clear()
            return out

        for after in rows():
            if now is not None and not now[1]:
                held.append(result(now, before, after))
                if len(held) >= 500:
                    yield batch()
            before, now = now, after
        if now is not None and not now[1]:
            held.append(result(now, before, None))
        if held:
            yield batch()

    dealt = keyed.select("page_id", "url", "html", "host", "path", "copied").mapInArrow(deal, _DEALT).repartition(n, "bucket")
    rows = dealt.sortWithinPartitions("bucket", "host", "path", "page_id")
    return rows.mapInArrow(walk, "page_id long, url string, text string, n_chars long, host string, copied long")
