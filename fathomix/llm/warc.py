"""WARC archives: writing, reading, and revisit resolution.

``write_archives`` writes one response record per page, each a gzip member of its own, where the
pages are read, and gives the records' headers with their places.  ``resolve`` shuffles headers
by payload digest (never payloads), finds the original of each digest, joins the others to it,
and rewrites the archives shard by shard: originals keep their payload under fresh headers,
repeats become revisit records that refer to the original.  ``read_archives`` reads archives back.

Defined cases: null html is an empty payload; payloads below ``least`` bytes are never resolved;
of equal payloads the smallest page_id is the original (of rows repeating that page_id one only,
the first in the archives); a null page_id sorts last and is written as the empty id; an empty
table gives no archives; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_fs, bound_batches, materialise

HEADERS = "shard string, at long, size long, page_id long, payload_bytes long, payload_digest string"
_NAMES = ["shard", "at", "size", "page_id", "payload_bytes", "payload_digest"]
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
_SPACE = uuid.UUID("7d5f1c1e-0a4b-5b52-9f5e-2f6a3f0c9b11")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(kind: str, page: str, place: str) -> str:
    """A record's URN; the same record written again has the same one."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{kind}|{page}|{place}')}>"


def record(kind: str, page: str, uri: str, digest: str, payload: bytes, place: str, date: str, extra: list[tuple[str, str]] | None = None) -> bytes:
    """One WARC/1.1 record; a response's block is an HTTP message with the payload, a revisit's
    only the HTTP head."""
    size = [f"Content-Length: {len(payload)}"] if kind == "response" else []
    http = "\r\n".join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", *size, "", ""]).encode()
    block = http + payload if kind == "response" else http
    head = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, page, place)), ("WARC-Date", date),
        ("WARC-Target-URI", uri.replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-ID", page),
        *(extra or []), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of an inflated record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _deflate(raw: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class _Shard:
    """An archive being written under a name of its task's attempt, renamed when complete."""

    def __init__(self, root: str, name: str):
        self.fs, base = arrow_fs(root)
        self.fs.create_dir(base, recursive=True)
        self.name, self.at = name, 0
        self.temp, self.final = f"{base}/{name}.{TaskContext.get().taskAttemptId()}", f"{base}/{name}"
        self.sink = self.fs.open_output_stream(self.temp, buffer_size=1 << 20)

    def add(self, data: bytes) -> tuple[int, int]:
        self.sink.write(data)
        at, self.at = self.at, self.at + len(data)
        return at, len(data)

    def close(self) -> None:
        self.sink.close()
        self.fs.move(self.temp, self.final)


def _batches(rows: Iterator[tuple], names: list[str], kinds: list, size: int = 5000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)
        held.clear()
        return out

    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield flush()
    if held:
        yield flush()


def write_archives(pages: DataFrame, out: str, date: str = "2024-01-01T00:00:00Z", level: int = 1) -> DataFrame:
    """Write pages (page_id, url, html) as response records below the URI out, one archive per
    input split; gives the headers as a table.  No shuffle."""

    bound_batches(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            shard = None
            for b in batches:
                for page, url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                    shard = shard or _Shard(out, f"crawl-{TaskContext.get().partitionId():06d}.warc.gz")
                    payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                    digest = hashlib.sha256(payload).hexdigest()
                    raw = record("response", "" if page is None else str(page), url or "", digest, payload, f"{shard.name}:{shard.at}", date)
                    yield (shard.name, *shard.add(_deflate(raw, level)), page, len(payload), digest)
            if shard:
                shard.close()

        yield from _batches(rows(), _NAMES, _KINDS)

    return materialise(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(write, HEADERS), "warc-headers")


def revisits(headers: DataFrame, least: int = 100, salts: int = 32) -> DataFrame:
    """headers with o_page, o_shard, o_at of the original; null for originals themselves.

    The original of each digest is an aggregate with map-side minima.  Headers then join the
    digests that repeat; these are few rows wide and dealt over ``salts`` keys each, so a digest
    that a third of all pages have is spread too.
    """
    large = headers.filter(F.col("payload_bytes") >= least)
    first = (
        large.groupBy("payload_digest")
        .agg(F.min(F.struct(F.col("page_id").isNull().alias("n"), "page_id", "shard", "at")).alias("o"), F.count("*").alias("k"))
        .filter("k > 1")
        .select("payload_digest", F.col("o.page_id").alias("o_page"), F.col("o.shard").alias("o_shard"), F.col("o.at").alias("o_at"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    )
    own = headers.withColumn("_salt", F.pmod(F.xxhash64("shard", "at"), F.lit(salts)).cast("int"))
    out = own.join(first, ["payload_digest", "_salt"], "left").drop("_salt")
    repeat = (F.col("payload_bytes") >= least) & F.col("o_shard").isNotNull() & ~((F.col("o_shard") == F.col("shard")) & (F.col("o_at") == F.col("at")))
    return out.select(*headers.columns, *(F.when(repeat, F.col(c)).alias(c) for c in ("o_page", "o_shard", "o_at")))


def resolve(headers: DataFrame, crawl: str, out: str, least: int = 100, date: str = "2024-01-02T00:00:00Z", level: int = 1) -> DataFrame:
    """Rewrite the archives below crawl into deduplicated ones below out, shard by shard; gives
    one row (shard, records) per archive.

    Only headers are shuffled.  A task streams its archive in record order and never holds more
    than one payload; its list of records is what one input split has.
    """
    spark = headers.sparkSession
    plan = revisits(headers, least)
    shards = headers.select("shard").distinct().count()
    if not shards:
        return spark.createDataFrame([], "shard string, records long")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            fs, base = arrow_fs(crawl)
            shard = source = name = None
            n = 0
            for b in batches:
                for s, at, size, page, digest, o_page, o_shard, o_at in zip(*(c.to_pylist() for c in b.columns)):
                    if s != name:
                        if shard:
                            shard.close()
                            source.close()
                            yield name, n
                        name, n = s, 0
                        shard, source = _Shard(out, s.replace("crawl-", "dedup-")), fs.open_input_file(f"{base}/{s}")
                    fields, payload = parse(zlib.decompress(source.read_at(size, at), 31))
                    key, uri, n = "" if page is None else str(page), fields["WARC-Target-URI"], n + 1
                    if o_shard is None:
                        raw = record("response", key, uri, digest, payload, f"{s}:{at}:fresh", date)
                    else:
                        first = "" if o_page is None else str(o_page)
                        extra = [("WARC-Refers-To", record_id("response", first, f"{o_shard}:{o_at}:fresh")), ("WARC-Profile", PROFILE), ("X-Refers-To-Page", first), ("X-Payload-Bytes", str(len(payload)))]
                        raw = record("revisit", key, uri, digest, b"", f"{s}:{at}:fresh", date, extra)
                    shard.add(_deflate(raw, level))
            if shard:
                shard.close()
                source.close()
                yield name, n

        yield from _batches(rows(), ["shard", "records"], [pa.string(), pa.int64()])

    dealt = plan.select("shard", "at", "size", "page_id", "payload_digest", "o_page", "o_shard", "o_at").repartition(shards, "shard").sortWithinPartitions("shard", "at")
    return materialise(dealt.mapInArrow(rewrite, "shard string, records long"), "warc-shards")


RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, refers_to_record string, record_id string"


def read_archives(spark: SparkSession, folder: str, names: DataFrame, block: int = 1 << 20) -> DataFrame:
    """Every record of the archives that names (column shard) lists below folder.

    One task per archive; it is inflated member by member from blocks of ``block`` bytes.  A
    response's size and digest are those of the payload read, a revisit's those it states.
    """
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
    columns = [x.split()[0] for x in RECORDS.split(", ")]

    def members(f) -> Iterator[bytes]:
        data, z, parts = b"", None, []
        while True:
            if not data:
                data = f.read(block)
                if not data:
                    break
            z = z or zlib.decompressobj(31)
            parts.append(z.decompress(data))
            data = b""
            if z.eof:
                yield b"".join(parts)
                data, z, parts = z.unused_data, None, []
        if parts:
            raise ValueError("a record ends early")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            fs, base = arrow_fs(folder)
            for b in batches:
                for name in b.column(0).to_pylist():
                    with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                        for raw in members(f):
                            h, payload = parse(raw)
                            page = int(h["X-Page-ID"]) if h["X-Page-ID"] else None
                            if h["WARC-Type"] == "revisit":
                                first = h["X-Refers-To-Page"]
                                yield page, h["WARC-Target-URI"], "revisit", int(h["X-Payload-Bytes"]), h["WARC-Payload-Digest"].partition(":")[2], int(first) if first else None, h["WARC-Refers-To"], h["WARC-Record-ID"]
                            else:
                                yield page, h["WARC-Target-URI"], h["WARC-Type"], len(payload), hashlib.sha256(payload).hexdigest(), None, None, h["WARC-Record-ID"]

        yield from _batches(rows(), columns, kinds)

    n = max(1, names.count())
    return names.select("shard").repartition(n, "shard").mapInArrow(read, RECORDS)


def deduplicate(pages: DataFrame, folder: str, least: int = 100) -> DataFrame:
    """Write pages as archives below folder/crawl, resolve them into folder/dedup, read these."""
    headers = write_archives(pages, f"{folder}/crawl")
    shards = resolve(headers, f"{folder}/crawl", f"{folder}/dedup", least)
    return read_archives(pages.sparkSession, f"{folder}/dedup", shards.select(F.regexp_replace("shard", "^crawl-", "dedup-").alias("shard")))
