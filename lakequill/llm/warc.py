"""WARC archives with a two-level capture index.

write() turns pages into WARC 1.1 records, one gzip member each, and identical payloads into revisit records. Tasks write
files of their own names and return where each record lies; only what a successful task returned is known to the index, so
a lost executor leaves unused files, never wrong entries. The index sorts captures by reversed-host URL key into compressed
blocks. Its upper level has a line for each index shard, its lower level a sparse directory of the shard's blocks. Readers
bisect both for the blocks that hold their keys; the blocks found are dealt out in as many partitions as the archive's bytes
ask for, and a task reads one range for a block and one for each record. A key with very many captures fills many blocks, and
so many tasks.

Defined results: a null html is an empty payload, a null url has the key '' and no target URI, a null page_id an id without
number; rows that repeat page_id and payload are all response (they refer to nothing smaller); empty tables make an index
without shards. Payloads of any length are written whole; tasks hold a record and a batch of BATCH_BYTES. Other columns are
not read.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakequill.llm.common import BATCH_BYTES, FileWriter, RangeReader, Store, table

MIN_REVISIT, BLOCK_LINES = 100, 256
#: Bytes of records that a reading task is given on average.
READ_BYTES = 64 << 20
_RECORD = "file long, offset long, length long"
_GZIP = 31


def escaped(url: str) -> str:
    """As a header can hold it."""
    return re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url)


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed and joined by commas, then path and query."""
    url = escaped(url or "")
    m = re.match(r"[^:/?#]*://([^/?#]*)([^#]*)", url)
    if not m:
        return url
    return ",".join(reversed(m[1].lower().split("."))) + ")" + (m[2] or "/")


def _compress(data: bytes, wbits: int) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, wbits)
    return c.compress(data) + c.flush()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """A response, or a revisit that names the response it refers to, and whose HTTP headers still tell the payload's length."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + payload if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + escaped(url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        if refers_url is not None:
            lines.append("WARC-Refers-To-Target-URI: " + escaped(refers_url))
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(member: bytes) -> tuple[dict[str, str], int, bytes]:
    """Headers of the record, length of the payload, and the payload (empty for a revisit)."""
    data = zlib.decompress(member, _GZIP)
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(headers["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return headers, int(re.search(rb"Content-Length: (\d+)", http)[1]), payload


def _payload() -> F.Column:
    return F.coalesce(F.col("html"), F.lit("")).cast("string")


class Archive:
    """A written archive, read through its index. shards: (first key, last key, directory file) of each index shard."""

    def __init__(self, spark: SparkSession, root: str, shards: list[tuple[str, str, int]], n_blocks: int, n_bytes: int):
        self.spark, self.root, self.shards = spark, root, sorted(shards)
        self.parts = max(1, min(n_blocks, max(2 * spark.sparkContext.defaultParallelism, n_bytes // READ_BYTES)))

    def captures(self, low: str | None = None, high: str | None = None, payload: bool = True) -> DataFrame:
        """Every capture whose key lies in [low, high), read back from its record: key, page_id, its measures and payload."""
        root, ends = self.root, [s[1] for s in self.shards]
        wanted = self.shards[0 if low is None else bisect.bisect_left(ends, low) :]
        wanted = [(name,) for first, _, name in wanted if high is None or first < high]

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = RangeReader(f"{root}/index", "directory")
            for b in batches:
                for name in b.column(0).to_pylist():
                    blocks = _directory(index, name)
                    i = 0 if low is None else bisect.bisect_left(blocks, low, key=lambda x: x[1])
                    j = len(blocks) if high is None else bisect.bisect_left(blocks, high, key=lambda x: x[0])
                    yield _asked([(None, *x[2:]) for x in blocks[i:j]])

        shards = self.spark.createDataFrame(wanted, "directory long").repartition(max(1, len(wanted)))
        return self._read(shards.mapInArrow(find, f"key string, {_RECORD}"), payload, low, high)

    def lookup(self, urls: DataFrame, payload: bool = True) -> DataFrame:
        """Captures of the given urls (a column url). Queries are sorted by key, so that a task stays in few shards."""
        root, shards = self.root, self.shards
        key = F.udf(url_key, "string")

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, ends = RangeReader(f"{root}/index", "directory"), [s[1] for s in shards]

            @lru_cache(maxsize=8)
            def directory(name: int) -> list[list]:
                return _directory(index, name)

            for b in batches:
                out = []
                for k in b.column(0).to_pylist():
                    for first, _, name in shards[bisect.bisect_left(ends, k) :]:
                        if first > k:
                            break
                        blocks = directory(name)
                        i = bisect.bisect_left(blocks, k, key=lambda x: x[1])
                        while i < len(blocks) and blocks[i][0] <= k:
                            out.append((k, *blocks[i][2:]))
                            i += 1
                yield _asked(out)

        keys = urls.select(key("url").alias("key")).distinct()
        return self._read(keys.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(find, f"key string, {_RECORD}"), payload)

    def _read(self, asked: DataFrame, payload: bool, low: str | None = None, high: str | None = None) -> DataFrame:
        """The captures of a key in a block; all of the block in [low, high) where the key is null."""
        root, schema = self.root, _CAPTURE + (", payload binary" if payload else "")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, data = RangeReader(f"{root}/index", "blocks"), RangeReader(f"{root}/data", "warc.gz")
            at, lines = None, []
            for b in batches:
                for row in b.to_pylist():
                    if at != (row["file"], row["offset"]):
                        at = row["file"], row["offset"]
                        lines = [json.loads(x) for x in zlib.decompress(index.read(*at, row["length"])).decode().split("\n")]
                    k = row["key"]
                    lo, hi = (low, high) if k is None else (k, k + "\0")
                    i = 0 if lo is None else bisect.bisect_left(lines, lo, key=lambda x: x[0])
                    j = len(lines) if hi is None else bisect.bisect_left(lines, hi, key=lambda x: x[0])
                    yield from _records(data, lines[i:j], payload)

        dealt = asked.repartition(self.parts, "file", "offset").sortWithinPartitions("file", "offset", "key")
        return dealt.mapInArrow(run, schema)

    def resolved(self, captures: DataFrame) -> DataFrame:
        """captures, in which revisits have the payload of the response they refer to, looked up by its URL."""
        again = captures.where("record_type = 'revisit'")
        firsts = self.lookup(again.select(F.col("refers_url").alias("url"))).where("record_type = 'response'")
        firsts = firsts.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.first("payload").alias("payload"))
        return captures.where("record_type <> 'revisit'").unionByName(again.drop("payload").join(firsts, ["refers_to", "payload_digest"]))


_CAPTURE = "key string, page_id long, record_type string, refers_to long, refers_url string, payload_bytes long, payload_digest string"


def _directory(index: RangeReader, name: int) -> list[list]:
    """(first key, last key, file, offset, length) of each block of a shard."""
    return json.loads(zlib.decompress(index.whole(name)))


def _asked(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["key", "file", "offset", "length"])


def _records(data: RangeReader, lines: list[list], with_payload: bool) -> Iterator[pa.RecordBatch]:
    """Checked records in batches of BATCH_BYTES, one record at least."""
    number = lambda x: int(m[1]) if x and (m := re.search(r"(-?\d+)>$", x)) else None
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), *([pa.binary()] if with_payload else [])]
    names = [x.split()[0] for x in _CAPTURE.split(", ")] + ["payload"] * with_payload
    rows, size = [], 0
    for k, (key, name, offset, length) in enumerate(lines):
        headers, n, payload = parse(data.read(name, offset, length))
        digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha256:"), headers["WARC-Type"]
        if kind == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"damaged record in {name} at {offset}")
        rows.append((key, number(headers["WARC-Record-ID"]), kind, number(headers.get("WARC-Refers-To")), headers.get("WARC-Refers-To-Target-URI"), n, digest, *([payload] if with_payload else [])))
        size += len(payload) if with_payload else 0
        if size >= BATCH_BYTES or k == len(lines) - 1:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)
            rows, size = [], 0


def write(pages: DataFrame, store: Store, min_revisit: int = MIN_REVISIT, block_lines: int = BLOCK_LINES) -> Archive:
    """Write archive and index under the store's folder."""
    root = store.path("warc")
    digest = F.sha2(_payload(), 256)
    marks = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), digest.alias("digest"), F.octet_length(_payload()).alias("n"))
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first")
    least = marks.where(F.col("n") >= min_revisit).groupBy("digest").agg(first, F.count("*").alias("rows")).where("rows > 1").select("digest", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url"))
    revisits = marks.select("page_id", "digest").join(least, "digest").where("page_id > first").select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "first", "first_url").distinct()
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), _payload().alias("html"), digest.alias("digest"))
    rows = rows.join(revisits, (F.col("page_id") == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left").select("page_id", "url", "html", "digest", "first", "first_url")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = FileWriter(f"{root}/data", "warc.gz")
        for b in batches:
            made = []
            for page_id, url, html, sha, first, first_url in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = record(page_id, url, html.encode("utf-8", "surrogatepass"), sha, first, first_url)
                made.append((url_key(url), page_id, *out.write(_compress(data, _GZIP))))
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate(types)], names=["key", "page_id", "file", "offset", "length"])
        out.close()

    entries = store.save(rows.mapInArrow(put, f"key string, page_id long, {_RECORD}"), "entries")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, held, out, n = [], [], FileWriter(f"{root}/index", "blocks"), 0

        def flush() -> None:
            data = "\n".join(json.dumps([k, f, o, n]) for k, _, f, o, n in held).encode()
            blocks.append((held[0][0], held[-1][0], *out.write(_compress(data, 15))))
            held.clear()

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(row)
                n += row[4]
                if len(held) >= block_lines:
                    flush()
        if held:
            flush()
        out.close()
        if blocks:
            lower = FileWriter(f"{root}/index", "directory")
            name, _, _ = lower.write(_compress(json.dumps(blocks).encode(), 15))
            lower.close()
            row = [blocks[0][0], blocks[-1][1], name, len(blocks), n]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["first_key", "last_key", "directory", "blocks", "bytes"])

    sorted_entries = entries.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    shards = store.save(sorted_entries.mapInArrow(build, "first_key string, last_key string, directory long, blocks long, bytes long"), "shards")
    # the upper level: a row for each index shard, as many as the index has partitions
    upper = shards.collect()
    return Archive(store.spark, root, [(r[0], r[1], r[2]) for r in upper], sum(r[3] for r in upper), sum(r[4] for r in upper))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written, and the captures of every page's url looked up in the index and read back."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = write(pages, Store(spark, "warc")).lookup(pages.select("url"), payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha256(html) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY digest)
SELECT d.page_id, d.n::BIGINT AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN d.page_id > f.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN d.page_id > f.first THEN f.first END AS refers_to
FROM d LEFT JOIN f ON d.digest = f.digest
"""
