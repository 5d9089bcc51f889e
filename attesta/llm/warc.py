"""WARC archives: a writer of gzipped records, and a splittable reader.

The reader's tasks each scan a byte range for the gzip magic, take a candidate for a member only
if its header decodes and a record's version line follows, and own the records that start inside
their range, reading past its end where a record does. So an archive is read by as many tasks as
it has ranges, without an index.

Archives of other writers are read too: records of every type (warcinfo, request, metadata, ...: the
payload is the block, or what follows its HTTP headers), header names in any case, folded header
lines, lines that end without CR, chunked bodies, records without a payload digest (it is computed;
null for a revisit). A member that does not decode to its end, a record that cannot be parsed and a
payload that differs from its SHA-1 are rows whose `error` says so; reading goes on after them.
Bytes between members that begin no record are passed over. Digests by other functions are not checked.

Equal payloads are one response and revisits of it: of the rows with one digest, those with the
largest page id are responses. Digests meet their largest id in a partial aggregation, so that a
payload held by a third of all rows is no hot group, and rows meet the leaders in an equi-join
whose skewed side Spark can split.

Archives go to the shared folder through the file system that its address names; a task writes
files of its own under a fresh name, and only files that the finished task reports are read.

Cases: null html is an empty payload. Null page ids are written without one and read back as null;
a group whose ids are all null has no leader and is written as responses. Rows that repeat the
largest page id are all responses. A table without rows gives archives without records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.tables import read, shared_dir, written

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/"
READ = 1 << 20


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, date="2024-01-01T00:00:00Z") -> bytes:
    """One gzip member with a response record, or with a revisit record that has the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest)}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}"]
    if url:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def leaders(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with refers_to: the largest page id of an equal payload, for all rows but its own."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", "html").withColumn("digest", F.sha1(payload))
    # the copies of one payload meet as one row of each task
    groups = rows.filter(F.octet_length(F.coalesce("html", F.lit(""))) >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("leader"), F.count("*").alias("n")).filter("n > 1").select("digest", "leader")
    groups = written(groups, "leaders")
    rows = rows.join(groups, "digest", "left")
    return rows.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("leader")), F.col("leader")).alias("refers_to"))


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and the path of an address in one of the forms that Hadoop writes."""
    return pa.fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", re.sub("^s3[an]://", "s3://", uri)))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes archives under folder; returns their (path, bytes, records), a written table."""
    kind = "path string, bytes bigint, records bigint"

    def run(batches):
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        name, out, size, n = f"{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            ids, urls, htmls, refs = (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                if out is None:
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                payload = (htmls[i].as_py() or "").encode()
                got = record(ids[i].as_py(), urls[i].as_py(), payload, base32_sha1(payload), refs[i].as_py())
                out.write(got)
                size, n = size + len(got), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["path", "bytes", "records"])

    return written(pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, kind), "archives")


class Range:
    """Bytes of an archive from a place on, read piece by piece as they are needed."""

    def __init__(self, source, start: int, size: int):
        self.source, self.at, self.size, self.buf = source, start, size, b""  # buf begins at `at`

    def more(self) -> bool:
        left = self.size - self.at - len(self.buf)
        if left <= 0:
            return False
        self.source.seek(self.at + len(self.buf))
        self.buf += self.source.read(min(READ, left))
        return True

    def skip(self, n: int) -> None:
        if n:
            self.at, self.buf = self.at + n, self.buf[n:]


def _begins(data: bytes) -> bool:
    """Does a gzip member with a WARC record begin here?"""
    try:
        return zlib.decompressobj(31).decompress(data, 64).startswith(VERSION)
    except zlib.error:
        return False


def members(source, start: int, end: int, size: int):
    """(offset, decoded bytes, None) of the records that start in start..end-1; (offset, None, error) where one does not decode."""
    r = Range(source, start, size)
    while r.at < end:
        found = r.buf.find(MAGIC)
        if found < 0:
            r.skip(max(0, len(r.buf) - 2))
            if not r.more():
                return
            continue
        r.skip(found)
        while len(r.buf) < 4096 and r.more():
            pass
        if r.at >= end:
            return
        if not _begins(r.buf[:4096]):
            r.skip(1)
            continue
        unpack, out, fed = zlib.decompressobj(31), [], 0
        try:
            while not unpack.eof:
                if fed == len(r.buf) and not r.more():
                    raise EOFError("the archive ends within the record")
                out.append(unpack.decompress(r.buf[fed:]))
                fed = len(r.buf)
        except (zlib.error, EOFError) as e:
            yield r.at, None, str(e)
            r.skip(1)
            continue
        yield r.at, b"".join(out), None
        r.skip(len(r.buf) - len(unpack.unused_data))


HEAD_END = re.compile(rb"\r?\n\r?\n")


def _headers(data: bytes) -> tuple[str, dict[str, str], bytes]:
    """First line, fields by lower-case name (the first of each; folded lines joined) and what follows the blank line."""
    end = HEAD_END.search(data)
    head, rest = (data[: end.start()], data[end.end() :]) if end else (data, b"")
    first, *lines = re.split(r"\r?\n", re.sub(r"\r?\n[ \t]+", " ", head.decode("utf-8", "replace")))
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if colon:
            fields.setdefault(name.strip().lower(), value.strip())
    return first, fields, rest


def _unchunked(body: bytes) -> bytes:
    """The body of a message sent in chunks; one that is cut short, or is not in chunks, raises."""
    out, at = [], 0
    while True:
        end = body.index(b"\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        if end + 1 + size > len(body):
            raise ValueError("a chunk is cut short")
        out.append(body[end + 1 : end + 1 + size])
        at = body.index(b"\n", end + 1 + size) + 1


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields (both by lower-case name) and the payload as it is stored."""
    _, fields, rest = _headers(data)
    length = int(fields["content-length"])
    if length > len(rest):
        raise ValueError("the block is shorter than its Content-Length")
    block = rest[:length]
    if not fields.get("content-type", "").lower().startswith("application/http"):
        return fields, {}, block
    _, http, payload = _headers(block)
    return fields, http, payload


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d{1,18})>", name or "")
    return int(found[1]) if found else None


def row(data: bytes) -> tuple:
    """What scan() returns of one record, after its place."""
    fields, http, payload = parse(data)
    kind, digest, error = fields.get("warc-type", "").lower() or None, fields.get("warc-payload-digest"), None
    if kind == "revisit":
        known = http.get("content-length", "")
        payload, size = None, int(known) if re.fullmatch(r"\d{1,18}", known) else None
    else:
        # archives digest a chunked body as it was sent or put together
        plain = _unchunked(payload) if http.get("transfer-encoding", "").lower() == "chunked" else payload
        if digest is None:
            digest = "sha1:" + base32_sha1(plain)
        elif digest[:5].lower() == "sha1:" and digest[5:].upper() not in {base32_sha1(payload), base32_sha1(plain)}:
            error = "the payload does not match its digest"
        payload, size = plain, len(plain)
    if digest is not None and digest[:5].lower() == "sha1:":
        digest = digest[5:].upper()
    return (_page(fields.get("warc-record-id")), fields.get("warc-target-uri"), payload, size, digest, kind, _page(fields.get("warc-refers-to")), fields.get("warc-record-id"), error)


SCHEMA = "path string, offset bigint, page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, record_id string, error string"


def scan(archives: DataFrame, split_bytes: int = 4 << 20, most_tasks: int = 100_000) -> DataFrame:
    """One row for each record of archives (path, bytes), with error where it is damaged; a task for each range, up to most_tasks."""
    ranges = archives.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.col("bytes") - 1), F.lit(split_bytes).cast("long"))).alias("start"))
    # a number of partitions that the planner keeps: rows of ranges are small, the bytes behind them are not
    n_ranges = archives.agg(F.coalesce(F.sum(F.ceil(F.col("bytes") / F.lit(split_bytes))), F.lit(0))).first()[0]
    ranges = ranges.repartition(max(1, min(n_ranges, most_tasks)))

    def run(batches):
        for batch in batches:
            for path, size, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                fs, at = file_system(path)
                rows, held = [], 0
                with fs.open_input_file(at) as source:
                    for offset, data, error in members(source, start, min(size, start + split_bytes), size):
                        try:
                            got = row(data) if error is None else (None,) * 8 + (error,)
                        except (KeyError, ValueError) as e:
                            got = (None,) * 8 + (f"not a record: {e}",)
                        rows.append((path, offset, *got))
                        held += len(data or b"")
                        if held > READ:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return ranges.mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])


def query(spark, sf_dir):
    pages = leaders(read(spark, sf_dir, "pages"))
    archives = write(pages, f"{shared_dir(spark)}/attesta-{uuid.uuid4().hex}/warc")
    # its own archives have no damaged records: one ends the job
    digest = F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(" ", "path", F.col("offset").cast("string"), "error"))).otherwise(F.col("payload_digest"))
    return scan(archives).select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
b AS (SELECT i, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', i + 1, 1) AS c FROM range(32) r(i)),
g AS (SELECT html, max(page_id) AS leader, sha1(html) AS hex FROM p GROUP BY html),
h AS (SELECT html, leader, hex, k, ('0x' || substr(hex, 5 * k + 1, 5))::INT AS v FROM g, range(8) r(k)),
d AS (
  SELECT html, any_value(leader) AS leader, string_agg(
    (SELECT c FROM b WHERE i = v // 32768) || (SELECT c FROM b WHERE i = v // 1024 % 32) || (SELECT c FROM b WHERE i = v // 32 % 32) || (SELECT c FROM b WHERE i = v % 32), '' ORDER BY k) AS digest
  FROM h GROUP BY html
)
SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN p.page_id = d.leader THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id <> d.leader THEN d.leader END AS refers_to
FROM p JOIN d USING (html)
"""
