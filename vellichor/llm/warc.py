"""WARC archives: writing captures, reading records, and assembling the records of a transaction.

write_warc() turns each page into a transaction of three records: a request and a metadata record, both concurrent to a
response, or to a revisit where a page with an equal payload and a larger id is the response. Records are built as
strings by Spark's own expressions and written by its text writer, whose line separator is the blank lines that end a
record, so the commit protocol, any file system that Spark writes and lost tasks are Spark's affair. An archive is as
large as Spark's partition, compressed as a whole (one gzip member; the names end in .txt.gz).

read_warc() reads archives of this or any other writer (plain, one member, or a member a record), a file a row, inflated
and parsed as a stream. captures() joins request, response and metadata records by their concurrent-to identifiers, in
whichever of the two records they are written, also where a metadata record names only the request, and emits one nested
row per capture. resolved() finds the responses that revisits repeat by their payload digests.

Scale: leading pages are a combined maximum by payload digest, joined back on a unique key, so a digest with any share
of the pages is a skewed side that Spark splits, or a small table that it broadcasts by its measured size. In the
assembly only identifiers move until a record knows its capture; payloads move once, by a unique key. Of any number of
records concurrent to one response the first of each kind joins it, found by a combined minimum; nothing is collected.

Defined results: null html is an empty payload; a null or empty url gives no WARC-Target-URI; blanks and line ends in a
url are percent-encoded; a null page_id is left out of the metadata and is a revisit where another page has an equal
payload; repeated rows are captures of their own, and rows that share the largest id of a payload are all responses;
payloads are equal if SHA-1 and a 64-bit hash are. Records of an unreadable rest of a file are replaced by one record
with an error. A request or metadata record that names nothing known, or that is not the first of its kind, is a capture
of its own without a response. Extra columns are not read; an empty table gives archives without records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellichor.session import shared_dir, staged

END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"  # of every capture, unless the caller has another
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK, FLUSH = 1 << 20, 4 << 20
ANCHORS, MEMBERS = ("response", "revisit", "resource"), ("request", "metadata")
RECORD = "file string, offset long, type string, record_id string, date string, target_uri string, concurrent_to array<string>, headers map<string,string>, fields map<string,string>, http_status int, payload_bytes long, payload_digest string, payload binary, error string"


# writing ----------------------------------------------------------------------------------------------------------


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a hex string of 40 digits, by 20 bits at a time."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _header(name: str, value: Column) -> Column:
    """A header line; nothing where the value is null or empty."""
    return F.when(F.coalesce(value, F.lit("")) == "", "").otherwise(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")))


def _record(block: Column, **headers: Column | str) -> Column:
    lines = [_header(k.replace("_", "-"), F.lit(v) if isinstance(v, str) else v) for k, v in headers.items()]
    return F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def write_warc(pages: DataFrame, path: str, least: int = 0, date: str = DATE) -> None:
    """Archives of pages (page_id, url, html) under path. Of equal payloads of at least `least` bytes the page with the largest id is the response; the others revisit it."""
    uri = F.col("url").cast("string")
    for char, code in (("\r", "%0D"), ("\n", "%0A"), ("\t", "%09"), (" ", "%20")):
        uri = F.replace(uri, F.lit(char), F.lit(code))
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), uri.alias("uri"), html.alias("html")).withColumn("sha1", F.sha1("html")).withColumn("hash", F.xxhash64("html"))
    firsts = rows.filter(F.octet_length("html") >= least).groupBy("sha1", "hash").agg(F.max(F.struct("page_id", "uri")).alias("first"), F.count("*").alias("copies")).filter("copies > 1 and first.page_id is not null").drop("copies")
    rows = rows.join(firsts, ["sha1", "hash"], "left").withColumn("repeats", F.expr("first is not null and not page_id <=> first.page_id"))
    name = lambda: F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">"))
    rows = rows.withColumn("id", name()).withColumn("request_id", name()).withColumn("metadata_id", name())

    digest = F.concat(F.lit("sha1:"), base32(F.col("sha1")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(END))
    shared = {"WARC_Date": date, "WARC_Target_URI": F.col("uri"), "WARC_Payload_Digest": digest}
    response = _record(F.concat(http, "html"), WARC_Type="response", WARC_Record_ID=F.col("id"), **shared, Content_Type="application/http; msgtype=response")
    revisit = _record(http, WARC_Type="revisit", WARC_Record_ID=F.col("id"), **shared, WARC_Profile=PROFILE, WARC_Refers_To_Target_URI=F.col("first.uri"), WARC_Refers_To_Date=date, Content_Type="application/http; msgtype=response")
    after = F.regexp_extract(F.coalesce("uri", F.lit("")), r"^[^:/?#]*://([^/?#]*)([^#]*)", 2)
    host = F.regexp_extract(F.coalesce("uri", F.lit("")), r"^[^:/?#]*://([^/?#]*)", 1)
    line = F.concat(F.lit("GET "), F.when(after.startswith("/"), after).otherwise(F.concat(F.lit("/"), after)), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END))
    about = {"WARC_Date": date, "WARC_Target_URI": F.col("uri"), "WARC_Concurrent_To": F.col("id")}
    request = _record(line, WARC_Type="request", WARC_Record_ID=F.col("request_id"), **about, Content_Type="application/http; msgtype=request")
    metadata = _record(_header("page_id", F.col("page_id").cast("string")), WARC_Type="metadata", WARC_Record_ID=F.col("metadata_id"), **about, Content_Type="application/warc-fields")
    records = rows.select(F.explode(F.array(request, F.when(F.col("repeats"), revisit).otherwise(response), metadata)).alias("value"))
    records.write.option("lineSep", END).option("compression", "gzip").text(path)


# reading ----------------------------------------------------------------------------------------------------------


def _inflated(data: memoryview) -> Iterator[bytes]:
    """The bytes of an archive, member by member, in pieces of bounded size."""
    if bytes(data[:2]) != b"\x1f\x8b":
        for at in range(0, len(data), CHUNK):
            yield bytes(data[at : at + CHUNK])
        return
    at, rest, member = 0, b"", zlib.decompressobj(31)
    while rest or at < len(data):
        if not rest:
            rest, at = bytes(data[at : at + CHUNK]), at + CHUNK
        if member.eof:
            member = zlib.decompressobj(31)
        yield member.decompress(rest, FLUSH)
        rest = member.unused_data if member.eof else member.unconsumed_tail
    while not member.eof and (more := member.decompress(member.unconsumed_tail, FLUSH)):
        yield more
    if not member.eof:
        raise ValueError("the last member is cut off")


class Stream:
    """Reads a given number of bytes, or up to a mark, of pieces."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.at, self.offset = pieces, bytearray(), 0, 0

    def more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        if self.at > FLUSH:
            del self.held[: self.at]
            self.at = 0
        self.held += piece
        return True

    def exactly(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            if not self.more():
                raise ValueError("a record is cut off")
        out = bytes(memoryview(self.held)[self.at : self.at + n])
        self.at += n
        self.offset += n
        return out

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the file."""
        seen = self.at
        while (end := self.held.find(b"\n", seen)) < 0:
            seen = max(self.at, len(self.held))
            left, before = seen - self.at, self.at
            if not self.more():
                return self.exactly(left) if left else None
            seen += self.at - before
        return self.exactly(end + 1 - self.at).rstrip(b"\r\n")


def _named(lines: Iterator[bytes]) -> list[tuple[str, str]]:
    """(lower-case name, value) of header lines; a line that begins with a blank goes on with the one before."""
    out: list[tuple[str, str]] = []
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in " \t" and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {text.strip()}".strip())
        else:
            name, _, value = text.partition(":")
            out.append((name.strip().lower(), value.strip()))
    return out


def parsed(data: memoryview) -> Iterator[dict]:
    """Records of one archive, in order; one with an error if the rest can't be read."""
    stream = Stream(_inflated(data))
    offset = 0
    try:
        while True:
            offset = stream.offset
            line = stream.line()
            if line is None:
                return
            if not line:
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError("no record begins here")
            head = _named(iter(stream.line, b""))
            named = dict(reversed(head))  # the first of a repeated name
            block = stream.exactly(int(named["content-length"]))
            yield _fields(offset, head, named, block)
    except (ValueError, KeyError, TypeError, AttributeError, zlib.error) as x:
        yield {"offset": offset, "error": f"{type(x).__name__}: {x}"}


def _fields(offset: int, head: list[tuple[str, str]], named: dict[str, str], block: bytes) -> dict:
    kind, status, fields = named.get("content-type", "").lower(), None, None
    if kind.startswith("application/http"):
        top, _, block = block.partition(b"\r\n\r\n")
        first = top.split(b"\r\n", 1)[0].split(b" ")
        status = int(first[1]) if first[0].startswith(b"HTTP/") and len(first) > 1 and first[1].isdigit() else None
    elif kind.startswith("application/warc-fields"):
        fields = _named(x for x in block.splitlines() if x)
    return {
        "offset": offset, "type": named.get("warc-type"), "record_id": named.get("warc-record-id"), "date": named.get("warc-date"), "target_uri": named.get("warc-target-uri"), "concurrent_to": [v for k, v in head if k == "warc-concurrent-to"],
        "headers": list(named.items()), "fields": fields and list(dict(reversed(fields)).items()), "http_status": status, "payload_bytes": len(block), "payload_digest": base64.b32encode(hashlib.sha1(block).digest()).decode(), "payload": block,
    }


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives under path (RECORD); payload is the block, of HTTP messages their body, and null unless payloads."""
    schema = spark.createDataFrame([], RECORD).schema
    arrow = pa.schema([("file", pa.string()), ("offset", pa.int64()), *((c, pa.string()) for c in ("type", "record_id", "date", "target_uri")), ("concurrent_to", pa.list_(pa.string())), ("headers", pa.map_(pa.string(), pa.string())), ("fields", pa.map_(pa.string(), pa.string())), ("http_status", pa.int32()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("error", pa.string())])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                held, size = [], 0
                for record in parsed(memoryview(content.as_buffer())):
                    if not payloads:
                        record["payload"] = None
                    held.append(record | {"file": file})
                    size += 500 + len(record.get("payload") or b"")
                    if size > FLUSH:
                        yield pa.RecordBatch.from_pylist(held, arrow)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, arrow)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(records, schema)


# assembling -------------------------------------------------------------------------------------------------------


def captures(records: DataFrame) -> DataFrame:
    """One row per capture: target_uri, date, response, request, metadata (each a record, or null). records: of read_warc(); read several times, so better staged."""
    place = F.concat_ws(":", F.hex(F.xxhash64("file")), "offset")
    kind = F.when(F.col("type").isin(*ANCHORS), "response").otherwise(F.col("type"))
    rows = records.filter(F.col("type").isin(*ANCHORS, *MEMBERS)).withColumns({"uid": place, "kind": kind})
    thin = staged(rows.select("uid", "kind", "record_id", "concurrent_to"))
    named = thin.filter("record_id is not null").groupBy("record_id").agg(F.min(F.struct("uid", "kind")).alias("other"))
    edges = thin.select("uid", "kind", F.explode(F.array_distinct("concurrent_to")).alias("record_id")).join(named, "record_id").select("uid", "kind", F.col("other.uid").alias("other"), F.col("other.kind").alias("other_kind"))
    both = staged(edges.unionByName(edges.select(F.col("other").alias("uid"), F.col("other_kind").alias("kind"), F.col("uid").alias("other"), F.col("kind").alias("other_kind"))).filter("kind <> 'response'"))
    direct = both.filter("other_kind = 'response'").groupBy("uid", "kind").agg(F.min("other").alias("anchor"))
    by_request = both.filter("kind = 'metadata' and other_kind = 'request'").select("uid", "kind", "other").join(direct.select(F.col("uid").alias("other"), "anchor"), "other")
    by_request = by_request.join(direct.select("uid"), "uid", "left_anti").groupBy("uid", "kind").agg(F.min("anchor").alias("anchor"))
    first = direct.unionByName(by_request).groupBy("anchor", "kind").agg(F.min("uid").alias("uid")).select("uid", "anchor")

    record = F.struct(*(c for c in records.columns if c != "error"))
    members = rows.filter("kind <> 'response'").join(first, "uid", "left").select(F.coalesce("anchor", "uid").alias("uid"), "kind", record.alias("record"))
    out = rows.filter("kind = 'response'").select("uid", record.alias("response"))
    for name in MEMBERS:
        out = out.join(members.filter(F.col("kind") == name).select("uid", F.col("record").alias(name)), "uid", "full_outer")
    return out.select(*(F.coalesce(*(F.col(f"{r}.{c}") for r in ("response", *MEMBERS))).alias(c) for c in ("target_uri", "date")), "response", *MEMBERS)


def resolved(captured: DataFrame, key: Column) -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to) of each capture: of a revisit those of the response with the same digest that has the largest key, which refers_to names; null where there is none."""
    rows = captured.filter("response is not null").select(key.alias("key"), F.col("response.type").alias("record_type"), F.expr("if(response.type = 'revisit', regexp_replace(response.headers['warc-payload-digest'], '^sha1:', ''), response.payload_digest)").alias("payload_digest"), F.col("response.payload_bytes").alias("bytes"))
    rows = staged(rows)
    known = rows.filter("record_type <> 'revisit'").groupBy("payload_digest").agg(F.max("key").alias("first"), F.max("bytes").alias("full"))
    revisits = rows.filter("record_type = 'revisit'").join(known, "payload_digest", "left").select("key", F.col("full").alias("payload_bytes"), "payload_digest", "record_type", F.col("first").alias("refers_to"))
    return rows.filter("record_type <> 'revisit'").select("key", F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(revisits)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as archives, read them back: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc_{uuid.uuid4().hex}"
    write_warc(pages, path)
    records = staged(read_warc(spark, path, payloads=False))
    return resolved(captures(records), F.col("metadata.fields")["page_id"].cast("long")).withColumnRenamed("key", "page_id")
