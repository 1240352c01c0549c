"""WARC archives: writing pages as records, and reading them back with segment reassembly.

Writing is one projection: an HTTP response whose body is in chunked transfer framing, cut into segments, each with a
WARC header, written by Spark's text sink with the record end as line end, so files commit as any Spark output does.
Reading parses whole archive files, whose size is bounded by ``records_per_file`` segments. Records in one segment are
decoded where they are read; continuations are grouped by the identifier of their origin, ordered by number, checked
against the total length and decoded.

Equal payloads are found by digest and length; only groups of two and more are joined back, dealt out by salt.

Defined results: a null html is an empty payload; of equal payloads the record with the largest page_id is the
response, rows that repeat it are responses too; null ids are smaller than all others; line breaks in a url are left
out; columns beside page_id, url and html are not read. A record whose parts don't fit together raises an error.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, partitions, prepare

#: Characters of a segment and of a transfer chunk.
SEGMENT, CHUNK = 16_384, 4_096
#: Segments in an archive file: with four bytes a character at most 128 MB, a few MB as a rule.
RECORDS_PER_FILE = 2_000
CRLF = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: four times 40 bits as eight digits to base 32."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(payload.cast("binary")), 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The pages with payload, payload_bytes, payload_digest and refers_to (null: the page's record is a response)."""
    salts = max(8, partitions(pages.sparkSession) // 2)
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", F.coalesce(F.regexp_replace("url", r"[\r\n]", ""), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    key = ["payload_digest", "payload_bytes"]
    groups = rows.where(F.col("payload_bytes") >= least_bytes).groupBy(*key).agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1")
    groups = groups.select(*key, "keeper", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    return salted.join(groups, [*key, "salt"], "left").select("page_id", "url", "payload", *key, refers.alias("refers_to"))


def record_id(page_id: Column, digest: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat(F.coalesce(page_id.cast("string"), F.lit("null")), F.lit("/"), digest)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def header(*fields: tuple[str, Column]) -> Column:
    """WARC header lines; fields that are null are left out."""
    lines = [F.lit("WARC/1.1"), *[F.concat(F.lit(f"{name}: "), value.cast("string")) for name, value in fields], F.lit("")]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF))


def records(pages: DataFrame) -> DataFrame:
    """One row a record, ``value``, without its final line breaks."""
    cut = lambda text, n: F.regexp_extract_all(text, F.lit(f"(?s).{{1,{n}}}"), F.lit(0))
    is_response = F.col("refers_to").isNull()
    chunks = F.transform(cut(F.col("payload"), CHUNK), lambda x: F.concat(F.lower(F.hex(F.octet_length(x))), F.lit(CRLF), x, F.lit(CRLF)))
    response = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"), F.array_join(chunks, ""), F.lit("0\r\n\r\n"))
    block = F.when(is_response, response).otherwise(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"))
    rows = pages.withColumn("block", block).withColumn("total", F.octet_length("block")).withColumn("segments", cut(F.col("block"), SEGMENT)).withColumn("n", F.size("segments"))
    rows = rows.select("*", F.posexplode("segments").alias("k", "segment")).drop("segments", "block", "payload")
    own, first = record_id(F.col("page_id"), F.col("payload_digest")), F.col("k") == 0
    split = F.col("n") > 1
    fields = (
        ("WARC-Type", F.when(~first, F.lit("continuation")).when(is_response, F.lit("response")).otherwise(F.lit("revisit"))),
        ("WARC-Record-ID", F.when(first, own).otherwise(record_id(F.col("k"), own))),
        ("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        ("WARC-Target-URI", F.col("url")),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("X-Page-Id", F.when(first, F.col("page_id"))),
        ("X-Payload-Length", F.when(first, F.col("payload_bytes"))),
        ("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), F.col("payload_digest")))),
        ("WARC-Profile", F.when(~is_response, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("WARC-Refers-To", F.when(~is_response, record_id(F.col("refers_to"), F.col("payload_digest")))),
        ("X-Refers-To-Page", F.when(~is_response, F.col("refers_to"))),
        ("WARC-Segment-Number", F.when(split, F.col("k") + 1)),
        ("WARC-Segment-Origin-ID", F.when(~first, own)),
        ("WARC-Segment-Total-Length", F.when(split & (F.col("k") == F.col("n") - 1), F.col("total"))),
        ("Content-Length", F.octet_length("segment")),
    )
    return rows.select(F.concat(header(*fields), F.col("segment")).alias("value"))


def write_archives(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes pages with roles as gzipped WARC files."""
    records(pages).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def inflated(data: bytes) -> bytes:
    """The content of a gzip file of any number of members, such as one for each record."""
    out, at, member = [], 0, None
    while at < len(data):
        member = member or zlib.decompressobj(wbits=47)
        part = data[at : at + 65536]
        out.append(member.decompress(part))
        at += len(part) - len(member.unused_data)
        if member.eof:
            member = None
    if member:
        raise ValueError("a gzip member is cut short")
    return b"".join(out)


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        stop = end + 4 + int(fields["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"a record of the wrong length at byte {at}")
        yield fields, data[end + 4 : stop]
        at = stop + 4


def dechunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing."""
    out, at = [], 0
    while True:
        end = body.index(CRLF.encode(), at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size
        if len(out[-1]) != size or body[at : at + 2] != CRLF.encode():
            raise ValueError("a chunk of the wrong length")
        at += 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def joined(segments: list[tuple[int, bytes]], total: int | None) -> bytes:
    """The block of segments, by number; numbers from 1 without gap, and the total length as stated at the last."""
    segments = sorted(segments)
    block = b"".join(x for _, x in segments)
    if [k for k, _ in segments] != [*range(1, len(segments) + 1)] or total != len(block):
        raise ValueError("segments don't make up their record")
    return block


FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def finished(fields: dict[str, str], block: bytes) -> tuple:
    """A row of FIELDS, and the payload, of a record whose block is whole."""
    number = lambda x: int(fields[x]) if x in fields else None
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "revisit":
        return number("x-page-id"), number("x-payload-length"), digest, "revisit", number("x-refers-to-page"), None
    payload = payload_of(block)
    own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if own != digest or len(payload) != number("x-payload-length"):
        raise ValueError(f"the payload of {fields['warc-record-id']} differs from its digest")
    return number("x-page-id"), len(payload), own, "response", None, payload


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row a record, continuations joined: FIELDS, and the payload on demand."""
    prepare(spark)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def row(done: tuple) -> tuple:
        return done if with_payload else (*done[:5], None)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in parsed(inflated(content.as_py())):
                    number = int(fields.get("warc-segment-number", 0))
                    if not number:
                        rows.append((*row(finished(fields, block)), None, 0, None, None, None))
                    else:
                        origin = fields.get("warc-segment-origin-id", fields["warc-record-id"])
                        total = fields.get("warc-segment-total-length")
                        head = [f"{k}: {v}" for k, v in fields.items()] if number == 1 else None
                        rows.append((None,) * 6 + (origin, number, total and int(total), head and CRLF.join(head), block))
                if rows:
                    cols = [*zip(*rows)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(cols, [*types, pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary()])], [*names, "origin", "number", "total", "head", "block"]
                    )

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                total, head, copies, segments = (batch.column(c)[k].as_py() for c in ("total", "head", "copies", "segments"))
                fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.split(CRLF))
                done = row(finished(fields, joined([(s["number"], s["block"]) for s in segments], total)))
                yield pa.RecordBatch.from_arrays([pa.array([v] * copies, t) for v, t in zip(done, types)], names)

    schema = f"{FIELDS}, payload binary"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    rows = files.mapInArrow(parse, f"{schema}, origin string, number int, total long, head string, block binary")
    whole = rows.where("number = 0").select(*names)
    parts = rows.where("number > 0").groupBy("origin").agg(
        F.max("total").alias("total"), F.max("head").alias("head"), F.count_if(F.col("number") == 1).cast("int").alias("copies"), F.collect_set(F.struct("number", "block")).alias("segments")
    )
    out = whole.union(parts.select("total", "head", "copies", "segments").mapInArrow(reassemble, schema))
    return out if with_payload else out.drop("payload")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes the archives into the shared folder and reads them back."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archives(with_roles(pages, least_bytes), path)
    return read_archives(pages.sparkSession, path)


DUCKDB_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, sha1(h) AS x, strlen(h)::BIGINT AS payload_bytes, max(page_id) OVER (PARTITION BY h) AS keeper FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(x, 1 + 10 * (i // 8), 10))::BIGINT >> (5 * (7 - i % 8))) & 31))::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM d
"""
