"""Content-addressed WARC archive.

A page becomes a WARC record: its exact header block and its payload bytes. Payload bytes are stored once, in the WARC record
of the smallest id among equal payloads, a ``response``; the others are ``revisit`` records without bytes that name it.
Header blocks are kept apart as well, each with the strong digest (SHA-256) of its payload.

Reading takes the payloads from the WARC files, digests the bytes that are there, and joins headers to payloads on the strong
digest: a payload that is not what a header says meets no header. So every original record is put together again.

Files are gzipped WARC 1.1, each of a bounded number of records, so that a task reads a whole file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.llm.common import slices, small, small_batches, written

#: Payload bytes a WARC file holds, about; and the smallest payload that is stored once.
FILE_BYTES = 16 << 20
#: Ends a record.
END = b"\r\n\r\n"
MIN_SHARED = 0
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2026-01-01T00:00:00Z"


def base32_sha1(hex_sha1):
    """Upper-case base32 of a SHA-1 given as hex: every five hex digits are four digits to base 32, which Spark writes 0-9A-V."""
    part = lambda at, n: F.lpad(F.conv(F.substring(hex_sha1, at, n), 16, 32), 4 * n // 5, "0")
    return F.translate(F.concat(part(1, 15), part(16, 15), part(31, 10)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def describe(pages: DataFrame, record_id: str, payload: str, url: str | None, min_shared: int = MIN_SHARED) -> DataFrame:
    """Record rows: id, url, body (binary), sha256, digest, bytes, record_type, refers_to and header."""
    target = F.col(url) if url else F.lit(None).cast("string")
    rows = pages.select(F.col(record_id).alias("id"), target.alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("body"))
    rows = rows.withColumns({"sha256": F.sha2("body", 256), "digest": base32_sha1(F.sha1("body")), "bytes": F.octet_length("body").cast("long")})
    shared = rows.where(F.col("bytes") >= min_shared).groupBy("sha256", "bytes").agg(F.min(F.struct("id")).alias("f"), F.count(F.lit(1)).alias("n"))
    shared = small(written(shared.where("n > 1").select(F.col("sha256").alias("s2"), F.col("bytes").alias("b2"), F.col("f.id").alias("first_id")), "first_ids"))
    rows = rows.join(shared, (F.col("sha256") == F.col("s2")) & (F.col("bytes") == F.col("b2")), "left")
    is_first = F.col("s2").isNull() | F.col("first_id").eqNullSafe(F.col("id"))
    rows = rows.withColumns({"record_type": F.when(is_first, "response").otherwise("revisit"), "refers_to": F.when(~is_first, F.col("first_id"))})
    return rows.withColumn("header", header_block("url")).drop("s2", "b2")


def header_block(url: str | None):
    """The exact header block of a record, with CRLF line ends; null headers are left out."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c.cast("string"), F.lit("\r\n"))
    length = F.when(F.col("record_type") == "response", F.col("bytes")).otherwise(F.lit(0))
    target = F.regexp_replace(F.col(url), r"[\r\n]", "%0A") if url else F.lit(None).cast("string")
    return F.concat_ws(
        "",
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", target),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.when(F.col("record_type") == "revisit", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")),
        line("Content-Length", length),
        F.lit("\r\n"),
    )


def write_archive(pages: DataFrame, path: str, record_id: str = "page_id", payload: str = "html", url: str | None = "url", min_shared: int = MIN_SHARED) -> None:
    """Writes ``path/headers`` (exact headers, each with its payload's digest) and ``path/warc`` (files, each payload once).

    A null payload is empty. Every row gives a record, one without an id too; it sorts before all others. Of rows that share
    both payload and smallest id, each is a response. An empty table writes empty folders.
    """
    rows = describe(pages, record_id, payload, url, min_shared)
    response = F.col("record_type") == "response"
    rows.select("id", "header", "sha256", "digest", "bytes", "record_type", "refers_to").write.parquet(f"{path}/headers")
    # no shuffle: a task joins its records to rows of about FILE_BYTES, and each row is a file; the text sink ends it, and every
    # record within it ends, with the two CRLF that WARC asks for
    value = F.concat(F.col("header"), F.when(response, F.col("body").cast("string")).otherwise(""))
    options = {"lineSep": END.decode(), "compression": "gzip", "maxRecordsPerFile": "1"}
    limit = FILE_BYTES
    with small_batches(pages.sparkSession):
        rows.select(value.alias("value")).mapInArrow(lambda batches: _bundled(batches, limit), "value string").write.options(**options).text(f"{path}/warc")


def _bundled(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Records in rows of at most ``limit`` bytes, or one that is longer."""
    held, size = [], 0
    out = lambda: pa.RecordBatch.from_arrays([pa.array([END.join(held)], pa.binary()).cast(pa.string())], ["value"])
    for batch in slices(batches):
        for value in batch.column(0).cast(pa.binary()):
            record = value.as_py()
            if held and size + len(record) + len(END) > limit:
                yield out()
                held, size = [], 0
            held.append(record)
            size += len(record) + len(END)
    if held:
        yield out()


def parse_records(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Header block and payload of every record of a WARC file (unzipped)."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        head = data[at:end]
        size = int(next(x for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
        yield head, data[end : end + size]
        at = end + size + 4


PARSED = "id string, record_type string, declared_digest string, refers_to string, payload_bytes long, payload_digest string, header binary, payload binary"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, pa.string()) for n in ("id", "record_type", "declared_digest", "refers_to")] + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("header", pa.binary()), ("payload", pa.binary())])
    for batch in batches:
        for content in batch.column("content"):
            rows, held = [], 0
            for head, body in parse_records(gzip.decompress(content.as_py())):
                fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:] if b": " in x)
                get = lambda k, f=fields: (v := f.get(k)) and v.decode()
                urn = lambda v: v and v.removeprefix("<urn:page:").removesuffix(">")
                declared = get(b"WARC-Payload-Digest")
                digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
                rows.append((urn(get(b"WARC-Record-ID")), get(b"WARC-Type"), declared and declared.removeprefix("sha1:"), urn(get(b"WARC-Refers-To")), len(body), digest, head, body))
                held += len(head) + len(body)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of ``path/warc`` as parsed (PARSED): digests are those of the bytes found, not of the header."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/warc").select("content")
    return files.mapInArrow(_parse, PARSED)


def resolve(records: DataFrame) -> DataFrame:
    """Every record with payload_bytes and payload_digest of its full payload; a revisit takes those of its response.

    A response whose bytes do not have the digest its header declares, or a revisit whose response is missing or has
    another digest, gets a null payload_bytes.
    """
    verified = records.where("record_type = 'response' AND payload_digest = declared_digest")
    # one row for each payload: rows that repeat both id and payload are responses of the same bytes
    stored = verified.groupBy(F.col("id").alias("rid"), F.col("payload_digest").alias("rdigest")).agg(F.max("payload_bytes").alias("rbytes"))
    narrow = records.select("id", "record_type", "declared_digest", "refers_to", "payload_bytes", "payload_digest")
    revisits = narrow.where("record_type = 'revisit'").join(stored, (F.col("refers_to") == F.col("rid")) & (F.col("declared_digest") == F.col("rdigest")), "left")
    revisits = revisits.select("id", "record_type", "refers_to", F.col("rbytes").alias("payload_bytes"), F.col("declared_digest").alias("payload_digest"))
    own = F.when(F.col("payload_digest") == F.col("declared_digest"), F.col("payload_bytes")).alias("payload_bytes")
    responses = narrow.where("record_type = 'response'").select("id", "record_type", "refers_to", own, F.col("declared_digest").alias("payload_digest"))
    return responses.unionByName(revisits)


def payloads(records: DataFrame) -> DataFrame:
    """(sha256, payload_bytes, payload_digest, payload): each payload once, under digests of the bytes that were read."""
    found = records.where("record_type = 'response' AND payload_digest = declared_digest")
    found = found.select(F.sha2("payload", 256).alias("sha256"), "payload_bytes", "payload_digest", "payload")
    # responses of one payload that share their id too hold the same bytes
    return found.dropDuplicates(["sha256"])


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """Original records by joining kept headers to stored payloads on the strong digest.

    id, header, record_type, refers_to, payload_bytes, payload_digest and payload; the last three are null where no stored
    bytes have the digest, length and SHA-1 of the header.
    """
    headers = spark.read.parquet(f"{path}/headers").select("id", "header", "record_type", "refers_to", F.col("sha256").alias("s2"), "digest", "bytes")
    stored = payloads(read_archive(spark, path))
    on = (F.col("s2") == F.col("sha256")) & (F.col("digest") == F.col("payload_digest")) & (F.col("bytes") == F.col("payload_bytes"))
    return headers.join(stored, on, "left").select("id", "header", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS hex FROM p),
b AS (SELECT *, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(hex, 5 * (i // 4)::INT + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), 'string_agg', '') AS payload_digest FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_id FROM b)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
