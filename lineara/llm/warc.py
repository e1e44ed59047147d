"""WARC archives in which repeated payloads become revisit records.

Method. Each page gives a small header row (id, url, digest, length). The headers are shuffled by payload digest and aggregated to
the response of each digest; headers of repeated digests meet it, dealt over ``SALTS`` parts of each digest, and give one decision row
for each revisit. The decisions then meet the pages by page id and digest: payloads are never shuffled by digest, so one that a
third of all pages share costs only header rows. Records with fresh headers are compressed one by one and written by Spark's text
writer, whose line separator is an empty gzip member: each part file is a valid WARC/1.1 archive of one gzip member a record, in any
store that Spark can write to, and a record can be read alone from its offset. A file holds at most ``FILE_ROWS`` records and about
``FILE_BYTES`` bytes. Reading parses the files by Content-Length.

Defined results: null payload is empty; a null url gives an empty target; white space and control characters in a url are
percent-encoded, so a url can't end a header; payloads under the least size are all responses; rows repeated with the id of
the response are responses too, as they can't refer to themselves; a null id is smaller than any other; no rows give an
archive without records; other columns of the input are not used.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_dir

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Most records and, unless one record is larger, bytes of records in a file; a file is read by one task.
FILE_ROWS, FILE_BYTES = 2000, 1 << 29
#: Parts into which the headers of one digest are dealt.
SALTS = 16
#: A gzip member without content, which parts the records of a file.
EMPTY = gzip.compress(b"", mtime=0)


def resolve(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, html with payload_bytes, payload_digest, record_type, refers_to and refers_url."""
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"),
        F.length(body).cast("long").alias("payload_bytes"), F.sha1(body).alias("payload_digest"),
    )
    heads = rows.where(F.col("payload_bytes") >= least).select("page_id", "url", "payload_digest")
    first = heads.groupBy("payload_digest").agg(F.max(F.struct("page_id", "url")).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1 and _first.page_id is not null")
    many = first.select("payload_digest", "_first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = heads.select("page_id", "payload_digest", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int").alias("_salt"))
    again = salted.join(many.hint("merge"), ["payload_digest", "_salt"]).where(~F.col("page_id").eqNullSafe(F.col("_first.page_id")))
    again = again.select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), F.col("_first.page_id").alias("refers_to"), F.col("_first.url").alias("refers_url")).distinct()
    on = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("payload_digest") == F.col("_digest"))
    return rows.join(again.hint("merge"), on, "left").select(
        "page_id", "url", "html", "payload_bytes", "payload_digest", F.when(F.col("_digest").isNotNull(), "revisit").otherwise("response").alias("record_type"), "refers_to", "refers_url"
    )


def _record_id(page: str, digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page}/{digest}').urn}>"


def _safe(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of resolve() as WARC records, each a gzip member."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            page = "" if r["page_id"] is None else str(r["page_id"])
            again = r["record_type"] == "revisit"
            payload = b"" if again else r["html"].encode()
            # A revisit keeps the response's HTTP header, whose Content-Length is that of the full payload.
            http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['payload_bytes']}\r\n\r\n".encode()
            head = [
                "WARC/1.1", f"WARC-Type: {r['record_type']}", f"WARC-Record-ID: {_record_id(page, r['payload_digest'])}", f"WARC-Date: {DATE}",
                f"WARC-Target-URI: {_safe(r['url'])}", f"WARC-Payload-Digest: sha1:{r['payload_digest']}",
                "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}", f"X-Page-ID: {page}",
            ]
            if again:
                head += [
                    f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(str(r['refers_to']), r['payload_digest'])}",
                    f"WARC-Refers-To-Target-URI: {_safe(r['refers_url'] or '')}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page-ID: {r['refers_to']}",
                ]
            out.append(gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n", 6, mtime=0))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])


def write_archives(resolved: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """Write the records of ``resolved`` below ``path`` as WARC files with a gzip member for each record."""
    records = resolved.mapInArrow(_records, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.mode("overwrite").option("encoding", "ISO-8859-1").option("lineSep", EMPTY.decode("latin-1")).option("maxRecordsPerFile", file_rows).text(path)


def rows_a_file(pages: DataFrame) -> int:
    """Records that a file may hold, by the largest payload."""
    largest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    return max(1, min(FILE_ROWS, FILE_BYTES // (largest + 4096)))


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of every record of an uncompressed WARC stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            head[name.lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        if len(block) != int(head["content-length"]):
            raise ValueError("the file ends inside a record")
        yield head, block


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _READ.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    for batch in batches:
        for content in batch.column(0):
            rows, held = [], 0
            for head, block in parse(gzip.open(io.BytesIO(content.as_buffer()))):
                http, _, payload = block.partition(b"\r\n\r\n")
                full = int(http.lower().rpartition(b"content-length:")[2].split(b"\r\n")[0])
                kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and (len(payload) != full or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"payload of {head['warc-record-id']} doesn't match its header")
                page, to = head["x-page-id"], head.get("x-refers-to-page-id")
                rows.append((int(page) if page else None, head["warc-target-uri"], full, digest, kind, int(to) if to else None, payload if kind == "response" else None))
                held += len(payload)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record below ``path``; digests of responses are verified while reading."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_read, _READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """The rows that op8 returns, read back from archives written below the shared folder."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(resolve(pages), path, rows_a_file(pages))
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
