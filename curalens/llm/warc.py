"""WARC archives: write captures as request, response (or revisit) and metadata records, read them back, and assemble
the records of each capture through their concurrent-to identifiers."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize
from .url_filter import host_of

#: Default parameters: least payload that is deduplicated, captures in a file, and the date that records carry.
LEAST_BYTES, FILE_CAPTURES, DATE = 100, 2000, "2024-01-01T00:00:00Z"
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:x-capture:"

RECORD = (
    "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, content_type string, "
    "payload_digest string, payload_bytes long, block binary"
)
ARROW = pa.schema([
    ("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()),
    ("date", pa.string()), ("content_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("block", pa.binary()),
])


def with_originals(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, payload, n_bytes, digest, original: the smallest page_id with an equal
    payload of `least_bytes` or more, null if the page itself is it. Only digests and ids are grouped, map side first,
    and only digests that several pages share are joined back."""
    base = pages.withColumn("payload", F.coalesce("html", F.lit(""))).drop("html")
    base = base.withColumns({"n_bytes": F.octet_length("payload").cast("long"), "digest": F.sha2(F.col("payload").cast("binary"), 256)})
    shared = base.where(F.col("n_bytes") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("original"), F.count("*").alias("n"))
    # written first, so that a short list is seen to be short and broadcast by size: payloads then stay where they are
    shared = materialize(shared.where(F.col("n") > 1).select("digest", "original"), "shared")
    joined = base.join(shared, "digest", "left")
    return joined.withColumn("original", F.when(~F.col("page_id").eqNullSafe(F.col("original")), F.col("original")))


def capture_records(pages: DataFrame, least_bytes: int = LEAST_BYTES, date: str = DATE) -> DataFrame:
    """One text per page: its request, response or revisit, and metadata records, without the last line feed."""
    line, end = F.lit("\r\n"), "\r\n\r\n"
    dealt = with_originals(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), least_bytes)
    # rows that repeat an id get a number of their own, so that record ids stay unique
    again = pages.groupBy(F.col("page_id").cast("long").alias("page_id")).count().where("count > 1").select(F.col("page_id").alias("_again"), F.lit(True).alias("_many"))
    dealt = dealt.join(materialize(again, "again"), F.col("page_id").eqNullSafe(F.col("_again")), "left")
    number = F.when(F.col("_many"), F.monotonically_increasing_id() + 1).otherwise(F.lit(0))
    dealt = dealt.withColumn("capture", F.concat(F.lit(URN), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(":"), number.cast("string")))

    def ident(kind: str, capture: Column) -> Column:
        return F.concat(F.lit("<"), capture, F.lit(f":{kind}>"))

    def header(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, line), F.lit(""))

    safe = F.regexp_replace("url", r"[\x00-\x20\x7F]+", "%20")
    capture, target = F.col("capture"), header("WARC-Target-URI", safe)

    def record(kind: str, name: str, block: Column, content: str, *more: Column) -> Column:
        return F.concat(
            F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\n"), header("WARC-Record-ID", ident(name, capture)), target, F.lit(f"WARC-Date: {date}\r\n"), *more,
            F.lit(f"Content-Type: {content}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(end), block, F.lit(end),
        )

    path = F.regexp_extract(safe, r"^[^:]*://[^/?#]*([^#]*)", 1)
    ask = F.concat(F.lit("GET "), F.coalesce(F.when(path.startswith("/"), path), F.concat(F.lit("/"), path), F.lit("/")), F.lit(" HTTP/1.1\r\nHost: "), host_of(safe), F.lit(end))
    top = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit(end))
    concurrent = header("WARC-Concurrent-To", ident("response", capture))
    digest = header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    first = F.concat(F.lit(URN), F.col("original").cast("string"), F.lit(":0"))
    refers = F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\n"), header("WARC-Refers-To", ident("response", first)))
    http = "application/http;msgtype="
    answer = F.when(F.col("original").isNull(), record("response", "response", F.concat(top, F.col("payload")), http + "response", digest)).otherwise(
        record("revisit", "response", top, http + "response", digest, refers)
    )
    about = F.concat(F.lit("payloadBytes: "), F.col("n_bytes").cast("string"), line)
    whole = F.concat(
        record("request", "request", ask, http + "request", concurrent), answer, record("metadata", "metadata", about, "application/warc-fields", concurrent)
    )
    return dealt.select(F.substring(whole, F.lit(1), F.length(whole) - 1).alias("value"))


def write_warc(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, date: str = DATE, file_captures: int = FILE_CAPTURES) -> None:
    """Write one capture per page under `path`, as gzip-compressed WARC files of at most `file_captures` captures.

    Files go through Spark's committer, to any file system Spark writes, and a retried task leaves nothing behind. Null html
    is an empty payload, a null url has no target header, and an empty table writes no record; other columns are ignored."""
    chosen = pages.select("page_id", "url", "html")
    capture_records(chosen, least_bytes, date).write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", file_captures).text(path)


def inflate(content: bytes) -> bytes:
    """A WARC file's bytes: plain, one gzip member, or a member for each record."""
    if content[:2] != b"\x1f\x8b":
        return content
    parts = []
    while content:
        member = zlib.decompressobj(31)
        parts += [member.decompress(content), member.flush()]
        content = member.unused_data.lstrip(b"\0")
    return b"".join(parts)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Headers (names in lower case) and block of each record, cut by Content-Length; a cut-off file raises."""
    at, view = 0, memoryview(data)
    while at < len(data):
        if data.startswith(b"\r\n", at):
            at += 2
            continue
        top = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or top < 0:
            raise ValueError(f"no WARC record at byte {at}")
        headers: dict[str, str] = {}
        for line in data[at:top].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            headers.setdefault(name.strip().lower().decode("utf-8", "replace"), value.strip().decode("utf-8", "replace"))
        start = top + 4
        at = start + int(headers["content-length"])
        if at > len(data):
            raise ValueError("the last record is cut off")
        yield headers, view[start:at]


def read_warc(spark: SparkSession, path: str, with_block: bool = True) -> DataFrame:
    """The records of all WARC files under `path`. payload_digest and payload_bytes are computed from a response's
    payload, and taken from the headers of a revisit, which holds none. `with_block=False` leaves the blocks out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")

    def row(headers: dict[str, str], block: memoryview) -> dict:
        kind, digest, size = headers.get("warc-type"), None, None
        if kind in ("response", "revisit"):
            top, mark, payload = bytes(block).partition(b"\r\n\r\n")
            if kind == "response":
                digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
            else:
                digest = headers.get("warc-payload-digest", "").rpartition(":")[2] or None
                told = [x.partition(b":")[2] for x in top.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                size = int(told[0]) if told else None
        return {
            "record_id": headers.get("warc-record-id"), "type": kind, "concurrent_to": headers.get("warc-concurrent-to"), "refers_to": headers.get("warc-refers-to"),
            "target_uri": headers.get("warc-target-uri"), "date": headers.get("warc-date"), "content_type": headers.get("content-type"),
            "payload_digest": digest, "payload_bytes": size, "block": bytes(block) if with_block else None,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for headers, block in parse_warc(inflate(content.as_py())):
                    rows.append(row(headers, block))
                    held += len(block) if with_block else 200
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)

    return files.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, response, request, metadata).

    A request or metadata record belongs to the record that its concurrent-to names; any other is a capture of its own.
    response holds a response, revisit or other main record; metadata is a list. Records whose main record is missing
    still give a row, with a null response, as do requests and metadata that name none. A capture's records are few, so
    the groups of the one exchange are small."""
    side = F.col("type").isin("request", "metadata") & F.col("concurrent_to").isNotNull()
    whole = F.struct(*[c for c in records.columns if c not in ("concurrent_to",)])
    keyed = records.select(F.when(side, F.col("concurrent_to")).otherwise(F.col("record_id")).alias("capture_id"), "type", whole.alias("r"))
    is_request, is_meta = F.col("type") == "request", F.col("type") == "metadata"
    return keyed.groupBy("capture_id").agg(
        F.min(F.when(~is_request & ~is_meta, F.col("r"))).alias("response"), F.min(F.when(is_request, F.col("r"))).alias("request"),
        F.collect_list(F.when(is_meta, F.col("r"))).alias("metadata"),
    )
