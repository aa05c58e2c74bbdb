"""WARC: write captures as request, response or revisit, and metadata records; read archives; assemble transactions.

Writing. Payloads that occur more than once are found by their SHA-1 (counts
are pre-aggregated; the list of them is broadcast while it is short and joined
by shuffling beyond). Of equal payloads the capture with the largest id is the
response, others revisit it. Each capture becomes three records of one
transaction: the request and the metadata name the response or revisit in
WARC-Concurrent-To. Files are gzip, written by Spark's text writer with the
blank lines that end a record as its separator, so they reach any store.

Files hold at most FILE_RECORDS captures, and those of one input split.

Reading. Files are unpacked as a stream and parsed record by record by
Content-Length, so a reader holds the packed file and one record. Records are
written once without their payloads; those of a transaction are joined through WARC-Concurrent-To, and a revisit through
WARC-Refers-To to the record that holds its payload: one nested row a capture.

Defined results: a null payload is empty; empty payloads are equal to each
other like any others, or, below ``least_bytes``, all are responses. Rows that repeat id and payload of
a response are all responses. A null id is the smallest. A null address is
written as urn:unknown and read as null. Extra columns play no part. An empty
table gives an empty archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, cut, shared_path, text_of
from .hashing import trim
from .ship import ship

#: Written in every record: archives of equal inputs are equal.
DATE = "2024-01-01T00:00:00Z"
#: Captures in a file at most, so that a reader can hold a file.
FILE_RECORDS = 15_000
#: Distinct repeated payloads up to which their list is broadcast (about 60 bytes each).
BROADCAST_PAYLOADS = 200_000
NOWHERE = "urn:unknown"
BATCH_BYTES = 8 << 20

ship(__name__)


def _record_id(kind: str, key, digest: str, nth) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{kind}|{key}|{digest}|{nth}'.encode()).hexdigest())}>"


def _record(kind: str, uri: str, date: str, block: bytes, mime: str, record_id: str, **more) -> str:
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Target-URI", uri), ("WARC-Date", date)]
    head += [(f"WARC-{k.replace('_', '-')}", v) for k, v in more.items() if v is not None]
    head += [("Content-Type", mime), ("Content-Length", len(block))]
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n" + block.decode()


def _transaction(key, url, html: str, first, row: int, date: str):
    """The three records of a capture; first: the id of the capture that holds the payload, or None."""
    body = (html or "").encode()
    digest = f"sha1:{base64.b32encode(hashlib.sha1(body).digest()).decode()}"
    uri = NOWHERE if url is None else quote(url, safe=":/?#[]@!$&'()*+,;=%~")
    parts = urlsplit(uri) if uri != NOWHERE else urlsplit("")
    # The record that others refer to is named by id and payload alone; those that repeat it are told apart by their row.
    main = _record_id("capture", key, digest, "" if first is not None and first[0] else row)
    refers = None if first is None or first[0] else _record_id("capture", first[1], digest, "")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    get = f"GET {parts.path or '/'}{'?' + parts.query if parts.query else ''} HTTP/1.1\r\nHost: {parts.netloc}\r\n\r\n".encode()
    yield _record("request", uri, date, get, "application/http; msgtype=request", _record_id("request", key, digest, row), Concurrent_To=main)
    if refers:
        yield _record(
            "revisit", uri, date, head, "application/http; msgtype=response", main, Payload_Digest=digest, Refers_To=refers,
            Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        )
    else:
        yield _record("response", uri, date, head + body, "application/http; msgtype=response", main, Payload_Digest=digest)
    fields = f"capture: {json.dumps(key)}\r\naddress: {json.dumps(url)}\r\n".encode()
    yield _record("metadata", uri, date, fields, "application/warc-fields", _record_id("metadata", key, digest, row), Concurrent_To=main)


def _records(date: str):
    def run(batches):
        for batch in batches:
            out, held = [], 0
            for key, url, html, first, row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                first = None if first is None else (first["own"], first["key"])
                for r in _transaction(key, url, html, first, row, date):
                    out.append(r)
                    held += len(r)
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
            trim()

    return run


def write(df: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, date: str = DATE) -> None:
    """Write df's captures as gzip archives under path."""
    pages = df.select(col(key).alias("key"), col(url).cast("string").alias("url"), text_of(payload).alias("html"))
    pages = pages.withColumn("sha", F.sha1("html"))
    prints = cut(pages.filter(F.octet_length("html") >= least_bytes).select("key", "sha"), "payloads")
    repeated = cut(prints.groupBy("sha").agg(F.max("key").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha", "first"), "repeated")
    small = repeated.limit(BROADCAST_PAYLOADS + 1).count() <= BROADCAST_PAYLOADS
    joined = pages.join(F.broadcast(repeated) if small else repeated, (pages["sha"] == repeated["sha"]) & (F.octet_length("html") >= least_bytes), "left")
    first = F.when(repeated["sha"].isNotNull(), F.struct(F.col("key").eqNullSafe(F.col("first")).alias("own"), F.col("first").alias("key")))
    rows = joined.select("key", "url", "html", first.alias("first"), F.monotonically_increasing_id().alias("row"))
    (
        rows.mapInArrow(_records(date), "value string")
        .write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", 3 * FILE_RECORDS).text(path)
    )


def _parse(content: bytes):
    """Yields (headers with lower-case names, block) of the records of one file, gzip (of one or many members) or plain; unpacked as a stream."""
    file = io.BytesIO(content)
    file = io.BufferedReader(gzip.GzipFile(fileobj=file), 1 << 20) if content[:2] == b"\x1f\x8b" else file
    while True:
        line = file.readline()
        while line in (b"\r\n", b"\n"):
            line = file.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        head = {}
        while (line := file.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        block = file.read(size)
        if len(block) < size:
            raise ValueError("a record ends with its file")
        yield head, block


_FIELDS = [
    ("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("concurrent_to", pa.string()),
    ("refers_to", pa.string()), ("head", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
]
RECORDS = "record_id string, type string, uri string, date string, concurrent_to string, refers_to string, head string, payload binary, payload_bytes long, payload_digest string"


def _read(payloads: bool):
    def run(batches):
        for batch in batches:
            out, held = [], 0
            for content in batch.column(0):
                for head, block in _parse(content.as_py()):
                    kind = head["warc-type"]
                    http, payload = None, None
                    if head.get("content-type", "").startswith("application/http"):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        http = http.decode()
                        payload = payload if kind == "response" else None
                    elif head.get("content-type", "").startswith("application/warc-fields"):
                        http = block.decode()
                    uri = head.get("warc-target-uri")
                    out.append((
                        head["warc-record-id"], kind, None if uri == NOWHERE else uri, head.get("warc-date"), head.get("warc-concurrent-to"), head.get("warc-refers-to"),
                        http, payload if payloads else None, None if payload is None else len(payload),
                        None if payload is None else base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                    ))
                    held += len(block)
                    if held > BATCH_BYTES:
                        yield _batch(out)
                        out, held = [], 0
            yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS)], [n for n, _ in _FIELDS])


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row a record of the archives under path; payload_bytes and payload_digest are those of the bytes that were read."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read(payloads), RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: capture (id as JSON), address, response (of a revisit: of the record it refers to), request, metadata.

    records are read three times, so give a table that is written. What names a
    record more than once (rows repeated in the input) is pre-aggregated to the
    one of the least id, so joins don't multiply.
    """
    side = lambda kind, name: (
        records.filter(F.col("type") == kind).groupBy(F.col("concurrent_to").alias("id")).agg(F.min(F.struct("record_id", "date", "head")).alias(name))
    )
    main = records.filter(F.col("type").isin("response", "revisit"))
    rows = main.join(side("request", "request"), main["record_id"] == F.col("id"), "left").drop("id")
    rows = rows.join(side("metadata", "metadata"), rows["record_id"] == F.col("id"), "left").drop("id")
    field = lambda name: F.regexp_extract("metadata.head", f"(?m)^{name}: (.*?)\\r?$", 1)
    return rows.select(
        field("capture").alias("capture"), field("address").alias("address"), F.col("type").alias("record_type"),
        F.struct("record_id", "uri", "date", "head", "payload", "payload_bytes", "payload_digest").alias("response"), "refers_to", "request", "metadata",
    )


def resolve(captures: DataFrame) -> DataFrame:
    """Adds ``origin``: of a revisit, the capture and response that hold its payload; of others null."""
    asked = captures.filter("refers_to is not null").select(F.col("refers_to").alias("id")).distinct()
    named = captures.select(F.col("response.record_id").alias("id"), F.struct("capture", "response").alias("origin"))
    # Written, so that the join can split the revisits of one payload.
    origin = cut(named.join(asked, "id", "left_semi").groupBy("id").agg(F.min("origin").alias("origin")), "origins")
    return captures.join(origin, captures["refers_to"] == origin["id"], "left").drop("id")


def archive(df: DataFrame, **options) -> DataFrame:
    """Write df to the shared folder and read the transactions back; payloads themselves are left out."""
    path = shared_path(df.sparkSession, "warc")
    write(df, path, **options)
    return resolve(cut(assemble(cut(read(df.sparkSession, path, payloads=False), "records")), "captures"))
