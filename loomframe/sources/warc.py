"""WARC files as records."""

from __future__ import annotations

import json
import zlib

import pyarrow as pa

SCHEMA = "WARC_Record_ID string, WARC_Type string, WARC_Date string, Content_Length long, WARC_Identified_Payload_Type string, warc_content binary, warc_headers string"
_NAMES = [part.split()[0] for part in SCHEMA.split(", ")]
_TYPES = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[part.split()[1]] for part in SCHEMA.split(", ")]
_COLUMNS = ("warc-record-id", "warc-type", "warc-date", "content-length", "warc-identified-payload-type")
#: Bytes that are unpacked at a time, and that a batch of records holds before it is sent on.
PIECE, HELD = 1 << 20, 16 << 20


def _pieces(content: memoryview):
    """The bytes of a file, unpacked piece by piece; gzip of one member or a member a record, or plain."""
    if bytes(content[:2]) != b"\x1f\x8b":
        yield from (bytes(content[at : at + PIECE]) for at in range(0, len(content), PIECE))
        return
    at, open_member = 0, None
    while at < len(content) or open_member is not None:
        if open_member is None:
            if bytes(content[at : at + 2]) != b"\x1f\x8b":
                return  # padding behind the last member
            open_member, rest = zlib.decompressobj(31), b""
        taken = rest or bytes(content[at : at + PIECE])
        if not rest:
            at += len(taken)
        out = open_member.decompress(taken, PIECE)
        rest = open_member.unconsumed_tail
        if out:
            yield out
        if open_member.eof:
            at -= len(open_member.unused_data)
            open_member = None
        elif not taken:
            raise ValueError("the file ends within a gzip member")


def records(content):
    """Yields headers and block of each record; no more than a record and a piece is held."""
    pieces, buffer = _pieces(memoryview(content)), bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        if piece is not None:
            buffer.extend(piece)
        return piece is not None

    while True:
        while True:
            while buffer[:2] == b"\r\n":
                del buffer[:2]
            if len(buffer) >= 5 or not more():
                break
        if not buffer:
            return
        if not buffer.startswith(b"WARC/"):
            raise ValueError("no record where one should begin")
        searched = 0
        while (end := buffer.find(b"\r\n\r\n", searched)) < 0:
            searched = max(0, len(buffer) - 3)
            if not more():
                raise ValueError("the file ends within a record's headers")
        lines = bytes(buffer[:end]).decode("utf-8", "replace").split("\r\n")[1:]
        head = {name.strip(): value.strip() for name, colon, value in (line.partition(":") for line in lines) if colon}
        size = next((int(x) for name, x in head.items() if name.lower() == "content-length"), None)
        if size is None:
            raise ValueError("a record without its length")
        while len(buffer) < end + 4 + size:
            if not more():
                raise ValueError("the file ends within a record")
        yield head, bytes(buffer[end + 4 : end + 4 + size])
        del buffer[: end + 4 + size]


def parse(batches):
    """Batches of records, sent on whenever their blocks reach a bound."""
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows, held = [], 0
            for h, block in records(content.as_buffer()):
                # Names of headers have no case.
                known = {n.lower(): v for n, v in h.items()}
                rest = {n: v for n, v in h.items() if n.lower() not in _COLUMNS}
                rows.append((path, *[int(known[n]) if n == "content-length" else known.get(n) for n in _COLUMNS], block, json.dumps(rest)))
                held += len(block)
                if held > HELD:
                    yield _sent(rows)
                    rows, held = [], 0
            yield _sent(rows)


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), *_TYPES])], ["path", *_NAMES])
