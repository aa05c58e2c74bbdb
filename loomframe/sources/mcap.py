"""MCAP files as messages: records are a byte of kind, eight bytes of length and a body; chunks hold records, plain or compressed."""

from __future__ import annotations

import struct
from itertools import batched

import pyarrow as pa

SCHEMA = "topic string, log_time long, publish_time long, sequence long, data binary"
_MAGIC = b"\x89MCAP0\r\n"
_CHANNEL, _MESSAGE, _CHUNK = 4, 5, 6


def _text(body: bytes, at: int) -> tuple[str, int]:
    n = struct.unpack_from("<I", body, at)[0]
    return body[at + 4 : at + 4 + n].decode(), at + 4 + n


def _unpacked(codec: str, body: bytes, size: int) -> bytes:
    if codec == "":
        return body
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompress(body, max_output_size=size)
    if codec == "lz4":
        # A frame has no library of its own here; Arrow reads it.
        return pa.input_stream(pa.py_buffer(body), compression="lz4").read()
    raise NotImplementedError(f"{codec} chunks")


def messages(data: bytes, topics: dict | None = None, start: int | None = None, end: int | None = None):
    """Messages with start <= log_time < end."""
    topics = {} if topics is None else topics
    at = 8 if data[:8] == _MAGIC else 0
    while at + 9 <= len(data) and data[at : at + 8] != _MAGIC:
        kind, size = struct.unpack_from("<BQ", data, at)
        body = data[at + 9 : at + 9 + size]
        at += 9 + size
        if kind == _CHANNEL:
            topics[struct.unpack_from("<H", body)[0]] = _text(body, 4)[0]
        elif kind == _MESSAGE:
            channel, sequence, logged, published = struct.unpack_from("<HIQQ", body)
            if (start is None or logged >= start) and (end is None or logged < end):
                yield topics.get(channel), logged, published, sequence, body[22:]
        elif kind == _CHUNK:
            # A chunk's channels may be used by later ones, so all are read; messages outside the range go.
            unpacked = struct.unpack_from("<Q", body, 16)[0]
            codec, begin = _text(body, 28)
            yield from messages(_unpacked(codec, body[begin + 8 :], unpacked), topics, start, end)


def parser(start: int | None, end: int | None, batch_size: int):
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                for rows in batched(messages(content.as_py(), None, start, end), batch_size):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return parse
