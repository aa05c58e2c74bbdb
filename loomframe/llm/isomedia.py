"""Media columns: ISO base media containers, written and read in pure Python and numpy.

Writing. A payload is stored losslessly as frames of one video track of
24 x 24 samples of 8 bits (576 bytes; the last frame is filled with bytes
255). Every 24th frame, one a second, is marked as a keyframe.

Reading. Boxes are walked by size (32-bit, 64-bit and to-the-end sizes) with a
stack of at most DEPTH. Of every track the sample tables (stts, stsc, stsz or
stz2, stco or co64, stss) and the runs of movie fragments (trex, tfhd, trun)
give each sample's place, size, time and whether it is a keyframe. Described
are the first video track, or the first track where there is none, with codec,
duration (the sum of stts and runs, or mdhd's where they give none) and the
keyframes' byte ranges and times; the others are listed. That comes from the
tables alone: payload bytes are touched only where the payload is asked for.
Edit lists and composition offsets (elst, ctts) are left out: times are those
of decoding, from the track's beginning.

Defined results: a null text is empty and is one frame of filling. A null or
broken container (boxes, tables or samples that end outside, counts that the
bytes present can't hold, boxes nested too deep, no track) gives a null row of
features. Any length works; batches are cut by bytes. Extra columns pass
through ``inspect`` untouched; if one is named info, the new one is _info.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, text_of
from .hashing import trim
from .ship import ship

SIDE, FRAME, RATE, GROUP, FILL = 24, 576, 24, 24, b"\xff"
BATCH_BYTES = 8 << 20
#: Boxes that hold boxes.
NESTED = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf")
DEPTH = 16
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)

ship(__name__)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def encode(data: bytes) -> bytes:
    """The container of a payload."""
    frames = max(1, -(-len(data) // FRAME))
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    entry = _box(
        b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 8, -1)
    )
    keys = range(1, frames + 1, GROUP)

    def moov(at: int) -> bytes:
        table = _box(
            b"stbl", _full(b"stsd", struct.pack(">I", 1), entry), _full(b"stts", struct.pack(">III", 1, frames, 1)),
            _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)), _full(b"stsc", struct.pack(">IIII", 1, 1, frames, 1)),
            _full(b"stsz", struct.pack(">II", FRAME, frames)), _full(b"stco", struct.pack(">II", 1, at)),
        )
        info = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table)
        media = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, frames, 0x55C4, 0)), _full(b"hdlr", bytes(4), b"vide", bytes(12), b"payload\0"), info)
        track = _box(b"trak", _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, frames), bytes(16), _MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16), flags=7), media)
        movie = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, frames, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", movie, track, _box(b"udta", _full(b"size", struct.pack(">Q", len(data)))))

    at = len(head) + len(moov(0)) + 8
    return head + moov(at) + _box(b"mdat", data, FILL * (frames * FRAME - len(data)))


def boxes(data):
    """Yields (path, start of body, end) of every box, outer ones before those they hold."""
    stack = [((), 0, len(data))]
    while stack:
        path, start, end = stack.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        stop = end if size == 0 else start + size
        if stop < body or stop > end or len(path) >= DEPTH:
            raise ValueError(f"box {kind!r} at byte {start} ends outside its parent, or is nested too deep")
        yield (*path, kind), body, stop
        stack.append((path, stop, end))
        if kind in NESTED:
            stack.append(((*path, kind), body, stop))


def _numbers(data, at: int, n: int, kind: str = ">u4", end: int | None = None) -> np.ndarray:
    if at + n * np.dtype(kind).itemsize > (len(data) if end is None else end):
        raise ValueError("a table ends outside its box")
    return np.frombuffer(data, kind, n, at).astype(np.int64)


def _table(data, box: tuple[int, int], columns: int = 1, kind: str = ">u4") -> np.ndarray:
    """The rows of a table that begins with its length."""
    a, end = box
    return _numbers(data, a + 8, columns * struct.unpack_from(">I", data, a + 4)[0], kind, end).reshape(-1, columns)


def _clipped(counts: np.ndarray, n: int) -> np.ndarray:
    """The counts, but n in all at most."""
    return np.diff(np.minimum(np.append(0, np.cumsum(np.minimum(counts, n))), n))


def _sizes(data, found: dict) -> np.ndarray:
    if b"stsz" in found:
        a, end = found[b"stsz"]
        fixed, n = struct.unpack_from(">II", data, a + 4)
        if fixed and n * fixed > len(data):
            raise ValueError("more samples than bytes")
        return np.full(n, fixed, np.int64) if fixed else _numbers(data, a + 12, n, end=end)
    a, end = found[b"stz2"]
    bits, n = data[a + 7], struct.unpack_from(">I", data, a + 8)[0]
    if bits == 4:
        pairs = _numbers(data, a + 12, -(-n // 2), ">u1", end)
        return np.stack([pairs >> 4, pairs & 15], 1).reshape(-1)[:n]
    return _numbers(data, a + 12, n, {8: ">u1", 16: ">u2"}[bits], end)


def _samples(data, found: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """offsets, sizes, times and numbers of keyframes of what the sample tables hold."""
    sizes = _sizes(data, found)
    n = len(sizes)
    chunk_at = (_table(data, found[b"co64"], kind=">u8") if b"co64" in found else _table(data, found[b"stco"]))[:, 0]
    runs = _table(data, found[b"stsc"], 3)
    per_chunk = _clipped(np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunk_at) + 1))), n)
    if per_chunk.sum() < n:
        raise ValueError("samples without a chunk")
    chunk = np.repeat(np.arange(len(per_chunk)), per_chunk)
    before = np.cumsum(sizes) - sizes
    first = np.minimum(np.cumsum(per_chunk) - per_chunk, max(n - 1, 0))
    offsets = chunk_at[chunk] + before - before[first][chunk] if n else before
    steps = _table(data, found[b"stts"], 2) if b"stts" in found else np.zeros((0, 2), np.int64)
    delta = np.repeat(steps[:, 1], _clipped(steps[:, 0], n))
    times = np.append(0, np.cumsum(np.append(delta, np.zeros(n - len(delta), np.int64))))
    keys = _table(data, found[b"stss"])[:, 0] - 1 if b"stss" in found else np.arange(n)
    if len(keys) and not 0 <= keys.min() <= keys.max() < n:
        raise ValueError("a keyframe that isn't a sample")
    return offsets, sizes, times, keys


def _run(data, box: tuple[int, int], base: int, header: list[int], at: int):
    """A trun's offsets, sizes, durations and keyframes; header: default duration, size and flags; at: where it begins if it doesn't say."""
    a, end = box
    flags, n = struct.unpack_from(">II", data, a)
    flags &= 0xFFFFFF
    place = a + 8
    if flags & 1:
        at, place = base + struct.unpack_from(">i", data, place)[0], place + 4
    first = None
    if flags & 4:
        first, place = struct.unpack_from(">I", data, place)[0], place + 4
    kinds = [k for k, bit in enumerate((0x100, 0x200, 0x400, 0x800)) if flags & bit]
    if not kinds and n * max(1, header[1]) > len(data):
        raise ValueError("more samples than bytes")
    rows = _numbers(data, place, n * len(kinds), end=end).reshape(-1, len(kinds)) if kinds else None
    duration, size, marks = (rows[:, kinds.index(k)] if k in kinds else np.full(n, header[k], np.int64) for k in range(3))
    if first is not None and n:
        marks = np.append(first, marks[1:])
    return at + np.cumsum(size) - size, size, duration, np.flatnonzero(marks & 0x10000 == 0)


def tracks(data) -> list[dict]:
    """Of every track: kind, codec, timescale, duration, samples, keyframes (offset, size, time), and where its samples are."""
    found, moof, extends, header, fragment, at = [], 0, {}, [0, 0, 0], None, 0
    size = None
    for path, a, b in boxes(data):
        kind = path[-1]
        if path == (b"moov", b"trak"):
            found.append({"runs": []})
        elif path[:2] == (b"moov", b"trak") and found:
            found[-1].setdefault(kind, (a, b))
        elif path == (b"moov", b"udta", b"size"):
            size = struct.unpack_from(">Q", data, a + 4)[0]
        elif kind == b"trex":
            track, _, *own = struct.unpack_from(">5I", data, a + 4)
            extends[track] = own
        elif path == (b"moof",):
            moof = a - 8
            at = moof
        elif kind == b"tfhd":
            flags, track = struct.unpack_from(">II", data, a)
            header, place, base = list(extends.get(track, [0, 0, 0])), a + 8, moof
            if flags & 1:
                base, place = struct.unpack_from(">Q", data, place)[0], place + 8
            place += 4 if flags & 2 else 0
            for k, bit in enumerate((8, 16, 32)):
                if flags & bit:
                    header[k], place = struct.unpack_from(">I", data, place)[0], place + 4
            fragment, at = (track, base), base
        elif kind == b"trun" and fragment:
            run = _run(data, (a, b), fragment[1], header, at)
            at = int(run[0][-1] + run[1][-1]) if len(run[0]) else at
            for t in found:
                if t.get(b"tkhd") and struct.unpack_from(">I", data, t[b"tkhd"][0] + (20 if data[t[b"tkhd"][0]] else 12))[0] == fragment[0]:
                    t["runs"].append(run)
    return [_track(data, t) | {"original_bytes": size} for t in found]


def _track(data, found: dict) -> dict:
    a = found[b"mdhd"][0]
    timescale, duration = struct.unpack_from(">IQ", data, a + 20) if data[a] else struct.unpack_from(">II", data, a + 12)
    codec = bytes(data[found[b"stsd"][0] + 12 :][:4]).decode("latin-1").strip()
    kind = bytes(data[found[b"hdlr"][0] + 8 :][:4]).decode("latin-1") if b"hdlr" in found else ""
    offsets, sizes, times, keys = _samples(data, found)
    for more, size, delta, own in found["runs"]:
        keys = np.concatenate([keys, len(offsets) + own])
        offsets, sizes, times = np.concatenate([offsets, more]), np.concatenate([sizes, size]), np.concatenate([times, times[-1] + np.cumsum(delta)])
    if len(offsets) and ((offsets < 0) | (offsets + sizes > len(data))).any():
        raise ValueError("a sample outside the file")
    return {
        "kind": kind, "codec": codec, "timescale": timescale, "duration": int(times[-1]) or duration, "samples": len(offsets),
        "keyframes": list(zip(offsets[keys].tolist(), sizes[keys].tolist(), times[keys].tolist())), "offsets": offsets, "sizes": sizes,
    }


def inspect_bytes(data) -> dict:
    """The first video track, or the first of any kind, as ``tracks`` gives it, and all of them as ``tracks``."""
    every = tracks(data)
    return next((t for t in every if t["kind"] == "vide"), every[0]) | {"tracks": every}


def payload(data, info: dict) -> bytes:
    """The samples' bytes, in order; neighbours are read at once."""
    offsets, sizes = info["offsets"], info["sizes"]
    if not len(offsets):
        return b""
    breaks = np.flatnonzero(offsets[1:] != offsets[:-1] + sizes[:-1]) + 1
    starts, ends = offsets[np.append(0, breaks)], (offsets + sizes)[np.append(breaks, len(offsets)) - 1]
    return b"".join(bytes(data[a:b]) for a, b in zip(starts, ends))


def _slices(batch: pa.RecordBatch, column: int):
    """Pieces of a batch of about BATCH_BYTES of a column."""
    sizes = np.array([0 if x is None else x for x in pa.compute.binary_length(batch.column(column)).to_pylist()], np.int64)
    at, total = 0, np.cumsum(sizes)
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BATCH_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def _write(batches):
    for batch in batches:
        for part in _slices(batch, batch.num_columns - 1):
            media = pa.array([encode(x or b"") for x in part.column(part.num_columns - 1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], media], part.schema.names)
        trim()


_TRACK = [("kind", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64())]
_INFO = pa.struct([
    *_TRACK, ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64()), ("time", pa.int64())]))), ("original_bytes", pa.int64()),
    ("payload", pa.binary()), ("tracks", pa.list_(pa.struct(_TRACK))),
])
TRACK = "kind:string,codec:string,timescale:long,duration:long,samples:long"
INFO = f"struct<{TRACK},keyframes:array<struct<offset:long,size:long,time:long>>,original_bytes:long,payload:binary,tracks:array<struct<{TRACK}>>>"


def _features(data, with_payload: bool) -> dict | None:
    try:
        info = inspect_bytes(data)
        got = payload(data, info) if with_payload else None
    except (ValueError, KeyError, IndexError, struct.error):
        return None
    names = [n for n, _ in _TRACK]
    return {k: info[k] for k in (*names, "original_bytes")} | {
        "keyframes": [{"offset": a, "size": b, "time": t} for a, b, t in info["keyframes"]], "payload": got, "tracks": [{k: t[k] for k in names} for t in info["tracks"]],
    }


def _inspect(with_payload: bool):
    def run(batches):
        for batch in batches:
            for part in _slices(batch, batch.num_columns - 1):
                rows = [None if x is None else _features(x, with_payload) for x in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], part.columns[-1], pa.array(rows, _INFO)], [*part.schema.names, "info"])

    return run


def write_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, media (the container of the text's UTF-8 bytes)."""
    rows = df.select(col(key).alias("key"), text_of(text).cast("binary").alias("media"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(_write, f"key {kind}, media binary").withColumnRenamed("key", key)


def inspect(df: DataFrame, media: str = "media", with_payload: bool = False) -> DataFrame:
    """df with its media column last, and a struct column ``info`` of its features after it."""
    others = [c for c in df.columns if c != media]
    rows = df.select(*[col(c).alias(f"c{i}") for i, c in enumerate(others)], col(media).cast("binary").alias("media"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    rows = rows.mapInArrow(_inspect(with_payload), f"{kinds}, info {INFO}")
    return rows.toDF(*others, media, fresh(df, "info"))
