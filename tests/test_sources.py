"""Archives and messages, written here by hand."""

import gzip
import struct

import pytest
import zstandard

from loomframe import col
from loomframe.sources import readers, warc


def _record(kind: str, body: bytes, names=str) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:{len(body)}>", "Content-Length": str(len(body)), "X-Odd": "a: b"}
    return b"WARC/1.1\r\n" + "".join(f"{names(k)}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + body + b"\r\n\r\n"


@pytest.mark.parametrize("pack", [lambda r: b"".join(r), lambda r: gzip.compress(b"".join(r)), lambda r: b"".join(map(gzip.compress, r)) + b"\0\0"])
@pytest.mark.parametrize("piece", [7, 1 << 20])
def test_warc_records_of_all_packings(pack, piece, monkeypatch):
    monkeypatch.setattr(warc, "PIECE", piece)
    bodies = [b"", b"\r\n\r\nWARC/1.1\r\n", b"x" * 1000]
    got = list(warc.records(pack([_record("response", b, str.lower) for b in bodies])))
    assert [b for _, b in got] == bodies and all(h["x-odd"] == "a: b" for h, _ in got)
    assert list(warc.records(b"")) == []


@pytest.mark.parametrize("data", [b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort", b"WARC/1.1\r\nContent-Length", b"nothing at all", gzip.compress(b"WARC/1.1\r\n" * 99)[:-9], b"WARC/1.1\r\nA: b\r\n\r\n"])
def test_broken_archives_are_errors(data):
    with pytest.raises(ValueError):
        list(warc.records(data))


def test_archives_come_in_bounded_batches(spark, tmp_path, monkeypatch):
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(_record("response", bytes([65 + i]) * 50)) for i in range(20)))
    rows = readers.read_warc(str(tmp_path / "a.warc.gz"), file_path_column="f").to_pylist()
    assert sorted(bytes(r["warc_content"])[:1] for r in rows) == [bytes([65 + i]) for i in range(20)] and rows[0]["f"].endswith("a.warc.gz") and rows[0]["Content_Length"] == 50


def test_crawl(spark, tmp_path):
    names = [f"crawl-data/CC-X/segments/{s}/warc/{i}.warc.gz" for s in ("one", "two") for i in range(2)]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(gzip.compress(_record("response", n.encode())))
    (tmp_path / "crawl-data/CC-X/warc.paths.gz").write_bytes(gzip.compress("\n".join(names).encode()))
    read = lambda **k: sorted(bytes(r["warc_content"]).decode() for r in readers.common_crawl("CC-X", base=str(tmp_path), **k).to_pylist())
    assert read() == names and read(segment="two") == names[2:] and read(num_files=1) == names[:1]
    with pytest.raises(ValueError):
        readers.common_crawl("CC-X", segment="three", base=str(tmp_path))
    with pytest.raises(ValueError):
        readers.common_crawl("CC-X", content="pictures", base=str(tmp_path))


def _mcap(kind: int, body: bytes) -> bytes:
    return struct.pack("<BQ", kind, len(body)) + body


@pytest.mark.parametrize("codec", ["", "zstd", "lz4"])
def test_mcap_chunks_and_times(spark, tmp_path, codec):
    import pyarrow as pa

    text = lambda t: struct.pack("<I", len(t)) + t.encode()
    inner = _mcap(4, struct.pack("<HH", 1, 0) + text("/pose")) + b"".join(_mcap(5, struct.pack("<HIQQ", 1, i, 100 + i, 200 + i) + b"m%d" % i) for i in range(10))

    def lz4(data):
        sink = pa.BufferOutputStream()
        with pa.CompressedOutputStream(sink, "lz4") as out:
            out.write(data)
        return sink.getvalue().to_pybytes()

    packed = {"": bytes, "zstd": zstandard.ZstdCompressor().compress, "lz4": lz4}[codec](inner)
    chunk = struct.pack("<QQQI", 100, 109, len(inner), 0) + text(codec) + struct.pack("<Q", len(packed)) + packed
    (tmp_path / "a.mcap").write_bytes(b"\x89MCAP0\r\n" + _mcap(6, chunk) + b"\x89MCAP0\r\n")
    rows = readers.read_mcap(str(tmp_path / "a.mcap"), start_time=103, end_time=107, batch_size=3).to_pylist()
    assert [(r["topic"], r["log_time"], bytes(r["data"])) for r in rows] == [("/pose", 100 + i, b"m%d" % i) for i in range(3, 7)]
    assert readers.read_mcap(str(tmp_path / "a.mcap"), topics=["/other"]).count_rows() == 0


def test_ranges_of_keys(spark):
    parts = [t.column("id").to_pylist() for t in readers.range(0, 1000).repartition_by_range(4, "id").iter_partitions()]
    ends = sorted((min(p), max(p)) for p in parts if p)
    assert len(ends) > 1 and all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
    assert readers.range(0, 10).repartition_by_range(None, col("id"), desc=True).count_rows() == 10
