"""Where this library's functions differ from Spark's own: nulls, bounds, order, IEEE results."""

import math

import pytest
from pyspark.sql import functions as F

from loomframe import col, lit
from loomframe import functions as L
from loomframe.operators.frame import Frame


@pytest.fixture(scope="module")
def one(spark):
    return Frame(spark.range(1))


def value(one, expr):
    return one.select(x=expr).to_pylist()[0]["x"]


@pytest.mark.parametrize(
    ("expr", "want"),
    [
        (lambda: lit(0.0).ln(), -math.inf), (lambda: lit(0.0).log2(), -math.inf), (lambda: lit(1.0) / 0, math.inf), (lambda: lit(-1) / 0, -math.inf), (lambda: lit(7) // 2, 3), (lambda: lit(None).cast("double").is_nan(), None),
        (lambda: lit(math.nan).fill_nan(lit(2.0)), 2.0), (lambda: lit(5).clip(None, 3), 3), (lambda: lit(25).factorial(), None), (lambda: lit(-2.5).round(), -3.0), (lambda: lit(10).conv(10, 2), "1010"),
        (lambda: lit("abc").substr(5), None), (lambda: lit("abc").substr(1, 1), "b"), (lambda: lit("a.b.c").split("."), ["a", "b", "c"]), (lambda: lit("abc").regexp_extract("x(.)", 1), None), (lambda: lit("  a ").strip(), "a"),
        (lambda: lit("hELLO").capitalize(), "Hello"), (lambda: lit("abc").find("z"), -1), (lambda: lit("The cat, the Cat").count_matches(["cat", "the"], whole_words=True, case_sensitive=False), 4), (lambda: lit("abcd").rpad(2, "x"), "ab"),
        (lambda: lit('{"b":1,"a":2}').json_object_keys(), ["a", "b"]), (lambda: lit("ca").damerau_levenshtein_distance(lit("abc")), 2), (lambda: lit("abc").hamming_distance_str(lit("ab")), None),
    ],
)
def test_scalars(one, expr, want):
    got = value(one, expr())
    assert got == want or (isinstance(want, float) and got == pytest.approx(want))


def test_null_rules(one):
    n = F.lit(None).cast("string")
    assert value(one, lit(1)) == 1
    row = one.select(a=lit(1)).df.select(
        L.concat_ws("-", n, n).alias("ws"), L.format("{}:{}", n, F.lit("a")).alias("fmt"), L.list_sum(F.array(F.lit(None).cast("int"))).alias("empty"), L.list_sum(F.array(F.lit(1), F.lit(None), F.lit(3))).alias("sum"),
        L.list_sort(F.array(F.lit(2), F.lit(None), F.lit(3)), desc=True).alias("sorted"), L.list_distinct(F.array(F.lit(2), F.lit(None), F.lit(2))).alias("distinct"), L.seq(F.lit(0)).alias("seq"), L.chunk(F.array(*map(F.lit, range(5))), 2).alias("chunk"),
        L.get(F.array(F.lit(1), F.lit(2)), 5, -1).alias("beyond"), L.get(F.array(F.lit(1), F.lit(2)), -1).alias("last"), L.slice(F.array(*map(F.lit, range(5))), -2).alias("tail"), L.make_date(F.lit(2023), F.lit(2), F.lit(30)).alias("no_day"),
        L.list_flatten(F.array(F.array(F.lit(1)), F.lit(None).cast("array<int>"))).alias("flat"), L.great_circle_distance(F.lit(91.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("nowhere"), L.try_decode(F.lit("!"), "hex").alias("bad"),
        L.eq_null_safe(n, None).alias("same"), L.jaccard_similarity(F.array(F.lit(1.0), F.lit(0.0), F.lit(2.0)), F.array(F.lit(1.0), F.lit(1.0), F.lit(0.0))).alias("jaccard"),
    ).collect()[0]
    assert (row.ws, row.fmt, row.empty, row.sum) == (None, None, None, 4)
    assert row.sorted == [3, 2, None] and row.distinct == [2] and row.seq == [] and row.chunk == [[0, 1], [2, 3]]
    assert (row.beyond, row["last"], row.tail, row.no_day, row.flat, row.nowhere, row.bad, row.same) == (-1, 2, [3, 4], None, [1], None, None, True)
    assert row.jaccard == pytest.approx(1 / 3)


def test_base64_of_long_values_has_no_line_breaks(one):
    import base64

    for text in ("x" * 57, "x" * 58, "é\r\n" * 99, ""):
        wanted = base64.b64encode(text.encode()).decode()
        for encode in (L.encode, L.try_encode):
            coded = encode(F.lit(text), "base64")
            assert value(one, coded.cast("string")) == wanted
            assert value(one, L.decode(coded, "base64").cast("string")) == text


def test_week_buckets_begin_on_thursday(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-03 10:00:00' AS t")
    assert str(df.select(L.date_trunc("1 week", F.col("t"))).first()[0]) == "2023-12-28 00:00:00"
    assert df.select(L.day_of_week("t")).first()[0] == 2
    assert df.select(L.strftime("t", "%Y/%m/%d at %H:%M")).first()[0] == "2024/01/03 at 10:00"
    with pytest.raises(ValueError, match="no such"):
        L.date_trunc("1 month", F.col("t"))


def test_murmur_matches_the_table_format_specification(spark):
    from loomframe.functions.partitioning import murmur3

    assert murmur3((34).to_bytes(8, "little")) == 2017239379 and murmur3(b"iceberg") == 1210000089
    got = spark.range(34, 35).select(L.partition_iceberg_bucket("id", 16).alias("b")).first().b
    assert got == (2017239379 & 0x7FFFFFFF) % 16


def test_buckets_match_the_table_format_specification(spark):
    from datetime import date, datetime
    from decimal import Decimal

    row = spark.createDataFrame([(34, "iceberg", date(2017, 11, 16), datetime(2017, 11, 16, 22, 31, 8), Decimal("14.20"), b"\0\1\2\3")], "i long, s string, d date, t timestamp_ntz, x decimal(9,2), b binary")
    n = 1 << 30
    hashes = {"i": 2017239379, "s": 1210000089, "d": -653330422, "t": -2047944441, "x": -500754589, "b": -188683207}
    got = row.select([L.partition_iceberg_bucket(c, n).alias(c) for c in hashes]).first().asDict()
    assert got == {k: (h & 0x7FFFFFFF) % n for k, h in hashes.items()}
    big = spark.createDataFrame([((1 << 53) + 1,), (None,), (1 << 53,)], "i long").select(L.partition_iceberg_bucket("i", n)).collect()
    assert big[1][0] is None and big[0][0] != big[2][0]


def test_minhash_estimates_similarity(spark):
    a, b = " ".join(map(str, range(100))), " ".join(map(str, range(25, 125)))
    x, y = (r[0] for r in spark.createDataFrame([(a,), (b,)], "t string").select(L.minhash("t", 256)).collect())
    assert abs(sum(p == q for p, q in zip(x, y)) / 256 - 0.6) < 0.12
    s = [r[0] for r in spark.createDataFrame([("ab",), ("the quick brown fox",), ("the quick brown fix",), ("zzz yyy xxx",)], "t string").select(L.simhash("t")).collect()]
    distance = lambda p, q: ((p ^ q) & (2**64 - 1)).bit_count()
    assert s[0] == 0 and distance(s[1], s[2]) < distance(s[1], s[3])


def test_similarity_hashes_by_hand(spark):
    import hashlib

    import xxhash

    from loomframe.functions.misc import _PRIME, _permutations
    from loomframe.functions.partitioning import murmur3

    hashers = {
        "xxhash64": xxhash.xxh64_intdigest, "xxhash32": xxhash.xxh32_intdigest, "xxhash3_64": xxhash.xxh3_64_intdigest, "murmurhash3": murmur3, "sha1": lambda b: int.from_bytes(hashlib.sha1(b).digest()[:8], "little"),
    }
    texts = ["the quick brown fox", "a", "", "the the the", " ".join(f"w{i % 7000}" for i in range(9000)), None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    pairs = _permutations(8, 5)
    for name, f in hashers.items():
        got = df.select(L.minhash("t", 8, 2, 5, name).alias("m"), L.simhash("t", 3, name).alias("s")).collect()
        for t, row in zip(texts, got):
            if t is None:
                assert row.m is None and row.s is None
                continue
            w = t.split(" ")
            h = [f(" ".join(w[i : i + 2]).encode()) & 0xFFFFFFFF for i in range(max(1, len(w) - 1))]
            assert row.m == [min((a * x + b) % _PRIME for x in h) & 0xFFFFFFFF for a, b in pairs]
            grams = [f(t[i : i + 3].encode()) for i in range(len(t) - 2)]
            bits = sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in grams) > len(grams))
            assert row.s % (1 << 64) == bits
    for made in (L.minhash, L.simhash, L.hash):
        with pytest.raises(ValueError, match="no such hash"):
            made("t", hash_function="md99")


def test_images(spark, tmp_path):
    import numpy as np

    from loomframe.functions import media

    rng = np.random.default_rng(0)
    for channels in (1, 2, 3, 4):
        a = rng.integers(0, 256, (7, 5, channels)).astype(np.uint8)
        assert (media.read_png(media.write_png(a)) == a).all()
    assert media.convert(np.full((1, 1, 3), 200, np.uint8), "L")[0, 0, 0] == 200
    assert media.scale(np.arange(16, dtype=np.uint8).reshape(4, 4, 1), 2, 2).shape == (2, 2, 1)
    ramp = np.tile(np.arange(64, dtype=np.uint8)[None, :, None], (64, 1, 1))
    for method in ("ahash", "dhash", "dhash_vertical", "phash", "phash_simple", "whash", "colorhash"):
        assert media.perceptual(ramp, method, 8) == media.perceptual(media.scale(ramp, 64, 64), method, 8)
    import wave

    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(b"\0\1" * 800)
    df = spark.createDataFrame([(str(tmp_path / "a.wav"),)], "p string")
    row = df.select(L.audio_metadata(L.file("p")).alias("m"), F.size(L.resample(L.file("p"), 4000)).alias("n"), L.file_size(L.file("p")).alias("s"), L.guess_mime_type(L.download("p")).alias("k")).first()
    assert (row.m.sample_rate, row.m.frames, row.n, row.k) == (8000, 800, 400, "audio/wav") and row.s > 1600


def test_upload_and_processes(spark, tmp_path):
    df = spark.createDataFrame([("hello",), (None,)], "t string")
    rows = df.select(L.upload("t", str(tmp_path / "up")).alias("p"), L.run_process([F.lit("echo"), F.col("t")]).alias("o")).collect()
    assert open(rows[0].p).read() == "hello" and rows[0].o == "hello\n" and rows[1].p is None
    assert df.select(L.download(F.lit("/no/such/file"), on_error="null")).first()[0] is None


def test_names_that_need_libraries_say_so():
    with pytest.raises(NotImplementedError, match="video library"):
        L.video_frames(F.col("x"))


def test_expressions_find_functions(one):
    assert value(one, (lit("a") + "b").upper().repeat(2)) == "ABAB"
    assert value(one, lit(5).apply(lambda x: x + 1, "int")) == 6
    with pytest.raises(AttributeError):
        col("x").no_such_function()
