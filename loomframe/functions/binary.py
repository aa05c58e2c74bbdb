"""Binary codecs, addresses, files, MIME types, processes."""

from __future__ import annotations

import gzip
import subprocess
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import c, public, v

_COMPRESS = {"gzip": lambda b: gzip.compress(b, mtime=0), "zlib": zlib.compress, "deflate": lambda b: zlib.compress(b)[2:-4]}
_EXPAND = {"gzip": gzip.decompress, "zlib": zlib.decompress, "deflate": lambda b: zlib.decompress(b, -15)}


def _mapped(f, quiet: bool) -> object:
    def one(b):
        try:
            return f(b.encode() if isinstance(b, str) else bytes(b))
        except Exception:
            if quiet:
                return None
            raise

    @F.pandas_udf("binary")
    def udf(s: pd.Series) -> pd.Series:
        return s.map(one, na_action="ignore")

    return udf


def _coded(expr, codec: str, table: dict, quiet: bool) -> Column:
    if codec not in table:
        raise ValueError(f"no such codec: {codec}")
    return _mapped(table[codec], quiet)(c(expr))


@public
def compress(expr, codec: str):
    return _coded(expr, codec, _COMPRESS, False)


@public
def decompress(bytes, codec: str):
    return _coded(bytes, codec, _EXPAND, False)


@public
def try_compress(expr, codec: str):
    return _coded(expr, codec, _COMPRESS, True)


@public
def try_decompress(bytes, codec: str):
    return _coded(bytes, codec, _EXPAND, True)


@public
def encode(expr, charset: str):
    """base64 and hex give their bytes; utf8 the bytes of a string; the compressions as compress."""
    if charset in _COMPRESS:
        return compress(expr, charset)
    x = c(expr).cast("binary")
    # Spark breaks lines after 76 characters, unless a setting says otherwise.
    return {"base64": lambda: F.replace(F.base64(x), F.lit("\r\n"), F.lit("")).cast("binary"), "hex": lambda: F.lower(F.hex(x)).cast("binary"), "utf8": lambda: x, "utf-8": lambda: x}[charset]()


@public
def try_encode(expr, charset: str):
    return try_compress(expr, charset) if charset in _COMPRESS else encode(expr, charset)


@public
def decode(bytes, charset: str):
    if charset in _EXPAND:
        return decompress(bytes, charset)
    x = c(bytes)
    return {"base64": lambda: F.unbase64(x.cast("string")), "hex": lambda: F.unhex(x.cast("string")), "utf8": lambda: F.decode(x, "UTF-8"), "utf-8": lambda: F.decode(x, "UTF-8")}[charset]()


@public
def try_decode(bytes, charset: str):
    if charset in _EXPAND:
        return try_decompress(bytes, charset)
    x = c(bytes)
    if charset in ("base64", "hex"):
        return F.try_to_binary(x.cast("string"), F.lit(charset))
    return F.when(F.is_valid_utf8(x.cast("string")), x.cast("string"))


@public
def parse_url(expr):
    """Struct of scheme, username, password, host, port, path, query, fragment."""
    x = c(expr)
    part = lambda name: F.try_parse_url(x, F.lit(name))
    user = part("USERINFO")
    authority = part("AUTHORITY")
    return F.struct(
        part("PROTOCOL").alias("scheme"), F.split_part(user, F.lit(":"), F.lit(1)).alias("username"),
        F.when(F.instr(user, ":") > 0, F.split_part(user, F.lit(":"), F.lit(2))).alias("password"), part("HOST").alias("host"),
        F.nullif(F.regexp_extract(authority, r":(\d+)$", 1), F.lit("")).cast("int").alias("port"), part("PATH").alias("path"), part("QUERY").alias("query"), part("REF").alias("fragment"),
    )


# The first bytes of file formats.
_MAGIC = (
    ("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("47494638", "image/gif"), ("25504446", "application/pdf"), ("504B0304", "application/zip"),
    ("1F8B", "application/gzip"), ("4F676753", "audio/ogg"), ("494433", "audio/mpeg"), ("FFFB", "audio/mpeg"), ("664C6143", "audio/flac"), ("1A45DFA3", "video/webm"),
    ("424D", "image/bmp"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"), ("3C21444F43545950452068746D6C", "text/html"), ("3C68746D6C", "text/html"), ("89484446", "application/x-hdf5"),
)


@public
def guess_mime_type(bytes_expr):
    """Null where no format is known."""
    x = c(bytes_expr)
    head, brand = F.hex(F.substring(x, 1, 16)), F.hex(F.substring(x, 9, 4))
    out = F.when(head.startswith("52494646") & (brand == "57415645"), "audio/wav").when(head.startswith("52494646") & (brand == "57454250"), "image/webp")
    out = out.when(F.substring(head, 9, 8) == "66747970", "video/mp4")
    for magic, kind in _MAGIC:
        out = out.when(head.startswith(magic), kind)
    return out


def _opened(path: str, mode: str):
    """A local file, or one of any store that the installed file systems know."""
    if path.startswith("file://"):
        path = path[7:]
    if "://" in path:
        import fsspec

        return fsspec.open(path, mode).open()
    return open(path, mode)


@public
def download(expr, max_connections: int = 32, on_error: str = "raise"):
    """The bytes of each address, several at a time."""

    @F.pandas_udf("binary")
    def udf(s: pd.Series) -> pd.Series:
        from concurrent.futures import ThreadPoolExecutor

        def one(path):
            if path is None:
                return None
            try:
                with _opened(path, "rb") as f:
                    return f.read()
            except Exception:
                if on_error == "raise":
                    raise
                return None

        with ThreadPoolExecutor(max_connections) as pool:
            return pd.Series(list(pool.map(one, s)), dtype="object")

    return udf(c(expr))


@public
def upload(expr, location: str, on_error: str = "raise"):
    """Writes each value under location, by the SHA-256 of its bytes (a task that runs again writes the same file); the path."""

    @F.pandas_udf("string")
    def udf(s: pd.Series) -> pd.Series:
        import hashlib
        import os

        def one(b):
            b = b.encode() if isinstance(b, str) else bytes(b)
            path = f"{location.rstrip('/')}/{hashlib.sha256(b).hexdigest()}"
            try:
                if "://" not in location:
                    os.makedirs(location, exist_ok=True)
                with _opened(path, "wb") as f:
                    f.write(b)
                return path
            except Exception:
                if on_error == "raise":
                    raise
                return None

        return s.map(one, na_action="ignore")

    return udf(c(expr))


@public
def file(url):
    """A reference to a file: a struct of its path, read when needed."""
    return F.struct(c(url).alias("path"))


def _kind(name: str, magic: str):
    def function(url, verify: bool = False):
        reference = file(url)
        if not verify:
            return reference
        return F.when(guess_mime_type(F.substring(download(url, on_error="null"), 1, 64)).startswith(magic), reference)

    function.__name__ = function.__qualname__ = name
    function.__doc__ = f"As file; with verify, null for files that aren't {magic}."
    return public(function)


for _name, _magic in (("image_file", "image/"), ("audio_file", "audio/"), ("video_file", "video/"), ("hdf5_file", "application/x-hdf5")):
    globals()[_name] = _kind(_name, _magic)


@public
def file_path(file):
    return c(file).getField("path")


def _stat(f, kind: str):
    @F.pandas_udf(kind)
    def udf(s: pd.Series) -> pd.Series:
        return s.map(lambda p: f(p.removeprefix("file://")), na_action="ignore")

    return udf


@public
def file_size(file):
    import os

    return _stat(os.path.getsize, "long")(file_path(file))


@public
def file_exists(file):
    import os

    return _stat(os.path.exists, "boolean")(file_path(file))


@public
def run_process(args, shell: bool = False, on_error: str = "raise", return_dtype: str = "string"):
    """Standard output of a command for each row. args: a column of commands, or of lists of arguments."""

    @F.pandas_udf("string")
    def udf(s: pd.Series) -> pd.Series:
        def one(a):
            if not isinstance(a, str) and any(x is None for x in a):
                return None
            try:
                return subprocess.run(a if shell or isinstance(a, str) else list(a), shell=shell or isinstance(a, str), capture_output=True, text=True, check=True).stdout
            except (OSError, subprocess.CalledProcessError):
                if on_error == "raise":
                    raise
                return None

        return s.map(one, na_action="ignore")

    out = udf(c(args) if not isinstance(args, list | tuple) else F.array(*[v(x).cast("string") for x in args]))
    return out if return_dtype == "string" else F.trim(out).cast(return_dtype)
