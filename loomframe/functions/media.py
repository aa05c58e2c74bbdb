"""Images as structs (data, height, width, channel, mode) in numpy; PNG and BMP without further libraries, others where Pillow is installed.

Audio (WAV) is read with the standard library. Video frames and HDF5 need
libraries that are looked for when they are used.
"""

from __future__ import annotations

import io
import struct
import wave
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .base import c, public
from .binary import download, file_path

IMAGE = "struct<data:binary,height:int,width:int,channel:int,mode:string>"
_MODES = {1: "L", 2: "LA", 3: "RGB", 4: "RGBA"}


def _unfiltered(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """The rows of a PNG after its five filters."""
    out = np.zeros((height + 1, stride + step), np.int32)
    rows = np.frombuffer(raw, np.uint8).reshape(height, stride + 1)
    for y in range(height):
        kind, line, up = rows[y, 0], rows[y, 1:].astype(np.int32), out[y]
        here = out[y + 1]
        if kind == 2:
            here[step:] = line + up[step:] & 255
        elif kind == 0:
            here[step:] = line
        else:
            for x in range(stride):
                a, b, d = here[x], up[x + step], up[x]
                if kind == 1:
                    guess = a
                elif kind == 3:
                    guess = (a + b) // 2
                else:
                    pa_, pb, pc = abs(b - d), abs(a - d), abs(a + b - 2 * d)
                    guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else d
                here[x + step] = line[x] + guess & 255
    return out[1:, step:].astype(np.uint8)


def read_png(data: bytes) -> np.ndarray:
    """8-bit PNG without interlacing, as (height, width, channels)."""
    at, body, palette = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            width, height, bits, color, _, _, laced = struct.unpack(">IIBBBBB", part)
            if bits != 8 or laced:
                raise ValueError("only 8-bit PNG without interlacing")
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    pixels = _unfiltered(zlib.decompress(body), height, width * channels, channels).reshape(height, width, channels)
    return palette[pixels[:, :, 0]] if color == 3 else pixels


def write_png(a: np.ndarray) -> bytes:
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    height, width, channels = a.shape
    rows = np.concatenate([np.zeros((height, 1), np.uint8), a.reshape(height, -1)], 1)
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def _read(data: bytes) -> np.ndarray:
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return read_png(data)
    from PIL import Image

    a = np.asarray(Image.open(io.BytesIO(data)))
    return a[:, :, None] if a.ndim == 2 else a


def _array(row) -> np.ndarray:
    return np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["channel"])


def _row(a: np.ndarray, mode: str | None = None) -> dict:
    return {"data": np.ascontiguousarray(a, np.uint8).tobytes(), "height": a.shape[0], "width": a.shape[1], "channel": a.shape[2], "mode": mode or _MODES[a.shape[2]]}


def convert(a: np.ndarray, mode: str) -> np.ndarray:
    """Between L, LA, RGB and RGBA."""
    alpha = a[:, :, -1:] if a.shape[2] in (2, 4) else np.full((*a.shape[:2], 1), 255, np.uint8)
    color = a[:, :, : 3 if a.shape[2] >= 3 else 1]
    if mode.startswith("L") and color.shape[2] == 3:
        color = ((color.astype(np.uint32) @ np.array([19595, 38470, 7471], np.uint32) + 0x8000) >> 16).astype(np.uint8)[:, :, None]
    if mode.startswith("RGB") and color.shape[2] == 1:
        color = np.repeat(color, 3, 2)
    return np.concatenate([color, alpha], 2) if mode.endswith("A") else color


def scale(a: np.ndarray, w: int, h: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    y, x = np.clip((np.arange(h) + 0.5) * a.shape[0] / h - 0.5, 0, a.shape[0] - 1), np.clip((np.arange(w) + 0.5) * a.shape[1] / w - 0.5, 0, a.shape[1] - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    f = a.astype(np.float64)
    top, bottom = f[y0][:, x0] * (1 - fx) + f[y0][:, x1] * fx, f[y1][:, x0] * (1 - fx) + f[y1][:, x1] * fx
    return np.round(top * (1 - fy) + bottom * fy).astype(np.uint8)


def _gray(a: np.ndarray, w: int, h: int) -> np.ndarray:
    return scale(convert(a, "L"), w, h)[:, :, 0].astype(np.float64)


def _cosines(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))


def perceptual(a: np.ndarray, method: str, size: int) -> bytes:
    if method == "ahash":
        g = _gray(a, size, size)
        bits = g > g.mean()
    elif method == "dhash":
        g = _gray(a, size + 1, size)
        bits = g[:, 1:] > g[:, :-1]
    elif method == "dhash_vertical":
        g = _gray(a, size, size + 1)
        bits = g[1:] > g[:-1]
    elif method in ("phash", "phash_simple"):
        d = _cosines(4 * size)
        g = _gray(a, 4 * size, 4 * size)
        low = (d @ g @ d.T)[:size, :size] if method == "phash" else (g @ d.T)[:size, 1 : size + 1]
        bits = low > (np.median(low) if method == "phash" else low.mean())
    elif method == "whash":
        g = _gray(a, 2 * size, 2 * size)
        low = (g[::2, ::2] + g[1::2, ::2] + g[::2, 1::2] + g[1::2, 1::2]) / 4
        bits = low > np.median(low)
    elif method == "colorhash":
        rgb = convert(a, "RGB").reshape(-1, 3).astype(int) * size // 256
        share = np.bincount(rgb[:, 0] * size * size + rgb[:, 1] * size + rgb[:, 2], minlength=size**3) / len(rgb)
        bits = share > 1 / size**3
    else:
        raise NotImplementedError(method)
    return np.packbits(np.asarray(bits).ravel()).tobytes()


def _mapped(f, kind: str, quiet: bool = False):
    def one(x):
        try:
            return f(x)
        except Exception:
            if quiet:
                return None
            raise

    if kind == IMAGE:
        fields = ["data", "height", "width", "channel", "mode"]

        @F.pandas_udf(IMAGE)
        def udf(s: pd.Series) -> pd.DataFrame:
            rows = [None if x is None else one(x) for x in (s.to_dict("records") if isinstance(s, pd.DataFrame) else s)]
            return pd.DataFrame([dict.fromkeys(fields) if r is None else r for r in rows], columns=fields)

        return udf

    @F.pandas_udf(kind)
    def plain(s: pd.Series) -> pd.Series:
        return s.map(one, na_action="ignore")

    return plain


def _on_image(f, kind: str):
    """f of an image's array; the struct comes as a frame."""
    fields = ["data", "height", "width", "channel", "mode"]
    if kind == IMAGE:

        @F.pandas_udf(IMAGE)
        def udf(s: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([dict.fromkeys(fields) if r["data"] is None else _row(f(_array(r))) for r in s.to_dict("records")], columns=fields)

        return udf

    @F.pandas_udf(kind)
    def plain(s: pd.DataFrame) -> pd.Series:
        return pd.Series([None if r["data"] is None else f(_array(r)) for r in s.to_dict("records")], dtype="object")

    return plain


@public
def decode_image(bytes, on_error: str = "raise", mode: str | None = None):
    return _mapped(lambda b: _row(convert(_read(b), mode) if mode else _read(b)), IMAGE, on_error != "raise")(c(bytes))


@public
def encode_image(image, image_format: str = "png"):
    def png(a):
        if image_format.lower() == "png":
            return write_png(a)
        from PIL import Image

        out = io.BytesIO()
        Image.fromarray(a[:, :, 0] if a.shape[2] == 1 else a).save(out, image_format)
        return out.getvalue()

    return _on_image(png, "binary")(c(image))


@public
def resize(image, w: int, h: int):
    return _on_image(lambda a: scale(a, w, h), IMAGE)(c(image))


@public
def crop(image, bbox):
    """bbox: x, y, width, height; what lies outside is left out."""
    x, y, w, h = bbox
    return _on_image(lambda a: a[y : y + h, x : x + w], IMAGE)(c(image))


@public
def convert_image(image, mode: str):
    return _on_image(lambda a: convert(a, mode), IMAGE)(c(image))


@public
def image_hash(image, method: str = "phash", hash_size: int = 8):
    return _on_image(lambda a: perceptual(a, method, hash_size), "binary")(c(image))


@public
def image_to_tensor(image):
    """Struct of the samples and the shape."""
    x = c(image)
    return F.struct(x.getField("data").alias("data"), F.array(x.getField("height"), x.getField("width"), x.getField("channel")).alias("shape"))


@public
def image_attribute(image, name: str):
    return c(image).getField(name)


@public
def image_width(image):
    return c(image).getField("width")


@public
def image_height(image):
    return c(image).getField("height")


@public
def image_channel(image):
    return c(image).getField("channel")


@public
def image_mode(image):
    return c(image).getField("mode")


@public
def decode_image_file(file_expr, mode: str | None = None, on_error: str = "raise"):
    return decode_image(download(file_path(file_expr), on_error=on_error), on_error, mode)


@public
def image_file_metadata(file_expr):
    """Struct of height, width, channel, mode."""
    image = decode_image_file(file_expr)
    return F.struct(*[image.getField(k).alias(k) for k in ("height", "width", "channel", "mode")])


def _wave(data: bytes):
    with wave.open(io.BytesIO(data)) as w:
        a = np.frombuffer(w.readframes(w.getnframes()), {1: np.uint8, 2: np.int16, 4: np.int32}[w.getsampwidth()]).reshape(-1, w.getnchannels())
        return w.getframerate(), a


@public
def audio_metadata(file_expr):
    """Struct of sample_rate, channels, frames."""

    @F.pandas_udf("struct<sample_rate:int,channels:int,frames:long>")
    def udf(s: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None) if b is None else (lambda r: (r[0], r[1].shape[1], len(r[1])))(_wave(b)) for b in s]
        return pd.DataFrame(rows, columns=["sample_rate", "channels", "frames"])

    return udf(download(file_path(file_expr)))


@public
def resample(file_expr, sample_rate: int):
    """The first channel at another rate, linearly interpolated, from -1 to 1."""

    def one(b):
        rate, a = _wave(b)
        x = (a[:, 0].astype(np.float64) - (128 if a.dtype == np.uint8 else 0)) / (128 if a.dtype == np.uint8 else np.iinfo(a.dtype).max + 1)
        n = int(len(x) * sample_rate / rate)
        return np.interp(np.arange(n) * rate / sample_rate, np.arange(len(x)), x)

    return _mapped(one, "array<double>")(download(file_path(file_expr)))


def _needs(name: str, library: str):
    def function(*_, **__):
        raise NotImplementedError(f"{name} needs {library}, which isn't installed here")

    function.__name__ = function.__qualname__ = name
    function.__doc__ = f"Needs {library}."
    return public(function)


for _name, _library in (
    ("video_metadata", "a video library"), ("video_keyframes", "a video library"), ("video_frames", "a video library"), ("get_video_frame_by_idx", "a video library"),
    ("hdf5_keys", "an HDF5 library"), ("hdf5_read", "an HDF5 library"), ("hdf5_read_many", "an HDF5 library"),
):
    globals()[_name] = _needs(_name, _library)
