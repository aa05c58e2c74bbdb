"""Words, shingles and windows of UTF-8 texts as 64-bit hashes, in numpy over whole Arrow buffers.

A word's hash is a polynomial over random values of its bytes, taken from
prefix sums, so cost is a few passes over the bytes whatever the words'
lengths. Two different word sequences share a hash with a chance of about
2**-64. Chunks bound the memory: CHUNK bytes of text, or one longer document.
"""

from __future__ import annotations

import ctypes
import gc
import sys

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once.
CHUNK = 1 << 20
#: Name of the module that holds what a worker keeps for later tasks of one operator.
HELD = "_loomframe_held"


def trim() -> None:
    """Give freed memory back to the system: workers live on after their tasks, beside others."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def release() -> None:
    """Drop what tasks of another operator left in this worker."""
    if sys.modules.pop(HELD, None) is not None:
        gc.collect()
    trim()


def _random(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**64 - 1, n, dtype=np.uint64)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    white = np.zeros(256, bool)
    white[[0x20, *range(0x09, 0x0E)]] = True
    exact = _random(11, 256)
    exact[white] = 0
    folded = exact.copy()
    folded[65:91] = exact[97:123]
    return white, exact, folded


_WHITE, _EXACT, _FOLDED = _tables()
_STEP = 0x9E3779B97F4A7C15 | 1
_WORD_STEP = 0xD6E8FEB86659FD93 | 1
_MASK = 2**64 - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """step**i and step**-i, up to as many as were ever needed."""

    def __init__(self, step: int):
        self.step, self.up, self.down = step, None, None

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.up is None or len(self.up) < n:
            n = max(n, 1 << 12)
            out = []
            for base in (self.step, pow(self.step, -1, 2**64)):
                p = np.full(n, base & _MASK, np.uint64)
                p[0] = 1
                out.append(np.cumprod(p, dtype=np.uint64))
            self.up, self.down = out
        return self.up, self.down


_POWERS: dict[int, _Powers] = {}


def _powers(step: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _POWERS.setdefault(step, _Powers(step)).get(n)


def _sums(values: np.ndarray, step: int) -> np.ndarray:
    """Prefix sums of values[i] * step**i, one longer than values."""
    up, _ = _powers(step, len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def words(data: np.ndarray, bounds: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, the first word of each text (one more than texts), and the words' first and last-plus-one bytes.

    data: bytes; bounds: where each text begins, and the end; fold: A-Z count as a-z.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64), none, none
    solid = ~_WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = _sums((_FOLDED if fold else _EXACT)[data], _STEP)
    _, down = _powers(_STEP, len(data) + 1)
    h = (sums[ends] - sums[starts]) * down[starts]
    h = mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return h, np.searchsorted(starts, bounds), starts, ends


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive words: len(h) - n + 1 of them, or none."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    sums = _sums(h, _WORD_STEP)
    _, down = _powers(_WORD_STEP, len(h) + 1)
    count = len(h) - n + 1
    return mix((sums[n:] - sums[:count]) * down[:count] + np.uint64(n))


def minima(a: np.ndarray, n: int) -> np.ndarray:
    """The least of every n consecutive values."""
    if len(a) < n:
        return a[:0]
    out, span = a, 1
    while span * 2 <= n:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = n - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def chunks(texts: pa.Array, size: int = CHUNK):
    """Yields (first row, bytes, bounds) for pieces of a string array, of about size bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def shingle_sets(texts: pa.Array, n: int = 5):
    """Yields (row, sorted distinct shingle hashes): n words lower-cased in A-Z; of fewer words all as one; of none, none."""
    for at, data, bounds in chunks(texts):
        h, firsts, _, _ = words(data, bounds, True)
        all_grams = grams(h, n)
        for i in range(len(bounds) - 1):
            a, b = int(firsts[i]), int(firsts[i + 1])
            if b - a >= n:
                yield at + i, np.unique(all_grams[a : b - n + 1])
            else:
                yield at + i, grams(h[a:b], b - a) if b > a else all_grams[:0]


def spans(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the word sequences from starts to before ends."""
    sums = _sums(h, _WORD_STEP)
    _, down = _powers(_WORD_STEP, len(h) + 1)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def least_places(a: np.ndarray, n: int) -> np.ndarray:
    """Where the least of every n consecutive values is, the first of equal ones."""
    if len(a) < n:
        return np.zeros(0, np.int64)
    at, span = np.arange(len(a)), 1

    def lower(left, right):
        return np.where(a[left] <= a[right], left, right)

    while span * 2 <= n:
        at = lower(at[:-span], at[span:])
        span *= 2
    rest = n - span
    return lower(at[: len(at) - rest], at[rest:]) if rest else at
