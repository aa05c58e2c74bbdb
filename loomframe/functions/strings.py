"""Strings: matching, slicing, case, padding, distances, JSON, formatting."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import c, guarded, public, v

_SPACE = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
_PUNCTUATION = r"[!-/:-@\[-`{-~]"
#: Words of identifiers: runs of capitals, capitalised or small words, numbers with what they follow.
_WORDS = r"\p{Lu}+(?=\p{Lu}[\p{Ll}])|\p{Lu}?[\p{Ll}\p{N}]+|\p{Lu}+[\p{N}]*|[\p{L}\p{N}]+"


def _quoted(text: str) -> str:
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


@public
def lower(expr):
    return F.lower(c(expr))


@public
def upper(expr):
    return F.upper(c(expr))


@public
def reverse(expr):
    return F.reverse(c(expr))


@public
def lstrip(expr):
    return F.regexp_replace(c(expr), "^" + _SPACE, "")


@public
def rstrip(expr):
    return F.regexp_replace(c(expr), _SPACE + "$", "")


@public
def strip(expr):
    return rstrip(lstrip(expr))


@public
def capitalize(expr):
    """The first character upper, the others lower."""
    return F.concat(F.upper(F.left(c(expr), F.lit(1))), F.lower(F.substring(c(expr), F.lit(2), F.length(c(expr)))))


def _words(expr) -> Column:
    return F.regexp_extract_all(c(expr), F.lit(_WORDS), F.lit(0))


def _title(w: Column) -> Column:
    return F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, F.lit(2), F.length(w))))


@public
def to_camel_case(expr):
    return F.array_join(F.transform(_words(expr), lambda w, i: F.when(i == 0, F.lower(w)).otherwise(_title(w))), "")


@public
def to_upper_camel_case(expr):
    return F.array_join(F.transform(_words(expr), _title), "")


@public
def to_snake_case(expr):
    return F.lower(F.array_join(_words(expr), "_"))


@public
def to_upper_snake_case(expr):
    return F.upper(F.array_join(_words(expr), "_"))


@public
def to_kebab_case(expr):
    return F.lower(F.array_join(_words(expr), "-"))


@public
def to_upper_kebab_case(expr):
    return F.upper(F.array_join(_words(expr), "-"))


@public
def to_title_case(expr):
    return F.array_join(F.transform(_words(expr), _title), " ")


@public
def contains(expr, substr):
    return c(expr).contains(v(substr))


@public
def startswith(expr, prefix):
    return c(expr).startswith(v(prefix))


@public
def endswith(expr, suffix):
    return c(expr).endswith(v(suffix))


@public
def split(expr, split_on: str):
    """By a literal."""
    return F.split(c(expr), _quoted(split_on), -1)


@public
def regexp_split(expr, pattern: str):
    return F.split(c(expr), pattern, -1)


@public
def left(expr, nchars):
    return F.left(c(expr), v(nchars))


@public
def right(expr, nchars):
    return F.right(c(expr), v(nchars))


@public
def lpad(expr, length: int, pad: str = " "):
    return F.lpad(c(expr), length, pad)


@public
def rpad(expr, length: int, pad: str = " "):
    return F.rpad(c(expr), length, pad)


@public
def repeat(expr, n):
    return F.repeat(c(expr), v(n))


@public
def space(expr):
    return F.repeat(F.lit(" "), c(expr))


@public
def like(expr, pattern: str):
    return c(expr).like(pattern)


@public
def ilike(expr, pattern: str):
    return c(expr).ilike(pattern)


@public
def substr(expr, start, length=None):
    """From 0; null where it begins beyond the end."""
    x, s = c(expr), v(start)
    return F.when(s < F.length(x), F.substring(x, s + 1, F.length(x) if length is None else v(length)))


@public
def length_bytes(expr):
    return F.octet_length(c(expr))


@public
def regexp(expr, pattern: str):
    return c(expr).rlike(pattern)


@public
def regexp_count(expr, pattern: str):
    return F.regexp_count(c(expr), F.lit(pattern))


@public
def regexp_extract(expr, pattern: str, index: int = 0):
    """Null without a match."""
    return F.when(c(expr).rlike(pattern), F.regexp_extract(c(expr), pattern, index))


@public
def regexp_extract_all(expr, pattern: str, index: int = 0):
    return F.regexp_extract_all(c(expr), F.lit(pattern), F.lit(index))


@public
def replace(expr, search, replacement):
    return F.replace(c(expr), v(search), v(replacement))


@public
def regexp_replace(expr, pattern: str, replacement: str):
    r"""References to groups as $1, ${1} or \1."""
    return F.regexp_replace(c(expr), pattern, re.sub(r"\\(\d)|\$\{(\d+)\}", lambda m: f"${m[1] or m[2]}", replacement))


@public
def find(expr, substr):
    """From 0; -1 if it isn't there."""
    return F.call_function("instr", c(expr), v(substr)) - 1


@public
def count_matches(expr, patterns, whole_words: bool = False, case_sensitive: bool = True):
    """Occurrences of literals, the longest first where several match."""
    patterns = [patterns] if isinstance(patterns, str) else patterns
    alternatives = "|".join(re.escape(p) for p in sorted(patterns, key=len, reverse=True))
    pattern = rf"\b(?:{alternatives})\b" if whole_words else f"(?:{alternatives})"
    return F.regexp_count(c(expr), F.lit(pattern if case_sensitive else f"(?iu){pattern}"))


@public
def concat_ws(sep: str, *exprs):
    """Null if all are."""
    columns = [c(x) for x in exprs]
    return F.when(F.coalesce(*columns).isNotNull(), F.concat_ws(sep, *columns))


@public
def format(f_string: str, *args):
    """Fills {} in order; null if any argument is."""
    pieces = f_string.split("{}")
    if len(pieces) != len(args) + 1:
        raise ValueError(f"{len(pieces) - 1} placeholders for {len(args)} arguments")
    out = [F.lit(pieces[0])]
    for piece, arg in zip(pieces[1:], args):
        out += [c(arg).cast("string"), F.lit(piece)]
    return F.concat(*out)


@public
def translate(expr, from_str: str, to_str: str):
    return F.translate(c(expr), from_str, to_str)


@public
def substring_index(expr, delim: str, count: int):
    return F.substring_index(c(expr), delim, count)


@public
def soundex(expr):
    return F.soundex(c(expr))


@public
def ascii_func(expr):
    return F.ascii(c(expr))


@public
def chr_func(expr):
    return F.chr(c(expr))


@public
def levenshtein_distance(left, right):
    return F.levenshtein(c(left), c(right))


@public
def hamming_distance_str(left, right):
    """Null where lengths differ."""
    a, b = c(left), c(right)
    chars = lambda x: F.filter(F.split(x, ""), lambda ch: ch != "")
    differs = F.zip_with(chars(a), chars(b), lambda x, y: F.when(x == y, 0).otherwise(1))
    return F.when(F.length(a) == F.length(b), F.aggregate(differs, F.lit(0), lambda s, x: s + x))


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    taken, hits = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                hits.append(ch)
                break
    if not hits:
        return 0.0
    swapped = sum(x != y for x, y in zip(hits, (ch for ch, t in zip(b, taken) if t))) / 2
    m = len(hits)
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def _winkler(a: str, b: str) -> float:
    score, prefix = _jaro(a, b), 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return score + 0.1 * prefix * (1 - score)


def _damerau(a: str, b: str) -> int:
    """Edits and transpositions of neighbours, any edits between allowed."""
    last, far = {}, len(a) + len(b)
    rows = {(-1, j): far for j in range(-1, len(b) + 1)} | {(i, -1): far for i in range(-1, len(a) + 1)}
    rows |= {(0, j): j for j in range(len(b) + 1)} | {(i, 0): i for i in range(len(a) + 1)}
    for i in range(1, len(a) + 1):
        match = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), match
            same = a[i - 1] == b[j - 1]
            match = j if same else match
            rows[i, j] = min(rows[i - 1, j - 1] + (not same), rows[i, j - 1] + 1, rows[i - 1, j] + 1, rows[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return rows[len(a), len(b)]


def _pairs(f, kind: str):
    @F.pandas_udf(kind)
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)], dtype="object")

    return udf


@public
def jaro_similarity(left, right):
    return _pairs(_jaro, "double")(c(left), c(right))


@public
def jaro_winkler_similarity(left, right):
    return _pairs(_winkler, "double")(c(left), c(right))


@public
def damerau_levenshtein_distance(left, right):
    return _pairs(_damerau, "long")(c(left), c(right))


@public
def normalize(expr, remove_punct: bool = False, lowercase: bool = False, nfd_unicode: bool = False, white_space: bool = False):
    """Each step only if asked for."""
    x = c(expr)
    if nfd_unicode:
        import unicodedata

        @F.pandas_udf("string")
        def nfd(s: pd.Series) -> pd.Series:
            return s.map(lambda t: unicodedata.normalize("NFD", t), na_action="ignore")

        x = nfd(x)
    x = F.lower(x) if lowercase else x
    x = F.regexp_replace(x, _PUNCTUATION, "") if remove_punct else x
    return strip(F.regexp_replace(x, _SPACE, " ")) if white_space else x


@public
def serialize(expr, format: str = "json"):
    if format != "json":
        raise ValueError(f"no such format: {format}")
    return F.to_json(c(expr))


@public
def deserialize(expr, format: str, dtype: str):
    if format != "json":
        raise ValueError(f"no such format: {format}")
    return F.from_json(c(expr), dtype, {"mode": "FAILFAST"})


@public
def try_deserialize(expr, format: str, dtype: str):
    if format != "json":
        raise ValueError(f"no such format: {format}")
    return F.from_json(c(expr), dtype, {"mode": "PERMISSIVE"})


@public
def jq(expr, filter: str):
    """Paths (.a.b[0]); other filters of the language have no Spark form."""
    if not re.fullmatch(r"(\.[A-Za-z_]\w*|\.?\[\d+\]|\.)+", filter):
        raise NotImplementedError(f"only paths are supported: {filter}")
    return F.get_json_object(c(expr), "$" + filter.replace(".[", "[").rstrip("."))


@public
def json_array_length(expr):
    return F.json_array_length(c(expr))


@public
def json_object_keys(expr):
    """Sorted."""
    return F.array_sort(F.json_object_keys(c(expr)))


@public
def json_tuple(expr, *fields: str):
    """One struct of the fields' strings."""
    return F.struct(*[F.get_json_object(c(expr), f"$.{f}").alias(f) for f in fields])


@public
def tokenize_encode(expr, ranks_path: str, pattern: str):
    """Ids of a byte-level vocabulary in a rank file, through the installed tokenizer library."""
    ranks = open(ranks_path, "rb").read()

    def encode(batches):
        coder = _tokenizer(ranks, pattern)
        for s in batches:
            yield s.map(coder.encode_ordinary, na_action="ignore")

    return _iterated(encode, "array<int>")(c(expr))


@public
def tokenize_decode(expr, ranks_path: str, pattern: str):
    ranks = open(ranks_path, "rb").read()

    def decode(batches):
        coder = _tokenizer(ranks, pattern)
        for s in batches:
            yield s.map(lambda ids: coder.decode([int(i) for i in ids]), na_action="ignore")

    return _iterated(decode, "string")(c(expr))


def _iterated(f, kind: str):
    from collections.abc import Iterator

    f.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(f, kind)


def _tokenizer(ranks: bytes, pattern: str):
    import base64

    import tiktoken

    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks={base64.b64decode(t): int(r) for t, r in pairs}, special_tokens={})


@public
def length(expr):
    """Characters of strings, bytes of binaries."""
    return guarded(c(expr), F.length(c(expr)))
