"""Library functions inside SQL text. Each call by a library name becomes the Spark SQL that it stands for before Spark parses the query, so it is planned and compiled like any other expression."""

from __future__ import annotations

import re

from .functions.strings import _SPACE, _WORDS, _damerau, _jaro, _pairs, _winkler
from .functions.temporal import java_pattern

#: Text in which nothing is replaced: comments, strings, quoted names.
_OPAQUE = r"--[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`(?:[^`]|``)*`"
_SCAN = re.compile(rf"{_OPAQUE}|(?<![\w.])([A-Za-z_]\w*)\s*\(|[()\[\],]", re.DOTALL)

#: The same function under Spark's name.
_RENAMED = {
    "arccos": "acos", "arcsin": "asin", "arctan": "atan", "arctan2": "atan2", "arccosh": "acosh", "arcsinh": "asinh", "arctanh": "atanh", "negate": "negative", "shift_left": "shiftleft", "shift_right": "shiftright", "fill_nan": "nanvl",
    "list_join": "array_join", "list_min": "array_min", "list_max": "array_max", "list_append": "array_append", "list_contains": "array_contains", "list_sort": "array_sort", "list_map": "transform", "list_filter": "filter", "to_list": "array",
    "to_struct": "struct", "map_get": "try_element_at", "fill_null": "coalesce", "length_bytes": "octet_length", "levenshtein_distance": "levenshtein", "ascii_func": "ascii", "chr_func": "chr",
    "day_of_month": "dayofmonth", "day_of_week": "weekday", "day_of_year": "dayofyear", "week_of_year": "weekofyear", "partition_days": "to_date",
}

_KEPT = "filter({0}, __e -> __e IS NOT NULL)"
_DOUBLES = "transform({0}, __e -> CAST(__e AS DOUBLE))"
_TOTAL = "aggregate({0}, 0.0D, (__s, __e) -> __s + __e)"
_MICROS = "unix_micros(CAST({0} AS TIMESTAMP))"
_PART = f"regexp_extract_all({{0}}, r'{_WORDS}', 0)"
_TITLE = "concat(upper(left(__w, 1)), lower(substring(__w, 2)))"


def _in(outer: str, inner: str) -> str:
    return outer.replace("{0}", inner)


def _zipped(each: str) -> str:
    x, y = "CAST(__x AS DOUBLE)", "CAST(__y AS DOUBLE)"
    return _in(_TOTAL, f"zip_with({{0}}, {{1}}, (__x, __y) -> {each.replace('X', x).replace('Y', y)})")


def _norm(place: str) -> str:
    return f"sqrt({_in(_TOTAL, f'transform({place}, __e -> CAST(__e AS DOUBLE) * CAST(__e AS DOUBLE))')})"


def _logarithm(name: str) -> str:
    return f"CASE WHEN {{0}} = 0 THEN double('-infinity') WHEN {{0}} < 0 THEN double('NaN') ELSE {name}({{0}}) END"


def _some(out: str) -> str:
    """Of the values that aren't null; null without any."""
    return f"CASE WHEN size({_KEPT}) > 0 THEN {out} END"


_COSINE = f"try_divide({_zipped('X * Y')}, {_norm('{0}')} * {_norm('{1}')})"
_SUM = _in("aggregate(slice({0}, 2, greatest(size({0}) - 1, 0)), get({0}, 0), (__s, __e) -> __s + __e)", _KEPT)
_MEAN = f"{_in(_TOTAL, _in(_DOUBLES, _KEPT))} / size({_KEPT})"
_NS = "(CAST(extract(DAY FROM {0}) AS BIGINT) * 86400000000 + CAST(extract(HOUR FROM {0}) AS BIGINT) * 3600000000 + CAST(extract(MINUTE FROM {0}) AS BIGINT) * 60000000 + CAST(extract(SECOND FROM {0}) * 1000000 AS BIGINT))"

#: What a call becomes; {0}, {1} are its arguments, {*} all of them. Some names are Spark's too, with another result at the edges.
_FORMS = {
    "ln": _logarithm("ln"), "log2": _logarithm("log2"), "log10": _logarithm("log10"), "bitwise_and": "({0} & {1})", "bitwise_or": "({0} | {1})", "bitwise_xor": "({0} ^ {1})", "clip": "if({0} IS NULL, NULL, least(greatest({0}, {1}), {2}))",
    "is_nan": "if({0} IS NULL, NULL, isnan({0}))", "not_nan": "if({0} IS NULL, NULL, NOT isnan({0}))", "is_inf": "(abs({0}) = double('infinity'))", "eq_null_safe": "({0} <=> {1})", "is_null": "({0} IS NULL)", "not_null": "({0} IS NOT NULL)",
    "is_in": "array_contains({1}, {0})", "columns_sum": _in(_some(_in(_TOTAL, _in(_DOUBLES, _KEPT))), "array({*})"), "columns_mean": _in(_some(_MEAN), "array({*})"), "columns_avg": _in(_some(_MEAN), "array({*})"),
    "columns_min": "array_min(array({*}))", "columns_max": "array_max(array({*}))", "list_sum": _some(_SUM), "list_mean": _some(_MEAN), "list_bool_and": _some(f"forall({_KEPT}, __e -> __e)"), "list_bool_or": _some(f"exists({_KEPT}, __e -> __e)"),
    "list_count": f"CASE WHEN {{0}} IS NOT NULL THEN CAST(size({_KEPT}) AS BIGINT) END", "list_count_distinct": f"CASE WHEN {{0}} IS NOT NULL THEN CAST(size(array_distinct({_KEPT})) AS BIGINT) END", "list_distinct": f"array_distinct({_KEPT})",
    "list_flatten": f"flatten({_KEPT})", "list_fill": "array_repeat({1}, {0})", "seq": "CASE WHEN {0} > 0 THEN sequence(0L, CAST({0} AS BIGINT) - 1) WHEN {0} IS NOT NULL THEN CAST(array() AS ARRAY<BIGINT>) END",
    "chunk": "CASE WHEN {0} IS NOT NULL THEN transform(filter(sequence(0, greatest(0, size({0}) - {1})), __i -> __i % {1} = 0 AND __i + {1} <= size({0})), __i -> slice({0}, __i + 1, {1})) END",
    "strip": f"regexp_replace(regexp_replace({{0}}, r'^{_SPACE}', ''), r'{_SPACE}$', '')", "lstrip": f"regexp_replace({{0}}, r'^{_SPACE}', '')", "rstrip": f"regexp_replace({{0}}, r'{_SPACE}$', '')",
    "capitalize": "concat(upper(left({0}, 1)), lower(substring({0}, 2)))", "find": "(instr({0}, {1}) - 1)", "regexp_split": "split({0}, {1}, -1)", "count_matches": r"regexp_count({0}, concat(r'\Q', {1}, r'\E'))",
    "to_camel_case": f"array_join(transform({_PART}, (__w, __i) -> if(__i = 0, lower(__w), {_TITLE})), '')", "to_upper_camel_case": f"array_join(transform({_PART}, __w -> {_TITLE}), '')", "to_title_case": f"array_join(transform({_PART}, __w -> {_TITLE}), ' ')",
    "to_snake_case": f"lower(array_join({_PART}, '_'))", "to_upper_snake_case": f"upper(array_join({_PART}, '_'))", "to_kebab_case": f"lower(array_join({_PART}, '-'))", "to_upper_kebab_case": f"upper(array_join({_PART}, '-'))",
    "hamming_distance_str": "CASE WHEN length({0}) = length({1}) THEN aggregate(zip_with(split({0}, ''), split({1}, ''), (__x, __y) -> int(__x <> __y)), 0, (__s, __e) -> __s + __e) END",
    "microsecond": f"CAST(pmod({_MICROS}, 1000000) AS INT)", "millisecond": f"CAST(floor(pmod({_MICROS}, 1000000) / 1000) AS INT)", "nanosecond": f"CAST(pmod({_MICROS}, 1000000) * 1000 AS INT)",
    "total_seconds": f"CAST({_NS} / 1000000 AS BIGINT)", "total_milliseconds": f"CAST({_NS} / 1000 AS BIGINT)", "total_microseconds": _NS, "total_minutes": f"CAST({_NS} / 60000000 AS BIGINT)", "total_hours": f"CAST({_NS} / 3600000000 AS BIGINT)",
    "total_days": f"CAST({_NS} / 86400000000 AS BIGINT)", "to_unix_epoch": f"CAST(floor({_MICROS} / 1000000) AS BIGINT)", "partition_hours": f"CAST(floor({_MICROS} / 3600000000) AS INT)",
    "partition_months": "CAST((year({0}) - 1970) * 12 + month({0}) - 1 AS INT)", "partition_years": "CAST(year({0}) - 1970 AS INT)", "partition_iceberg_truncate": "({0} - pmod({0}, {1}))",
    "dot_product": _zipped("X * Y"), "euclidean_distance": f"sqrt({_zipped('(X - Y) * (X - Y)')})", "cosine_similarity": _COSINE, "cosine_distance": f"(1 - {_COSINE})", "hamming_distance": "bit_count({0} ^ {1})",
    "jaccard_similarity": f"try_divide({_zipped('if(X <> 0 AND Y <> 0, 1.0D, 0.0D)')}, {_zipped('if(X <> 0 OR Y <> 0, 1.0D, 0.0D)')})",
}


def _text(argument: str) -> str:
    """The value of a plain string literal."""
    found = re.fullmatch(r"\s*'([^'\\]*)'\s*", argument)
    if not found:
        raise ValueError(f"this argument must be a plain string: {argument}")
    return found[1]


def _pattern(argument: str) -> str:
    return "'" + java_pattern(_text(argument)).replace("'", "\\'") + "'"


def _zoned(a: list[str]) -> str:
    return f"convert_timezone({a[2] if len(a) > 2 else repr('UTC')}, {a[1]}, CAST({a[0]} AS TIMESTAMP_NTZ))"


#: Calls whose form depends on their literals or on how many arguments there are.
_BUILT = {
    "strftime": lambda a: f"date_format({a[0]}, {_pattern(a[1] if len(a) > 1 else repr('%Y-%m-%dT%H:%M:%S%.f'))})", "to_datetime": lambda a: f"to_timestamp_ntz({a[0]}, {_pattern(a[1])})", "convert_time_zone": _zoned,
    "regexp_extract": lambda a: f"CASE WHEN {a[0]} RLIKE {a[1]} THEN regexp_extract({a[0]}, {a[1]}, {a[2] if len(a) > 2 else 0}) END",
}

#: Without a Spark form: Python functions over Arrow batches, registered when a query names them.
_PYTHON = {"jaro_similarity": (_jaro, "double"), "jaro_winkler_similarity": (_winkler, "double"), "damerau_levenshtein_distance": (_damerau, "long")}


def names() -> set[str]:
    """The library's names that SQL text understands beside Spark's own."""
    return {*_RENAMED, *_FORMS, *_BUILT, *_PYTHON}


def _fill(form: str, arguments: list[str]) -> str:
    places = {"*": ", ".join(arguments)} | {str(i): f"({a})" for i, a in enumerate(arguments)}

    def put(m):
        if m[1] not in places:
            raise ValueError(f"argument {int(m[1]) + 1} is missing")
        return places[m[1]]

    return re.sub(r"\{(\d|\*)\}", put, form)


def _close(query: str, start: int) -> tuple[list[str], int]:
    """The arguments from after an opening parenthesis, and the place after the one that closes it."""
    depth, begin, found = 0, start, []
    for m in _SCAN.finditer(query, start):
        token = m[0]
        if m[1] or token in ("(", "["):
            depth += 1
        elif token in (")", "]"):
            if depth == 0:
                last = query[begin : m.start()]
                return [*found, last.strip()] if found or last.strip() else [], m.end()
            depth -= 1
        elif token == "," and depth == 0:
            found.append(query[begin : m.start()].strip())
            begin = m.end()
    raise ValueError("a parenthesis isn't closed")


_DISTINCT_ON = re.compile(rf"{_OPAQUE}|(?<![\w.])(select\s+distinct\s+on\s*\()", re.DOTALL | re.IGNORECASE)
_CLAUSE = re.compile(rf"{_OPAQUE}|[()]|(?<![\w.])(from|order\s+by|limit|offset|union|intersect|except|minus)(?!\w)", re.DOTALL | re.IGNORECASE)


def distinct_on(query: str) -> str:
    """SELECT DISTINCT ON (keys) as the first row of each group in the query's order, any row without one; the rows themselves come in no order."""
    start = 0
    while m := _DISTINCT_ON.search(query, start):
        start = m.end()
        if not m[1]:
            continue
        keys, begin = _close(query, m.end())
        # Where the clauses of this select begin, and where it ends.
        depth, at, stop = 0, {}, len(query)
        for c in _CLAUSE.finditer(query, begin):
            word = re.sub(r"\s+", " ", (c[1] or c[0])).lower()
            if word == "(":
                depth += 1
            elif word == ")":
                depth -= 1
            elif depth == 0 and c[1] and word not in ("from", "order by", "limit", "offset") and (word != "except" or "from" in at):
                stop = c.start()
            elif depth == 0 and c[1]:
                at.setdefault(word, (c.start(), c.end()))
            if depth < 0:
                stop = c.start()
            if stop < len(query):
                break
        if "from" not in at or "limit" in at or "offset" in at:
            raise ValueError("DISTINCT ON needs a FROM, and its LIMIT or OFFSET around it")
        order = query[at["order by"][1] : stop] if "order by" in at else " " + ", ".join(keys)
        source = query[at["from"][0] : at["order by"][0] if "order by" in at else stop]
        inner = f"SELECT {query[begin : at['from'][0]].strip()}, row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY{order}) AS __nth {source.strip()}"
        query = f"{query[: m.start()]}SELECT * EXCEPT (__nth) FROM ({inner}) WHERE __nth = 1 {query[stop:]}"
        start = m.start() + 1
    return query


def expand(query: str, spark=None, own: set[str] | frozenset = frozenset()) -> str:
    """The query with library calls replaced. Names in ``own`` stay: the user's functions of those names."""
    out, at = [], 0
    while m := _SCAN.search(query, at):
        name = (m[1] or "").lower()
        if name in own or name not in names() or re.search(r"(?i)\bfunction\s+$", query[: m.start()]):
            out.append(query[at : m.end()])
            at = m.end()
            continue
        arguments, end = _close(query, m.end())
        arguments = [expand(a, spark, own) for a in arguments]
        out.append(query[at : m.start()])
        if name in _PYTHON:
            if spark is not None:
                spark.udf.register(name, _pairs(*_PYTHON[name]))
            out.append(f"{name}({', '.join(arguments)})")
        elif name in _RENAMED:
            out.append(f"{_RENAMED[name]}({', '.join(arguments)})")
        else:
            out.append(_BUILT[name](arguments) if name in _BUILT else _fill(_FORMS[name], arguments))
        at = end
    return "".join(out) + query[at:]
