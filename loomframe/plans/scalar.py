"""The scalar function library, a query for each family. Columns are named after the functions."""

from pyspark.sql import functions as F

from .. import functions as L
from ..operators.expr import Expr, col, lit
from .registry import query


def _select(frame, *keys, **columns):
    return frame.select(*keys, **columns)


_ROUNDED = "sqrt cbrt sin cos tan cot arctan radians degrees exp"


@query("""SELECT p_partkey, abs(x) AS abs, ceil(x) AS ceil, floor(x) AS floor, CAST(sign(x) AS DOUBLE) AS sign, -x AS negate, round(x, 1) AS round, greatest(-100.0, least(100.0, x)) AS clip,
          x BETWEEN -50 AND 50 AS between_, pow(x / 1000, 2) AS pow, CAST(((p_size % 7) + 7) % 7 AS INTEGER) AS pmod, CAST(factorial(p_size % 10) AS BIGINT) AS factorial, p_size / 4 AS true_division, p_size // 4 AS floor_division
          FROM (SELECT *, p_retailprice - 1200 AS x FROM part)""")
def numeric_basic(t):
    x, s = col("x"), col("p_size")
    rows = t.part.with_column("x", col("p_retailprice") - 1200)
    return rows.select(
        "p_partkey", abs=x.abs(), ceil=x.ceil().cast("double"), floor=x.floor().cast("double"), sign=x.sign(), negate=x.negate(), round=x.round(1), clip=x.clip(-100.0, 100.0), between_=x.between(-50, 50),
        pow=(x / 1000).pow(2), pmod=s.pmod(7), factorial=(s % 10).factorial(), true_division=s / 4, floor_division=s // 4,
    )


@query("""SELECT p_partkey, round(sqrt(x), 9) AS sqrt, round(cbrt(x), 9) AS cbrt, round(sin(x), 9) AS sin, round(cos(x), 9) AS cos, round(tan(x), 6) AS tan, round(1 / tan(x), 6) AS cot, round(1 / sin(x), 6) AS csc,
          round(1 / cos(x), 6) AS sec, round(atan(x), 9) AS arctan, round(asin(1 / x), 9) AS arcsin, round(acos(1 / x), 9) AS arccos, round(atan2(x, 2), 9) AS arctan2, round(sinh(x / 50), 9) AS sinh, round(cosh(x / 50), 9) AS cosh,
          round(tanh(x / 50), 9) AS tanh, round(asinh(x), 9) AS arcsinh, round(acosh(x), 9) AS arccosh, round(atanh(1 / (x + 1)), 9) AS arctanh, round(radians(x), 9) AS radians, round(degrees(x), 6) AS degrees,
          round(sqrt(x * x + 9), 9) AS hypot FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x FROM part)""")
def numeric_trigonometry(t):
    x = col("x")
    rows = t.part.select("p_partkey", x=col("p_size").cast("double"))
    nine = {
        "sqrt": x.sqrt(), "cbrt": x.cbrt(), "sin": x.sin(), "cos": x.cos(), "arctan": x.arctan(), "arcsin": (lit(1) / x).arcsin(), "arccos": (lit(1) / x).arccos(), "arctan2": x.arctan2(lit(2.0)),
        "sinh": (x / 50).sinh(), "cosh": (x / 50).cosh(), "tanh": (x / 50).tanh(), "arcsinh": x.arcsinh(), "arccosh": x.arccosh(), "arctanh": (lit(1) / (x + 1)).arctanh(), "radians": x.radians(), "hypot": x.hypot(lit(3.0)),
    }
    six = {"tan": x.tan(), "cot": x.cot(), "csc": x.csc(), "sec": x.sec(), "degrees": x.degrees()}
    return rows.select("p_partkey", **{k: e.round(9) for k, e in nine.items()}, **{k: e.round(6) for k, e in six.items()})


@query("""SELECT p_partkey, round(ln(x), 9) AS ln, round(log2(x), 9) AS log2, round(log10(x), 9) AS log10, round(ln(x) / ln(3), 9) AS log, round(ln(1 + x), 9) AS log1p, round(exp(x / 50), 6) AS exp, round(exp(x / 50) - 1, 6) AS expm1,
          round(pi(), 9) AS pi, round(exp(1), 9) AS e FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x FROM part)""")
def numeric_logarithms(t):
    x = col("x")
    rows = t.part.select("p_partkey", x=col("p_size").cast("double"))
    nine = {"ln": x.ln(), "log2": x.log2(), "log10": x.log10(), "log": x.log(3.0), "log1p": x.log1p(), "pi": Expr(L.pi()), "e": Expr(L.e())}
    return rows.select("p_partkey", **{k: v.round(9) for k, v in nine.items()}, exp=(x / 50).exp().round(6), expm1=(x / 50).expm1().round(6))


@query("""SELECT o_orderkey, o_custkey & 12 AS bitwise_and, o_custkey | 12 AS bitwise_or, xor(o_custkey, 12) AS bitwise_xor, o_custkey << 2 AS shift_left, o_custkey >> 2 AS shift_right, bin(o_custkey) AS bin,
          lower(hex(o_custkey)) AS conv FROM orders""")
def numeric_bits(t):
    x = col("o_custkey")
    return t.orders.select(
        "o_orderkey", bitwise_and=x.bitwise_and(lit(12)), bitwise_or=x.bitwise_or(lit(12)), bitwise_xor=x ^ lit(12), shift_left=x << lit(2), shift_right=x >> lit(2), bin=x.bin(), conv=x.conv(10, 16).lower()
    )


@query("""SELECT c_custkey, isnan(x) AS is_nan, NOT isnan(x) AS not_nan, isinf(1 / nullif(c_acctbal - c_acctbal, 1)) AS is_inf, CASE WHEN isnan(x) THEN 0 ELSE x END AS fill_nan
          FROM (SELECT *, CASE WHEN c_acctbal < 0 THEN 'NaN'::DOUBLE ELSE c_acctbal END AS x FROM customer)""")
def numeric_nan(t):
    x = col("x")
    rows = t.customer.with_column("x", Expr(F.when(F.col("c_acctbal") < 0, float("nan")).otherwise(F.col("c_acctbal"))))
    return rows.select("c_custkey", is_nan=x.is_nan(), not_nan=x.not_nan(), is_inf=(lit(1.0) / (col("c_acctbal") - col("c_acctbal"))).is_inf(), fill_nan=x.fill_nan(lit(0.0)))


@query("""SELECT l_orderkey, l_linenumber, round(l_tax + l_discount + l_quantity, 6) AS columns_sum, round((l_tax + l_discount + l_quantity) / 3, 6) AS columns_mean, least(l_tax, l_discount, l_quantity) AS columns_min,
          greatest(l_tax, l_discount, l_quantity) AS columns_max FROM lineitem""")
def numeric_columns(t):
    c = [col(x) for x in ("l_tax", "l_discount", "l_quantity")]
    each = {n: Expr(getattr(L, n)(*[x.column for x in c])) for n in ("columns_sum", "columns_mean", "columns_min", "columns_max")}
    return t.lineitem.select("l_orderkey", "l_linenumber", **{n: x.round(6) if n in ("columns_sum", "columns_mean") else x for n, x in each.items()})


@query(r"""SELECT c_custkey, lower(c_name) AS lower, upper(c_name) AS upper, reverse(c_name) AS reverse, upper(c_name[1]) || lower(c_name[2:]) AS capitalize, left(c_name, 4) AS left_, right(c_name, 4) AS right_,
          lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS lpad, rpad(c_mktsegment, 4, '*') AS rpad, repeat(c_mktsegment, 2) AS repeat, trim('  ' || c_name || ' ') AS strip, length(c_name) AS length, strlen(c_name) AS length_bytes,
          c_name[3:7] AS substr, replace(c_name, '#', '-') AS replace, instr(c_name, '#') - 1 AS find, translate(c_name, 'Cust', 'kust') AS translate, split_part(c_name, '#', 1) AS substring_index, ascii(c_name) AS ascii_, chr(65 + CAST(c_nationkey AS INTEGER)) AS chr_,
          repeat(' ', 3) AS space FROM customer""")
def string_basic(t):
    n, m = col("c_name"), col("c_mktsegment")
    return t.customer.select(
        "c_custkey", lower=n.lower(), upper=n.upper(), reverse=n.reverse(), capitalize=n.capitalize(), left_=n.left(4), right_=n.right(4), lpad=col("c_custkey").cast("string").lpad(8, "0"), rpad=m.rpad(4, "*"), repeat=m.repeat(2),
        strip=Expr(F.concat(F.lit("  "), n.column, F.lit(" "))).strip(), length=n.length(), length_bytes=n.length_bytes(), substr=n.substr(2, 5), replace=n.replace("#", "-"), find=n.find("#"), translate=n.translate("Cust", "kust"),
        substring_index=n.substring_index("#", 1), ascii_=n.ascii_func(), chr_=(col("c_nationkey") + 65).chr_func(), space=lit(3).space(),
    )


@query(r"""SELECT doc_id, contains(text, 'the') AS contains, starts_with(text, 'The') AS startswith, ends_with(text, '.') AS endswith, text LIKE '%and%' AS like_, text ILIKE '%AND%' AS ilike, string_split(text, ' the ') AS split,
          regexp_matches(text, '[0-9]{3}') AS regexp, len(regexp_extract_all(text, '[A-Z]')) AS regexp_count, nullif(regexp_extract(text, '([a-z]+) the', 1), '') AS regexp_extract, regexp_extract_all(text, '[0-9]+') AS regexp_extract_all,
          regexp_replace(text, '([aeiou])', '<\1>', 'g') AS regexp_replace, len(regexp_extract_all(text, 'the|and')) AS count_matches, concat_ws('-', lang, source) AS concat_ws, lang || ':' || source AS format FROM documents""")
def string_search(t):
    x = col("text")
    return t.documents.select(
        "doc_id", contains=x.contains("the"), startswith=x.startswith("The"), endswith=x.endswith("."), like_=x.like("%and%"), ilike=x.ilike("%AND%"), split=x.split(" the "), regexp=x.regexp("[0-9]{3}"), regexp_count=x.regexp_count("[A-Z]"),
        regexp_extract=x.regexp_extract("([a-z]+) the", 1), regexp_extract_all=x.regexp_extract_all("[0-9]+"), regexp_replace=x.regexp_replace("([aeiou])", r"<\1>"), count_matches=x.count_matches(["and", "the"]),
        concat_ws=Expr(L.concat_ws("-", "lang", "source")), format=Expr(L.format("{}:{}", "lang", "source")),
    )


@query("""SELECT a.n_nationkey AS x, b.n_nationkey AS y, levenshtein(a.n_name, b.n_name) AS levenshtein, round(jaro_similarity(a.n_name, b.n_name), 9) AS jaro, round(jaro_winkler_similarity(a.n_name, b.n_name), 9) AS winkler,
          damerau_levenshtein(a.n_name, b.n_name) AS damerau, CASE WHEN length(a.n_name) = length(b.n_name) THEN hamming(a.n_name, b.n_name) END AS hamming FROM nation a, nation b""")
def string_distances(t):
    a, b = t.nation.select(x=col("n_nationkey"), p=col("n_name")), t.nation.select(y=col("n_nationkey"), q=col("n_name"))
    p, q = col("p"), col("q")
    return a.join(b, how="cross").select(
        "x", "y", levenshtein=p.levenshtein_distance(q), jaro=p.jaro_similarity(q).round(9), winkler=p.jaro_winkler_similarity(q).round(9), damerau=p.damerau_levenshtein_distance(q), hamming=p.hamming_distance_str(q)
    )


def _normalized(documents):
    return documents.select("doc_id", normalized=col("text").normalize(remove_punct=True, lowercase=True, white_space=True))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '\s+', ' ', 'g')) AS normalized FROM documents""")
def string_normalize(t):
    return _normalized(t.documents)


@query("SELECT * FROM (VALUES ('helloWorldFoo', 'hello_world_foo', 'HELLO_WORLD_FOO', 'hello-world-foo', 'HELLO-WORLD-FOO', 'Hello World Foo', 'HelloWorldFoo', 'H464')) v(camel, snake, upper_snake, kebab, upper_kebab, title, upper_camel, soundex)")
def string_cases(t):
    x = lit("hello worldFoo").regexp_replace("worldFoo", "WorldFoo")
    one = t.region.filter("r_regionkey = 0")
    return one.select(
        camel=x.to_camel_case(), snake=x.to_snake_case(), upper_snake=x.to_upper_snake_case(), kebab=x.to_kebab_case(), upper_kebab=x.to_upper_kebab_case(), title=x.to_title_case(), upper_camel=x.to_upper_camel_case(), soundex=x.soundex()
    )


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS parsed, json_extract_string(props, '$.k') AS jq, json_keys(props) AS json_object_keys, CAST(json_array_length('[1, 2, 3]') AS INTEGER) AS json_array_length,
          '{"k":' || json_extract_string(props, '$.k') || '}' AS serialized FROM events""")
def string_json(t):
    p = col("props")
    return t.events.select(
        "event_id", parsed=Expr(L.try_deserialize(p.column, "json", "k long").getField("k")), jq=p.jq(".k"), json_object_keys=p.json_object_keys(), json_array_length=lit("[1, 2, 3]").json_array_length(),
        serialized=Expr(L.serialize(L.deserialize(p.column, "json", "k long"))),
    )


@query("""SELECT event_id, CAST(ts AS DATE) AS date, day(ts) AS day, hour(ts) AS hour, minute(ts) AS minute, second(ts) AS second, CAST(epoch_us(ts) % 1000000 // 1000 AS INTEGER) AS millisecond, CAST(epoch_us(ts) % 1000000 AS INTEGER) AS microsecond,
          month(ts) AS month, quarter(ts) AS quarter, year(ts) AS year, isodow(ts) - 1 AS day_of_week, dayofyear(ts) AS day_of_year, weekofyear(ts) AS week_of_year, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS unix_date FROM events""")
def temporal_fields(t):
    x = col("ts")
    names = "date day hour minute second millisecond microsecond month quarter year day_of_week day_of_year week_of_year unix_date".split()
    return t.events.select("event_id", **{n: getattr(x, n)() for n in names})


@query("""SELECT o_orderkey, CAST(o_orderdate + INTERVAL 10 DAY AS DATE) AS date_add, CAST(o_orderdate - INTERVAL 10 DAY AS DATE) AS date_sub, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS date_diff,
          CAST(o_orderdate + INTERVAL 3 MONTH AS DATE) AS add_months, last_day(o_orderdate) AS last_day, strftime(o_orderdate, '%Y/%m/%d %H-%M') AS strftime, epoch(o_orderdate)::BIGINT AS to_unix_epoch, epoch_ms(o_orderdate) AS to_unix_epoch_ms,
          make_date(year(o_orderdate), month(o_orderdate), 1) AS make_date, strptime(strftime(o_orderdate, '%d.%m.%Y'), '%d.%m.%Y')::DATE AS to_date FROM orders""")
def temporal_arithmetic(t):
    x = col("o_orderdate")
    start = Expr(F.lit("1990-01-01").cast("date"))
    return t.orders.select(
        "o_orderkey", date_add=x.date_add(10), date_sub=x.date_sub(10), date_diff=x.date_diff(start), add_months=x.add_months(3), last_day=x.last_day(), strftime=x.strftime("%Y/%m/%d %H-%M"), to_unix_epoch=x.to_unix_epoch("s"),
        to_unix_epoch_ms=x.to_unix_epoch("ms"), make_date=Expr(L.make_date(L.year(x.column), L.month(x.column), F.lit(1))), to_date=x.strftime("%d.%m.%Y").to_date("%d.%m.%Y"),
    )


@query("""SELECT event_id, time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01') AS quarter_hours, time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01') AS weeks, date_trunc('hour', ts) AS hours,
          time_bucket(INTERVAL '2 days', ts, TIMESTAMP '2020-01-01 06:00:00') AS shifted FROM events""")
def temporal_truncate(t):
    x = F.col("ts")
    return t.events.select(
        "event_id", quarter_hours=Expr(L.date_trunc("15 minutes", x)), weeks=Expr(L.date_trunc("1 week", x)), hours=Expr(L.trunc(x, "1 hour")),
        shifted=Expr(L.date_trunc("2 days", x, F.lit("2020-01-01 06:00:00").cast("timestamp_ntz"))),
    )


@query("""SELECT o_orderkey, CAST(epoch(d) AS BIGINT) AS total_seconds, CAST(epoch(d) AS BIGINT) * 1000 AS total_milliseconds, CAST(epoch(d) AS BIGINT) // 60 AS total_minutes, CAST(epoch(d) AS BIGINT) // 3600 AS total_hours,
          CAST(epoch(d) AS BIGINT) // 86400 AS total_days FROM (SELECT o_orderkey, o_orderdate - TIMESTAMP '1990-01-01' AS d FROM orders)""")
def temporal_durations(t):
    d = col("d")
    rows = t.orders.select("o_orderkey", d=col("o_orderdate") - Expr(F.lit("1990-01-01").cast("timestamp_ntz")))
    return rows.select("o_orderkey", **{f"total_{n}": getattr(d, f"total_{n}")() for n in ("seconds", "milliseconds", "minutes", "hours", "days")})


@query("""SELECT event_id, ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS convert_time_zone, make_timestamp(year(ts), month(ts), day(ts), 1, 2, 3) AS make_timestamp, to_timestamp(floor(epoch(ts))::BIGINT) AT TIME ZONE 'UTC' AS timestamp_seconds FROM events""")
def temporal_zones(t):
    x = F.col("ts")
    return t.events.select(
        "event_id", convert_time_zone=Expr(L.convert_time_zone(x, "America/New_York", "UTC")),
        make_timestamp=Expr(L.make_timestamp(F.year(x), F.month(x), F.dayofmonth(x), F.lit(1), F.lit(2), F.lit(3)).cast("timestamp_ntz")),
        timestamp_seconds=Expr(L.timestamp_seconds(F.floor(F.unix_micros(x.cast("timestamp")) / 1000000).cast("long")).cast("timestamp_ntz")),
    )


@query("""SELECT event_id, day(ts) AS day_of_month, dayofyear(ts) AS dayofyear, weekofyear(ts) AS weekofyear, CAST(epoch_us(ts) % 1000000 * 1000 AS INTEGER) AS nanosecond, strftime(ts, '%H:%M') AS date_format,
          CAST(date_trunc('minute', ts) AS TIMESTAMP) AS to_datetime, date_part('month', ts)::INTEGER AS datepart, CAST(ts + INTERVAL 3 DAY AS DATE) AS dateadd, date_diff('day', DATE '2020-01-01', CAST(ts AS DATE)) AS datediff,
          CAST(ts + INTERVAL ((7 - isodow(ts)) % 7 + CASE WHEN isodow(ts) = 7 THEN 7 ELSE 0 END) DAY AS DATE) AS next_day, ts AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Tokyo' AS from_utc_timestamp, ts AT TIME ZONE 'Asia/Tokyo' AT TIME ZONE 'UTC' AS to_utc_timestamp,
          ts AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Tokyo' AS convert_timezone, ts AT TIME ZONE 'Asia/Tokyo' AT TIME ZONE 'UTC' AS replace_time_zone, strftime(to_timestamp(floor(epoch(ts))) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS from_unixtime,
          date_trunc('second', ts) AS millis, ts AS micros, CAST(ts AS DATE) AS date_from_unix_date, 'UTC' AS current_timezone, true AS now, make_timestamp(year(ts), month(ts), day(ts), hour(ts), 2, 3) AS make_timestamp_ltz FROM events""")
def temporal_aliases(t):
    x, plain = F.col("ts"), lambda e: Expr(e.cast("timestamp_ntz"))
    each = {n: col("ts").__getattr__(n)() for n in ("day_of_month", "dayofyear", "weekofyear", "nanosecond")}
    return t.events.select(
        "event_id", **each, date_format=Expr(L.date_format(x, "%H:%M")), to_datetime=Expr(L.to_datetime(L.strftime(x, "%Y-%m-%d %H:%M"), "%Y-%m-%d %H:%M")), datepart=Expr(L.datepart("month", x)), dateadd=Expr(L.dateadd(x, 3)),
        datediff=Expr(L.datediff(F.to_date(x), F.lit("2020-01-01").cast("date"))), next_day=Expr(L.next_day(F.to_date(x), "Sunday")), from_utc_timestamp=plain(L.from_utc_timestamp(x.cast("timestamp"), "Asia/Tokyo")),
        to_utc_timestamp=plain(L.to_utc_timestamp(x.cast("timestamp"), "Asia/Tokyo")), convert_timezone=Expr(L.convert_timezone("Asia/Tokyo", x)), replace_time_zone=plain(L.replace_time_zone(x, "Asia/Tokyo")),
        from_unixtime=Expr(L.from_unixtime(L.to_unix_epoch(x))), millis=plain(L.timestamp_millis(L.to_unix_epoch(x) * 1000)), micros=plain(L.timestamp_micros(L.to_unix_epoch(x, "us"))), date_from_unix_date=Expr(L.date_from_unix_date(L.unix_date(x))),
        current_timezone=Expr(L.current_timezone()), now=Expr((L.current_date() > F.lit("2020-01-01").cast("date")) & (L.current_timestamp() > F.lit("2020-01-01").cast("timestamp"))),
        make_timestamp_ltz=plain(L.make_timestamp_ltz(F.year(x), F.month(x), F.dayofmonth(x), F.hour(x), F.lit(2), F.lit(3))),
    )


@query("""SELECT o_orderkey, epoch_us(d) AS total_microseconds, epoch_us(d) * 1000 AS total_nanoseconds, CAST(CAST(o_orderdate + to_microseconds(o_orderkey * 60250000) AS TIME) AS VARCHAR) AS time,
          round((year(o_orderdate) - 1990) * 12 + month(o_orderdate) - 1 + CASE WHEN day(o_orderdate) = 1 THEN 0 ELSE (day(o_orderdate) - 1) / 31 END, 6) AS months_between
          FROM (SELECT *, o_orderdate - TIMESTAMP '1990-01-01' AS d FROM orders)""")
def temporal_totals(t):
    start = F.lit("1990-01-01").cast("timestamp_ntz")
    d = col("o_orderdate") - Expr(start)
    return t.orders.select(
        "o_orderkey", total_microseconds=d.total_microseconds(), total_nanoseconds=d.total_nanoseconds(), time=Expr(F.timestamp_add("MICROSECOND", F.col("o_orderkey") * 60250000, F.col("o_orderdate"))).time().cast("string"), months_between=Expr(L.months_between("o_orderdate", start)).round(6)
    )


@query(r"""SELECT c_custkey, c_custkey * c_custkey::DOUBLE AS power, round((c_nationkey + c_acctbal) / 2, 6) AS columns_avg, c_name || ' ' AS lstrip, ' ' || c_name AS rstrip, string_split(c_name, '#') AS regexp_split,
          c_nationkey::VARCHAR AS json_a, c_mktsegment AS json_b, c_nationkey AS unnest_a, c_mktsegment AS unnest_b FROM customer""")
def scalar_aliases(t):
    n = col("c_name")
    rows = t.customer.with_column("s", Expr(L.to_struct(unnest_a="c_nationkey", unnest_b="c_mktsegment")))
    rows = rows.with_column("j", Expr(L.json_tuple(F.to_json(F.struct(F.col("c_nationkey").alias("json_a"), F.col("c_mktsegment").alias("json_b"))), "json_a", "json_b")))
    return rows.select(
        "c_custkey", Expr(L.unnest("s")), Expr(L.unnest("j")), power=col("c_custkey").power(2), columns_avg=Expr(L.columns_avg("c_nationkey", "c_acctbal")).round(6), lstrip=Expr(F.concat(F.lit(" \t"), n.column, F.lit(" "))).lstrip(),
        rstrip=Expr(F.concat(F.lit(" "), n.column, F.lit(" \n"))).rstrip(), regexp_split=n.regexp_split("#"),
    )


@query("""SELECT doc_id, array_to_string(w, '|') AS list_join, len(w) AS list_count, list_sort(w) AS list_sort, list_sort(list_distinct(w)) AS list_distinct, list_contains(w, 'the') AS list_contains, w[1:3] AS slice, w[2] AS get, w[-1] AS get_last,
          list_append(w, 'end') AS list_append, list_transform(w, lambda x: reverse(x)) AS list_map, list_filter(w, lambda x: length(x) > 10) AS list_filter, len(list_distinct(w)) AS list_count_distinct
          FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)""")
def list_basic(t):
    w = col("w")
    return t.documents.select("doc_id", w=col("text").split(" ")).select(
        "doc_id", list_join=w.list_join("|"), list_count=w.list_count(), list_sort=w.list_sort(), list_distinct=w.list_distinct().list_sort(), list_contains=w.list_contains("the"), slice=Expr(L.slice(w.column, 0, 3)), get=Expr(L.get(w.column, 1)),
        get_last=Expr(L.get(w.column, -1)), list_append=Expr(L.list_append(w.column, F.lit("end"))), list_map=Expr(L.list_map(w.column, F.reverse)), list_filter=Expr(L.list_filter(w.column, lambda x: F.length(x) > 10)),
        list_count_distinct=w.list_count_distinct(),
    )


@query("""SELECT vec_id, round(list_sum(embedding[1:8]::DOUBLE[]), 6) AS list_sum, round(list_avg(embedding[1:8]::DOUBLE[]), 6) AS list_mean, list_min(embedding) AS list_min, list_max(embedding) AS list_max,
          list_bool_and([x > 0 FOR x IN embedding[1:2]]) AS list_bool_and, list_bool_or([x > 0 FOR x IN embedding[1:2]]) AS list_bool_or, flatten([embedding[1:1], embedding[2:2]]) AS list_flatten, [embedding[1:2], embedding[3:4]] AS chunk,
          range(label % 4) AS seq, [label, label + 1] AS to_list, list_reverse_sort([label, 3, 5]) AS list_sort_desc FROM embeddings""")
def list_numbers(t):
    v = F.col("embedding")
    head, positive = L.slice(v, 0, 8), F.transform(L.slice(v, 0, 2), lambda x: x > 0)
    return t.embeddings.select(
        "vec_id", list_sum=Expr(L.list_sum(F.transform(head, lambda x: x.cast("double")))).round(6), list_mean=Expr(L.list_mean(head)).round(6), list_min=Expr(L.list_min(v)), list_max=Expr(L.list_max(v)), list_bool_and=Expr(L.list_bool_and(positive)),
        list_bool_or=Expr(L.list_bool_or(positive)), list_flatten=Expr(L.list_flatten(F.array(L.slice(v, 0, 1), L.slice(v, 1, 2)))), chunk=Expr(L.chunk(L.slice(v, 0, 5), 2)), seq=Expr(L.seq(F.col("label") % 4)),
        to_list=Expr(L.to_list(F.col("label"), F.col("label") + 1)), list_sort_desc=Expr(L.list_sort(F.array(F.col("label"), F.lit(3), F.lit(5)), desc=True)),
    )


@query("""SELECT o_orderkey, coalesce(nullif(o_orderpriority, '1-URGENT'), 'none') AS fill_null, nullif(o_orderpriority, '1-URGENT') IS NULL AS is_null, nullif(o_orderpriority, '1-URGENT') IS NOT NULL AS not_null, o_orderstatus IN ('F', 'O') AS is_in,
          nullif(o_orderstatus, 'F') IS NOT DISTINCT FROM NULL AS eq_null_safe, CASE WHEN o_totalprice > 100000 THEN 'much' ELSE 'little' END AS when_, TRY_CAST(o_orderstatus AS INTEGER) AS try_cast, CAST(o_orderkey AS VARCHAR) AS cast_,
          o_orderstatus || '+' AS concat, coalesce(nullif(o_orderstatus, 'F'), o_orderpriority) AS coalesce_ FROM orders""")
def conditionals(t):
    p, s = Expr(F.nullif("o_orderpriority", F.lit("1-URGENT"))), col("o_orderstatus")
    n = Expr(F.nullif("o_orderstatus", F.lit("F")))
    return t.orders.select(
        "o_orderkey", fill_null=p.fill_null("none"), is_null=p.is_null(), not_null=p.not_null(), is_in=s.is_in(["F", "O"]), eq_null_safe=n.eq_null_safe(lit(None)), when_=Expr(L.when((col("o_totalprice") > 100000).column, "much")).otherwise("little"),
        try_cast=s.try_cast("int"), cast_=col("o_orderkey").cast("string"), concat=s.concat("+"), coalesce_=Expr(L.coalesce(n.column, F.col("o_orderpriority"))),
    )


@query("""SELECT c_custkey, c_mktsegment AS a, c_nationkey AS b, CAST(c_nationkey + 1 AS INTEGER) AS map_get, ['x', 'y'] AS map_keys, struct_field FROM (SELECT *, c_name AS struct_field FROM customer)""")
def structs_maps(t):
    rows = t.customer.with_column("s", Expr(L.to_struct(a="c_mktsegment", b="c_nationkey", c="c_name"))).with_column("m", Expr(F.create_map(F.lit("x"), F.col("c_nationkey") + 1, F.lit("y"), F.lit(0))))
    return rows.select("c_custkey", Expr(F.col("s.a")), Expr(F.col("s.b")), map_get=Expr(L.map_get(F.col("m"), "x")), map_keys=Expr(L.map_keys(F.col("m"))), struct_field=Expr(L.get(F.col("s"), "c")))


@query("SELECT doc_id, CAST(len(list_filter(string_split(text, ' '), lambda x: x = 'the')) AS BIGINT) AS the FROM documents WHERE list_contains(string_split(text, ' '), 'the')")
def value_counts(t):
    return t.documents.select("doc_id", the=Expr(L.map_get(L.value_counts(F.split("text", " ")), "the"))).filter("the is not null")


@query()
def hashes_and_ids(t):
    x = col("text")
    return t.documents.select("doc_id", hash=x.hash(), sha=x.hash(hash_function="sha1"), minhash=x.minhash(16, 3), simhash=x.simhash(), id4=Expr(L.uuid()), id7=Expr(L.uuid(7)), number=Expr(L.random_int(1, 6, 3)), at=Expr(L.monotonically_increasing_id()))


@query(r"""SELECT doc_id, CAST('0x' || sha1(coalesce(text, chr(0)))[:15] AS BIGINT) AS sha, true AS version4, true AS version7, true AS in_range, 16 AS permutations, true AS signs, true AS own_place FROM documents""")
def hash_properties(t):
    x = col("text")
    rows = t.documents.select("doc_id", sha=x.hash(hash_function="sha1"), id4=Expr(L.uuid()), id7=Expr(L.uuid(7)), number=Expr(L.random_int(1, 6, 3)), at=Expr(L.monotonically_increasing_id()), m=x.minhash(16, 3))
    form = "^[0-9a-f]{{8}}-[0-9a-f]{{4}}-{}[0-9a-f]{{3}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}$"
    return rows.select(
        "doc_id", "sha", version4=col("id4").regexp(form.format(4)), version7=col("id7").regexp(form.format(7)), in_range=col("number").between(1, 6), permutations=Expr(F.size("m")),
        signs=Expr(F.forall("m", lambda v: v.between(0, (1 << 32) - 1))), own_place=col("at") >= 0,
    )


def _pairs(t, queries):
    """Every vector with every query."""
    return t.embeddings.select(i=col("vec_id"), x=col("embedding")).join(t.embeddings.filter(queries).select(j=col("vec_id"), y=col("embedding")), how="cross")


_E = "(SELECT a.vec_id AS i, b.vec_id AS j, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) b)"
#: The query set of the searches.
_EVERY = "vec_id % 50 = 0"


@query(f"""SELECT i, j, round(list_dot_product(x, y), 6) AS dot_product, round(list_cosine_similarity(x, y), 6) AS cosine_similarity, round(list_cosine_distance(x, y), 6) AS cosine_distance, round(list_distance(x, y), 6) AS euclidean_distance,
           CAST(bit_count(xor(i, j)) AS INTEGER) AS hamming_distance FROM {_E}""")
def vector_distances(t):
    return _sides(t, _EVERY, ("dot_product", "cosine_similarity", "cosine_distance", "euclidean_distance")).with_column("hamming_distance", col("i").hamming_distance(col("j")))


def _sides(t, queries, measures):
    """Every vector with every query, in blocks."""
    return t.embeddings.select(i=col("vec_id"), x=col("embedding")).vector_pairs(t.embeddings.filter(queries).select(j=col("vec_id"), y=col("embedding")), measures, 6)


@query(f"""SELECT i, j, round((SELECT corr(u, v) FROM (SELECT unnest(x) AS u, unnest(y) AS v)), 6) AS pearson_correlation, 1.0::DOUBLE AS jaccard_similarity FROM {_E}""")
def vector_correlations(t):
    return _sides(t, _EVERY, ("pearson_correlation", "jaccard_similarity"))


@query(f"""SELECT i, j, d FROM (SELECT i, j, d, row_number() OVER (PARTITION BY j ORDER BY d, i) AS n FROM (SELECT i, j, round(list_distance(x, y), 6) AS d FROM {_E})) WHERE n <= 3""")
def vector_top_k(t):
    return _nearest(_pairs(t, _EVERY))


def _nearest(pairs):
    from ..operators.window import Window

    rows = pairs.select("i", "j", d=col("x").euclidean_distance(col("y")).round(6))
    return rows.with_column("n", Window().partition_by("j").order_by("d", "i").apply(F.row_number())).filter("n <= 3").exclude("n")


@query("""SELECT c_custkey, round(2 * 6371008.8 * asin(sqrt(pow(sin(radians(b - a) / 2), 2) + cos(radians(a)) * cos(radians(b)) * pow(sin(radians(10) / 2), 2))), 3) AS metres
          FROM (SELECT c_custkey, c_nationkey::DOUBLE AS a, (c_nationkey + 20)::DOUBLE AS b FROM customer)""")
def great_circle(t):
    n = col("c_nationkey").cast("double")
    return t.customer.select("c_custkey", metres=Expr(L.great_circle_distance(n.column, F.lit(0.0), (n + 20).column, F.lit(10.0))).round(3))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS days, CAST(floor(epoch(o_orderdate) / 3600) AS INTEGER) AS hours, (year(o_orderdate) - 1970) * 12 + month(o_orderdate) - 1 AS months, year(o_orderdate) - 1970 AS years,
          o_orderkey - o_orderkey % 10 AS truncated, left(o_orderpriority, 3) AS truncated_text FROM orders""")
def partition_transforms(t):
    x = col("o_orderdate")
    return t.orders.select(
        "o_orderkey", days=x.partition_days(), hours=x.partition_hours(), months=x.partition_months(), years=x.partition_years(), truncated=col("o_orderkey").partition_iceberg_truncate(10),
        truncated_text=Expr(L.partition_iceberg_truncate("o_orderpriority", 3, "string")),
    )


@query("SELECT minute, hour, day, month FROM (VALUES (28401120::BIGINT, 473352::BIGINT, 19723::BIGINT, 648)) v(minute, hour, day, month)")
def uuid7_times(t):
    u = F.lit("018cc251-f400-7000-8000-000000000000")
    one = t.region.filter("r_regionkey = 0")
    return one.select(minute=Expr(L.extract_minute_uuid7(u)), hour=Expr(L.extract_hour_uuid7(u)), day=Expr(L.extract_day_uuid7(u)), month=Expr(L.extract_month_uuid7(u)))


#: The table format's hash of a 64-bit number, step by step; every step names the one before.
_MURMUR = """SELECT o_orderkey, o_orderpriority, xor(f2, f2 >> 16) AS hashed FROM (SELECT *, o_orderkey::UBIGINT AS k, 4294967295::UBIGINT AS m, 3432918353::UBIGINT AS c, 461845907::UBIGINT AS d, 3864292196::UBIGINT AS e,
    ((k & m) * c) & m AS a1, ((((a1 << 15) | (a1 >> 17)) & m) * d) & m AS b1, ((((b1 << 13) | (b1 >> 19)) & m) * 5::UBIGINT + e) & m AS h1, ((k >> 32) * c) & m AS a2, ((((a2 << 15) | (a2 >> 17)) & m) * d) & m AS b2, xor(h1, b2) AS x2,
    ((((x2 << 13) | (x2 >> 19)) & m) * 5::UBIGINT + e) & m AS h2, xor(h2, 8::UBIGINT) AS f0, (xor(f0, f0 >> 16) * 2246822507::UBIGINT) & m AS f1, (xor(f1, f1 >> 13) * 3266489909::UBIGINT) & m AS f2 FROM orders)"""


@query(f"""SELECT o_orderkey, CAST((hashed & 2147483647::UBIGINT) % 16::UBIGINT AS INTEGER) AS bucket,
           CASE o_orderpriority WHEN '1-URGENT' THEN 9 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 9 WHEN '4-NOT SPECIFIED' THEN 12 WHEN '5-LOW' THEN 2 END AS text_bucket FROM ({_MURMUR})""")
def iceberg_buckets(t):
    return t.orders.select("o_orderkey", bucket=col("o_orderkey").partition_iceberg_bucket(16), text_bucket=col("o_orderpriority").partition_iceberg_bucket(16))


@query("""SELECT page_id, to_base64(encode(url)) AS b64, lower(hex(encode(url))) AS hexed, url AS back64, url AS backhex, url AS gz, url AS zlibbed, url AS deflated FROM pages""")
def binary_codecs(t):
    u = col("url")
    text = lambda c: Expr(c.cast("string"))
    return t.pages.select(
        "page_id", b64=text(L.encode("url", "base64")), hexed=text(L.encode("url", "hex")), back64=text(L.decode(L.encode("url", "base64"), "base64")), backhex=text(L.decode(L.encode("url", "hex"), "hex")),
        gz=text(L.decompress(L.compress(u.column, "gzip"), "gzip")), zlibbed=text(L.try_decompress(L.try_compress(u.column, "zlib"), "zlib")), deflated=text(L.decode(L.encode(u.column, "deflate"), "deflate")),
    )


@query(r"""SELECT page_id, regexp_extract(url, '^(\w+)://', 1) AS scheme, regexp_extract(url, '://([^/:?#]+)', 1) AS host, regexp_extract(url, '://[^/]+(/[^?#]*)', 1) AS path, nullif(regexp_extract(url, '\?([^#]*)', 1), '') AS query FROM pages""")
def url_parts(t):
    u = L.parse_url("url")
    return t.pages.select("page_id", scheme=Expr(u.getField("scheme")), host=Expr(u.getField("host")), path=Expr(u.getField("path")), query=Expr(u.getField("query")))


@query("SELECT page_id, 'text/html' AS kind FROM pages")
def mime_types(t):
    return t.pages.select("page_id", kind=Expr(L.guess_mime_type(F.concat(F.lit("<html"), F.col("html")).cast("binary"))))


@query("SELECT p_partkey, 4 AS height, 4 AS width, 3 AS channel, 'L' AS gray, 2 AS small, true AS same FROM part")
def images(t):
    return _images(t.part)


def _images(parts):
    from ..functions import media

    raw = F.struct(F.expr("unhex(repeat(lpad(hex(p_size), 2, '0'), 48))").alias("data"), F.lit(4).alias("height"), F.lit(4).alias("width"), F.lit(3).alias("channel"), F.lit("RGB").alias("mode"))
    rows = parts.select("p_partkey", image=Expr(raw))
    back = rows.with_column("back", Expr(media.decode_image(media.encode_image("image"))))
    b = F.col("back")
    return back.select(
        "p_partkey", height=Expr(L.image_height(b)), width=Expr(L.image_width(b)), channel=Expr(L.image_channel(b)), gray=Expr(L.image_mode(L.convert_image(b, "L"))), small=Expr(L.image_height(L.crop(L.resize(b, 8, 8), (1, 1, 2, 2)))),
        same=Expr((b.getField("data") == F.col("image.data")) & (F.length(L.image_hash(b, "dhash")) == 8)),
    )


@query()
def model_functions(t):
    x = F.col("text")
    return t.benchmark.select("item_id", vector=Expr(L.embed_text(x)), label=Expr(L.classify_text(x, ["one", "two"])), answer=Expr(L.prompt(x)))


@query("SELECT doc_id, text AS back FROM documents")
def tokenizer_round_trip(t):
    return _round_trip(t.documents)


def _round_trip(documents):
    import public_tokenizers as p

    path = p.path("byte_bpe_50k.tiktoken")
    return documents.select("doc_id", back=Expr(L.tokenize_decode(L.tokenize_encode("text", path, p.PATTERN), path, p.PATTERN)))


@query("SELECT r_regionkey, r_name || chr(10) AS said FROM region")
def run_process(t):
    return t.region.select("r_regionkey", said=Expr(L.run_process([F.lit("echo"), F.col("r_name")])))
