"""The library's functions in SQL text, a query for each family."""

from .registry import engine_sql

engine_sql(
    "sql_functions_numbers",
    """SELECT p_partkey, round(arccos(1 / p_size), 9) AS arccos, round(arctan2(p_size, 2), 9) AS arctan2, negate(p_size) AS negate, shift_left(p_size, 2) AS shift_left, bitwise_and(p_size, 12) AS bitwise_and, bitwise_xor(p_size, 5) AS bitwise_xor,
       clip(p_retailprice, 1000, 1200) AS clip, round(ln(p_size - 1), 9) AS ln, round(log2(p_size), 9) AS log2, is_nan(p_retailprice) AS is_nan, is_inf(ln(p_size - 1)) AS is_inf, is_null(nullif(p_size, 1)) AS is_null,
       eq_null_safe(nullif(p_size, 1), NULL) AS eq_null_safe, fill_null(nullif(p_size, 1), 7) AS fill_null, is_in(p_size, to_list(1, 2, 3)) AS is_in, round(columns_sum(p_size, p_retailprice, NULL), 6) AS columns_sum,
       round(columns_mean(p_size, p_retailprice, NULL), 6) AS columns_mean, columns_max(p_size, 20) AS columns_max FROM part""",
    """SELECT p_partkey, round(acos(1 / p_size), 9) AS arccos, round(atan2(p_size, 2), 9) AS arctan2, -p_size AS negate, p_size << 2 AS shift_left, p_size & 12 AS bitwise_and, xor(p_size, 5) AS bitwise_xor,
       least(greatest(p_retailprice, 1000), 1200) AS clip, CASE WHEN p_size = 1 THEN '-inf'::DOUBLE ELSE round(ln(greatest(p_size - 1, 1)), 9) END AS ln, round(log2(p_size), 9) AS log2, false AS is_nan, p_size = 1 AS is_inf, p_size = 1 AS is_null,
       p_size = 1 AS eq_null_safe, CASE WHEN p_size = 1 THEN 7 ELSE p_size END AS fill_null, p_size IN (1, 2, 3) AS is_in, round(p_size + p_retailprice, 6) AS columns_sum, round((p_size + p_retailprice) / 2, 6) AS columns_mean,
       greatest(p_size, 20) AS columns_max FROM part""",
)
engine_sql(
    "sql_functions_text",
    """SELECT c_custkey, strip(concat('  ', c_name, ' ')) AS strip, lstrip(concat(' ', c_name, ' ')) AS lstrip, capitalize(c_mktsegment) AS capitalize, to_snake_case('helloWorldFoo') AS snake, to_upper_kebab_case('helloWorldFoo') AS kebab,
       to_camel_case('Hello world-foo') AS camel, length_bytes(c_name) AS length_bytes, find(c_name, '#') AS find, count_matches(c_name, '0') AS count_matches, levenshtein_distance(c_name, c_mktsegment) AS levenshtein,
       round(jaro_winkler_similarity(c_name, c_mktsegment), 9) AS winkler, damerau_levenshtein_distance(c_name, c_mktsegment) AS damerau, hamming_distance_str(c_mktsegment, upper(c_mktsegment)) AS hamming,
       regexp_extract(c_name, '#0*(7[0-9]*)', 1) AS regexp_extract, list_join(regexp_split(c_name, '[#]'), '(strip(x)') AS split, ascii_func(c_name) AS ascii_, 'strip(a, ''b)' AS quoted FROM customer""",
    r"""SELECT c_custkey, c_name AS strip, c_name || ' ' AS lstrip, upper(left(c_mktsegment, 1)) || lower(c_mktsegment[2:]) AS capitalize, 'hello_world_foo' AS snake, 'HELLO-WORLD-FOO' AS kebab,
       'helloWorldFoo' AS camel, strlen(c_name) AS length_bytes, instr(c_name, '#') - 1 AS find, len(regexp_extract_all(c_name, '0')) AS count_matches, levenshtein(c_name, c_mktsegment) AS levenshtein,
       round(jaro_winkler_similarity(c_name, c_mktsegment), 9) AS winkler, damerau_levenshtein(c_name, c_mktsegment) AS damerau, hamming(c_mktsegment, upper(c_mktsegment)) AS hamming,
       nullif(regexp_extract(c_name, '#0*(7[0-9]*)', 1), '') AS regexp_extract, array_to_string(string_split(c_name, '#'), '(strip(x)') AS split, ascii(c_name) AS ascii_, 'strip(a, ''b)' AS quoted FROM customer""",
)
engine_sql(
    "sql_functions_lists",
    """SELECT vec_id, round(list_sum(list_map(slice(embedding, 1, 8), x -> double(x))), 6) AS list_sum, round(list_mean(slice(embedding, 1, 8)), 6) AS list_mean, list_min(embedding) AS list_min, list_max(embedding) AS list_max, list_count(embedding) AS list_count,
       list_bool_or(list_map(slice(embedding, 1, 2), x -> x > 0)) AS list_bool_or, list_bool_and(list_map(slice(embedding, 1, 2), x -> x > 0)) AS list_bool_and, list_sort(to_list(label, 3, NULL, 1)) AS list_sort,
       list_distinct(to_list(label, 1, NULL, 1)) AS list_distinct, list_count_distinct(to_list(label, 1, NULL, 1)) AS list_count_distinct, list_contains(to_list(1, 2), label) AS list_contains, list_append(to_list(label), 9) AS list_append,
       list_fill(2, label) AS list_fill, list_flatten(to_list(to_list(label), to_list(1, 2))) AS list_flatten, seq(label % 4) AS seq, chunk(to_list(1, 2, label, 4, 5), 2) AS chunk, map_get(map('a', label), 'a') AS map_get,
       list_filter(to_list(label, 1, 2), x -> x > 1) AS list_filter FROM embeddings""",
    """SELECT vec_id, round(list_sum(embedding[1:8]::DOUBLE[]), 6) AS list_sum, round(list_avg(embedding[1:8]::DOUBLE[]), 6) AS list_mean, list_min(embedding) AS list_min, list_max(embedding) AS list_max, len(embedding) AS list_count,
       list_bool_or([x > 0 FOR x IN embedding[1:2]]) AS list_bool_or, list_bool_and([x > 0 FOR x IN embedding[1:2]]) AS list_bool_and, list_sort([label, 3, NULL, 1], 'ASC', 'NULLS LAST') AS list_sort,
       CASE WHEN label = 1 THEN [1] ELSE [label, 1] END AS list_distinct, CASE WHEN label = 1 THEN 1 ELSE 2 END AS list_count_distinct, label IN (1, 2) AS list_contains, [label, 9] AS list_append, [label, label] AS list_fill, [label, 1, 2] AS list_flatten,
       range(label % 4) AS seq, [[1, 2], [label, 4]] AS chunk, label AS map_get, list_filter([label, 1, 2], lambda x: x > 1) AS list_filter FROM embeddings""",
)
engine_sql(
    "sql_functions_times",
    """SELECT event_id, day_of_month(ts) AS day_of_month, day_of_week(ts) AS day_of_week, day_of_year(ts) AS day_of_year, week_of_year(ts) AS week_of_year, millisecond(ts) AS millisecond, microsecond(ts) AS microsecond,
       strftime(ts, '%Y/%m/%d at %H:%M') AS strftime, to_datetime(strftime(ts, '%d.%m.%Y %H'), '%d.%m.%Y %H') AS to_datetime, to_unix_epoch(ts) AS to_unix_epoch, convert_time_zone(ts, 'America/New_York') AS convert_time_zone,
       total_hours(ts - TIMESTAMP_NTZ'1990-01-01 00:00:00') AS total_hours, total_days(ts - TIMESTAMP_NTZ'1990-01-01 00:00:00') AS total_days, partition_days(ts) AS partition_days, partition_hours(ts) AS partition_hours,
       partition_months(ts) AS partition_months, partition_years(ts) AS partition_years, partition_iceberg_truncate(event_id, 10) AS truncated FROM events""",
    """SELECT event_id, day(ts) AS day_of_month, isodow(ts) - 1 AS day_of_week, dayofyear(ts) AS day_of_year, weekofyear(ts) AS week_of_year, CAST(epoch_us(ts) % 1000000 // 1000 AS INTEGER) AS millisecond, CAST(epoch_us(ts) % 1000000 AS INTEGER) AS microsecond,
       strftime(ts, '%Y/%m/%d at %H:%M') AS strftime, date_trunc('hour', ts) AS to_datetime, CAST(floor(epoch(ts)) AS BIGINT) AS to_unix_epoch, ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS convert_time_zone,
       epoch_us(ts - TIMESTAMP '1990-01-01') // 3600000000 AS total_hours, epoch_us(ts - TIMESTAMP '1990-01-01') // 86400000000 AS total_days, CAST(ts AS DATE) AS partition_days, CAST(floor(epoch_us(ts) / 3600000000) AS INTEGER) AS partition_hours,
       (year(ts) - 1970) * 12 + month(ts) - 1 AS partition_months, year(ts) - 1970 AS partition_years, event_id - event_id % 10 AS truncated FROM events""",
)
_PAIRS = "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
engine_sql(
    "sql_functions_vectors",
    f"""SELECT a.vec_id, round(dot_product(a.embedding, b.embedding), 6) AS dot, round(euclidean_distance(a.embedding, b.embedding), 6) AS euclidean, round(cosine_similarity(a.embedding, b.embedding), 6) AS similarity,
        round(cosine_distance(a.embedding, b.embedding), 6) AS distance, hamming_distance(a.vec_id, b.vec_id) AS bits, round(jaccard_similarity(list_map(a.embedding, x -> if(x > 0, x, 0)), list_map(b.embedding, x -> if(x > 0, x, 0))), 6) AS jaccard {_PAIRS}""",
    f"""SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS euclidean,
        round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity, round(list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance, CAST(bit_count(xor(a.vec_id, b.vec_id)) AS INTEGER) AS bits,
        round(len(list_filter(list_zip(a.embedding, b.embedding), lambda p: p[1] > 0 AND p[2] > 0)) / len(list_filter(list_zip(a.embedding, b.embedding), lambda p: p[1] > 0 OR p[2] > 0)), 6) AS jaccard {_PAIRS}""",
)
engine_sql("sql_sampling", "SELECT count(*) AS n FROM orders TABLESAMPLE (100 PERCENT)", "SELECT count(*) AS n FROM orders")
engine_sql(
    "sql_values_unnest",
    """SELECT k, item, n_name FROM (SELECT k, item FROM VALUES (0, array('a', 'b')), (1, array('c')) AS v(k, items) LATERAL VIEW explode(items) e AS item) JOIN nation ON n_nationkey = k""",
    """SELECT k, item, n_name FROM (SELECT k, unnest(items) AS item FROM (VALUES (0, ['a', 'b']), (1, ['c'])) v(k, items)) JOIN nation ON n_nationkey = k""",
)
engine_sql(
    "sql_distinct_on",
    """SELECT o_custkey, o_orderkey, upper(o_orderstatus) AS status, n FROM (SELECT DISTINCT ON (o_custkey, o_orderstatus) o_custkey, o_orderkey, o_orderstatus, (SELECT count(*) FROM nation) AS n
       FROM orders WHERE o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey) WHERE o_custkey > 1""",
    """SELECT o_custkey, o_orderkey, upper(o_orderstatus) AS status, n FROM (SELECT DISTINCT ON (o_custkey, o_orderstatus) o_custkey, o_orderkey, o_orderstatus, (SELECT count(*) FROM nation) AS n
       FROM orders WHERE o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey) WHERE o_custkey > 1""",
)
