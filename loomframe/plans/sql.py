"""The SQL surface: decision-support queries adapted to the tables at hand, and one query for each construct."""

from .registry import portable

_SQL = {
    "tpch_q1": """
        SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
               round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
               round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "tpch_q3": """
        SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, o_orderdate
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1995-03-15 00:00:00'
        GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""",
    "tpch_q4_priorities": """
        SELECT o_orderpriority, count(*) AS order_count FROM orders
        WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate AND l_quantity > 25) GROUP BY o_orderpriority""",
    "tpch_q5": """
        SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00' GROUP BY n_name""",
    "tpch_q6": """
        SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
        WHERE l_shipdate >= TIMESTAMP '1994-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1995-01-01 00:00:00' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
    "tpch_q7": """
        SELECT supp_nation, cust_nation, l_year, round(sum(volume), 4) AS revenue FROM (
            SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(extract(YEAR FROM l_shipdate) AS BIGINT) AS l_year, l_extendedprice * (1 - l_discount) AS volume
            FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
            JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey
            WHERE ((n1.n_name = 'NATION_6' AND n2.n_name = 'NATION_7') OR (n1.n_name = 'NATION_7' AND n2.n_name = 'NATION_6')) AND l_shipdate BETWEEN TIMESTAMP '1995-01-01 00:00:00' AND TIMESTAMP '1996-12-31 00:00:00') shipping
        GROUP BY supp_nation, cust_nation, l_year""",
    "tpch_q8": """
        SELECT o_year, round(sum(CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM (
            SELECT CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS o_year, l_extendedprice * (1 - l_discount) AS volume, n2.n_name AS nation
            FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey
            JOIN customer ON o_custkey = c_custkey JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN region ON n1.n_regionkey = r_regionkey
            JOIN nation n2 ON s_nationkey = n2.n_nationkey WHERE r_name = 'EUROPE' AND p_type = 'ECONOMY' AND o_orderdate BETWEEN TIMESTAMP '1995-01-01 00:00:00' AND TIMESTAMP '1996-12-31 00:00:00') all_nations
        GROUP BY o_year""",
    "tpch_q9_profit": """
        SELECT n_name AS nation, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS o_year, round(sum(l_extendedprice * (1 - l_discount) - p_retailprice * 0.1 * l_quantity), 4) AS sum_profit
        FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey
        WHERE p_name LIKE '%blue%' GROUP BY n_name, extract(YEAR FROM o_orderdate)""",
    "tpch_q10": """
        SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, c_acctbal, n_name
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
        WHERE l_returnflag = 'R' AND o_orderdate >= TIMESTAMP '1995-10-01 00:00:00' AND o_orderdate < TIMESTAMP '1996-01-01 00:00:00' GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "tpch_q14": """
        SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1995-09-01 00:00:00' AND l_shipdate < TIMESTAMP '1996-10-01 00:00:00'""",
    "tpch_q15": """
        WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total_revenue FROM lineitem GROUP BY l_suppkey)
        SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN revenue ON s_suppkey = supplier_no WHERE total_revenue = (SELECT max(total_revenue) FROM revenue)""",
    "tpch_q17_small_quantities": """
        SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey
        WHERE p_size < 25 AND l_quantity < (SELECT 0.5 * avg(i.l_quantity) FROM lineitem i WHERE i.l_partkey = p_partkey)""",
    "tpch_q18": """
        SELECT c_name, c_custkey, o_orderkey, o_totalprice, round(sum(l_quantity), 2) AS total_qty FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
        WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 300) GROUP BY c_name, c_custkey, o_orderkey, o_totalprice""",
    "tpch_q22_idle_customers": """
        SELECT c_nationkey, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer
        WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)
        GROUP BY c_nationkey""",
    # Offers of parts by suppliers come from the lines; dates of receipt and shipping modes aren't in the tables.
    "tpch_q2_cheapest_suppliers": """
        WITH offers AS (SELECT l_partkey AS partkey, l_suppkey AS suppkey, round(min(l_extendedprice / l_quantity), 8) AS cost FROM lineitem GROUP BY l_partkey, l_suppkey)
        SELECT s_acctbal, s_name, n_name, p_partkey, p_brand, cost FROM part JOIN offers o ON p_partkey = o.partkey JOIN supplier ON s_suppkey = o.suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE p_size = 15 AND p_type = 'STANDARD' AND r_name = 'EUROPE' AND cost = (
            SELECT min(i.cost) FROM offers i JOIN supplier s ON s.s_suppkey = i.suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE i.partkey = p_partkey AND r.r_name = 'EUROPE')
        ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
    "tpch_q11_important_stock": """
        WITH stock AS (SELECT l_partkey AS partkey, sum(l_extendedprice * l_quantity) AS worth FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 3 GROUP BY l_partkey)
        SELECT partkey, round(worth, 2) AS worth FROM stock WHERE worth > (SELECT sum(worth) * 0.001 FROM stock)""",
    "tpch_q12_line_priorities": """
        SELECT l_returnflag, sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS high_line_count,
               sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS low_line_count
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag IN ('R', 'A') AND l_shipdate > o_orderdate AND l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-01-01 00:00:00' GROUP BY l_returnflag""",
    "tpch_q13_orders_of_customers": """
        SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%' GROUP BY c_custkey) c_orders
        GROUP BY c_count""",
    "tpch_q16_suppliers_of_parts": """
        SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM lineitem JOIN part ON p_partkey = l_partkey
        WHERE p_brand <> 'Brand#4' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size""",
    "tpch_q19_alternatives": """
        SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey
        WHERE (p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 5) OR (p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 10)
           OR (p_brand = 'Brand#4' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 15)""",
    "tpch_q20_excess_suppliers": """
        SELECT s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2 AND s_suppkey IN (
            SELECT suppkey FROM (SELECT l_partkey AS partkey, l_suppkey AS suppkey, sum(l_quantity) AS available FROM lineitem GROUP BY l_partkey, l_suppkey) offers
            WHERE partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'blue%') AND available < 4 * (
                SELECT sum(l_quantity) FROM lineitem WHERE l_partkey = partkey AND l_suppkey = suppkey AND l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00'))""",
    "tpch_q21_late_suppliers": """
        SELECT s_name, count(*) AS numwait FROM supplier JOIN lineitem l1 ON s_suppkey = l1.l_suppkey JOIN orders ON o_orderkey = l1.l_orderkey JOIN nation ON s_nationkey = n_nationkey
        WHERE o_orderstatus = 'F' AND l1.l_shipdate > o_orderdate + INTERVAL '60' DAY AND n_regionkey = 1 AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
          AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_shipdate > o_orderdate + INTERVAL '60' DAY)
        GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
    "sql_cte_case": """
        WITH sized (pkey, size_class) AS (SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END FROM part)
        SELECT size_class, count(*) AS parts, min(pkey) AS first_part FROM sized GROUP BY size_class""",
    "sql_group_having": "SELECT o_custkey, count(*) AS n, round(max(o_totalprice), 2) AS most FROM orders GROUP BY 1 HAVING count(*) > 10",
    "sql_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "sql_distinct_in_between": "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer WHERE c_nationkey IN (1, 3, 5) AND c_acctbal BETWEEN 0 AND 5000",
    "sql_order_limit_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 15 OFFSET 5",
    "sql_window": """
        SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth,
               round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving FROM orders""",
    "sql_semi_anti": "SELECT c_custkey, c_name FROM customer ANTI JOIN orders ON c_custkey = o_custkey",
    "sql_using_full": """
        SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation WHERE n_nationkey < 15) FULL JOIN (SELECT s_suppkey AS k, s_name AS b FROM supplier) USING (k)""",
    "sql_set_operations": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation WHERE n_regionkey = 0",
    "sql_casts": "SELECT p_partkey, CAST(floor(p_retailprice) AS INTEGER) AS whole, TRY_CAST(p_name AS INTEGER) AS nothing, CAST(p_size AS VARCHAR(10)) AS size_text FROM part",
    "sql_like_extract": "SELECT event_id, CAST(extract(HOUR FROM ts) AS BIGINT) AS hour, event_type LIKE 'p%' AS p FROM events WHERE event_type ILIKE '%U%'",
    "clicks_by_type": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean FROM events GROUP BY event_type",
    "clicks_top_users": "SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10",
    "clicks_by_hour": "SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY date_trunc('hour', ts)",
    "clicks_filtered": "SELECT count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events WHERE user_id = 7 OR (event_type = 'purchase' AND value > 50)",
    "clicks_wide_sums": "SELECT " + ", ".join(f"round(sum(value + {i}), 3) AS s{i}" for i in range(20)) + " FROM events",
    "clicks_error_rate": """
        SELECT user_id, round(sum(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) / count(*), 6) AS rate FROM events GROUP BY user_id HAVING count(*) > 5""",
    "clicks_hosts": "SELECT split_part(url, '/', 3) AS host, count(*) AS n, round(avg(length(html)), 3) AS size FROM pages GROUP BY split_part(url, '/', 3)",
    "clicks_first_purchase": """
        SELECT user_id, min(CASE WHEN event_type = 'view' THEN ts END) AS first_view, min(CASE WHEN event_type = 'purchase' THEN ts END) AS first_purchase FROM events GROUP BY user_id""",
    "store_sales_by_year": """
        SELECT CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y, o_orderpriority, count(*) AS n, round(sum(o_totalprice) / 1000, 1) AS thousands,
               rank() OVER (PARTITION BY extract(YEAR FROM o_orderdate) ORDER BY count(*) DESC, o_orderpriority) AS place
        FROM orders GROUP BY extract(YEAR FROM o_orderdate), o_orderpriority""",
    "store_ratio_to_group": """
        SELECT p_partkey, p_type, round(p_retailprice * 100.0 / sum(p_retailprice) OVER (PARTITION BY p_type), 6) AS share FROM part""",
    "store_customers_in_both": """
        SELECT count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') t""",
    "store_union_channels": """
        SELECT channel, count(*) AS n, round(sum(amount), 2) AS total FROM (
            SELECT 'order' AS channel, o_totalprice AS amount FROM orders WHERE o_totalprice < 20000 UNION ALL SELECT 'event', value FROM events WHERE value IS NOT NULL) s GROUP BY channel""",
    "talks_turns": "SELECT conv_id, count(*) AS turns, max(turn) AS last_turn, sum(length(text)) AS characters FROM conversations GROUP BY conv_id",
    "talks_replies": """
        SELECT a.conv_id, a.turn, a.role AS asked, b.role AS answered FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role <> b.role""",
    "labels_joined": """
        SELECT lang, count(*) AS n, sum(quality) AS good, sum(toxic) AS bad FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id GROUP BY lang""",
}
for _name, _text in _SQL.items():
    portable(_name, _text)
