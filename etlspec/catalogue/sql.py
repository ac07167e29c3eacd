"""Coverage of the ``sql`` transform: each query is a spec of one step."""

from __future__ import annotations

from etlspec.catalogue.base import by_sql

by_sql(
    "sql_topk",
    ["orders"],
    """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50""",
)
by_sql(
    "sql_union",
    ["customer", "supplier"],
    """SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey AS nationkey FROM supplier""",
)
by_sql(
    "sql_intersect",
    ["customer", "supplier"],
    """SELECT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey AS nationkey FROM supplier""",
)
by_sql(
    "sql_except",
    ["customer", "orders"],
    """SELECT c_custkey AS custkey FROM customer
       EXCEPT SELECT o_custkey AS custkey FROM orders WHERE o_totalprice > 400000""",
)
_SUM_PRICE = "CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price"
by_sql(
    "sql_rollup",
    ["lineitem"],
    f"""SELECT l_returnflag, l_linestatus, count(*) AS n, {_SUM_PRICE} FROM lineitem
        GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
)
by_sql(
    "sql_cube",
    ["orders"],
    """SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders
       GROUP BY CUBE (o_orderstatus, o_orderpriority)""",
)
by_sql(
    "sql_grouping_sets",
    ["part"],
    """SELECT p_brand, p_type, count(*) AS n, min(p_retailprice) AS lowest FROM part
       GROUP BY GROUPING SETS ((p_brand), (p_type), ())""",
)
by_sql(
    "sql_semi_anti",
    ["customer", "orders"],
    """SELECT c_custkey, c_name FROM customer c
       WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')
         AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 450000)""",
)
# A range condition next to an equality, so that the join is partitioned by key.
by_sql(
    "sql_range_join",
    ["orders", "lineitem"],
    """SELECT o.o_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey FROM orders o JOIN lineitem l
       ON l.l_orderkey = o.o_orderkey
      AND l.l_shipdate > o.o_orderdate AND l.l_shipdate < o.o_orderdate + INTERVAL '90' DAY""",
)
by_sql(
    "sql_cte_subquery",
    ["orders"],
    """WITH totals AS (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
                       FROM orders GROUP BY o_custkey)
       SELECT o_custkey, total FROM totals
       WHERE total > (SELECT 2 * CAST(sum(CAST(total AS DECIMAL(18,2))) AS DOUBLE) / count(*) FROM totals)""",
)
by_sql("sql_distinct", ["lineitem"], "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
by_sql(
    "sql_string_funcs",
    ["customer"],
    """SELECT c_custkey, upper(c_name) AS upper_name, length(c_name) AS n, substring(c_name, 10, 9) AS digits,
              replace(c_mktsegment, 'MACHINE', 'machine') AS segment, trim(concat('  ', c_mktsegment, ' ')) AS trimmed,
              lpad(CAST(c_nationkey AS STRING), 4, '0') AS padded, reverse(c_mktsegment) AS reversed,
              c_mktsegment LIKE '%IN%' AS has_in
       FROM customer""",
)
by_sql(
    "sql_date_funcs",
    ["orders"],
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m,
              CAST(day(o_orderdate) AS INT) AS d, CAST(quarter(o_orderdate) AS INT) AS q,
              date_format(o_orderdate, 'yyyy-MM') AS ym,
              CAST(datediff(DATE'2000-01-01', CAST(o_orderdate AS DATE)) AS INT) AS days_left,
              date_format(last_day(o_orderdate), 'yyyy-MM-dd') AS month_end
       FROM orders""",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m,
              CAST(day(o_orderdate) AS INT) AS d, CAST(quarter(o_orderdate) AS INT) AS q,
              strftime(o_orderdate, '%Y-%m') AS ym,
              CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS INT) AS days_left,
              strftime(last_day(o_orderdate), '%Y-%m-%d') AS month_end
       FROM orders""",
)
by_sql(
    "sql_math_funcs",
    ["part"],
    """SELECT p_partkey, abs(p_retailprice - 1000) AS distance, CAST(floor(p_retailprice) AS BIGINT) AS low,
              CAST(ceil(p_retailprice) AS BIGINT) AS high, p_size % 7 AS remainder, sqrt(p_size) AS root,
              greatest(p_size, 25) AS at_least, least(p_size, 25) AS at_most,
              CASE WHEN p_size > 25 THEN 1 WHEN p_size < 25 THEN -1 ELSE 0 END AS side
       FROM part""",
)
by_sql(
    "sql_array_map",
    ["embeddings"],
    """SELECT vec_id, size(embedding) AS n, CAST(embedding[0] AS DOUBLE) AS head,
              CAST(array_max(embedding) AS DOUBLE) AS top, CAST(array_min(embedding) AS DOUBLE) AS low,
              size(filter(embedding, x -> x > 0)) AS n_positive,
              CAST(map('head', embedding[0], 'second', embedding[1])['second'] AS DOUBLE) AS second
       FROM embeddings""",
    """SELECT vec_id, CAST(len(embedding) AS INT) AS n, CAST(embedding[1] AS DOUBLE) AS head,
              CAST(list_max(embedding) AS DOUBLE) AS top, CAST(list_min(embedding) AS DOUBLE) AS low,
              CAST(len(list_filter(embedding, lambda x: x > 0)) AS INT) AS n_positive,
              CAST(embedding[2] AS DOUBLE) AS second
       FROM embeddings""",
)
by_sql(
    "sql_json",
    ["events"],
    """SELECT event_type, CAST(get_json_object(props, '$.k') AS INT) AS k, count(*) AS n
       FROM events GROUP BY event_type, CAST(get_json_object(props, '$.k') AS INT)""",
    """SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n
       FROM events GROUP BY event_type, CAST(json_extract_string(props, '$.k') AS INT)""",
)
by_sql(
    "sql_time_bucket",
    ["events"],
    """SELECT date_format(window.start, 'yyyy-MM-dd HH:mm:ss') AS bucket, event_type, count(*) AS n,
              max(value) AS largest
       FROM events GROUP BY window(ts, '15 minutes'), event_type""",
    """SELECT strftime(time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS bucket,
              event_type, count(*) AS n, max(value) AS largest
       FROM events GROUP BY ALL""",
)
by_sql(
    "sql_window_frame",
    ["events"],
    """SELECT event_id, user_id, max(value) OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id NULLS FIRST
              ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent_max
       FROM events""",
)
by_sql(
    "sql_tpch_q1",
    ["lineitem"],
    """SELECT l_returnflag, l_linestatus,
              round(sum(l_quantity), 2) AS sum_qty,
              round(sum(l_extendedprice), 2) AS sum_base_price,
              CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE)
                  AS sum_disc_price,
              round(sum(l_quantity), 2) / count(*) AS avg_qty,
              round(sum(l_discount), 2) / count(*) AS avg_disc,
              count(*) AS count_order
       FROM lineitem WHERE l_shipdate <= DATE '1998-09-02'
       GROUP BY l_returnflag, l_linestatus""",
)
_REVENUE = """CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE)"""
by_sql(
    "sql_tpch_q3",
    ["customer", "orders", "lineitem"],
    f"""SELECT l_orderkey, {_REVENUE} AS revenue, date_format(o_orderdate, 'yyyy-MM-dd') AS o_orderdate
        FROM customer, orders, lineitem
        WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
          AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15'
        GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""",
    f"""SELECT l_orderkey, {_REVENUE} AS revenue, strftime(o.o_orderdate, '%Y-%m-%d') AS o_orderdate
        FROM customer, orders o, lineitem
        WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
          AND o.o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15'
        GROUP BY l_orderkey, o.o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""",
)
by_sql(
    "sql_tpch_q5",
    ["customer", "orders", "lineitem", "supplier", "nation", "region"],
    f"""SELECT n_name, {_REVENUE} AS revenue
        FROM customer, orders, lineitem, supplier, nation, region
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey
          AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey
          AND r_name = 'ASIA' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1998-01-01'
        GROUP BY n_name""",
)
by_sql(
    "sql_tpch_q6",
    ["lineitem"],
    """SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS revenue
       FROM lineitem
       WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1999-01-01'
         AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
)
