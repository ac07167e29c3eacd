"""Queries for the nine transforms and their composition."""

from __future__ import annotations

from etlspec.catalogue.base import query, table, transformed
from etlspec.operators.joins import join
from etlspec.operators.windows import add_window
from etlspec.plans.spec import Order

# --- filter, select, drop_columns, rename, add_column, sql


@query("trn_filter", "SELECT * FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice > 100000")
def trn_filter(spark, sf_dir):
    return transformed(
        spark,
        sf_dir,
        ["orders"],
        [{"type": "filter", "condition": '(F.col("o_orderstatus") != "P") & (col("o_totalprice") > 100000)'}],
    )


@query("trn_filter_sqltext", "SELECT * FROM lineitem WHERE l_quantity >= 25 AND l_returnflag IN ('A', 'R')")
def trn_filter_sqltext(spark, sf_dir):
    return transformed(
        spark,
        sf_dir,
        ["lineitem"],
        [{"type": "filter", "condition": "l_quantity >= 25 AND l_returnflag IN ('A', 'R')"}],
    )


@query("trn_select", "SELECT o_custkey, o_orderkey, o_orderdate FROM orders")
def trn_select(spark, sf_dir):
    return transformed(
        spark, sf_dir, ["orders"], [{"type": "select", "columns": ["o_custkey", "o_orderkey", "o_orderdate"]}]
    )


@query("trn_drop_columns", "SELECT p_partkey, p_name, p_brand, p_size FROM part")
def trn_drop_columns(spark, sf_dir):
    return transformed(
        spark, sf_dir, ["part"], [{"type": "drop_columns", "columns": ["p_type", "p_retailprice", "not_there"]}]
    )


@query(
    "trn_rename",
    """SELECT c_custkey AS customer_id, c_name AS name, c_nationkey, c_acctbal AS balance, c_mktsegment
       FROM customer""",
)
def trn_rename(spark, sf_dir):
    mapping = {"c_custkey": "customer_id", "c_name": "name", "c_acctbal": "balance", "not_there": "ignored"}
    return transformed(spark, sf_dir, ["customer"], [{"type": "rename", "mapping": mapping}])


@query(
    "trn_rename_swap",
    """SELECT l_orderkey, l_suppkey AS l_partkey, l_partkey AS l_suppkey, l_linenumber FROM lineitem""",
)
def trn_rename_swap(spark, sf_dir):
    return transformed(
        spark,
        sf_dir,
        ["lineitem"],
        [
            {"type": "select", "columns": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]},
            {"type": "rename", "mapping": {"l_partkey": "l_suppkey", "l_suppkey": "l_partkey"}},
        ],
    )


@query(
    "trn_add_column",
    """SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount,
              l_extendedprice * (1 - l_discount) AS net_price
       FROM lineitem""",
)
def trn_add_column(spark, sf_dir):
    return transformed(
        spark,
        sf_dir,
        ["lineitem"],
        [
            {
                "type": "add_column",
                "name": "net_price",
                "expression": 'F.col("l_extendedprice") * (1 - F.col("l_discount"))',
            },
            {
                "type": "select",
                "columns": ["l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "net_price"],
            },
        ],
    )


@query(
    "trn_add_column_replace",
    """SELECT c_custkey, c_name, c_nationkey, c_acctbal,
              CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE lower(c_mktsegment) END AS c_mktsegment
       FROM customer""",
)
def trn_add_column_replace(spark, sf_dir):
    text = 'F.when(F.col("c_acctbal") < 0, "DEBT").otherwise(F.lower(F.col("c_mktsegment")))'
    return transformed(
        spark, sf_dir, ["customer"], [{"type": "add_column", "name": "c_mktsegment", "expression": text}]
    )


@query(
    "trn_sql",
    """SELECT n.n_name, count(*) AS n_customers FROM customer c
       JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name""",
)
def trn_sql(spark, sf_dir):
    text = """SELECT n.n_name, count(*) AS n_customers FROM customer c
              JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name"""
    return transformed(spark, sf_dir, ["customer", "nation"], [{"type": "sql", "query": text}])


# --- join


@query(
    "trn_join_inner",
    """SELECT l_orderkey AS orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, o_custkey, o_orderpriority
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def trn_join_inner(spark, sf_dir):
    columns = ["orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "o_custkey", "o_orderpriority"]
    return transformed(
        spark,
        sf_dir,
        ["lineitem", "orders"],
        [
            {"type": "rename", "source": "lineitem", "mapping": {"l_orderkey": "orderkey"}},
            {"type": "rename", "source": "orders", "mapping": {"o_orderkey": "orderkey"}},
            {"type": "join", "left": "lineitem", "right": "orders", "on": "orderkey", "output": "joined"},
            {"type": "select", "source": "joined", "columns": columns},
        ],
    )


def _building_customers(how, left, right, columns):
    return [
        {"type": "filter", "source": "customer", "condition": 'F.col("c_mktsegment") == "BUILDING"'},
        {"type": "rename", "source": "customer", "mapping": {"c_custkey": "custkey"}},
        {"type": "rename", "source": "orders", "mapping": {"o_custkey": "custkey"}},
        {"type": "join", "left": left, "right": right, "on": "custkey", "how": how, "output": "joined"},
        {"type": "select", "source": "joined", "columns": columns},
    ]


@query(
    "trn_join_left",
    """SELECT o.o_custkey AS custkey, o.o_orderkey, o.o_totalprice, c.c_name
       FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') c
       ON o.o_custkey = c.c_custkey""",
)
def trn_join_left(spark, sf_dir):
    steps = _building_customers("left", "orders", "customer", ["custkey", "o_orderkey", "o_totalprice", "c_name"])
    return transformed(spark, sf_dir, ["orders", "customer"], steps)


@query(
    "trn_join_right",
    """SELECT o.o_custkey AS custkey, c.c_name, o.o_orderkey, o.o_totalprice
       FROM (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') c RIGHT JOIN orders o
       ON o.o_custkey = c.c_custkey""",
)
def trn_join_right(spark, sf_dir):
    steps = _building_customers("right", "customer", "orders", ["custkey", "c_name", "o_orderkey", "o_totalprice"])
    return transformed(spark, sf_dir, ["orders", "customer"], steps)


@query(
    "trn_join_outer",
    """SELECT coalesce(c.custkey, o.custkey) AS custkey, c.c_name, c.c_acctbal, o.n_orders
       FROM (SELECT c_custkey AS custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 0) c
       FULL JOIN (SELECT o_custkey AS custkey, count(*) AS n_orders FROM orders
                  WHERE o_totalprice > 300000 GROUP BY o_custkey) o ON c.custkey = o.custkey""",
)
def trn_join_outer(spark, sf_dir):
    return transformed(
        spark,
        sf_dir,
        ["customer", "orders"],
        [
            {"type": "filter", "source": "customer", "condition": "c_acctbal > 0"},
            {"type": "rename", "source": "customer", "mapping": {"c_custkey": "custkey"}},
            {"type": "filter", "source": "orders", "condition": "o_totalprice > 300000"},
            {"type": "rename", "source": "orders", "mapping": {"o_custkey": "custkey"}},
            {"type": "aggregate", "source": "orders", "group_by": ["custkey"], "aggs": {"n_orders": "count(*)"}},
            {"type": "join", "left": "customer", "right": "orders", "on": "custkey", "how": "outer", "output": "both"},
            {"type": "select", "source": "both", "columns": ["custkey", "c_name", "c_acctbal", "n_orders"]},
        ],
    )


def _frequent(name, how, sql):
    """Outer joins with a low limit, so that customers with several orders count as frequent keys.

    Each customer is one row, so the result grows with the tables.
    """

    @query(name, sql)
    def run(spark, sf_dir):
        customer = table(spark, sf_dir, "customer").filter("c_acctbal > 0").selectExpr("c_custkey AS custkey", "c_name")
        orders = table(spark, sf_dir, "orders").filter("o_totalprice < 150000").selectExpr("o_custkey AS custkey", "o_orderkey")
        left, right = (orders, customer) if how == "right" else (customer, orders)
        return join(left, right, "custkey", how, split_rows=1)


_SIDES = """(SELECT c_custkey AS custkey, c_name FROM customer WHERE c_acctbal > 0) c
    {} JOIN (SELECT o_custkey AS custkey, o_orderkey FROM orders WHERE o_totalprice < 150000) o
    ON c.custkey = o.custkey"""
for _how, _word in (("left", "LEFT"), ("right", "LEFT"), ("outer", "FULL")):
    _frequent(
        f"trn_join_{_how}_frequent",
        _how,
        f"SELECT coalesce(c.custkey, o.custkey) AS custkey, c_name, o_orderkey FROM {_SIDES.format(_word)}",
    )

# --- aggregate


@query(
    "trn_aggregate",
    """SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS order_count
       FROM orders GROUP BY o_custkey""",
)
def trn_aggregate(spark, sf_dir):
    aggs = {"total": "cast(sum(cast(o_totalprice as decimal(18,2))) as double)", "order_count": "count(*)"}
    return transformed(spark, sf_dir, ["orders"], [{"type": "aggregate", "group_by": ["o_custkey"], "aggs": aggs}])


_MULTI = """count(*) AS n,
       round(sum(l_quantity), 2) AS sum_qty,
       min(l_extendedprice) AS min_price,
       max(l_extendedprice) AS max_price,
       round(sum(l_extendedprice), 2) / count(*) AS avg_price,
       count(DISTINCT l_partkey) AS parts"""


@query(
    "trn_aggregate_multi",
    f"SELECT l_returnflag, l_linestatus, {_MULTI} FROM lineitem GROUP BY l_returnflag, l_linestatus",
)
def trn_aggregate_multi(spark, sf_dir):
    aggs = {
        "n": "count(*)",
        "sum_qty": "round(sum(l_quantity), 2)",
        "min_price": "min(l_extendedprice)",
        "max_price": "max(l_extendedprice)",
        "avg_price": "round(sum(l_extendedprice), 2) / count(*)",
        "parts": "count(distinct l_partkey)",
    }
    return transformed(
        spark,
        sf_dir,
        ["lineitem"],
        [{"type": "aggregate", "group_by": ["l_returnflag", "l_linestatus"], "aggs": aggs}],
    )


@query(
    "trn_aggregate_expr",
    """SELECT event_type,
              CAST(sum(CASE WHEN value > 10 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS share_large,
              max(length(props)) - min(length(props)) AS props_spread
       FROM events GROUP BY event_type""",
)
def trn_aggregate_expr(spark, sf_dir):
    aggs = {
        "share_large": "cast(sum(case when value > 10 then 1 else 0 end) as double) / count(*)",
        "props_spread": "cast(max(length(props)) - min(length(props)) as bigint)",
    }
    return transformed(spark, sf_dir, ["events"], [{"type": "aggregate", "group_by": ["event_type"], "aggs": aggs}])


# --- window


def _window(spark, sf_dir, table_name, keep, **window):
    return transformed(
        spark, sf_dir, [table_name], [{"type": "window", **window}, {"type": "select", "columns": [*keep, window["name"]]}]
    )


@query(
    "trn_window_row_number",
    """SELECT o_orderkey, o_custkey, CAST(row_number() OVER (
           PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS INTEGER) AS order_rank
       FROM orders""",
)
def trn_window_row_number(spark, sf_dir):
    return _window(
        spark,
        sf_dir,
        "orders",
        ["o_orderkey", "o_custkey"],
        name="order_rank",
        expression="row_number()",
        partition_by=["o_custkey"],
        order_by=[{"column": "o_orderdate", "desc": True}, {"column": "o_orderkey"}],
    )


@query(
    "trn_window_rank",
    """SELECT p_partkey, p_brand, p_size, CAST(dense_rank() OVER (
           PARTITION BY p_brand ORDER BY p_size NULLS FIRST) AS INTEGER) AS size_rank
       FROM part""",
)
def trn_window_rank(spark, sf_dir):
    return _window(
        spark,
        sf_dir,
        "part",
        ["p_partkey", "p_brand", "p_size"],
        name="size_rank",
        expression="dense_rank()",
        partition_by=["p_brand"],
        order_by=[{"column": "p_size"}],
    )


@query(
    "trn_window_lag",
    """SELECT event_id, user_id, value, lag(value, 1) OVER (
           PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id NULLS FIRST) AS previous
       FROM events""",
)
def trn_window_lag(spark, sf_dir):
    return _window(
        spark,
        sf_dir,
        "events",
        ["event_id", "user_id", "value"],
        name="previous",
        expression="lag(value, 1)",
        partition_by=["user_id"],
        order_by=[{"column": "ts"}, {"column": "event_id"}],
    )


@query(
    "trn_window_running_sum",
    """SELECT event_id, event_type, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (
           PARTITION BY event_type ORDER BY user_id NULLS FIRST) AS DOUBLE) AS running
       FROM events""",
)
def trn_window_running_sum(spark, sf_dir):
    return transformed(
        spark,
        sf_dir,
        ["events"],
        [
            {
                "type": "window",
                "name": "running",
                "expression": "sum(cast(value as decimal(18,2)))",
                "partition_by": ["event_type"],
                "order_by": [{"column": "user_id"}],
            },
            {"type": "add_column", "name": "running", "expression": 'F.col("running").cast("double")'},
            {"type": "select", "columns": ["event_id", "event_type", "running"]},
        ],
    )


@query(
    "trn_window_partition_total",
    """SELECT l_orderkey, l_linenumber, l_partkey,
              round(sum(l_quantity) OVER (PARTITION BY l_partkey), 2) AS part_quantity
       FROM lineitem""",
)
def trn_window_partition_total(spark, sf_dir):
    return _window(
        spark,
        sf_dir,
        "lineitem",
        ["l_orderkey", "l_linenumber", "l_partkey"],
        name="part_quantity",
        expression="round(sum(l_quantity), 2)",
        partition_by=["l_partkey"],
    )


@query(
    "trn_window_order_only",
    """SELECT o_orderkey, o_totalprice, CAST(rank() OVER (
           ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS INTEGER) AS price_rank
       FROM orders""",
)
def trn_window_order_only(spark, sf_dir):
    return _window(
        spark,
        sf_dir,
        "orders",
        ["o_orderkey", "o_totalprice"],
        name="price_rank",
        expression="rank()",
        order_by=[{"column": "o_totalprice", "desc": True}, {"column": "o_orderkey"}],
    )


# The same transform with a low limit, so that the tables' groups count as large.


def _sliced(name, table_name, keep, expression, partition_by, order_by, sql):
    @query(name, sql)
    def run(spark, sf_dir):
        df = table(spark, sf_dir, table_name)
        return add_window(df, "w", expression, partition_by, order_by, split_rows=1_000).select(*keep, "w")


_sliced(
    "trn_window_large_row_number",
    "orders",
    ["o_orderkey", "o_orderstatus"],
    "row_number()",
    ["o_orderstatus"],
    [Order("o_totalprice", True), Order("o_orderkey")],
    """SELECT o_orderkey, o_orderstatus, CAST(row_number() OVER (PARTITION BY o_orderstatus
           ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS INTEGER) AS w FROM orders""",
)
_sliced(
    "trn_window_large_rank",
    "lineitem",
    ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
    "rank()",
    ["l_returnflag"],
    [Order("l_shipdate")],
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(rank() OVER (PARTITION BY l_returnflag
           ORDER BY l_shipdate NULLS FIRST) AS INTEGER) AS w FROM lineitem""",
)
_sliced(
    "trn_window_large_running_count",
    "events",
    ["event_id"],
    "count(*)",
    [],
    [Order("ts", True)],
    "SELECT event_id, count(*) OVER (ORDER BY ts DESC NULLS LAST) AS w FROM events",
)
_sliced(
    "trn_window_large_lag",
    "events",
    ["event_id", "event_type"],
    "lag(value, 2, -1.0)",
    ["event_type"],
    [Order("ts"), Order("event_id")],
    """SELECT event_id, event_type, lag(value, 2, -1.0) OVER (PARTITION BY event_type
           ORDER BY ts NULLS FIRST, event_id NULLS FIRST) AS w FROM events""",
)
_sliced(
    "trn_window_large_ntile",
    "customer",
    ["c_custkey"],
    "ntile(7)",
    [],
    [Order("c_name")],
    "SELECT c_custkey, CAST(ntile(7) OVER (ORDER BY c_name NULLS FIRST) AS INTEGER) AS w FROM customer",
)

# --- composition


@query(
    "pipe_flagship",
    "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders WHERE o_totalprice > 0 AND o_orderstatus = 'F'",
)
def pipe_flagship(spark, sf_dir):
    text = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderdate FROM orders WHERE o_totalprice > 0"
    return transformed(
        spark,
        sf_dir,
        ["orders"],
        [
            {"type": "sql", "source": "orders", "output": "projected", "query": text},
            {"type": "filter", "source": "projected", "output": "final", "condition": 'F.col("o_orderstatus") == "F"'},
            {"type": "drop_columns", "source": "final", "output": "clean", "columns": ["o_orderstatus"]},
        ],
    )


@query(
    "pipe_join_chain",
    """SELECT n.n_name AS nation, count(*) AS n_orders,
              CAST(sum(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
       FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
       WHERE o.o_orderpriority = '1-URGENT' GROUP BY n.n_name""",
)
def pipe_join_chain(spark, sf_dir):
    aggs = {"n_orders": "count(*)", "revenue": "cast(sum(cast(o_totalprice as decimal(18,2))) as double)"}
    return transformed(
        spark,
        sf_dir,
        ["orders", "customer", "nation"],
        [
            {"type": "filter", "source": "orders", "condition": "col('o_orderpriority') == '1-URGENT'"},
            {"type": "rename", "source": "orders", "mapping": {"o_custkey": "custkey"}},
            {"type": "rename", "source": "customer", "mapping": {"c_custkey": "custkey", "c_nationkey": "nationkey"}},
            {"type": "rename", "source": "nation", "mapping": {"n_nationkey": "nationkey", "n_name": "nation"}},
            {"type": "join", "left": "orders", "right": "customer", "on": "custkey", "output": "with_customer"},
            {"type": "join", "left": "with_customer", "right": "nation", "on": "nationkey", "output": "full"},
            {"type": "aggregate", "source": "full", "output": "by_nation", "group_by": ["nation"], "aggs": aggs},
        ],
    )


@query(
    "pipe_in_place",
    """SELECT c_custkey, c_acctbal * 2 AS c_acctbal FROM customer WHERE c_acctbal > 1000 AND c_acctbal * 2 < 15000""",
)
def pipe_in_place(spark, sf_dir):
    return transformed(
        spark,
        sf_dir,
        ["customer"],
        [
            {"type": "filter", "condition": "c_acctbal > 1000"},
            {"type": "add_column", "name": "c_acctbal", "expression": 'F.col("c_acctbal") * 2'},
            {"type": "sql", "query": "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 15000"},
        ],
    )


@query(
    "pipe_branch",
    """SELECT user_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS n_errors,
              sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END)::BIGINT AS n_other
       FROM events GROUP BY user_id
       HAVING sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) > 0
          AND sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) > 0""",
)
def pipe_branch(spark, sf_dir):
    def count(name):
        return {name: "count(*)"}

    return transformed(
        spark,
        sf_dir,
        ["events"],
        [
            {"type": "filter", "source": "events", "output": "errors", "condition": "event_type = 'error'"},
            {"type": "filter", "source": "events", "output": "other", "condition": "event_type <> 'error'"},
            {"type": "aggregate", "source": "errors", "group_by": ["user_id"], "aggs": count("n_errors")},
            {"type": "aggregate", "source": "other", "group_by": ["user_id"], "aggs": count("n_other")},
            {"type": "join", "left": "errors", "right": "other", "on": "user_id", "output": "both"},
        ],
    )
