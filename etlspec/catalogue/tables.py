"""Queries for the keyed-table operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from etlspec.catalogue.base import query, table
from etlspec.functions.canonical import fingerprint
from etlspec.operators import quality as q
from etlspec.operators.snapshots import existence, overlay, scope_subtree, scope_to, snapshot_diff

# --- snapshot diff: the orders against an older state that lacks the open
# ones, had other prices for the urgent ones, and held cancelled ones besides.

_PRICE = "CAST(o_totalprice AS DECIMAL(18,2))"
_NEW = f"""SELECT o_orderkey, o_custkey, o_orderstatus, {_PRICE} AS price, o_orderpriority FROM orders"""
_OLD = f"""SELECT o_orderkey, o_custkey,
                  CASE WHEN o_orderstatus = 'F' AND o_totalprice > 400000 THEN NULL ELSE o_orderstatus END
                      AS o_orderstatus,
                  CASE WHEN o_orderpriority = '1-URGENT' THEN {_PRICE} + 10 ELSE {_PRICE} END AS price,
                  o_orderpriority
           FROM orders WHERE o_orderstatus <> 'O'
           UNION ALL
           SELECT -1 - o_orderkey, o_custkey, 'X', {_PRICE}, o_orderpriority FROM orders WHERE o_totalprice < 20000"""


def _old_and_new(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("price", F.col("o_totalprice").cast("decimal(18,2)"))
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "price", "o_orderpriority"]
    big_final = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 400000)
    old = (
        orders.filter("o_orderstatus <> 'O'")
        .withColumn("o_orderstatus", F.when(~big_final, F.col("o_orderstatus")))
        .withColumn(
            "price", F.expr("cast(if(o_orderpriority = '1-URGENT', price + 10, price) as decimal(18,2))")
        )
        .select(columns)
    )
    gone = (
        orders.filter("o_totalprice < 20000")
        .withColumn("o_orderkey", -1 - F.col("o_orderkey"))
        .withColumn("o_orderstatus", F.lit("X"))
        .select(columns)
    )
    return old.unionByName(gone), orders.select(columns)


_JOINED = f"""FROM ({_NEW}) n FULL JOIN ({_OLD}) o ON n.o_orderkey = o.o_orderkey"""
_TYPE = """CASE WHEN o.o_orderkey IS NULL THEN 'Create' WHEN n.o_orderkey IS NULL THEN 'Delete'
                WHEN (n.o_custkey, n.o_orderstatus, n.price, n.o_orderpriority) IS DISTINCT FROM
                     (o.o_custkey, o.o_orderstatus, o.price, o.o_orderpriority) THEN 'Modify' END"""
_TYPES_SQL = f"""SELECT * FROM (SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, {_TYPE} AS change_type
                 {_JOINED}) WHERE change_type IS NOT NULL"""


@query("ra_snapshot_diff", _TYPES_SQL)
def ra_snapshot_diff(spark, sf_dir):
    old, new = _old_and_new(spark, sf_dir)
    return snapshot_diff(new, old, ["o_orderkey"], detail=False).select("o_orderkey", "change_type")


def _field_sql(field: str) -> str:
    return f"""SELECT n.o_orderkey, '{field}' AS field, CAST(o.{field} AS VARCHAR) AS old_value, CAST(n.{field} AS VARCHAR) AS new_value
               FROM ({_NEW}) n JOIN ({_OLD}) o ON n.o_orderkey = o.o_orderkey
               WHERE n.{field} IS DISTINCT FROM o.{field}"""


@query(
    "ra_snapshot_diff_changes",
    " UNION ALL ".join(_field_sql(f) for f in ("o_custkey", "o_orderstatus", "price", "o_orderpriority")),
)
def ra_snapshot_diff_changes(spark, sf_dir):
    old, new = _old_and_new(spark, sf_dir)
    return (
        snapshot_diff(new, old, ["o_orderkey"])
        .select("o_orderkey", F.explode("changes").alias("field", "values"))
        .select("o_orderkey", "field", F.col("values.old").alias("old_value"), F.col("values.new").alias("new_value"))
    )


@query(
    "ra_fingerprint",
    """SELECT c_custkey, sha256('{"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name
              || '","c_nationkey":' || c_nationkey || '}') AS fingerprint
       FROM customer""",
)
def ra_fingerprint(spark, sf_dir):
    df = fingerprint(table(spark, sf_dir, "customer"), ["c_name", "c_nationkey", "c_mktsegment"])
    return df.select("c_custkey", "fingerprint")


@query(
    "ra_overlay",
    """SELECT c_custkey,
              CASE WHEN c_acctbal < 0 THEN 'ARREARS' ELSE c_mktsegment END AS c_mktsegment,
              CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0 ELSE c_acctbal END AS c_acctbal,
              CASE WHEN c_mktsegment = 'BUILDING' THEN 'override' ELSE 'base' END AS origin,
              CASE WHEN c_acctbal < 0 THEN 'yes' END AS flagged
       FROM customer""",
)
def ra_overlay(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    base = customer.select(
        "c_custkey", "c_mktsegment", "c_acctbal", F.create_map(F.lit("origin"), F.lit("base")).alias("tags")
    )
    arrears = customer.filter("c_acctbal < 0").select(
        "c_custkey",
        F.lit("ARREARS").alias("c_mktsegment"),
        F.create_map(F.lit("flagged"), F.lit("yes")).alias("tags"),
    )
    building = customer.filter("c_mktsegment = 'BUILDING'").select(
        "c_custkey",
        F.lit(None).cast("string").alias("c_mktsegment"),
        F.lit(0.0).alias("c_acctbal"),
        F.create_map(F.lit("origin"), F.lit("override")).alias("tags"),
    )
    return overlay([base, arrears, building], ["c_custkey"]).select(
        "c_custkey",
        "c_mktsegment",
        "c_acctbal",
        F.try_element_at("tags", F.lit("origin")).alias("origin"),
        F.try_element_at("tags", F.lit("flagged")).alias("flagged"),
    )


_PATH = r"regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '')"


def _pages_with_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.expr(_PATH.replace("\\", "\\\\")).alias("path"))


@query("ra_scope", f"SELECT page_id, {_PATH} AS path FROM pages WHERE {_PATH} = '/en' OR {_PATH} LIKE '/en/%'")
def ra_scope(spark, sf_dir):
    return scope_subtree(_pages_with_path(spark, sf_dir), "path", "/en/")


@query(
    "ra_scope_to",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
       WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def ra_scope_to(spark, sf_dir):
    kept = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return scope_to(orders, kept.withColumnRenamed("c_custkey", "o_custkey"), ["o_custkey"])


# --- row rules

_MESSAGE_SET = """'"' || o_orderstatus || '" is not accepted (use one of: F, O)'"""
_MESSAGE_PATTERN = """'"' || o_orderpriority || '" does not match [1-4]-.*'"""
_CHECKS = {
    "o_orderstatus": [("o_orderstatus NOT IN ('F', 'O')", _MESSAGE_SET, "error")],
    "o_orderpriority": [("NOT regexp_full_match(o_orderpriority, '[1-4]-.*')", _MESSAGE_PATTERN, "warning")],
    "o_totalprice": [("NOT (o_totalprice > 50000)", "'is too small'", "error")],
    "clerk": [
        ("o_orderstatus = 'P' AND o_totalprice <= 250000", "'is required here'", "error"),
    ],
    "clerk, reviewer": [
        ("(o_totalprice > 250000) AND (o_totalprice > 400000)", "'at most one may be set'", "error"),
        ("NOT (o_totalprice > 250000) AND NOT (o_totalprice > 400000)", "'at least one must be set'", "warning"),
    ],
}
_CHECK_SQL = " UNION ALL ".join(
    f"""SELECT o_orderkey, '{field}' AS field, {message} AS message, '{severity}' AS severity
        FROM orders WHERE {violated}"""
    for field, entries in _CHECKS.items()
    for violated, message, severity in entries
)


@query("ra_check_rows", _CHECK_SQL)
def ra_check_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumns(
        {
            "clerk": F.when(F.col("o_totalprice") > 250000, F.lit("c")),
            "reviewer": F.when(F.col("o_totalprice") > 400000, F.lit("r")),
        }
    )
    rules = [
        q.required("o_orderstatus"),
        q.one_of("o_orderstatus", ["F", "O"]),
        q.pattern("o_orderpriority", "[1-4]-.*", severity="warning"),
        q.holds("o_totalprice", "o_totalprice > 50000", "is too small"),
        q.required_when("clerk", 'F.col("o_orderstatus") == "P"'),
        q.exclusive(["clerk", "reviewer"]),
        q.at_least_one(["clerk", "reviewer"], severity="warning"),
    ]
    return q.check_rows(orders, rules, ["o_orderkey"])


# --- duplicates, orphans, existence


@query(
    "ra_duplicates",
    """SELECT text, source AS origin, count(*) AS n_origin, sum(count(*)) OVER (PARTITION BY text)::BIGINT AS n_rows
       FROM documents GROUP BY text, source QUALIFY sum(count(*)) OVER (PARTITION BY text) > 1""",
)
def ra_duplicates(spark, sf_dir):
    return q.find_duplicates(table(spark, sf_dir, "documents"), ["text"], "source")


@query(
    "ra_duplicates_keys",
    """SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
       GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
)
def ra_duplicates_keys(spark, sf_dir):
    return q.find_duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "ra_orphans",
    """SELECT doc_id, quality, toxic, 'doc_id' AS field, CAST(doc_id AS VARCHAR) AS value FROM labels
       WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')""",
)
def ra_orphans(spark, sf_dir):
    english = table(spark, sf_dir, "documents").filter("lang = 'en'")
    return q.find_orphans(table(spark, sf_dir, "labels"), "doc_id", english, "doc_id")


@query(
    "ra_orphans_orders",
    """SELECT o_orderkey, o_custkey, 'o_custkey' AS field, CAST(o_custkey AS VARCHAR) AS value FROM orders
       WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
)
def ra_orphans_orders(spark, sf_dir):
    known = table(spark, sf_dir, "customer").filter("c_acctbal > 0")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return q.find_orphans(orders, "o_custkey", known, "c_custkey")


@query(
    "ra_existence",
    """SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) AS "exists"
       FROM customer""",
)
def ra_existence(spark, sf_dir):
    large = table(spark, sf_dir, "orders").filter("o_totalprice > 450000")
    return existence(
        table(spark, sf_dir, "customer"), large.withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"]
    )
