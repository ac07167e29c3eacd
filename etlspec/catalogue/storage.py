"""Queries that write through a sink and read back through a source.

Each writes a whole table, or what Spark derives from it, below a new scratch
folder, so the table itself is the expected result.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from etlspec.catalogue import jobs
from etlspec.catalogue.base import query, scratch, source, table, transformed
from etlspec.plans.pipeline import run_pipeline
from etlspec.plans.registry import register_sink, register_source
from etlspec.streaming.incremental import BATCH_COLUMN, RUN_COLUMN, run_incremental

_ORDERS = "SELECT * FROM orders"


def _written(spark, sf_dir, name, sink, **rest):
    """Run a spec from one table into a sink; return the path written."""
    path = scratch(spark)
    provider = rest.pop("provider", "iceberg")
    spec = {"sources": [source(sf_dir, name)], "sink": {"path": path, **sink}, **rest}
    run_pipeline(spark, spec).write(provider=provider)
    return path


def _new_table(spark, name):
    """A table name of this run alone, so that runs on one metastore leave each other's tables be."""
    return f"{name}_{uuid.uuid4().hex}"


def _read(spark, **fields):
    return run_pipeline(spark, {"sources": [{"name": "back", **fields}]}).output


# --- sources


@query("src_parquet", _ORDERS)
def src_parquet(spark, sf_dir):
    return run_pipeline(spark, {"sources": [source(sf_dir, "orders")]}).output


@query("src_csv", "SELECT * FROM customer")
def src_csv(spark, sf_dir):
    path, customer = scratch(spark), table(spark, sf_dir, "customer")
    customer.write.option("header", True).option("sep", "|").csv(path)
    schema = "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"
    options = {"header": True, "sep": "|", "schema": schema}
    return _read(spark, type="s3", format="csv", path=path, options=options)


@query("src_json", "SELECT * FROM events")
def src_json(spark, sf_dir):
    path = scratch(spark)
    form = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    table(spark, sf_dir, "events").write.options(**form).json(path)
    schema = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
    return _read(spark, type="s3", format="json", path=path, options={"schema": schema, **form})


@query("src_orc", "SELECT * FROM lineitem")
def src_orc(spark, sf_dir):
    path = scratch(spark)
    table(spark, sf_dir, "lineitem").write.orc(path)
    return _read(spark, type="s3", format="orc", path=path)


@query("src_catalog", "SELECT * FROM part")
def src_catalog(spark, sf_dir):
    name = _new_table(spark, "etlspec_part")
    table(spark, sf_dir, "part").write.option("path", scratch(spark)).saveAsTable(f"default.{name}")
    return _read(spark, type="catalog", database="default", table=name)


@query("src_api", "SELECT * FROM customer")
def src_api(spark, sf_dir):
    """JSON lines written by Spark stand in for the responses: one URL per file."""
    path = scratch(spark)
    table(spark, sf_dir, "customer").write.json(path)
    urls = sorted(spark.read.text(path).inputFiles())
    options = {"urls": urls, "schema": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"}
    return _read(spark, type="api", url=urls[0], options=options)


@query("src_registered", _ORDERS)
def src_registered(spark, sf_dir):
    register_source("orc")
    path = scratch(spark)
    table(spark, sf_dir, "orders").write.orc(path)
    return _read(spark, type="orc", path=path)


# --- sinks


@query("snk_parquet", "SELECT * FROM lineitem")
def snk_parquet(spark, sf_dir):
    return spark.read.parquet(_written(spark, sf_dir, "lineitem", {"type": "s3", "format": "parquet"}))


@query("snk_csv", "SELECT * FROM supplier")
def snk_csv(spark, sf_dir):
    path = _written(spark, sf_dir, "supplier", {"type": "s3", "format": "csv"})
    return spark.read.schema("s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE").csv(path)


@query("snk_json", "SELECT * FROM part")
def snk_json(spark, sf_dir):
    path = _written(spark, sf_dir, "part", {"type": "s3", "format": "json"})
    return spark.read.schema(table(spark, sf_dir, "part").schema).json(path)


@query("snk_orc", "SELECT * FROM events")
def snk_orc(spark, sf_dir):
    return spark.read.orc(_written(spark, sf_dir, "events", {"type": "s3", "format": "orc"}))


@query("snk_append", _ORDERS)
def snk_append(spark, sf_dir):
    path = scratch(spark)
    for mode, condition in (("overwrite", "o_orderstatus = 'F'"), ("append", "o_orderstatus <> 'F'")):
        spec = {
            "sources": [source(sf_dir, "orders")],
            "transforms": [{"type": "filter", "condition": condition}],
            "sink": {"type": "s3", "path": path, "mode": mode},
        }
        run_pipeline(spark, spec).write()
    return spark.read.parquet(path)


@query("snk_partitioned", _ORDERS)
def snk_partitioned(spark, sf_dir):
    sink = {"type": "s3", "format": "parquet", "partition_by": ["o_orderstatus", "o_orderpriority"]}
    return spark.read.parquet(_written(spark, sf_dir, "orders", sink))


@query("snk_catalog", "SELECT * FROM customer")
def snk_catalog(spark, sf_dir):
    name = _new_table(spark, "etlspec_customer")
    sink = {"type": "catalog", "database": "default", "table": name, "partition_by": ["c_mktsegment"]}
    _written(spark, sf_dir, "customer", sink)
    return spark.table(f"default.{name}")


def _table_format(spark, sf_dir, name, target, steps=(), sink=None, **rest):
    """The table-format sink, with parquet tables standing in for the format."""
    target = _new_table(spark, target)
    block = {"type": "iceberg", "database": "default", "table": target, **(sink or {})}
    _written(spark, sf_dir, name, block, transforms=list(steps), provider="parquet", **rest)
    return spark.table(f"default.{target}")


@query("snk_table_format", "SELECT * FROM supplier")
def snk_table_format(spark, sf_dir):
    return _table_format(spark, sf_dir, "supplier", "etlspec_supplier", sink={"mode": "append"})


@query(
    "snk_fill_nulls",
    """SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), '') AS status,
              CASE WHEN o_totalprice > 250000 THEN o_totalprice ELSE 0.0 END AS price, '' AS nothing
       FROM orders""",
)
def snk_fill_nulls(spark, sf_dir):
    text = """SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status,
                     CASE WHEN o_totalprice > 250000 THEN o_totalprice END AS price, NULL AS nothing FROM orders"""
    return _table_format(spark, sf_dir, "orders", "etlspec_filled", [{"type": "sql", "query": text}])


@query(
    "snk_time_partition",
    """SELECT CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, count(*) AS n
       FROM orders GROUP BY ALL""",
)
def snk_time_partition(spark, sf_dir):
    back = _table_format(
        spark,
        sf_dir,
        "orders",
        "etlspec_monthly",
        partition_by=["year", "month"],
        partition_timestamp_column="o_orderdate",
    )
    return back.groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"))


@query("snk_ingestion_timestamp", "SELECT event_id, true AS stamped FROM events")
def snk_ingestion_timestamp(spark, sf_dir):
    back = _table_format(spark, sf_dir, "events", "etlspec_stamped", partition_by=["year"], create_timestamp=True)
    same_year = F.col("year") == F.year("ingestion_timestamp")
    return back.select("event_id", (F.col("ingestion_timestamp").isNotNull() & same_year).alias("stamped"))


@query("snk_registered", "SELECT * FROM customer")
def snk_registered(spark, sf_dir):
    register_sink("parquet_zstd", lambda df, sink: df.write.option("compression", "zstd").parquet(sink.path))
    return spark.read.parquet(_written(spark, sf_dir, "customer", {"type": "parquet_zstd"}))


# --- incremental runs


@query(
    "str_file_drop",
    """SELECT user_id, event_id, value * 2 AS doubled FROM events WHERE event_type <> 'view'""",
)
def str_file_drop(spark, sf_dir):
    """Two drops into one folder, a run after each; the second reads only the new files."""
    base, events = scratch(spark), table(spark, sf_dir, "events")
    spec = {
        "sources": [{"name": "events", "type": "s3", "path": f"{base}/drops"}],
        "transforms": [
            {"type": "filter", "condition": "event_type <> 'view'"},
            {"type": "sql", "query": "SELECT user_id, event_id, value * 2 AS doubled FROM events"},
        ],
        "sink": {"type": "s3", "path": f"{base}/out"},
    }
    for condition in ("event_type in ('click', 'view')", "event_type not in ('click', 'view')"):
        events.filter(condition).write.mode("append").parquet(f"{base}/drops")
        run_incremental(spark, spec, f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").drop(RUN_COLUMN, BATCH_COLUMN)


# --- code in specs


@query("udf_body", "SELECT event_type, round(max(sqrt(value)), 9) AS root FROM events GROUP BY event_type")
def udf_body(spark, sf_dir):
    body = """
rooted = df_events.withColumn("root", F.sqrt("value"))
digits = int(math.pow(3, 2))
df_result = rooted.groupBy("event_type").agg(F.round(F.max("root"), digits).alias("root"))
"""
    return transformed(spark, sf_dir, ["events"], [], body=body, imports=[{"name": "math"}], allow_code=True)


@query(
    "udf_job_file",
    """SELECT o_orderpriority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
       FROM orders GROUP BY o_orderpriority""",
)
def udf_job_file(spark, sf_dir):
    spec = {"sources": [source(sf_dir, "orders")], "job_file": "order_totals.py"}
    return run_pipeline(spark, spec, base_dir=list(jobs.__path__)[0], allow_code=True).output


@query(
    "udf_registered",
    """SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem""",
)
def udf_registered(spark, sf_dir):
    @F.pandas_udf("double")
    def discounted(price: pd.Series, discount: pd.Series) -> pd.Series:
        return price * (1 - discount)

    spark.udf.register("etlspec_discounted", discounted)
    return transformed(
        spark,
        sf_dir,
        ["lineitem"],
        [
            {"type": "add_column", "name": "net", "expression": "etlspec_discounted(l_extendedprice, l_discount)"},
            {"type": "select", "columns": ["l_orderkey", "l_linenumber", "net"]},
        ],
    )
