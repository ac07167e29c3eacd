"""Writing a frame to the sink of a spec. These are the only actions of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from etlspec.functions.canonical import quoted
from etlspec.plans.registry import added_sink
from etlspec.plans.spec import SinkSpec
from etlspec.sources.jdbc import Credentials, jdbc_options
from etlspec.sources.read import table_name

DEFAULT_MODE = "error"


def write_sink(
    df: DataFrame, sink: SinkSpec, *, credentials: Credentials | None = None, provider: str = "iceberg"
) -> None:
    """Write ``df`` as the sink says.

    ``provider`` is the table format behind sinks of kind ``iceberg``. A format
    that is not a version-2 catalog table is written with ``saveAsTable``.
    """
    match sink.kind:
        case "s3":
            _files(df, sink)
        case "jdbc":
            writer = df.write.format("jdbc").options(**jdbc_options(sink, credentials))
            writer.mode(sink.mode or DEFAULT_MODE).save()
        case "catalog":
            _catalog(df, sink, None)
        case "iceberg" if provider == "iceberg":
            _table_format(df, sink, provider)
        case "iceberg":
            _catalog(df, sink, provider)
        case kind:
            write = added_sink(kind)
            if write is None:
                raise ValueError(f"no writer for sink kind '{kind}'")
            write(df, sink)


def arranged(df: DataFrame, partition_by: tuple[str, ...]) -> DataFrame:
    """Bring rows of a partition value together before a partitioned write.

    Without this every task writes a file per value it holds. Rebalancing,
    unlike repartitioning, lets adaptive execution split a value that holds
    much of the data and merge the small ones.
    """
    return df.hint("rebalance", *map(quoted, partition_by)) if partition_by else df


def _files(df: DataFrame, sink: SinkSpec) -> None:
    writer = arranged(df, sink.partition_by).write.format(sink.format or "parquet").mode(sink.mode or DEFAULT_MODE)
    if sink.partition_by:
        writer = writer.partitionBy(*sink.partition_by)
    writer.save(sink.path)


def _catalog(df: DataFrame, sink: SinkSpec, provider: str | None) -> None:
    writer = arranged(df, sink.partition_by).write.mode(sink.mode or DEFAULT_MODE)
    if provider or sink.format:
        writer = writer.format(provider or sink.format)
    if sink.path:
        writer = writer.option("path", sink.path)
    if sink.partition_by:
        writer = writer.partitionBy(*sink.partition_by)
    writer.saveAsTable(table_name(sink.database, sink.table))


def _table_format(df: DataFrame, sink: SinkSpec, provider: str) -> None:
    """Create the table when it is missing; else append, or replace all rows."""
    table = table_name(sink.database, sink.table)
    writer = df.writeTo(table)
    if sink.mode is None or not df.sparkSession.catalog.tableExists(table):
        writer = writer.using(provider)
        if sink.partition_by:
            writer = writer.partitionedBy(*map(quoted, sink.partition_by))
        writer.create()
    elif sink.mode == "append":
        writer.append()
    else:
        writer.overwrite(F.lit(True))
