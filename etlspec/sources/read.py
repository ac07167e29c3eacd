"""Reading any source of a spec."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from etlspec.plans.registry import added_source
from etlspec.plans.spec import SourceSpec
from etlspec.sources.files import read_files, stream_files
from etlspec.sources.http import read_http
from etlspec.sources.jdbc import Credentials, read_jdbc
from etlspec.sources.kafka import read_kafka, stream_kafka


def table_name(database: str, table: str) -> str:
    return ".".join("`" + part.replace("`", "``") + "`" for part in (*database.split("."), table))


def read_source(spark: SparkSession, source: SourceSpec, credentials: Credentials | None = None) -> DataFrame:
    match source.kind:
        case "s3":
            return read_files(spark, source)
        case "jdbc":
            return read_jdbc(spark, source, credentials)
        case "catalog":
            return spark.table(table_name(source.database, source.table))
        case "kafka":
            return read_kafka(spark, source)
        case "api":
            return read_http(spark, source)
    read = added_source(source.kind)
    if read is None:
        raise ValueError(f"no reader for source kind '{source.kind}'")
    return read(spark, source)


def stream_source(spark: SparkSession, source: SourceSpec) -> DataFrame:
    match source.kind:
        case "s3":
            return stream_files(spark, source)
        case "kafka":
            return stream_kafka(spark, source)
    raise ValueError(f"a source of kind '{source.kind}' cannot be read as a stream")
