"""Kafka options, the same for a batch read and a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from etlspec.plans.spec import SourceSpec
from etlspec.sources.files import reader_options


def kafka_options(source: SourceSpec) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": source.connection_url,
        "subscribe": source.topic,
        **reader_options(source.options),
    }


def read_kafka(spark: SparkSession, source: SourceSpec) -> DataFrame:
    return spark.read.format("kafka").options(**kafka_options(source)).load()


def stream_kafka(spark: SparkSession, source: SourceSpec) -> DataFrame:
    return spark.readStream.format("kafka").options(**kafka_options(source)).load()
