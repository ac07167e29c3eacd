"""File sources and the option rules every source shares."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from etlspec.plans.spec import SourceSpec


def reader_options(options: Mapping[str, Any]) -> dict[str, str]:
    """Option values as the text Spark expects; ``schema`` is not an option."""
    return {k: _text(v) for k, v in options.items() if v is not None and k != "schema"}


def _text(value: Any) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    return value if isinstance(value, str) else json.dumps(value)


def read_files(spark: SparkSession, source: SourceSpec) -> DataFrame:
    """Parquet, CSV, JSON or ORC under a path.

    ``options.schema`` (a DDL string) fixes the schema. Without it CSV and JSON
    read the data once more to infer one, which is worth avoiding on big input.
    """
    return _configured(spark.read, source).load(source.path)


def stream_files(spark: SparkSession, source: SourceSpec) -> DataFrame:
    """The same files as a stream. A schema not given is taken from a batch read."""
    reader = _configured(spark.readStream, source)
    if "schema" not in source.options:
        reader = reader.schema(read_files(spark, source).schema)
    return reader.load(source.path)


def _configured(reader, source: SourceSpec):
    reader = reader.format(source.format or "parquet").options(**reader_options(source.options))
    return reader.schema(source.options["schema"]) if "schema" in source.options else reader
