"""What the catalogue's queries share: registration, tables, scratch space."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from etlspec.plans.pipeline import run_pipeline


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOGUE: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` gives the same result in DuckDB."""

    def register(run):
        if name in CATALOGUE:
            raise ValueError(f"query '{name}' is registered twice")
        CATALOGUE[name] = Query(run, sql)
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source(sf_dir: str, name: str, as_name: str | None = None) -> dict[str, Any]:
    """A parquet source of a spec for one of the tables."""
    return {"name": as_name or name, "type": "s3", "format": "parquet", "path": f"{sf_dir}/{name}.parquet"}


def transformed(
    spark: SparkSession, sf_dir: str, tables: list[str], transforms: list[Mapping[str, Any]], **rest: Any
) -> DataFrame:
    """Run transforms over tables and return the output frame."""
    allow_code = rest.pop("allow_code", False)
    spec = {"sources": [source(sf_dir, t) for t in tables], "transforms": transforms, **rest}
    return run_pipeline(spark, spec, allow_code=allow_code).output


def by_sql(name: str, tables: list[str], text: str, oracle: str | None = None) -> None:
    """Register a one-step ``sql`` spec; ``oracle`` when DuckDB spells it differently."""

    @query(name, oracle or text)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return transformed(spark, sf_dir, tables, [{"type": "sql", "query": text}])


def scratch(spark: SparkSession) -> str:
    """A new directory for tables a query writes and reads back.

    It is below ``spark.checkpoint.dir``, which a cluster points at storage all
    its nodes share. Only a local session without that setting uses a temporary
    folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/etlspec-{uuid.uuid4().hex}"
